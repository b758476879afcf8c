"""Per-clip summaries of detections and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def representative_frame(rows: DataFrame, clip: str, t: str, active: str, name: str, confidence: str) -> DataFrame:
    """Of each clip the moment with an active row, then most distinct names, then mean confidence, then the
    latest; rows without a name don't count. Moments are summed before the shuffle by clip."""
    frames = rows.where(F.coalesce(F.col(name), F.lit("")) != "").groupBy(clip, t).agg(F.max(F.col(active).cast("int")).alias("any_active"), F.countDistinct(name).alias("names"), F.avg(confidence).alias("mean"))
    w = Window.partitionBy(clip).orderBy(F.desc("any_active"), F.desc("names"), F.desc("mean"), F.desc(t))
    return frames.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def loadout(rows: DataFrame, clip: str, order: list[str], active: str, name: str, slot: str) -> DataFrame:
    """First active name, names in order of first appearance, and whether two slots or more make it credible."""
    w = Window.partitionBy(clip, name).orderBy(*order)
    first = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    names = first.groupBy(clip).agg(F.array_sort(F.collect_list(F.struct(*order, name))).alias("x"))
    names = names.select(clip, F.transform("x", lambda s: s[name]).alias("names"))
    facts = rows.groupBy(clip).agg(F.min_by(F.when(F.col(active), F.col(name)), F.when(F.col(active), F.struct(*order))).alias("first_active"), (F.countDistinct(slot) >= 2).alias("credible"))
    return names.join(facts, clip)


def death_row(rows: DataFrame, clip: str, weapon: str, t: str, key: str) -> DataFrame:
    """A10: of each clip the latest row with a weapon, else the latest one."""
    w = Window.partitionBy(clip).orderBy(F.col(weapon).isNull(), F.desc(t), F.desc(key))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def ordered_distinct(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Of each group the first of values that are equal trimmed and lowered; blanks dropped."""
    key = F.lower(F.trim(value))
    w = Window.partitionBy(by, key).orderBy(order)
    return rows.where(F.trim(value) != "").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def distinct_array(values: Column) -> Column:
    """A18 on arrays: trimmed, case-insensitive, first wins, in order."""
    clean = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(clean, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))


def latest_and_before(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """The last value of a timeline, and the distinct other values before it, in order of first appearance."""
    w = Window.partitionBy(by, value).orderBy(*order)
    first = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    seen = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("x")).select(by, F.transform("x", lambda s: s[value]).alias("values"))
    last = rows.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias("latest"))
    return seen.join(last, by).select(by, "latest", F.array_except("values", F.array("latest")).alias("previous"))


def histogram(rows: DataFrame, by: str, value: str) -> DataFrame:
    """A4: counts of each value in each group, and the dominant one: most rows, then the first by name."""
    n = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(by).agg(F.max_by(value, F.struct("n", F.expr(f"transform(split({value}, ''), c -> -ascii(c))"))).alias("dominant"))
    return n.join(best, by)


def frequent_terms(rows: DataFrame, by: str, words: Column, stop: list[str], n: int = 8) -> DataFrame:
    """The n most frequent words of each group, ties by word, stop words aside."""
    counts = rows.select(by, F.explode(words).alias("token")).where(~F.col("token").isin(*stop)).groupBy(by, "token").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "token")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def transcript_anchor(segments: DataFrame, clip: str, order: list[str], text: str, term: Column) -> DataFrame:
    """Of each clip the first segment that holds the term, else the first one."""
    w = Window.partitionBy(clip).orderBy(~F.coalesce(F.contains(F.lower(text), F.lower(term)), F.lit(False)), *order)
    return segments.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
