"""Data-quality rules: each gives violations as rows, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule whose condition of trouble holds; one pass, no shuffle."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return rows.select(key, F.explode(found).alias("rule"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, rule: str) -> DataFrame:
    """Child keys that no parent has, as (key, rule)."""
    own = parent.select(F.col(parent_key).alias("p_"))
    return child.join(own, F.col(child_key) == F.col("p_"), "left_anti").select(F.col(child_key).cast("string").alias("key"), F.lit(rule).alias("rule")).distinct()


def duplicates(rows: DataFrame, key: str, rule: str) -> DataFrame:
    """Keys that occur more than once, as (key, rule)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"))


def within(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Is the interval inside the analysed range, with a slack of 1e-6?"""
    return (start >= low) & (end <= high + 1e-6) & (start <= end)


def missing_items(required: Column, there: Column) -> Column:
    """What is required and isn't there."""
    return F.array_except(required, there)


def repeated(rows: DataFrame, by: str, mark: Column, most: int) -> DataFrame:
    """(by, mark, n) of marks that a group holds more than `most` times."""
    return rows.withColumn("mark", mark).groupBy(by, "mark").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > most) & (F.col("mark") != ""))


def death_classes(captions: DataFrame, markers: DataFrame, key: str, caption_id: str, start: str, end: str, marker_id: str, at: str, known: Column, tolerance: float = 1.5) -> DataFrame:
    """A caption whose middle lies within the tolerance of a hit marker is the player's kill candidate where the
    outcome is known, uncertain where it isn't; all others are another's death. Captions keep their columns."""
    from quillwork.operators.timeline import nearest_point

    mid = captions.withColumn("mid", (F.col(start) + F.col(end)) / 2)
    near = nearest_point(mid, markers, key, caption_id, "mid", marker_id, at, tolerance)
    kind = F.when(F.col(marker_id).isNull(), "other_death_audio").when(known, "player_kill_candidate").otherwise("uncertain_death_audio")
    return near.withColumn("class", kind).drop("mid")


def ledger(clips: DataFrame, key: str, **evidence: DataFrame) -> DataFrame:
    """One nested row a clip: for each kind of evidence a sorted array of its structs, empty if there is none."""
    out = clips
    for name, rows in evidence.items():
        fields = [c for c in rows.columns if c != key]
        lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))
    return out
