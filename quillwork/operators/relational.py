"""Scans, upserts, filters and joins on tables of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of source over rows of target by keys, all fields; fields in keep_old keep the old
    value where the new one is null. A full join; the result is written elsewhere and swapped in."""
    s, t = source.alias("s"), target.alias("t")
    on = [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys]
    both = t.join(s, on, "full")
    there = F.col(f"s.{keys[0]}").isNotNull()

    def field(c: str) -> Column:
        if c in keys or c in keep_old:
            return F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c)
        return F.when(there, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    return both.select(*[field(c) for c in target.columns])


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """K1: one row of each key, the first in order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def replace_for_keys(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """K6: all rows of the keys in source give way to source's."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """source's rows of keys that target lacks are added."""
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def change_capture(listing: DataFrame, state: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """(keys, status): new, changed, unchanged or missing, by the compared fields."""
    a, b = listing.alias("a"), state.alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    k = keys[0]
    status = F.when(F.col(f"b.{k}").isNull(), "new").when(F.col(f"a.{k}").isNull(), "missing").when(same, "unchanged").otherwise("changed")
    return both.select(*[F.coalesce(F.col(f"a.{x}"), F.col(f"b.{x}")).alias(x) for x in keys], status.alias("status"))


def missing(state: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """State rows that were not seen."""
    return state.join(seen.select(*keys), keys, "left_anti")


def duplicates_hashed(rows: DataFrame, name: str, size: str, content: Column) -> DataFrame:
    """A hash of the content only where a (lowered name, size) occurs more than once."""
    w = Window.partitionBy(F.lower(name), F.col(size))
    return rows.withColumn("copies", F.count(F.lit(1)).over(w)).withColumn("file_hash", F.when(F.col("copies") > 1, F.sha2(content.cast("binary"), 256)))


def sidecar_groups(files: DataFrame, stem: Column, path: str, is_main: Column) -> DataFrame:
    """Files of one lowered stem: the first main file and the others, sorted; groups without a main file go."""
    g = files.withColumn("stem", F.lower(stem)).withColumn("main", is_main)
    out = g.groupBy("stem").agg(
        F.min_by(F.when(F.col("main"), F.col(path)), F.when(F.col("main"), F.struct(F.lower(path), F.col(path)))).alias("primary"),
        F.array_sort(F.collect_list(path)).alias("all"),
    )
    return out.where("primary is not null").select("stem", "primary", F.filter("all", lambda x: x != F.col("primary")).alias("related"))


def group_stats(rows: DataFrame, group: str, status: str, at: str) -> DataFrame:
    """A1, A2: of each group its rows, those of each status, and the latest time."""
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("clips"),
        F.count_if(F.col(status) == "indexed").alias("indexed"),
        F.count_if(F.col(status) == "failed").alias("failed"),
        F.count_if(F.col(status) == "pending").alias("pending"),
        F.max(at).alias("latest"),
    )


def holds_any_term(fields: list[Column], terms: list[str]) -> Column:
    """does a field hold a term, letter case aside? `%` and `_` are letters like others."""
    out = F.lit(False)
    for f in fields:
        for t in terms:
            out = out | F.coalesce(F.contains(F.lower(f), F.lit(t.lower())), F.lit(False))
    return out


def filtered(rows: DataFrame, order: list[str], **equal) -> DataFrame:
    """the given equalities, where given, and an order."""
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == v)
    return rows.orderBy(*order)


def tail(rows: DataFrame, key: str, after: int, n: int) -> DataFrame:
    """The next n rows after a key."""
    return rows.where(F.col(key) > after).orderBy(key).limit(n)


def needing_index(clips: DataFrame, items: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Clips to index again: forced, new or changed, not done, no summary, or an embedding of another model."""
    stale = items.where(~F.col("model").eqNullSafe(F.lit(model))).select("clip_id").distinct().withColumn("stale", F.lit(True))
    due = F.lit(force) | F.col("scan_status").isin("new", "changed") | F.col("status").isin("pending", "partial", "failed") | (F.trim(F.coalesce("summary", F.lit(""))) == "")
    return clips.join(stale, "clip_id", "left").where(due | F.coalesce("stale", F.lit(False))).drop("stale")


def upsert_two_keys(target: DataFrame, source: DataFrame, first: str, second: list[str], key: str) -> DataFrame:
    """K2: rows of source replace the row of the same `first` key, else of the same `second` keys, with all their
    fields; others are added, with a null `key`. target has `key`; source hasn't."""
    by_first = target.where(F.col(first).isNotNull()).select(F.col(first).alias("f_"), F.col(key).alias("k1_"))
    by_second = target.select(*[F.col(c).alias(f"{c}_") for c in second], F.col(key).alias("k2_"))
    found = source.join(by_first, F.col(first) == F.col("f_"), "left").join(by_second, [F.col(c) == F.col(f"{c}_") for c in second], "left")
    new = found.withColumn(key, F.coalesce("k1_", "k2_")).select(*target.columns)
    return target.join(new.where(F.col(key).isNotNull()).select(key), key, "left_anti").select(*target.columns).unionByName(new)


def updated(target: DataFrame, where: Column, **values: Column) -> DataFrame:
    """K9: the given columns of the rows that meet a condition."""
    return target.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def emptied(*tables: DataFrame) -> list[DataFrame]:
    """The tables without rows, to be written over them: all of them, so none keeps rows of deleted clips."""
    return [t.limit(0) for t in tables]


def without_clips(points: DataFrame, gone: DataFrame, key: str = "clip_id") -> DataFrame:
    """Points of deleted clips leave every collection."""
    return points.join(gone.select(key).distinct(), key, "left_anti")


def of_size(points: DataFrame, vector: str, size: int) -> DataFrame:
    """Points whose vectors have the collection's size; others belong to one that is made anew."""
    return points.where(F.size(vector) == size)


def validated(detections: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Detections of known candidates only."""
    return detections.join(candidates.select(key).distinct(), key, "left_semi")


def zipped(a: Column, b: Column) -> Column:
    """Pairs by position, up to the longer one."""
    return F.arrays_zip(a, b)


def best_reference(scores: DataFrame, item: str, reference: str, entity: str) -> DataFrame:
    """Of (item, reference, entity, score) the best of each reference, then of each entity."""
    each = scores.groupBy(item, reference, entity).agg(F.max("score").alias("score"))
    return each.groupBy(item, entity).agg(F.max("score").alias("score"))


def in_slot_order(rows: DataFrame, slot: str, order: list[str]) -> DataFrame:
    """By a given order of slots, unknown ones last."""
    table = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    return rows.orderBy(F.coalesce(F.try_element_at(table, F.col(slot)), F.lit(99)), slot)
