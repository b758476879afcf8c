"""Intervals and sequences: windows, islands, nearest and as-of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(df: DataFrame, duration: str, length: float, stride: float) -> DataFrame:
    """(index, start_sec, end_sec) windows of each row; the last is cut at the end, none begins after one
    that reaches it."""
    n = F.greatest(F.lit(0), F.ceil((F.col(duration) - length) / stride)).cast("long")
    out = df.where(F.col(duration) > 0).withColumn("index", F.explode(F.sequence(F.lit(0).cast("bigint"), n)))
    start = F.col("index") * F.lit(float(stride))
    return out.withColumn("start_sec", start).withColumn("end_sec", F.least(start + length, F.col(duration)))


def caption_windows(df: DataFrame, key: str, duration: str, length: float, stride: float, least: float = 0.5, first: float = 0.0) -> DataFrame:
    """Windows of at most 30 s from `first` on, with a tail window up to the end, none under `least`."""
    length = min(length, 30.0)
    n = F.floor((F.col(duration) - first - length) / stride).cast("long")
    whole = df.where(F.col(duration) - first >= length).select(key, F.col(duration).alias("d"), F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("i"))
    starts = F.lit(first) + F.col("i") * stride
    whole = whole.select(key, starts.alias("start_sec"), (starts + length).alias("end_sec"))
    tail_start = F.when(F.col(duration) - first < length, F.lit(first)).otherwise(F.lit(first) + (n + 1) * stride)
    tail = df.select(key, tail_start.alias("start_sec"), F.col(duration).alias("end_sec")).where(F.col("end_sec") - F.col("start_sec") >= least)
    return whole.unionByName(tail)


def midpoints(start: Column, end: Column, n: int) -> Column:
    """N times at the middles of equal parts."""
    step = (end - start) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + step * (i + 0.5))


def islands(rows: DataFrame, by: str, order: list[str], same: list[str], at: str, value: str) -> DataFrame:
    """Runs of rows that agree in `same`: start, end, number and largest value. Null agrees with null."""
    w = Window.partitionBy(by).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    fresh = F.when(changed | (F.row_number().over(w) == 1), 1).otherwise(0)
    marked = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return marked.groupBy(by, "island", *same).agg(F.min(at).alias("start_at"), F.max(at).alias("end_at"), F.count(F.lit(1)).alias("n"), F.max(value).alias("best"))


def head_and_tail(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """Of groups of more than `most` rows the first and last halves."""
    w = Window.partitionBy(by).orderBy(*order)
    out = rows.withColumn("rn", F.row_number().over(w)).withColumn("cnt", F.count(F.lit(1)).over(Window.partitionBy(by)))
    half = most // 2
    return out.where((F.col("cnt") <= most) | (F.col("rn") <= half) | (F.col("rn") > F.col("cnt") - (most - half)))


def distance(t: Column, start: Column, end: Column) -> Column:
    """0 inside, else to the nearer edge; a missing edge is the other one."""
    a, b = F.coalesce(start, end), F.coalesce(end, start)
    return F.when(t < a, a - t).when(t > b, t - b).otherwise(F.lit(0.0))


def in_cells(rows: DataFrame, low: Column, high: Column, width: float) -> DataFrame:
    """Each row once for every cell of `width` that [low, high] touches, as `cell`: with the key, the cell makes a join on
    nearness in time an equi-join whose candidates follow the density, not the length of a clip."""
    return rows.withColumn("cell", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))


def nearest_interval(points: DataFrame, intervals: DataFrame, key: str, point_id: str, t: str, start: str, end: str, tie: str, width: float = 8.0) -> DataFrame:
    """The interval of the same key nearest to each point, ties by start, then `tie`.

    Three candidates decide: of the intervals around the point the first, met by cells of `width`; the last that ended
    before; the next that begins after. The latter two come from running values over points and edges in
    order of time, so nothing is paired along a clip. A missing edge is the other one; intervals without any go.
    """
    own = intervals.select(key, start, end, tie, F.coalesce(start, end).alias("x"), F.coalesce(end, start).alias("y")).where("x is not null")
    own = own.select(key, start, end, tie, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    own = own.select(key, "a", "b", F.struct(F.col(start).alias("start"), F.col(tie).alias("tie"), F.col(end).alias("end"), "a", "b").alias("own"))
    at = points.select(key, point_id, F.col(t).alias("t"))
    around = at.withColumn("cell", F.floor(F.col("t") / width)).join(in_cells(own, F.col("a"), F.col("b"), width), [key, "cell"]).where("t between a and b")
    found = around.select(key, point_id, "t", "own")
    none = F.lit(None).cast(own.schema["own"].dataType)
    asked = at.select(key, F.col("t").alias("at"), point_id, "t", none.alias("own"))
    nobody = F.lit(None).cast(at.schema[point_id].dataType).alias(point_id)
    for edge, direction in (("b", F.asc), ("a", F.desc)):
        edges = own.select(key, F.col(edge).alias("at"), nobody, F.lit(None).cast("double").alias("t"), "own")
        # of edges at one time the one to win comes last
        w = Window.partitionBy(key).orderBy(direction("at"), F.desc("own.start"), F.desc("own.tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        near = asked.unionByName(edges).withColumn("near", F.last("own", ignorenulls=True).over(w))
        found = found.unionByName(near.where("t is not null and near is not null").select(key, point_id, "t", F.col("near").alias("own")))
    best = F.struct(distance(F.col("t"), F.col("own.a"), F.col("own.b")).alias("distance"), F.col("own.start").alias("start"), F.col("own.tie").alias("tie"), F.col("own.end").alias("end"))
    out = found.groupBy(key, point_id, "t").agg(F.min(best).alias("best"))
    return out.select(key, point_id, F.col("t").alias(t), F.col("best.tie").alias(tie), F.col("best.start").alias(start), F.col("best.end").alias(end), "best.distance")


def nearest_point(left: DataFrame, right: DataFrame, key: str, left_id: str, t: str, right_id: str, s: str, tolerance: float) -> DataFrame:
    """For each left row the right time nearest to its own within the tolerance, else nulls.

    Both sides fall into cells of the width of the tolerance, and a left row meets its cell and the two
    beside it: an equi-join, whose candidates follow the density in time, not the length of a clip.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    spread = left.withColumn("cell", F.explode(F.array(cell(t) - 1, cell(t), cell(t) + 1)))
    both = spread.join(right.withColumn("cell", cell(s)), [key, "cell"])
    gap = F.abs(F.col(t) - F.col(s))
    best = both.where(gap <= tolerance).groupBy(key, left_id).agg(F.min(F.struct(gap.alias("gap"), F.col(s).alias("s"), F.col(right_id).alias("id"))).alias("best"))
    found = best.select(F.col(key).alias("k_"), F.col(left_id).alias("l_"), F.col("best.gap").alias("gap"), F.col("best.s").alias(s), F.col("best.id").alias(right_id))
    return left.join(found, (F.col(key) == F.col("k_")) & (F.col(left_id) == F.col("l_")), "left").drop("k_", "l_")


def active_at(points: DataFrame, ranges: DataFrame, key: str, point_id: str, t: str, start: str, end: str, name: str, tolerance: float = 2.5) -> DataFrame:
    """What is active at a time: a range around it, else the nearest within the tolerance, later ends first.
    Points and ranges meet by cells of twice the tolerance."""
    gap = distance(F.col(t), F.col(start), F.col(end))
    low, high = F.coalesce(start, end), F.greatest(start, end)
    dealt = in_cells(ranges.where(low.isNotNull()), low - tolerance, high + tolerance, 2 * tolerance)
    both = points.withColumn("cell", F.floor(F.col(t) / (2 * tolerance))).join(dealt, [key, "cell"]).where(gap <= tolerance)
    best = F.struct(gap.alias("gap"), (-F.col(end)).alias("late"), F.col(name).alias("name"))
    found = both.groupBy(key, point_id).agg(F.min(best).alias("best")).select(F.col(key).alias("k_"), F.col(point_id).alias("p_"), F.col("best.name").alias(name), F.col("best.gap").alias("gap"))
    return points.join(found, (F.col(key) == F.col("k_")) & (F.col(point_id) == F.col("p_")), "left").drop("k_", "p_")


def as_of(points: DataFrame, ranges: DataFrame, key: str, point_id: str, t: str, start: str, end: str, name: str) -> DataFrame:
    """By priority: around the time (0.5 s before to 0.75 s after) 0, ended within 8 s 1, longer ago dropped;
    ranges that start more than 0.5 s later are skipped. They meet by cells of 8 s."""
    x, a, b = F.col(t), F.col(start), F.col(end)
    rank = F.when(a - x > 0.5, None).when((x >= a - 0.5) & (x <= b + 0.75), 0).when((b <= x) & (x - b <= 8), 1).when(x - b > 8, None).otherwise(2)
    dealt = in_cells(ranges.where(a.isNotNull() & b.isNotNull()), a - 0.5, F.greatest(a, b) + 8, 8.0)
    both = points.withColumn("cell", F.floor(x / 8.0)).join(dealt, [key, "cell"]).withColumn("priority", rank).where("priority is not null")
    best = F.struct("priority", F.abs(x - b).alias("gap"), F.col(name).alias("name"))
    return both.groupBy(key, point_id, t).agg(F.min(best).alias("best")).select(key, point_id, t, "best.priority", F.col("best.name").alias(name))


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """do [a, b) and [c, d) overlap?"""
    return (a < d) & (b > c)


def overlap_semi(left: DataFrame, right: DataFrame, key: str, a: str, b: str, c: str, d: str) -> DataFrame:
    """Left rows that a right row of the same key overlaps.

    Over both in order of time, a left row at its end and a right row at its start, the largest end of the right rows so
    far tells whether one of them reaches over the left row's start.
    """
    row = F.struct(*left.columns)
    events = left.select(key, F.col(b).alias("at"), F.lit(0).alias("side"), F.col(a).alias("edge"), row.alias("row"))
    events = events.unionByName(right.select(key, F.col(c).alias("at"), F.lit(1).alias("side"), F.col(d).alias("edge"), F.lit(None).cast(events.schema["row"].dataType).alias("row")))
    w = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("side") == 1, F.col("edge"))).over(w)
    return events.where("at is not null").withColumn("reach", reach).where("side = 0 and reach > edge").select("row.*")


def cumulative_times(rows: DataFrame, by: str, order: list[str], n_words: str, rate: float = 0.45, low: float = 1.0, high: float = 12.0) -> DataFrame:
    """start_sec and end_sec of utterances one after the other, each rate seconds a word within bounds."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    took = F.greatest(F.lit(low), F.least(F.lit(high), F.col(n_words) * rate))
    out = rows.withColumn("took", took).withColumn("start_sec", F.coalesce(F.sum("took").over(w), F.lit(0.0)))
    return out.withColumn("end_sec", F.col("start_sec") + F.col("took"))


def even_indices(count: Column, n: int) -> Column:
    """At most n indices spread evenly over count, both ends included, distinct."""
    step = (count - 1) / F.lit(float(max(1, n - 1)))
    all_ = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * step + 0.5).cast("long"))
    return F.array_distinct(F.filter(all_, lambda i: i < count))


def last_rows(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The n latest of each group."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= n)


def second_histogram(rows: DataFrame, by: str, t: str, duration: str) -> DataFrame:
    """Rows for each second; the end itself falls into the last one."""
    bucket = F.least(F.floor(F.col(t)), F.greatest(F.ceil(F.col(duration)) - 1, F.lit(0))).cast("long")
    return rows.withColumn("bucket", bucket).groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("n"))


def loud_buckets(samples: DataFrame, by: str, t: str, level: str, width: float = 0.25, least: float = 12000.0) -> DataFrame:
    """M4: buckets of `width` seconds whose largest |level| is least or more."""
    bucket = F.floor(F.col(t) / width).cast("long")
    return samples.withColumn("bucket", bucket).groupBy(by, "bucket").agg(F.max(F.abs(level)).alias("peak")).where(F.col("peak") >= least)


def word_chunks(rows: DataFrame, key: str, words: Column, size: int = 220, overlap: int = 35) -> DataFrame:
    """(key, index, chunk): runs of `size` words, each beginning `overlap` words before the last one ended."""
    step = size - overlap
    w = rows.select(key, words.alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int")
    out = w.withColumn("index", F.explode(F.sequence(F.lit(0), n)))
    return out.select(key, F.col("index").cast("long").alias("index"), F.array_join(F.slice("w", F.col("index") * step + 1, size), " ").alias("chunk"))


def hit_timing(hits: DataFrame, segments: DataFrame, said: DataFrame, order: list[str], term: str, clip: str = "clip_id") -> DataFrame:
    """best_timestamp, segment_start, segment_end of hits (clip, hit_id, start_time, end_time, kind).

    A hit with a start keeps its own times. One of kind transcript_text or sqlite_fallback takes the first
    utterance that holds the term, else the first one, and the bounds of the segment nearest to its start.
    Others have none. segments: (clip, segment_id, start_sec, end_sec); said: (clip, text, start_sec, ...).
    """
    from quillwork.operators.summary import transcript_anchor

    anchor = transcript_anchor(said.where("start_sec is not null"), clip, order, "text", F.lit(term)).select(clip, F.col("start_sec").alias("anchor"))
    textual = F.col("kind").isin("transcript_text", "sqlite_fallback")
    best = F.when(F.col("start_time").isNotNull(), F.col("start_time")).when(textual, F.col("anchor"))
    timed = hits.join(anchor, clip, "left").withColumn("best_timestamp", best).drop("anchor")
    near = nearest_interval(timed.where("best_timestamp is not null and start_time is null"), segments, clip, "hit_id", "best_timestamp", "start_sec", "end_sec", "segment_id")
    near = near.select(F.col(clip).alias("c_"), F.col("hit_id").alias("h_"), F.col("start_sec").alias("s_"), F.col("end_sec").alias("e_"))
    out = timed.join(near, (F.col(clip) == F.col("c_")) & (F.col("hit_id") == F.col("h_")), "left")
    return out.withColumn("segment_start", F.coalesce("start_time", "s_")).withColumn("segment_end", F.coalesce("end_time", "start_time", "e_")).drop("c_", "h_", "s_", "e_")
