"""The tables as the engine's own records, in DataFrame form and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["video", "summary", "speech", "audio_caption", "metadata", "fused"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a file that few tasks hold over more of them, by key: a row group is one task however large it is.
    What fills the cores already, small tables and inputs of over 1,000 splits stay as they are read. The count
    reads no column."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() > 1000:
        return rows
    held, n = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = min(4 * cores, n // 1000)
    return rows if held >= min(cores, parts) else rows.repartition(parts, key)


def vec_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points of clips in six fields; a clip may have several in one."""
    field = F.element_at(F.array(*[F.lit(f) for f in FIELDS]), (F.expr("(vec_id div 60) % 6") + 1).cast("int"))
    return load(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 60).alias("clip_id"), field.alias("field"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One vector as the query: a point lookup of one row."""
    row = vec_points(spark, sf_dir).where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else [0.0]


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as clips; the label's quality tells the status."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "indexed").when(F.col("quality") == 0, "failed").otherwise("pending")
    d = load(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return d.select(F.col("doc_id").alias("clip_id"), F.col("source").alias("group_name"), status.alias("status"), F.col("text").alias("summary"), "lang", "n_chars")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as detections; seconds since the first day as time."""
    e = load(spark, sf_dir, "events")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return e.select(
        F.col("user_id").alias("clip_id"),
        "event_id",
        "ts",
        seconds.cast("double").alias("t"),
        F.col("event_type").alias("entity"),
        (F.col("value") > 50).alias("is_active"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        "value",
        "props",
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as transcripts; times follow from the numbers of words."""
    from quillwork.operators.timeline import cumulative_times

    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n\t]+"), lambda x: x != ""))
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip_id"), "turn", F.col("role").alias("modality"), "text", words.alias("n_words"))
    return cumulative_times(rows, "clip_id", ["turn"], "n_words")


VEC = """v AS (SELECT vec_id, vec_id % 60 AS clip_id, (['video','summary','speech','audio_caption','metadata','fused'])[((vec_id // 60) % 6) + 1] AS field,
  CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"""


def cos_sql(a: str, b: str) -> str:
    def norm(x: str) -> str:
        return f"sqrt(list_sum(list_transform({x}, lambda q: q * q)))"

    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
    return f"CASE WHEN {norm(a)} * {norm(b)} > 0 THEN {dot} / ({norm(a)} * {norm(b)}) ELSE 0 END"


SCORED = f"{VEC}, q AS (SELECT e AS qe FROM v WHERE vec_id = 0), s AS (SELECT v.*, {cos_sql('v.e', 'q.qe')} AS score FROM v, q)"

CLIPS = """clips AS (SELECT d.doc_id AS clip_id, d.source AS group_name,
  CASE WHEN l.quality = 1 THEN 'indexed' WHEN l.quality = 0 THEN 'failed' ELSE 'pending' END AS status, d.text AS summary, d.lang, d.n_chars
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

DET = """det AS (SELECT user_id AS clip_id, event_id, ts, CAST(datediff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts)) AS DOUBLE) AS t, event_type AS entity,
  value > 50 AS is_active, least(value / 100, 1.0) AS confidence, value, props FROM events)"""

TRANS = """tr0 AS (SELECT conv_id AS clip_id, turn, role AS modality, text,
  len(list_filter(string_split_regex(coalesce(text, ''), '[ \n\t]+'), lambda x: x <> '')) AS n_words FROM conversations),
tr1 AS (SELECT *, greatest(1.0::DOUBLE, least(12.0::DOUBLE, n_words * 0.45::DOUBLE)) AS took FROM tr0),
tr AS (SELECT *, coalesce(sum(took) OVER (PARTITION BY clip_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_sec FROM tr1),
trs AS (SELECT *, start_sec + took AS end_sec FROM tr)"""
