"""The engine's entry points: each gives a DataFrame and runs nothing by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import text as T
from quillwork.functions.backends import answer
from quillwork.operators import fusion, knowledge, relational, summary
from quillwork.sources import files


class Library:
    """Tables of one library by name: clips, segments, transcripts, points, hud, deaths, tags, entities, chunks.

    A table that isn't given is read from `root`/name when it is asked for.
    """

    def __init__(self, spark: SparkSession, root: str = "", **tables: DataFrame):
        self.spark, self.root, self.tables = spark, root, dict(tables)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.read.parquet(f"{self.root}/{name}")
        return self.tables[name]

    def scan(self, folder: str, state: DataFrame | None = None) -> DataFrame:
        """The listing of a folder with status new, changed, unchanged or missing against a saved one."""
        now = files.listing(self.spark, folder, files.VIDEO)
        if state is None:
            return now.withColumn("status", F.lit("new"))
        change = relational.change_capture(now, state, ["path"], ["size_bytes", "modified_at"])
        return change.join(now, "path", "left")

    def due(self, model: str, force: bool = False) -> DataFrame:
        """F8: clips to index (again)."""
        return relational.needing_index(self.table("clips"), self.table("items"), model, force)

    def groups(self) -> DataFrame:
        """A1."""
        return relational.group_stats(self.table("clips"), "group_name", "status", "indexed_at")

    def clips(self, group: str | None = None, status: str | None = None) -> DataFrame:
        """F1."""
        return relational.filtered(self.table("clips"), ["group_name", "clip_id"], group_name=group, status=status)

    def clip_detail(self, clip_id) -> DataFrame:
        """the clip with its transcript in time order and its tags."""
        own = self.table("clips").where(F.col("clip_id") == clip_id)
        said = self.table("transcripts").where(F.col("clip_id") == clip_id).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", "text"))).alias("transcript"))
        tags = self.table("tags").where(F.col("clip_id") == clip_id).groupBy("clip_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
        return own.join(said, "clip_id", "left").join(tags, "clip_id", "left")

    def search(self, vector: list[float], query: str = "", group: str | None = None, tags: list[str] | None = None, fields: list[str] | None = None, candidates: int = 100, least: float = 0.35, top: int | None = None) -> DataFrame:
        """Search by a query vector: filters go to the scan, each field gives its best candidates, scores are put
        on one scale and fused, clips are enriched and re-ranked by rules, a threshold and an order end it.

        top bounds the result if given; with tags, all must be there; fields restricts what is searched.
        """
        points = self.table("points")
        if fields:
            points = points.where(F.col("field").isin(*fields))
        if group is not None:
            points = points.join(self.table("clips").where(F.col("group_name") == group).select("clip_id"), "clip_id", "left_semi")
        hits = fusion.top_k_each(fusion.scored(points, vector), "field", max(1, min(500, candidates)), "vec_id")
        fused = fusion.late_fusion(hits)
        out = fused.join(self.table("clips").select("clip_id", "group_name", "summary"), "clip_id")
        if tags:
            have = self.table("tags").where(F.col("tag").isin(*tags)).groupBy("clip_id").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(set(tags)))
            out = out.join(have.select("clip_id"), "clip_id", "left_semi")
        lexical = T.lexical_score(T.tokens_underscore(F.lit(query)), T.tokens_underscore(F.coalesce("summary", F.lit(""))))
        out = out.withColumn("score", fusion.hybrid_score(F.col("score"), lexical, F.lit(0.0)) if query else F.col("score"))
        ranked = fusion.with_threshold(out, least, "clip_id")
        return ranked if top is None else ranked.limit(top)

    def analyze(self, clip_id, question: str) -> DataFrame:
        """What a clip's transcript answers to a question, with its loadout and death rows."""
        own = self.table("transcripts").where(F.col("clip_id") == clip_id)
        said = own.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "text"))), lambda s: s["text"]).alias("lines"))
        out = self.table("clips").where(F.col("clip_id") == clip_id).join(said, "clip_id", "left")
        hud = summary.loadout(self.table("hud").where(F.col("clip_id") == clip_id), "clip_id", ["t"], "is_active", "entity", "slot")
        return out.join(hud, "clip_id", "left").withColumn("answer", answer(F.lit(question), F.coalesce("lines", F.array("summary"))))

    def knowledge_search(self, query: str, k: int = 5, kind: str | None = None) -> DataFrame:
        """V22."""
        entities = self.table("entities") if kind is None else self.table("entities").where(F.col("type") == kind)
        q = self.spark.range(1).select(F.col("id").alias("q_id"), F.lit(query).alias("q_text"))
        return knowledge.search(q, entities, "q_id", "q_text", "id", "description", k)
