"""Vector retrieval, fusion of fields, ranking and re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions import text as T
from quillwork.functions import vectors as V
from quillwork.functions.convert import signed_clamp

# The weight of each field in late fusion.
FIELD_WEIGHTS = {"fused": 0.35, "video": 0.20, "summary": 0.20, "speech": 0.15, "audio_caption": 0.05, "metadata": 0.05}


def scored(points: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """V3: cosine of every point with the query, which is a literal: no join, no shuffle."""
    return points.withColumn("score", V.cosine(F.col(vector), V.literal(query)))


def top_k(points: DataFrame, k: int, key: str) -> DataFrame:
    """The k best, ties by key: Spark keeps k rows a task and merges those. k <= 0: nothing."""
    return points.orderBy(F.desc("score"), key).limit(max(0, k))


def top_k_each(points: DataFrame, by: str, k: int, key: str) -> DataFrame:
    """V6, T4: the k best of each group; tasks drop what can't be among them before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
    return points.withColumn("rank", rank).where(F.col("rank") <= k)


def min_max(hits: DataFrame, by: str) -> DataFrame:
    """V7: scores of each group onto [0, 1]; 1 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("norm", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)))


def field_weight(field: Column, weights: dict[str, float] = FIELD_WEIGHTS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.try_element_at(table, field)


def late_fusion(hits: DataFrame, clip: str = "clip_id", field: str = "field", weights: dict[str, float] = FIELD_WEIGHTS, cut: int | None = None) -> DataFrame:
    """By clip, the sum over every hit of weight * norm, hits, matched fields, best weighted score of each.

    Hits of unknown fields or without a clip don't count. field_scores is a map; fields are sorted.
    """
    known = min_max(hits, field).withColumn("weighted", field_weight(F.col(field), weights) * F.col("norm")).where(F.col("weighted").isNotNull() & F.col(clip).isNotNull())
    best = known.groupBy(clip, field).agg(F.sum("weighted").alias("total"), F.max("weighted").alias("best"), F.count(F.lit(1)).alias("n"))
    out = best.groupBy(clip).agg(
        F.round(F.sum("total"), 6).alias("score"),
        F.sum("n").alias("n_hits"),
        F.array_sort(F.collect_list(field)).alias("fields"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, "best")))).alias("field_scores"),
    )
    return out if cut is None else out.orderBy(F.desc("score"), clip).limit(cut)


def combined(hits: DataFrame, clip: str, kind: str, score: str = "score") -> DataFrame:
    """Best of each (clip, kind), then their sum; hybrid where two kinds or more hit."""
    best = hits.groupBy(clip, kind).agg(F.max(score).alias("best"))
    return best.groupBy(clip).agg(F.sum("best").alias("score"), (F.count(F.lit(1)) > 1).alias("hybrid"))


def hybrid_score(vector: Column, lexical: Column, metadata: Column) -> Column:
    """0.72 vector, 0.20 lexical, 0.08 metadata."""
    return F.lit(0.72) * signed_clamp(vector) + F.lit(0.20) * lexical + F.lit(0.08) * metadata


def metadata_score(checks: list[tuple[Column, Column]]) -> Column:
    """Mean of the checks that are asked for; (asked, value) each. 0 if none is."""
    asked = sum((F.when(a, 1).otherwise(0) for a, _ in checks), F.lit(0))
    total = sum((F.when(a, v).otherwise(0.0) for a, v in checks), F.lit(0.0))
    return F.when(asked > 0, total / asked).otherwise(F.lit(0.0))


def rerank_blend(hits: DataFrame, by: str, score: str = "score", rerank: str = "rerank") -> DataFrame:
    """0.35 of score over the largest |score| (1 if that is 0) and 0.65 of the re-ranker's score onto
    [0, 1]; 0.5 where those are equal, 0 where one isn't finite."""
    w = Window.partitionBy(by)
    finite = ~(F.isnan(rerank) | F.col(rerank).isin(float("inf"), float("-inf")))
    value = F.when(finite, F.col(rerank))
    low, high, most = F.min(value).over(w), F.max(value).over(w), F.max(F.abs(score)).over(w)
    fine = F.when(~finite | F.col(rerank).isNull(), F.lit(0.0)).when(high > low, (F.col(rerank) - low) / (high - low)).otherwise(F.lit(0.5))
    return hits.withColumn("blend", F.lit(0.35) * F.col(score) / F.when(most > 0, most).otherwise(F.lit(1.0)) + F.lit(0.65) * fine)


def rerank_document(parts: dict[str, Column]) -> Column:
    """A line `label: value` for each part that isn't blank."""
    return F.concat_ws("\n", *[F.when(F.trim(v) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in parts.items()])


def scores_of(output: Column, count: Column) -> Column:
    """`count` scores from what a re-ranker said in JSON: a number, a list of numbers or of lists, whose last
    number counts, or objects with a score and perhaps an index. What is missing or no number is 0."""
    listed = F.when(F.startswith(F.ltrim(output), F.lit("[")), F.from_json(output, "array<string>")).when(output.try_cast("double").isNotNull(), F.array(output))
    number = lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))
    field = lambda x, *names: F.coalesce(*[F.get_json_object(x, f"$.{n}") for n in names])
    plain = F.transform(listed, lambda x: number(F.when(F.startswith(x, F.lit("[")), F.try_element_at(F.from_json(x, "array<string>"), F.lit(-1))).otherwise(x)))
    ranked = F.transform(listed, lambda x, i: F.struct(F.coalesce(field(x, "index").try_cast("int"), i).alias("at"), number(field(x, "relevance_score", "score")).alias("score")))
    told = F.exists(listed, lambda x: F.startswith(x, F.lit("{")))
    places = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: (i - 1).cast("int"))
    by_index = F.transform(places, lambda i: F.coalesce(F.try_element_at(F.filter(ranked, lambda r: r["at"] == i), F.lit(-1))["score"], F.lit(0.0)))
    by_place = F.transform(places, lambda i: F.coalesce(F.get(plain, i), F.lit(0.0)))
    return F.slice(F.when(F.coalesce(told, F.lit(False)), by_index).otherwise(by_place), F.lit(1), F.greatest(count, F.lit(0)))


# What a query asks for.
DEATH_INTENT = r"\b(killed me|killed by|what killed|who killed|downed me|death|dead)\b"
KILL_INTENT = r"\b(i|we)\s+(kill|killed|down|downed|shot)|hunter killed|enemy killed|final kill\b"


def death_intent(query: Column) -> Column:
    return F.lower(query).rlike(DEATH_INTENT)


def kill_intent(query: Column) -> Column:
    return ~death_intent(query) & F.lower(query).rlike(KILL_INTENT)


def local_rerank(query: Column, document: Column, file_name: Column, died: Column, loadout: Column) -> Column:
    """Lexical cosine; +3 for a kill asked and told of by the file name, -2 if the clip has a death then;
    +2 for a death asked for and there; +0.8 for `window` on both sides, and for the loadout in the query."""
    out = T.lexical_score(T.tokens_long(query), T.tokens_long(document))
    kill, death = kill_intent(query), death_intent(query)
    told = F.lower(file_name).rlike("hunter[ _]killed|enemy killed")
    asked, worn = T.compact(query), T.compact(loadout)
    out = out + F.when(kill & told, 3.0).otherwise(0.0) - F.when(kill & died, 2.0).otherwise(0.0) + F.when(death & died, 2.0).otherwise(0.0)
    out = out + F.when(F.contains(F.lower(query), F.lit("window")) & F.contains(F.lower(document), F.lit("window")), 0.8).otherwise(0.0)
    out = out + F.when((worn != "") & F.contains(asked, worn), 0.8).otherwise(0.0)
    return out + F.when(F.contains(asked, F.lit("auto5")) & F.contains(worn, F.lit("auto5")), 0.8).otherwise(0.0)


def hud_boost(active: Column, confidence: Column) -> Column:
    """0.35, 0.15 more where active, and a tenth of the confidence."""
    return F.lit(0.35) + F.when(active, 0.15).otherwise(0.0) + F.least(F.coalesce(confidence, F.lit(0.0)), F.lit(1.0)) * 0.1


def death_boost(confidence: Column) -> Column:
    """V17."""
    return F.lit(0.7) + F.least(F.coalesce(confidence, F.lit(0.0)), F.lit(1.0)) * 0.15


def intent_boost(named: Column, windowed: Column, died: Column) -> Column:
    """4.5, 1 more where the query names the loadout, 0.5 with a window; clips with a death lose 2.5."""
    return F.lit(4.5) + F.when(named, 1.0).otherwise(0.0) + F.when(windowed, 0.5).otherwise(0.0) - F.when(died, 2.5).otherwise(0.0)


def boosted(hits: DataFrame, matches: DataFrame, clip: str, boost: Column) -> DataFrame:
    """Boosts of all matching rows of a clip add up on its score; clips without a hit get them alone."""
    more = matches.groupBy(clip).agg(F.sum(boost).alias("boost"))
    both = hits.join(more, clip, "full")
    return both.withColumn("score", F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).drop("boost")


def with_threshold(hits: DataFrame, least: float, key: str) -> DataFrame:
    """scores of `least` or more, best first."""
    return hits.where(F.col("score") >= least).orderBy(F.desc("score"), key)


def margin(scores: DataFrame, by: str, name: str) -> DataFrame:
    """The best of each group and how far the runner-up is behind (all of it if there is none)."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), name)
    out = scores.withColumn("next", F.lead("score").over(w)).withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return out.withColumn("margin", F.col("score") - F.coalesce("next", F.lit(0.0))).drop("rank", "next")
