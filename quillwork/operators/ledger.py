"""Evidence of a clip from several detectors, put on one timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions import text as T

# What a file name or context says of an outcome, and echoes of prompts.
OUTCOME_CUES = ["confirmed_hunter_kill", "hunter_killed", "hunter killed", "_killed", " killed"]


def known_outcome(*values: Column) -> Column:
    """is the kill confirmed by the file name or the context?"""
    return T.any_cue(F.concat_ws(" ", *values), OUTCOME_CUES)


def speech(rows: DataFrame, text: str, end: str, analysis_start: Column) -> DataFrame:
    """utterances that aren't blank, don't repeat a word, and don't end before the analysis starts."""
    return rows.where((F.trim(text) != "") & ~T.repetitive(F.col(text)) & (F.col(end) + 1e-6 >= analysis_start))


def captions(rows: DataFrame, key: str, text: str, start: str, end: str, order: list[str], analysis_start: Column, echo: str) -> DataFrame:
    """F16: captions like speech, without echoes of the prompt, one of each (times to two digits, lowered text)."""
    clean = rows.withColumn(text, T.collapsed(F.col(text)))
    kept = speech(clean, text, end, analysis_start).where(~F.col(text).rlike(echo))
    w = Window.partitionBy(key, F.round(start, 2), F.round(end, 2), F.lower(text)).orderBy(*order)
    return kept.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def equipment(rows: DataFrame, key: str, start: str, name: str, order: list[str], digits: int = 3) -> DataFrame:
    """One state for each (start to some digits, lowered name), the first in order; blank names go."""
    w = Window.partitionBy(key, F.round(start, digits), F.lower(F.trim(name))).orderBy(*order)
    return rows.where(F.trim(name) != "").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def canonical_equipment(name: Column, resolved: Column | None = None) -> Column:
    """The resolved name, else the cleaned one, one skin by its weapon."""
    clean = T.collapsed(name)
    own = F.when(F.lower(clean) == "rougarou", F.lit("Mosin Obrez (Rougarou skin)")).otherwise(clean)
    return own if resolved is None else F.coalesce(resolved, own)


def hit_markers(rows: DataFrame, at: str, duration: str, half: float = 0.25) -> DataFrame:
    """A quarter second on each side of a detected marker, inside the clip."""
    t = F.greatest(F.lit(0.0), F.coalesce(F.col(at), F.lit(0.0)))
    start = F.greatest(F.lit(0.0), t - half)
    return rows.withColumn("start_sec", start).withColumn("end_sec", F.greatest(start, F.least(F.col(duration), t + half)))


def death_screens(rows: DataFrame, at: str, *fields: str) -> DataFrame:
    """C4: rows with something in a field; blanks are null, times aren't negative."""
    clean = rows.withColumns({f: F.when(F.trim(f) != "", F.trim(f)) for f in fields})
    return clean.where(F.coalesce(*fields).isNotNull()).withColumn("start_sec", F.greatest(F.lit(0.0), F.coalesce(F.col(at), F.lit(0.0)))).withColumn("end_sec", F.col("start_sec"))


def visual_events(events: DataFrame, timeline: DataFrame, key: str, name: str, end: str, analysis_start: Column) -> DataFrame:
    """Events that end after the analysis starts; equipment that isn't on the clip's timeline is taken back
    and noted as an uncertainty (clips without a timeline keep theirs)."""
    known = timeline.groupBy(key).agg(F.collect_set(F.lower(name)).alias("known"))
    out = events.where(F.col(end) + 1e-6 >= analysis_start).join(known, key, "left")
    strange = F.col(name).isNotNull() & (F.size("known") > 0) & ~F.array_contains("known", F.lower(name))
    note = F.concat(F.lit("Visual event equipment '"), F.col(name), F.lit("' is not in the canonical local-player equipment timeline."))
    noted = F.when(strange, F.array_append("uncertainties", note)).otherwise(F.col("uncertainties"))
    return out.withColumn("uncertainties", noted).withColumn(name, F.when(~F.coalesce(strange, F.lit(False)), F.col(name))).drop("known")


def best_evidence(rows: DataFrame, key: str, at: str, confidence: str, tie: str, low: float | None, high: float | None, most: int, least: float) -> DataFrame:
    """Rows of a time range, the `most` surest of each clip, detected if the best reaches `least`."""
    if low is not None:
        rows = rows.where(F.col(at) >= low)
    if high is not None:
        rows = rows.where(F.col(at) <= high)
    w = Window.partitionBy(key).orderBy(F.desc(confidence), at, tie)
    kept = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(1, most))
    out = kept.groupBy(key).agg(F.max(confidence).alias("best"), F.count(F.lit(1)).alias("n_kept"), F.min_by(at, "rn").alias("best_at"))
    return out.withColumn("detected", F.col("best") >= least)


def observations(key: str, **sources: DataFrame) -> DataFrame:
    """(key, source, start_sec, end_sec, text) of all sources together."""
    out = None
    for name, rows in sources.items():
        own = rows.select(key, F.lit(name).alias("source"), "start_sec", "end_sec", "text")
        out = own if out is None else out.unionByName(own)
    return out


def injected(moments: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """Made moments (key, window_id, start_sec, end_sec, text) are added where no moment of the same window
    overlaps them."""
    a, b = made.alias("a"), moments.alias("b")
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.window_id") == F.col("b.window_id")) & (F.col("a.start_sec") < F.col("b.end_sec")) & (F.col("a.end_sec") > F.col("b.start_sec"))
    return moments.unionByName(a.join(b, same, "left_anti"))


def uncertainties(has_captions: Column, has_other_death: Column) -> Column:
    """Z12."""
    return F.array_compact(
        F.array(
            F.when(has_captions, F.lit("Audio captions are uncertain and may hallucinate environmental sounds.")),
            F.when(has_other_death, F.lit("At least one death vocalization is not near player-hit evidence and must not be attributed to the player's kill.")),
        )
    )
