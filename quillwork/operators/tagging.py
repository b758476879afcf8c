"""Rule tags of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions import text as T

# Tags and their keywords.
RULES: dict[str, tuple[str, ...]] = {
    "kill": ("kill", "eliminated", "frag", "downed", "headshot"),
    "death": ("died", "dead", "death", "killed me", "got me", "traded"),
    "boss": ("boss", "butcher", "spider", "assassin", "scrapbeak", "rotjaw"),
    "extract": ("extract", "extraction", "extracting"),
    "compound": ("compound", "yard", "barn", "church", "station", "fort"),
    "night": ("night", "dark", "low light"),
    "indoors": ("inside", "indoor", "building", "room", "stairs"),
    "shotgun": ("shotgun", "romero", "specter", "crown", "terminus", "slate"),
    "rifle": ("rifle", "long ammo", "mosin", "lebel", "berthier", "sparks"),
    "teammate comms": ("teammate", "on the left", "on right", "callout", "comms"),
    "gunfight": ("gunfight", "gunshot", "shooting", "shot", "duel"),
    "funny": ("funny", "chaos", "laugh", "panic"),
    "fail": ("fail", "missed", "whiff", "mistake"),
    "clutch": ("clutch", "last one", "solo", "saved"),
    "reload": ("reload", "reloading"),
    "revive": ("revive", "reviving", "picked up"),
    "burning": ("burn", "burning", "fire", "lantern"),
    "bounty": ("bounty", "token", "banish"),
    "window": ("window", "peek", "re-peek", "repeek"),
    "lair": ("lair", "boss room"),
    "forest": ("forest", "trees", "woods"),
    "sniper": ("sniper", "scope", "scoped", "marksman"),
    "melee": ("melee", "knife", "saber", "bomblance"),
    "footsteps": ("footstep", "steps", "walking", "running"),
    "gunshots": ("gunshot", "shots", "shooting", "fired"),
    "explosion": ("explosion", "dynamite", "frag", "bomb"),
    "dogs": ("dog", "dogs", "kennel"),
    "crows": ("crow", "crows", "birds"),
}


def tags(rows: DataFrame, key: str, text: Column, rules: dict[str, tuple[str, ...]] = RULES, most: int = 12, game: Column | None = None) -> DataFrame:
    """(key, tag, score, rank): a tag for each rule with a whole-word keyword, 0.45 and 0.2 more a keyword, at
    most 1; with a game that has a name, its slug at 0.75 or more; the `most` best, ties by tag.

    The rules are literal conditions of one pass over the text; only matched tags become rows.
    """
    low = F.lower(text)
    found = []
    for tag, words in rules.items():
        hits = sum((F.when(low.rlike(rf"\b\Q{w}\E\b"), 1).otherwise(0) for w in words), F.lit(0))
        found.append(F.when(hits > 0, F.struct(F.lit(tag).alias("tag"), F.least(F.lit(1.0), F.lit(0.45) + hits * 0.2).alias("score"))))
    if game is not None:
        own, named = T.slug(game), ~F.lower(F.trim(game)).isin("", "ungrouped", "unknown")
        found.append(F.when(named, F.struct(own.alias("tag"), F.lit(0.75).alias("score"))))
    out = rows.select(key, F.inline(F.array_compact(F.array(*found))))
    if game is not None:
        out = out.groupBy(key, "tag").agg(F.max("score").alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "tag")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
