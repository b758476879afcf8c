"""Summaries of clips put together from cues: rules over tags, hints and words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import records
from quillwork.functions import text as T

# Tags that name the action, in order of weight.
ACTIONS = ["death", "kill", "boss", "lair", "shotgun", "rifle", "teammate comms", "footsteps", "gunshots", "explosion", "dogs", "crows", "window", "extract", "funny", "clutch"]
# What cues tell of the place, of which the first counts, and of movement.
PLACES = [
    ("the fight centered near a boss lair", "boss lair"),
    ("the fight was near extraction", "extraction fight|extract"),
    ("you were inside or just inside a dark compound interior", "dark indoor fight"),
    ("you were fighting from indoor cover", "indoor"),
    ("visibility was low in a night fight", "night"),
]
MOVES = [
    ("the enemy pressure was around a window angle", "window"),
    ("an enemy appeared to push through a doorway", "enemy pushing through doorway"),
    ("an enemy was likely crossing exposed ground", "enemy crossing open ground"),
    ("enemy footsteps or movement closed in before the outcome", "footsteps before death|enemy footsteps approaching"),
    ("you were rotating through the area", "player rotating|rotation|rotating"),
    ("you were holding or watching an angle", r"\b(i'?m|i am|we are|we'?re|i was|we were)\s+(holding|watching)\b"),
    ("you were pushing or closing distance", r"\b(i'?m|i am|we are|we'?re|i was|we were)\s+(pushing|moving in)\b"),
    ("you were backing up or repositioning", r"\b(backing up|falling back|repositioning)\b"),
    ("you were peeking an angle", r"\b(peeking|peeked|wide peek)\b"),
    ("the engagement stayed close range", "close-range push|shotgun fight"),
    ("you had reload or reposition pressure", "reload under pressure"),
    ("movement centered on a revive attempt", "revive attempt"),
]
SEEN = [("an enemy was visible near a window", "enemy visible in window"), ("an enemy was pushing through a doorway", "enemy pushing through doorway"), ("an enemy was crossing exposed ground", "enemy crossing open ground")]
SIDES = [("to your left", "on your left", "left"), ("to your right", "on your right", "right"), ("in front of you", "in front of you", "front|ahead"), ("behind you", "behind you", "behind|back"), ("above you", "above you", "above|up top|high ground")]
ENEMY, MATE = r"\b(enemy|enemies|one|hunter|guy|he|they)\b", r"\b(teammate|team mate|partner|buddy)\b"
MATES = [("a teammate was nearby", "nearby|near me|close|with me"), ("a teammate was downed or dead", "downed|down|dead|killed"), ("a teammate was pushing", "pushing|push|pushed|moving in")]
MATE_TALK = "comms|called|callout|said"


def _joined(parts: Column) -> Column:
    """a, b and c."""
    n = F.size(parts)
    return F.when(n < 2, F.array_join(parts, "")).otherwise(F.concat(F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(parts, -1)))


def _named(parts: Column) -> Column:
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def action(tags: Column) -> Column:
    """The tags that name an action, by weight; else the first three."""
    known = F.filter(F.array(*[F.lit(a) for a in ACTIONS]), lambda a: F.array_contains(tags, a))
    return _joined(F.when(F.size(known) > 0, known).otherwise(F.slice(tags, 1, 3)))


def position(told: Column) -> Column:
    """Up to five things that the lowered tags, hints and words tell of place, movement, enemies and teammates."""
    says = lambda phrase, cue: F.when(told.rlike(cue), F.lit(phrase))
    place = F.coalesce(*[says(*p) for p in PLACES])
    chunks = F.split(told, "[.!?;,]")
    side = r"\b(on|to|at|in|from)\s+((my|our|your|the)\s+)?({0})\b|\b({0})\s+(of|side)\b"

    def enemy_at(where: str) -> Column:
        near, plain = rf"{ENEMY}.{{0,40}}\b({where})\b", rf"\bon\s+(my|our|your)\s+({where})\b"
        return F.exists(chunks, lambda c: c.rlike(near) | (c.rlike(ENEMY) & c.rlike(side.format(where))) | (~c.rlike("teammate") & c.rlike(plain)))

    def mate_at(where: str) -> Column:
        return F.exists(chunks, lambda c: c.rlike(rf"{MATE}.{{0,50}}(\bon|to|at|in|from)?\b.{{0,8}}\b({where})\b") & ~c.rlike(ENEMY))

    enemies = [F.when(enemy_at(cue), F.lit(f"an enemy was {phrase}")) for phrase, _, cue in SIDES] + [says(*s) for s in SEEN]
    mates = [says(phrase, rf"{MATE}[^.!?;]{{0,50}}\b({cue})\b") for phrase, cue in MATES]
    mates += [F.when(mate_at(cue), F.lit(f"a teammate was {phrase}")) for _, phrase, cue in SIDES]
    mates.append(says("teammate comms were present", rf"teammate comms|{MATE}[^.!?;]{{0,50}}\b({MATE_TALK})\b"))
    return F.array_join(F.slice(F.array_distinct(F.array_compact(F.array(place, *[says(*m) for m in MOVES], *enemies, *mates))), 1, 5), "; ")


def _after(told: Column, label: str, stop: str = ";|.") -> Column:
    x = F.trim(F.regexp_extract(told, rf"(?i){label}\s*([^{stop}]+)", 1))
    return F.when(x != "", x)


def summaries(clips: DataFrame, most_words: int = 90) -> DataFrame:
    """Clips with title, summary and key_moments, from transcript, file_name, group_name, tags, hints, n_segments
    and modality (its label). Null and blank parts are left out; other columns stay.

    Where a hint tells the weapon in hand, the loadout or a death, the summary is made of those; else of the first
    words of the transcript, or of the file name.
    """
    said = T.collapsed(F.coalesce("transcript", F.lit("")))
    tags, hints = F.slice(_named(F.col("tags")), 1, 8), F.slice(F.array_distinct(_named(F.col("hints"))), 1, 5)
    name = records.human_name(F.coalesce("file_name", F.lit("")))
    x = clips.withColumns({"_said": said, "_tags": tags, "_hints": hints, "_name": name})
    told = F.lower(F.concat_ws(" ", F.array_join("_tags", " "), F.array_join("_hints", " "), "_said"))
    x = x.withColumns({"_told": told, "_cues": F.lower(F.concat_ws(" ", F.array_join("_tags", " "), F.array_join("_hints", " "))), "_hint": F.array_join("_hints", " | ")})
    x = x.withColumns({"_where": F.nullif(position(F.col("_told")), F.lit("")), "_doing": F.nullif(action(F.col("_tags")), F.lit("")), "_hinted": F.nullif(_joined(F.col("_hints")), F.lit(""))})
    x = x.withColumns({"_active": _after(F.col("_hint"), "active weapon or item:"), "_loadout": _after(F.col("_hint"), "detected loadout:", "|."), "_status": _after(F.col("_hint"), "player was"), "_with": _after(F.col("_hint"), "killed with:"), "_killer": _after(F.col("_hint"), "killer:")})
    cues, active = F.col("_cues"), F.col("_active")
    where = F.concat(F.lit("Position/movement: "), "_where")
    after = lambda words, c: F.concat(F.lit(words), F.col(c))
    place = F.when(F.contains(cues, F.lit("dark indoor fight")), "a dark indoor fight").when(F.contains(cues, F.lit("indoor")), "an indoor fight").when(F.contains(cues, F.lit("window")), "a fight around a window angle").when(F.contains(cues, F.lit("night")), "a night fight")
    played = F.when(F.contains(cues, F.lit("shotgun")), after("You were playing a close-range shotgun position with the ", "_active")).otherwise(after("You were using the ", "_active"))
    doing = F.when(active.isNotNull(), played).when(F.contains(cues, F.lit("enemy visible in window")), "You were watching an enemy near a window").when(F.contains(cues, F.lit("gunfight")), "You were in a gunfight")
    dead = F.coalesce("_status", "_with", "_killer").isNotNull()
    end = F.when(dead, F.concat(F.coalesce(after("You were ", "_status"), F.lit("The clip ends with a death/down")), F.coalesce(after(" by ", "_with"), F.lit("")), F.coalesce(after(" from ", "_killer"), F.lit(""))))
    gear = F.nullif(F.concat_ws("; ", after("Current weapon/item: ", "_active"), after("visible loadout: ", "_loadout")), F.lit(""))
    framed = F.concat_ws(". ", F.coalesce(F.concat(F.lit("This happens in "), place), F.lit("Gameplay moment")), doing, where, gear, end)
    group = F.when(F.trim("group_name") != "", after("from ", "group_name"))
    spoken = F.concat_ws(" ", F.lit("Gameplay clip"), group, after("around ", "_doing"), F.concat(F.lit("with transcript cues: "), T.cut_words(F.col("_said"), 28)), after("Audio-video embeddings suggest ", "_hinted"), where)
    modes = F.when(F.col("n_segments") > 0, F.concat(F.lit("indexed as "), F.col("n_segments").cast("string"), F.lit(" "), "modality"))
    silent = F.concat_ws(" ", F.lit("Gameplay clip"), group, F.concat(F.lit("named '"), F.when(F.col("_name") != "", F.col("_name")).otherwise(F.lit("an untitled capture")), F.lit("'")), after("likely involving ", "_doing"), after("with audio-video embedding cues for ", "_hinted"), where, modes)
    shaped = F.coalesce("_active", "_loadout").isNotNull() | dead
    body = T.cut_words(F.when(shaped, framed).when(F.col("_said") != "", spoken).otherwise(silent), most_words)
    body = F.when(body.rlike(r"[.!?]$"), body).otherwise(F.concat(body, F.lit(".")))
    source = F.when(F.col("_said") != "", F.col("_said")).when(F.col("_name") != "", F.col("_name")).otherwise(F.lit("Gameplay Clip"))
    moments = F.concat(
        F.slice(T.sentences(F.col("_said")), 1, 3),
        F.array_compact(
            F.array(
                F.when(F.size("_tags") > 0, F.concat(F.lit("Tags: "), F.array_join(F.slice("_tags", 1, 6), ", "))),
                F.when(F.size("_hints") > 0, F.concat(F.when(shaped, F.lit("Detected context: ")).otherwise(F.lit("Audio-video embedding hints: ")), F.array_join(F.slice("_hints", 1, 4), ", "))),
                F.when(F.col("n_segments") > 0, F.concat(F.lit("Indexed into "), F.col("n_segments").cast("string"), F.lit(" "), "modality", F.lit(" segments"))),
            )
        ),
    )
    out = x.withColumns({"title": T.title_words(F.regexp_replace(source, "[.,!?]+$", "")), "summary": body, "key_moments": F.slice(moments, 1, 5)})
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in clips.columns])
