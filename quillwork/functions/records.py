"""Small record shapes: pointers, payloads, cleaned fields, composed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions import text as T

# The evidence source that a field stands for.
SOURCES = {"video": "video", "summary": "summary", "speech": "speech", "audio_caption": "audio", "metadata": "metadata", "fused": "summary"}
# Technical keys that stay in compact metadata.
TECHNICAL = ("duration", "width", "height", "fps", "codec", "timebase")


def pointer(field: Column, window_id: Column, start: Column, end: Column, *texts: Column, most: int = 500) -> Column:
    """V9: source, window, start, end not before it, and the first of the texts that isn't blank, cut to 500."""
    table = F.create_map(*[F.lit(x) for pair in SOURCES.items() for x in pair])
    said = F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts], F.lit(""))
    a = F.greatest(F.lit(0.0), F.coalesce(start, F.lit(0.0)))
    return F.struct(F.coalesce(F.try_element_at(table, field), F.lit("metadata")).alias("source"), window_id.alias("window_id"), a.alias("start"), F.greatest(a, F.coalesce(end, a)).alias("end"), F.substring(said, 1, most).alias("quote"))


def compact_metadata(values: Column) -> Column:
    """only technical keys of a map."""
    return F.map_filter(values, lambda k, v: k.isin(*TECHNICAL))


def merged_maps(a: Column, b: Column) -> Column:
    """Both maps' entries, b's where both have a key."""
    only = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.map_from_entries(F.concat(F.map_entries(only), F.map_entries(b)))


def first_present(values: Column, keys: list[str]) -> Column:
    """The value of the first key that a map has a non-blank value for."""
    return F.coalesce(*[F.when(F.trim(F.try_element_at(values, F.lit(k))) != "", F.try_element_at(values, F.lit(k))) for k in keys])


def progress(position: Column, total: Column, start: float, end: float) -> Column:
    """A stage's share of the whole run."""
    return F.lit(float(start)) + F.lit(float(end - start)) * position / F.greatest(total, F.lit(1))


def human_name(path: Column) -> Column:
    """A file name as words: no folder, extension, separators or date."""
    name = F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[A-Za-z0-9]{1,5}$", "")
    name = F.regexp_replace(name, r"\b\d{4}[-_.]\d{2}[-_.]\d{2}\b|(?<!\d)\d{8}(?!\d)", " ")
    return T.collapsed(F.regexp_replace(name, "[_.\\-]+", " "))


def rewritten(value: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules (pattern, replacement), one after the other."""
    for pattern, to in rules:
        value = F.regexp_replace(value, pattern, to)
    return value


def numeric_noise(value: Column) -> Column:
    """Eight numeric tokens or more, and over three times the alphabetic ones."""
    tokens = T.split_words(value)
    numbers, words = F.size(F.filter(tokens, lambda t: t.rlike(r"^[\d.,:%/+-]+$"))), F.size(F.filter(tokens, lambda t: t.rlike(r"[A-Za-z]{2,}")))
    return (numbers >= 8) & (numbers > 3 * words)


def clean_field(value: Column) -> Column:
    """Null for blanks and stand-ins of nothing."""
    x = T.collapsed(value)
    return F.when((x != "") & ~F.lower(x).isin("none", "null", "unknown", "n/a", "na", "-", "not visible"), x)


def labelled(parts: dict[str, Column], between: str = "; ") -> Column:
    """`label: value` of the parts that aren't blank, in order."""
    return F.concat_ws(between, *[F.when(F.trim(v) != "", F.concat(F.lit(f"{k}: "), F.trim(v))) for k, v in parts.items()])


def packed(rows: DataFrame, by: str, order: list[str], text: str, most: int) -> DataFrame:
    """The first rows of a group whose texts, with a separator each, stay within a number of characters."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("used", F.sum(F.length(text) + 2).over(w)).where(F.col("used") - 2 <= most).drop("used")


def evidence(value: Column) -> Column:
    """An evidence field in JSON, a string, a list of strings or a list of objects, as structs (source, text)."""
    objects = F.from_json(value, "array<struct<source:string,text:string,quote_or_observation:string>>")
    listed = F.from_json(value, "array<string>")
    from_objects = F.transform(objects, lambda o: F.struct(o["source"].alias("source"), F.coalesce(o["text"], o["quote_or_observation"]).alias("text")))
    from_list = F.transform(F.filter(listed, lambda s: s.isNotNull() & ~F.startswith(F.ltrim(s), F.lit("{"))), lambda s: F.struct(s.alias("source"), F.lit(None).cast("string").alias("text")))
    plain = F.array(F.struct(F.trim(F.translate(value, '"', "")).alias("source"), F.lit(None).cast("string").alias("text")))
    shape = F.ltrim(value)
    return F.when(F.startswith(shape, F.lit("[{")), from_objects).when(F.startswith(shape, F.lit("[")), from_list).when(F.trim(value) != "", plain)


def sorted_entries(values: Column, most: int) -> Column:
    """Entries of a map by the key's length and its lowered form, `most` at most."""
    keyed = F.transform(F.map_entries(values), lambda e: F.struct(F.length(e["key"]).alias("n"), F.lower(e["key"]).alias("low"), e.alias("entry")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["entry"]), 1, most)


def max_merged(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """The larger score of each key of two tables."""
    return a.select(key, score).unionByName(b.select(key, score)).groupBy(key).agg(F.max(score).alias(score))


def with_children(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """The children of each parent as a sorted array of structs, empty where there are none."""
    fields = [c for c in children.columns if c != key]
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))


def matched_fields(fused: DataFrame, fields: list[str]) -> DataFrame:
    """fused clips that one of the fields matched."""
    return fused.where(F.arrays_overlap("fields", F.array(*[F.lit(f) for f in fields])))


def before_first(rows: DataFrame, deaths: DataFrame, key: str, end: str, at: str) -> DataFrame:
    """rows that end before the first death of their clip; clips without one keep all."""
    first = deaths.groupBy(key).agg(F.min(at).alias("first_death"))
    return rows.join(first, key, "left").where(F.col("first_death").isNull() | (F.col(end) < F.col("first_death"))).drop("first_death")


def finite_top(rows: DataFrame, score: str, key: str, n: int = 20) -> DataFrame:
    """The n best of finite scores."""
    return rows.where(F.col(score).isNotNull() & ~F.isnan(score) & ~F.col(score).isin(float("inf"), float("-inf"))).orderBy(F.desc(score), key).limit(n)
