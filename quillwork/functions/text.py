"""Text columns: tokens, forms, cues, URLs, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extracted(t: Column, pattern: str) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), 0)


def tokens_underscore(t: Column) -> Column:
    """Distinct `[a-z0-9_]+` of two characters or more."""
    return F.array_distinct(F.filter(extracted(F.lower(t), "[a-z0-9_]+"), lambda x: F.length(x) > 1))


def tokens_long(t: Column) -> Column:
    """Distinct `[a-z0-9]+` of three characters or more."""
    return F.array_distinct(F.filter(extracted(F.lower(t), "[a-z0-9]+"), lambda x: F.length(x) > 2))


def tokens(t: Column) -> Column:
    """`[a-z0-9]+` of two characters or more, in order, repeats kept."""
    return F.filter(extracted(F.lower(t), "[a-z0-9]+"), lambda x: F.length(x) > 1)


def alias_key(t: Column) -> Column:
    """The tokens joined by one space."""
    return F.array_join(tokens(t), " ")


def compact(t: Column) -> Column:
    """Lower case, nothing but letters and digits."""
    return F.regexp_replace(F.lower(t), "[^a-z0-9]+", "")


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two token sets."""
    return F.size(F.array_intersect(a, b))


def lexical_score(q: Column, d: Column) -> Column:
    """Overlap over the geometric mean of the sizes; 0 if either set is empty."""
    size = F.size(q) * F.size(d)
    return F.when(size > 0, overlap(q, d) / F.sqrt(size.cast("double"))).otherwise(F.lit(0.0))


def slug(t: Column, empty: str | None = None) -> Column:
    """Runs of other characters become one hyphen, none at the ends; `empty` for what becomes empty."""
    out = F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return out if empty is None else F.when(out == "", F.lit(empty)).otherwise(out)


def collapsed(t: Column) -> Column:
    """White space as one space, none at the ends."""
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def without_marks(t: Column) -> Column:
    """Without `[edit]` and `[12]` marks."""
    return F.regexp_replace(t, r"\[(edit|\d+)\]", "")


def split_words(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda x: x != "")


def cut_words(t: Column, n: int, ellipsis: str = "...") -> Column:
    """X11: the first n words, with an ellipsis if there are more."""
    w = split_words(t)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit(ellipsis)).otherwise(F.lit("")))


def sentence_case(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def sentences(t: Column) -> Column:
    """Parts after `.`, `!` or `?` and white space; empty parts dropped."""
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def title_words(t: Column, n: int = 8) -> Column:
    """The first n words, each with a capital."""
    return F.initcap(F.array_join(F.slice(split_words(t), 1, n), " "))


def signature(t: Column) -> Column:
    """Lower case, times as <time>, no punctuation, single spaces. A time ends before what is no letter,
    digit or underscore of any script, written out since engines differ in what \\b and \\s mean."""
    timed = F.regexp_replace(F.lower(t), r"[0-9]+(\.[0-9]+)?[ \t\n\x0B\f\r]*(s|sec|seconds)([^\p{L}\p{N}_]|$)", "<time>$3")
    return F.trim(F.regexp_replace(F.regexp_replace(timed, "[^a-z0-9<>]+", " "), " +", " "))


def highlights(parts: list[Column], terms: Column, most: int = 3) -> Column:
    """Of each part the first sentence that holds a term; at most `most`, in order."""
    found = [F.get(F.filter(sentences(F.coalesce(p, F.lit(""))), lambda s: F.exists(terms, lambda t: F.contains(F.lower(s), t))), F.lit(0)) for p in parts]
    return F.slice(F.array_compact(F.array(*found)), 1, most)


def expanded(term: Column) -> Column:
    """Letters followed by digits also as the letters alone, hyphenated and spaced."""
    head, tail = F.regexp_extract(term, "^([a-z]+)([0-9]+)$", 1), F.regexp_extract(term, "^([a-z]+)([0-9]+)$", 2)
    more = F.array(term, head, F.concat(head, F.lit("-"), tail), F.concat(head, F.lit(" "), tail))
    return F.when(head != "", more).otherwise(F.array(term))


def search_terms(query: Column) -> Column:
    """Ordered distinct expanded tokens of a query."""
    return F.array_distinct(F.flatten(F.transform(tokens(query), expanded)))


def contained_share(haystack: Column, terms: Column) -> Column:
    """Share of terms in the text, plainly or with both compacted."""
    low, tight = F.lower(haystack), compact(haystack)
    hit = F.filter(terms, lambda t: F.contains(low, t) | ((compact(t) != "") & F.contains(tight, compact(t))))
    return F.size(hit) / F.greatest(F.size(terms), F.lit(1))


def seconds(x: Column) -> Column:
    """A time as 0.000s."""
    return F.concat(F.format_string("%.3f", x), F.lit("s"))


def time_range(a: Column, b: Column) -> Column:
    return F.concat(F.format_string("%.3f", a), F.lit("-"), F.format_string("%.3f", b), F.lit("s"))


def without_thinking(t: Column) -> Column:
    """Without <think> parts, an unclosed one to the end."""
    return F.regexp_replace(t, "(?is)<think>.*?(</think>|$)", "")


def without_fence(t: Column) -> Column:
    """A Markdown code fence around the whole text removed."""
    return F.regexp_replace(F.trim(t), r"(?s)^```[a-zA-Z]*\s*(.*?)\s*```$", "$1")


def repetitive(t: Column) -> Column:
    """one word six times or more in a row."""
    return F.coalesce(t.rlike(r"(?i)\b(\w{2,})\b(?:\W+\1\b){5,}"), F.lit(False))


def page_url(url: Column, base: str) -> Column:
    """A link as a page of the host: absolute or rooted, no query, fragment dropped; else null."""
    absolute = F.when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)
    bare = F.regexp_replace(absolute, "#.*$", "")
    return F.when(bare.startswith(base + "/") & ~F.contains(bare, F.lit("?")), F.regexp_replace(bare, "/+$", ""))


def language_code(name: Column) -> Column:
    """Two-letter code of a language name; two letters stay, others are null."""
    codes = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "russian": "ru", "japanese": "ja", "chinese": "zh", "korean": "ko"}
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    low = F.lower(F.trim(name))
    return F.when(F.length(low) == 2, low).otherwise(F.try_element_at(table, low))


def any_cue(t: Column, cues: list[str]) -> Column:
    """Does the lowered text hold one of the cues?"""
    low, out = F.lower(t), F.lit(False)
    for c in cues:
        out = out | F.contains(low, F.lit(c))
    return F.coalesce(out, F.lit(False))
