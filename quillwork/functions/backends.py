"""Pluggable models with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import text as T
from quillwork.functions import vectors as V

#: name -> function from columns to a column. A model is put here as a pandas UDF with a declared type.
_BACKENDS: dict[str, Callable[..., Column]] = {}


def register(name: str, make: Callable[..., Column]) -> None:
    _BACKENDS[name] = make


def backend(name: str) -> Callable[..., Column]:
    """The registered backend, else the stand-in; KeyError for a name that has neither."""
    return _BACKENDS.get(name) or DEFAULTS[name]


def utterances(transcript: Column, words: float = 0.45) -> Column:
    """Sentences of a text with synthetic times, one after the other, 1 to 12 s each."""
    parts = T.sentences(transcript)
    took = F.transform(parts, lambda s: F.struct(s.alias("text"), F.greatest(F.lit(1.0), F.least(F.lit(12.0), F.size(T.split_words(s)) * words)).alias("took")))
    kind = "struct<at:double,out:array<struct<text:string,start_sec:double,end_sec:double>>>"
    start = F.expr("named_struct('at', 0D, 'out', cast(array() as array<struct<text:string,start_sec:double,end_sec:double>>))").cast(kind)
    return F.aggregate(
        took,
        start,
        lambda a, s: F.struct((a["at"] + s["took"]).alias("at"), F.array_append(a["out"], F.struct(s["text"].alias("text"), a["at"].alias("start_sec"), (a["at"] + s["took"]).alias("end_sec"))).alias("out")),
    )["out"]


def audio_events(name: Column) -> Column:
    """Events that a file's name tells of."""
    cues = {"gunshot": ["shot", "gun"], "explosion": ["boom", "explosion"], "voice": ["voice", "talk"], "music": ["music", "song"]}
    return F.array_compact(F.array(*[F.when(T.any_cue(name, words), F.lit(kind)) for kind, words in cues.items()]))


def answer(question: Column, rows: Column) -> Column:
    """The rows that hold a word of the question, else the first row."""
    terms = T.tokens_long(question)
    hit = F.filter(rows, lambda r: F.exists(terms, lambda t: F.contains(F.lower(r), t)))
    return F.array_join(F.when(F.size(hit) > 0, hit).otherwise(F.slice(rows, 1, 1)), "\n")


DEFAULTS: dict[str, Callable[..., Column]] = {
    "embed": lambda text, size=64: V.hash_embedding(text, size),
    "transcribe": utterances,
    "audio_events": audio_events,
    "ocr": lambda sidecar: F.filter(F.split(sidecar, "\n"), lambda x: F.trim(x) != ""),
    "summarize": lambda text: T.cut_words(text, 40),
    "answer": answer,
}


def apply(df: DataFrame, name: str, out: str, *columns: str, on_error: Column | None = None) -> DataFrame:
    """A backend as a new column; rows it gives null for take `on_error`."""
    made = backend(name)(*[F.col(c) for c in columns])
    return df.withColumn(out, made if on_error is None else F.coalesce(made, on_error))
