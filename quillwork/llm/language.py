"""Language identification as inference of a mixture of languages in every text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from quillwork.llm._rows import crc_mod, key_text, map_text, quoted

#: Training reads about so many documents of each language at most, picked by a hash of their ids.
DOCS_PER_LANGUAGE = 20_000
BUCKETS = 1 << 16
#: Grams that share one hidden language: about six words.
UNIT = 32
#: Of a bucket's counts: added to each, relative to the mean count.
SMOOTHING = 0.02
ROUNDS = 12
#: Cost in log-likelihood of one more language in a text, times the log of its units.
PENALTY = 2.0
#: Share under which a language is no candidate.
LEAST_SHARE = 0.01
SMALL = 256

_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes other than letters become spaces.
_FOLD = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def grams(text: bytes) -> np.ndarray:
    """Buckets of the 4-byte grams of a text, lowered and with spaces for all ASCII but letters."""
    folded = b" " + text.decode("utf-8", "replace").lower().encode("utf-8", "replace").translate(_FOLD) + b"  "
    b = np.frombuffer(folded, np.uint8).astype(np.uint32)
    code = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    code = code[code != 0x20202020]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


@dataclass
class Model:
    """languages in order, and the log-probability of every bucket in each: (BUCKETS, languages)."""

    languages: list[str]
    table: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, np.ndarray]) -> Model:
        names = sorted(counts)
        if not names:
            return cls([], np.zeros((BUCKETS, 0), np.float32))
        c = np.stack([counts[k] for k in names], 1).astype(np.float64)
        c += SMOOTHING * np.maximum(c.sum(0) / BUCKETS, 1e-9) + 1e-9
        return cls(names, np.log(c / c.sum(0)).astype(np.float32))

    def units(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of every unit in each language, and where each text's units begin, with the end."""
        parts, starts = [], [0]
        for t in texts:
            codes = grams(t) if t else np.zeros(0, np.uint32)
            if len(codes):
                parts.append(np.add.reduceat(self.table[codes], np.arange(0, len(codes), UNIT), 0))
            starts.append(starts[-1] + -(-len(codes) // UNIT))
        return (np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)), np.array(starts)

    def mixtures(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (texts, languages) after selection, 0 for languages not selected; units of each text.

        Expectation-maximisation over all languages gives the candidates. Sets of the first 1, 2, ...
        candidates are fitted in turn, and the one with the best log-likelihood less PENALTY * size *
        log(1 + units) stays. All texts of a batch are fitted in the same numpy operations.
        """
        x, starts = self.units(texts)
        n, k = len(texts), len(self.languages)
        sizes = np.diff(starts)
        shares = np.zeros((n, k))
        there = np.flatnonzero(sizes)
        if not len(there) or not k:
            return shares, sizes
        top = x.max(1, keepdims=True)
        p = np.exp(x - top).astype(np.float64)
        owner = np.repeat(np.arange(len(there)), sizes[there])
        begins, m = starts[:-1][there], sizes[there].astype(float)
        full, _ = self._fit(p, owner, begins, m, np.ones((len(there), k), bool))
        order = np.argsort(-full, 1, kind="stable")
        candidates = (full >= LEAST_SHARE).sum(1)
        best = np.zeros((len(there), k))
        best[np.arange(len(there)), order[:, 0]] = 1.0
        score = np.full(len(there), -np.inf)
        mixed = np.flatnonzero(candidates > 1)
        for size in range(1, int(candidates.max()) + 1):
            own = mixed[candidates[mixed] >= size]
            if not len(own):
                break
            pick = np.zeros(len(there), bool)
            pick[own] = True
            rows = np.flatnonzero(pick[owner])
            at = np.full(len(there), -1)
            at[own] = np.arange(len(own))
            allowed = np.zeros((len(own), k), bool)
            np.put_along_axis(allowed, order[own, :size], True, 1)
            own_begins = np.concatenate(([0], np.cumsum(m[own][:-1]))).astype(int)
            fit, loglik = self._fit(p[rows], at[owner[rows]], own_begins, m[own], allowed)
            value = loglik - PENALTY * size * np.log1p(m[own])
            better = value > score[own]
            score[own[better]] = value[better]
            best[own[better]] = fit[better]
        shares[there] = best
        return shares, sizes

    @staticmethod
    def _fit(p, owner, begins, m, allowed):
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            r = p * share[owner]
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
            share = np.add.reduceat(r, begins, 0) / m[:, None]
        return share, np.add.reduceat(np.log(np.maximum((p * share[owner]).sum(1), 1e-300)), begins)


def train(documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Gram counts of each language over a sample of documents with text and lang.

    A language of more than DOCS_PER_LANGUAGE documents gives about so many, by a hash of the id; smaller ones
    give all. Each task counts by itself; its table goes out in pieces by (language, piece), summed over
    SMALL groups of tasks first, then over those. The model has one table a language, so its size follows
    the number of languages only.
    """
    own = documents.select(F.col(quoted(text)).alias("text"), F.col(quoted(lang)).alias("lang"), F.col(quoted(doc_id)).alias("doc_id")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model.of({})
    part = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, DOCS_PER_LANGUAGE / n))])
    picked = own.where(F.pmod(F.xxhash64(key_text(F.col("doc_id"))), F.lit(1_000_000)) < F.lit(1_000_000) * part[F.col("lang")])
    pieces, width = 64, BUCKETS // 64
    schema = StructType([StructField("lang", StringType()), StructField("piece", IntegerType()), StructField("counts", BinaryType())])
    arrow = to_arrow_schema(schema)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = held.get(name)
                if c is None:
                    c = held[name] = np.zeros(BUCKETS, np.int64)
                c += np.bincount(grams(t), minlength=BUCKETS)
        for name, c in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * pieces), pa.array(range(pieces), pa.int32()), pa.array([c[i * width : (i + 1) * width].tobytes() for i in range(pieces)], pa.binary())], schema=arrow)

    def add(rows):
        total = sum(np.frombuffer(b, np.int64) for b in rows["counts"])
        return rows.iloc[:1].assign(counts=[total.tobytes()])

    counted = picked.select("text", "lang").mapInArrow(count, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SMALL)))
    some = counted.groupBy("lang", "piece", "part").applyInPandas(add, "lang string, piece int, counts binary, part int")
    tables = {k: np.zeros(BUCKETS, np.int64) for k in sizes}
    for r in some.groupBy("lang", "piece").applyInPandas(lambda rows: add(rows)[["lang", "piece", "counts"]], "lang string, piece int, counts binary").collect():
        tables[r["lang"]][r["piece"] * width : (r["piece"] + 1) * width] = np.frombuffer(bytes(r["counts"]), np.int64)
    return Model.of(tables)


_MIXTURE = ArrayType(StructType([StructField("lang", StringType()), StructField("share", DoubleType())]))
FIELDS = [StructField("li_lang", StringType()), StructField("li_score", DoubleType()), StructField("li_mixture", _MIXTURE)]


def predict(documents: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, the language with the largest share, its share, and all selected languages with shares.

    A null text, one without a letter, and any text under a model of no languages gets `und`, score 0 and an
    empty mixture. Shares within 1e-12 go to the language first in order. A text is scored by itself, from
    its letters only. A kept column called as one of these is replaced.
    """
    keep = [c for c in keep if c.lower() not in {f.name for f in FIELDS}]
    held = documents.sparkSession.sparkContext.broadcast(model)

    def factory():
        def work(texts):
            model = held.value
            spoken = [t if t and _LETTER.search(t.decode("utf-8", "replace")) else None for t in texts]
            shares, sizes = model.mixtures(spoken)
            names, scores, mixtures = [], [], []
            for row, n in zip(shares, sizes.tolist(), strict=True):
                if not n or not len(row):
                    names.append("und")
                    scores.append(0.0)
                    mixtures.append([])
                    continue
                first = int(np.argmax(row >= row.max() - 1e-12))
                names.append(model.languages[first])
                scores.append(float(min(1.0, row[first])))
                mixtures.append([{"lang": model.languages[i], "share": float(row[i])} for i in np.flatnonzero(row)])
            return [names, scores, mixtures]

        return work

    return map_text(documents, text, keep, FIELDS, factory)


def contract(documents: DataFrame) -> DataFrame:
    """One row per document for op5: learned from documents whose crc32 of the id modulo 3 is not 1."""
    fold = crc_mod(F.col("doc_id"), 3)
    model = train(documents.where(fold != 1))
    out = predict(documents, model, ["doc_id"])
    shown = F.array_join(F.transform("li_mixture", lambda x: F.concat(x["lang"], F.lit(":"), F.round(x["share"], 4).cast("string"))), ",")
    return out.select("doc_id", (fold == 1).alias("held_out"), F.col("li_lang").alias("lang_pred"), F.col("li_score").alias("score"), shown.alias("mixture"))


