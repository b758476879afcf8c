"""Line dedup over documents: sharded cuckoo filters in front of exact reference-count tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillwork.llm._rows import cut, map_text, quoted, shared_dir

#: Keys in one cuckoo filter; the number of shards follows from the number of keys.
SHARD_KEYS = 50_000
#: Filters are sent to the tasks only while all of them together take at most this much; beyond it the
#: lines go to the exact tables unfiltered, with the same result.
FILTER_BYTES = 32 << 20

_SPACE = b" \t\n\x0b\x0c\r"
_KEY = [StructField("h1", LongType()), StructField("h2", LongType())]


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def hashed(text: bytes | None, least: int) -> list[bytes | None]:
    """For each line of a text, the 16-byte hash of its key, or None for keys under `least` code points."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line_key(line) if len(line) >= least else b""
        long_enough = len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


def pairs(digests: list[bytes]) -> np.ndarray:
    """16-byte hashes as an (n, 2) array of signed integers."""
    return np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)


class CuckooFilter:
    """Approximate set of 128-bit hashes with deletion: buckets of four 16-bit fingerprints.

    A key's fingerprint and first bucket come from its second half (the first half picks the shard); the
    second bucket is the first one xor a hash of the fingerprint, so either can be found from the other.
    Membership has no false negatives; equal keys may be inserted more than once and are deleted one by one.
    """

    SLOTS = 4

    def __init__(self, keys: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (self.SLOTS * 0.85)))))
            table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.table = table

    @staticmethod
    def _other(fp):
        return (np.uint64(fp) * np.uint64(0x5BD1E995)) >> np.uint64(7) if np.isscalar(fp) else (fp.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)

    def places(self, h2: np.ndarray):
        """Fingerprints and the two buckets of each key."""
        h = np.asarray(h2, np.int64).view(np.uint64)
        mask = np.uint64(len(self.table) - 1)
        fp = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = h & mask
        return fp, first.astype(np.int64), ((first ^ self._other(fp)) & mask).astype(np.int64)

    def contains(self, h2: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(h2)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(1)

    def _place(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts entries into free slots of their buckets, one a bucket at a time; returns which found none."""
        left = np.arange(len(at))
        full = [np.zeros(0, np.int64)]
        while len(left):
            buckets, first = np.unique(at[left], return_index=True)
            own = left[first]
            free = self.table[buckets] == 0
            some = free.any(1)
            self.table[buckets[some], free[some].argmax(1)] = fp[own[some]]
            full.append(left[np.isin(at[left], buckets[~some])])
            left = np.setdiff1d(left, np.concatenate([own[some], full[-1]]))
        return np.concatenate(full)

    def insert(self, h2: np.ndarray) -> CuckooFilter:
        """Inserts all keys; OverflowError if there is no room, after which the filter must be built anew."""
        rng = np.random.default_rng(len(h2))
        mask = len(self.table) - 1
        fps, a, b = self.places(h2)
        late = self._place(fps, a)
        late = late[self._place(fps[late], b[late])]
        for fp, at in zip(fps[late].tolist(), b[late].tolist(), strict=True):
            for _ in range(500):
                slot = int(rng.integers(self.SLOTS))
                fp, self.table[at, slot] = int(self.table[at, slot]), fp
                at = (at ^ int(self._other(np.uint16(fp)))) & mask
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = fp
                    break
            else:
                raise OverflowError("cuckoo filter is full")
        return self

    def delete(self, h2: np.ndarray) -> CuckooFilter:
        """Deletes keys that are in the filter, one entry for each."""
        for fp, a, b in zip(*(x.tolist() for x in self.places(h2)), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == fp)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
        return self

    @classmethod
    def of(cls, h2: np.ndarray, room: int = 0) -> CuckooFilter:
        size = max(len(h2), room, 1)
        while True:
            try:
                return cls(size).insert(h2)
            except OverflowError:
                size *= 2

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())


def shard_of(h1, n: int):
    return F.pmod(h1, F.lit(n)) if not isinstance(h1, np.ndarray) else np.mod(h1, n)


def postings(documents: DataFrame, text: str, doc_id: str, least: int, probe=None) -> DataFrame:
    """(doc_id, h1, h2) for every keyed line, once per row of documents; with probe(), only lines it passes.

    probe() runs once in a task and returns a function from an (n, 2) array of keys to booleans.
    """
    schema = StructType([StructField("doc_id", LongType()), *_KEY])
    arrow = to_arrow_schema(schema)

    def run(batches):
        passes = probe() if probe else None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start in range(0, batch.num_rows, 500):
                owners, found = [], []
                for i, t in zip(ids[start : start + 500], batch.column(1).slice(start, 500).cast(pa.binary()).to_pylist(), strict=True):
                    own = {h for h in hashed(t, least) if h}
                    owners += [i] * len(own)
                    found += own
                keys, owners = pairs(found), np.array(owners, np.int64)
                if passes is not None and len(keys):
                    held = passes(keys)
                    keys, owners = keys[held], owners[held]
                yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1]))], schema=arrow)

    return documents.select(own_id(doc_id).alias("doc_id"), F.col(quoted(text)).alias("text")).mapInArrow(run, schema)


def own_id(doc_id: str):
    """A null id is one more id, the smallest."""
    return F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(-(1 << 63)))


def probe_of(table: DataFrame, n_shards: int):
    """A probe for `postings` from filters, or None if they are larger than FILTER_BYTES."""
    total = table.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    if total > FILTER_BYTES:
        return None
    bodies = table.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["body"]) for r in table.collect()})

    def probe():
        held = {s: CuckooFilter.from_bytes(b) for s, b in bodies.value.items()}

        def passes(keys: np.ndarray) -> np.ndarray:
            out, shards = np.zeros(len(keys), bool), shard_of(keys[:, 0], n_shards)
            for s in np.unique(shards).tolist() if len(held) > 1 else list(held):
                if s in held:
                    at = np.flatnonzero(shards == s)
                    out[at] = held[s].contains(keys[at, 1])
            return out

        return passes

    return probe


def cleaned(documents: DataFrame, lost: DataFrame, text: str, doc_id: str, keep: list[str], least: int) -> DataFrame:
    """Columns `keep`, then ld_text, ld_n_lines, ld_n_dropped of every row of documents; a kept column of such a name
    is replaced."""
    fields = [StructField("ld_text", StringType()), StructField("ld_n_lines", LongType()), StructField("ld_n_dropped", LongType())]
    keep = [c for c in keep if c.lower() not in {f.name for f in fields}]
    held = [f"c{i}" for i in range(len(keep))]
    own = documents.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keep, held, strict=True)], F.col(quoted(text)).alias("body"), own_id(doc_id).alias("doc_id"))

    def factory():
        def work(texts, keys):
            out, n_lines, n_dropped = [], [], []
            for t, gone in zip(texts, keys, strict=True):
                lines = (t or b"").split(b"\n")
                kept = lines
                if gone:
                    names = {(k["h1"], k["h2"]) for k in gone}
                    found = hashed(t, least)
                    both_ = iter(map(tuple, pairs([h for h in found if h]).tolist()))
                    kept = [line for line, h in zip(lines, found, strict=True) if h is None or next(both_) not in names]
                out.append(b"\n".join(kept).decode("utf-8", "replace") if gone else t if t is None else t.decode("utf-8", "replace"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            return [out, n_lines, n_dropped]

        return work

    return map_text(own.join(lost, "doc_id", "left"), "body", held, fields, factory, extra=("keys",)).toDF(*keep, *[f.name for f in fields])


class LineIndex:
    """Which lines repeat in a set of documents that grows by batches and gives documents back.

    A key (a line stripped of ASCII white space, A-Z lowered, of at least `least` code points) repeats while at
    least `min_docs` documents hold it. The index holds, in the folder `path`:
    - postings (h1, h2, doc_id), one row for each key and document, a folder for each insert;
    - counts (h1, h2, n, last, epoch, whole), what each insert or delete did to the references of a key: n is added;
      last is the largest id the step saw, of all documents where `whole`, and epoch numbers the deletes;
    - filters (shard, body), the cuckoo filters of the keys that repeat now, and gone (doc_id), deleted ids.
    insert() and delete() write their own rows only. Keys that begin to repeat are inserted into the filters, those that
    cease to are deleted from them; a filter that is full is built anew by itself, and all are where
    SHARD_KEYS keys a filter want more shards. So whatever was dropped on account of a document comes back
    after its deletion. A step that fails leaves the index as it was: tables are named by the last line of a step.
    Null ids are one id, the smallest; rows of one id are one document; null and empty texts hold no key.
    """

    KINDS = {"postings": "h1 long, h2 long, doc_id long", "counts": "h1 long, h2 long, n long, last long, epoch long, whole boolean", "filters": "shard long, body binary", "gone": "doc_id long"}

    def __init__(self, spark: SparkSession, path: str | None = None, least: int = 40, min_docs: int = 5):
        self.spark, self.path, self.least, self.min_docs = spark, path or f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}", least, min_docs
        self.tables: dict[str, list[str]] = {k: [] for k in self.KINDS}
        self.n_keys, self.n_shards, self.epoch = 0, 1, 0

    def table(self, name: str) -> DataFrame:
        """All rows of a table, those of deleted documents left out of the postings."""
        if not self.tables[name]:
            return self.spark.createDataFrame([], self.KINDS[name])
        out = self.spark.read.schema(self.KINDS[name]).parquet(*self.tables[name])
        return out.join(self.table("gone"), "doc_id", "left_anti").select("h1", "h2", "doc_id") if name == "postings" and self.tables["gone"] else out

    def _write(self, name: str, df: DataFrame) -> str:
        at = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.select(*[c.split()[0] for c in self.KINDS[name].split(", ")]).write.parquet(at)
        return at

    def counts(self) -> DataFrame:
        """(h1, h2, n, last) of all keys ever seen: references now, and the largest id that holds it."""
        rows = self.table("counts")
        if not self.epoch:
            if len(self.tables["counts"]) < 2:
                return rows.select("h1", "h2", "n", "last")
            return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        # one entry for each step that met the key: the last ids since the latest step that saw all of them
        steps = rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.collect_list(F.struct("epoch", "last", "whole")).alias("steps"))
        since = F.coalesce(F.array_max(F.transform(F.filter("steps", lambda s: s["whole"]), lambda s: s["epoch"])), F.lit(0))
        steps = steps.withColumn("since", since)
        return steps.select("h1", "h2", "n", F.expr("array_max(transform(filter(steps, s -> s.epoch >= since), s -> s.last))").alias("last"))

    def repeated(self) -> DataFrame:
        """(h1, h2, last) of the keys that repeat now."""
        return self.counts().where(F.col("n") >= self.min_docs).select("h1", "h2", "last")

    def _filters(self, more: DataFrame, less: DataFrame | None) -> list[str]:
        """The filters with keys inserted and deleted: by shard, each shard's own task."""
        grown = self.n_shards
        while self.n_keys > SHARD_KEYS * grown:
            grown *= 2
        if grown != self.n_shards or not self.tables["filters"]:
            self.n_shards, old, rows = grown, None, self.repeated_after.withColumn("more", F.lit(True))
        else:
            old, rows = self.table("filters"), more.withColumn("more", F.lit(True))
            if less is not None:
                rows = rows.unionByName(less.withColumn("more", F.lit(False)))
        rows = rows.select(shard_of(F.col("h1"), self.n_shards).alias("shard"), "h2", "more")
        after = self.repeated_after.select(shard_of(F.col("h1"), self.n_shards).alias("shard"), "h2")

        def update(key, held, rows):
            import pandas as pd

            new, dead = rows["h2"][rows["more"].astype(bool)].to_numpy(np.int64), rows["h2"][~rows["more"].astype(bool)].to_numpy(np.int64)
            try:
                body = (CuckooFilter.from_bytes(held["body"].iloc[0]).delete(dead).insert(new) if len(held) else CuckooFilter.of(new, int(1.5 * len(new)))).to_bytes()
            except OverflowError:
                body = b""
            return pd.DataFrame({"shard": [key[0]], "body": [body]})

        def build(rows):
            return rows.iloc[:1][["shard"]].assign(body=[CuckooFilter.of(rows["h2"].to_numpy(), int(1.5 * len(rows))).to_bytes()])

        none = self.spark.createDataFrame([], self.KINDS["filters"])
        at = self._write("filters", (old if old is not None else none).groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(update, self.KINDS["filters"]))
        made = self.spark.read.schema(self.KINDS["filters"]).parquet(at)
        full = [r["shard"] for r in made.where(F.octet_length("body") == 0).select("shard").collect()]
        if not full:
            return [at]
        again = after.where(F.col("shard").isin(full)).groupBy("shard").applyInPandas(build, self.KINDS["filters"])
        return [self._write("filters", made.where(~F.col("shard").isin(full)).unionByName(again))]

    def _step(self, postings: list[str], change: DataFrame, gone: list[str], epoch: int) -> None:
        """Takes over a step's rows once all are written. change: what it did to each key it met."""
        at = self._write("counts", change)
        change = self.spark.read.schema(self.KINDS["counts"]).parquet(at).select("h1", "h2", F.col("n").alias("dn"))
        held, n_keys, n_shards = {k: list(v) for k, v in self.tables.items()}, self.n_keys, self.n_shards
        was = self.epoch
        try:
            self.tables["counts"].append(at)
            self.tables["postings"] += postings
            self.tables["gone"] += gone
            self.epoch = epoch
            counts = self.counts()
            self.repeated_after = counts.where(F.col("n") >= self.min_docs).select("h1", "h2")
            if not held["counts"]:
                more = cut(self.repeated_after, "line-more")
                less = None
                self.n_keys = more.count()
                self.repeated_after = more
            else:
                met = cut(counts.join(change, ["h1", "h2"]).select("h1", "h2", "n", (F.col("n") - F.col("dn")).alias("before")), "line-met")
                more = met.where((F.col("n") >= self.min_docs) & (F.col("before") < self.min_docs)).select("h1", "h2")
                less = met.where((F.col("n") < self.min_docs) & (F.col("before") >= self.min_docs)).select("h1", "h2")
                self.n_keys += more.count() - less.count()
            self.tables["filters"] = self._filters(more, less)
        except Exception:
            self.tables, self.n_keys, self.n_shards, self.epoch = held, n_keys, n_shards, was
            raise

    def insert(self, documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> LineIndex:
        """Adds documents. Ids that are in the index must be deleted first; deleted ids may come back."""
        known = self.tables["gone"]
        if known:
            # an id that comes back is gone no more: its old postings are written off for good
            back = documents.select(own_id(doc_id).alias("doc_id")).distinct()
            if self.table("gone").join(back, "doc_id", "left_semi").limit(1).count():
                rest = self._write("postings", self.table("postings"))
                self.tables = {**self.tables, "postings": [rest], "gone": []}
        at = self._write("postings", postings(documents, text, doc_id, self.least).distinct())
        new = self.spark.read.schema(self.KINDS["postings"]).parquet(at)
        change = new.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        self._step([at], change.select("h1", "h2", "n", "last", F.lit(self.epoch).cast("long").alias("epoch"), F.lit(False).alias("whole")), [], self.epoch)
        return self

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """Takes documents back by their ids; ids that are not there change nothing."""
        old = self.table("postings")
        asked = ids.select(own_id(doc_id).alias("doc_id")).distinct()
        gone = self._write("gone", asked)
        lost = cut(old.join(self.spark.read.schema(self.KINDS["gone"]).parquet(gone), "doc_id", "left_semi"), "line-lost")
        less = lost.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("lost"))
        rest = old.join(asked, "doc_id", "left_anti").join(less.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.max("doc_id").alias("last"))
        change = less.join(rest, ["h1", "h2"], "left").select("h1", "h2", (-F.col("lost")).alias("n"), "last", F.lit(self.epoch + 1).cast("long").alias("epoch"), F.lit(True).alias("whole"))
        self._step([], change, [gone], self.epoch + 1)
        return self

    def drops(self, documents: DataFrame, text: str, doc_id: str) -> DataFrame:
        """(doc_id, keys): the keys whose lines each document loses.

        The filters let through the lines that may repeat; those alone are shuffled to the exact counts. That
        join may be uneven; adaptive execution splits its large partitions.
        """
        probe = probe_of(self.table("filters"), self.n_shards)
        lost = postings(documents, text, doc_id, self.least, probe).join(self.repeated(), ["h1", "h2"]).where("doc_id <> last")
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("keys"))

    def clean(self, documents: DataFrame, keep: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """Columns `keep` and ld_* of documents of the index, by its counts as they are now."""
        return cleaned(documents, self.drops(documents, text, doc_id), text, doc_id, keep, self.least)


def dedup(documents: DataFrame, keep: list[str], text: str = "text", doc_id: str = "doc_id", least: int = 40, min_docs: int = 5) -> DataFrame:
    """Columns `keep` and ld_text, ld_n_lines, ld_n_dropped: each text without lines that repeat elsewhere.

    A line that repeats (see LineIndex) stays only in the document with the largest id. Null and empty texts
    are one empty line and stay as they are. Rows with the same id are one document: they count once and all
    keep or all lose a line. A null id is the smallest id. Every row comes back.
    """
    return LineIndex(documents.sparkSession, least=least, min_docs=min_docs).insert(documents, text, doc_id).clean(documents, keep, text, doc_id)


def clean_documents(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **params) -> DataFrame:
    """The documents with their repeated lines dropped; n_chars, if there is one, follows a changed text."""
    names = documents.columns
    plain = {c: f"c{i}" for i, c in enumerate(names)}
    out = dedup(documents.toDF(*plain.values()), [plain[c] for c in names if c != text], plain[text], plain[doc_id], **params).withColumnRenamed("ld_text", plain[text])
    if "n_chars" in names:
        size = F.char_length(plain[text]).cast(documents.schema["n_chars"].dataType)
        out = out.withColumn(plain["n_chars"], F.when(F.col("ld_n_dropped") > 0, size).otherwise(F.col(plain["n_chars"])))
    return out.select(*plain.values()).toDF(*names)


def contract(documents: DataFrame) -> DataFrame:
    """One row per document for op4."""
    out = dedup(documents, ["doc_id"])
    return out.select("doc_id", F.col("ld_n_lines").alias("n_lines"), F.col("ld_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("ld_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
