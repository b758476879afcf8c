"""Shared plumbing of the text operators: Arrow maps, word splitting, shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Rows of one Arrow batch are handed to Python code in slices of at most this many text bytes
#: (a single longer text is one slice), which bounds the memory of a worker.
SLICE_BYTES = 8 << 20

#: ASCII bytes that separate words; digits, lower-case letters and all bytes of other code points stay.
_WORDS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 text after lower-casing A-Z."""
    return text.lower().translate(_WORDS).split()


def folded(text: bytes) -> bytes:
    """The text with A-Z lowered and every separator a space; offsets stay those of the text."""
    return text.lower().translate(_WORDS)


MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: Bytes of text that are hashed at once; a longer word is a part of its own.
PART_BYTES = 1 << 20
_BASE = 0xD6E8FEB86659FD93
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE, and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"]


def _part_hashes(low: bytes) -> np.ndarray:
    b = np.frombuffer(low, np.uint8)
    inside = np.concatenate(([False], b != 32, [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    a, e = turns[0::2], turns[1::2]
    up, down = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    h = (total[e] - total[a]) * down[a] * MIX[0]
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    return (h ^ (h >> np.uint64(29))) | np.uint64(1)


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes, none of them 0, of the words of a text (see words_of), all in a few numpy operations: a
    polynomial over the bytes of each word, from running sums."""
    low, at, parts = folded(text or b""), 0, []
    while at < len(low):
        end = at + PART_BYTES
        if end < len(low):
            cut_at = low.rfind(b" ", at, end)
            end = cut_at if cut_at > at else low.find(b" ", end)
            end = len(low) if end < 0 else end
        parts.append(_part_hashes(low[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, computed once each; forgotten when there are too many."""

    MOST = 300_000

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def fresh(taken, name: str) -> str:
    """The name, lengthened until none of those taken is the same but for case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def key_text(column):
    """An id as text, null as the empty text: what the folds by crc32 are taken of."""
    return F.coalesce(column.cast("string"), F.lit(""))


def crc_mod(column, n: int):
    """crc32 of an id as text, modulo n."""
    return F.crc32(key_text(column).cast("binary")) % F.lit(n)


def slices(batch: pa.RecordBatch, text: pa.Array) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of rows whose texts take at most SLICE_BYTES together."""
    start, total = 0, 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE_BYTES:
            yield start, i - start
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes) - start


def map_text(
    df: DataFrame,
    text: str,
    keep: list[str],
    fields: list[StructField],
    factory: Callable[[], Callable[..., list]],
    extra: tuple[str, ...] = (),
    select: bool = False,
) -> DataFrame:
    """Columns `keep` of df and `fields` computed from the text column, batch by batch.

    factory() runs once in a task and returns a function from a list of UTF-8 texts (null: None), and
    one list for each column named in `extra`, to one list or Arrow array for each of `fields`. With
    select, the function returns first a list of booleans: rows with False are dropped.
    No row is compared with another, so this needs no shuffle; a lost task is just run again.
    """
    columns = list(dict.fromkeys([*keep, text, *extra]))
    at = {c: i for i, c in enumerate(columns)}
    kept = [StructField(c, df.schema[c].dataType, True) for c in keep]
    schema = StructType(kept + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in batches:
            whole = batch.column(at[text]).cast(pa.binary())
            for start, n in slices(batch, whole):
                part = batch.slice(start, n)
                out = work(whole.slice(start, n).to_pylist(), *(part.column(at[c]).to_pylist() for c in extra))
                held = [part.column(at[c]).cast(arrow.field(c).type) for c in keep]
                if select:
                    mask = pa.array(out[0], pa.bool_())
                    held = [h.filter(mask) for h in held]
                    out = out[1:]
                made = [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(len(keep) + i).type) for i, x in enumerate(out)]
                yield pa.RecordBatch.from_arrays(held + made, schema=arrow)

    return df.select(*[quoted(c) for c in columns]).mapInArrow(run, schema)


_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one all executors share, deleted when the driver's JVM ends.

    Where spark.checkpoint.dir is unset, a local session (as in tests) gets a folder of its own; on a cluster
    that is an error, since executors and driver would not see each other's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="quillwork-")
        spark.conf.set("spark.checkpoint.dir", at)
    app = f"{at.rstrip('/')}/quillwork-{spark.sparkContext.applicationId}"
    if app not in _folders:
        java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(app)
        files = java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(java)
        files.deleteOnExit(java)
        _folders[app] = app
    return app


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
