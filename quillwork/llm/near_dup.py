"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quillwork.llm._rows import MIX, cut, map_text, quoted, word_hashes
from quillwork.llm.graph import components

#: Members of one side of a verified block, and n-grams of one side, at most about so many.
BLOCK, BLOCK_GRAMS = 1024, 1_500_000
#: A set of candidates of more blocks than this is verified bucket by bucket instead of as a whole.
MOST_BLOCKS = 16


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, given those of the words; fewer words are one run, none have none."""
    if not len(h):
        return h
    width = min(n, len(h))
    s = h[: len(h) - width + 1] * MIX[0]
    for k in range(1, width):
        s = (s ^ (s >> np.uint64(29))) * MIX[k % 5] + h[k : len(h) - width + 1 + k]
    s ^= s >> np.uint64(32)
    return s * MIX[1]


def gram_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted hashes of the n-word runs of a text; a text of fewer words is one run, one of none has none."""
    return np.unique(run_hashes(word_hashes(text), n))


def band_plan(threshold: float, recall: float, most_bands: int = 24) -> tuple[int, int]:
    """(bands, rows): the most rows, which give the fewest chance candidates, with which at most most_bands
    bands find a pair at the threshold with chance `recall`."""
    best = (most_bands, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= most_bands:
            best = (bands, rows)
    return best


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.weights = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """One hash for each band of a set's smallest values under each permutation."""
        low = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 4096):
            np.minimum(low, (grams[None, at : at + 4096] * self.factors[:, None]).min(1), out=low)
        h = (low.reshape(self.bands, self.rows) * self.weights).sum(1, dtype=np.uint64)
        return (h ^ (h >> np.uint64(31))).view(np.int64)


def signed(documents: DataFrame, text: str, doc_id: str, n: int, plan: tuple[int, int]) -> DataFrame:
    """(doc_id, k, grams, bands): hash of the n-gram set, its size, band hashes; k null for texts of no words."""

    def factory():
        mins = MinHash(*plan)

        def work(texts):
            keys, sizes, bands = [], [], []
            for t in texts:
                g = gram_set(t, n)
                keys.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                sizes.append(len(g))
                bands.append(mins.of(g) if len(g) else None)
            return [pa.array(keys, pa.binary()), sizes, pa.array(bands, pa.list_(pa.int64()))]

        return work

    own = documents.select(F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(quoted(text)).alias("text"))
    fields = [StructField("k", BinaryType()), StructField("grams", LongType()), StructField("bands", ArrayType(LongType()))]
    return map_text(own, "text", ["doc_id"], fields, factory)


def linked(a: list, b: list | None, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of candidates with Jaccard similarity of threshold or more; b None: pairs
    within a, the smaller row first. Members are (key, documents, bands, grams); a pair is a candidate if it
    shares a band, and, if band is one, that band first."""
    own = b is None
    b = a if own else b
    x, y = np.stack([m[2] for m in a]), np.stack([m[2] for m in b])
    shared = np.zeros((len(a), len(b)), bool)
    for k in range(x.shape[1]):
        same = x[:, k][:, None] == y[:, k][None, :]
        if k == band:
            shared = same & ~shared
            break
        shared |= same
    size_a, size_b = np.array([len(m[3]) for m in a]), np.array([len(m[3]) for m in b])
    lo, hi = np.minimum(size_a[:, None], size_b[None, :]), np.maximum(size_a[:, None], size_b[None, :])
    shared &= lo >= threshold * hi - 1e-9
    if own:
        shared &= np.tri(len(a), k=-1, dtype=bool).T
    i, j = np.nonzero(shared)
    if not len(i):
        return i, j
    if len(i) <= 4 * (len(a) + len(b)):
        common = np.array([np.intersect1d(a[p][3], b[q][3], assume_unique=True).size for p, q in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        common = overlaps(a, b)[i, j]
    held = common >= threshold * (size_a[i] + size_b[j] - common) - 1e-9
    return i[held], j[held]


def overlaps(a: list, b: list) -> np.ndarray:
    """Sizes of all intersections of n-gram sets of a and b, as products of 0/1 matrices, some grams at a time."""
    members = a if a is b else a + b
    owner = np.repeat(np.arange(len(members)), [len(m[3]) for m in members])
    _, gram, times = np.unique(np.concatenate([m[3] for m in members]), return_inverse=True, return_counts=True)
    often = times[gram] > 1
    owner, gram = owner[often], gram[often]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    out = np.zeros((len(a), len(b)), np.float32)
    new = np.concatenate(([True], gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, (at, at + 2048))
        part = np.zeros((len(members), 2048), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part[: len(a)] @ (part if a is b else part[len(a) :]).T
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows along the pairs."""
    root = np.arange(n)
    while len(i):
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """(k, root, n_texts, n_docs) of every member of blocks (unit, lo, hi, band, side, k, docs, bands, set).

    Rows of a block lie together in a sorted partition and are read one block at a time. From each block comes
    one row for each member that has a link: how many texts and documents it links to there, and a member
    it is connected with.
    """
    schema = StructType([StructField("k", BinaryType()), StructField("root", BinaryType()), StructField("n_texts", LongType()), StructField("n_docs", LongType())])
    arrow = to_arrow_schema(schema)

    def of(block: list) -> pa.RecordBatch:
        band, inner = block[0][3], block[0][1] == block[0][2]
        sides: list[dict] = [{}, {}]
        for _, _, _, _, side, k, docs, bands, grams in block:
            sides[0 if inner else side].setdefault(k, (k, docs, np.array(bands, np.int64), np.frombuffer(grams, np.uint64)))
        a, b = list(sides[0].values()), list(sides[1].values())
        members = a if inner else a + b
        i, j = linked(a, None if inner else b, band, threshold) if a and (inner or b) else (np.zeros(0, int), np.zeros(0, int))
        if not inner:
            j = j + len(a)
        docs = np.array([m[1] for m in members])
        texts, others = np.zeros(len(members), np.int64), np.zeros(len(members), np.int64)
        for p, q in ((i, j), (j, i)):
            np.add.at(texts, p, 1)
            np.add.at(others, p, docs[q])
        root = _roots(len(members), i, j)
        at = np.flatnonzero(texts)
        return pa.RecordBatch.from_arrays([pa.array([members[r][0] for r in at], pa.binary()), pa.array([members[r][0] for r in root[at]], pa.binary()), pa.array(texts[at]), pa.array(others[at])], schema=arrow)

    def run(batches):
        key, block = None, []
        for batch in batches:
            cols = [batch.column(c) for c in range(batch.num_columns)]
            for start in range(0, batch.num_rows, 256):
                for row in zip(*(c.slice(start, 256).to_pylist() for c in cols), strict=True):
                    if row[:4] != key:
                        if block:
                            yield of(block)
                        key, block = row[:4], []
                    block.append(row)
        if block:
            yield of(block)

    return blocks.mapInArrow(run, schema)


#: Rows of one group are dealt over so many keys where each of them must learn a sum of its group.
SALTS = 64


def with_sums(df: DataFrame, group: str, first: list, second: list) -> DataFrame:
    """df with aggregates of each row's group: `first` over each of SALTS parts of it, `second` over those.

    Rows meet their sums by (group, part), so that a group of a third of all rows is not one task's.
    """
    dealt = df.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)))
    parts = dealt.groupBy(group, "salt").agg(*first)
    sums = parts.select(group, "salt").join(parts.groupBy(group).agg(*second), group)
    return dealt.join(sums, [group, "salt"]).drop("salt")


def join(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """(doc_id, class_id, copy_id, n_copies, n_links, n_text_links) of every row of documents.

    Two documents are linked if the Jaccard similarity of their sets of n-word runs is threshold or more.
    Documents of equal sets are copies: copy_id is their smallest id, n_copies their number, and the class
    stands for them in all that follows, so copies are never paired. class_id is the smallest id that links
    lead to, over other documents too. n_links counts the other documents that the document is linked to, its
    copies among them, n_text_links those classes of copies. Texts without words link to nothing. Rows of one
    id and different texts are different documents. A null id is the smallest id.

    Bands and rows are chosen for `recall` at the threshold. Band hashes alone are shuffled; buckets of one
    class are dropped by sums before any join. Members of what buckets connect come together once with their
    n-gram sets, in pairs of blocks of bounded size, so a large group is spread over tasks and no pair is
    written: a task gives one row a member. Any pair that shares a band is verified in exactly one place.
    """
    plan = band_plan(threshold, recall)
    light = cut(signed(documents, text, doc_id, n, plan), "near-signed")
    with_words = light.where("k is not null")
    classes = cut(with_words.groupBy("k").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("docs"), F.first("grams").alias("grams"), F.first("bands").alias("bands")), "near-classes")
    placed = classes.select("k", F.posexplode("bands").alias("band", "hash")).select("k", "band", F.xxhash64("band", "hash").alias("bucket"))
    shared = cut(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("k").alias("star")).where("m > 1"), "near-buckets")
    members = cut(placed.join(shared, "bucket"), "near-members")
    parts = cut(components(members.select(F.col("k").alias("u"), F.col("star").alias("v"))).withColumnsRenamed({"node": "k"}), "near-parts")
    def n_blocks(count, grams):
        return F.greatest(F.ceil(count / F.lit(float(BLOCK))), F.ceil(grams / F.lit(float(BLOCK_GRAMS))), F.lit(1))

    sizes = [F.count(F.lit(1)).alias("c"), F.sum("grams").alias("g")]
    sized = with_sums(parts.join(classes.select("k", "grams"), "k"), "root", sizes, [F.sum("c").alias("c"), F.sum("g").alias("g")]).withColumn("blocks", n_blocks(F.col("c"), F.col("g")))
    whole = sized.where(F.col("blocks") <= MOST_BLOCKS).select("k", F.xxhash64("root").alias("unit"), F.lit(-1).alias("band"), "blocks")
    large = sized.where(F.col("blocks") > MOST_BLOCKS).select("k")
    by_bucket = members.join(large, "k", "left_semi").join(classes.select("k", "grams"), "k")
    buckets = with_sums(by_bucket, "bucket", sizes, [F.sum("c").alias("c"), F.sum("g").alias("g")])
    buckets = buckets.select("k", F.col("bucket").alias("unit"), "band", n_blocks(F.col("c"), F.col("g")).alias("blocks"))
    units = whole.unionByName(buckets).groupBy("k").agg(F.collect_list(F.struct("unit", "band", "blocks")).alias("units"))
    # a class has one unit, or one for each of its bands

    def set_factory():
        def work(texts, keys):
            sets = [gram_set(t, n) for t in texts]
            kept = [len(g) > 0 and xxhash.xxh3_128_digest(g.tobytes()) == k for g, k in zip(sets, keys, strict=True)]
            return [kept, pa.array([g.tobytes() for g, y in zip(sets, kept, strict=True) if y], pa.binary())]

        return work

    asked = classes.join(units, "k").select("k", "docs", "bands", "units", F.col("rep").alias("id"))
    own = documents.select(F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(quoted(text)).alias("text"))
    sets = map_text(own.join(asked, "id"), "text", ["k", "docs", "bands", "units"], [StructField("set", BinaryType())], set_factory, extra=("k",), select=True)
    spread = sets.select("k", "docs", "bands", "set", F.inline("units")).withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    blocks = spread.select("unit", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "band", (F.col("own") > F.col("other")).cast("int").alias("side"), "k", "docs", "bands", "set")
    blocks = blocks.repartition("unit", "lo", "hi", "band").sortWithinPartitions("unit", "lo", "hi", "band")
    links = cut(verified(blocks, threshold), "near-links")
    counts = links.groupBy("k").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    groups = components(links.select(F.col("k").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"node": "k"})
    named = groups.join(classes.select("k", "rep"), "k")
    named = with_sums(named, "root", [F.min("rep").alias("class_id")], [F.min("class_id").alias("class_id")])
    facts = classes.select("k", "rep", "docs").join(named.select("k", "class_id"), "k", "left").join(counts, "k", "left")
    facts = cut(facts.select("k", F.col("rep").alias("copy_id"), "docs", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_docs", F.lit(0)).alias("n_docs")), "near-facts")
    # texts without words meet nothing, so their one null key goes round the join
    out = with_words.select("doc_id", "k").join(facts, "k", "left").unionByName(light.where("k is null").select("doc_id", "k"), allowMissingColumns=True)
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("docs", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("n_docs") + F.col("docs") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).alias("n_text_links"),
    )


def contract(documents: DataFrame) -> DataFrame:
    """One row per document for op2; a null doc_id comes back as null."""
    lost = F.lit(-(1 << 63))
    return join(documents).withColumns({c: F.when(F.col(c) != lost, F.col(c)) for c in ("doc_id", "class_id", "copy_id")})


def keep_one(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without near copies: of every class, the document of the smallest id stays, unchanged.

    Ids are taken to be unique, as in `documents`; rows that share an id stay or go together.
    """
    names = documents.columns
    gone = join(documents.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))).where("doc_id <> class_id").select("doc_id").distinct()
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    own = F.coalesce(F.col(f"c{names.index(doc_id)}").cast("long"), F.lit(-(1 << 63)))
    return plain.join(gone, own == F.col("doc_id"), "left_anti").toDF(*names)
