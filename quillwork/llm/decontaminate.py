"""Benchmark decontamination with a generalised suffix automaton over the words of test items."""

from __future__ import annotations

import io
import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quillwork.llm._rows import cut, map_text, quoted, word_hashes
from quillwork.llm.near_dup import run_hashes

#: Bytes of benchmark text in one automaton, about half a million words. Building one takes about 350 MB of a worker,
#: which then keeps about 20 MB of arrays.
BLOCK_BYTES = 3 << 20
#: Bytes of automata that are sent to the tasks at once. Beyond them, the rows are written and read again for the next.
PASS_BYTES = 64 << 20
#: Words of one piece of a very long item; pieces overlap by a window, so that no window is lost.
PIECE_WORDS = 100_000
#: Words in a row that are looked up before the automaton reads them.
GRAM = 3


@dataclass
class SuffixAutomaton:
    """All substrings (of words) of a set of items.

    A state stands for substrings that end at the same places; `link` leads to the state of its longest
    suffix that ends at more places, `length` is its longest substring. While a text is read word by
    word, the state and the matched length say how long a suffix of what was read occurs in some item.
    """

    window: int = 10
    vocab: dict = field(default_factory=dict)
    step: list = field(default_factory=lambda: [{}])
    link: list = field(default_factory=lambda: [-1])
    length: list = field(default_factory=lambda: [0])
    items: dict = field(default_factory=dict)
    short: dict = field(default_factory=dict)

    def _state(self, step: dict, link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, at: int, via: int, word: int) -> int:
        """Gives the substring of length(at) + 1 that ends in `via` a state of its own."""
        clone = self._state(dict(self.step[via]), self.link[via], self.length[at] + 1)
        self.link[via] = clone
        while at >= 0 and self.step[at].get(word) == via:
            self.step[at][word] = clone
            at = self.link[at]
        return clone

    def _append(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        new, at = self._state({}, 0, self.length[last] + 1), last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.step[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, to, word)
        return new

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], window: int = 10) -> Matcher:
        """Of (item id as text, UTF-8 text) pairs."""
        self, coded = cls(window), []
        names: dict[str, int] = {}
        for name, text in items:
            words = word_hashes(text).tolist()
            for a in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                codes = [self.vocab.setdefault(w, len(self.vocab)) for w in words[a : a + PIECE_WORDS + window - 1]]
                if codes:
                    coded.append((names.setdefault(name, len(names)), codes))
                    last = 0
                    for c in codes:
                        last = self._append(last, c)
        for name, codes in coded:
            at = 0
            for i, c in enumerate(codes):
                at = self.step[at][c]
                if i + 1 >= window:
                    self.items.setdefault(self._window_state(at), set()).add(name)
            if len(codes) < window:
                self.short.setdefault(at, (len(codes), set()))[1].add(name)
        return self._arrays([codes for _, codes in coded], list(names))

    def _window_state(self, at: int) -> int:
        """The state among the suffixes of `at` that holds the one of `window` words."""
        while self.length[self.link[at]] >= self.window:
            at = self.link[at]
        return at

    def _arrays(self, coded: list[list[int]], names: list[str]) -> Matcher:
        least = min((min(len(c), self.window) for c in coded), default=1 << 30)
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        near = [-1] * len(self.step)  # the nearest state from here on along suffix links that ends a short item
        for s in order:
            near[s] = s if s in self.short else near[self.link[s]]
        width = max(1, len(self.vocab))
        keys = np.fromiter((s * width + c for s, to in enumerate(self.step) for c in to), np.int64)
        to = np.fromiter(chain.from_iterable(x.values() for x in self.step), np.int32)
        by_key = np.argsort(keys)
        words = np.fromiter(self.vocab, np.uint64, len(self.vocab))
        by_word = np.argsort(words)
        gram = min(GRAM, least)
        grams = [_grams(words[np.array(c)], gram) for c in coded]
        distinct = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        bits = max(16, int(np.ceil(np.log2(16 * len(distinct) + 1))))
        known = np.zeros(1 << (bits - 3), np.uint8)
        at = distinct >> np.uint64(64 - bits)
        np.bitwise_or.at(known, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        ends = [(s, self.window, held) for s, held in self.items.items()] + [(s, n, held) for s, (n, held) in self.short.items()]
        ends.sort(key=lambda e: (e[0], e[1]))
        return Matcher(
            self.window, least, gram, np.array(names, object), words[by_word], by_word.astype(np.int32), keys[by_key], to[by_key], np.array(self.link, np.int32), np.array(self.length, np.int32), np.array(near, np.int32),
            known, np.array([e[0] for e in ends], np.int32), np.array([e[1] for e in ends], np.int32), np.cumsum([0, *(len(e[2]) for e in ends)]), np.array([x for e in ends for x in sorted(e[2])], np.int32),
        )


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs, one for each word that begins one."""
    return run_hashes(hashes, n) if 1 <= n <= len(hashes) else np.zeros(0, np.uint64)


@dataclass
class Matcher:
    """A suffix automaton as arrays: transitions sorted by (state, word), states with links and lengths, and for the
    states that end a window or a short item, its words and the items. `known` holds a bit for the hash of
    every `gram` words in a row of the items: only where all such runs of a text are known is it read."""

    window: int
    least: int
    gram: int
    names: np.ndarray
    words: np.ndarray
    codes: np.ndarray
    keys: np.ndarray
    to: np.ndarray
    link: np.ndarray
    length: np.ndarray
    near: np.ndarray
    known: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    held: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        plain = {k: v for k, v in self.__dict__.items() if k != "names"}
        text = "\x00".join(self.names).encode("utf-8", "surrogatepass")
        np.savez(out, names=np.frombuffer(text, np.uint8), **plain)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Matcher:
        with np.load(io.BytesIO(data)) as z:
            held = {k: z[k] for k in z.files}
        names = held.pop("names").tobytes().decode("utf-8", "surrogatepass").split("\x00")
        return cls(names=np.array(names, object), **{k: int(v) if v.ndim == 0 else v for k, v in held.items()})

    def candidates(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """[from, to) of the stretches of at least `least` words whose runs of `gram` words are all known."""
        grams = _grams(hashes, self.gram)
        if not len(grams) or not len(self.words):
            return []
        at = grams >> np.uint64(64 - int(np.log2(len(self.known) << 3)))
        there = (self.known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        turns = np.flatnonzero(np.diff(np.concatenate(([0], there, [0])).astype(np.int8)))
        a, b = turns[0::2], turns[1::2] + self.gram - 1
        long = b - a >= self.least
        return list(zip(a[long].tolist(), b[long].tolist(), strict=True))

    def walk(self, hashes: np.ndarray, base: int, spans: list[tuple[int, int]], found: set[int]) -> int:
        """Reads a stretch that begins at word `base`: adds hit spans and the ends (by place in `ends`) met;
        returns the longest match."""
        at_word = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        codes = np.where(self.words[at_word] == hashes, self.codes[at_word], -1)
        keys, to, link, length, near, width, last = self.keys, self.to, self.link, self.length, self.near, len(self.words), len(self.keys) - 1
        at = matched = longest = 0
        for i, c in enumerate(codes.tolist(), base + 1):
            if c < 0:
                at = matched = 0
                continue
            while True:
                k = int(keys.searchsorted(at * width + c))
                if k <= last and keys[k] == at * width + c:
                    at, matched = int(to[k]), matched + 1
                    break
                if not at:
                    break
                at = int(link[at])
                matched = int(length[at])
            longest = max(longest, matched)
            reach = 0
            if matched >= self.window:
                reach, s = matched, at
                while length[link[s]] >= self.window:
                    s = int(link[s])
                found.add(int(self.ends.searchsorted(s, "right")) - 1)  # the window comes after a short item of the state
            s = int(near[at])
            while s > 0:
                e = int(self.ends.searchsorted(s))
                if self.sizes[e] <= matched:
                    reach = max(reach, int(self.sizes[e]))
                    found.add(e)
                s = int(near[link[s]])
            if reach:
                a = i - reach
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i))
        return longest

    def items_of(self, found: set[int]) -> set[str]:
        """Ids of the items of the ends met, each end looked up once."""
        if not found:
            return set()
        return set(self.names[np.unique(np.concatenate([self.held[self.starts[e] : self.starts[e + 1]] for e in found]))])

    def hits(self, texts: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], set, int]]:
        """For each text, as word hashes: maximal hit spans [from, to) of word positions in order, items with a window
        here, longest match."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        out: list = [([], set(), 0)] * len(texts)
        if not len(ends):
            return out
        gap = np.zeros(1, np.uint64)  # no word has this hash
        whole = np.concatenate([x for t in texts for x in (t, gap)])
        state: dict[int, list] = {}
        for a, b in self.candidates(whole):
            # runs over a gap are unknown but for chance, and the walk ends at the gap
            while a < b:
                k = int(np.searchsorted(ends, a, "right"))
                first, end = int(ends[k]) - len(texts[k]) - 1, min(b, int(ends[k]) - 1)
                if end - a >= self.least:
                    had = state.setdefault(k, [[], set(), 0])
                    had[2] = max(had[2], self.walk(whole[a:end], a - first, had[0], had[1]))
                a = int(ends[k])
        for k, (spans, found, longest) in state.items():
            out[k] = (spans, self.items_of(found), longest)
        return out


def automata(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(block, body): a Matcher for each block of items, of about BLOCK_BYTES of text, built in its own task.

    Equal items count once. A hash of id and text deals the items to blocks, so their sizes are even.
    """
    own = benchmark.select(F.coalesce(F.col(quoted(item_id)).cast("string"), F.lit("")).alias("i"), F.col(quoted(text)).cast("binary").alias("t")).where("t is not null").distinct()
    n = max(1, -(-(benchmark.agg(F.sum(F.octet_length(F.col(quoted(text))))).first()[0] or 0) // BLOCK_BYTES))

    def build(rows):
        import pandas as pd

        items = sorted(zip(rows["i"], map(bytes, rows["t"]), strict=True))
        return pd.DataFrame({"block": rows["block"].iloc[:1], "body": [SuffixAutomaton.of(items, window).to_bytes()]})

    return cut(own.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n))).groupBy("block").applyInPandas(build, "block long, body binary"), "benchmark-automata")


def passes(table: DataFrame) -> list[list[int]]:
    """The blocks in lists that take at most PASS_BYTES together (a larger one is alone)."""
    out: list[list[int]] = [[]]
    total = 0
    for r in table.select("block", F.octet_length("body").alias("n")).orderBy("block").collect():
        if out[-1] and total + r["n"] > PASS_BYTES:
            out.append([])
            total = 0
        out[-1].append(r["block"])
        total += r["n"]
    return out


_SPANS = ArrayType(StructType([StructField("from", LongType()), StructField("to", LongType())]))
#: What `find` appends.
FIELDS = [
    StructField("dc_n_words", LongType()),
    StructField("dc_n_hit", LongType()),
    StructField("dc_items", ArrayType(StringType())),
    StructField("dc_longest", LongType()),
    StructField("dc_spans", _SPANS),
]


def find(documents: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Columns `keep` of each document, then dc_n_words, dc_n_hit, dc_items, dc_longest, dc_spans.

    A window is `window` consecutive words of an item, or a whole shorter item. A word inside any
    occurrence of a window is hit; dc_spans are the hit words as maximal [from, to) word positions, dc_items
    the sorted ids of items with an occurring window, dc_longest the longest run of words, of those as long as the
    shortest window, that occurs in one item (of a very long item: in PIECE_WORDS of it). A null or empty
    text has no words; an empty benchmark hits nothing; repeated items count by id; a null item id is the
    empty text. Rows stay one for one, repeated ones too. Kept columns may have any names; one with a name
    above is replaced. Automata are built in blocks by the executors and sent in passes of at most
    PASS_BYTES; rows are written between passes, so one pass is in memory at a time.
    """
    spark = documents.sparkSession
    names = [f.name for f in FIELDS]
    keep = [c for c in keep if c.lower() not in names]
    held = [f"c{i}" for i in range(len(keep))]
    out = documents.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keep, held, strict=True)], F.col(quoted(text)).alias("body"))
    table = automata(benchmark, item_id, item_text, window)
    rounds = passes(table)
    for k, blocks in enumerate(rounds):
        model = spark.sparkContext.broadcast([bytes(r["body"]) for r in table.where(F.col("block").isin(blocks)).collect()])
        before = ("dc_items", "dc_longest", "dc_spans") if k else ()
        out = map_text(out, "body", [*held, "body"] if k + 1 < len(rounds) else held, FIELDS, lambda m=model: matcher(m.value), extra=before)
        if k + 1 < len(rounds):
            out = cut(out, "benchmark-pass")
            model.destroy()
    return out.toDF(*keep, *names)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matcher(bodies: list[bytes]):
    models = [Matcher.from_bytes(b) for b in bodies]

    def work(texts, *before):
        words = [word_hashes(t) for t in texts]
        found = [m.hits(words) for m in models]
        cols: list[list] = [[] for _ in FIELDS]
        for k, w in enumerate(words):
            own = [f[k] for f in found]
            names, longest, spans = set().union(*(o[1] for o in own)), max((o[2] for o in own), default=0), [s for o in own for s in o[0]]
            if before:
                names |= set(before[0][k])
                longest = max(longest, before[1][k])
                spans += [(s["from"], s["to"]) for s in before[2][k]]
            spans = united(spans)
            for c, v in zip(cols, (len(w), sum(b - a for a, b in spans), sorted(names), longest, [{"from": a, "to": b} for a, b in spans]), strict=True):
                c.append(v)
        return cols

    return work


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans, and without what stands between the words of one span."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """The documents without benchmark passages: hit spans are cut out of the text, and a document of whose
    words a share of max_coverage or more is hit goes altogether. Other documents stay as they are, empty
    and null texts included. Columns are those of the input; n_chars, if there is one, follows the text.
    """
    names = documents.columns
    sizes = [c for c in names if c == "n_chars"]
    rest = [c for c in names if c not in (text, *sizes)]
    fields = [documents.schema[text], *(documents.schema[c] for c in sizes)]

    def factory():
        def work(texts, words, hits, spans, *counts):
            held = [not h or h < max_coverage * n for n, h in zip(words, hits, strict=True)]
            new = [
                without(t, [(s["from"], s["to"]) for s in cut]).decode("utf-8", "replace") if cut else t if t is None else t.decode("utf-8", "replace")
                for t, cut, k in zip(texts, spans, held, strict=True)
                if k
            ]
            if not counts:
                return [held, new]
            was = [(n, cut) for n, cut, k in zip(counts[0], spans, held, strict=True) if k]
            return [held, new, [len(t) if cut else n for t, (n, cut) in zip(new, was, strict=True)]]

        return work

    plain = {c: f"c{i}" for i, c in enumerate(names)}
    found = find(documents.toDF(*plain.values()), benchmark, list(plain.values()), plain[text], window=window)
    extra = ("dc_n_words", "dc_n_hit", "dc_spans", *(plain[c] for c in sizes))
    fields = [StructField(plain[f.name], f.dataType) for f in fields]
    out = map_text(found, plain[text], [plain[c] for c in rest], fields, factory, extra=extra, select=True)
    return out.select(*plain.values()).toDF(*names)


def contract(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document for op9: the digest columns of `find`."""
    return find(documents, benchmark, ["doc_id"]).select(
        "doc_id",
        F.col("dc_n_words").alias("n_words"),
        F.col("dc_n_hit").alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("dc_n_hit") > 0).alias("contaminated"),
    )
