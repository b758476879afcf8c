"""Toxicity: a learned lexicon as a trie, met by Levenshtein automata, with context of every hit."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from quillwork.llm._rows import crc_mod, cut, key_text, map_text, quoted
from quillwork.llm.near_dup import gram_set

#: The classifier is fitted on about so many labelled documents at most, picked by a hash of their ids.
MAX_LABELLED = 40_000
#: A term's log odds less two standard errors must reach this.
LEAST_WEIGHT = 1.2
#: A term stands in so many toxic texts at least, and in so many more than by chance that of all terms looked at, about
#: BY_CHANCE would.
LEAST_TEXTS, BY_CHANCE = 3, 0.5
#: Part of a term's weight that a misspelling has.
MISSPELLED = 0.9
#: Lengths of word beginnings that can be terms besides whole words.
STEMS = (4, 5, 6)
#: Words of at least so many letters are also matched with one edit, or with two.
ONE_EDIT, TWO_EDITS = 5, 10
#: Words on each side of a hit that are looked at.
CONTEXT = 8

#: A word near terms tells abuse from quotation if its log odds between toxic and clean texts with terms, less as many
#: standard errors as chance gives among all such words, reach this; quotation marks around a term tell QUOTED.
LEAST_CONTEXT, QUOTED = 0.5, 1.0
_OPEN, _CLOSE = "\"'“‘«(`", "\"'”’»)`"

_WORD = re.compile(r"[^\W\d_]+")
#: Words with digits or mask marks inside, each of which stands for any letter.
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9*@$#!]{1,3}+[^\W\d_]++)+")


class Trie:
    """Terms with weights; a stem stands for all words that begin with it."""

    def __init__(self):
        self.step: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]
        self.stem: list[float] = [0.0]

    def add(self, term: str, stem: bool, weight: float) -> None:
        at = 0
        for c in term:
            to = self.step[at].get(c)
            if to is None:
                to = self.step[at][c] = len(self.step)
                self.step.append({})
                self.word.append(0.0)
                self.stem.append(0.0)
            at = to
        table = self.stem if stem else self.word
        table[at] = max(table[at], weight)

    def exact(self, word: str) -> float:
        """The largest weight of the word itself and of stems that it begins with."""
        at, best = 0, 0.0
        for c in word:
            best = max(best, self.stem[at])
            at = self.step[at].get(c, -1)
            if at < 0:
                return best
        return max(best, self.stem[at], self.word[at])

    def near(self, word: str, edits: int, least: int, swaps: bool) -> float:
        """The largest weight of whole-word terms of `least` letters or more within `edits` of the word; with
        swaps, two swapped neighbours are one edit.

        The word's Levenshtein automaton runs along the trie: its state is the set of (letters of the word
        used, edits so far), here as the row of fewest edits for each number of letters used. A branch ends
        where no state is left.
        """
        n, best = len(word), 0.0
        first = [min(i, edits + 1) for i in range(n + 1)]
        stack = [(to, c, 1, first, None, "") for c, to in self.step[0].items()]
        while stack:
            at, c, depth, row, before, last = stack.pop()
            new = [row[0] + 1]
            for i in range(1, n + 1):
                v = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (word[i - 1] != c))
                if swaps and before is not None and i > 1 and word[i - 1] == last and word[i - 2] == c:
                    v = min(v, before[i - 2] + 1)
                new.append(v)
            if new[n] <= edits and depth >= least:
                best = max(best, self.word[at])
            if min(new) <= edits:
                stack += [(to, d, depth + 1, new, row, c) for d, to in self.step[at].items()]
        return best


    def masked(self, word: str) -> float:
        """The largest weight of whole-word terms that the word is, its digits and marks being any letter."""
        at = [0]
        for c in word:
            if c.isalpha():
                at = [self.step[k][c] for k in at if c in self.step[k]]
            else:
                at = [to for k in at for to in self.step[k].values()]
        return max((self.word[k] for k in at), default=0.0)


@dataclass
class Lexicon:
    """(term, is it a stem, weight, match misspelled) entries and what is made of them to look words up."""

    entries: list[tuple[str, bool, float, bool]] = field(default_factory=list)
    #: what looks like a misspelled term, but stands in clean texts
    ordinary: set[str] = field(default_factory=set)
    #: words near a term and how much they speak for abuse, or below 0 for quotation
    context: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.trie, self.fuzzy = Trie(), Trie()
        self.stems: dict[int, set[str]] = {}
        self.whole: set[str] = set()
        # what is left of terms without one letter, or without two: a word within so many edits of a term leaves some of it too
        self.one: set[str] = set()
        self.two: set[str] = set()
        self.thirds: dict[int, tuple[set[str], set[str], set[str]]] = {}
        self.places: dict[int, list[tuple[int, int, set[str]]]] = {}
        self.longest = max((len(e[0]) for e in self.entries if not e[1]), default=0)
        for term, stem, weight, fuzzy in self.entries:
            self.trie.add(term, stem, weight)
            if stem:
                self.stems.setdefault(len(term), set()).add(term)
                continue
            self.whole.add(term)
            if fuzzy:
                self.fuzzy.add(term, False, weight)
                if len(term) >= ONE_EDIT:
                    self.one |= self._left(term, 1)
                if len(term) >= TWO_EDITS:
                    self.two |= self._left(term, 2)
                    for part, (i, j) in zip(self.thirds.setdefault(len(term), (set(), set(), set())), self._cuts(len(term)), strict=True):
                        part.add(term[i:j])

    def __getstate__(self):
        return self.entries, self.ordinary, self.context

    def __setstate__(self, state):
        self.entries, self.ordinary, self.context = state
        self.__post_init__()

    @staticmethod
    def _left(word: str, letters: int) -> set[str]:
        out = last = {word}
        for _ in range(letters):
            last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
            out = out | last
        return out

    @staticmethod
    def _cuts(n: int) -> tuple[tuple[int, int], ...]:
        return (0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)

    def _places(self, n: int) -> list[tuple[int, int, set[str]]]:
        """Where a word of n letters holds a third of a term that two edits left as it is, moved by two places at most."""
        found: dict[tuple[int, int], set[str]] = {}
        for size in range(max(TWO_EDITS, n - 2), n + 3):
            if size in self.thirds:
                for part, (i, j) in zip(self.thirds[size], self._cuts(size), strict=True):
                    for k in [i] if i == 0 else [n - (j - i)] if j == size else range(i - 2, i + 3):
                        found.setdefault((k, k + j - i), set()).update(part)
        return [(i, j, held) for (i, j), held in found.items()]

    def _two_edits(self, word: str) -> bool:
        """False only for words two edits off no term."""
        places = self.places.get(len(word))
        if places is None:
            places = self.places[len(word)] = self._places(len(word))
        for i, j, held in places:
            if word[i:j] in held:
                return not self.two.isdisjoint(self._left(word, 2))
        return False

    def _one_edit(self, word: str) -> bool:
        one = self.one
        if word in one:
            return True
        for i in range(len(word)):
            if word[:i] + word[i + 1 :] in one:
                return True
        return False

    def look(self, word: str) -> tuple[float, float]:
        """Weight of a word as a term, and as a misspelled one (0 if it is a term)."""
        if word in self.whole:
            return self.trie.exact(word), 0.0
        for n, held in self.stems.items():
            if word[:n] in held:
                return self.trie.exact(word), 0.0
        if word in self.ordinary:
            return 0.0, 0.0
        near = 0.0 if word.isalpha() else self.fuzzy.masked(word)
        # the automata run where they can end: most words leave nothing that a term does
        n = len(word)
        if ONE_EDIT - 1 <= n <= self.longest + 1 and self._one_edit(word):
            near = max(near, self.fuzzy.near(word, 1, ONE_EDIT, True))
        if TWO_EDITS - 2 <= n <= self.longest + 2 and self._two_edits(word):
            near = max(near, self.fuzzy.near(word, 2, TWO_EDITS, False))
        return 0.0, near


class Words(dict):
    """Weights of words, looked up once each. Words without weight are only remembered as such; when too many
    are, all are forgotten, which costs time and changes nothing."""

    MOST = 200_000

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) >= self.MOST:
            self.clear()
        found = self.lexicon.look(word)
        self[word] = found = found if found != (0.0, 0.0) else None
        return found


def finds(text: str, words: Words) -> list[tuple[int, int, float, float, str, bool, list[str]]]:
    """(start, end, weight as a term, weight as a misspelled one, word, in quotation marks, words around) of each term."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    masked = [(m.start(), m.end(), m[0]) for m in _MASKED.finditer(low) if words[m[0]]]
    if not masked and not any(words[w] for w in set(_WORD.findall(low))):
        return []
    places = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(low)]
    if masked:
        within = {k for a, b, _ in masked for k in range(a, b)}
        places = sorted([p for p in places if p[0] not in within] + masked)
    out = []
    for i, (a, b, w) in enumerate(places):
        found = words[w]
        if found:
            around = [x[2] for x in places[max(0, i - CONTEXT) : i] + places[i + 1 : i + 1 + CONTEXT]]
            out.append((a, b, *found, w, a > 0 and b < len(low) and low[a - 1] in _OPEN and low[b] in _CLOSE, around))
    return out


def how(lexicon: Lexicon, near: float, quoted_: bool, around: list[str]) -> str:
    """used, mentioned or misspelled: a term is mentioned where its quotation marks and the words around say so."""
    if near:
        return "misspelled"
    return "mentioned" if QUOTED * quoted_ - sum(lexicon.context.get(w, 0.0) for w in around) >= QUOTED else "used"


def hits_of(text: str, words: Words) -> list[tuple[int, int, float, str]]:
    """(start, end, weight, how) of each term in the text."""
    return [(a, b, exact or near, how(words.lexicon, near, q, around)) for a, b, exact, near, _, q, around in finds(text, words)]


HOWS = ("used", "mentioned", "misspelled")


def signals(hits: list[tuple[int, int, float, str]]) -> list[float]:
    """What the classifier sees: log(1 + weights) of terms used, misspelled ones counting MISSPELLED of theirs, of
    terms mentioned and of misspelled ones, and a constant."""
    sums = dict.fromkeys(HOWS, 0.0)
    for _, _, weight, how in hits:
        sums[how] += weight
    shown = (sums["used"] + MISSPELLED * sums["misspelled"], sums["mentioned"], sums["misspelled"])
    return [float(np.log1p(x)) for x in shown] + [1.0]


#: What the fit is drawn to where there is little evidence: a term used tells much, a mention little, and a
#: misspelling nothing beyond its share in the first.
PRIOR = np.array([2.0, 0.3, 0.0, -2.5])


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, hits) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.weights, signals(hits)))))


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps, with a normal prior around PRIOR."""
    w = PRIOR.copy()
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - strength * (w - PRIOR)
        bend = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w = w + move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-8:
            break
    return w


def chosen(found: list[tuple[str, bool, float, int, float]]) -> list[tuple[str, bool, float, bool]]:
    """Of significant (term, is it a stem, weight, documents, certainty): (term, stem, weight, match misspelled).

    A stem enters if it stands for much more than its most frequent word; of nested stems with nearly the
    same documents the longest does. All words enter, those that begin with an entered stem too, and are
    matched with edits.
    """
    words = {t: n for t, stem, _, n, _ in found if not stem}
    most: dict[str, int] = {}
    for t, n in words.items():
        for k in STEMS:
            most[t[:k]] = max(most.get(t[:k], 0), n)
    stems: dict[str, int] = {}
    for t, stem, _, n, _ in sorted(found, key=lambda e: (-len(e[0]), e[0])):
        if stem and n >= 2 * most.get(t, 0):
            inner = [s for s in stems if s.startswith(t)]
            if not any(stems[s] >= 0.9 * n for s in inner):
                for s in inner:
                    del stems[s]
                stems[t] = n
    return [(t, stem, w, not stem) for t, stem, w, _, _ in found if not stem or t in stems]


#: Permutations under which copies are told: near copies differ in all of their smallest hashes once in some 600 times.
LIKENESSES = 4
_TURNS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _likeness():
    """The smallest hashes of five words in a row, each under another permutation: near copies share most of them."""

    def work(texts):
        grams = [gram_set(t, 5) for t in texts]
        return [[((g[None, :] * _TURNS[:, None]).min(1).view(np.int64).tolist() if len(g) else [0] * LIKENESSES) for g in grams]]

    return work


def _one_of_each(labelled: DataFrame) -> DataFrame:
    """Rows (at) without those that share a smallest hash with another one: under one permutation after the other, of
    the rows of one hash the first by id stays. Hashes and ids alone are shuffled."""
    left = labelled.select("at", "own_id", "y", "like")
    for k in range(LIKENESSES):
        kept = F.min_by(F.struct("at", "own_id", "y", "like"), F.struct("own_id", "y", "at")).alias("r")
        left = left.groupBy(F.col("like")[k].alias("h")).agg(kept).select("r.*")
    return left.select("at")


def _terms(label_at: int):
    schema = StructType([StructField("term", StringType()), StructField("stem", LongType()), StructField("pos", LongType()), StructField("neg", LongType())])
    arrow = to_arrow_schema(schema)

    def batch_of(held: dict):
        keys = list(held)
        cols = [[k[1:] for k in keys], [int(k[0] == "~") for k in keys], [held[k][1] for k in keys], [held[k][0] for k in keys]]
        return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(cols)], schema=arrow)

    def run(batches):
        held: dict[str, list[int]] = {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(label_at).to_pylist(), strict=True):
                own = set(_WORD.findall(t.lower()))
                keys = {"=" + w for w in own}
                for n in STEMS:
                    keys |= {"~" + w[:n] for w in own if len(w) > n}
                for k in keys:
                    held.setdefault(k, [0, 0])[y] += 1
                if len(held) > 200_000:
                    yield batch_of(held)
                    held = {}
        yield batch_of(held)

    return run, schema


def _neighbourhoods(sample: DataFrame, terms: set[tuple[str, int]]) -> DataFrame:
    """(term, stem, places): how many pairs of words before and after each term has in the toxic texts of the sample."""
    held = sample.sparkSession.sparkContext.broadcast(terms)
    schema = StructType([StructField("term", StringType()), StructField("stem", LongType()), StructField("around", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        words, stems = {t for t, s in held.value if not s}, {t for t, s in held.value if s}
        for batch in batches:
            out = set()
            for t in batch.column(0).to_pylist():
                own = ["", *_WORD.findall(t.lower()), ""]
                for a, w, b in zip(own, own[1:], own[2:], strict=False):
                    keys = ([(w, 0)] if w in words else []) + [(w[:n], 1) for n in STEMS if len(w) > n and w[:n] in stems]
                    if keys:
                        around = xxhash.xxh3_64_intdigest(f"{a} {b}") - (1 << 63)
                        out.update((*k, around) for k in keys)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return sample.where("y = 1").select("text").mapInArrow(run, schema).groupBy("term", "stem").agg(F.countDistinct("around").alias("places"))


def train(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """A lexicon and the weights of its signals from labelled documents.

    Labels of 0 and 1 with an id count, the larger one where an id has several. About MAX_LABELLED ids are
    picked by their hash, and broadcast for that bound to fetch their texts. Of texts that share a
    smallest hash of five words (see LIKENESSES) one stays, so that copies don't count a term again and again. Terms are counted by
    documents, with partial sums; a term enters if its log odds less two standard errors reach LEAST_WEIGHT and
    chance doesn't explain it (BY_CHANCE), neither by its texts nor by the words it stands between; the sample
    bounds their number.
    What looks like a misspelling but stands in a clean text is an ordinary word. Words around terms that stand
    in toxic texts far more often than in clean ones, or the other way, tell use from mention. The driver
    gets such words and three numbers for each text of the sample with terms. Without labels or texts the lexicon
    is empty and the score is the prior's.
    """
    known = labels.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(label)).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    picked = known.where(F.pmod(F.xxhash64(key_text(F.col("id")), F.lit(8)), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, MAX_LABELLED / max(1, n))))
    own = documents.select(F.col(quoted(doc_id)).alias("own_id"), F.col(quoted(text)).alias("text")).where("text is not null")
    labelled = map_text(own.join(F.broadcast(picked), F.col("own_id") == F.col("id")), "text", ["text", "y", "own_id"], [StructField("like", ArrayType(LongType()))], _likeness)
    labelled = cut(labelled.withColumn("at", F.monotonically_increasing_id()), "toxic-labelled")
    sample = cut(labelled.join(_one_of_each(labelled), "at", "left_semi").select("text", "y"), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Model(Lexicon(), PRIOR)
    run, schema = _terms(1)
    counts = sample.mapInArrow(run, schema).groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    weight = F.log(a / (n_pos + 1)) - F.log(b / (n_neg + 1))
    sure = weight - 2 * F.sqrt(1 / a + 1 / b)
    counts = cut(counts, "toxic-terms")
    # toxic texts may be longer than others: chance gives a term as many of them as there are words in them
    of_all = counts.agg(F.sum("pos").alias("pos"), F.sum(F.col("pos") + F.col("neg")).alias("all"), F.count_if(F.col("pos") >= LEAST_TEXTS).alias("n")).first()
    candidates, base = of_all["n"], of_all["pos"] / of_all["all"] if of_all["all"] else 0.5
    counts = counts.where(F.col("pos") >= LEAST_TEXTS)
    # how unlikely so many toxic ones among the texts with a term are by chance, as a bound, against so many terms looked at
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    apart = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    told = (F.col("pos") + F.col("neg")) * apart >= float(np.log(max(1, candidates) / BY_CHANCE))
    best = counts.withColumn("weight", weight).withColumn("sure", sure).where((F.col("sure") >= LEAST_WEIGHT) & told)
    best = cut(best, "toxic-best")
    # the same for the different neighbourhoods of a term in place of its texts: a passage of many texts has one
    seen = _neighbourhoods(sample, {(r["term"], r["stem"]) for r in best.select("term", "stem").collect()})
    told = F.least("pos", "places") * float(-np.log(base)) >= float(np.log(max(1, candidates) / BY_CHANCE))
    rows = best.join(seen, ["term", "stem"]).where(told).orderBy(F.desc("sure"), "term", "stem").collect()
    lexicon = Lexicon(chosen([(r["term"], bool(r["stem"]), float(r["weight"]), r["pos"], r["sure"]) for r in rows]))
    held = sample.sparkSession.sparkContext.broadcast(lexicon)

    def factory():
        words = Words(held.value)

        def work(texts):
            found = [finds(t.decode("utf-8", "replace"), words) for t in texts]
            return [[[{"exact": e, "near": n, "word": w, "quoted": q, "around": around} for _, _, e, n, w, q, around in f] for f in found]]

        return work

    kind = ArrayType(StructType([StructField("exact", DoubleType()), StructField("near", DoubleType()), StructField("word", StringType()), StructField("quoted", BooleanType()), StructField("around", ArrayType(StringType()))]))
    met = map_text(sample, "text", ["y"], [StructField("hits", kind)], factory).where(F.size("hits") > 0)
    met = cut(met.withColumn("at", F.monotonically_increasing_id()), "toxic-hits")
    each = met.select("at", "y", F.explode("hits").alias("h"))
    lexicon.ordinary = {r["w"] for r in each.where("y = 0 and h.near > 0").select(F.col("h.word").alias("w")).distinct().collect()}
    lexicon.context = _context(each.where("h.near = 0"))
    held = sample.sparkSession.sparkContext.broadcast(lexicon)
    x, y = _signals(met, held)
    rest = [(k, n - int((y == k).sum())) for k, n in ((1, n_pos), (0, n_neg))]
    x = np.concatenate([x, *(np.tile(signals([]), (n, 1)) for _, n in rest)])
    return Model(lexicon, fit(x, np.concatenate([y, *(np.full(n, k, float) for k, n in rest)])))


def _context(each: DataFrame) -> dict[str, float]:
    """Weights of the words around terms, from the texts (at, y) with terms h that hold them; the sample bounds them."""
    texts = {r["y"]: r["n"] for r in each.groupBy("y").agg(F.countDistinct("at").alias("n")).collect()}
    if len(texts) < 2:
        return {}
    near = each.select("at", "y", F.explode("h.around").alias("w")).distinct().groupBy("w").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(a / (texts[1] + 1)) - F.log(b / (texts[0] + 1))
    told = cut(near.withColumn("odds", odds), "toxic-context")
    # odds that chance doesn't explain, among so many words
    least = float(np.sqrt(2 * np.log(max(1, told.count()) / BY_CHANCE)))
    told = told.where(F.abs("odds") - least * F.sqrt(1 / a + 1 / b) >= LEAST_CONTEXT)
    return {r["w"]: float(r["odds"]) for r in told.select("w", "odds").collect()}


def _signals(met: DataFrame, held) -> tuple[np.ndarray, np.ndarray]:
    """What the classifier sees of the sample's texts with terms, three numbers a text, and their labels."""
    schema = StructType([StructField("x", ArrayType(DoubleType())), StructField("y", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        lexicon = held.value
        for batch in batches:
            rows = [
                signals([(0, 0, h["exact"] or h["near"], how(lexicon, h["near"], h["quoted"], h["around"])) for h in hits if not (h["near"] and h["word"] in lexicon.ordinary)])
                for hits in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([pa.array(rows, arrow.field(0).type), batch.column(0).cast(pa.int64())], schema=arrow)

    rows = met.select("y", "hits").mapInArrow(run, schema).collect()
    return np.array([r["x"] for r in rows], float).reshape(-1, len(PRIOR)), np.array([r["y"] for r in rows], float)


_HIT = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("weight", DoubleType()), StructField("how", StringType())]))
FIELDS = [StructField("tox_score", DoubleType()), StructField("tox_hits", _HIT)]


def score(documents: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, the chance that the text is toxic, and the terms found with places and how they stand.

    Null and empty texts have no terms and get the score of such a text. Rows stay one for one. A kept column
    called as one of these is replaced.
    """
    keep = [c for c in keep if c.lower() not in {f.name for f in FIELDS}]
    held = documents.sparkSession.sparkContext.broadcast(model)

    def factory():
        words = Words(held.value.lexicon)
        plain = held.value.score([])

        def work(texts):
            found = [hits_of(t.decode("utf-8", "replace"), words) if t else [] for t in texts]
            return [[held.value.score(h) if h else plain for h in found], [[{"start": a, "end": b, "weight": w, "how": how} for a, b, w, how in h] for h in found]]

        return work

    return map_text(documents, text, keep, FIELDS, factory)


def held_out(doc_id: str = "doc_id"):
    """Ids whose labels are not learned from: crc32 of the id as text modulo 5 is 0."""
    return crc_mod(F.col(quoted(doc_id)), 5) == 0


def model_of(documents: DataFrame, labels: DataFrame) -> Model:
    return train(documents, labels.where(~held_out()))


def contract(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document for op8."""
    out = score(documents, model_of(documents, labels), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.size("tox_hits").alias("n_terms"))


def drop_toxic(documents: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the model of their own labels (held-out ids aside) does not call toxic, unchanged."""
    names = documents.columns
    plain = [f"c{i}" for i in range(len(names))]
    out = score(documents.toDF(*plain), model_of(documents, labels), plain, plain[names.index(text)])
    return out.where("tox_score < 0.5").select(*plain).toDF(*names)
