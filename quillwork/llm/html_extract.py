"""HTML extraction with site template removal: subtrees that recur across a host's pages are deleted."""

from __future__ import annotations

import html
import re
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from quillwork.llm._rows import MIX, WordHashes, cut, map_text, quoted

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of these kinds ends where one of the same kind begins in the same list or table.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: The end tag of an inline element doesn't reach out of these.
HOLDERS = frozenset(("article", "main", "body", "td", "li"))
# What is never article text.
CHROME_TAGS = frozenset("head nav footer aside form button select input dialog menu".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe subscription sidebar breadcrumb breadcrumbs menu nav navbar navigation footer comment comments commentlist disqus "
    "replies respond share sharing social related recommended toolbar skip pagination pager".split()
)
OUTSIDE_WORDS = frozenset("header masthead banner topbar alert disclaimer widget login signup search announcement legal copyright".split())
#: Words that may stand beside those in one name, such as comment-list; a name with any other word, such as
#: social-policy or related-work, says what the text is about.
FRAME_WORDS = frozenset(
    "a all also area article articles bar bars block body bottom box button buttons by c col column container content desktop entry field fixed "
    "float for form global group has holder icon icons in inner is item items js l label large left like link links list lists m main may message "
    "mobile module more o on outer page panel pane post posts primary read row secondary section see site slot small sticky story the this title "
    "to top u ui unit us widgets wp wrap wrapper you".split()
)
#: Elements of prose: without a class or id of their own, what they say is the article's, however often it is said.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th caption figcaption summary".split())
#: An id names the element itself for these; on headings and paragraphs it is an anchor of the text.
NAMED_BY_ID = frozenset("div section aside ul ol dl table span".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "depth", "holds")

    def __init__(self, tag: str, attributes: dict | None, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        #: is there an article or main element below it?
        self.holds = False


class Open:
    """The open elements by kind, so that an element to close is found without walking up the tree."""

    def __init__(self, root: Node):
        self.root = self.now = root
        self.by_tag: dict[str, list[Node]] = {}
        self.blocks: list[Node] = []

    def nearest(self, tags) -> Node | None:
        tops = [self.by_tag[t][-1] for t in tags if self.by_tag.get(t)]
        return max(tops, key=lambda n: n.depth) if tops else None

    def push(self, node: Node) -> None:
        self.by_tag.setdefault(node.tag, []).append(node)
        if node.tag in BLOCK:
            self.blocks.append(node)
        self.now = node

    def close(self, node: Node) -> None:
        """Ends the element and all that are open inside it."""
        while True:
            last = self.now
            self.by_tag[last.tag].pop()
            if last.tag in BLOCK:
                self.blocks.pop()
            self.now = last.parent
            if last is node:
                return


def tree(page: str) -> Node:
    """The page as a tree of elements and decoded texts; unclosed and misplaced tags are put right.

    Nesting may have any depth: each element is opened and closed once, and nothing walks up.
    """
    root = Node("#root", None, None)
    held, at = Open(root), 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                held.now.children.append(html.unescape(page[at:]))
            return root
        if m.start() > at:
            held.now.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        close, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if held.by_tag.get(tag):
                node, fence = held.by_tag[tag][-1], None if tag in BLOCK else held.nearest(HOLDERS)
                if fence is None or fence.depth < node.depth:
                    held.close(node)
            continue
        if tag in BLOCK and held.blocks and held.blocks[-1].tag == "p":
            held.close(held.blocks[-1])
        if tag in SIBLINGS:
            same, fence = held.nearest(SIBLINGS[tag]), held.nearest(FENCES[tag])
            if same is not None and (fence is None or fence.depth < same.depth):
                held.close(same)
        if tag in ("html", "body") and held.by_tag.get(tag):
            continue
        names = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest.strip() else None
        node = Node(tag, names, held.now)
        held.now.children.append(node)
        if tag in ("article", "main"):
            up = held.now
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
        if tag in RAW and not rest.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
        elif tag not in VOID:
            held.push(node)


def _marked(name: str, words: frozenset) -> bool:
    """Does a class or id say one of the words, and nothing but such words and those of frames?"""
    said = [w.lower() for w in _NAME_WORD.findall(name)]
    return not words.isdisjoint(said) and all(w in CHROME_WORDS or w in OUTSIDE_WORDS or w in FRAME_WORDS for w in said)


def chrome(node: Node, inside: bool) -> bool:
    """Is the element, by its kind or its names, a menu, header, footer, sidebar, notice, advert, form or comment?"""
    tag, names = node.tag, node.attributes
    if tag in RAW or tag in CHROME_TAGS or tag == "header" and not inside:
        return not (tag == "form" and node.holds)  # some sites put the whole page into one form
    if not names or node.holds:
        return False
    if "hidden" in names or names.get("aria-hidden", "").lower() == "true" or names.get("role", "").lower() in CHROME_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    words = CHROME_WORDS if inside else CHROME_WORDS | OUTSIDE_WORDS
    own = names.get("class", "").split() + ([names["id"]] if tag in NAMED_BY_ID and "id" in names else [])
    return any(_marked(name, words) for name in own)


def _outermost(root: Node, kind) -> list[Node]:
    """The elements of a kind outside of chrome that are in no other one, in page order."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if x is not root:
            if kind(x) and not chrome(x, True):
                found.append(x)
                continue
            if chrome(x, x.tag == "article"):
                continue
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]
    return found


def _length(tops: list[Node], besides: set[int]) -> int:
    """Characters of text below the elements, without chrome and without the elements of those ids."""
    total, stack = 0, list(tops)
    while stack:
        x = stack.pop()
        for c in x.children:
            if isinstance(c, str):
                total += len("".join(c.split()))
            elif id(c) not in besides and not chrome(c, True):
                stack.append(c)
    return total


def regions(root: Node) -> list[Node]:
    """Where the article is: the outermost article elements, or main ones if those hold more text outside of
    their articles than in them; the whole page if there is neither."""
    articles = _outermost(root, lambda n: n.tag == "article")
    mains = _outermost(root, lambda n: n.tag == "main" or (n.attributes or {}).get("role") == "main" or (n.attributes or {}).get("itemprop") == "articleBody")
    if articles and mains and _length(mains, {id(a) for a in articles}) > _length(articles, set()):
        return mains
    return articles or mains or [root]


def _least(blocks: list[str], known: WordHashes) -> list[int]:
    """For each block the smallest hash of three words in a row; of all its words, if it has fewer."""
    words = [b.split(" ") for b in blocks]
    sizes = np.array([len(w) for w in words])
    starts = np.concatenate(([0], np.cumsum(sizes + 2)))
    h = np.zeros(starts[-1], np.uint64)
    inside = np.ones(len(h), bool)
    for k in range(2):
        inside[starts[1:] - 1 - k] = False
    h[inside] = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    runs = h * MIX[0]
    for k in (1, 2):
        runs[:-k] += h[k:]
        runs = (runs ^ (runs >> np.uint64(29))) * MIX[k]
    first = np.zeros(len(h), bool)
    first[starts[:-1]] = True
    beyond = np.zeros(len(h), bool)
    for k in range(4):
        beyond[np.maximum(starts[1:] - 1 - k, starts[:-1])] = True
    runs[beyond & ~first] = np.iinfo(np.uint64).max
    return np.minimum.reduceat(runs, starts[:-1]).tolist()


class Subtree(NamedTuple):
    """A block element below an article, main or page root, plain paragraphs and the like aside: hash of its kinds, names
    and texts, and the blocks of text it holds, [start, end)."""

    hash: int
    start: int
    end: int


class Page(NamedTuple):
    #: texts of the blocks in page order, without chrome
    blocks: list[str]
    subtrees: list[Subtree]
    #: does it have an article or main element?
    framed: bool


def read(page: str) -> Page:
    """The main text of a page in blocks, and the block elements that hold it, from the inside out."""
    root = tree(page)
    within = regions(root)
    blocks: list[str] = []
    found: list[Subtree] = []
    pending: list[str] = []

    def flush():
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            blocks.append(text)

    for top in within:
        inside = top is not root
        said: list[list[str]] = []  # for each open element its kind, class, and what is in it
        stack: list = [(top, -1)]
        while stack:
            x, start = stack.pop()
            if isinstance(x, str):
                pending.append(x)
                said[-1].append(" ".join(x.split()))
            elif start >= 0:
                if x.tag in BLOCK:
                    flush()
                body = xxhash.xxh3_64_intdigest("\x00".join(said.pop()).encode("utf-8", "surrogatepass"))
                if said:
                    said[-1].append(f"{body:x}")
                plain = x.tag in PROSE and not (x.attributes and ("class" in x.attributes or "id" in x.attributes))
                if x is not top and x.tag in BLOCK and not plain and x.tag not in ("html", "body", "main", "article") and len(blocks) > start:
                    found.append(Subtree(body - (1 << 63), start, len(blocks)))
            elif x.tag in ("br", "wbr"):
                pending.append(" " if x.tag == "br" else "")
            elif x is not top and chrome(x, inside):
                said[-1].append("#")
                if x.tag in BLOCK:
                    flush()
            else:
                if x.tag in BLOCK:
                    flush()
                said.append([x.tag, (x.attributes or {}).get("class", "")])
                stack.append((x, len(blocks)))
                stack += [(c, -1) for c in reversed(x.children)]
        flush()
    return Page(blocks, found, within != [root])


def others(found: list[Subtree], blocks: list[str], known: WordHashes) -> list[int | None]:
    """For each subtree the smallest hash of three words in a row of the blocks outside of it, which near copies
    mostly share; None where nothing is outside."""
    least = _least(blocks, known) if found else []
    before, after = [None], [None]
    for h in least:
        before.append(h if before[-1] is None else min(before[-1], h))
    for h in reversed(least):
        after.append(h if after[-1] is None else min(after[-1], h))
    after.reverse()
    both = ([h for h in (before[f.start], after[f.end]) if h is not None] for f in found)
    return [min(h) - (1 << 63) if h else None for h in both]


def without(page: Page, gone: set[int]) -> list[str]:
    """The blocks without the subtrees of those hashes; all blocks if they hold most of an article's text, as in
    copies of it."""
    turns = [0] * (len(page.blocks) + 1)
    for f in page.subtrees:
        if f.hash in gone:
            turns[f.start] += 1
            turns[f.end] -= 1
    kept = [b for b, over in zip(page.blocks, accumulate(turns), strict=False) if not over]
    if page.framed and 2 * sum(map(len, kept)) < sum(map(len, page.blocks)):
        return page.blocks
    return kept


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


#: A subtree recurs in copies, not in a template, if its pages have more than so many texts for each kind of other text.
COPIES = 4
#: Shorter subtrees recur by chance ever more often as a host grows, so that a share of its pages counts for them.
LONG = 40


def _key(host: Column, body: Column) -> Column:
    """What equal pages of a host have in common."""
    return F.unhex(F.md5(F.concat(host.cast("binary"), F.lit(b"\x00"), body.cast("binary"))))


def templates(own: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(host, key, hashes) of the pages (host, key, body) that hold subtrees which recur on their host.

    A subtree recurs if its pages have min_pages kinds of other text or more, and at most COPIES pages for
    each kind: equal pages count once, near copies mostly as one kind (see others). Subtrees of under LONG
    characters must also be on a share min_share of the host's pages. Hashes are counted by host with
    partial sums, so a hot host costs one row for each hash and task, and no list is held for a host: the
    hashes that recur are joined to the pages that hold them, by (host, hash).
    """

    def factory():
        known = WordHashes()

        def work(texts):
            found = []
            for t in texts:
                page = read(t.decode("utf-8", "replace")) if t else Page([], [], False)
                sizes = [0]
                for b in page.blocks:
                    sizes.append(sizes[-1] + len(b))
                held = {(f.hash, o): sizes[f.end] - sizes[f.start] >= LONG for f, o in zip(page.subtrees, others(page.subtrees, page.blocks, known), strict=True) if o is not None}
                found.append([{"hash": h, "other": o, "long": y} for (h, o), y in held.items()])
            return [found]

        return work

    kind = ArrayType(StructType([StructField("hash", LongType()), StructField("other", LongType()), StructField("long", BooleanType())]))
    seen = cut(map_text(own, "body", ["host", "key"], [StructField("found", kind)], factory), "html-subtrees")
    per_host = seen.groupBy("host", "key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = seen.select("host", "key", F.inline("found")).groupBy("host", "hash", "key").agg(F.min("other").alias("other"), F.max("long").alias("long"))
    each = cut(each, "html-each")
    kinds = each.groupBy("host", "hash", "other").agg(F.count(F.lit(1)).alias("n"), F.max("long").alias("long"))
    counts = kinds.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.max("long").alias("long"))
    recur = counts.where((F.col("kinds") >= min_pages) & (F.col("n") <= COPIES * F.col("kinds"))).join(per_host, "host")
    often = recur.where(F.col("long") | (F.col("n") >= F.lit(min_share) * F.col("pages"))).select("host", "hash")
    return cut(each.join(often, ["host", "hash"]).groupBy("host", "key").agg(F.collect_set("hash").alias("hashes")), "html-templates")


def extract(pages: DataFrame, keep: list[str], body: str = "html", url: str = "url", min_pages: int = 5, min_share: float = 0.05) -> DataFrame:
    """Columns `keep` and he_text: the main text of each page.

    Subtrees that recur across the host's pages go, inside the article too unless they are most of it, and
    what its kind or names mark as menu, header, footer, sidebar, notice, advert, form, script or comment.
    Texts of one block are joined, white space becomes one space, blocks are joined by one newline. A null
    or empty page has the empty text; a null url is host ''. Pages stay one for one, repeated ones too. Other
    columns of `pages` may have any names; a kept column called he_text is replaced.
    """
    keep = [c for c in keep if c.lower() != "he_text"]
    held = [f"c{i}" for i in range(len(keep))]
    own = pages.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keep, held, strict=True)], host_of(F.col(quoted(url))).alias("host"), F.col(quoted(body)).alias("body"))
    own = own.withColumn("key", _key(F.col("host"), F.coalesce(F.col("body"), F.lit(""))))
    gone = templates(own.select("host", "key", "body"), min_pages, min_share)

    def factory():
        def work(texts, gone):
            out = []
            for t, hashes in zip(texts, gone, strict=True):
                page = read(t.decode("utf-8", "replace")) if t else None
                out.append("\n".join(without(page, set(hashes)) if hashes else page.blocks) if page else "")
            return [out]

        return work

    out = map_text(own.join(gone, ["host", "key"], "left"), "body", held, [StructField("he_text", StringType())], factory, extra=("hashes",))
    return out.toDF(*keep, "he_text")


def contract(pages: DataFrame) -> DataFrame:
    """One row per page for op1."""
    out = extract(pages, ["page_id", "url"])
    return out.select("page_id", "url", F.col("he_text").alias("text"), F.char_length("he_text").cast("long").alias("n_chars"))
