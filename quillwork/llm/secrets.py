"""Secret scans that unwrap nested encodings: a worklist of layers, each scanned, with spans of the original."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quillwork.llm._rows import map_text

# The base patterns, in their order.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|([abtnvfr0'\"\\/]))")
#: The same through any number of codings of the sign itself, for texts that are coded again and again.
_PERCENTS = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_ESCAPES = re.compile(r"\\(?:u005[Cc]|x5[Cc])*(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|([abtnvfr0'\"\\/]))")
AGAIN = 3
_SHORTS = dict(zip("abtnvfr0'\"\\/", "\a\b\t\n\v\f\r\0'\"\\/", strict=True))
#: The shortest secret has 14 letters (token= and 8 more), which 18 letters of base64 cannot hold.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+)(={0,2})(?![A-Za-z0-9+/_=-])")
_URL_SAFE = str.maketrans("-_", "+/")
_MAGIC = re.compile(r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_WIDE = re.compile(r"[\x20-\x7e](?:\x00[\x20-\x7e]){13,}")
#: Decoded bytes without any of these hold no secret and nothing encoded that could hold one.
_WORTH = re.compile(
    rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\|[A-Za-z0-9+/_-]{16}|\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd"
    rb"|[\x20-\x7e](?:\x00[\x20-\x7e]){13}"
)

#: A compressed body is unpacked and scanned in pieces of this size, which begin OVERLAP before the last one ends.
PIECE, OVERLAP = 16 << 20, 1 << 20


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind, as (start, end, kind)."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


class Layer(NamedTuple):
    """A text to scan. Decoded bytes are Latin-1 text, one character a byte, which the patterns, all ASCII, read alike.

    `starts` and `ends` tell for each character what part of the original it comes from (None: itself);
    with `run`, all characters come from that part. Layers of one `whole` are the same text with escapes
    decoded in place.
    """

    path: str
    text: str
    starts: np.ndarray | None
    ends: np.ndarray | None
    run: tuple[int, int] | None
    whole: int

    def at(self, a: int, b: int) -> tuple[int, int]:
        if self.run:
            return self.run
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))

    def mark(self) -> bytes:
        """What tells layers apart: the text, and where it comes from."""
        h = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        h.update(f"{self.at(0, len(self.text)) if self.text else self.run}".encode())
        return h.digest()

    def inner(self, coding: str, text: str, starts: np.ndarray, ends: np.ndarray, whole: int) -> Layer:
        """A layer made of this one, from places in its text."""
        path = f"{self.path}>{coding}" if self.path else coding
        if self.run:
            return Layer(path, text, None, None, self.run, whole)
        if self.starts is not None:
            starts, ends = self.starts[starts], self.ends[ends - 1]
        return Layer(path, text, starts, ends, None, whole)


def _in_place(layer: Layer, coding: str, units: re.Pattern, decode) -> Layer:
    """The layer with each match of units replaced by one character."""
    text, parts, starts, ends, at = layer.text, [], [], [], 0
    for m in units.finditer(text):
        a, b = m.span()
        parts += (text[at:a], decode(m))
        starts += (np.arange(at, a + 1),)
        ends += (np.arange(at + 1, a + 1), np.array([b]))
        at = b
    parts.append(text[at:])
    starts.append(np.arange(at, len(text)))
    ends.append(np.arange(at + 1, len(text) + 1))
    return layer.inner(coding, "".join(parts), np.concatenate(starts), np.concatenate(ends), layer.whole)


def _unescaped(m: re.Match) -> str:
    return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SHORTS[m[3]]


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """(letters, places) of each run of base64: with the lines after it that carry it on, if it ends a line. Full
    lines are equally long, and a shorter or padded one is the last."""
    done = 0
    for m in _BASE64.finditer(text):
        if m.start() < done:
            continue
        spans, at, full = [m.span()], m.end(), 0
        while line := _NEXT_LINE.match(text, at):
            size = len(line[1])
            if size > (full or max(len(m[0]), 76)):
                break
            full = full or size
            spans.append(line.span(1))
            at = line.end()
            if line[2] or size < max(full, 16):
                break
        done = spans[-1][1]
        yield "".join(text[a:b] for a, b in spans), np.concatenate([np.arange(a, b) for a, b in spans])


def _of_base64(layer: Layer, whole: Iterator[int]) -> Iterator[Layer]:
    """What runs of base64 say. Letters before the beginning, such as those of a path, only move it: reading from
    each of the first four letters meets every beginning, and what isn't base64 gives bytes that say nothing."""
    for letters, places in _runs(layer.text):
        plain = letters.translate(_URL_SAFE)
        for first in range(min(4, len(plain) - 15)):
            size = len(plain) - first
            body = base64.b64decode(plain[first:] + ("=" * (-size % 4) if size % 4 != 1 else "A=="))
            if not _WORTH.search(body):
                continue
            bits = np.arange(len(body)) * 8
            ends = np.minimum(first + (bits + 7) // 6, len(places) - 1)
            yield layer.inner("base64", body.decode("latin-1"), places[first + bits // 6], places[ends] + 1, next(whole))


def _decoder(head: bytes):
    if head[:2] == b"\x1f\x8b" or head[:1] == b"x":
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:1] == b"\xfd":
        return lzma.LZMADecompressor()
    return zstandard.ZstdDecompressor().decompressobj()


def _unpacked(source: Iterator[bytes]) -> Iterator[tuple[bytes, int]]:
    """(bytes, input bytes read so far) of a compressed body and of those that follow it at once; what comes before
    an error counts."""
    rest, read, d = b"", 0, None
    try:
        for chunk in source:
            rest += chunk
            while rest:
                if d is None:
                    if read and not _MAGIC.match(rest[:6].decode("latin-1")):
                        return
                    d = _decoder(rest)
                zstd = not isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor, type(zlib.decompressobj())))
                part = rest[: 512 if zstd else 1 << 16]
                out = d.decompress(part) if zstd else d.decompress(part, PIECE)
                used = len(part) - len(d.unused_data) - (len(d.unconsumed_tail) if hasattr(d, "unconsumed_tail") else 0)
                rest, read = rest[used:], read + used
                if out:
                    yield out, read
                while not d.eof and not getattr(d, "needs_input", True):
                    yield d.decompress(b"", PIECE), read
                if d.eof:
                    d = None
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        return


def _pieces(source: Callable[[], Iterator[bytes]]) -> Iterator[tuple[bytes, int]]:
    """The unpacked body in pieces of PIECE bytes that overlap."""
    held, read, new = bytearray(), 0, False
    for out, read in _unpacked(source()):
        held += out
        new = True
        while len(held) > PIECE:
            yield bytes(held[:PIECE]), read
            del held[: PIECE - OVERLAP]
            new = len(held) > OVERLAP
    if new:
        yield bytes(held), read


def _of_packed(layer: Layer, raw: Callable[[], Iterator[bytes]] | None, whole: Iterator[int]) -> Iterator[tuple[Layer, Callable | None]]:
    """What compressed bodies hold, wherever in the layer they begin. raw gives all bytes of which the layer is a piece."""
    body, past = None, 0
    for m in _MAGIC.finditer(layer.text):
        if m.start() < past:
            continue
        if body is None:
            body = memoryview(layer.text.encode("latin-1", "replace"))
        at = m.start()

        def rest(at=at, body=body) -> Iterator[bytes]:
            return (bytes(body[k : k + (1 << 16)]) for k in range(at, len(body), 1 << 16))

        def longer(at=at) -> Iterator[bytes]:
            skip = at
            for chunk in raw():
                yield chunk[skip:]
                skip = max(0, skip - len(chunk))

        source = longer if raw else rest
        read = None
        for piece, used in _pieces(source):
            if read is None:
                read = used if len(piece) < PIECE else max((u for _, u in _unpacked(source())), default=used)
                if layer.run is None:
                    past = at + read
            name = f"{layer.path}>packed" if layer.path else "packed"
            run = layer.run or layer.at(at, min(at + read, len(layer.text)))
            if _WORTH.search(piece):
                yield Layer(name, piece.decode("latin-1"), None, None, run, next(whole)), lambda source=source: (x for x, _ in _unpacked(source()))


def _of_wide(layer: Layer, whole: Iterator[int]) -> Iterator[Layer]:
    """UTF-16 in decoded bytes, of either order."""
    for m in _WIDE.finditer(layer.text):
        at = np.arange(m.start(), m.end(), 2)
        yield layer.inner("utf16", m[0][::2], at, at + 1, next(whole))


def layers(layer: Layer, raw: Callable[[], Iterator[bytes]] | None, whole: Iterator[int]) -> Iterator[tuple[Layer, Callable | None]]:
    """What is encoded in a layer."""
    text = layer.text
    yield from ((x, None) for x in _of_base64(layer, whole))
    yield from _of_packed(layer, raw, whole)
    if layer.path and "\x00" in text:
        yield from ((x, None) for x in _of_wide(layer, whole))
    if "%" in text and _PERCENT.search(text):
        yield _in_place(layer, "url", _PERCENTS if layer.path.count("url") >= AGAIN else _PERCENT, lambda m: chr(int(m[1], 16))), None
    if "\\" in text and _ESCAPE.search(text):
        yield _in_place(layer, "unicode", _ESCAPES if layer.path.count("unicode") >= AGAIN else _ESCAPE, _unescaped), None


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int]:
    """Base spans; further spans found under encodings; layers read.

    A worklist starts with the text. Each layer is scanned, and all that is encoded in it gives further
    layers, until none is left: every coding is looked for in every layer. URL and Unicode escapes are
    decoded where they stand, so what surrounds them counts; what a layer shares with the one it is made of
    is not told again. A layer that was read before is not read again, which ends cycles. The worklist is
    a stack, so only the layers above the one in hand are in memory, and a compressed body is read in pieces of
    bounded size, whatever it unpacks to. Spans are carried back to the original text: through escapes,
    base64 and UTF-16 letter by letter, through compression to the compressed body. Kinds of further spans
    name the path, as in base64>assign.
    """
    base = base_spans(text)
    known, more, n = set(base), [], 0
    told = {(0, *s) for s in base}
    seen: set[bytes] = set()
    whole = iter(range(1, 1 << 62))
    stack = [layers(Layer("", text, None, None, None, 0), None, whole)]
    while stack:
        layer, raw = next(stack[-1], (None, None))
        if layer is None:
            stack.pop()
            continue
        mark = layer.mark()
        if mark in seen:
            continue
        seen.add(mark)
        n += 1
        for a, b, kind in base_spans(layer.text):
            at = layer.at(a, b)
            if (layer.whole, *at, kind) in told:
                continue
            told.add((layer.whole, *at, kind))
            if (*at, kind) not in known and (*at, f"{layer.path}>{kind}") not in known:
                known.add((*at, f"{layer.path}>{kind}"))
                more.append((*at, f"{layer.path}>{kind}"))
        stack.append(layers(layer, raw, whole))
    return base, more, n


def _joined(spans: list[tuple[int, int, str]]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], rank.get(s[2], len(rank)), s[2], s[1])))


_SPAN = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))
FIELDS = [
    StructField("sec_n_assign", LongType()),
    StructField("sec_n_access", LongType()),
    StructField("sec_n_hex", LongType()),
    StructField("sec_base", StringType()),
    StructField("sec_spans", StringType()),
    StructField("sec_found", _SPAN),
    StructField("sec_layers", LongType()),
]


def find(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` and FIELDS: the secrets of each text, null and empty texts having none.

    Every text is scanned whole by itself, so no row depends on another; repeated rows give equal results.
    """

    def work(texts):
        cols: list[list] = [[] for _ in FIELDS]
        for t in texts:
            base, more, n = scan(t.decode("utf-8", "replace")) if t else ([], [], 0)
            found = [{"kind": k, "start": a, "end": b} for a, b, k in sorted(base + more)]
            row = (*(sum(k == kind for _, _, k in base) for kind in KINDS), _joined(base), _joined(base + more), found, n)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        return cols

    keep = [c for c in keep if c.lower() not in {f.name for f in FIELDS}]  # results replace columns of their names
    return map_text(documents, text, keep, FIELDS, lambda: work)


def contract(documents: DataFrame) -> DataFrame:
    """One row per document for op6."""
    out = find(documents, ["doc_id"])
    return out.select(
        "doc_id",
        F.col("sec_n_assign").alias("n_assign"),
        F.col("sec_n_access").alias("n_access"),
        F.col("sec_n_hex").alias("n_hex"),
        F.sha2(F.col("sec_base").cast("binary"), 256).alias("base_sha256"),
        F.col("sec_spans").alias("spans"),
    )
