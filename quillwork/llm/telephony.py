"""Telephony audio columns: mu-law, A-law and IMA ADPCM to resampled PCM, with numpy over whole batches."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField

from quillwork.llm._rows import map_text

# Format codes of RIFF audio, and the step sizes and step moves of IMA ADPCM.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
     494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
     10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw() -> np.ndarray:
    """16-bit value of every mu-law byte: sign, 3 bits of exponent, 4 of mantissa, all inverted; bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    """16-bit value of every A-law byte: even bits inverted, the lowest segment linear."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, segment = (code & 15) << 4, code >> 4 & 7
    size = np.where(segment == 0, part + 8, (part + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw(), _alaw()


def ima_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks: (n, size) bytes to (n, 1 + 2 * (size - 4)) values.

    A block begins with its first sample and step index; each further nibble moves the sample by a
    multiple of the step. The steps of one block depend on each other, those of different blocks don't:
    each nibble position is one numpy operation over all blocks.
    """
    n, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((n, 1 + 2 * (size - 4)), np.int16)
    out[:, 0] = value
    # columns beside each other in memory make the loop below read and write runs
    nibbles = np.ascontiguousarray(blocks[:, 4:].T)
    made = np.empty((2 * (size - 4), n), np.int16)
    for k in range(size - 4):
        for half, code in enumerate((nibbles[k] & 15, nibbles[k] >> 4)):
            code = code.astype(np.int32)
            step = STEPS[index]
            delta = step >> 3
            delta += np.where(code & 4, step, 0)
            delta += np.where(code & 2, step >> 1, 0)
            delta += np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + MOVES[code], 0, 88)
            made[2 * k + half] = value
    out[:, 1:] = made.T
    return out


def _taps(up: int, down: int, half: int = 4) -> np.ndarray:
    """For each of `up` phases, 2 * half taps of a windowed sinc, in units of 2**-14 that sum to one."""
    cut = min(1.0, up / down)
    phase = np.arange(up)[:, None] / up
    at = np.arange(1 - half, half + 1)[None, :] - phase
    taps = np.sinc(at * cut) * (0.5 + 0.5 * np.cos(np.pi * at / (half + 1)))
    whole = np.rint(taps / taps.sum(1, keepdims=True) * 16384).astype(np.int64)
    whole[:, half - 1] += 16384 - whole.sum(1)
    return whole


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate by a polyphase filter in whole numbers, so that equal input gives equal
    output on any machine and in any batch. Samples beyond the ends repeat the end's."""
    if rate == to or not len(pcm):
        return pcm
    common = int(np.gcd(rate, to))
    up, down = to // common, rate // common
    taps = _taps(up, down)
    half = taps.shape[1] // 2
    x = np.pad(pcm.astype(np.int32), (half - 1, half), mode="edge")
    n = -(-len(pcm) * up // down)
    at = np.arange(n, dtype=np.int64) * down
    out = np.empty(n, np.int64)
    for p in range(up):
        own = np.flatnonzero(at % up == p) if down > 1 else np.arange(p, n, up)
        base = at[own] // up
        out[own] = sum(int(t) * x[base + k] for k, t in enumerate(taps[p]) if t) if down > 1 else _phase(x, taps[p], len(own))
    return np.clip((out + 8192) >> 14, -32768, 32767).astype(np.int16)


def _phase(x: np.ndarray, taps: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n, np.int32)
    for k, t in enumerate(taps.tolist()):
        if t:
            total += t * x[k : k + n]
    return total


def to_wav(body: bytes, kind: int, rate: int = 8000, block: int = 1) -> bytes:
    """A mono RIFF file around encoded bytes; block is the bytes of one unit (ADPCM: of one block)."""
    bits, extra, samples, per_second = 8, b"\0\0", len(body), rate * block
    if kind == PCM:
        bits, extra, samples, block = 16, b"", len(body) // 2, 2
        per_second = rate * block
    elif kind == IMA:
        each = 2 * (block - 4) + 1
        bits, extra, samples, per_second = 4, struct.pack("<HH", 2, each), len(body) // block * each, rate * block // each
    head = struct.pack("<HHIIHH", kind, 1, rate, per_second, block, bits) + extra
    chunks = [(b"fmt ", head), *([(b"fact", struct.pack("<I", samples))] if kind != PCM else []), (b"data", body)]
    inner = b"".join(n + struct.pack("<I", len(c)) + c + b"\0" * (len(c) % 2) for n, c in chunks)
    return b"RIFF" + struct.pack("<I", len(inner) + 4) + b"WAVE" + inner


def from_wav(data: bytes) -> tuple[int, int, int, bytes]:
    """(format code, rate, bytes of a unit, encoded bytes); ValueError for what is no mono RIFF audio."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF audio")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and n >= 16:
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            body = data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    if form is None or body is None or form[1] != 1:
        raise ValueError("no mono audio")
    return form[0], form[2], form[4], body


def expand(kind: int, block: int, body: bytes) -> np.ndarray:
    """16-bit samples of encoded bytes; a last incomplete unit is left out."""
    raw = np.frombuffer(body, np.uint8)
    if kind == MULAW:
        return MULAW_TABLE[raw]
    if kind == ALAW:
        return ALAW_TABLE[raw]
    if kind == IMA:
        return ima_blocks(raw[: len(raw) // block * block].reshape(-1, block)).reshape(-1)
    if kind == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2")
    raise ValueError(f"format {kind} is not telephony audio")


def decode(media: DataFrame, keep: list[str], content: str = "content", rate: int = 16000) -> DataFrame:
    """Columns `keep`, then ta_rate, ta_pcm (16-bit little-endian samples at `rate`), ta_error of each file.

    Mono RIFF files of mu-law, A-law, IMA ADPCM or PCM. Null, empty, broken and other files have null
    ta_pcm and a reason in ta_error. Files stay one for one; each is decoded by itself. A kept column called as
    one of these is replaced.
    """
    keep = [c for c in keep if c.lower() not in ("ta_rate", "ta_pcm", "ta_error")]

    def work(bodies):
        rates, pcm, errors = [], [], []
        for b in bodies:
            try:
                kind, own, block, body = from_wav(b or b"")
                pcm.append(resample(expand(kind, block, body), own, rate).astype("<i2").tobytes())
                rates.append(own)
                errors.append(None)
            except (ValueError, struct.error, ZeroDivisionError) as e:
                rates.append(None)
                pcm.append(None)
                errors.append(str(e)[:200])
        return [pa.array(rates, pa.int32()), pa.array(pcm, pa.binary()), errors]

    return map_text(media, content, keep, [StructField("ta_rate", IntegerType()), StructField("ta_pcm", BinaryType()), StructField("ta_error", StringType())], lambda: work)


UNIT = 64


def payload_of(text: bytes | None) -> bytes:
    body = text or b""
    return body + b"\0" * (max(1, -(-len(body) // UNIT)) * UNIT - len(body))


def features(payloads: list[bytes], pcm: list[bytes]) -> list[str]:
    """Of payloads taken as mu-law, as A-law and as ADPCM blocks of UNIT bytes: root mean square, peak and sign
    changes, and the checksum of the resampled mu-law samples. Whole numbers only."""
    whole = np.frombuffer(b"".join(payloads), np.uint8)
    adpcm = ima_blocks(whole.reshape(-1, UNIT)) if len(whole) else None
    out, at = [], 0

    def said(x: np.ndarray) -> str:
        wide = x.astype(np.int64)
        level = int(np.sqrt(float(wide @ wide // len(x))))
        return f"{level},{int(np.abs(wide).max())},{int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"

    for p, samples in zip(payloads, pcm, strict=True):
        raw = np.frombuffer(p, np.uint8)
        mu = MULAW_TABLE[raw]
        n = len(raw) // UNIT
        out.append(f"mu={said(mu)};a={said(ALAW_TABLE[raw])};ima={said(adpcm[at : at + n].reshape(-1))};pcm16k={zlib.crc32(samples):08x}")
        at += n
    return out


FIELDS = [
    StructField("n_bytes", LongType()),
    StructField("payload_bytes", LongType()),
    StructField("payload_sha256", StringType()),
    StructField("tail_crc32", LongType()),
    StructField("media_bytes", LongType()),
    StructField("media_sha256", StringType()),
    StructField("feature", StringType()),
    StructField("pcm_bytes", LongType()),
    StructField("pcm_sha256", StringType()),
]
#: The stored columns: the RIFF file of mu-law samples, and 16-bit little-endian samples at PCM_RATE.
BODIES = [StructField("ta_media", BinaryType()), StructField("ta_pcm", BinaryType())]
PCM_RATE = 16000


def stored(documents: DataFrame, keep: list[str], text: str = "text", writer: Callable[[bytes], bytes] = lambda p: to_wav(p, MULAW), bodies: bool = True) -> DataFrame:
    """Columns `keep`, FIELDS and BODIES: each text as the mu-law samples of a telephone recording, written, read back,
    expanded and resampled.

    The text's UTF-8 bytes, null as none, are padded with zeros to a positive multiple of UNIT, stored as
    mu-law samples in a RIFF file, and read back from it; ta_pcm holds what they expand to at PCM_RATE. The
    checksums and features are of what is read. Without bodies, the stored columns are left out and only told
    by their sizes and checksums. A kept column called as one of these is replaced.
    """
    made = [*FIELDS, *(BODIES if bodies else [])]
    keep = [c for c in keep if c.lower() not in {f.name for f in made}]

    def work(texts):
        media = [writer(payload_of(t)) for t in texts]
        back = [from_wav(m) for m in media]
        pcm = [resample(expand(kind, block, body), rate, PCM_RATE).astype("<i2").tobytes() for kind, rate, block, body in back]
        back = [b[3] for b in back]
        out = [
            [len(t or b"") for t in texts],
            [len(p) for p in back],
            [hashlib.sha256(p).hexdigest() for p in back],
            [zlib.crc32(p[-UNIT:]) for p in back],
            [len(m) for m in media],
            [hashlib.sha256(m).hexdigest() for m in media],
            features(back, pcm),
            [len(x) for x in pcm],
            [hashlib.sha256(x).hexdigest() for x in pcm],
        ]
        return [*out, media, pcm] if bodies else out

    return map_text(documents, text, keep, made, lambda: work)


def contract(documents: DataFrame) -> DataFrame:
    """One row per document for op7."""
    return stored(documents, ["doc_id"], bodies=False)
