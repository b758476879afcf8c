"""Dense vectors as array columns, in double precision and with a fixed order of summation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """V4: sum of products over the shorter of the two; what one of them lacks adds nothing."""
    return total(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """V3: products over the shorter length, over both whole norms; 0 if either vector is zero or empty."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def normalized(v: Column) -> Column:
    """V2: unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def fitted(v: Column, size: int) -> Column:
    """V1: cut to size, or filled up with zeros."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)


def hash_embedding(text: Column, size: int, prefix: str = "document: ") -> Column:
    """Unit vector from SHA-256 of the text and a 4-byte little-endian block counter, eight little-endian
    32-bit numbers a block, each mapped to [-1, 1)."""

    def little(n: int) -> str:
        return n.to_bytes(4, "little").hex()

    data = F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))).cast("binary")
    parts = []
    for block in range(-(-size // 8)):
        digest = F.sha2(F.concat(data, F.unhex(F.lit(little(block)))), 256)
        for k in range(min(8, size - 8 * block)):
            swapped = F.concat(*[F.substring(digest, 8 * k + 2 * j + 1, 2) for j in (3, 2, 1, 0)])
            parts.append(F.conv(swapped, 16, 10).cast("double") / F.lit(2147483648.0) - 1)
    return normalized(F.array(*parts))


def mean_vectors(df, key: str, v: str):
    """Element-wise mean of the vectors of each key, as rows (key, pos, value), summed before the shuffle."""
    return df.select(key, F.posexplode(v).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("value"))
