"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm._rows import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v): root is the smallest node of its component.

    Each round points every node's larger neighbours at the smallest one (large star), then every node and its
    smaller neighbours (small star), until nothing changes: about log(nodes) rounds. A round is four joins
    and sums of edges by node; each result is written, so a lost executor costs no earlier round. Nodes with
    many neighbours are sums before the shuffle, and their side of a join is split by adaptive execution.
    """
    held = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "edges-large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        others = large.join(low, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held = cut(others.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "edges-small")
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
