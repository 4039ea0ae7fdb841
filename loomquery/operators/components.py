"""Connected components over an edge table, by alternating large-star and small-star steps.

No vertex list, edge list or component is ever brought to the driver; each round moves two sums there. Minima are
pre-aggregated and checkpointed before the join on the vertex, so a hub's edges meet a plain two-sided shuffle join
that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.session import checkpointed


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _star(pairs: DataFrame) -> DataFrame:
    """For each u the least vertex among u and its neighbours, joined to every pair (u, v)."""
    least = checkpointed(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every vertex of the undirected edges (u, v); root is the least vertex of its component.

    Self-loops and null ends take no part. An empty edge table gives an empty result. Raises after max_rounds rounds
    without a fixed point (each round at least halves path lengths, so 60 covers any real input).
    """
    clean = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    cur = checkpointed(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(cur)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = checkpointed(cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = checkpointed(_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: edges already point from the greater vertex u to lesser ones
        joined = _star(large)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = checkpointed(small.union(joined.where("u <> m").select("u", F.col("m").alias("v"))).distinct())
        after = _signature(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
