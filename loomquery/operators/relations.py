"""Relations between assets: blocked pair joins, groups, boxes of one file, graph expansion, clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.operators.components import connected_components


def blocked_pairs(df: DataFrame, block: Column, id_col: str, keep: list[str]) -> DataFrame:
    """Ordered pairs a.id < b.id of rows in the same block (null blocks take no part). Blocks are meant to be small
    groups; copies of one value are better compared once, by grouping them before."""
    rows = df.select(block.alias("__block"), id_col, *keep).where("__block is not null")
    a = rows.select("__block", F.col(id_col).alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in keep])
    b = rows.select("__block", F.col(id_col).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in keep])
    return a.join(b, "__block").where("a_id < b_id").drop("__block")


def star_edges(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """One edge from every row of a group to the group's least id, instead of all pairs."""
    least = df.groupBy(key).agg(F.min(id_col).alias("v"))
    return df.join(least, key).where(F.col(id_col) != F.col("v")).select(F.col(id_col).alias("u"), "v")


def groups(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(id, group_id): rows that share any key value, directly or through others; group_id is the least id."""
    edges = None
    for k in keys:
        one = star_edges(df.where(F.col(k).isNotNull()).select(k, id_col), k, id_col)
        edges = one if edges is None else edges.union(one)
    comp = connected_components(edges)
    return df.select(id_col).join(comp.withColumnRenamed("node", id_col), id_col, "left").select(id_col, F.coalesce("root", id_col).alias("group_id"))


def expand_graph(edges: DataFrame, seeds: DataFrame, decays: list[float], floor: float, most: int) -> DataFrame:
    """(node, score, hops): best score over paths from the seeds, losing a decay each hop; under `floor` paths end.

    edges: src, dst, weight. seeds: node, score. At most `most` nodes come back, best first.
    """
    reached = seeds.select("node", F.col("score").cast("double").alias("score"), F.lit(0).alias("hops"))
    frontier = reached
    for hop, decay in enumerate(decays, 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.round(F.col("score") * F.col("weight") * decay, 9).alias("score"), F.lit(hop).alias("hops"))
        frontier = step.where(F.col("score") >= floor).groupBy("node").agg(F.max("score").alias("score")).withColumn("hops", F.lit(hop))
        reached = reached.unionByName(frontier)
    best = reached.groupBy("node").agg(F.max("score").alias("score"), F.min_by("hops", F.struct(-F.col("score"), "hops")).alias("hops"))
    return best.orderBy(F.desc("score"), "node").limit(most)


def leader_clusters(df: DataFrame, key: str, id_col: str, vec: str, threshold: float) -> DataFrame:
    """(key, id, cluster): greedy leader clustering inside every key, in id order. A row joins the most similar running
    centroid at `threshold` or more, the first of equals, else it founds a cluster.

    Every decision needs all before it, so a key is one chain by definition; it is read as sorted Arrow batches, and what
    a task holds are a key's centroids, never its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sums, lengths, n = None, np.zeros((0, 0)), np.zeros(0), 0
        for b in batches:
            out = []
            for k, v in zip(b.column(key).to_pylist(), b.column("__vec").to_pylist(), strict=True):
                v = np.asarray(v or [], dtype=float)
                if name is None or k != name[0] or len(v) != sums.shape[1]:
                    if name is None or k != name[0]:
                        name, n = (k,), 0
                        sums, lengths = np.zeros((16, len(v))), np.ones(16)
                    else:
                        width = max(len(v), sums.shape[1])
                        sums, v = np.pad(sums, ((0, 0), (0, width - sums.shape[1]))), np.pad(v, (0, width - len(v)))
                unit = v / max(float(np.linalg.norm(v)), 1e-8)
                sims = sums[:n] @ unit / lengths[:n]
                at = int(sims.argmax()) if n else -1
                if at < 0 or sims[at] < threshold:
                    if n == len(sums):
                        sums, lengths = np.pad(sums, ((0, n), (0, 0))), np.pad(lengths, (0, n), constant_values=1)
                    at, n = n, n + 1
                sums[at] += unit
                lengths[at] = max(float(np.linalg.norm(sums[at])), 1e-8)
                out.append(at)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(id_col), pa.array(out, type=pa.int64())], [key, id_col, "cluster"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, id_col)}
    rows = df.select(key, id_col, F.col(vec).alias("__vec")).repartition(key).sortWithinPartitions(key, id_col)
    return rows.mapInArrow(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, cluster long")
