"""SimHash near-duplicates, linked through BK-trees.

Fingerprints are 64-bit majorities over XXH64 (seed 42) of word shingles. Two fingerprints that differ in at most
RADIUS = 3 bits agree on at least one of four 16-bit bands, so every band value is a shard: its distinct
fingerprints form a BK-tree whose children are keyed by their integer Hamming distance to the parent, and a search
follows only edges within the radius. Trees of many small shards are built and searched together, level by level. A
shard of more than SHARD fingerprints is dealt into blocks, and each pair of blocks becomes a shard of its own, so no
task gets an unbounded tree and no link is lost. Shards emit a star for each of their components, never all pairs;
connected components join the stars. Trees stay with their shard instead of being broadcast, as their size grows with
the data.

Null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle give one
shingle of all their words; copies share one node; null ids take no part in the choice of the smallest id, and of rows
that tie in it the first stays; an empty table gives an empty result; columns of any name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm.common import arrow_map, numbered, restored, texts_of
from loomquery.operators.components import connected_components
from loomquery.session import materialize

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Largest number of fingerprints of one tree; larger shards are dealt into pairs of blocks of half this size.
SHARD = 1000
#: (query, node) pairs that a search holds at once.
FRONTIER = 2_000_000
#: Shingles hashed at once, so that memory does not grow with a text's length.
STEP = 100_000


def fingerprint(text: bytes) -> int:
    """64-bit majority of the shingles' hashes; a tie of set and unset gives 0. No words: 0."""
    w = text.lower().split()
    if not w:
        return 0
    buf = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends[:-1]]
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, STEP):
        hi = min(n, lo + STEP)
        h = np.array([digest(buf[a : b - 1], SEED) for a, b in zip(starts[lo:hi], ends[lo + k - 1 : hi + k - 1], strict=True)], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns to keep, fp long) of every row."""
    keep = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts_of(b, text_col)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp)], [*keep, "fp"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(docs.select(*keep, text_col), run, f"{schema}, fp long")


class Forest:
    """BK-trees over the groups of a sorted group array, built level by level.

    Every round makes the first unplaced fingerprint of each group a node, and regroups the rest of the group by
    their distance to it. A node has one child at most for each distance; (node, distance) finds it by binary search.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.fp = fp
        n = len(fp)
        parent, edge = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        rest, key = np.arange(n), group.astype(np.int64)
        self.roots: dict[int, int] | np.ndarray
        first_round = True
        above, dist = parent.copy(), edge.copy()
        while len(rest):
            _, first, inv = np.unique(key, return_index=True, return_inverse=True)
            heads = rest[first]
            if first_round:
                self.root_of = heads[inv]  # of every fingerprint, its group's root
                first_round = False
            parent[heads], edge[heads] = above[heads], dist[heads]
            node = heads[inv]
            d = np.bitwise_count(fp[rest] ^ fp[node]).astype(np.int64)
            keep = np.ones(len(rest), dtype=bool)
            keep[first] = False
            rest, node, d = rest[keep], node[keep], d[keep]
            above[rest], dist[rest] = node, d
            key = node * 65 + d
        linked = np.flatnonzero(parent >= 0)
        keys = parent[linked] * 65 + edge[linked]
        order = np.argsort(keys, kind="stable")
        self.keys, self.child = keys[order], linked[order]

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius; edges outside [d - radius, d + radius] are not followed."""
        stack = [(queries, self.root_of[queries])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            near = (d <= radius) & (q != node)
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), side="left")
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
            n = hi - lo
            some = n > 0
            if some.any():
                q, lo, n = q[some], lo[some], n[some]
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
                stack.append((np.repeat(q, n), self.child[at]))


class Union:
    """Least member of each group under pairwise links, vectorised."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def shard_stars(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): each fingerprint that links within its group, with the least-placed one of its component there."""
    _, inv, size = np.unique(group, return_inverse=True, return_counts=True)
    many = np.flatnonzero(size[inv] > 1)
    group, fp = group[many], fp[many]
    if not len(fp):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    forest, union = Forest(group, fp), Union(len(fp))
    for lo in range(0, len(fp), 20_000):
        for q, node in forest.links(np.arange(lo, min(len(fp), lo + 20_000)), radius):
            union.link(q, node)
    moved = np.flatnonzero(union.root != np.arange(len(fp)))
    return fp[moved], fp[union.root[moved]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by shard: complete shards go on together as soon as enough rows have come."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def emit(keys, fps):
        # shard keys are 64-bit hashes; equal keys of different shards only add harmless comparisons
        u, v = shard_stars(keys, fps)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append((b.column("shard").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
        if sum(len(k) for k, _ in held) >= 50_000:
            keys, fps = np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield from emit(keys[:cut], fps[:cut])
            held = [(keys[cut:], fps[cut:])]
    if held:
        yield from emit(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))


def band_masks(n: int) -> list[int]:
    """Masks of the bits that a shard's members share: of b blocks, b - RADIUS agree when RADIUS bits differ at most.

    Four blocks give 4 masks of 16 bits; more fingerprints take five (10 masks of 25 bits or more) or six (20 of 32),
    so that shards stay small while every link still falls into at least one.
    """
    b = 4 if n <= 1 << 24 else 5 if n <= 1 << 34 else 6
    cuts = [64 * i // b for i in range(b + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(some) for some in combinations(block, b - RADIUS)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def linked(fps: DataFrame) -> DataFrame:
    """(node, root) of the fingerprints (column fp, each once) that link to another at RADIUS or fewer bits."""
    masks = band_masks(fps.count())
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(masks)])
    banded = fps.select("fp", F.explode(bands).alias("b")).select("fp", "b.band", "b.value")
    count = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD)
    large = materialize(count.select("band", "value", F.ceil(F.col("n") * 2 / SHARD).cast("int").alias("g")), "large-shards")
    sized = banded.join(large, ["band", "value"], "left") if large.take(1) else banded.withColumn("g", F.lit(None).cast("int"))
    block = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("g") - 1), lambda x: x != block)
    pairs = F.when(F.col("g").isNull(), F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))).otherwise(
        F.transform(others, lambda x: F.struct(F.least(x, block).alias("i"), F.greatest(x, block).alias("j")))
    )
    dealt = sized.select("fp", "band", "value", F.explode(pairs).alias("p"))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt.select("fp", F.xxhash64("band", "value", "p").alias("shard")).repartition(parts, "shard").sortWithinPartitions("shard")
    return connected_components(materialize(arrow_map(spread, _stars, "u long, v long"), "stars"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id reachable over links, its own included."""
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    least = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    nodes = materialize(least, "nodes")
    comp = linked(nodes)
    per_root = materialize(comp.join(nodes, comp.node == nodes.fp).groupBy("root").agg(F.min("least").alias("top")), "per-root")
    tops = materialize(comp.join(per_root, "root").select(F.col("node").alias("fp"), "top"), "tops")
    named = materialize(nodes.join(tops, "fp", "left").select("fp", F.coalesce(F.least("least", "top"), "least").alias("component_id")), "named")
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows, with all their columns, that come first in their component by (id, nulls last; place in the input)."""
    rows = numbered(docs, id_col, text_col, "near-rows")
    fps = materialize(fingerprints(rows, "__id", "__text", ("__row",)), "fingerprints")
    first = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    nodes = materialize(fps.groupBy("fp").agg(F.min(first).alias("least")), "nodes")
    comp = linked(nodes.select("fp"))
    tops = comp.join(nodes, comp.node == nodes.fp).select("root", "fp", "least")
    kept_roots = tops.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    alone = nodes.join(comp.select(F.col("node").alias("fp")), "fp", "left_anti").select(F.col("least.row").alias("row"))
    kept = materialize(alone.union(kept_roots), "kept-rows")
    # by hash at every size: the kept rows grow with the input, and sorting whole texts would gain nothing
    return rows.join(kept.hint("shuffle_hash"), rows["__row"] == kept["row"], "left_semi").select(*restored(docs, text_col))
