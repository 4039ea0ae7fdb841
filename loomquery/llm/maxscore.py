"""Exact top-k inner products by MaxScore over quantised vectors.

A vector's components are postings. The terms of a dimension are its impact buckets: a shard sorts its rows by the
component's value and cuts them into lists of BUCKET rows, so a list's bound for a query is exact, the larger of
q_d times its first and last value. Every row is in one list of each dimension.

A query sorts the lists of all dimensions by bound. Taking lists from the lowest bound up, each dimension can add at
most the largest bound taken of it; as long as these maxima sum to less than the k-th best score so far, the lists are
non-essential, and a row that is in none of the others, the essential lists, cannot enter. Only the postings of
essential lists are traversed: each adds to its row what it exceeds its dimension's non-essential bound by. Rows
whose sum still competes are probed in the other dimensions, those with the largest bounds first, and dropped as soon
as they cannot reach the threshold. A task keeps its best k of every query over all its shards, which raises the
threshold from shard to shard; the tasks' lists are then merged. Scores are exact integers: beyond what doubles hold,
shards are scored with integers of any size.

Queries are taken in blocks of QUERIES, each of bounded size, and every block runs against all rows. Ties go to the
smaller id. Rows with a null id, a null vector or a null or non-finite component take no part, nor do those whose
scaled component overflows a double; shorter vectors count as padded with zeros; repeated rows are candidates of their
own; a query id that repeats uses its least vector; scores beyond 64 bits are ranked exactly and returned as the
nearest long; an empty table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomquery.llm.common import arrow_map
from loomquery.session import materialize

K, SCALE, QUERIES, SHARD, BUCKET = 5, 256.0, 4096, 4096, 32
#: Dimensions probed between two tests of the threshold.
PROBE = 8
_LOW = (1 << 62) - 1


def quantised(batch: pa.RecordBatch, id_col: str, vec_col: str, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix of floor(scale * x)) of the rows that take part."""
    vectors = batch.column(vec_col)
    here = np.asarray(vectors.is_valid()) & np.asarray(batch.column(id_col).is_valid())
    batch = batch.filter(pa.array(here))
    vectors, ids = batch.column(vec_col), batch.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
    lens = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is nan here
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(scale * flat)
    row = np.repeat(np.arange(len(ids)), lens)
    keep = np.bincount(row, weights=~np.isfinite(flat), minlength=len(ids)) == 0
    out = np.zeros((len(ids), int(lens[keep].max(initial=0))))
    good = keep[row]
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[row[good], at[good]] = flat[good]
    return ids[keep], out[keep]


def padded(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


class TopK:
    """The best k of one query: highest score, then smallest id. Scores are doubles, or Python integers once one needs it."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0), np.zeros(0, dtype=np.int64)

    def threshold(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if self.score.dtype != score.dtype:
            self.score, score = (np.array([int(x) for x in a], dtype=object) for a in (self.score, score))
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        if score.dtype == object:
            order = np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[: self.k], dtype=np.int64)
        else:
            if len(score) > 4 * self.k:
                cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
                near = score >= cut
                score, ids = score[near], ids[near]
            order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]


class Shard:
    """Rows and their posting lists: for each dimension, rows by falling value, in lists of BUCKET rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, bucket: int = BUCKET):
        n, self.width = x.shape
        self.x, self.ids, self.n_lists = x, ids, -(-n // bucket)
        self.rows = np.full((self.width, self.n_lists * bucket), -1, dtype=np.int64)
        self.rows[:, :n] = np.argsort(-x, axis=0, kind="stable").T
        self.rows = self.rows.reshape(self.width, self.n_lists, bucket)
        values = np.where(self.rows >= 0, x[self.rows, np.arange(self.width)[:, None, None]], np.nan)
        self.values, self.top, self.low = values, values[:, :, 0], np.nanmin(values, axis=2)
        #: postings traversed, rows that were in one, rows scored in full, of all rows asked for
        self.seen = np.zeros(4, dtype=np.int64)

    def search(self, q: np.ndarray, own: int, best: TopK) -> None:
        theta = best.threshold()
        if theta == -np.inf:
            live, score = np.arange(len(self.x)), self.x @ q
            self.seen += (0, len(live), len(live), len(live))
        else:
            live, score = self._compete(q, theta)
        fit = (score >= theta) & (self.ids[live] != own)
        best.add(score[fit], self.ids[live[fit]])

    def _compete(self, q: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
        bound = np.where(q[:, None] > 0, q[:, None] * self.top, q[:, None] * self.low)
        floor = bound.min(axis=1)  # a row is in one list of each dimension, so this much counts in any case
        order = np.unique(bound)
        lo, hi = 0, len(order)  # the most lists whose dimensions' maxima sum to less than theta
        while lo < hi:
            mid = (lo + hi) // 2
            taken = np.where(bound <= order[mid], bound, -np.inf).max(axis=1)
            if np.maximum(taken, floor).sum() < theta:
                lo = mid + 1
            else:
                hi = mid
        cut = order[lo - 1] if lo else -np.inf
        base = np.maximum(np.where(bound <= cut, bound, -np.inf).max(axis=1), floor)
        if base.sum() >= theta:  # even the lowest lists compete: every list is essential
            live = np.arange(len(self.x))
            self.seen += (self.x.size, len(live), len(live), len(live))
            return live, self.x @ q
        essential = bound > base[:, None]
        d, _ = np.nonzero(essential)
        rows, gain = self.rows[essential], self.values[essential] * q[d][:, None] - base[d][:, None]
        real = rows >= 0
        rows, gain = rows[real], np.maximum(gain[real], 0)
        in_one = np.bincount(rows, minlength=len(self.x)) > 0
        most = base.sum() + np.bincount(rows, weights=gain, minlength=len(self.x))
        live = np.flatnonzero(in_one & (most >= theta))
        self.seen += (len(rows), int(in_one.sum()), 0, len(self.x))
        score = most[live]
        others = np.argsort(floor - base)  # dimensions in which a row can lose most come first
        for at in range(0, len(others), PROBE):
            dims = others[at : at + PROBE]
            score = score + np.minimum(self.x[np.ix_(live, dims)] * q[dims] - base[dims], 0).sum(axis=1)
            fit = score >= theta
            live, score = live[fit], score[fit]
        self.seen[2] += len(live)
        return live, score


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in x], dtype=object)


def top_k(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(query_id, rank, id, score) of each query's k best rows among all but its own."""
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{vec_col}`").alias("__vec"), is_query.alias("__asks"))
    finite = ~F.exists("__vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    queries = rows.where("__asks and __id is not null and __vec is not null").where(finite).groupBy("__id").agg(F.min("__vec").alias("__vec"))
    queries = materialize(queries, "queries")
    n_blocks = max(1, -(-queries.count() // QUERIES))

    def search(q_ids: np.ndarray, q_mat: np.ndarray):
        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held = []
            for b in batches:
                held.append(quantised(b, "__id", "__vec", scale))
                if sum(len(i) for i, _ in held) >= SHARD:
                    yield held
                    held = []
            if held:
                yield held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [TopK(k) for _ in q_ids]
            for held in shards(batches):
                width = max(q_mat.shape[1], *(m.shape[1] for _, m in held))
                x, q = np.concatenate([padded(m, width) for _, m in held]), padded(q_mat, width)
                ids = np.concatenate([i for i, _ in held])
                if not len(ids) or not len(q_ids):
                    continue
                if width * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) >= 2**52:
                    for i, own in enumerate(q_ids):
                        best[i].add(_exact(x[ids != own], q[i]), ids[ids != own])
                    continue
                for lo in range(0, len(ids), SHARD):
                    shard = Shard(x[lo : lo + SHARD], ids[lo : lo + SHARD])
                    for i, own in enumerate(q_ids):
                        shard.search(q[i], own, best[i])
            sizes = [len(t.ids) for t in best]
            if sum(sizes):
                scores = [int(x) for t in best for x in t.score]
                high = [max(min(x >> 62, (1 << 63) - 1), -(1 << 63)) for x in scores]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate([t.ids for t in best])), pa.array(high, type=pa.int64()), pa.array([x & _LOW for x in scores], type=pa.int64())], ["query_id", "__id", "high", "low"])

        return run

    parts = []
    for n in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("__id"), F.lit(n_blocks)) == n).orderBy("__id").toPandas()
        q_ids, q_mat = quantised(pa.RecordBatch.from_pydict({"__id": pa.array(block["__id"].tolist(), type=pa.int64()), "__vec": pa.array([list(v) for v in block["__vec"]], type=pa.list_(pa.float64()))}), "__id", "__vec", scale)
        got = arrow_map(rows.select("__id", "__vec"), search(q_ids, q_mat), "query_id long, __id long, high long, low long")
        parts.append(got if n_blocks == 1 else materialize(got, "top"))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "__id"))
    # a score is high * 2^62 + low; what a long cannot hold becomes the nearest one
    score = F.when(F.col("high") >= 2, F.lit((1 << 63) - 1)).when(F.col("high") < -2, F.lit(-(1 << 63))).otherwise(F.shiftleft("high", 62).bitwiseOR(F.col("low")))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("__id").alias(id_col), score.alias("score"))


#: The same in DuckDB for the query's parameters.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
