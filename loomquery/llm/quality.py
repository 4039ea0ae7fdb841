"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE tokens. Each passage is encoded from hashed features of its tokens (their
shape, pairs of neighbouring shapes, immediate and passage-wide repetition): the mean of the features' learned
vectors through tanh. Gated attention, softmax over passages of w . (tanh(V h) * sigmoid(U h)), weighs the passages,
and a logistic layer scores the weighted passage. Encoder, attention and classifier are learned together from document
labels.

Null and empty texts are one passage without features; texts of any length are scored whole; repeated rows score
alike; passages of equal weight: the first is the top one; with labels of a single class every score is that class's
rate; an empty table gives an empty result; columns of docs beside id and text play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from loomquery.llm.common import arrow_map, label_sample, texts_of

#: Bounds of the training sample: labelled rows, and bytes of a row that is learnt from.
TRAIN_ROWS, TRAIN_BYTES = 4_000, 200_000
PASSAGE, BUCKETS, WIDTH, GATE, EPOCHS = 64, 1 << 13, 12, 8, 80


def _shape_table() -> bytes:
    out = bytearray(range(256))
    for i in range(256):
        if 65 <= i <= 90:
            out[i] = ord("A")
        elif 97 <= i <= 122:
            out[i] = ord("a")
        elif 48 <= i <= 57:
            out[i] = ord("9")
        elif i >= 128:
            out[i] = ord("u")
    return bytes(out)


_SHAPE, _RUNS = _shape_table(), re.compile(rb"([aAu9])\1+")


def passage_features(text: bytes, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, bucket, share) triples: what share of a passage's tokens has the feature."""
    raw = text.split()
    if not raw:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    ids = []
    for s in _RUNS.sub(rb"\1", text.translate(_SHAPE)).split():
        i = known.get(s)
        if i is None:
            i = zlib.crc32(s)
            if len(known) < 200_000:
                known[s] = i
        ids.append(i)
    n = len(raw)
    a = np.array(ids, dtype=np.int64)
    at = np.arange(n) // PASSAGE
    same = np.fromiter((x == y for x, y in zip(raw[1:], raw)), dtype=bool, count=n - 1)
    pair = (a[1:] * 31 + a[:-1]) & 0x7FFFFFFF
    fresh = np.array([len(set(raw[i : i + PASSAGE])) * 8 // len(raw[i : i + PASSAGE]) for i in range(0, n, PASSAGE)])
    length = np.minimum(np.fromiter(map(len, raw), dtype=np.int64, count=n), 15)
    sizes = np.bincount(at).astype(float)
    feats = np.concatenate([a % 4000, 4000 + pair % 4000, 8000 + same, 8010 + fresh, 8020 + length])
    where = np.concatenate([at, at[1:], at[1:], np.arange(len(fresh)), at])
    key, count = np.unique(where * BUCKETS + feats, return_counts=True)
    p, f = key // BUCKETS, key % BUCKETS
    share = np.where((f >= 8010) & (f < 8020), 1.0, count / sizes[p])
    return p, f, share


class Attention:
    """Encoder, gated attention and classifier; parameters are numpy arrays."""

    names = ("E", "c", "V", "U", "w", "o", "b")

    def __init__(self, **params: np.ndarray):
        for k in self.names:
            setattr(self, k, params[k])

    @classmethod
    def fresh(cls, seed: int = 11) -> Attention:
        r = np.random.default_rng(seed)
        return cls(E=r.normal(0, 0.3, (BUCKETS, WIDTH)), c=np.zeros(WIDTH), V=r.normal(0, 0.3, (WIDTH, GATE)), U=r.normal(0, 0.3, (WIDTH, GATE)), w=r.normal(0, 0.3, GATE), o=r.normal(0, 0.3, WIDTH), b=np.zeros(1))

    def forward(self, p, f, x, doc_of, n_docs):
        """p: passage of each feature; doc_of: document of each passage (sorted)."""
        n = len(doc_of)
        pre = np.stack([np.bincount(p, weights=self.E[f, k] * x, minlength=n) for k in range(WIDTH)], 1) + self.c
        h = np.tanh(pre)
        t, g = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        s = (t * g) @ self.w
        top = np.full(n_docs, -np.inf)
        np.maximum.at(top, doc_of, s)
        e = np.exp(s - top[doc_of])
        alpha = e / np.bincount(doc_of, weights=e, minlength=n_docs)[doc_of]
        z = np.stack([np.bincount(doc_of, weights=alpha * h[:, k], minlength=n_docs) for k in range(WIDTH)], 1)
        y = 1 / (1 + np.exp(-np.clip(z @ self.o + self.b[0], -30, 30)))
        return h, t, g, alpha, z, y

    def gradients(self, p, f, x, doc_of, n_docs, y, weight):
        h, t, g, alpha, z, out = self.forward(p, f, x, doc_of, n_docs)
        d = (out - y) * weight
        dz = d[:, None] * self.o
        dh = alpha[:, None] * dz[doc_of]
        da = (h * dz[doc_of]).sum(1)
        ds = alpha * (da - np.bincount(doc_of, weights=alpha * da, minlength=n_docs)[doc_of])
        dt, dg = ds[:, None] * self.w * g * (1 - t**2), ds[:, None] * self.w * t * g * (1 - g)
        dh += dt @ self.V.T + dg @ self.U.T
        dp = dh * (1 - h**2)
        dE = np.stack([np.bincount(f, weights=dp[p, k] * x, minlength=BUCKETS) for k in range(WIDTH)], 1)
        return {"E": dE + 1e-6 * self.E, "c": dp.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": ((t * g) * ds[:, None]).sum(0), "o": z.T @ d + 1e-5 * self.o, "b": np.array([d.sum()])}


def _bag(feats: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Join documents' triples into one numbering of passages; a document without features has one empty passage."""
    ps, fs, xs, docs, base = [], [], [], [], 0
    for d, (p, f, x) in enumerate(feats):
        n = int(p[-1]) + 1 if len(p) else 1
        ps.append(p + base)
        fs.append(f)
        xs.append(x)
        docs.append(np.full(n, d))
        base += n
    return np.concatenate(ps), np.concatenate(fs), np.concatenate(xs), np.concatenate(docs), len(feats)


def fit(feats: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray) -> Attention | float:
    """Adam over the whole sample; classes weigh alike up to a square root. A single class gives its rate instead."""
    if not len(y) or y.min() == y.max():
        return float(np.clip(y.mean() if len(y) else 0.5, 0, 1))
    model, bag = Attention.fresh(), _bag(feats)
    rate = y.mean()
    weight = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)) ** 0.5
    weight /= weight.sum()
    m = {k: np.zeros_like(getattr(model, k)) for k in model.names}
    v = {k: np.zeros_like(getattr(model, k)) for k in model.names}
    for step in range(1, EPOCHS + 1):
        for k, g in model.gradients(*bag, y, weight).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            setattr(model, k, getattr(model, k) - 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9))
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Attention | float:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            rows = [passage_features(t, known) for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in rows], type=pa.list_(pa.int32())) for i in (0, 1)), pa.array([r[2] for r in rows], type=pa.list_(pa.float32())), b.column("y").cast(pa.int32())], ["p", "f", "x", "y"]
            )

    sample = label_sample(docs, labels, "quality", learn, TRAIN_ROWS, TRAIN_BYTES)
    rows = arrow_map(sample, features, "p array<int>, f array<int>, x array<float>, y int").toPandas()
    rows["k"] = [zlib.crc32(np.asarray(f, dtype=np.int32).tobytes()) for f in rows["f"]]
    rows = rows.sort_values(["k", "y"], kind="stable")  # the sample's order depends on the shuffle
    feats = [(np.asarray(p, dtype=np.int64), np.asarray(f, dtype=np.int64), np.asarray(x, dtype=float)) for p, f, x in zip(rows["p"], rows["f"], rows["x"])]
    return fit(feats, rows["y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Attention | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_passages, top_passage, top_weight) of every row: the score, and the passage attended to most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            texts = texts_of(b, text_col)
            if not texts:
                continue
            n_docs = len(texts)
            bag = _bag([passage_features(t, known) for t in texts])
            doc_of = bag[3]
            counts = np.bincount(doc_of, minlength=n_docs)
            if isinstance(model, Attention):
                _, _, _, alpha, _, y = model.forward(*bag)
            else:
                alpha, y = 1.0 / counts[doc_of], np.full(n_docs, model)
            first = np.cumsum(counts) - counts
            order = np.lexsort((np.arange(len(alpha)), -alpha, doc_of))
            top = order[first]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array(y, type=pa.float64()), pa.array(counts, type=pa.int64()), pa.array(top - first, type=pa.int64()), pa.array(alpha[top], type=pa.float64())],
                [id_col, "score", "n_passages", "top_passage", "top_weight"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double, n_passages long, top_passage long, top_weight double")
