"""Toxicity: a factorization machine over hashed terms.

Terms of a document are its distinct words and the 4- and 5-byte stems of longer words, hashed by crc32. A term is an
input of the model if it speaks for or against the label by itself (z score of its smoothed log odds over the distinct
training texts), or if it does so in company: every pair of the frequent terms is tested for how far the label's rate
in texts with both is from what the two rates alone would add up to. So terms that are neutral alone, such as the name
of a group, come in with the insult beside them. The machine y = b + sum w_i + 1/2 (|sum v_i|^2 - sum |v_i|^2) then
learns a weight for every input and, through the factors, one for every pair of them. A tenth of a text's inputs is
left out at random in each epoch, so that a text with a single one is caught too.

Nulls and empty texts have no terms and take the bias' score; a text of any length is scored whole; repeated rows and
ties are scored alike; without two classes to learn from every score is the label's base rate (0 with no label); an
empty table gives an empty result; columns of any name are kept as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.llm.common import arrow_map, label_sample, texts_of, words
from loomquery.session import materialize

#: Bounds of the training sample: labelled rows, and bytes of a row that is learnt from.
TRAIN_ROWS, TRAIN_BYTES = 20_000, 1_000_000
#: Terms need this many training texts and this z score, on either side.
MIN_DF, MIN_Z = 4, 3.0
#: Pairs are tested among the PAIR_TERMS most frequent terms with this share of the texts, and need this z score.
PAIR_TERMS, PAIR_SHARE, PAIR_Z = 2_000, 0.01, 5.0
FACTORS, EPOCHS, LEFT_OUT, CACHE = 8, 200, 0.1, 400_000


def term_hashes(word: bytes) -> tuple[int, ...]:
    if len(word) <= 4:
        return (zlib.crc32(word),)
    if len(word) == 5:
        return zlib.crc32(word), zlib.crc32(word[:4], 4)
    return zlib.crc32(word), zlib.crc32(word[:4], 4), zlib.crc32(word[:5], 5)


def _doc_hashes(text: bytes) -> set[int]:
    return {h for w in set(words(text)) for h in term_hashes(w)}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        y = np.asarray(b.column("y").to_pylist(), dtype=bool)
        sets = [np.fromiter(s, dtype=np.int64, count=len(s)) for s in map(_doc_hashes, texts_of(b, "text"))]
        if not sets:
            continue
        term = np.concatenate(sets)
        pos = np.repeat(y, [len(s) for s in sets])
        uniq, inv = np.unique(term, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(uniq), pa.array(np.bincount(inv, weights=pos, minlength=len(uniq)).astype(np.int64)), pa.array(np.bincount(inv, minlength=len(uniq)).astype(np.int64))], ["term", "pos", "df"]
        )


class Machine:
    """A fitted factorization machine; slots maps a term's hash to its row of w and v."""

    def __init__(self, slots: dict[int, int], b: float, w: np.ndarray, v: np.ndarray):
        self.slots, self.b, self.w, self.v = slots, b, w, v

    def raw(self, feats: list[list[int]]) -> np.ndarray:
        sizes = np.array([len(f) for f in feats], dtype=np.int64)
        idx = np.fromiter((i for f in feats for i in f), dtype=np.int64, count=int(sizes.sum()))
        doc = np.repeat(np.arange(len(feats)), sizes)
        out = self.b + np.bincount(doc, weights=self.w[idx], minlength=len(feats))
        for k in range(self.v.shape[1]):
            f = self.v[idx, k]
            out += 0.5 * (np.bincount(doc, weights=f, minlength=len(feats)) ** 2 - np.bincount(doc, weights=f * f, minlength=len(feats)))
        return out

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(feats), -30, 30)))


def fit_machine(feats: list[list[int]], y: np.ndarray, n_terms: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the logistic loss with weight decay, whole batch; classes weigh alike."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, FACTORS))
    rate = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    theta = [np.array([np.log(rate / (1 - rate))]), w, v]
    m, s = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    sizes = np.array([len(f) for f in feats])
    every = np.fromiter((i for f in feats for i in f), dtype=np.int64, count=int(sizes.sum()))
    whose, n = np.repeat(np.arange(len(feats)), sizes), len(feats)
    weight = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)) ** 0.5
    weight /= weight.sum()
    for t in range(1, EPOCHS + 1):
        b, w, v = theta
        here = rng.random(len(every)) >= LEFT_OUT
        idx, doc = every[here], whose[here]
        sums = np.stack([np.bincount(doc, weights=v[idx, k], minlength=n) for k in range(FACTORS)], 1)
        squares = sum(np.bincount(doc, weights=v[idx, k] ** 2, minlength=n) for k in range(FACTORS))
        p = 1 / (1 + np.exp(-np.clip(b[0] + np.bincount(doc, weights=w[idx], minlength=n) + 0.5 * ((sums**2).sum(1) - squares), -30, 30)))
        g = (p - y) * weight
        gi = g[doc]
        gv = np.stack([np.bincount(idx, weights=gi * (sums[doc, k] - v[idx, k]), minlength=n_terms) for k in range(FACTORS)], 1)
        grads = [np.array([g.sum()]), np.bincount(idx, weights=gi, minlength=n_terms) + 2e-5 * w, gv + 1e-4 * v]
        for j, q in enumerate(grads):
            m[j] = 0.9 * m[j] + 0.1 * q
            s[j] = 0.99 * s[j] + 0.01 * q * q
            theta[j] = theta[j] - 0.08 * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.99**t)) + 1e-9)
    return float(theta[0][0]), theta[1], theta[2]


def telling_pairs(feats: list[list[int]], y: np.ndarray, n_terms: int) -> np.ndarray:
    """Which of the terms 0..n_terms-1 belong to a pair whose texts' rate differs from what the terms add up to."""
    if not n_terms:
        return np.zeros(0, dtype=bool)
    both, pos = (np.zeros((n_terms, n_terms), dtype=np.float32) for _ in range(2))  # counts, exact up to 2^24 texts
    for lo in range(0, len(feats), 1_000):
        some = feats[lo : lo + 1_000]
        x = np.zeros((len(some), n_terms), dtype=np.float32)
        for i, f in enumerate(some):
            x[i, f] = 1
        both += x.T @ x
        hit = x[y[lo : lo + 1_000] > 0]
        pos += hit.T @ hit
    logit = lambda k, n: np.log((k + 0.5) / (n - k + 0.5))
    alone = logit(np.diag(pos).astype(float), np.diag(both).astype(float))
    out = np.zeros(n_terms, dtype=bool)
    for lo in range(0, n_terms, 200):  # a few rows at once, so that the driver holds no further matrices
        n, k = both[lo : lo + 200].astype(float), pos[lo : lo + 200].astype(float)
        e = 1 / (1 + np.exp(-np.clip(alone[lo : lo + 200, None] + alone[None, :] - logit(y.sum(), len(y)), -30, 30)))
        z = np.abs(k - n * e) / np.sqrt(np.maximum(n * e * (1 - e), 1.0))
        z[np.arange(len(z)), np.arange(lo, lo + len(z))] = 0
        out[lo : lo + 200] = ((z >= PAIR_Z) & (n >= MIN_DF)).any(axis=1)
    return out


def fit(sample: DataFrame) -> Machine:
    """Fit on a frame (text, y) of bounded size, such as label_sample gives."""
    sample = materialize(sample, "toxic-sample")
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = total["n"], total["p"]
    if p == 0 or p == n:
        rate = 1e-9 if n == 0 else min(max(p / n, 1e-9), 1 - 1e-9)
        return Machine({}, float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, FACTORS)))
    pos, neg = F.col("pos") + 0.5, F.col("df") - F.col("pos") + 0.5
    z = (F.log(pos / F.lit(p + 1.0)) - F.log(neg / F.lit(n - p + 1.0))) / F.sqrt(1 / pos + 1 / neg)
    counted = arrow_map(sample, _count_terms, "term long, pos long, df long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("df").alias("df"))
    often = materialize(counted.where(F.col("df") >= MIN_DF).withColumn("z", z).where((F.abs("z") >= MIN_Z) | (F.col("df") >= PAIR_SHARE * n)), "toxic-terms")
    frequent = [r["term"] for r in often.where(F.col("df") >= PAIR_SHARE * n).orderBy(F.desc("df"), "term").limit(PAIR_TERMS).collect()]
    alone = {r["term"] for r in often.where(F.abs("z") >= MIN_Z).collect()}
    slots = {t: i for i, t in enumerate([*frequent, *sorted(alone.difference(frequent))])}

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sorted(slots[h] for h in _doc_hashes(t) if h in slots) for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, type=pa.list_(pa.int32())), b.column("y").cast(pa.int32())], ["f", "y"])

    rows = sorted((tuple(r["f"]), r["y"]) for r in arrow_map(sample, featurize, "f array<int>, y int").collect())
    feats, y = [list(f) for f, _ in rows], np.array([y for _, y in rows], dtype=float)
    paired = telling_pairs([[i for i in f if i < len(frequent)] for f in feats], y, len(frequent))
    chosen = [t for t, i in slots.items() if t in alone or paired[i]]
    place = {slots[t]: k for k, t in enumerate(chosen)}
    feats = [[place[i] for i in f if i in place] for f in feats]
    return Machine({t: k for k, t in enumerate(chosen)}, *fit_machine(feats, y, len(chosen)))


def _scorer(model: Machine, text_col: str):
    slots, known = model.slots, {}

    def feats(text: bytes) -> list[int]:
        out: set[int] = set()
        for w in set(words(text)):
            got = known.get(w)
            if got is None:
                got = tuple(slots[h] for h in term_hashes(w) if h in slots)
                if len(known) < CACHE:
                    known[w] = got
            out.update(got)
        return sorted(out)

    return lambda batch: model.scores([feats(t) for t in texts_of(batch, text_col)])


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; score is between 0 and 1, higher for likelier toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model, text_col)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(of(b), type=pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double")


def keep_clean(docs: DataFrame, model: Machine, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model, text_col)
        for b in batches:
            yield b.filter(pa.array(of(b) < threshold))

    return arrow_map(docs, run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Machine:
    return fit(label_sample(docs, labels, "toxic", learn, TRAIN_ROWS, TRAIN_BYTES))
