"""Language identification by a linear-chain conditional random field over words.

The states are the languages of the training documents. A word's emission scores sum learned weights of hashed affix,
character n-gram and whole-word features and of lexicon features (the languages in whose list of frequent words it
is); learned transition weights join neighbouring words. Forward-backward gives every word's posterior, so
code-switched text is labelled word by word; a document's language is the one with the largest mean posterior.
Training documents are chained in pairs, so that the transitions learn what switching costs.

Chains of any length are exact: each block of words is reduced to its transfer matrix, blocks are chained by these,
and then all blocks run at once from their exact borders.

Null texts and texts without a letter are `und` with score 0; ties go to the language that sorts first; repeated rows
are labelled alike; texts of any length are read whole; an empty table gives an empty result; without a labelled text
everything is `und`; columns of docs beside id and text play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.llm.common import arrow_map, texts_of

#: Bounds of the training sample: documents, and bytes of a document that is learnt from.
TRAIN_ROWS, TRAIN_BYTES = 1_500, 20_000
BUCKETS, BLOCK, EPOCHS, LEXICON, CACHE = 1 << 17, 128, 6, 300, 300_000
#: Bytes of the longest word that is one state.
LONGEST = 36


def _letters_table() -> bytes:
    out = bytearray(b" " * 256)
    for i in range(256):
        if 65 <= i <= 90:
            out[i] = i + 32
        elif 97 <= i <= 122 or i >= 128:
            out[i] = i
    return bytes(out)


_TABLE, _ASCII = _letters_table(), re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def split_words(text: bytes) -> list[bytes]:
    """Runs of letters; a run of more than LONGEST bytes, as in scripts without spaces, is cut between characters, so
    that every part of it is a state of the chain and all of it is read."""
    out = text.translate(_TABLE).split()
    if not out or max(map(len, out)) <= LONGEST:
        return out
    cut: list[bytes] = []
    for w in out:
        while len(w) > LONGEST:
            at = LONGEST
            while at > 1 and w[at] & 0xC0 == 0x80:  # not inside a character
                at -= 1
            cut.append(w[:at])
            w = w[at:]
        cut.append(w)
    return cut


def features(word: bytes, lexicon: dict[bytes, tuple[int, ...]]) -> list[int]:
    """Buckets of a word's features."""
    w = b"^" + word + b"$"
    crc, n = zlib.crc32, len(w)
    out = [crc(w), crc(w[:3], 3), crc(w[:4], 4), crc(w[-3:], 5), crc(w[-4:], 6)]
    out += [crc(w[i : i + 2], 1) for i in range(n - 1)]
    out += [crc(w[i : i + 3], 2) for i in range(n - 2)]
    out += [crc(b"lexicon%d" % k, 7) for k in lexicon.get(word, ())]
    return [x % BUCKETS for x in out]


def _flat(words: list[bytes], lexicon) -> tuple[np.ndarray, np.ndarray]:
    rows = [features(w, lexicon) for w in words]
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    return np.array([x for r in rows for x in r], dtype=np.int64), sizes


def emissions(words: list[bytes], weights: np.ndarray, lexicon) -> np.ndarray:
    """(words, languages) summed weights."""
    if not words:
        return np.zeros((0, weights.shape[1]))
    idx, sizes = _flat(words, lexicon)
    return np.add.reduceat(weights[idx], np.cumsum(sizes) - sizes, axis=0)


def forward_backward(em: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word of chains laid end to end, and summed pair posteriors; no empty chains."""
    k = em.shape[1]
    e = np.exp(em - em.max(1, keepdims=True))
    a = np.exp(trans - trans.max())
    n_blocks = -(-lens // BLOCK)
    chain_of = np.repeat(np.arange(len(lens)), n_blocks)
    first_block = np.cumsum(n_blocks) - n_blocks
    nth = np.arange(len(chain_of)) - first_block[chain_of]
    start = (np.cumsum(lens) - lens)[chain_of] + nth * BLOCK
    size = np.minimum(lens[chain_of] - nth * BLOCK, BLOCK)
    nb, longest = len(start), int(size.max())
    live = [np.flatnonzero(size > j) for j in range(longest)]
    # transfer matrix of every block
    t = np.repeat(np.eye(k)[None], nb, 0)
    for j in range(longest if int(n_blocks.max()) > 1 else 0):
        b = live[j]
        m = (t[b] @ a) * e[start[b] + j][:, None, :]
        t[b] = m / m.max(axis=(1, 2), keepdims=True)
    # borders: what comes into a block from the left, and from the right
    left, right = np.full((nb, k), 1.0 / k), np.ones((nb, k))
    for j in range(1, int(n_blocks.max())):
        b = first_block[n_blocks > j] + j
        x = np.einsum("bi,bij->bj", left[b - 1], t[b - 1])
        left[b] = x / x.sum(1, keepdims=True)
        last = (first_block + n_blocks - 1 - j)[n_blocks > j]
        y = np.einsum("bij,bj->bi", t[last + 1], right[last + 1])
        right[last] = y / y.sum(1, keepdims=True)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    x = left.copy()
    prior = np.empty_like(e)
    for j in range(longest):
        b = live[j]
        prior[start[b] + j] = x[b]
        y = (x[b] @ a) * e[start[b] + j]
        y /= y.sum(1, keepdims=True)
        x[b] = y
        alpha[start[b] + j] = y
    x = right.copy()
    for j in range(longest - 1, -1, -1):
        b = live[j]
        beta[start[b] + j] = x[b]
        y = (e[start[b] + j] * x[b]) @ a.T
        x[b] = y / y.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    right_side = e * beta
    z = np.einsum("ni,ij,nj->n", prior, a, right_side)
    pairs = a * (prior.T @ (right_side / z[:, None]))
    return post, pairs


class Crf:
    """Languages, feature weights, transitions and lexicon."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray, lexicon: dict[bytes, tuple[int, ...]]):
        self.langs, self.weights, self.trans, self.lexicon = langs, weights, trans, lexicon


def fit(texts: list[bytes], langs_of: list[str], seed: int = 5) -> Crf:
    """Stochastic gradient (Adagrad) on the conditional likelihood of chains of two documents."""
    langs = sorted(set(langs_of))
    k, code = len(langs), {x: i for i, x in enumerate(langs)}
    weights, trans = np.zeros((BUCKETS, k)), np.zeros((k, k))
    docs = [(split_words(t), code[x]) for t, x in zip(texts, langs_of)]
    docs = [(w, y) for w, y in docs if w]
    counts: list[dict[bytes, int]] = [{} for _ in langs]
    for w, y in docs:
        for x in set(w):
            counts[y][x] = counts[y].get(x, 0) + 1
    lexicon: dict[bytes, tuple[int, ...]] = {}
    for y, c in enumerate(counts):
        for x, _ in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:LEXICON]:
            lexicon[x] = (*lexicon.get(x, ()), y)
    model = Crf(langs, weights, trans, lexicon)
    if k < 2 or not docs:
        return model
    vocab: dict[bytes, int] = {}
    coded = [(np.array([vocab.setdefault(x, len(vocab)) for x in w]), y) for w, y in docs]
    idx, sizes = _flat(list(vocab), lexicon)
    begin = np.cumsum(sizes) - sizes
    gw, gt = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(coded))
        for lo in range(0, len(order), 100):
            some = [coded[i] for i in order[lo : lo + 100]]
            words = np.concatenate([w for w, _ in some])
            gold = np.concatenate([np.full(len(w), y) for w, y in some])
            lens = np.array([sum(len(w) for w, _ in some[i : i + 2]) for i in range(0, len(some), 2)])
            uniq, inv = np.unique(words, return_inverse=True)
            at = np.concatenate([np.arange(begin[u], begin[u] + sizes[u]) for u in uniq])
            feats, size = idx[at], sizes[uniq]
            em = np.add.reduceat(weights[feats], np.cumsum(size) - size, axis=0)
            post, pairs = forward_backward(em[inv], lens, trans)
            post[np.arange(len(gold)), gold] -= 1
            seen = np.zeros_like(trans)
            np.add.at(seen, (gold[:-1], gold[1:]), 1)
            ends = np.cumsum(lens)[:-1]
            np.subtract.at(seen, (gold[ends - 1], gold[ends]), 1)
            word_g = np.stack([np.bincount(inv, weights=post[:, j], minlength=len(uniq)) for j in range(k)], 1)
            per = np.repeat(word_g, size, axis=0) / len(words)
            touched, where = np.unique(feats, return_inverse=True)
            g = np.stack([np.bincount(where, weights=per[:, j], minlength=len(touched)) for j in range(k)], 1) + 1e-7 * weights[touched]
            gw[touched] += g * g
            weights[touched] -= 0.3 * g / np.sqrt(gw[touched])
            g = (pairs - seen) / len(words)
            gt += g * g
            trans -= 0.1 * g / np.sqrt(gt)
    return model


def train(docs: DataFrame, learn: Column) -> Crf:
    """Learn from text and lang of a bounded sample of the rows that `learn` admits."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES) & learn).select("text", "lang", F.xxhash64("text").alias("h"))
    # the sample is drawn on hashes alone; only its own texts, a bounded number, go to the driver
    drawn = rows.select("h", "lang").distinct().orderBy("h", "lang").limit(TRAIN_ROWS)
    got = rows.join(F.broadcast(drawn), ["h", "lang"]).groupBy("h", "lang").agg(F.min("text").alias("text")).collect()
    rows = sorted(got, key=lambda r: (r["h"], r["lang"]))
    return fit([r["text"].encode() for r in rows], [r["lang"] for r in rows])


def label(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", with_words: bool = False) -> DataFrame:
    """(id, lang_pred, score) of every row, and with_words the label of each word: words array<string>, word_langs array<string>."""
    langs, weights, trans, lexicon = model.langs, model.weights.astype(np.float32), model.trans, model.lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        table = np.zeros((1024, max(len(langs), 1)), dtype=np.float32)
        for b in batches:
            texts = texts_of(b, text_col)
            split = [split_words(t) if has_letter(t) else [] for t in texts]
            if len(known) > CACHE:
                known.clear()
            new = list({w for s in split for w in s if w not in known})
            if new and langs:
                if len(known) + len(new) > len(table):
                    table = np.concatenate([table, np.zeros((len(known) + len(new), table.shape[1]), dtype=np.float32)])
                for lo in range(0, len(new), 20_000):
                    some = new[lo : lo + 20_000]
                    table[len(known) : len(known) + len(some)] = emissions(some, weights, lexicon)
                    base = len(known)
                    known.update((w, base + i) for i, w in enumerate(some))
            preds, scores, word_langs = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            rows = np.array([i for i, s in enumerate(split) if s], dtype=np.int64)
            if len(rows) and langs:
                lens = np.array([len(split[i]) for i in rows])
                ids = np.fromiter((known[w] for i in rows for w in split[i]), dtype=np.int64, count=int(lens.sum()))
                post, _ = forward_backward(table[ids].astype(float), lens, trans)
                begin = np.cumsum(lens) - lens
                mean = np.add.reduceat(post, begin, axis=0) / lens[:, None]
                best = mean.argmax(1)
                scores[rows] = np.clip(mean.max(1), 0, 1)
                for i, j in zip(rows.tolist(), best.tolist()):
                    preds[i] = langs[j]
                if with_words:
                    each = post.argmax(1)
                    for i, at, n in zip(rows.tolist(), begin.tolist(), lens.tolist()):
                        word_langs[i] = [langs[j] for j in each[at : at + n]]
            cols = [b.column(id_col), pa.array(preds, type=pa.string()), pa.array(scores, type=pa.float64())]
            names = [id_col, "lang_pred", "score"]
            if with_words:
                cols += [pa.array([[w.decode("utf-8", "replace") for w in s] if word_langs[i] else [] for i, s in enumerate(split)], type=pa.list_(pa.string())), pa.array(word_langs, type=pa.list_(pa.string()))]
                names += ["words", "word_langs"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", words array<string>, word_langs array<string>" if with_words else ""
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, lang_pred string, score double{more}")
