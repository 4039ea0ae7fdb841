"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Only lengths matter to a packing, and there are at most `capacity` different ones, so the instance is the histogram of
piece lengths: its size is bounded by the capacity, however many pieces there are. The reduction fixes bins that
provably dominate every other bin holding their largest piece; best-fit decreasing places what remains, on counts.
Runs of equal bins become rows (pattern, first bin, bins), and pieces find their place by their rank among the pieces
of their length, which two-level counting gives without bringing a length's pieces together in one task.

Null texts count as empty and give one piece with the end id alone; repeated rows and repeated ids are packed once
each; pieces of one length are told apart by place only, so ties play no part; an empty table gives an empty result; a
text of any length is tokenised whole and only cut beyond the capacity; of docs' columns only id and text are read.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomquery.llm.common import arrow_map, held, texts_of
from loomquery.session import materialize

CAPACITY, END_ID = 2048, 0
#: Entries that a worker's caches of chunks and of words may hold.
CACHE = 700_000

#: Punctuation that the vocabulary's pre-tokeniser takes as one run; ' opens its own pieces and <|> mark special tokens.
_MARKS = r"[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*"
_SIMPLE = re.compile(rf"({_MARKS})([A-Za-zÀ-ÖØ-öø-ÿ]+)({_MARKS})\Z")

#: What the chunk-wise way takes for granted; a file that says otherwise is encoded text by text.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_chunks(path: str) -> bool:
    """Whether a tokenizer file parts texts as the chunk-wise way needs: nothing joined across white space, every word
    closed by its mark, punctuation in runs, lower case, and special tokens without white space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0]
    return (
        model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("unk_token") and not model.get("continuing_subword_prefix")
        and not any(spec.get(k) for k in ("truncation", "padding", "post_processor")) and spec.get("normalizer") == _NORMALIZER and pre.get("type") == "Sequence"
        and len(pre["pretokenizers"]) == 2 and first.get("pattern") == {"Regex": _PIECES} and first.get("behavior") == "Removed" and first.get("invert") is True
        and pre["pretokenizers"][1].get("type") == "ByteLevel" and not pre["pretokenizers"][1].get("add_prefix_space") and not pre["pretokenizers"][1].get("use_regex")
        and all(re.fullmatch(r"<\|[^\s<>]*\|>", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    )


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to the tokenizer's own.

    Where by_chunks() holds, a text's ids are the concatenation of its chunks' between ASCII white space, and known
    chunks are looked up. Plain words are encoded many at a time, and their ids parted at the mark that closes every
    word. Any other tokenizer encodes text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunkwise = by_chunks(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        for lo in range(0, len(words), 500):
            some = words[lo : lo + 500]
            ids = self._ids(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, at = ids.tobytes(), 0
                for word, cut in zip(some, (cuts * 4).tolist(), strict=True):
                    self.words[word] = raw[at:cut]
                    at = cut
            else:
                self.words.update((word, self._ids(word).tobytes()) for word in some)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.chunkwise:
            return [self._ids(t.decode()).tobytes() for t in texts]
        split = [t.split() for t in texts]
        known, words = self.chunks, self.words
        fresh = list(set().union(*split).difference(known)) if split else []
        plain = []
        for c in fresh:
            if m := _SIMPLE.match(c.decode()):
                before, word, after = m.groups()
                plain.append((c, before, word.lower(), after))
            else:
                known[c] = self._ids(c.decode()).tobytes()
        need = list({w for p in plain for w in p[1:]}.difference(words))
        for w in need:
            if not w[0].isalpha():
                words[w] = self._ids(w).tobytes()
        self._learn([w for w in need if w[0].isalpha()])
        known.update([(c, words[before] + words[word] + words[after]) for c, before, word, after in plain])
        get = known.__getitem__
        out = [b"".join(map(get, s)) for s in split]
        for cache, new in ((known, fresh), (words, need)):  # a full cache keeps what it knows and lets the batch's own go
            if len(cache) > CACHE:
                for x in new:
                    del cache[x]
        return out


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(END_ID).to_bytes(4, "little")
        for b in batches:
            encoder = held(("encoder", tokenizer_path), lambda: Encoder(tokenizer_path))
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(texts_of(b, text_col))):
                ids += end
                for k, at in enumerate(range(0, len(ids), capacity * 4)):
                    part = ids[at : at + capacity * 4]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col).take(pa.array(row, type=pa.int64())), pa.array(piece, type=pa.int32()), *(pa.array(x, type=pa.int64()) for x in (start, length, crc))],
                [id_col, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class _Counts:
    """Lengths that remain, with their counts, in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.order.remove(length)

    def at_most(self, room: int) -> int | None:
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for x in self.order:
            out += [x] * min(self.n[x], k - len(out))
            if len(out) == k:
                break
        return out


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix bins that dominate every feasible bin with the same largest piece; (patterns with counts, what remains).

    With largest piece j: alone, if nothing fits beside it; with k, if k fills the bin exactly, or if at most one more
    piece fits and k is the largest that does, or if at most two more fit and k is as large as any two that fit; with
    k and b, if at most two more fit, k and b fill the bin exactly, k is the largest piece that fits beside j, and no
    two pieces larger than b fit together (so of any two partners one goes into b's place and the other into k's).
    """
    left, fixed = _Counts(counts), []

    def fix(pattern: tuple[int, ...], n: int) -> None:
        fixed.append((pattern, n))
        for x in set(pattern):
            left.take(x, n * pattern.count(x))

    for j in sorted(counts, reverse=True):
        while left.n.get(j):
            n, room = left.n[j], capacity - j
            left.n[j] -= 1  # partners come from the other pieces
            if not left.n[j]:
                left.order.remove(j)
            k, low = left.at_most(room), left.smallest(3)
            left.n[j] += 1
            if left.n[j] == 1:
                insort(left.order, j)
            if k is None:
                fix((j,), n)
                continue
            pairs = min(n, left.n[k]) if k != j else n // 2
            one_more = len(low) < 2 or low[0] + low[1] > room
            two_more = len(low) < 3 or sum(low) > room
            if k == room or one_more:
                fix((j, k), max(pairs, 1))
                continue
            if two_more:
                rest = left.at_most(room - k)
                wider = left.order[bisect_right(left.order, rest) :] if rest is not None else []
                two_wide = (2 * wider[0] if left.n[wider[0]] > 1 else sum(wider[:2]) if len(wider) > 1 else capacity) if wider else capacity
                if rest is not None and rest + k == room and two_wide > room and len({j, k, rest}) == 3:
                    fix((j, k, rest), min(n, left.n[k], left.n[rest]))
                    continue
                best, others = 0, [x for x in left.order if x <= room]
                lo, hi = 0, len(others) - 1
                while lo <= hi:
                    if others[lo] + others[hi] <= room:
                        best = max(best, others[lo] + others[hi])
                        lo += 1
                    else:
                        hi -= 1
                if best <= k:
                    fix((j, k), max(pairs, 1))
                    continue
            break
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: open bins are grouped by (free room, pattern), the tightest takes a piece first."""
    open_by: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], room: int, n: int, least: int) -> None:
        if room < least:
            done.append((pattern, n))
            return
        if room not in open_by:
            open_by[room] = []
            insort(rooms, room)
        open_by[room].append([pattern, n])

    sizes = sorted((k for k, n in counts.items() if n), reverse=True)
    least = sizes[-1] if sizes else 0
    for size in sizes:
        n = counts[size]
        while n:
            i = next_room(rooms, size)
            if i is None:
                each = capacity // size
                if full := n // each:
                    put((size,) * each, capacity - each * size, full, least)
                    n -= full * each
                if n:
                    put((size,) * n, capacity - n * size, 1, least)
                    n = 0
                continue
            group = open_by[i][-1]
            each = min(i // size, n)
            bins = min(group[1], n // each)
            group[1] -= bins
            if not group[1]:
                open_by[i].pop()
                if not open_by[i]:
                    del open_by[i]
                    rooms.remove(i)
            put(group[0] + (size,) * each, i - each * size, bins, least)
            n -= bins * each
    return done + [(p, n) for groups in open_by.values() for p, n in groups]


def next_room(rooms: list[int], size: int) -> int | None:
    i = bisect_right(rooms, size - 1)
    return rooms[i] if i < len(rooms) else None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (descending lengths) with the number of bins of each, for a histogram of lengths."""
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first bin, offset, in a row): ranks first..first+ranks of a length fill bins in order."""
    used: dict[int, int] = {}
    out, first_bin = [], 0
    for pattern, bins in plan:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            k = pattern.count(length)
            out.append((length, used.get(length, 0), k * bins, first_bin, offset, k))
            used[length] = used.get(length, 0) + k * bins
            offset += k * length
        first_bin += bins
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence_id and offset; see the module's docstring."""
    pieces = materialize(tokenised_pieces(docs, tokenizer_path, capacity, id_col, text_col).withColumn("part", F.spark_partition_id()), "pieces")
    per_part = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = _slots(plan_bins(counts, capacity))
    spark = docs.sparkSession

    # rank of a piece among those of its length: pieces of lesser parts, then a local rank within the part
    before = per_part.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    local = pieces.withColumn("local", F.row_number().over(W.partitionBy("part", "length").orderBy(id_col, "piece", "start", "ids_crc32")) - 1)
    ranked = local.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local"))

    by_length: dict[int, list] = {}
    for s in slots:
        by_length.setdefault(s[0], []).append(s[1:])
    table = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in by_length.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            seq, off = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                here = np.flatnonzero(length == x)
                t = table.value[int(x)]
                s = t[np.searchsorted(t[:, 0], rank[here], side="right") - 1]
                at = rank[here] - s[:, 0]
                seq[here] = s[:, 2] + at // s[:, 4]
                off[here] = s[:, 3] + (at % s[:, 4]) * x
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    names = [id_col, "piece", "start", "length", "ids_crc32"]
    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(ranked.select(*names, "rank"), place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
