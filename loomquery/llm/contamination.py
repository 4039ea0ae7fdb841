"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of WINDOW consecutive words of a benchmark item (a shorter item is one window of its length).
For each pattern length m, the shift table holds for every block of two words the distance from its last place in any
pattern to the pattern's end; a block that is in no pattern lets the search skip m - 1 words. Where the shift is zero,
the bucket of that suffix block, parted by the pattern's first block, names the patterns to compare word by word.

Null and empty texts and items have no words; items with a null id take no part; repeated items count once; texts of
any length are searched whole; ties play no part, as every occurrence counts; an empty table gives an empty result, an
empty benchmark no hit; columns of any name are kept as they are. Patterns go to the workers in blocks of bounded size.
A benchmark of more than one block reads the texts once a block and joins the spans found, never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm.common import arrow_map, numbered, packed, restored, texts_of, words
from loomquery.session import materialize

WINDOW = 10
#: Bytes of item texts, and items, in one block of patterns.
BLOCK_BYTES, BLOCK_ITEMS = 4_000_000, 20_000


class WuManber:
    """Search for word windows; find() gives spans of words and the items they belong to."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        by_len: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            w = words(text)
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                by_len.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item)
        self.tables = [self._tables(m, patterns) for m, patterns in sorted(by_len.items())]

    @staticmethod
    def _tables(m: int, patterns: dict[tuple[bytes, ...], set[str]]):
        b = min(2, m)
        shift: dict[tuple[bytes, ...], int] = {}
        buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for p, owners in patterns.items():
            for end in range(b, m + 1):
                block = p[end - b : end]
                shift[block] = min(shift.get(block, m), m - end)
            buckets.setdefault(p[m - b :], {}).setdefault(p[:b], []).append((p, owners))
        return m, b, shift, buckets

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        spans, found = [], set()
        for m, b, shift, buckets in self.tables:
            end, n, skip = m, len(w), m - b + 1
            while end <= n:
                block = tuple(w[end - b : end])
                step = shift.get(block, skip)
                if step:
                    end += step
                    continue
                start = end - m
                for p, owners in buckets[block].get(tuple(w[start : start + b]), ()):
                    if tuple(w[start:end]) == p:
                        spans.append((start, end))
                        found |= owners
                end += 1
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, max_bytes: int = BLOCK_BYTES, max_items: int = BLOCK_ITEMS) -> Iterator[list[tuple[str, bytes]]]:
    """Item texts in blocks of bounded size, read one partition at a time."""
    held, size = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        text = r["text"].encode()
        held.append((r["i"], text))
        size += len(text)
        if size >= max_bytes or len(held) >= max_items:
            yield held
            held, size = [], 0
    if held:
        yield held


_SPANS = "array<struct<a: int, b: int>>"


def _search(rows: DataFrame, block: list[tuple[str, bytes]], window: int, only_hits: bool) -> DataFrame:
    """rows (any columns, __text among them) with __n_words, __spans (merged word spans hit) and __items in place of
    __text where only_hits asks for the rows with a hit, beside it otherwise."""
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    names = [c for c in rows.columns if not (only_hits and c == "__text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for b in batches:
            matcher = matcher or WuManber(block, window)
            n_words, spans, items = [], [], []
            for text in texts_of(b, "__text"):
                w = words(text)
                hit, found = matcher.find(w)
                n_words.append(len(w))
                spans.append([{"a": x, "b": y} for x, y in merged(hit)])
                items.append(sorted(found))
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n_words, type=pa.int64()), pa.array(spans, type=spans_type), pa.array(items, type=pa.list_(pa.string()))], [*names, "__n_words", "__spans", "__items"])
            yield out.filter(pa.array([bool(x) for x in spans], type=pa.bool_())) if only_hits else out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    return arrow_map(rows, run, f"{schema}, __n_words long, __spans {_SPANS}, __items array<string>")


def _joined(spans: list[list]) -> list[tuple[int, int]]:
    return merged([(x["a"], x["b"]) for some in spans for x in some])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs packed (__id, __text, __rest) with __n_words long, __spans array<struct<a, b>> and __items array<string>."""
    every = blocks(benchmark)
    first = next(every, [])
    second = next(every, None)
    if second is None:
        return _search(docs.select(*packed(docs, id_col, text_col)), first, window, False)
    rows = numbered(docs, id_col, text_col, "search-rows")
    found = None
    for block in chain([first, second], every):
        got = materialize(_search(rows.select("__row", "__text"), block, window, True), "block-hits")
        found = got if found is None else found.unionByName(got)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"a": x, "b": y} for x, y in _joined(s)] for s in b.column("s").to_pylist()]
            items = [sorted({x for some in s for x in some}) for s in b.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(spans, type=pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(items, type=pa.list_(pa.string()))], ["__row", "__spans", "__items"])

    per_row = arrow_map(found.groupBy("__row").agg(F.collect_list("__spans").alias("s"), F.collect_list("__items").alias("i")), join, f"__row long, __spans {_SPANS}, __items array<string>")
    counted = _search(rows, [], window, False).drop("__spans", "__items")
    whole = counted.join(materialize(per_row, "row-hits").hint("shuffle_hash"), "__row", "left").drop("__row")
    return whole.withColumn("__spans", F.coalesce("__spans", F.array().cast(_SPANS))).withColumn("__items", F.coalesce("__items", F.array().cast("array<string>")))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: words, words hit, items found and whether it is contaminated."""
    got = find(docs.select(id_col, text_col), benchmark, id_col, text_col)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return got.select(
        F.col("__id").alias(id_col), F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.size("__spans") > 0).alias("contaminated"), F.col("__items").alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, in which no benchmark window occurs."""
    return find(docs, benchmark, id_col, text_col).where(F.size("__spans") == 0).select(*restored(docs, text_col))
