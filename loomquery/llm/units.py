"""Substring dedup by hashing units of text: lines, and the sentences in them.

A unit is a whole line (a paragraph, where texts break lines at paragraphs only) that is not blank, or, for repeats
inside lines, a sentence of at least MIN_WORDS words; lower case and single spaces normalise it. Digests of 128 bits are
grouped over all documents; the occurrence that comes first by (document id, nulls last; place in the input; start)
stays, and every other is a repeat. A repeated line is one span, whatever its sentences are. Repeats that follow each
other, with nothing between them but shorter sentences, form a passage; passages of at least MIN_PASSAGE words are
removed. Shorter ones, such as a licence line alone, are left to line dedup; min_passage=1 removes every repeat.
Removed spans keep their offsets in the original text (code points, end exclusive) and name the document that keeps
the unit.

Null and empty texts have no units; repeated rows are documents of their own, in the order of the input; ties in id go
to the row that comes first; texts of any length are read whole; an empty table gives an empty result; columns of any
name are kept as they are, and `removed` is added under the first free name of removed, removed_, ...
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomquery.llm.common import arrow_map, numbered, restored
from loomquery.session import materialize

MIN_WORDS, MIN_PASSAGE = 6, 20
_LINE = re.compile(r"[^\n]+")
_UNIT = re.compile(r"[^\s][^\n.!?]*(?:[.!?]+(?=[^\s.!?])[^\n.!?]*)*[.!?]*")


def _placed(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes, int, bool, int]]:
    """(start, end, words, digest, start of the line, whether it is the whole line, number) of the units of a text.
    Lines and sentences are numbered in one sequence; a line has the number of its first sentence."""
    no = 0
    for line in _LINE.finditer(text):
        w = line[0].lower().split()
        if not w:
            continue
        raw = line[0].rstrip()
        at, end = line.end() - len(line[0].lstrip()), line.start() + len(raw)
        yield at, end, len(w), xxhash.xxh3_128_digest(" ".join(w).encode()), at, True, no
        n = 0
        for m in _UNIT.finditer(text, at, end) if len(w) >= min_words else ():
            w = m[0].lower().split()
            z = m.start() + len(m[0].rstrip())
            if len(w) >= min_words and (m.start(), z) != (at, end):
                yield m.start(), z, len(w), xxhash.xxh3_128_digest(" ".join(w).encode()), at, False, no + n
                n += 1
        no += max(n, 1)


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of a text: each line, then the sentences in it."""
    return (x[:4] for x in _placed(text, min_words))


def unit_table(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __row, start, end, n_words, line, no, upto, whole, h1, h2) of every unit of rows (__id, __row, __text): line
    is where its line starts, and it has the numbers from no to before upto."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cols, lines = [], ([], [], [], [], [], [], [], []), []
            for i, t in enumerate(b.column("__text").to_pylist()):
                for s, e, n, d, line, whole, no in _placed(t or "", min_words):
                    row.append(i)
                    for c, x in zip(cols, (s, e, n, line, no, whole, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)), strict=True):
                        c.append(x)
            upto = [x + 1 for x in cols[4]]
            for i in range(len(row)):  # a line ends where its last sentence does
                if cols[5][i]:
                    lines.append(i)
                elif lines:
                    upto[lines[-1]] = upto[i]
            at = pa.array(row, type=pa.int64())
            out = pa.RecordBatch.from_arrays(
                [b.column("__id").take(at), b.column("__row").take(at), *(pa.array(c, type=pa.int32()) for c in (*cols[:5], upto)), pa.array(cols[5], type=pa.bool_()), *(pa.array(c, type=pa.int64()) for c in cols[6:])],
                ["__id", "__row", "start", "end", "n_words", "line", "no", "upto", "whole", "h1", "h2"],
            )
            for lo in range(0, out.num_rows, 50_000):
                yield out.slice(lo, 50_000)

    kind = rows.schema["__id"].dataType.simpleString()
    return arrow_map(rows.select("__id", "__row", "__text"), run, f"__id {kind}, __row long, start int, end int, n_words int, line int, no int, upto int, whole boolean, h1 long, h2 long")


def _repeats(rows: DataFrame, min_words: int, min_passage: int) -> DataFrame:
    """(__id, __row, start, end, n_words, kept_id, kept_start, passage) of every unit to be removed."""
    every = materialize(unit_table(rows, min_words), "units")
    place = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"), F.col("start").alias("start"))
    first = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    first = materialize(first.select("h1", "h2", "first"), "first-units")
    joined = every.join(first, ["h1", "h2"])
    again = joined.where((F.col("__row") != F.col("first.row")) | (F.col("start") != F.col("first.start")))
    # a removed line covers its sentences, each of which its first copy holds as well
    covered = F.max("whole").over(W.partitionBy("__row", "line"))
    again = again.withColumn("covered", covered).where(F.col("whole") | ~F.col("covered"))
    order = W.partitionBy("__row").orderBy("start")
    breaks = F.coalesce(F.lag("upto").over(order) != F.col("no"), F.lit(True)).cast("int")
    runs = again.withColumn("breaks", breaks).withColumn("passage", F.sum("breaks").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int"))
    words = F.sum("n_words").over(W.partitionBy("__row", "passage"))
    return runs.withColumn("words", words).where(F.col("words") >= min_passage).select(
        "__id", "__row", "start", "end", "n_words", F.col("first.id").alias("kept_id"), F.col("first.start").alias("kept_start"), "passage"
    )


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """(id, start, end, n_words, kept_id, kept_start, passage) of every unit that is to be removed."""
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    return _repeats(rows, min_words, min_passage).select(F.col("__id").alias(id_col), "start", "end", "n_words", "kept_id", "kept_start", "passage")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """docs without their repeated passages, and removed array<struct<start, end>> of the spans cut out."""
    rows = numbered(docs, id_col, text_col, "unit-rows")
    per_row = _repeats(rows, min_words, min_passage).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cut"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    got = rows.join(materialize(per_row, "removed").hint("shuffle_hash"), "__row", "left").select("__text", "__rest", F.coalesce("__cut", none).alias("__cut"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b.column("__text").to_pylist(), b.column("__cut").to_pylist(), strict=True):
                if t is not None and spans:
                    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(t)]
                    t = "".join(t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string()), b.column("__rest"), b.column("__cut")], ["__text", "__rest", "__cut"])

    name = "removed"
    while name in docs.columns:
        name += "_"
    return arrow_map(got, cut, got.schema).select(*restored(docs, text_col), F.col("__cut").alias(name))
