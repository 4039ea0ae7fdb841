"""Helpers of the llm operators: Arrow maps over texts, word splitting on bytes, training samples."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.session import materialize

#: Rows and bytes that a function is given at once; a longer row comes alone.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def _table() -> bytes:
    out = bytearray(b" " * 256)
    for i in range(256):
        if 65 <= i <= 90:
            out[i] = i + 32
        elif 48 <= i <= 57 or 97 <= i <= 122 or i >= 128:
            out[i] = i
    return bytes(out)


#: A-Z lower-cased; everything outside 0-9, a-z and non-ASCII becomes a space.
WORD_TABLE = _table()


def words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text whose A-Z are lower-cased."""
    return text.translate(WORD_TABLE).split()


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BATCH_ROWS rows and BATCH_BYTES bytes."""
    for b in batches:
        todo = [b]
        while todo:
            x = todo.pop()
            if x.num_rows > 1 and (x.num_rows > BATCH_ROWS or x.nbytes > BATCH_BYTES):
                half = x.num_rows // 2
                todo += [x.slice(half), x.slice(0, half)]
            else:
                yield x


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over bounded batches. What Spark sends at once is bounded by the session's maxRecordsPerBatch, which
    is lowered to BATCH_ROWS where it is higher, as whole texts can be long."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(lambda batches: f(bounded(batches)), schema)


def held(key: tuple, make: Callable):
    """One value a worker process, kept between its tasks. A function sent by value has no module to keep it in."""
    kept = vars(sys).setdefault("_loomquery_held", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def packed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """__id, __text, and __rest with all other columns: none of them can clash with those an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return [F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("__rest")]


def numbered(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """docs packed and written once with __row, a number that never changes when the frame is read again."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("__row"), *packed(docs, id_col, text_col)), name)


def restored(docs: DataFrame, text_col: str, text: Column | None = None, **changed: Column) -> list[Column]:
    """The columns of docs, from a frame made by packed(); text and changed stand in for columns' values."""
    text = F.col("__text") if text is None else text
    return [(text if c == text_col else changed[c] if c in changed else F.col("__rest").getField(c)).alias(c) for c in docs.columns]


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod (null id: remainder of the empty text, 0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def label_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, max_bytes: int) -> DataFrame:
    """(text, y) of at most `bound` labelled rows, chosen by a hash of their id; repeated texts count once.

    The bound holds for the sample a model is fitted on, never for what is scored. Rows longer than max_bytes are not
    learnt from (they are scored like any other). A doc_id labelled more than once takes its largest label.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return (
        docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
        .join(F.broadcast(ids), "doc_id").select("text", F.col("__y").alias("y")).groupBy("text").agg(F.max("y").alias("y"))
    )
