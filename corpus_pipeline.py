"""From raw documents to packed training sequences, one operator a stage.

Toxic documents go; recurring template lines go; of near copies one document stays; documents that hold a benchmark
window go; what is left is packed. Every stage is written as Parquet and read again before the next.

Null and empty texts are documents like any other (one empty text stays after near-dedup); repeated rows and ties in
doc_id are handled as each stage's operator states; an empty table gives an empty result; extra columns of any name
pass through all stages but the last, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomquery.llm import contamination, packing, simhash, templates, toxicity
from loomquery.llm.common import fold
from loomquery.llm.queries import tokenizer_path
from loomquery.session import materialize, table

#: Some stages (learned scores, fingerprints, token ids) cannot be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.7."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, model, 0.7)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring template lines; n_chars follows where a line went."""
    return templates.drop_recurring(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_template_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
