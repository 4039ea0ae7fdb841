"""State that changes later answers: concepts, examples, aliases, corrections, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions.kernels import clamp


def concept_confidence(pos: Column, neg: Column) -> Column:
    return clamp(F.least(F.lit(0.98), 0.5 + 0.08 * pos - 0.05 * neg))


def teach(examples: DataFrame, taught: DataFrame, keys: list[str]) -> DataFrame:
    """Union of examples and newly taught rows: a row taught by a user replaces an automatic one of the same key."""
    both = examples.withColumn("__new", F.lit(0)).unionByName(taught.withColumn("__new", F.lit(1)))
    rest = [c for c in examples.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct((F.col("source") == "user").cast("int"), "__new")).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def demote_rivals(examples: DataFrame, file_col: str, concept: str, role: str = "role") -> DataFrame:
    """The file's positives for other concepts become negatives once it is taught `concept`."""
    taught = examples.where((F.col("concept") == concept) & (F.col(role) == "positive")).select(F.col(file_col).alias("__f")).distinct()
    got = examples.join(taught, F.col(file_col) == F.col("__f"), "left")
    rival = F.col("__f").isNotNull() & (F.col("concept") != concept) & (F.col(role) == "positive")
    return got.withColumn(role, F.when(rival, "negative").otherwise(F.col(role))).drop("__f")


def merge_registry(concepts: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(id, keep): every concept with the one that its key's duplicates are merged into."""
    keep = concepts.groupBy(key.alias("__k")).agg(F.min(id_col).alias("keep"))
    return concepts.withColumn("__k", key).join(keep, "__k").select(id_col, "keep")


def rename_subtree(paths: DataFrame, col: str, old: str, new: str) -> DataFrame:
    """Rename a category and all below it; the old path stays as an alias."""
    c = F.col(col)
    hit = (c == old) | c.startswith(old + "/")
    return paths.withColumn("alias", F.when(hit, c)).withColumn(col, F.when(hit, F.concat(F.lit(new), F.substring(c, len(old) + 1, 1_000_000))).otherwise(c))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of changes replace rows of current with the same key."""
    return current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)
