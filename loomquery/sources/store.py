"""Tables that are replaced as a whole, grow by new keys, or change by partition, each readable at any time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED = "version string, at long, rows long"


def publish(df: DataFrame, root: str, at: int) -> None:
    """Write a version of a table and then announce it: readers see the version before or this one, never a part of it."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{version}")
    spark = df.sparkSession
    n = spark.read.parquet(f"{root}/data/{version}").count()
    spark.createDataFrame([(version, at, n)], PUBLISHED).coalesce(1).write.mode("append").json(f"{root}/published")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest announced version; one row of the announcements reaches the driver."""
    newest = spark.read.schema(PUBLISHED).json(f"{root}/published").agg(F.max_by("version", F.struct("at", "version"))).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no version is published in {root}")
    return spark.read.parquet(f"{root}/data/{newest}")


def append_new(df: DataFrame, path: str, key: str, known: DataFrame | None = None) -> None:
    """Append the rows whose key is not known yet, one a key (the smallest); rows that are there stay as they are."""
    row = df.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("__row"))
    fresh = row if known is None else row.join(known.select(key), key, "left_anti")
    fresh.select(*[F.col(c) if c == key else F.col("__row").getField(c).alias(c) for c in df.columns]).write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that df holds rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def report_rows(df: DataFrame, *cols: str) -> DataFrame:
    """(html): a table row of each row, with the reserved characters written out."""
    plain = [F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")) for c in cols]
    cells = [x for p in plain for x in (F.lit("<td>"), p, F.lit("</td>"))]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))
