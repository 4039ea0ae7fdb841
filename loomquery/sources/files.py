"""Sources and sinks: folder scans, format registry, JSON lines, partial hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions.text import extension

#: Extensions by capability.
FORMATS = {"raster": ["jpg", "jpeg", "png", "bmp", "webp", "gif"], "layered": ["psd", "psb", "tif", "tiff"], "vector": ["ai", "eps", "svg", "pdf"], "page": ["html", "htm"]}


def scan_folder(spark: SparkSession, path: str, extensions: list[str] | None = None, ignored: list[str] | None = None) -> DataFrame:
    """(path, file_size, mtime) of the files below a folder, by extension in any case, without paths that hold an ignored
    part; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    got = reader.load(path).select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"))
    if extensions:
        got = got.where(extension("path").isin([e.lower() for e in extensions]))
    for part in ignored or []:
        got = got.where(~F.col("path").contains(part))
    return got


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, k) for k, es in FORMATS.items() for e in es], "extension string, capability string")


def with_format(df: DataFrame, path_col: str) -> DataFrame:
    """The capability of each path's extension; `unsupported` where there is none."""
    dim = F.broadcast(formats(df.sparkSession))  # a fixed table of a few rows
    got = df.withColumn("extension", extension(path_col)).join(dim, "extension", "left")
    return got.withColumn("capability", F.coalesce("capability", F.lit("unsupported")))


def partial_hash(text: Column, size: Column, head: int = 200, tail: int = 200) -> Column:
    """Hash of the beginning, the end and the size."""
    return F.sha2(F.concat(F.substring(text, 1, head), F.substring(text, -tail, tail), size.cast("string")), 256)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as the frame has partitions."""
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
