"""Session helpers shared by every operator: table reads and lineage cuts in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a dataset folder through Spark only (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables under this size may come as one row group, which is one task however many cores there are.
FEW_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt out over all cores, ahead of costly work on texts; larger ones have splits enough."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < FEW_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder stands in on a
    local master (tests); on a cluster no executor would see it, so that raises."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomquery-"))
        found = sc.getCheckpointDir()
    return found


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; Spark removes it when the frame is no longer referenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
