"""Structured Streaming forms of the event operators: windows with watermarks, sessions, and keyed job state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomquery.session import shared_dir


def stream(spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet folder as a stream; its schema is that of the files there now. files_per_batch bounds a micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(f"{path}/{glob}" if glob else path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    got = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)
    for f in got.schema.fields:  # event time needs a time zone
        if f.dataType.simpleString() == "timestamp_ntz":
            got = got.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return got


def tumbling(events: DataFrame, ts: str = "ts", length: str = "1 day", late: str = "1 day", key: str = "event_type") -> DataFrame:
    """Counts and sums of a window and key, with late rows admitted up to `late`."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, length), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "6 hours", late: str = "1 day", key: str = "user_id") -> DataFrame:
    got = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def fold_jobs(events: DataFrame) -> DataFrame:
    """(user_id, n_events, errors, last_type): running state of every key over micro-batches."""

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, errors, last_ts, last_id, last = state.get if state.exists else (0, 0, None, -1, "")
        for pdf in pdfs:
            for r in pdf.sort_values(["ts", "event_id"]).itertuples():
                n, errors = n + 1, errors + (r.event_type == "error")
                at = r.ts.value
                if last_ts is None or (at, r.event_id) > (last_ts, last_id):
                    last_ts, last_id, last = at, int(r.event_id), r.event_type
        state.update((n, errors, last_ts, last_id, last))
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "errors": [errors], "last_type": [last]})

    out = "user_id long, n_events long, errors long, last_type string"
    keep = "n long, errors long, last_ts long, last_id long, last string"
    return events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(run, out, keep, "update", GroupStateTimeout.NoTimeout)


def discover(files: DataFrame, known: DataFrame, key: str, artifacts: list[str]) -> DataFrame:
    """Jobs for the files of a stream that are not known yet: one a file and artifact, in the artifacts' order."""
    fresh = files.join(known.select(key), key, "left_anti")
    jobs = F.explode(F.array(*[F.struct(F.lit(a).alias("artifact"), F.lit(i).alias("priority")) for i, a in enumerate(artifacts)]))
    return fresh.select(key, jobs.alias("__job")).select(key, "__job.artifact", "__job.priority")


def run_to_table(df: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there now into the shared folder and read the result back: all rows in append mode, the
    last batch in complete mode, and the newest row of each of `keys` in update mode."""
    import uuid

    spark = df.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").outputMode("append").trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda b, i: b.withColumn("__batch", F.lit(i)).write.mode("overwrite").parquet(f"{base}/out/b={i}")).option("checkpointLocation", f"{base}/ck").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(f"{base}/out")
    got = spark.read.parquet(f"{base}/out/b=*")
    if mode == "complete":
        return got.where(F.col("__batch") == got.agg(F.max("__batch")).first()[0]).select(*df.columns)
    if not keys:
        raise ValueError("update mode needs the keys whose newest row stays")
    newest = got.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "__batch").alias("__row"))
    return newest.select(*[F.col("__row").getField(c).alias(c) for c in df.columns])
