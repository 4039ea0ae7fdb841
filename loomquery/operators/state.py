"""Folding event logs into state: latest-wins, clears, clamped sums, merges, manifests, job queues and leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomquery.functions.kernels import clamp
from loomquery.operators.topk import first_per_key

#: Deltas of feedback actions.
FEEDBACK = {"same": 0.15, "texture": 0.08, "promote": 0.10, "wrong": -0.55, "demote": -0.15, "not_similar": -0.35}
#: What an artifact needs before it can be made.
DEPENDENCIES = {"SEMANTIC": "TEXTURE", "DNA": "SEMANTIC"}
MAX_ATTEMPTS = 3


def latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    return first_per_key(df, keys, F.desc(ts), F.desc(tie))


def after_last_clear(df: DataFrame, key: str, ts: str, tie: str, is_clear: Column) -> DataFrame:
    """Rows that come after their key's newest clear, clears left out."""
    w = W.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("__clears", F.sum(is_clear.cast("int")).over(w)).where("__clears = 0").drop("__clears")


def clamped_sum(df: DataFrame, keys: list[str], delta: Column, lo: float = -0.70, hi: float = 0.20) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.greatest(F.lit(lo), F.least(F.lit(hi), F.sum(delta))), 6).alias("delta"))


def manifest_diff(known: DataFrame, seen: DataFrame, key: str, size: str, mtime: str) -> DataFrame:
    """(key, change): new, missing, changed (size differs, or mtime by over half a second) or same."""
    a, b = known.alias("a"), seen.alias("b")
    change = (
        F.when(F.col(f"a.{key}").isNull(), "new").when(F.col(f"b.{key}").isNull(), "missing")
        .when((F.col(f"a.{size}") != F.col(f"b.{size}")) | (F.abs(F.col(f"a.{mtime}") - F.col(f"b.{mtime}")) > 0.5), "changed").otherwise("same")
    )
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"))


def merge_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field-wise upsert: a new value that is neither null nor empty wins, otherwise the old one stays."""
    o, n = old.alias("o"), new.alias("n")
    pick = [F.coalesce(F.when(F.col(f"n.{f}").cast("string") != "", F.col(f"n.{f}")), F.col(f"o.{f}")).alias(f) for f in fields]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *pick)


def job_state(events: DataFrame, keys: list[str], ts: str, tie: str, kind: str, failed: str, done: str) -> DataFrame:
    """Fold of a job's events: done if its last event is `done`, failed for good after three failures, else pending."""
    last = F.max_by(F.col(kind), F.struct(ts, tie))
    failures = F.sum((F.col(kind) == failed).cast("int"))
    state = F.when(last == done, "done").when(failures >= MAX_ATTEMPTS, "failed_permanent").when(last == failed, "retry").otherwise("pending")
    return events.groupBy(*keys).agg(failures.cast("int").alias("attempts"), state.alias("state"))


def retry_delay(attempts: Column) -> Column:
    return F.least(F.lit(30), attempts)


def fair_order(jobs: DataFrame, source: str, *order: Column | str) -> DataFrame:
    """Round-robin over sources: `round` is a job's turn in its source, `claim` its place overall."""
    turn = jobs.withColumn("round", F.row_number().over(W.partitionBy(source).orderBy(*order)))
    return turn


def claim_fair(jobs: DataFrame, source: str, limit: int, *order: Column | str) -> DataFrame:
    """The first `limit` jobs by (round, source): no job beyond turn `limit` of its source can be among them."""
    turn = fair_order(jobs, source, *order).where(F.col("round") <= limit)
    return turn.orderBy("round", source).limit(limit)


def feedback_score(score: Column, delta: Column, wrong: Column) -> Column:
    """Score after feedback: wrong results sink to .12 at most, others move by their delta."""
    return F.when(wrong, F.least(score, F.lit(0.12))).otherwise(clamp(score + F.coalesce(delta, F.lit(0.0))))


def latest_or_cleared(events: DataFrame, keys: list[str], ts: str, tie: str, value: str, is_clear: Column) -> DataFrame:
    """Each key's newest value; keys whose newest event is a clear have none and are left out."""
    newest = F.max(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), is_clear.alias("clear"), F.col(value).alias("value")))
    return events.groupBy(*keys).agg(newest.alias("__n")).where("not __n.clear").select(*keys, F.col("__n.value").alias(value))


def one_way_status(events: DataFrame, keys: list[str], at: Column, kind: Column) -> DataFrame:
    """Pipeline status from events `processing`, `done`, `failed` and `reset`: done and failed stay until a reset, whatever
    else starts; a start counts only since then. Other events change nothing."""
    fixed = kind.isin("done", "failed", "reset")
    last, since, busy = F.max_by(F.when(fixed, kind), F.when(fixed, at)), F.max(F.when(fixed, at)), F.max(F.when(kind == "processing", at))
    status = F.when(last.isin("done", "failed"), last).when(busy.isNotNull() & (since.isNull() | (busy > since)), "processing").otherwise("pending")
    return events.groupBy(*keys).agg(status.alias("status"))


def audit_findings(events: DataFrame, keys: list[str], at: Column, status: Column, *fields: str) -> DataFrame:
    """Findings of an audit by their newest event; one that was resolved or dismissed is not reopened by a pending one."""
    settled = F.max_by(F.when(status != "pending", status), F.when(status != "pending", at))
    newest = F.max_by(status, at)
    kept = F.when((newest == "pending") & settled.isin("resolved", "dismissed"), settled).otherwise(newest)
    return events.groupBy(*keys).agg(kept.alias("status"), *[F.max_by(f, at).alias(f) for f in fields])
