"""Queries of logs, feedback and queues: latest-wins, clears, clamps, claims, rates, percentiles, merges of lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomquery.operators import state, topk
from loomquery.plans.registry import register
from loomquery.session import table


@register("latest_wins", "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_wins(spark, sf):
    """Newest row of every key, as an aggregate with map-side partials, so that a hot key is not sorted in one task."""
    e = table(spark, sf, "events")
    best = e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("value", "event_id"), F.struct("ts", "event_id")).alias("b"))
    return best.select("user_id", "event_type", "b.value", "b.event_id")


@register("clear_reset_state", """WITH c AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS clears FROM events)
SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS purchases FROM c WHERE clears = 0 GROUP BY user_id""")
def clear_reset_state(spark, sf):
    """State of a key after its newest clear event: the clear's time by an aggregate, then one comparison a row."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    last = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("at").alias("cleared"))
    live = e.join(last, "user_id", "left").where("cleared is null or at > cleared")
    return live.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("purchases"))


_DELTA = "CASE event_type WHEN 'purchase' THEN 0.15 WHEN 'click' THEN 0.08 WHEN 'error' THEN -0.55 WHEN 'view' THEN -0.15 ELSE 0 END"


def _delta():
    t, f = F.col("event_type"), state.FEEDBACK
    return F.when(t == "purchase", f["same"]).when(t == "click", f["texture"]).when(t == "error", f["wrong"]).when(t == "view", f["demote"]).otherwise(0.0)


@register("feedback_clamp", f"SELECT user_id, round(greatest(-0.7, least(0.2, sum({_DELTA}))), 6)::DOUBLE AS delta FROM events WHERE value > 60 GROUP BY user_id")
def feedback_clamp(spark, sf):
    return state.clamped_sum(table(spark, sf, "events").where("value > 60"), ["user_id"], _delta())


@register("memory_overlay", f"""WITH d AS (SELECT user_id, greatest(-0.7, least(0.2, sum({_DELTA}))) AS delta, bool_or(event_type = 'error' AND value > 90) AS wrong FROM events WHERE value > 60 GROUP BY user_id), b AS (SELECT user_id, avg(value) / 100 AS score FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN coalesce(wrong, false) THEN least(score, 0.12) ELSE greatest(0, least(1, score + coalesce(delta, 0))) END, 6)::DOUBLE AS score FROM b LEFT JOIN d USING (user_id)""")
def memory_overlay(spark, sf):
    """Scores under the feedback overlay: wrong ones sink, the rest move by their clamped delta."""
    e = table(spark, sf, "events")
    f = e.where("value > 60")
    d = state.clamped_sum(f, ["user_id"], _delta()).join(f.groupBy("user_id").agg(F.bool_or((F.col("event_type") == "error") & (F.col("value") > 90)).alias("wrong")), "user_id")
    b = e.groupBy("user_id").agg((F.avg("value") / 100).alias("score"))
    return b.join(d, "user_id", "left").select("user_id", F.round(state.feedback_score(F.col("score"), F.col("delta"), F.coalesce("wrong", F.lit(False))), 6).alias("score"))


@register("weight_discriminative", """WITH x AS (SELECT label, toxic, unnest(range(8)) AS d, unnest(embedding[1:8]) AS v FROM embeddings JOIN labels ON vec_id = doc_id)
SELECT d::INT AS d, round(avg(CASE WHEN toxic = 1 THEN v::DOUBLE END) - avg(CASE WHEN toxic = 0 THEN v::DOUBLE END), 6) AS gain, round(greatest(0.02, least(0.6, 0.125 + 0.12 * (avg(CASE WHEN toxic = 1 THEN v::DOUBLE END) - avg(CASE WHEN toxic = 0 THEN v::DOUBLE END)))), 6) AS weight FROM x GROUP BY d""")
def weight_discriminative(spark, sf):
    """Weight updates from the mean difference of each component between positive and negative feedback."""
    x = table(spark, sf, "embeddings").join(table(spark, sf, "labels").select("doc_id", "toxic"), F.col("vec_id") == F.col("doc_id")).select("toxic", F.posexplode(F.slice("embedding", 1, 8)).alias("d", "v"))
    v = F.col("v").cast("double")
    gain = F.avg(F.when(F.col("toxic") == 1, v)) - F.avg(F.when(F.col("toxic") == 0, v))
    return x.groupBy("d").agg(F.round(gain, 6).alias("gain"), F.round(F.greatest(F.lit(0.02), F.least(F.lit(0.6), 0.125 + 0.12 * gain)), 6).alias("weight"))


@register("acceptance_domains", """SELECT event_type, sum(CASE WHEN CASE event_type WHEN 'signup' THEN true WHEN 'purchase' THEN value >= 18 WHEN 'click' THEN value >= 28 WHEN 'view' THEN value >= 20 ELSE value >= 60 END THEN 1 ELSE 0 END)::BIGINT AS accepted, count(*) AS n FROM events GROUP BY event_type""")
def acceptance_domains(spark, sf):
    """Acceptance with a threshold of its own for each kind of evidence."""
    t, v = F.col("event_type"), F.col("value")
    ok = F.when(t == "signup", F.lit(True)).when(t == "purchase", v >= 18).when(t == "click", v >= 28).when(t == "view", v >= 20).otherwise(v >= 60)
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(ok.cast("long")).alias("accepted"), F.count(F.lit(1)).alias("n"))


@register("capped_topk", "WITH m AS (SELECT event_id, value FROM events WHERE event_type = 'signup' AND value > 95), r AS (SELECT event_id, value FROM events WHERE NOT (event_type = 'signup' AND value > 95) ORDER BY value DESC, event_id LIMIT greatest(0, 500 - (SELECT count(*) FROM m))) SELECT * FROM m UNION ALL SELECT * FROM r")
def capped_topk(spark, sf):
    """A list of at most 500: mandatory rows first, the best others in the room that is left."""
    e = table(spark, sf, "events")
    return topk.capped(e, (F.col("event_type") == "signup") & (F.col("value") > 95), 500, F.desc("value"), "event_id").select("event_id", "value")


@register("per_class_cap", "SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INT AS rank FROM events) WHERE rank <= 12")
def per_class_cap(spark, sf):
    return topk.first_per_key(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], F.desc("value"), "event_id", k=12, rank="rank").drop("value")


@register("below_threshold_preview", "SELECT event_id, value FROM events WHERE value < 60 ORDER BY value DESC, event_id LIMIT 50")
def below_threshold_preview(spark, sf):
    return table(spark, sf, "events").where("value < 60").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(50)


@register("queue_final_state", """WITH k AS (SELECT user_id, event_type AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1), f AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::INT AS attempts FROM events GROUP BY user_id)
SELECT user_id, attempts, CASE WHEN last = 'purchase' THEN 'done' WHEN attempts >= 3 THEN 'failed_permanent' WHEN last = 'error' THEN 'retry' ELSE 'pending' END AS state FROM k JOIN f USING (user_id)""")
def queue_final_state(spark, sf):
    return state.job_state(table(spark, sf, "events"), ["user_id"], "ts", "event_id", "event_type", "error", "purchase")


@register("fair_claim", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS round FROM events WHERE event_type = 'view') SELECT * FROM r WHERE round <= 100 ORDER BY round, user_id LIMIT 100""")
def fair_claim(spark, sf):
    """A claim of 100 jobs that turns over the sources fairly."""
    jobs = table(spark, sf, "events").where("event_type = 'view'").select("user_id", "event_id", "ts")
    return state.claim_fair(jobs, "user_id", 100, "ts", "event_id").drop("ts")


@register("claim_order", "SELECT event_id, rank FROM (SELECT event_id, row_number() OVER (ORDER BY (event_type = 'error')::INT, (value > 50)::INT, ts, event_id)::INT AS rank FROM events) WHERE rank <= 50")
def claim_order(spark, sf):
    """The first 50 jobs: errors last, heavy ones late, then by time."""
    e = table(spark, sf, "events")
    order = [(F.col("event_type") == "error").cast("int"), (F.col("value") > 50).cast("int"), F.col("ts"), F.col("event_id")]
    top = e.orderBy(*order).limit(50).withColumn("one", F.lit(1))
    return topk.first_per_key(top, ["one"], *order, k=50, rank="rank").select("event_id", "rank")


@register("rate_eta", """WITH p AS (SELECT event_type, count(*) AS done, epoch(max(ts)) - epoch(min(ts)) AS span FROM events GROUP BY event_type) SELECT event_type, done, CASE WHEN span >= 5 AND done >= 2 THEN round(done / span, 6) END AS per_second, CASE WHEN span >= 5 AND done >= 2 THEN round(10000 / (done / span), 0) END AS eta FROM p""")
def rate_eta(spark, sf):
    """Throughput between the first and last sample, and the time that 10,000 more would take."""
    p = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("done"), (F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")).alias("span"))
    ok, rate = (F.col("span") >= 5) & (F.col("done") >= 2), F.col("done") / F.col("span")
    return p.select("event_type", "done", F.when(ok, F.round(rate, 6)).alias("per_second"), F.when(ok, F.round(10000 / rate, 0)).alias("eta"))


@register("trailing_throughput", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY event_type")
def trailing_throughput(spark, sf):
    e = table(spark, sf, "events").select("event_type", "ts")
    newest = F.broadcast(e.agg(F.max("ts").alias("newest")).withColumn("one", F.lit(1)))
    return e.withColumn("one", F.lit(1)).join(newest, "one").where(F.col("ts") >= F.col("newest") - F.expr("interval 1 day")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("session_delta", "WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT event_type, min_by(n, day) AS base FROM d GROUP BY event_type) SELECT event_type, day, (n - base)::BIGINT AS plus FROM d JOIN b USING (event_type)")
def session_delta(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    b = d.groupBy("event_type").agg(F.min_by("n", "day").alias("base"))
    return d.join(b, "event_type").select("event_type", "day", (F.col("n") - F.col("base")).alias("plus"))


@register("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, CASE WHEN quantile_cont(value, 0.5) < 20 THEN 'fast' WHEN quantile_cont(value, 0.5) < 50 THEN 'good' ELSE 'slow' END AS band FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    """Exact percentiles by linear interpolation; counts of equal values are combined before the shuffle."""
    p = table(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    band = F.when(F.col("p")[0] < 20, "fast").when(F.col("p")[0] < 50, "good").otherwise("slow")
    return p.select("event_type", *[F.round(F.col("p")[i], 6).alias(x) for i, x in enumerate(("p50", "p95", "p99"))], band.alias("band"))


@register("stage_timing", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 3)::DOUBLE AS seconds FROM events GROUP BY user_id")
def stage_timing(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return e.withColumn("seconds", F.round((F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 1000000, 3))


@register("lru_keep", "WITH m AS (SELECT md5(text) AS key, max(conv_id * 1000 + turn) AS used FROM conversations GROUP BY 1) SELECT key, used FROM m ORDER BY used DESC, key LIMIT 100")
def lru_keep(spark, sf):
    """A cache of the 100 most recently used keys."""
    m = table(spark, sf, "conversations").groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.max(F.col("conv_id") * 1000 + F.col("turn")).alias("used"))
    return m.orderBy(F.desc("used"), "key").limit(100)


@register("json_props", "SELECT (props->>'$.k')::INT % 10 AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE json_valid(props) GROUP BY 1")
def json_props(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.try_parse_json("props")).where("v is not null")
    return e.groupBy((F.try_variant_get("v", "$.k", "int") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@register("scan_due", "SELECT user_id, max(ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 12 HOUR AS due FROM events GROUP BY user_id")
def scan_due(spark, sf):
    """Sources whose last scan lies more than 12 hours back."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.select("user_id", (F.col("last") < F.to_timestamp(F.lit("2024-01-30 00:00:00")) - F.expr("interval 12 hours")).alias("due"))


@register("active_learning_queue", "SELECT event_id, value FROM events WHERE event_type = 'view' ORDER BY abs(value - 50), event_id LIMIT 25")
def active_learning_queue(spark, sf):
    """The 25 rows that the model is least sure of."""
    return table(spark, sf, "events").where("event_type = 'view'").select("event_id", "value").orderBy(F.abs(F.col("value") - 50), "event_id").limit(25)


@register("undo_log", """WITH n AS (SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) SELECT user_id, count(*) AS kept FROM n WHERE event_type <> 'error' AND coalesce(next, '') <> 'error' GROUP BY user_id""")
def undo_log(spark, sf):
    """Actions that stand: an undo event takes back the action just before it."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("next", F.lead("event_type").over(w))
    return e.where("event_type <> 'error' and coalesce(next, '') <> 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))
