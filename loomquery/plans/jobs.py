"""Job queue, index consistency, teaching and registry queries, and file sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomquery.functions import text as T
from loomquery.operators import learning, state, topk
from loomquery.plans.registry import register
from loomquery.session import shared_dir, table
from loomquery.sources import files


@register("enqueue_jobs", "SELECT user_id AS file_id, event_type AS artifact, CASE WHEN max(value) > 95 THEN 'far' ELSE 'near' END AS queue, count(*) AS requests FROM events GROUP BY ALL")
def enqueue_jobs(spark, sf):
    """Idempotent enqueue: one job a file and artifact, jumbo ones in the far queue."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("file_id"), F.col("event_type").alias("artifact")).agg(F.when(F.max("value") > 95, "far").otherwise("near").alias("queue"), F.count(F.lit(1)).alias("requests"))


@register("stale_requeue", """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, max(ts) AS beat FROM events GROUP BY user_id) SELECT user_id, CASE WHEN last = 'view' AND beat < (SELECT max(ts) FROM events) - INTERVAL 3 HOUR THEN 'pending' WHEN last = 'view' THEN 'processing' ELSE last END AS state FROM l""")
def stale_requeue(spark, sf):
    """Claims whose heartbeat is too old go back to pending."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    l = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("beat"), F.lit(1).alias("one"))  # noqa: E741
    now = F.broadcast(e.agg(F.max("ts").alias("now"), F.lit(1).alias("one")))
    late = (F.col("last") == "view") & (F.col("beat") < F.col("now") - F.expr("interval 3 hours"))
    return l.join(now, "one").select("user_id", F.when(late, "pending").when(F.col("last") == "view", "processing").otherwise(F.col("last")).alias("state"))


@register("retry_delays", "SELECT user_id, attempts, CASE WHEN attempts < 3 THEN least(30, attempts) END::INT AS delay FROM (SELECT user_id, sum((event_type = 'error')::INT)::INT AS attempts FROM events GROUP BY user_id)")
def retry_delays(spark, sf):
    a = table(spark, sf, "events").groupBy("user_id").agg(F.sum((F.col("event_type") == "error").cast("int")).cast("int").alias("attempts"))
    return a.withColumn("delay", F.when(F.col("attempts") < state.MAX_ATTEMPTS, state.retry_delay(F.col("attempts"))))


@register("reconcile_pendings", "SELECT event_type AS artifact, count(*) AS cancelled FROM events e WHERE event_type <> 'purchase' AND (EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'purchase' AND d.value > 99) OR user_id NOT IN (SELECT c_custkey FROM customer)) GROUP BY 1")
def reconcile_pendings(spark, sf):
    """Pending jobs that are done already or whose file is unknown."""
    e = table(spark, sf, "events").select("user_id", "event_type", "value")
    done = e.where("event_type = 'purchase' and value > 99").select("user_id").distinct().withColumn("done", F.lit(True))
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    got = e.where("event_type <> 'purchase'").join(done, "user_id", "left").join(known, "user_id", "left").where("done or known is null")
    return got.groupBy(F.col("event_type").alias("artifact")).agg(F.count(F.lit(1)).alias("cancelled"))


@register("priority_bands", "SELECT CASE WHEN event_type = 'purchase' THEN 'now' WHEN value > 80 THEN 'heavy' WHEN event_type IN ('click', 'view') THEN 'normal' ELSE 'late' END AS band, count(*) AS n, count(DISTINCT user_id) AS files FROM events GROUP BY 1")
def priority_bands(spark, sf):
    t = F.col("event_type")
    band = F.when(t == "purchase", "now").when(F.col("value") > 80, "heavy").when(t.isin("click", "view"), "normal").otherwise("late")
    per = table(spark, sf, "events").groupBy(band.alias("band"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("band").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))


@register("index_consistency", "SELECT (SELECT count(*) FROM documents) AS assets, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS orphans, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing")
def index_consistency(spark, sf):
    """Assets against vectors: counts, vectors without asset, assets without vector."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("a"))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("v"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return d.join(v, "id", "full").agg(n(F.col("a").isNotNull()).alias("assets"), n(F.col("v").isNotNull()).alias("vectors"), n(F.col("a").isNull()).alias("orphans"), n(F.col("v").isNull()).alias("missing"))


@register("teach_examples", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'user' ELSE 'auto' END AS source, CASE WHEN doc_id % 3 = 0 THEN toxic ELSE quality END::INT AS value FROM labels")
def teach_examples(spark, sf):
    l = table(spark, sf, "labels")  # noqa: E741
    auto = l.select("doc_id", F.lit("auto").alias("source"), F.col("quality").alias("value"))
    taught = l.where("doc_id % 3 = 0").select("doc_id", F.lit("user").alias("source"), F.col("toxic").alias("value"))
    return learning.teach(auto, taught, ["doc_id"])


@register("demote_rivals", """WITH e AS (SELECT l_orderkey AS file, l_returnflag AS concept, CASE WHEN l_linestatus = 'O' THEN 'positive' ELSE 'negative' END AS role FROM lineitem), t AS (SELECT DISTINCT file FROM e WHERE concept = 'A' AND role = 'positive')
SELECT concept, CASE WHEN concept <> 'A' AND role = 'positive' AND file IN (SELECT file FROM t) THEN 'negative' ELSE role END AS role, count(*) AS n FROM e GROUP BY ALL""")
def demote_rivals(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("concept"), F.when(F.col("l_linestatus") == "O", "positive").otherwise("negative").alias("role"))
    return learning.demote_rivals(e, "file", "A").groupBy("concept", "role").agg(F.count(F.lit(1)).alias("n"))


@register("registry_merge", "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(p_name), p_brand) AS keep FROM part")
def registry_merge(spark, sf):
    return learning.merge_registry(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), F.concat_ws("|", F.lower("p_name"), "p_brand"), "p_partkey")


@register("category_rename", "WITH c AS (SELECT p_partkey, p_type || '/' || p_brand AS path FROM part) SELECT p_partkey, CASE WHEN path = 'ECONOMY' OR starts_with(path, 'ECONOMY/') THEN 'Value' || substr(path, 8) ELSE path END AS path, CASE WHEN path = 'ECONOMY' OR starts_with(path, 'ECONOMY/') THEN path END AS alias FROM c")
def category_rename(spark, sf):
    c = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("path"))
    return learning.rename_subtree(c, "path", "ECONOMY", "Value")


@register("correction_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CORRECTED' ELSE c_mktsegment END AS segment FROM customer")
def correction_upsert(spark, sf):
    cur = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return learning.upsert(cur, cur.where("c_custkey % 10 = 0").withColumn("segment", F.lit("CORRECTED")), ["c_custkey"])


@register("alias_lookup", "WITH a AS (SELECT p_partkey, unnest([lower(p_name), lower(p_brand), lower(p_type)]) AS alias FROM part) SELECT p_partkey, min(CASE WHEN alias = 'brand#2' THEN 0 WHEN starts_with(alias, 'brand#2') THEN 1 ELSE 2 END)::INT AS tier FROM a WHERE contains(alias, 'brand#2') GROUP BY p_partkey")
def alias_lookup(spark, sf):
    """Concepts by name or alias, with the tier of the best match."""
    a = table(spark, sf, "part").select("p_partkey", F.explode(F.array(F.lower("p_name"), F.lower("p_brand"), F.lower("p_type"))).alias("alias")).where(F.col("alias").contains("brand#2"))
    tier = F.when(F.col("alias") == "brand#2", 0).when(F.col("alias").startswith("brand#2"), 1).otherwise(2)
    return a.groupBy("p_partkey").agg(F.min(tier).alias("tier"))


@register("learning_log", "SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events WHERE event_type IN ('purchase', 'error')")
def learning_log(spark, sf):
    return table(spark, sf, "events").where("event_type in ('purchase', 'error')").select("user_id", "event_type", F.date_trunc("day", "ts").alias("day")).distinct()


@register("taught_conflicts", "SELECT doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def taught_conflicts(spark, sf):
    """Positives without those that are taught as something else."""
    l = table(spark, sf, "labels")  # noqa: E741
    return l.where("quality = 1").select("doc_id").join(l.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@register("inbox_pools", "SELECT pool, doc_id FROM (SELECT pool, doc_id, row_number() OVER (PARTITION BY pool ORDER BY doc_id) AS n FROM (SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'undefined' WHEN toxic = 1 THEN 'suspicious' ELSE 'undecided' END AS pool FROM labels)) WHERE n <= 20")
def inbox_pools(spark, sf):
    q, t = F.col("quality"), F.col("toxic")
    p = table(spark, sf, "labels").select("doc_id", F.when((q == 0) & (t == 0), "undefined").when(t == 1, "suspicious").otherwise("undecided").alias("pool"))
    return topk.first_per_key(p, ["pool"], "doc_id", k=20)


@register("evidence_profile", "WITH c AS (SELECT l_returnflag AS concept, l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT concept, sum(n) AS total FROM c GROUP BY concept), r AS (SELECT c.*, row_number() OVER (PARTITION BY concept ORDER BY n DESC, value) AS k FROM c) SELECT concept, value, round(n / total, 6)::DOUBLE AS share FROM r JOIN t USING (concept) WHERE k = 1")
def evidence_profile(spark, sf):
    """The most frequent attribute of each concept, with its share as confidence."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("concept"), F.col("l_linenumber").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("concept").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("value"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@register("person_by_alias", "SELECT DISTINCT o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(c_name) = 'customer#000000011' OR lower(c_mktsegment) = 'machinery'")
def person_by_alias(spark, sf):
    c = table(spark, sf, "customer").where((F.lower("c_name") == "customer#000000011") | (F.lower("c_mktsegment") == "machinery")).select("c_custkey")
    return table(spark, sf, "orders").select("o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").distinct()


@register("ancestor_scope", "WITH p AS (SELECT page_id, string_split(split_part(split_part(url, '://', 2), '?', 1), '/') AS s FROM pages), a AS (SELECT page_id, unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS dir FROM p) SELECT dir, count(*) AS n, min(page_id) AS first_id FROM a GROUP BY dir HAVING count(*) >= 2")
def ancestor_scope(spark, sf):
    """Folders that at least two assets lie under, at any depth."""
    s = F.split(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), "/")
    p = table(spark, sf, "pages").select("page_id", s.alias("s")).where(F.size("s") > 1)
    a = p.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.array_join(F.slice("s", F.lit(1), i), "/"))).alias("dir"))
    return a.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id")).where("n >= 2")


@register("set_operations", "SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL SELECT doc_id, 'only' FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM documents WHERE lang = 'en')")
def set_operations(spark, sf):
    a = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    b = table(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.exceptAll(b).distinct().withColumn("side", F.lit("only")))


@register("format_registry", """WITH e AS (SELECT page_id, regexp_extract(lower(split_part(url, '?', 1)), '\\.([a-z0-9]+)$', 1) AS extension FROM pages) SELECT page_id, CASE WHEN extension IN ('html', 'htm') THEN 'page' WHEN extension IN ('jpg', 'jpeg', 'png', 'bmp', 'webp', 'gif') THEN 'raster' WHEN extension IN ('psd', 'psb', 'tif', 'tiff') THEN 'layered' WHEN extension IN ('ai', 'eps', 'svg', 'pdf') THEN 'vector' ELSE 'unsupported' END AS capability FROM e""".replace("\\\\", "\\"))
def format_registry(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("?"), F.lit(1)).alias("path"))
    return files.with_format(p, "path").select("page_id", "capability")


@register("partial_hash", "SELECT doc_id, sha256(substr(text, 1, 200) || CASE WHEN length(text) < 200 THEN text ELSE right(text, 200) END || n_chars::VARCHAR) AS h FROM documents")
def partial_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", files.partial_hash(F.col("text"), F.col("n_chars")).alias("h"))


@register("jsonl_export", "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def jsonl_export(spark, sf):
    """Pairs written as JSON lines to the shared folder and read again."""
    got = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(got, path)
    return files.read_jsonl(spark, path, "user_id long, n long, top double")


@register("log_summary_24h", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AND json_valid(props) GROUP BY event_type")
def log_summary_24h(spark, sf):
    e = table(spark, sf, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now"), F.lit(1).alias("one")))
    got = e.withColumn("one", F.lit(1)).join(now, "one").where((F.col("ts") >= F.col("now") - F.expr("interval 24 hours")) & F.try_parse_json("props").isNotNull())
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@register("customer_query_score", """WITH c AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/.]+)', 1) AS customer FROM pages), q(q) AS (VALUES ('ththre'), ('thhe'), ('oner'))
SELECT q, customer, round(CASE WHEN customer = q THEN 1 WHEN starts_with(customer, q) THEN 0.96 ELSE 1 - levenshtein(customer, q) / greatest(length(customer), length(q)) END, 6)::DOUBLE AS score FROM c CROSS JOIN q WHERE customer = q OR starts_with(customer, q) OR 1 - levenshtein(customer, q) / greatest(length(customer), length(q)) >= 0.5""")
def customer_query_score(spark, sf):
    """Customers suggested for the words of a question: equal, prefix, or by edit distance."""
    c = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/.]+)", 1).alias("customer")).distinct()
    x = c.withColumn("q", F.explode(F.array(*map(F.lit, ["ththre", "thhe", "oner"]))))
    near = 1 - F.levenshtein("customer", "q") / F.greatest(F.length("customer"), F.length("q"))
    score = F.when(F.col("customer") == F.col("q"), 1.0).when(F.col("customer").startswith(F.col("q")), 0.96).otherwise(near)
    return x.withColumn("score", F.round(score, 6)).where((F.col("customer") == F.col("q")) | F.col("customer").startswith(F.col("q")) | (near >= 0.5)).select("q", "customer", "score")


@register("variant_labels", "SELECT T.label, count(*) AS n FROM (SELECT CASE WHEN n_chars > 20000 THEN 'jumbo' WHEN n_chars > 2000 THEN 'normal' ELSE 'small' END AS label FROM documents) T GROUP BY 1")
def variant_labels(spark, sf):
    kind = F.when(F.col("n_chars") > 20000, "jumbo").when(F.col("n_chars") > 2000, "normal").otherwise("small")
    return table(spark, sf, "documents").groupBy(kind.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("brand_match", "SELECT p_partkey, round(CASE WHEN contains(' ' || lower(p_name) || ' ', ' red ') THEN 0.90 WHEN contains(lower(p_brand), '#1') THEN 0.42 ELSE 0 END, 2)::DOUBLE AS score FROM part")
def brand_match(spark, sf):
    """Brand evidence: a whole alias counts .90, a short one inside another word .42."""
    score = F.when(T.has_phrase("p_name", "red"), 0.90).when(F.lower("p_brand").contains("#1"), 0.42).otherwise(0.0)
    return table(spark, sf, "part").select("p_partkey", F.round(score, 2).alias("score"))
