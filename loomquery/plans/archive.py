"""The archive's own tables: stores that grow and change, statuses and findings, orders of shown lists, affinities, paths."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomquery.functions import kernels as K
from loomquery.functions import text as T
from loomquery.operators import ordering, state, topk
from loomquery.plans.registry import register
from loomquery.session import shared_dir, table
from loomquery.sources import files, store


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Stores


@register("folder_scan")
def folder_scan(spark, sf):
    """Names of the Parquet files below the dataset's folder, found without reading them; SQL does not see the folder."""
    return files.scan_folder(spark, sf, ["parquet"], ["/_"]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "file_size")


@register("append_batches", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 2 END AS batch FROM orders")
def append_batches(spark, sf):
    """Two batches of discovered rows: the second adds only what the first did not hold."""
    o, path = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), _folder(spark, "append")
    store.append_new(o.where("o_orderkey % 2 = 1").withColumn("batch", F.lit(1)), path, "o_orderkey")
    store.append_new(o.withColumn("batch", F.lit(2)), path, "o_orderkey", spark.read.parquet(path))
    return spark.read.parquet(path)


@register("vector_store", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length FROM embeddings WHERE label <> 3")
def vector_store(spark, sf):
    """Vectors written as a whole twice; readers get the newest version that was announced."""
    v, root = table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), _folder(spark, "vectors")
    store.publish(v, root, 1)
    store.publish(v.where("label <> 3"), root, 2)
    return store.current(spark, root).select("vec_id", F.round(K.norm("embedding"), 6).alias("length"))


@register("cluster_store", """WITH c AS (SELECT label AS customer, vec_id, CASE WHEN label % 2 = 0 THEN vec_id % 3 ELSE vec_id % 7 END AS cluster FROM embeddings)
SELECT customer, count(DISTINCT cluster) AS clusters, count(*) AS members, count(DISTINCT CASE WHEN cluster % 2 = 0 THEN cluster END) AS claimed FROM c GROUP BY customer""")
def cluster_store(spark, sf):
    """Clusters of some customers replaced, those of the others kept; what each customer's store holds."""
    e, path = table(spark, sf, "embeddings").select(F.col("label").alias("customer"), "vec_id"), _folder(spark, "clusters")
    store.replace_partitions(e.withColumn("cluster", F.col("vec_id") % 7), path, "customer")
    store.replace_partitions(e.where("customer % 2 = 0").withColumn("cluster", F.col("vec_id") % 3), path, "customer")
    c = spark.read.parquet(path)
    return c.groupBy("customer").agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("members"), F.count_distinct(F.when(F.col("cluster") % 2 == 0, F.col("cluster"))).alias("claimed"))


@register("response_cache", """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders), u AS (SELECT o_custkey, max(o_orderdate) AS used FROM orders GROUP BY 1),
k AS (SELECT o_custkey FROM u ORDER BY used DESC, o_custkey LIMIT 512) SELECT o_custkey, count(*) AS hits, min_by(o_orderkey, n) AS best FROM r JOIN k USING (o_custkey) WHERE n <= 20 GROUP BY 1""")
def response_cache(spark, sf):
    """First pages of answers as JSON in a compressed table, the 512 last used of them (the cache's size), read back."""
    o, path = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), _folder(spark, "cache")
    used = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("used")).orderBy(F.desc("used"), "o_custkey").limit(512)
    page = topk.first_per_key(o, ["o_custkey"], F.desc("o_totalprice"), "o_orderkey", k=20, rank="n")
    answer = page.groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n", "o_orderkey")))).alias("payload"))
    answer.join(used, "o_custkey").write.option("compression", "zstd").parquet(path)
    hits = F.from_json("payload", "array<struct<n: int, o_orderkey: long>>")
    return spark.read.parquet(path).select("o_custkey", F.size(hits).cast("long").alias("hits"), hits[0]["o_orderkey"].alias("best"))


@register("status_report", "SELECT '<tr><td>' || o_orderstatus || ' &amp; ' || o_orderpriority || '</td><td>' || count(*) || '</td></tr>' AS html FROM orders GROUP BY o_orderstatus, o_orderpriority")
def status_report(spark, sf):
    """The status report as rows of an HTML table."""
    n = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return store.report_rows(n.select(F.concat_ws(" & ", "o_orderstatus", "o_orderpriority").alias("status"), "n"), "status", "n")


@register("truth_export", "SELECT d.doc_id, d.lang, l.toxic = 1 AS wrong, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
def truth_export(spark, sf):
    """Ground truth from feedback, written as JSON lines and read back."""
    path = _folder(spark, "truth")
    l = table(spark, sf, "labels").where("quality is not null")  # noqa: E741
    truth = table(spark, sf, "documents").select("doc_id", "lang").join(l, "doc_id").select("doc_id", "lang", (F.col("toxic") == 1).alias("wrong"), "quality")
    files.write_jsonl(truth, path)
    return files.read_jsonl(spark, path, "doc_id long, lang string, wrong boolean, quality int")


# Statuses, findings, approvals

_KIND = "CASE event_type WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'reset' ELSE 'note' END"
_NUMBERED = "SELECT user_id, event_id % 20 AS part, value, {0} AS kind, row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY ts, event_id) AS n FROM events"


def _parts(spark, sf):
    return table(spark, sf, "events").withColumn("part", F.col("event_id") % 20), F.struct("ts", "event_id")


@register("pipeline_status", f"""WITH e AS ({_NUMBERED.format(_KIND)}), s AS (SELECT user_id, part, max(n) FILTER (WHERE kind IN ('done', 'failed', 'reset')) AS since, arg_max(kind, n) FILTER (WHERE kind IN ('done', 'failed', 'reset')) AS last, max(n) FILTER (WHERE kind = 'processing') AS busy FROM e GROUP BY ALL)
SELECT user_id, part, CASE WHEN last IN ('done', 'failed') THEN last WHEN busy > coalesce(since, 0) THEN 'processing' ELSE 'pending' END AS status FROM s""")
def pipeline_status(spark, sf):
    e, at = _parts(spark, sf)
    return state.one_way_status(e, ["user_id", "part"], at, F.expr(_KIND))


_FINDING = "CASE event_type WHEN 'purchase' THEN 'resolved' WHEN 'error' THEN 'dismissed' WHEN 'signup' THEN 'snoozed' ELSE 'pending' END"


@register("audit_findings", f"""WITH e AS ({_NUMBERED.format(_FINDING)}), s AS (SELECT user_id, part, arg_max(kind, n) AS newest, arg_max(kind, n) FILTER (WHERE kind <> 'pending') AS settled, arg_max(value, n) AS value FROM e GROUP BY ALL)
SELECT user_id, part, CASE WHEN newest = 'pending' AND settled IN ('resolved', 'dismissed') THEN settled ELSE newest END AS status, value FROM s""")
def audit_findings(spark, sf):
    e, at = _parts(spark, sf)
    return state.audit_findings(e, ["user_id", "part"], at, F.expr(_FINDING), "value")


@register("learned_family", "WITH e AS (SELECT user_id, event_id % 20 AS part, event_type, props, row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, part, props FROM e WHERE n = 1 AND event_type <> 'signup'")
def learned_family(spark, sf):
    """The family that the newest correction teaches; a clear takes it back."""
    return state.latest_or_cleared(_parts(spark, sf)[0], ["user_id", "part"], "ts", "event_id", "props", F.col("event_type") == "signup")


@register("taught_brands", "WITH t AS (SELECT o_custkey AS file_id, lower(trim(o_orderpriority)) AS brand_key, o_orderpriority AS display, o_orderdate, o_orderkey FROM orders) SELECT brand_key, file_id, arg_max(display, (o_orderdate, o_orderkey)) AS display FROM t GROUP BY ALL")
def taught_brands(spark, sf):
    """Brands taught to files, one row a file and brand key, spelled as last taught."""
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("file_id"), T.brand_key("o_orderpriority").alias("brand_key"), F.col("o_orderpriority").alias("display"), "o_orderdate", "o_orderkey")
    return t.groupBy("brand_key", "file_id").agg(F.max_by("display", F.struct("o_orderdate", "o_orderkey")).alias("display"))


@register("project_approval", """WITH g AS (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS head, least(0.95, 0.80 + 0.05 * (count(DISTINCT lower(trim(p_type))) = 1)::INT + 0.05 * (max(p_retailprice) - min(p_retailprice) <= 7)::INT + 0.05 * (count(DISTINCT p_size % 2) > 1)::INT) AS confidence FROM part GROUP BY ALL HAVING count(*) >= 2)
SELECT p.p_partkey, g.head, round(g.confidence, 2)::DOUBLE AS confidence, CASE WHEN p.p_brand LIKE '%1' THEN 'approved' ELSE 'candidate' END AS status FROM part p JOIN g ON p.p_brand = g.p_brand AND p.p_name = g.p_name""")
def project_approval(spark, sf):
    """Members of project candidates with their group's first file; groups that were approved keep their confidence."""
    c = F.col
    p = table(spark, sf, "part")
    k = lambda x: F.when(x, 0.05).otherwise(0.0)
    signs = k(F.count_distinct(F.lower(F.trim("p_type"))) == 1) + k(F.max("p_retailprice") - F.min("p_retailprice") <= 7) + k(F.count_distinct(c("p_size") % 2) > 1)
    g = p.groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("head"), F.round(F.least(F.lit(0.95), 0.80 + signs), 2).alias("confidence")).where("n >= 2")
    return p.select("p_partkey", "p_brand", "p_name").join(g, ["p_brand", "p_name"]).select("p_partkey", "head", "confidence", F.when(c("p_brand").endswith("1"), "approved").otherwise("candidate").alias("status"))


@register("learning_decision", """WITH h AS (SELECT l_orderkey AS file_id, l_partkey AS concept, max(0.6 + l_discount * 4) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, concept) AS n FROM h),
t AS (SELECT file_id, max(concept) FILTER (WHERE n = 1) AS concept, max(score) FILTER (WHERE n = 1) AS top, coalesce(max(score) FILTER (WHERE n = 2), 0) AS second FROM r WHERE n <= 2 GROUP BY file_id)
SELECT file_id, concept, CASE WHEN file_id % 11 = 0 THEN 'ignore' WHEN file_id % 7 = 0 THEN 'candidate' WHEN top >= 0.82 AND second < 0.82 AND NOT (second >= top - 0.05 AND second >= 0.72) THEN 'auto' WHEN top >= 0.72 THEN 'candidate' ELSE 'ignore' END AS decision FROM t""")
def learning_decision(spark, sf):
    """Learn by itself, ask, or leave: a clear leader over .82 without a close rival or a negative example nearby."""
    c = F.col
    h = table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("file_id"), c("l_partkey").alias("concept")).agg(F.max(0.6 + c("l_discount") * 4).alias("score"))
    t = topk.first_per_key(h, ["file_id"], F.desc("score"), "concept", k=2, rank="n").groupBy("file_id").agg(
        F.max(F.when(c("n") == 1, c("concept"))).alias("concept"), F.max(F.when(c("n") == 1, c("score"))).alias("top"), F.coalesce(F.max(F.when(c("n") == 2, c("score"))), F.lit(0.0)).alias("second"))
    return t.select("file_id", "concept", K.learning_decision(c("top"), c("second"), c("file_id") % 11 == 0, c("file_id") % 7 == 0).alias("decision"))


# Orders of shown lists

_FIELDS = {"brand_hit": "(l_returnflag = 'R')", "visual": "l_discount * 10", "alias": "l_tax * 10", "ocr": "(l_suppkey % 4)", "score": "l_quantity / 50", "negative": "(l_linestatus = 'O')", "dna": "(l_partkey % 5)", "family": "(l_partkey % 3)",
           "object": "(l_suppkey % 6)", "bucket": "(l_suppkey % 5)", "tier": "(l_partkey % 4)", "margin": "l_tax", "name": "(l_partkey % 7)", "gender": "(l_suppkey % 2)", "texture": "l_discount", "dino": "l_tax * 5", "evidence_rank": "(l_partkey % 5)", "language": "(l_suppkey % 3)"}
_MODES = list(ordering.TEXT_ORDERS)
_MODE_SQL = "CASE l_orderkey % 7 " + " ".join("WHEN {} THEN [{}]".format(i, ", ".join(("-" if f.startswith("-") else "") + f"({_FIELDS[f.lstrip('-')]})::DOUBLE" for f in ordering.TEXT_ORDERS[m].split())) for i, m in enumerate(_MODES)) + " END"


@register("text_order", f"WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, {_MODE_SQL} AS key FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY key, l_linenumber, l_partkey)::INT AS place FROM k")
def text_order(spark, sf):
    """Results of text queries, each list in the order of its query's mode."""
    mode = F.element_at(F.array(*[F.lit(m) for m in _MODES]), (F.col("l_orderkey") % 7 + 1).cast("int"))
    k = table(spark, sf, "lineitem").withColumn("key", ordering.mode_key(mode, {f: F.expr(e) for f, e in _FIELDS.items()}))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("key", "l_linenumber", "l_partkey"))
    return k.select("l_orderkey", "l_linenumber", "l_partkey", place.alias("place"))


@register("live_order", """WITH RECURSIVE r AS (SELECT user_id, event_id, value / 200 AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior, row_number() OVER (PARTITION BY user_id ORDER BY value / 200 DESC, event_id) AS n FROM events WHERE value IS NOT NULL), t AS (SELECT * FROM r WHERE n <= 800),
b AS (SELECT user_id, n, score AS opened FROM t WHERE n = 1 UNION ALL SELECT t.user_id, t.n, CASE WHEN b.opened - t.score >= 0.03 THEN t.score ELSE b.opened END FROM b JOIN t ON t.user_id = b.user_id AND t.n = b.n + 1)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY opened DESC, prior)::INT AS place FROM t JOIN b USING (user_id, n)""")
def live_order(spark, sf):
    """The first 800 results of every list (what is shown) by score, near ties in the order they were shown before."""
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 200).alias("score"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("prior"))
    return ordering.stable_order(e, ["user_id"], "event_id", "score", "prior")


@register("asked_limit", """WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer) SELECT * FROM r WHERE c_nationkey % 4 = 0 OR rank <= least((c_nationkey % 4) * 3, 800)""")
def asked_limit(spark, sf):
    """Lists as long as their query asks, 0 for all of it (limits are the feature)."""
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    r = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).alias("rank"))
    return r.where(ordering.within_limit(F.col("rank"), F.col("c_nationkey") % 4 * 3))


# Affinities


def _ladder(x: str, anchors) -> str:
    return "round((CASE " + " ".join(f"WHEN {x} <= {b} THEN {c} + ({x} - {a}) / ({b} - {a}) * ({d} - {c})" for (a, c), (b, d) in zip(anchors, anchors[1:])) + " ELSE 0.93 END)::DOUBLE, 4)"


@register("text_calibration", f"SELECT DISTINCT x, {_ladder('x', K.TEXT_ANCHORS)} AS shown FROM (SELECT l_discount * 5 + l_tax AS x FROM lineitem)")
def text_calibration(spark, sf):
    """The relevance that each cosine stands for."""
    x = table(spark, sf, "lineitem").select((F.col("l_discount") * 5 + F.col("l_tax")).alias("x")).distinct()
    return x.select("x", K.text_calibration(F.col("x")).alias("shown"))


@register("unified_text", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS base, l_discount * 6 AS clip, l_tax * 12 AS extra, l_quantity / 60 AS structure, l_tax * 5 AS semantic, (l_partkey % 101) / 100.0::DOUBLE AS exact, ['same', 'other', 'unknown'][l_suppkey % 3 + 1] AS rel,
 CASE l_suppkey % 4 WHEN 0 THEN 0.06 WHEN 1 THEN 0.04 WHEN 2 THEN 0.015 ELSE 0 END AS grade, l_tax - 0.04 AS margin, l_tax * 4 AS rival FROM lineitem),
y AS (SELECT *, {_ladder('clip', K.TEXT_ANCHORS)} AS cal, greatest(exact, semantic) AS ev, greatest(clip, 0.55 * extra) AS v, CASE WHEN rel = 'same' THEN structure ELSE 0 END AS form FROM x), z AS (SELECT *, cal >= 0.8 OR clip >= 0.55 AS wins FROM y),
s AS (SELECT *, CASE WHEN clip >= 0.2 AND wins AND rel = 'other' AND extra < 0.4 THEN least(0.56, greatest(cal, 0.82 * cal + 0.1 * extra + 0.08 * form)) WHEN clip >= 0.2 AND wins THEN greatest(cal, 0.82 * cal + 0.1 * extra + 0.08 * form)
 WHEN clip >= 0.2 THEN least(0.42 * cal + 0.16 * extra + 0.12 * form + 0.1 * semantic + 0.08 * ev, CASE WHEN clip >= 0.32 THEN 0.58 ELSE 0.5 END, CASE WHEN rel = 'other' THEN 0.48 ELSE 1 END, CASE WHEN rel = 'unknown' AND extra < 0.4 THEN 0.55 ELSE 1 END)
 ELSE greatest(CASE WHEN v >= 0.75 THEN greatest(0.9 * v + 0.1 * ev, 0.55 * v + 0.25 * ev + 0.2 * base) WHEN v >= 0.55 THEN 0.62 * v + 0.2 * ev + 0.18 * base WHEN v >= 0.3 THEN 0.45 * v + 0.3 * ev + 0.25 * base ELSE 0.62 * ev + 0.38 * base END, CASE WHEN exact >= 0.88 THEN 0.78 * exact + 0.22 * base ELSE 0 END) END AS u FROM z)
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(1, u + 0.65 * grade + 0.02 * greatest(0, margin) - 0.25 * greatest(0, rival - greatest(0, clip - 0.08)))), 9)::DOUBLE AS score FROM s""")
def unified_text(spark, sf):
    """Relevance to a text of every row, from its channels, its family's relation and its rivals."""
    c = F.col
    grade = F.when(c("l_suppkey") % 4 == 0, 0.06).when(c("l_suppkey") % 4 == 1, 0.04).when(c("l_suppkey") % 4 == 2, 0.015).otherwise(0.0)
    relation = F.when(c("l_suppkey") % 3 == 0, "same").when(c("l_suppkey") % 3 == 1, "other").otherwise("unknown")
    score = K.unified_text(c("l_quantity") / 50, c("l_discount") * 6, c("l_tax") * 12, c("l_quantity") / 60, c("l_tax") * 5, (c("l_partkey") % 101) / 100, relation, grade, c("l_tax") - 0.04, c("l_tax") * 4)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 9).alias("score"))


_PALETTES = ["brown_tan", "orange", "black_white", "grayscale", "unknown", "navy", "cream"]
_ANIMALS = ["leopard", "jaguar", "tiger", "zebra", "cow", "dog", ""]
_ROOTS = ["floral", "animal_print", "plaid_check", "plain", "marble_abstract", "camouflage"]


def _sql_list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@register("hierarchy_affinity", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {_sql_list(_PALETTES)}[l_partkey % 7 + 1] AS p1, {_sql_list(_PALETTES)}[l_suppkey % 7 + 1] AS p2, {_sql_list(_ANIMALS)}[l_partkey % 7 + 1] AS a1, {_sql_list(_ANIMALS)}[l_suppkey % 7 + 1] AS a2, l_quantity / 50 AS v, l_discount * 10 AS b, l_tax * 10 AS c FROM lineitem),
y AS (SELECT *, CASE WHEN p1 = 'unknown' OR p2 = 'unknown' THEN 0.5 WHEN p1 = p2 THEN 1 WHEN p1 IN ('brown_tan', 'orange') AND p2 IN ('brown_tan', 'orange') THEN 0.85 WHEN p1 = 'black_white' AND p2 = 'grayscale' THEN 0.75 ELSE 0.2 END AS palette,
 CASE WHEN a1 = '' OR a2 = '' THEN 0.3 WHEN a1 = a2 THEN 1 WHEN a1 IN ('leopard', 'jaguar') AND a2 <> 'dog' THEN CASE a2 WHEN 'leopard' THEN 0.9 WHEN 'jaguar' THEN 0.9 WHEN 'tiger' THEN 0.75 ELSE 0.55 END WHEN a1 <> 'dog' AND a2 <> 'dog' THEN 0.5 ELSE 0.15 END AS animal FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round(palette, 2)::DOUBLE AS palette, round(animal, 2)::DOUBLE AS animal, round(least(1, 0.3 * v + 0.25 * b + 0.2 * least(1, 0.4 * CASE WHEN l_partkey % 3 = 0 THEN 0.7 ELSE 0.25 END + 0.35 * (0.4 * (1 - abs(v - b)) + 0.35 * (1 - abs(b - c)) + 0.25 * (1 - abs(v - c))) + 0.25 * animal) + 0.15 * palette + 0.1 * animal), 9)::DOUBLE AS score FROM y""")
def hierarchy_affinity(spark, sf):
    """Palette, animal and texture likeness of two profiles, and their weighted sum."""
    c = F.col
    at = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (c(k) % 7 + 1).cast("int"))
    v, b, t = c("l_quantity") / 50, c("l_discount") * 10, c("l_tax") * 10
    palette, animal = K.palette_similarity(at(_PALETTES, "l_partkey"), at(_PALETTES, "l_suppkey")), K.animal_similarity(at(_ANIMALS, "l_partkey"), at(_ANIMALS, "l_suppkey"))
    texture = K.texture_family_score(c("l_partkey") % 3 == 0, (v, b), (b, t), (v, t), animal)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", palette.alias("palette"), animal.alias("animal"), F.round(K.hierarchy_score(v, b, texture, palette, animal), 9).alias("score"))


@register("knowledge_affinity", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, 'f' || l_partkey % 12 AS f1, 'f' || l_suppkey % 12 AS f2, {_sql_list(_ROOTS)}[l_partkey % 6 + 1] AS r1, {_sql_list(_ROOTS)}[l_suppkey % 6 + 1] AS r2, l_partkey % 4 AS q1, l_suppkey % 4 AS q2, {_sql_list(['red', 'coral', 'navy', 'teal', 'brown', 'cream', 'black'])}[l_partkey % 7 + 1] AS c1, {_sql_list(['red', 'coral', 'navy', 'teal', 'brown', 'cream', 'black'])}[l_suppkey % 7 + 1] AS c2, l_discount * 10 AS motif FROM lineitem),
y AS (SELECT *, CASE WHEN f1 = f2 THEN 1 WHEN r1 = r2 AND r1 <> 'plain' THEN 0.82 WHEN q1 = q2 AND q1 <> 0 THEN 0.7 WHEN r1 <> r2 AND least(r1, r2) || '/' || greatest(r1, r2) IN ('animal_print/floral', 'animal_print/plaid_check', 'animal_print/plain', 'animal_print/marble_abstract', 'camouflage/floral', 'floral/plaid_check') THEN 0.05 WHEN r1 <> r2 THEN 0.15 ELSE 0.35 END AS family,
 CASE WHEN c1 = c2 THEN 1 WHEN c1 IN ('red', 'coral') AND c2 IN ('red', 'coral') THEN 0.72 WHEN c1 IN ('navy', 'teal') AND c2 IN ('navy', 'teal') THEN 0.72 WHEN c1 IN ('brown', 'cream') AND c2 IN ('brown', 'cream') THEN 0.75 WHEN c1 IN ('cream', 'black') AND c2 IN ('cream', 'black') THEN 0.8 ELSE 0.18 END AS color FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round(family, 2)::DOUBLE AS family, round(color, 2)::DOUBLE AS color, round(least(1, 0.45 * family + 0.3 * motif + 0.15 * color), 9)::DOUBLE AS boost FROM y""")
def knowledge_affinity(spark, sf):
    """Affinity of families and of colours, and the boost that they give."""
    c = F.col
    at = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (c(k) % len(xs) + 1).cast("int"))
    name = lambda k: F.concat(F.lit("f"), (c(k) % 12).cast("string"))
    parent = lambda k: F.when(c(k) % 4 == 0, "").otherwise((c(k) % 4).cast("string"))
    colors = ["red", "coral", "navy", "teal", "brown", "cream", "black"]
    family = K.family_affinity(name("l_partkey"), name("l_suppkey"), (at(_ROOTS, "l_partkey"), at(_ROOTS, "l_suppkey")), (parent("l_partkey"), parent("l_suppkey")))
    color = K.color_affinity(at(colors, "l_partkey"), at(colors, "l_suppkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", family.alias("family"), color.alias("color"), F.round(K.knowledge_boost(family, c("l_discount") * 10, color, F.lit(0.0)), 9).alias("boost"))


# Paths, names, metadata

_RAW = "CASE p_size % 4 WHEN 0 THEN ' //Server1/Nas-Backup//' || p_name || '/ ' WHEN 1 THEN '\\\\srv\\designs\\' || p_name || '\\' WHEN 2 THEN 'D:/Work//' || p_name ELSE 'E:\\a\\' || p_name || '\\\\' END"


@register("source_roots", f"""WITH r AS (SELECT p_partkey, replace(trim({_RAW}), '/', '\\') AS raw FROM part), t AS (SELECT p_partkey, CASE WHEN raw LIKE '\\%' THEN '\\\\' ELSE '' END || array_to_string(list_filter(string_split(raw, '\\'), lambda x: x <> ''), '\\') AS root FROM r)
SELECT p_partkey, root, lower(root) AS root_key, CASE WHEN NOT starts_with(root, '\\\\') THEN 'local_pc' WHEN regexp_matches(upper(root), 'NAS|BACKUP|YEDEK|ARCHIVE|ARSIV') THEN 'nas_backup' ELSE 'server_share' END AS kind FROM t""".replace("raw LIKE '\\%'", "starts_with(raw, '\\')"))
def source_roots(spark, sf):
    """Canonical roots of source folders, their keys, and what kind of store each is."""
    p, n = F.col("p_size") % 4, F.col("p_name")
    raw = F.when(p == 0, F.concat(F.lit(" //Server1/Nas-Backup//"), n, F.lit("/ "))).when(p == 1, F.concat(F.lit("\\\\srv\\designs\\"), n, F.lit("\\"))).when(p == 2, F.concat(F.lit("D:/Work//"), n)).otherwise(F.concat(F.lit("E:\\a\\"), n, F.lit("\\\\")))
    got = table(spark, sf, "part").select("p_partkey", T.source_root(raw).alias("root"))
    return got.select("p_partkey", "root", F.lower("root").alias("root_key"), T.source_type("root").alias("kind"))


@register("category_resolve", """WITH a AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS parent, lower(p_name) AS child, lower(p_name) AS alias FROM part UNION ALL SELECT DISTINCT lower(split_part(p_name, ' ', 2)), '', lower(split_part(p_name, ' ', 2)) FROM part),
t AS (SELECT x.p_partkey, lower(x.p_brand || ' ' || x.p_name || ' ' || y.p_name) AS text FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1),
m AS (SELECT p_partkey, parent, child, row_number() OVER (PARTITION BY p_partkey ORDER BY (child = '')::INT, length(alias) DESC, child DESC, parent DESC) AS n FROM t JOIN a ON contains(' ' || regexp_replace(text, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || alias || ' '))
SELECT p_partkey, CASE WHEN child = '' THEN parent ELSE parent || '/' || child END AS path FROM m WHERE n = 1""")
def category_resolve(spark, sf):
    """The category a text names: its longest alias as a whole phrase, a child's before a parent's."""
    p = table(spark, sf, "part")
    parent, child = F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lower("p_name")
    aliases = p.select(parent.alias("parent"), child.alias("child"), child.alias("alias")).distinct().unionByName(p.select(parent.alias("parent"), F.lit("").alias("child"), parent.alias("alias")).distinct())
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    t = p.join(after, "p_partkey").select("p_partkey", F.explode(T.phrases(F.concat_ws(" ", "p_brand", "p_name", "next"))).alias("alias"))
    m = t.join(aliases, "alias")
    best = F.max(F.struct((F.col("child") != "").alias("leaf"), F.length("alias").alias("size"), "child", "parent"))
    got = m.groupBy("p_partkey").agg(best.alias("b"))
    return got.select("p_partkey", F.when(F.col("b.leaf"), F.concat_ws("/", "b.parent", "b.child")).otherwise(F.col("b.parent")).alias("path"))


@register("time_fields", """SELECT o_orderkey, 'mtime' AS key, 'filesystem_mtime' AS source, false AS is_usage_date FROM orders WHERE o_orderdate IS NOT NULL UNION ALL SELECT o_orderkey, 'indexed_at', 'index_clock', false FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'usage_date', 'unavailable', true FROM orders""")
def time_fields(spark, sf):
    """The times that a file has, each named by its source; no stored time tells when a file was used, and a row says so."""
    f = lambda key, source, usage, there: F.when(there, F.struct(F.lit(key).alias("key"), F.lit(source).alias("source"), F.lit(usage).alias("is_usage_date")))
    fields = F.array_compact(F.array(f("mtime", "filesystem_mtime", False, F.col("o_orderdate").isNotNull()), f("indexed_at", "index_clock", False, F.col("o_orderstatus") == "F"), f("usage_date", "unavailable", True, F.lit(True))))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(fields).alias("f")).select("o_orderkey", "f.key", "f.source", "f.is_usage_date")


@register("flat_metadata", "SELECT p_partkey, list_sort(list_distinct(list_filter(list_concat(string_split(lower(p_name), ' '), [lower(p_type), lower(p_brand), '']), lambda x: x <> ''))) AS strings, list_filter([CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_name LIKE '%widget%' THEN 'widget' END, CASE WHEN p_retailprice > 950 THEN 'costly' END], lambda x: x IS NOT NULL) AS tags FROM part")
def flat_metadata(spark, sf):
    """All strings of nested metadata, and the tags that rules give."""
    nested = F.create_map(F.lit("name"), F.split(F.lower("p_name"), " "), F.lit("kind"), F.array(F.lower("p_type"), F.lower("p_brand"), F.lit("")))
    flat = F.sort_array(F.array_distinct(F.filter(F.flatten(F.map_values(nested)), lambda x: x != "")))
    rules = {"large": F.col("p_size") > 25, "widget": F.col("p_name").contains("widget"), "costly": F.col("p_retailprice") > 950}
    return table(spark, sf, "part").select("p_partkey", flat.alias("strings"), F.array_compact(F.array(*[F.when(test, tag) for tag, test in rules.items()])).alias("tags"))


@register("sibling_files", r"""WITH f AS (SELECT p_partkey, p_brand AS dir, replace(lower(p_name), ' ', '_') AS stem FROM part), g AS (SELECT dir, stem, count(*) AS siblings, min(p_partkey) AS head FROM f GROUP BY ALL HAVING count(*) >= 2) SELECT p_partkey, head, siblings FROM f JOIN g ON f.dir = g.dir AND f.stem = g.stem""")
def sibling_files(spark, sf):
    """Files of one folder whose names differ in size, version or extension only."""
    name = F.concat("p_name", F.lit("_v"), F.col("p_size").cast("string"), F.lit(".tif"))
    f = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("dir"), T.variant_stem(name).alias("stem"))
    g = f.groupBy("dir", "stem").agg(F.count(F.lit(1)).alias("siblings"), F.min("p_partkey").alias("head")).where("siblings >= 2")
    return f.join(g, ["dir", "stem"]).select("p_partkey", "head", "siblings")
