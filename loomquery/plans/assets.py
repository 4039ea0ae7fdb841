"""Asset-table queries: scope, manifests, merges, hydration, joins, dashboards, audits, catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.functions import text as T
from loomquery.operators import state, topk
from loomquery.plans.registry import register
from loomquery.session import table


def n(cond):
    """Rows that satisfy a condition, 0 over none."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


@register("scope_filter", "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT DISTINCT source, source <> 'src3' AS active FROM documents WHERE source <> 'src5') s USING (source) WHERE (s.source IS NULL OR s.active) AND (d.source IN ('src1', 'src3', 'src5') OR d.lang = 'fr')")
def scope_filter(spark, sf):
    """Rows in scope: chosen sources or languages, where a source that is not registered counts as active."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    s = d.where("source <> 'src5'").select("source", (F.col("source") != "src3").alias("active")).distinct()
    got = d.join(s, "source", "left").where("(active is null or active) and (source in ('src1', 'src3', 'src5') or lang = 'fr')")
    return got.select("doc_id")


@register("path_prefix_scope", "SELECT page_id FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/]+)', 1) = 'ththre.example.com' OR regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) IN ('fr', 'de')")
def path_prefix_scope(spark, sf):
    p = table(spark, sf, "pages")
    return p.where((T.host("url") == "ththre.example.com") | T.first_segment("url").isin("fr", "de")).select("page_id")


@register("category_subtree", "WITH c AS (SELECT p_partkey, p_type || '/' || p_brand AS path FROM part) SELECT p_partkey, path FROM c WHERE path = 'ECONOMY' OR starts_with(path, 'ECONOMY/')")
def category_subtree(spark, sf):
    c = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("path"))
    return c.where(T.under("path", "ECONOMY"))


@register("visual_ready", "SELECT o_orderstatus, count(*) AS n, sum(CASE WHEN o_orderstatus <> 'F' AND o_totalprice > 0 AND coalesce(o_orderpriority, '') <> '' THEN 1 ELSE 0 END)::BIGINT AS ready FROM orders GROUP BY ALL")
def visual_ready(spark, sf):
    """Readiness predicate: a status that is not excluded, and parts that are neither null nor empty."""
    ready = (F.col("o_orderstatus") != "F") & (F.col("o_totalprice") > 0) & (F.coalesce("o_orderpriority", F.lit("")) != "")
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), n(ready).alias("ready"))


@register("manifest_diff", """WITH k AS (SELECT doc_id, n_chars, 0.0 AS m FROM documents WHERE doc_id % 5 <> 0), s AS (SELECT doc_id, n_chars + (doc_id % 7 = 0)::INT AS n_chars, CASE WHEN doc_id % 11 = 0 THEN 0.6 ELSE 0.2 END AS m FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(k.doc_id, s.doc_id) AS doc_id, CASE WHEN k.doc_id IS NULL THEN 'new' WHEN s.doc_id IS NULL THEN 'missing' WHEN k.n_chars <> s.n_chars OR abs(k.m - s.m) > 0.5 THEN 'changed' ELSE 'same' END AS change FROM k FULL JOIN s ON k.doc_id = s.doc_id""")
def manifest_diff(spark, sf):
    """Two snapshots of a source tree compared: new, missing, changed, same."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    known = d.where("doc_id % 5 <> 0").withColumn("m", F.lit(0.0))
    seen = d.where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") + (F.col("doc_id") % 7 == 0).cast("int")).alias("n_chars"), F.when(F.col("doc_id") % 11 == 0, 0.6).otherwise(0.2).alias("m"))
    return state.manifest_diff(known, seen, "doc_id", "n_chars", "m")


@register("merge_upsert", """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'N' END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice * 2 END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(nullif(n.o_orderstatus, ''), o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def merge_upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("N").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") * 2).alias("o_totalprice"))
    return state.merge_fields(o.where("o_orderkey % 2 = 0 or o_orderkey % 3 = 0"), new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@register("keyset_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey > 5000").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(50)


@register("hydrate_ordered", "SELECT (i.pos - 1)::INT AS pos, d.doc_id, d.n_chars FROM (SELECT unnest([7, 3, 150, 42, 9]) AS id, unnest(range(1, 6)) AS pos) i JOIN documents d ON d.doc_id = i.id")
def hydrate_ordered(spark, sf):
    """Rows by a list of ids, with the list's order kept."""
    ids = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (7, 3, 150, 42, 9)])).alias("pos", "doc_id"))
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(F.broadcast(ids), "doc_id").select("pos", "doc_id", "n_chars")


@register("identity_lookup", """WITH h AS (SELECT doc_id, md5(text) AS hf, md5(substr(text, 1, 200) || n_chars::VARCHAR) AS hp, source FROM documents), q AS (SELECT hf AS qf, hp AS qp, doc_id AS qid FROM h WHERE doc_id % 20 = 0)
SELECT qid, doc_id, (hf = qf) AS same_full FROM h JOIN q ON (hf = qf OR hp = qp) AND doc_id <> qid""")
def identity_lookup(spark, sf):
    """Rows with the full or the partial hash of the stated assets: two equi-joins united, instead of one OR join."""
    h = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("full"), F.md5(F.concat(F.substring("text", 1, 200), F.col("n_chars").cast("string")).cast("binary")).alias("part"))
    q = h.where("doc_id % 20 = 0").select(F.col("full").alias("qf"), F.col("part").alias("qp"), F.col("doc_id").alias("qid"))
    either = h.join(q, F.col("full") == F.col("qf")).union(h.join(q, F.col("part") == F.col("qp"))).where("doc_id <> qid")
    return either.select("qid", "doc_id", (F.col("full") == F.col("qf")).alias("same_full")).distinct()


@register("stratified_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5")
def stratified_sample(spark, sf):
    """The first five rows of every source, from per-task candidates: the window sees a bounded number of rows a key."""
    d = table(spark, sf, "documents").select("source", "doc_id")
    return topk.first_per_key(d, ["source"], "doc_id", k=5)


@register("random_sample", "SELECT doc_id FROM documents ORDER BY md5('seed-7-' || doc_id::VARCHAR), doc_id LIMIT 100")
def random_sample(spark, sf):
    """A repeatable random sample of 100 rows, in the order of a seeded hash."""
    d = table(spark, sf, "documents").select("doc_id")
    return d.orderBy(F.md5(F.concat(F.lit("seed-7-"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(100)


@register("files_features_sources", """SELECT n_name, count(*) AS n, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END)::BIGINT AS large, round(avg(l_quantity), 6) AS qty FROM lineitem l LEFT JOIN part p ON l_partkey = p_partkey LEFT JOIN supplier s ON l_suppkey = s_suppkey LEFT JOIN nation n ON s_nationkey = n_nationkey GROUP BY n_name""")
def files_features_sources(spark, sf):
    """The hot path: facts with their features and sources, left joins so that unregistered ones stay."""
    t = lambda x: table(spark, sf, x)
    got = t("lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(t("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"), "left")
    got = got.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return got.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), n(F.col("p_size") > 25).alias("large"), F.round(F.avg("l_quantity"), 6).alias("qty"))


@register("anti_semi", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS big FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_semi(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders")
    key = F.col("c_custkey") == F.col("o_custkey")
    free = c.join(o.where("o_orderstatus = 'P'").select("o_custkey"), key, "left_anti")
    big = o.where("o_totalprice > 400000").select("o_custkey").distinct()
    return free.join(big, key, "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("big"))


@register("collections_count", "SELECT c_custkey, count(o_orderkey) AS n_items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def collections_count(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_items"))


@register("purge_cascade", "SELECT count(*) AS kept, sum(l_quantity)::DOUBLE AS qty FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def purge_cascade(spark, sf):
    """Children of purged parents go with them."""
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    kept = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity").join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.sum("l_quantity").alias("qty"))


@register("status_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@register("dashboard_conditional", """SELECT count(*) AS total, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned,
 sum(CASE WHEN l_linestatus = 'O' AND l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS discounted, sum(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END)::BIGINT AS orphaned, sum(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END)::BIGINT AS untaxed, max(l_shipdate) AS newest FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def dashboard_conditional(spark, sf):
    """Many conditional counts over facts and their parents: the facts are counted by parent first, so that one row a
    parent meets the join, on the partitioning that the counting made."""
    c = F.col
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("total"), n(c("l_returnflag") == "R").alias("returned"), n((c("l_linestatus") == "O") & (c("l_discount") > 0.05)).alias("discounted"),
        n(c("l_tax") == 0).alias("untaxed"), F.max("l_shipdate").alias("newest"),
    )
    got = per.join(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), c("l_orderkey") == c("o_orderkey"), "left")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    of = lambda cond: total(F.when(cond, c("total")).otherwise(0))
    return got.agg(
        total("total").alias("total"), of(c("o_orderstatus") == "O").alias("open"), of(c("o_orderstatus") == "F").alias("done"), total("returned").alias("returned"),
        total("discounted").alias("discounted"), of(c("o_orderkey").isNull()).alias("orphaned"), total("untaxed").alias("untaxed"), F.max("newest").alias("newest"),
    )


@register("distinct_conditional", "SELECT count(DISTINCT l_orderkey) AS files, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_orderkey END) AS open, count(DISTINCT CASE WHEN l_discount = 0 THEN l_orderkey END) AS undiscounted FROM lineitem")
def distinct_conditional(spark, sf):
    """Distinct files satisfying each of several conditions: flags per file first, then plain sums, so that rows are
    not expanded once for every distinct count."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_discount")  # noqa: E741
    per = l.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_linestatus") == "O").alias("o"), F.bool_or(F.col("l_discount") == 0).alias("d"))
    return per.agg(F.count(F.lit(1)).alias("files"), n(F.col("r")).alias("returned"), n(F.col("o")).alias("open"), n(F.col("d")).alias("undiscounted"))


@register("format_audit", """WITH e AS (SELECT CASE WHEN regexp_extract(lower(split_part(url, '?', 1)), '\\.([a-z0-9]+)$', 1) IN ('', 'com') THEN 'none' WHEN regexp_extract(lower(split_part(url, '?', 1)), '\\.([a-z0-9]+)$', 1) IN ('htm', 'html') THEN 'html' ELSE regexp_extract(lower(split_part(url, '?', 1)), '\\.([a-z0-9]+)$', 1) END AS format FROM pages) SELECT format, count(*) AS n FROM e GROUP BY format""".replace("\\\\", "\\"))
def format_audit(spark, sf):
    """Counts by extension (after the last dot), aliases merged."""
    e = T.extension(F.split_part("url", F.lit("?"), F.lit(1)))
    kind = F.when(e.isin("", "com"), "none").when(e.isin("htm", "html"), "html").otherwise(e)
    return table(spark, sf, "pages").groupBy(kind.alias("format")).agg(F.count(F.lit(1)).alias("n"))


@register("customer_catalog", "SELECT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS customer, count(*) AS files, count(DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS roots FROM pages GROUP BY 1")
def customer_catalog(spark, sf):
    p = table(spark, sf, "pages").select(T.first_segment("url").alias("customer"), T.host("url").alias("host"))
    return p.groupBy("customer", "host").agg(F.count(F.lit(1)).alias("n")).groupBy("customer").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("roots"))


@register("top_reasons", """WITH r AS (SELECT event_type AS reason, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, reason) AS rank FROM r) SELECT CASE WHEN rank <= 3 THEN reason ELSE 'other' END AS reason, sum(n)::BIGINT AS n FROM k GROUP BY 1""")
def top_reasons(spark, sf):
    """The three most frequent reasons, and all others together; reasons are a handful of values."""
    r = table(spark, sf, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    top = F.broadcast(r.orderBy(F.desc("n"), "reason").limit(3).select(F.col("reason").alias("top")))
    return r.join(top, F.col("reason") == F.col("top"), "left").groupBy(F.coalesce("top", F.lit("other")).alias("reason")).agg(F.sum("n").alias("n"))


@register("quarantine_class", "SELECT CASE WHEN contains(lower(text), 'license') THEN 'licence' WHEN contains(text, '!!') THEN 'noise' WHEN contains(text, ' | ') THEN 'menu' ELSE 'other' END AS class, count(*) AS n FROM documents GROUP BY 1")
def quarantine_class(spark, sf):
    t = F.col("text")
    kind = F.when(F.lower(t).contains("license"), "licence").when(t.contains("!!"), "noise").when(t.contains(" | "), "menu").otherwise("other")
    return table(spark, sf, "documents").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@register("distinct_values", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE coalesce(c_mktsegment, '') <> ''")
def distinct_values(spark, sf):
    return table(spark, sf, "customer").where("coalesce(c_mktsegment, '') <> ''").select(F.col("c_mktsegment").alias("value")).distinct()


@register("health_worst", """WITH s AS (SELECT o_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_linestatus = 'O' THEN 2 WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT CASE p WHEN 3 THEN 'failed' WHEN 2 THEN 'pending' WHEN 1 THEN 'stale' ELSE 'ready' END AS health, count(*) AS n FROM s GROUP BY 1""")
def health_worst(spark, sf):
    """Health of a file: the worst state of its parts."""
    p = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_linestatus") == "O", 2).when(F.col("l_tax") > 0.07, 1).otherwise(0)
    worst = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(p).alias("p")).join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    name = F.element_at(F.array(*map(F.lit, ["ready", "stale", "pending", "failed"])), F.col("p") + 1)
    return worst.groupBy(name.alias("health")).agg(F.count(F.lit(1)).alias("n"))


@register("artifact_plan", """WITH a AS (SELECT o_orderkey, o_totalprice > 0 AS preview, o_totalprice > 100000 AS texture, o_totalprice > 200000 AS semantic, o_totalprice > 300000 AS dna FROM orders),
j AS (SELECT o_orderkey, unnest(['PREVIEW', 'TEXTURE', 'SEMANTIC', 'DNA']) AS artifact, unnest([preview, texture, semantic, dna]) AS ready, unnest([true, preview, texture, semantic]) AS can FROM a) SELECT artifact, CASE WHEN can THEN 'pending' ELSE 'dep_wait' END AS state, count(*) AS n FROM j WHERE NOT ready GROUP BY ALL""")
def artifact_plan(spark, sf):
    """Missing artifacts of every file as jobs, waiting where what they depend on is missing too."""
    price = F.col("o_totalprice")
    ready = {"PREVIEW": price > 0, "TEXTURE": price > 100000, "SEMANTIC": price > 200000, "DNA": price > 300000}
    needs = {"PREVIEW": F.lit(True), "TEXTURE": ready["PREVIEW"]} | {k: ready[v] for k, v in state.DEPENDENCIES.items()}
    jobs = F.array(*[F.struct(F.lit(k).alias("artifact"), v.alias("ready"), needs[k].alias("can")) for k, v in ready.items()])
    j = table(spark, sf, "orders").select(F.explode(jobs).alias("j")).where("not j.ready")
    return j.groupBy(F.col("j.artifact").alias("artifact"), F.when(F.col("j.can"), "pending").otherwise("dep_wait").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@register("file_size_label", """SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars::VARCHAR || ' B' WHEN n_chars < 1048576 THEN printf('%.1f', round(n_chars / 1024.0, 1)) || ' KB' WHEN n_chars < 1073741824 THEN printf('%.1f', round(n_chars / 1048576.0, 1)) || ' MB' ELSE printf('%.1f', round(n_chars / 1073741824.0, 1)) || ' GB' END AS size,
 CASE WHEN big < 1024 THEN big::VARCHAR || ' B' WHEN big < 1048576 THEN printf('%.1f', round(big / 1024.0, 1)) || ' KB' WHEN big < 1073741824 THEN printf('%.1f', round(big / 1048576.0, 1)) || ' MB' ELSE printf('%.1f', round(big / 1073741824.0, 1)) || ' GB' END AS scaled FROM (SELECT doc_id, n_chars, n_chars * 100003 AS big FROM documents)""")
def file_size_label(spark, sf):
    """Readable sizes, of the texts and of a hundred thousand times as much, so that every unit comes up."""
    return table(spark, sf, "documents").select("doc_id", T.file_size("n_chars").alias("size"), T.file_size(F.col("n_chars") * 100003).alias("scaled"))
