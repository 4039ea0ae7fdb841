"""Structure queries: duplicates, groups, candidate layers, boxes, graph expansion, projects, object counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.functions import kernels as K
from loomquery.functions import text as T
from loomquery.operators import relations, topk
from loomquery.plans.registry import register
from loomquery.session import materialize, spread, table


def _md5(c="text"):
    return F.md5(F.col(c).cast("binary"))


@register("exact_duplicates", "WITH h AS (SELECT md5(text) AS h, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1) SELECT * FROM h WHERE n > 1")
def exact_duplicates(spark, sf):
    g = table(spark, sf, "documents").groupBy(_md5().alias("h")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1")


# Hashes of a text's shingles of five words (all of its words, if they are fewer), each once and in order. The two
# smallest are its block: texts that share most shingles mostly share those, wherever in the text they differ.
_SHINGLES_SQL = "list_sort(list_distinct(list_transform(range(1, greatest(len({w}) - 3, 2)), lambda i: md5(array_to_string({w}[i:i + 4], ' ')))))"
_WORDS_SQL = "list_filter(string_split_regex(text, '[ \\t\\r\\n\\f\\x0B]+'), lambda x: x <> '')"
_BLOCKS_SQL = f"(SELECT *, array_to_string(s[1:2], '') AS b FROM (SELECT *, {_SHINGLES_SQL.format(w='words')} AS s FROM (SELECT *, {_WORDS_SQL} AS words FROM documents)))"


def _shingles(text="text"):
    words = F.array_remove(F.split(text, r"[ \t\r\n\f\x0B]+"), "")
    # through a one-element array, so that the text is parted once and not for every shingle
    each = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.md5(F.array_join(F.slice(w, i, F.lit(5)), " ").cast("binary"))))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def _block(shingles):
    return F.array_join(F.slice(shingles, 1, 2), "")


@register("near_dup_classify", f"""WITH t AS (SELECT min(doc_id) AS doc_id, text, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text), d AS (SELECT t.doc_id, t.copies, x.s, x.b FROM t JOIN {_BLOCKS_SQL} x ON x.doc_id = t.doc_id), h AS (SELECT b, min(doc_id) AS head FROM d GROUP BY b HAVING count(*) > 1),
j AS (SELECT d.doc_id, h.head, d.copies, len(list_intersect(d.s, e.s))::DOUBLE / len(list_distinct(list_concat(d.s, e.s))) AS jaccard FROM d JOIN h ON h.b = d.b JOIN d e ON e.doc_id = h.head WHERE d.doc_id <> h.head)
SELECT doc_id, head, copies, round(jaccard, 6) AS jaccard, CASE WHEN jaccard >= 0.95 THEN 'near' ELSE 'variant' END AS relation FROM j WHERE jaccard >= 0.8""")
def near_dup_classify(spark, sf):
    """Distinct texts classed against the first of their block, from a likeness of .8 on: links to the block's head, as
    many as rows, instead of all pairs. Written is a digest and a block key a row; the shingles of a text are made anew
    where it meets its head, since a text is a fraction of its shingles' size."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    keys = materialize(spread(docs).select("doc_id", F.sha2("text", 256).alias("h"), _block(_shingles()).alias("b")), "blocks")
    d = keys.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("b").alias("b"))
    head = d.groupBy("b").agg(F.min_by(F.struct("doc_id", "h"), "doc_id").alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1").select("b", F.col("x.doc_id").alias("head"), F.col("x.h").alias("head_h"))
    links = materialize(d.join(head, "b").where("doc_id <> head").select("doc_id", "h", "head", "head_h", "copies"), "links")
    wanted = links.select("head", "head_h").distinct()
    theirs = docs.select(F.col("doc_id").alias("head"), F.col("text").alias("head_text")).join(wanted, "head").where(F.sha2("head_text", 256) == F.col("head_h")).drop("head_h")
    j = docs.join(links, "doc_id").where(F.sha2("text", 256) == F.col("h")).join(theirs, "head")
    both = F.array(F.struct(_shingles().alias("s"), _shingles("head_text").alias("t")))
    # as an exploded array of one, so that shingles are made once and not for every mention
    j = j.select("doc_id", "head", "copies", F.explode(F.transform(both, lambda x: K.jaccard(x["s"], x["t"]))).alias("jaccard")).where("jaccard >= 0.8").distinct()
    return j.select("doc_id", "head", "copies", F.round("jaccard", 6).alias("jaccard"), F.when(F.col("jaccard") >= 0.95, "near").otherwise("variant").alias("relation"))


@register("phash_bucket_candidates", "WITH h AS (SELECT doc_id, md5(text) AS h FROM documents), q AS (SELECT doc_id AS qid, substr(h, 1, 2) AS b FROM h WHERE doc_id % 20 = 0) SELECT qid, doc_id FROM h JOIN q ON substr(h, 1, 2) = b AND qid <> doc_id")
def phash_bucket_candidates(spark, sf):
    h = table(spark, sf, "documents").select("doc_id", F.substring(_md5(), 1, 2).alias("b"))
    q = h.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid")
    return h.join(q, "b").where("qid <> doc_id").select("qid", "doc_id")


_LAYERS = """l AS (SELECT doc_id, 'hash' AS layer FROM documents WHERE substr(md5(text), 1, 1) IN ('0', '1') UNION ALL SELECT doc_id, 'text' FROM documents WHERE contains(lower(text), 'the ') UNION ALL SELECT doc_id, 'source' FROM documents WHERE source IN ('src1', 'src2')
 UNION ALL SELECT doc_id, 'feedback' FROM labels WHERE quality = 1)"""


def _layers(spark, sf):
    d = table(spark, sf, "documents")
    parts = {
        "hash": d.where(F.substring(_md5(), 1, 1).isin("0", "1")), "text": d.where(F.lower("text").contains("the ")),
        "source": d.where(F.col("source").isin("src1", "src2")), "feedback": table(spark, sf, "labels").where("quality = 1"),
    }
    out = None
    for name, rows in parts.items():
        one = rows.select("doc_id", F.lit(name).alias("layer"))
        out = one if out is None else out.unionByName(one)
    return out


@register("candidate_layers", f"WITH {_LAYERS} SELECT doc_id, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers, count(DISTINCT layer) AS n FROM l GROUP BY doc_id")
def candidate_layers(spark, sf):
    g = _layers(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_set("layer")).alias("s"))
    return g.select("doc_id", F.array_join("s", ",").alias("layers"), F.size("s").cast("long").alias("n"))


@register("compound_and_union", f"WITH {_LAYERS}, k AS (SELECT count(DISTINCT layer) AS k FROM l WHERE layer IN ('text', 'source')), c AS (SELECT doc_id, count(DISTINCT layer) AS n FROM l WHERE layer IN ('text', 'source') GROUP BY doc_id), m AS (SELECT max(n) AS m FROM c) SELECT doc_id, CASE WHEN k.k >= 2 AND m.m = k.k THEN 'and' ELSE 'union' END AS policy FROM c, k, m WHERE NOT (k.k >= 2 AND m.m = k.k) OR n = k.k")
def compound_and_union(spark, sf):
    """Channels of a compound query: their intersection if at least two have evidence and meet, else their union."""
    l = _layers(spark, sf).where(F.col("layer").isin("text", "source")).distinct()  # noqa: E741
    c = l.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    k = l.agg(F.count_distinct("layer").alias("k"), F.lit(1).alias("one")).join(c.agg(F.max("n").alias("m"), F.lit(1).alias("one")), "one")
    meet = (F.col("k") >= 2) & (F.col("m") == F.col("k"))
    return c.withColumn("one", F.lit(1)).join(F.broadcast(k), "one").where(~meet | (F.col("n") == F.col("k"))).select("doc_id", F.when(meet, "and").otherwise("union").alias("policy"))


@register("connected_groups", """WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS h, b FROM """ + _BLOCKS_SQL + """), e AS (SELECT a.doc_id AS u, x.m AS v FROM d a JOIN (SELECT h, min(doc_id) AS m FROM d GROUP BY h) x USING (h) UNION SELECT a.doc_id, x.m FROM d a JOIN (SELECT b, min(doc_id) AS m FROM d GROUP BY b) x USING (b)),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(id, g) AS (SELECT doc_id, doc_id FROM d UNION SELECT s.u, r.g FROM r JOIN s ON s.v = r.id) SELECT id AS doc_id, min(g) AS group_id FROM r GROUP BY id""")
def connected_groups(spark, sf):
    """Groups of documents that share their text or the block of their shingles, directly or through others."""
    d = materialize(spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", _md5().alias("h"), _block(_shingles()).alias("b")), "blocks")  # texts are read once, not once a key
    return relations.groups(d, ["h", "b"], "doc_id")


@register("project_groups", "WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS dir, page_id, length(url) AS n FROM pages) SELECT host, dir, count(*) AS n_files, min(page_id) AS first_id, round(least(0.95, 0.80 + 0.05 * (count(DISTINCT n) > 1)::INT + 0.05 * (max(n) - min(n) <= 8)::INT), 2)::DOUBLE AS confidence FROM p GROUP BY host, dir HAVING count(*) >= 2")
def project_groups(spark, sf):
    """Siblings in one folder as project candidates."""
    p = table(spark, sf, "pages").select(T.host("url").alias("host"), T.first_segment("url").alias("dir"), "page_id", F.length("url").alias("n"))
    conf = F.least(F.lit(0.95), 0.80 + 0.05 * (F.max("n") > F.min("n")).cast("int") + 0.05 * (F.max("n") - F.min("n") <= 8).cast("int"))
    return p.groupBy("host", "dir").agg(F.count(F.lit(1)).alias("n_files"), F.min("page_id").alias("first_id"), F.round(conf, 2).alias("confidence")).where("n_files >= 2")


_BOX = "SELECT l_orderkey AS file, l_linenumber AS i, l_returnflag AS label, (l_quantity / 60) AS x1, (l_discount * 5) AS y1, (l_quantity / 60 + 0.1 + l_tax) AS x2, (l_discount * 5 + 0.1 + l_tax) AS y2 FROM lineitem"


def _boxes(spark, sf):
    c = F.col
    box = F.struct((c("l_quantity") / 60).alias("x1"), (c("l_discount") * 5).alias("y1"), (c("l_quantity") / 60 + 0.1 + c("l_tax")).alias("x2"), (c("l_discount") * 5 + 0.1 + c("l_tax")).alias("y2"))
    return table(spark, sf, "lineitem").select(c("l_orderkey").alias("file"), c("l_linenumber").alias("i"), c("l_returnflag").alias("label"), box.alias("box"))


@register("spatial_relations", f"""WITH b AS ({_BOX}), p AS (SELECT a.file, a.i AS a, b.i AS b, round(sqrt(((a.x1 + a.x2 - b.x1 - b.x2) / 2)**2 + ((a.y1 + a.y2 - b.y1 - b.y2) / 2)**2), 6) AS dist,
 (b.x1 + b.x2 - a.x1 - a.x2) / 2 AS dx, (b.y1 + b.y2 - a.y1 - a.y2) / 2 AS dy FROM b a JOIN b b ON a.file = b.file AND a.label = 'A' AND b.label = 'R'), l AS (SELECT * FROM p WHERE abs(dx) >= abs(dy) AND dx >= 0.04),
r AS (SELECT file, a, b, dist, row_number() OVER (PARTITION BY file ORDER BY dist, a, b) AS n FROM l) SELECT file, a, b, dist FROM r WHERE n = 1""")
def spatial_relations(spark, sf):
    """Files in which a box of one label lies left of one of another, with their closest such pair."""
    b = _boxes(spark, sf)
    a = b.where("label = 'A'").select("file", F.col("i").alias("a"), F.col("box").alias("p"))
    o = b.where("label = 'R'").select("file", F.col("i").alias("b"), F.col("box").alias("q"))
    p, q = F.col("p"), F.col("q")
    dx, dy = (q["x1"] + q["x2"] - p["x1"] - p["x2"]) / 2, (q["y1"] + q["y2"] - p["y1"] - p["y2"]) / 2
    pairs = a.join(o, "file").where((F.abs(dx) >= F.abs(dy)) & (dx >= 0.04)).select("file", "a", "b", F.round(K.box_centre_distance(p, q), 6).alias("dist"))
    return topk.first_per_key(pairs, ["file"], "dist", "a", "b")


@register("box_iou", f"""WITH b AS ({_BOX}), p AS (SELECT a.file, a.i AS a, b.i AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS o, (a.x2 - a.x1) * (a.y2 - a.y1) AS s, (b.x2 - b.x1) * (b.y2 - b.y1) AS t FROM b a JOIN b b ON a.file = b.file AND a.i < b.i)
SELECT file, a, b, round(o / (s + t - o), 6) AS iou, o / s >= 0.85 AS inside FROM p WHERE o / (s + t - o) >= 0.02""")
def box_iou(spark, sf):
    b = _boxes(spark, sf)
    pairs = b.select("file", F.col("i").alias("a"), F.col("box").alias("p")).join(b.select("file", F.col("i").alias("b"), F.col("box").alias("q")), "file").where("a < b")
    p, q = F.col("p"), F.col("q")
    return pairs.where(K.box_iou(p, q) >= 0.02).select("file", "a", "b", F.round(K.box_iou(p, q), 6).alias("iou"), (K.box_containment(p, q) >= 0.85).alias("inside"))


@register("object_count_and", "SELECT l_orderkey, sum((l_returnflag = 'A')::INT)::BIGINT AS a, sum((l_returnflag = 'R')::INT)::BIGINT AS r FROM lineitem GROUP BY l_orderkey HAVING sum((l_returnflag = 'A')::INT) >= 2 AND sum((l_returnflag = 'R')::INT) >= 1")
def object_count_and(spark, sf):
    """Files with at least two objects of one label and one of another."""
    k = lambda x: F.sum((F.col("l_returnflag") == x).cast("long"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(k("A").alias("a"), k("R").alias("r")).where("a >= 2 and r >= 1")


@register("best_confidence", "SELECT l_orderkey, l_returnflag AS label, max(l_discount) AS best FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL")
def best_confidence(spark, sf):
    return table(spark, sf, "lineitem").where("l_discount >= 0.05").groupBy("l_orderkey", F.col("l_returnflag").alias("label")).agg(F.max("l_discount").alias("best"))


@register("kg_expand", """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 0.9 AS w FROM nation UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.8 FROM nation UNION ALL SELECT DISTINCT 'n' || c_nationkey, 's' || c_mktsegment, 0.7 FROM customer),
r(node, score, hops) AS (SELECT 'n1', 1.0::DOUBLE, 0 UNION ALL SELECT e.dst, round(r.score * e.w::DOUBLE * CASE r.hops WHEN 0 THEN 0.72 WHEN 1 THEN 0.68 ELSE 0.60 END::DOUBLE, 9), r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 3 AND round(r.score * e.w::DOUBLE * CASE r.hops WHEN 0 THEN 0.72 WHEN 1 THEN 0.68 ELSE 0.60 END::DOUBLE, 9) >= 0.18)
SELECT node, max(score) AS score FROM r GROUP BY node ORDER BY score DESC, node LIMIT 48""")
def kg_expand(spark, sf):
    """Nodes reached from a seed within three hops, best score first, at most 48."""
    nat = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("r"), F.concat(F.lit("n"), "n_nationkey").alias("n"))
    cust = table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("s"), "c_mktsegment").alias("dst")).distinct()
    e = nat.select(F.col("r").alias("src"), F.col("n").alias("dst"), F.lit(0.9).alias("weight")).union(nat.select("n", "r", F.lit(0.8))).union(cust.withColumn("weight", F.lit(0.7)))
    seeds = spark.range(1).select(F.lit("n1").alias("node"), F.lit(1.0).alias("score"))
    return relations.expand_graph(e, seeds, [0.72, 0.68, 0.60], 0.18, 48).select("node", "score")


@register("concept_registry_audit", "SELECT lower(p_name) AS key, count(DISTINCT p_name) AS spellings, count(*) AS n, min(p_partkey) AS keep FROM part GROUP BY 1 HAVING count(*) > 1")
def concept_registry_audit(spark, sf):
    """Concepts registered more than once under the same folded name, and the one that stays."""
    g = table(spark, sf, "part").groupBy(F.lower("p_name").alias("key"), "p_name").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("keep"))
    return g.groupBy("key").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"), F.min("keep").alias("keep")).where("n > 1")


@register("concept_confidence", "SELECT source, round(greatest(0, least(0.98, 0.5 + 0.08 * sum(quality) - 0.05 * sum(toxic))), 6)::DOUBLE AS confidence FROM labels JOIN documents USING (doc_id) GROUP BY source")
def concept_confidence(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.round(K.clamp(0.5 + 0.08 * F.sum("quality") - 0.05 * F.sum("toxic"), 0.0, 0.98), 6).alias("confidence"))


@register("scope_fallback", """WITH x AS (SELECT lang AS customer, source AS concept, doc_id FROM documents), p AS (SELECT doc_id, concept, CASE WHEN customer = 'fr' THEN 0 WHEN customer = 'en' THEN 1 END AS tier FROM x WHERE customer IN ('fr', 'en')), r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY tier, doc_id) AS n FROM p) SELECT concept, doc_id, tier::INT AS tier FROM r WHERE n <= 3""")
def scope_fallback(spark, sf):
    """Examples of a concept: the customer's own first, then the global ones."""
    p = table(spark, sf, "documents").where("lang in ('fr', 'en')").select(F.col("source").alias("concept"), "doc_id", F.when(F.col("lang") == "fr", 0).otherwise(1).alias("tier"))
    return topk.first_per_key(p, ["concept"], "tier", "doc_id", k=3)


@register("variant_stems", "SELECT regexp_replace(regexp_replace(lower(p_name || '_' || p_size || '.tif'), '\\.[a-z0-9]+$', ''), '([ _-]+(xs|s|m|l|xl|xxl|final|copy|v[0-9]+|rev[0-9]+|[0-9]+))+$', '') AS raw, count(*) AS n FROM part GROUP BY 1".replace("\\\\", "\\"))
def variant_stems(spark, sf):
    name = F.concat("p_name", F.lit("_"), "p_size", F.lit(".tif"))
    stem = F.regexp_replace(T.variant_stem(name), "_", " ")
    return table(spark, sf, "part").groupBy(stem.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
