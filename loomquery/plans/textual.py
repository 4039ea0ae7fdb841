"""Text queries: score cascades, token and phrase match, folding, synonyms, slots, memory of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.functions import kernels as K
from loomquery.functions import text as T
from loomquery.operators import topk
from loomquery.plans.registry import register
from loomquery.session import spread, table

_FOLD = f"translate(lower(translate(trim({{0}}), 'İI', 'ii')), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
_TOKENS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: len(t) >= 2))"


@register("turkish_fold", f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def turkish_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.fold("text").cast("binary")).alias("folded"))


@register("text_score_cascade", """WITH d AS (SELECT p_partkey, lower(p_name) AS title, lower(p_type) AS body, 'red widget' AS q FROM part),
t AS (SELECT *, list_distinct(list_filter(string_split_regex(title, '[^a-z0-9]+'), lambda t: len(t) >= 2)) AS tt, ['red', 'widget'] AS qt FROM d),
o AS (SELECT *, len(list_intersect(tt, qt)) / len(list_distinct(list_concat(tt, qt))) AS over FROM t)
SELECT p_partkey, round(CASE WHEN title = q THEN 0.98 WHEN starts_with(title, q) THEN 0.95 WHEN contains(' ' || title || ' ', ' ' || q || ' ') THEN 0.92 WHEN over > 0 THEN least(1, 0.82 + 0.08 * over) WHEN contains(title, q) THEN 0.55 WHEN contains(body, q) THEN 0.38 ELSE 0 END, 6)::DOUBLE AS score FROM o""")
def text_score_cascade(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(T.text_score(F.lower("p_name"), F.lower("p_type"), F.lit("red widget")), 6).alias("score"))


#: Terms of the full-text query, best first.
TERMS = ["the", "und", "que", "les"]


@register("fts_or_match", f"""WITH t(term, pos) AS (VALUES {', '.join(f"('{t}', {i})" for i, t in enumerate(TERMS))}), w AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents)
SELECT doc_id, min(pos)::INT AS best_term, count(*) AS n_terms FROM w JOIN t ON token = term GROUP BY doc_id""")
def fts_or_match(spark, sf):
    """Documents with any query term, ranked by the first one that they have."""
    w = table(spark, sf, "documents").select("doc_id", F.explode(T.tokens("text")).alias("token"))
    got = w.where(F.col("token").isin(TERMS)).withColumn("pos", F.array_position(F.array(*map(F.lit, TERMS)), F.col("token")) - 1)
    return got.groupBy("doc_id").agg(F.min("pos").cast("int").alias("best_term"), F.count(F.lit(1)).alias("n_terms"))


@register("like_substring", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def like_substring(spark, sf):
    return table(spark, sf, "part").where(F.lower("p_name").contains("ring")).select("p_partkey", "p_name")


@register("phrase_word_boundary", "SELECT doc_id FROM documents WHERE contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' all rights reserved ')")
def phrase_word_boundary(spark, sf):
    return table(spark, sf, "documents").where(T.has_phrase("text", "all rights reserved")).select("doc_id")


@register("token_jaccard", f"""WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents), q AS (SELECT item_id, {_TOKENS.format('text')} AS u FROM benchmark)
SELECT item_id, doc_id, round(len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))), 6) AS sim FROM q JOIN d ON len(list_intersect(t, u)) > 0 AND len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) >= 0.05""")
def token_jaccard(spark, sf):
    """Token overlap of every benchmark item with every document: shared tokens are counted by an equi-join on the
    token, and the union's size follows from the two set sizes, so no pair without a shared token is made."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.tokens("text").alias("t"))
    q = table(spark, sf, "benchmark").select("item_id", T.tokens("text").alias("u"))
    qt = q.select("item_id", F.size("u").alias("nu"), F.explode("u").alias("token"))
    shared = d.select("doc_id", F.size("t").alias("nt"), F.explode("t").alias("token")).join(qt, "token").groupBy("item_id", "doc_id", "nt", "nu").agg(F.count(F.lit(1)).alias("both"))
    sim = F.col("both") / (F.col("nt") + F.col("nu") - F.col("both"))
    return shared.where(sim >= 0.05).select("item_id", "doc_id", F.round(sim, 6).alias("sim"))


@register("fuzzy_levenshtein", """WITH b AS (SELECT DISTINCT lower(p_name) AS name FROM part), q(query) AS (VALUES ('red widgt'), ('smal ring'), ('bleu bolt')),
s AS (SELECT query, name, levenshtein(query, name) AS d FROM b CROSS JOIN q WHERE levenshtein(query, name) <= 3), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, name)::INT AS rank FROM s) SELECT query, name, d::INT AS d, rank FROM r WHERE rank <= 3""")
def fuzzy_levenshtein(spark, sf):
    """Spelling correction of query words against the vocabulary of names."""
    names = table(spark, sf, "part").select(F.lower("p_name").alias("name")).distinct()
    q = names.withColumn("query", F.explode(F.array(*map(F.lit, ["red widgt", "smal ring", "bleu bolt"])))).withColumn("d", F.levenshtein("query", "name"))
    return topk.first_per_key(q.where("d <= 3"), ["query"], "d", "name", k=3, rank="rank").select("query", "name", "d", "rank")


#: Own small lexicon of query synonyms.
SYNONYMS = {"ring": ["ring", "band"], "bolt": ["bolt", "screw"], "widget": ["widget", "gadget"]}


@register("synonym_expand", f"""WITH s(term, synonym) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, vs in SYNONYMS.items() for v in vs)})
SELECT s.term, count(DISTINCT p_partkey) AS n_parts FROM part JOIN s ON list_contains(string_split(lower(p_name), ' '), synonym) GROUP BY s.term""")
def synonym_expand(spark, sf):
    rows = [(k, v) for k, vs in SYNONYMS.items() for v in vs]
    s = spark.createDataFrame(rows, "term string, synonym string")
    w = table(spark, sf, "part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("synonym"))
    return w.join(F.broadcast(s), "synonym").groupBy("term").agg(F.countDistinct("p_partkey").alias("n_parts"))


@register("nl_slot_score", """WITH m AS (SELECT p_partkey, (contains(p_name, 'red'))::INT AS color, (p_brand = 'Brand#2')::INT AS brand, (p_type = 'ECONOMY')::INT AS style FROM part)
SELECT p_partkey, round(least(1, ((0.3 * color + 0.4 * brand + 0.3 * style) / 1.0) * (0.55 + 0.45 * (color + brand + style) / 3.0) + 0.04 * greatest(color + brand + style - 1, 0)), 6)::DOUBLE AS score FROM m WHERE color + brand + style > 0""")
def nl_slot_score(spark, sf):
    """Slots of a parsed question (colour, brand, style): weighted hits times coverage, and a bonus for each further one."""
    p = table(spark, sf, "part")
    color, brand, style = (c.cast("int") for c in (F.col("p_name").contains("red"), F.col("p_brand") == "Brand#2", F.col("p_type") == "ECONOMY"))
    n = color + brand + style
    score = (0.3 * color + 0.4 * brand + 0.3 * style) * (0.55 + 0.45 * n / 3.0) + 0.04 * F.greatest(n - 1, F.lit(0))
    return p.where(n > 0).select("p_partkey", F.round(F.least(F.lit(1.0), score), 6).alias("score"))


@register("autocomplete", """WITH v AS (SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT name, n, CASE WHEN name = 're' THEN 0 WHEN starts_with(name, 're') THEN 1 WHEN contains(name, 're') THEN 2 END::INT AS tier FROM v WHERE contains(name, 're')),
r AS (SELECT *, row_number() OVER (ORDER BY tier, n DESC, name)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def autocomplete(spark, sf):
    v = table(spark, sf, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    tier = F.when(F.col("name") == "re", 0).when(F.col("name").startswith("re"), 1).when(F.col("name").contains("re"), 2)
    top = v.withColumn("tier", tier).where("tier is not null").orderBy("tier", F.desc("n"), "name").limit(10)
    return topk.first_per_key(top.withColumn("one", F.lit(1)), ["one"], "tier", F.desc("n"), "name", k=10, rank="rank").drop("one")


@register("query_rewrite", """WITH m AS (SELECT conv_id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS rewrite, turn, role FROM conversations),
k AS (SELECT md5(lower(trim(text))) AS key, rewrite, row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY conv_id DESC, turn DESC) AS n FROM m WHERE role = 'user' AND rewrite IS NOT NULL) SELECT key, md5(rewrite) AS rewrite FROM k WHERE n = 1""")
def query_rewrite(spark, sf):
    """Memory of query rewrites: the newest answer to the same folded query wins."""
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations").withColumn("rewrite", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")))
    k = c.where("role = 'user' and rewrite is not null").withColumn("key", F.md5(F.lower(F.trim("text")).cast("binary")))
    best = k.groupBy("key").agg(F.max_by(F.md5(F.col("rewrite").cast("binary")), F.struct("conv_id", "turn")).alias("rewrite"))
    return best


@register("cache_key", "SELECT conv_id, turn, sha256(lower(trim(text)) || '|' || role) AS key FROM conversations")
def cache_key(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.concat(F.lower(F.trim("text")), F.lit("|"), "role"), 256).alias("key"))


@register("semantic_tag_similarity", f"""WITH p AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS tags, p_type FROM part), q AS (SELECT tags AS qt, p_type AS qf FROM p WHERE p_partkey = 0)
SELECT p_partkey, round(greatest(len(list_intersect(tags, qt)) / len(list_distinct(list_concat(tags, qt))), CASE WHEN p_type = qf THEN 0.65 ELSE 0 END), 6)::DOUBLE AS sim FROM p CROSS JOIN q""")
def semantic_tag_similarity(spark, sf):
    """Overlap of tags with those of a stored asset; the same family is worth at least .65."""
    p = table(spark, sf, "part").select("p_partkey", "p_type", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("tags"))
    q = F.broadcast(p.where("p_partkey = 0").select(F.col("tags").alias("qt"), F.col("p_type").alias("qf"), F.lit(1).alias("one")))
    sim = F.greatest(K.jaccard("tags", "qt"), F.when(F.col("p_type") == F.col("qf"), 0.65).otherwise(0.0))
    return p.withColumn("one", F.lit(1)).join(q, "one").select("p_partkey", F.round(sim, 6).alias("sim"))
