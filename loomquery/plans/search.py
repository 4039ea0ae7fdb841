"""Whole searches: pictures and words against the archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.functions import kernels as K
from loomquery.operators import search as S
from loomquery.operators import topk
from loomquery.operators.components import connected_components
from loomquery.plans.registry import register
from loomquery.plans.scoring import _hash_sql
from loomquery.plans.structure import _BLOCKS_SQL, _block, _shingles
from loomquery.session import materialize, spread, table

_COS = "round(greatest(0, coalesce(list_cosine_similarity({0}, {1}), 0)), 6)"
_IMG = f"""WITH a AS (SELECT doc_id AS id, embedding[1:32]::DOUBLE[] AS dino, embedding[33:64]::DOUBLE[] AS clip, substr(md5(text), 1, 16) AS phash, label AS family FROM documents JOIN embeddings ON doc_id = vec_id),
p AS (SELECT q.id AS query_id, a.id, a.family, q.family AS qf, round(1 - {_hash_sql('a.phash', 'q.phash')} / 64, 6) AS p, {_COS.format('a.dino', 'q.dino')} AS d, {_COS.format('a.clip', 'q.clip')} AS c, substr(a.phash, 1, 2) = substr(q.phash, 1, 2) AS h FROM a JOIN a q ON q.id % 20 = 0 AND q.id <> a.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, id) AS rd, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rc FROM p),
f AS (SELECT *, (0.35 * d + 0.25 * c + 0.20 * p) / 0.80 AS base FROM r WHERE rd <= 40 OR rc <= 40 OR h),
s AS (SELECT query_id, id, array_to_string(list_sort(list_filter([CASE WHEN rd <= 40 THEN 'dino' END, CASE WHEN rc <= 40 THEN 'clip' END, CASE WHEN h THEN 'hash' END], lambda x: x IS NOT NULL)), ',') AS layers,
 round(CASE WHEN p >= 0.98 THEN greatest(base, 0.98) ELSE least(base + CASE WHEN family = qf THEN 0.12 ELSE 0 END, CASE WHEN family = qf THEN 0.75 WHEN abs(family - qf) = 1 THEN 0.60 ELSE 0.40 END) END::DOUBLE, 10) AS score FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s)
SELECT *, CASE WHEN score >= 0.95 THEN 'exact' WHEN score >= 0.85 THEN 'near' WHEN score >= 0.70 THEN 'similar' WHEN score >= 0.50 THEN 'style' ELSE 'weak' END AS category, score >= 0.40 AS visible FROM k WHERE rank <= 40"""


def _assets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.substring(F.md5(F.col("text").cast("binary")), 1, 16).alias("phash"))
    e = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("dino"), F.slice("embedding", 33, 32).alias("clip"), F.col("label").alias("family"))
    return d.join(e, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("id"), "dino", "clip", "phash", "family")


@register("image_search", _IMG)
def image_search(spark, sf):
    """Every twentieth picture against the archive: layers, fusion, family gate, ranking, display flag."""
    a = _assets(spark, sf)
    q = a.where("id % 20 = 0").select(F.col("id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in ("dino", "clip", "phash", "family")])
    return S.image_search(a, q, S.SearchQuery(top_k=40))


def _text_sql() -> str:
    terms = [("red", 1.0), ("ring", 1.0), ("band", 0.9)]
    pad = "' ' || regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') || ' '"
    parts = [x for t, w in terms for x in (f"CASE WHEN contains({pad}, ' {t} ') THEN 0.92 * {w} WHEN contains(lower(p_name), '{t}') THEN 0.55 * {w} END", f"CASE WHEN contains(lower(p_type), '{t}') THEN 0.50 * {w} END", f"CASE WHEN contains(lower(p_brand), '{t}') THEN 0.38 * {w} END")]
    n = " + ".join(f"(({p}) IS NOT NULL)::INT" for p in parts)
    best = ", ".join(f"coalesce({p}, 0)" for p in parts)
    return f"WITH x AS (SELECT p_partkey, greatest({best}) AS best, ({n})::INT AS n_channels FROM part) SELECT p_partkey, round(greatest(0, least(1, best + 0.02 * (n_channels - 1)))::DOUBLE, 6) AS score, n_channels FROM x WHERE best > 0"


@register("text_search", _text_sql())
def text_search(spark, sf):
    q = S.SearchQuery(mode="text", text="red ring", synonyms={"ring": ["band"]})
    return S.text_search(table(spark, sf, "part"), q, "p_partkey", "p_name", "p_type", "p_brand")


@register("below_threshold", f"WITH s AS ({_IMG}) SELECT query_id, id, n FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS n FROM s WHERE NOT visible) WHERE n <= 5")
def below_threshold(spark, sf):
    """Previews of the best rows under the threshold."""
    got = image_search(spark, sf).where("not visible")
    return topk.first_per_key(got, ["query_id"], F.desc("score"), "id", k=5, rank="n").select("query_id", "id", "n")


@register("open_file_relations", """WITH d AS (SELECT doc_id, md5(text) AS h, b, source, lang, n_chars FROM """ + _BLOCKS_SQL + """), q AS (SELECT doc_id AS qid, h AS qh, b AS qb, source AS qs, lang AS ql, n_chars AS qn FROM d WHERE doc_id % 20 = 0)
SELECT qid, doc_id, CASE WHEN h = qh THEN 'same' WHEN b = qb THEN 'variant' ELSE 'similar' END AS relation FROM d JOIN q ON doc_id <> qid AND (h = qh OR b = qb OR (source = qs AND lang = ql AND n_chars = qn))""")
def open_file_relations(spark, sf):
    """Relations of open files, each row claimed by the strongest: equal text, same block of shingles, same scope and size."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "source", "lang", "n_chars")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), _block(_shingles()).alias("b"), F.concat_ws("|", "source", "lang", "n_chars").alias("s"))
    d = materialize(d, "file-keys")  # texts are read once, not once a tier and side
    q = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), *[F.col(c).alias(f"q{c}") for c in "hbs"])
    every = None
    for tier, c in enumerate("hbs"):
        one = d.join(q, F.col(c) == F.col(f"q{c}")).where("doc_id <> qid").select("qid", "doc_id", F.lit(tier).alias("tier"))
        every = one if every is None else every.unionByName(one)
    name = F.element_at(F.array(*map(F.lit, ["same", "variant", "similar"])), F.col("tier") + 1)
    return every.groupBy("qid", "doc_id").agg(F.min("tier").alias("tier")).select("qid", "doc_id", name.alias("relation"))


@register("identity_merge", """WITH RECURSIVE u AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS d FROM embeddings), m AS (SELECT label, d, avg(x::DOUBLE) AS x FROM u GROUP BY ALL), e AS (SELECT label, list(x ORDER BY d) AS v FROM m GROUP BY label),
p AS (SELECT a.label AS u, b.label AS v FROM e a JOIN e b ON a.label < b.label AND list_cosine_similarity(a.v, b.v) >= 0.1), s AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r(id, g) AS (SELECT label, label FROM e UNION SELECT s.u, r.g FROM r JOIN s ON s.v = r.id) SELECT id AS label, min(g) AS person FROM r GROUP BY id""")
def identity_merge(spark, sf):
    """Persons joined where their centroids agree, directly or through others."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    other = c.select(F.col("label").alias("other"), F.col("v").alias("w"))
    pairs = topk.best_of_few(other, c).where((F.col("label") < F.col("other")) & (K.cosine("v", "w") >= 0.1))
    comp = connected_components(pairs.select(F.col("other").alias("u"), F.col("label").alias("v"))).withColumnRenamed("node", "label")
    return c.select("label").join(comp, "label", "left").select("label", F.coalesce("root", "label").alias("person"))
