"""Vector queries on embeddings: neighbours, boosts, norms, centroids, identities, concepts, clusters.

The query sets are the rows whose vec_id is divisible by 20; each query runs against all rows.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomquery.functions import kernels as K
from loomquery.operators import relations, topk
from loomquery.plans.registry import register
from loomquery.session import materialize, spread, table

_COS = "greatest(0, coalesce(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 0))"


def _queries(pool):
    return pool.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


_PAIRS = f"""pairs AS (SELECT q.vec_id AS query_id, p.vec_id, p.label, round({_COS.format(a='q.embedding', b='p.embedding')}, 6) AS sim
  FROM embeddings q JOIN embeddings p ON q.vec_id % 20 = 0 AND q.vec_id <> p.vec_id)"""


@register("knn_topk", f"WITH {_PAIRS} SELECT * FROM (SELECT query_id, vec_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id)::INT AS rank FROM pairs) WHERE rank <= 10")
def knn_topk(spark, sf):
    pool = table(spark, sf, "embeddings")
    return topk.knn(_queries(pool), pool, 10)


@register("knn_floor_expand", f"""WITH {_PAIRS}, r AS (SELECT query_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CASE WHEN rank <= 20 THEN 20 WHEN rank <= 40 THEN 40 WHEN rank <= 80 THEN 80 ELSE 160 END::INT AS band, count(*) AS n, sum(CASE WHEN sim >= 0.2 THEN 1 ELSE 0 END)::BIGINT AS above, round(quantile_cont(sim, 0.5), 8) AS median
FROM r WHERE rank <= 160 GROUP BY ALL""")
def knn_floor_expand(spark, sf):
    """Bands that an expanding search walks through (20, 40, 80, 160), with each band's yield over the floor."""
    pool = table(spark, sf, "embeddings")
    r = topk.knn(_queries(pool), pool, 160)
    band = F.when(F.col("rank") <= 20, 20).when(F.col("rank") <= 40, 40).when(F.col("rank") <= 80, 80).otherwise(160)
    return r.groupBy("query_id", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("sim") >= 0.2).cast("long")).alias("above"), F.round(F.percentile("sim", F.lit(0.5)), 8).alias("median"))


@register("expanding_search")
def expanding_search(spark, sf):
    """A search that widens only for the queries whose last step was worth it, and says why each of them ended."""
    pool = table(spark, sf, "embeddings")
    return topk.expanding(_queries(pool), pool, 20, 0.25)


@register("vector_boost_fusion", """WITH p AS (SELECT q.vec_id AS query_id, p.vec_id,
 round(greatest(0, list_cosine_similarity(q.embedding[1:32]::DOUBLE[], p.embedding[1:32]::DOUBLE[])), 6) AS d, round(greatest(0, list_cosine_similarity(q.embedding[33:64]::DOUBLE[], p.embedding[33:64]::DOUBLE[])), 6) AS c
 FROM embeddings q JOIN embeddings p ON q.vec_id % 20 = 0 AND q.vec_id <> p.vec_id),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, vec_id) AS rd, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rc FROM p)
SELECT query_id, vec_id, round(CASE WHEN rd <= 50 THEN 0.35 * d ELSE 0 END + CASE WHEN rc <= 50 THEN 0.25 * c ELSE 0 END, 9) AS boost FROM a WHERE rd <= 50 OR rc <= 50""")
def vector_boost_fusion(spark, sf):
    """Weighted sum of two channels' top-50 lists, the halves of a vector standing for the two models."""
    pool = materialize(spread(table(spark, sf, "embeddings").select("vec_id", "embedding")), "boost-pool")
    parts = []
    for at, weight in ((1, 0.35), (33, 0.25)):
        half = pool.select("vec_id", F.slice("embedding", at, 32).alias("embedding"))
        near = topk.compared(_queries(half), half, "query_id", "vec_id", {"sim": ("query_vec", "embedding")}, "sim", k=50, dealt=True)
        parts.append(near.select("query_id", "vec_id", (F.col("sim") * weight).alias("part")))
    return parts[0].union(parts[1]).groupBy("query_id", "vec_id").agg(F.round(F.sum("part"), 9).alias("boost"))


@register("vector_normalize_audit", """SELECT label, count(*) AS n, sum(CASE WHEN len(embedding) = 64 THEN 1 ELSE 0 END)::BIGINT AS right_size,
 sum(CASE WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) < 0.001 THEN 1 ELSE 0 END)::BIGINT AS unit FROM embeddings GROUP BY label""")
def vector_normalize_audit(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.size("embedding") == 64).cast("long")).alias("right_size"), F.sum((F.abs(K.norm("embedding") - 1) < 0.001).cast("long")).alias("unit"))


@register("hist_correlation", """WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE - list_avg(embedding::DOUBLE[])) AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, round(greatest(0, list_cosine_similarity(a.v, b.v)), 6) AS corr FROM c a JOIN c b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY corr DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 25""")
def hist_correlation(spark, sf):
    """The 25 rows whose histograms correlate best with the query's, centred once a row."""
    pool = table(spark, sf, "embeddings").select("vec_id", K.centred("embedding").alias("embedding"))
    return topk.knn(_queries(pool), pool, 25).withColumnRenamed("sim", "corr")


#: Own prototypes of plain colours.
PROTOTYPES = [("black", 0, 0, 0), ("white", 255, 255, 255), ("red", 200, 30, 40), ("green", 40, 140, 60), ("blue", 40, 70, 170), ("beige", 210, 180, 140), ("cream", 244, 235, 210), ("grey", 128, 128, 128)]
_RGB = "list_transform(embedding[1:3], lambda x: greatest(0, least(255, floor((x::DOUBLE + 0.5) * 255))))"


@register("color_nearest_prototype", f"""WITH p(name, r, g, b) AS (VALUES {', '.join(str(p) for p in PROTOTYPES)}), c AS (SELECT vec_id, {_RGB} AS v FROM embeddings),
d AS (SELECT vec_id, name, round(sqrt((v[1]-r)**2 + (v[2]-g)**2 + (v[3]-b)**2), 6) AS dist FROM c CROSS JOIN p),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, name)::INT AS rank FROM d WHERE dist <= 95) SELECT * FROM k WHERE rank <= 4""")
def color_nearest_prototype(spark, sf):
    """Up to four colour names within 95 of a row's mean colour (the vector's first three components, scaled)."""
    rgb = F.transform(F.slice("embedding", 1, 3), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((x.cast("double") + 0.5) * 255).cast("double"))))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for n, *v in PROTOTYPES])
    near = table(spark, sf, "embeddings").select("vec_id", rgb.alias("rgb")).select("vec_id", F.filter(F.transform(names, lambda p: F.struct(F.round(K.rgb_distance(F.col("rgb"), p["v"]), 6).alias("dist"), p["name"].alias("name"))), lambda x: x["dist"] <= 95).alias("c"))
    return near.select("vec_id", F.posexplode(F.slice(F.array_sort("c"), 1, 4)).alias("i", "x")).select("vec_id", "x.name", "x.dist", (F.col("i") + 1).alias("rank"))


@register("centroid", """WITH u AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS d FROM embeddings) SELECT label, d::INT AS d, round(avg(x::DOUBLE), 6) AS mean FROM u GROUP BY ALL""")
def centroid(spark, sf):
    u = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    return u.groupBy("label", "d").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


_CENTRES = "u AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS d FROM embeddings WHERE vec_id % 20 <> 0), m AS (SELECT label, d, avg(x::DOUBLE) AS x FROM u GROUP BY ALL), c AS (SELECT label, list(x ORDER BY d) AS v FROM m GROUP BY label)"


def _centres(pool):
    u = pool.where("vec_id % 20 <> 0").select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return u.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))


@register("margin_top2", f"""WITH {_CENTRES}, s AS (SELECT q.vec_id, c.label, round({_COS.format(a='q.embedding', b='c.v')}, 6) AS sim FROM embeddings q CROSS JOIN c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER w AS n, lead(sim) OVER w AS runner_up FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY sim DESC, label)) SELECT vec_id, label, sim, runner_up, round(sim - coalesce(runner_up, 0), 6) AS margin FROM r WHERE n = 1""")
def margin_top2(spark, sf):
    pool = table(spark, sf, "embeddings")
    pairs = topk.best_of_few(_queries(pool), _centres(pool))
    s = pairs.select(F.col("query_id").alias("vec_id"), "label", F.round(K.cosine("query_vec", "v"), 6).alias("sim"))
    return topk.with_margin(s, ["vec_id"], "sim", "label")


@register("two_stage_identity", f"""WITH {_CENTRES}, gate AS (SELECT q.vec_id AS query_id, c.label FROM embeddings q CROSS JOIN c WHERE q.vec_id % 20 = 0 AND {_COS.format(a='q.embedding', b='c.v')} >= 0.05),
bb AS (SELECT g.query_id, g.label, round(max({_COS.format(a='q.embedding', b='p.embedding')}), 6) AS best FROM gate g JOIN embeddings q ON q.vec_id = g.query_id JOIN embeddings p ON p.label = g.label AND p.vec_id % 20 <> 0 GROUP BY ALL)
SELECT query_id, label, best, best >= 0.25 AS accepted FROM bb""")
def two_stage_identity(spark, sf):
    """Identities whose centroid passes a gate, then their best exemplar; accepted at a threshold."""
    pool = table(spark, sf, "embeddings")
    gate = topk.best_of_few(_queries(pool), _centres(pool)).where(K.cosine("query_vec", "v") >= 0.05).select("query_id", "label")
    best = topk.best_by_label(_queries(pool), pool.where("vec_id % 20 <> 0"), "query_id", "query_vec", "vec_id", "embedding", "label")
    return best.join(gate, ["query_id", "label"], "left_semi").withColumn("accepted", F.col("best") >= 0.25)


@register("concept_neighbours", f"""WITH pos AS (SELECT * FROM embeddings WHERE vec_id % 40 = 0), neg AS (SELECT * FROM embeddings WHERE vec_id % 40 = 20), rest AS (SELECT * FROM embeddings WHERE vec_id % 20 <> 0),
p AS (SELECT r.vec_id, round(max({_COS.format(a='r.embedding', b='p.embedding')}), 6) AS sim FROM rest r CROSS JOIN pos p GROUP BY ALL), n AS (SELECT r.vec_id, round(max({_COS.format(a='r.embedding', b='p.embedding')}), 6) AS neg FROM rest r CROSS JOIN neg p GROUP BY ALL)
SELECT vec_id, round(sim - CASE WHEN neg >= 0.2 THEN 0.18 * neg ELSE 0 END, 9) AS score FROM p JOIN n USING (vec_id) WHERE sim >= 0.2""")
def concept_neighbours(spark, sf):
    """Neighbours of a concept's positive examples, less a penalty near its negative ones."""
    pool = table(spark, sf, "embeddings")
    rest = pool.where("vec_id % 20 <> 0")

    def best(cond, name):
        # a neighbour or a penalty counts from .2 on, so nothing under that has to leave the workers
        examples = pool.where(cond).select(F.col("vec_id").alias("example"), F.col("embedding").alias("example_vec"))
        near = topk.compared(examples, rest, "example", "vec_id", {"sim": ("example_vec", "embedding")}, "sim", floor=0.2)
        return near.groupBy("vec_id").agg(F.max("sim").alias(name))

    got = best("vec_id % 40 = 0", "sim").join(best("vec_id % 40 = 20", "neg"), "vec_id", "left")
    return got.select("vec_id", F.round(F.col("sim") - 0.18 * F.coalesce("neg", F.lit(0.0)), 9).alias("score"))


@register("cluster_split_gain", """WITH e AS (SELECT vec_id, label, vec_id % 2 AS part, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.label, a.part = b.part AS same, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, round(avg(CASE WHEN same THEN sim END), 6) AS intra, round(avg(CASE WHEN NOT same THEN sim END), 6) AS inter FROM p GROUP BY label""")
def cluster_split_gain(spark, sf):
    """Mean cosine within and between two candidate parts of a cluster. Over unit vectors the pairs' sum follows from
    the vector sums, |S|^2 - n, so no pair is made."""
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 2).alias("part"), K.normalized("embedding").alias("u"))
    per = e.select("label", "part", F.posexplode("u").alias("d", "x")).groupBy("label", "part", "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    part = per.groupBy("label", "part").agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.max("n").alias("n"))
    whole = per.groupBy("label", "d").agg(F.sum("s").alias("s")).groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("all_sq"))
    inside = part.groupBy("label").agg(F.sum("sq").alias("sq"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    both = inside.join(whole, "label")
    n = F.col("n")
    between = n * (n - 1) / 2 - F.col("pairs")
    intra = F.when(F.col("pairs") > 0, (F.col("sq") - n) / 2 / F.col("pairs"))
    inter = F.when(between > 0, (F.col("all_sq") - F.col("sq")) / 2 / between)
    return both.select("label", F.round(intra, 6).alias("intra"), F.round(inter, 6).alias("inter"))


@register("greedy_clusters")
def greedy_clusters(spark, sf):
    """Order-dependent leader clustering of each customer's (label's) rows, all of them in id order."""
    return relations.leader_clusters(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.25)


@register("fine_detail_rerank", """WITH p AS (SELECT q.vec_id AS query_id, p.vec_id, round((list_cosine_similarity(q.embedding[1:12]::DOUBLE[], p.embedding[1:12]::DOUBLE[]) + 1) / 2, 6) AS fine,
 round(greatest(0, list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[])), 6) AS base FROM embeddings q JOIN embeddings p ON q.vec_id % 20 = 0 AND q.vec_id <> p.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, vec_id) AS n FROM p) SELECT query_id, vec_id, base, fine, round(base + 0.12 * fine, 9) AS score FROM r WHERE n <= 80""")
def fine_detail_rerank(spark, sf):
    """The 80 best rows, moved by the likeness of a 12-component signature."""
    pool = table(spark, sf, "embeddings")
    top = topk.knn(_queries(pool), pool, 80).withColumnRenamed("sim", "base")
    got = top.join(pool.select("vec_id", "embedding"), "vec_id").join(_queries(pool), "query_id")
    fine = F.round(K.fine_detail(F.slice("query_vec", 1, 12), F.slice("embedding", 1, 12)), 6)
    return got.select("query_id", "vec_id", "base", fine.alias("fine"), F.round(F.col("base") + 0.12 * fine, 9).alias("score"))


@register("multi_query_merge", f"""WITH {_PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS n FROM pairs), k AS (SELECT * FROM t WHERE n <= 20),
m AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, query_id) AS b, count(*) OVER (PARTITION BY vec_id) AS n_queries FROM k) SELECT vec_id, query_id AS best_query, sim, n_queries FROM m WHERE b = 1""")
def multi_query_merge(spark, sf):
    """Several query pictures merged: each row keeps its best query."""
    pool = table(spark, sf, "embeddings")
    k = topk.knn(_queries(pool), pool, 20)
    got = k.withColumn("n_queries", F.count(F.lit(1)).over(W.partitionBy("vec_id")))
    return topk.first_per_key(got, ["vec_id"], F.desc("sim"), "query_id").select("vec_id", F.col("query_id").alias("best_query"), "sim", "n_queries")


@register("pair_triplet_mining", """WITH e AS (SELECT vec_id, label, md5(vec_id::VARCHAR) AS h FROM embeddings),
a AS (SELECT *, lead(vec_id) OVER (PARTITION BY label ORDER BY h, vec_id) AS positive FROM e), n AS (SELECT label, min_by(vec_id, h) AS head FROM e GROUP BY label)
SELECT a.vec_id AS anchor, a.positive, n.head AS negative FROM a JOIN n ON n.label = (a.label + 1) % 10 WHERE a.positive IS NOT NULL""")
def pair_triplet_mining(spark, sf):
    """Training triplets in a seeded hash order: the next row of the label is the positive, another label's head the negative."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.md5(F.col("vec_id").cast("string").cast("binary")).alias("h"))
    a = e.withColumn("positive", F.lead("vec_id").over(W.partitionBy("label").orderBy("h", "vec_id")))
    n = e.groupBy(F.col("label").alias("other")).agg(F.min_by("vec_id", "h").alias("negative"))
    return a.join(n, (F.col("label") + 1) % 10 == F.col("other")).where("positive is not null").select(F.col("vec_id").alias("anchor"), "positive", "negative")
