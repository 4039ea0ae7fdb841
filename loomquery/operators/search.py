"""End-to-end search: candidate layers, scoring, gates, ranking, as one chain of DataFrames a query batch wide."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions import kernels as K
from loomquery.functions import text as T
from loomquery.operators import topk


@dataclass
class SearchQuery:
    """What a search asks for; image queries come as a table, text queries as terms."""

    mode: str = "image"
    text: str = ""
    threshold: float = 0.40
    top_k: int = 100
    color: str = "normal"
    scope: Column | None = None
    synonyms: dict[str, list[str]] = field(default_factory=dict)

    def terms(self) -> list[str]:
        out = [t for t in self.text.lower().split() if len(t) >= 2]
        return list(dict.fromkeys(out + [s for t in out for s in self.synonyms.get(t, [])]))


def image_search(assets: DataFrame, queries: DataFrame, q: SearchQuery, id_col: str = "id") -> DataFrame:
    """(query_id, id, score, layers, category, rank, visible).

    assets: id, dino, clip, phash, family. queries: query_id and the same features with a q_ prefix. Candidates are
    each vector's top_k and the rows in the query's hash bucket; hashes, vectors and family then decide the score.
    """
    pool = assets.where(q.scope) if q.scope is not None else assets
    layers = []
    for name in ("dino", "clip"):
        got = topk.knn(queries.select("query_id", F.col(f"q_{name}").alias("query_vec")), pool.select(id_col, F.col(name).alias("v")), q.top_k, vec="v", id_col=id_col)
        layers.append(got.select("query_id", id_col, F.lit(name).alias("layer")))
    bucket = queries.select("query_id", F.substring("q_phash", 1, 2).alias("b"))
    layers.append(pool.select(id_col, F.substring("phash", 1, 2).alias("b")).join(bucket, "b").where(F.col("query_id") != F.col(id_col)).select("query_id", id_col, F.lit("hash").alias("layer")))
    found = layers[0].unionByName(layers[1]).unionByName(layers[2]).groupBy("query_id", id_col).agg(F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"))
    full = found.join(pool, id_col).join(queries, "query_id")
    p, d, c = F.round(K.phash_similarity("phash", "q_phash"), 6), F.round(K.cosine("dino", "q_dino"), 6), F.round(K.cosine("clip", "q_clip"), 6)
    w = K.effective_weights(q.color)
    same = F.col("family") == F.col("q_family")
    base = (w["dino"] * d + w["clip"] * c + w["phash"] * p) / (w["dino"] + w["clip"] + w["phash"])
    relation = F.when(same, "same").when(F.abs(F.col("family") - F.col("q_family")) == 1, "related").otherwise("unrelated")
    score = F.when(p >= 0.98, F.greatest(base, F.lit(0.98))).otherwise(F.least(base + F.when(same, 0.12).otherwise(0.0), K.family_cap(relation, F.lit(False))))
    scored = full.select("query_id", id_col, "layers", F.round(score, 10).alias("score"))
    category = F.when(F.col("score") >= 0.95, "exact").when(F.col("score") >= 0.85, "near").when(F.col("score") >= 0.70, "similar").when(F.col("score") >= 0.50, "style").otherwise("weak")
    ranked = topk.first_per_key(scored, ["query_id"], F.desc("score"), id_col, k=q.top_k, rank="rank")
    return ranked.withColumn("category", category).withColumn("visible", F.col("score") >= q.threshold)


def text_search(assets: DataFrame, q: SearchQuery, id_col: str, title: str, body: str, source: str) -> DataFrame:
    """(id, score, channels) of rows that any channel finds: title, category, source and synonyms; the best channel
    scores, and each further one adds a little."""
    parts, names = [], []
    direct = q.text.lower().split()
    for term in q.terms():
        weight = 1.0 if term in direct else 0.9
        parts += [F.when(T.has_phrase(title, term), 0.92 * weight).when(F.lower(title).contains(term), 0.55 * weight), F.when(F.lower(body).contains(term), 0.50 * weight), F.when(F.lower(source).contains(term), 0.38 * weight)]
        names += [f"title:{term}", f"body:{term}", f"source:{term}"]
    hits = F.array(*[F.when(p.isNotNull(), F.lit(n)) for p, n in zip(parts, names)])
    got = assets.select(id_col, F.greatest(*[F.coalesce(p, F.lit(0.0)) for p in parts]).alias("best"), F.filter(hits, lambda x: x.isNotNull()).alias("hit")).where("best > 0")
    return got.select(id_col, F.round(K.clamp(F.col("best") + 0.02 * (F.size("hit") - 1)), 6).alias("score"), F.size("hit").alias("n_channels"))
