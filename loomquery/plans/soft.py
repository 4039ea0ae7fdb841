"""Soft rescoring layers on scored rows; lineitem's numeric columns stand for the channels of a scored result."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.operators import rescoring as R
from loomquery.operators import topk
from loomquery.plans.registry import register
from loomquery.session import table

_S = """s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS clip, least(1, l_quantity / 50) AS dino, l_tax * 12.5 AS color, (l_partkey % 101) / 100.0 AS dna, (l_suppkey % 11) / 10.0 AS fam, (l_orderkey % 97) / 96.0 AS tex,
 (l_partkey % 53) / 52.0 AS txt, (l_partkey % 4)::INT AS hits, (l_suppkey % 3)::INT AS misses, l_returnflag = 'R' AS neg, l_linestatus = 'O' AS obj, 0.5 * (l_discount * 10) + 0.5 * least(1, l_quantity / 50) AS score FROM lineitem)"""


def _scored(spark, sf):
    c = F.col
    clip, dino = c("l_discount") * 10, F.least(F.lit(1.0), c("l_quantity") / 50)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", clip.alias("clip"), dino.alias("dino"), (c("l_tax") * 12.5).alias("color"), (c("l_partkey") % 101 / 100.0).alias("dna"), (c("l_suppkey") % 11 / 10.0).alias("fam"),
        (c("l_orderkey") % 97 / 96.0).alias("tex"), (c("l_partkey") % 53 / 52.0).alias("txt"), (c("l_partkey") % 4).cast("int").alias("hits"), (c("l_suppkey") % 3).cast("int").alias("misses"),
        (c("l_returnflag") == "R").alias("neg"), (c("l_linestatus") == "O").alias("obj"), (0.5 * clip + 0.5 * dino).alias("score"),
    )


def _layer(name: str, sql: str, build):
    """Register one layer: Spark and SQL forms over the same scored rows."""

    def query(spark, sf):
        got = R.chain(_scored(spark, sf), "score", build(F.col))
        return got.select("l_orderkey", "l_linenumber", "score")

    query.__name__ = name
    register(name, f"WITH {_S} SELECT l_orderkey, l_linenumber, round(({sql})::DOUBLE, 9) AS score FROM s")(query)


def _clamp(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


_ATT = "CASE WHEN obj THEN CASE WHEN dna - 0.5 >= 0 THEN least(0.10, 0.045 + 0.055 * (dna - 0.5)) ELSE greatest(-0.05, -0.035 + 0.045 * (dna - 0.5)) END ELSE 0 END"
_layer("attribute_soft", _clamp(f"score + {_ATT}"), lambda c: [R.attributes(c("dna") - 0.5, c("obj"))])

_CLR = "CASE WHEN NOT neg THEN greatest(-0.04, least(0.08, CASE WHEN hits > 0 THEN least(0.08, 0.03 * hits + 0.02) ELSE 0 END - CASE WHEN misses > 0 AND hits = 0 THEN least(0.04, 0.02 * misses) WHEN misses > 0 AND hits > 0 THEN least(0.02, 0.01 * misses) ELSE 0 END)) ELSE 0 END"
_layer("color_evidence", _clamp(f"score + {_CLR}"), lambda c: [R.colour_evidence(c("hits"), c("misses"), ~c("neg"))])

_layer(
    "object_pattern_gate",
    "CASE WHEN txt > 0.95 THEN score WHEN tex >= 0.55 THEN CASE WHEN tex >= 0.72 AND dna < 0.55 THEN least(1, score + 0.025) ELSE score END WHEN dna >= 0.45 AND tex < 0.35 THEN score * (1 - least(0.32, 0.10 + 0.28 * greatest(dna - tex, 0))) WHEN dna > tex + 0.20 THEN score * (1 - least(0.12, 0.06 + 0.15 * (dna - tex))) ELSE score END",
    lambda c: [R.pattern_not_object(c("tex"), c("dna"), c("txt") > 0.95)],
)

_EVD = "CASE WHEN hits > 1 THEN 0.08 WHEN misses > 1 THEN -0.10 ELSE 0 END + CASE WHEN txt > 0.8 THEN 0.06 ELSE 0 END + CASE WHEN dino > 0.8 THEN 0.08 ELSE 0 END - CASE WHEN neg THEN CASE WHEN fam >= 0.3 THEN 0.03 ELSE 0.12 END ELSE 0 END + CASE hits WHEN 2 THEN 0.10 WHEN 1 THEN 0.06 ELSE 0 END - CASE WHEN dna < 0.1 THEN 0.05 ELSE 0 END"
_layer(
    "query_evidence",
    f"CASE WHEN NOT neg OR fam >= 0.3 THEN {_clamp(f'score + {_EVD}')} ELSE least({_clamp(f'score + {_EVD}')}, 0.48) END",
    lambda c: [R.query_evidence(F.when(c("hits") > 1, 1).when(c("misses") > 1, -1).otherwise(0), c("txt") > 0.8, c("dino") > 0.8, c("neg"), c("fam") >= 0.3, c("hits"), c("dna") < 0.1, ~c("neg") | (c("fam") >= 0.3))],
)

_layer(
    "intent_routing", _clamp("score + CASE WHEN obj THEN 0.10 ELSE 0 END + CASE WHEN fam > 0.5 THEN 0.05 ELSE 0 END + CASE WHEN hits > 1 THEN 0.04 ELSE 0 END - CASE WHEN neg THEN 0.06 ELSE 0 END"),
    lambda c: [R.intent(c("obj"), c("fam") > 0.5, c("hits") > 1, c("neg"))],
)

_layer(
    "concept_evidence", _clamp("score + CASE WHEN obj THEN greatest(-0.04, CASE WHEN hits - misses = 2 THEN 0.025 WHEN hits - misses = 1 THEN 0.015 WHEN hits - misses = -1 THEN -0.01 WHEN hits - misses = -2 THEN -0.02 ELSE 0 END + least(0.02, 0.01 * hits)) ELSE 0 END"),
    lambda c: [R.concept_evidence(c("hits") - c("misses"), c("hits"), c("obj"))],
)

_BON = "CASE WHEN color >= 0.5 THEN CASE WHEN obj THEN 0.06 * color ELSE 0.01 * color END ELSE 0 END + CASE WHEN hits > 1 THEN 0.06 * fam WHEN fam > 0 THEN 0.02 * fam ELSE 0 END + CASE WHEN tex >= 0.5 THEN 0.05 * tex ELSE 0 END + CASE WHEN dna >= 0.5 THEN 0.08 * dna WHEN neg THEN -0.04 ELSE 0 END + CASE WHEN color >= 0.5 AND fam >= 0.5 THEN 0.04 WHEN txt >= 0.5 THEN 0.015 * txt ELSE 0 END"
_layer(
    "fusion_channels", f"CASE WHEN color < 0.5 THEN least(CASE WHEN neg THEN least(least(1, score + {_BON}), 0.42) ELSE least(1, score + {_BON}) END, 0.50) ELSE CASE WHEN neg THEN least(least(1, score + {_BON}), 0.42) ELSE least(1, score + {_BON}) END END",
    lambda c: [R.fusion(c("color"), c("obj"), c("fam"), c("hits") > 1, c("tex"), c("dna"), c("neg"), c("txt"), (c("color") >= 0.5) & (c("fam") >= 0.5))],
)

_layer(
    "visual_pattern_priority",
    f"CASE WHEN neg THEN least(score, 0.42) WHEN dna >= 0.6 THEN greatest({_clamp('score + 0.16 * dna + 0.12 * fam + 0.08 * tex + 0.06 * dino + 0.04 * clip + 0.02 * color + 0.01 * least(txt, 0.3)')}, least(1, 0.62 + 0.28 * (0.4 * dna + 0.3 * fam + 0.3 * tex))) ELSE {_clamp('score + 0.05 * dna + 0.04 * fam + 0.03 * tex + 0.025 * dino + 0.02 * clip + 0.01 * color + 0.005 * txt')} END",
    lambda c: [R.visual_pattern(c("dna") >= 0.6, c("neg"), c("dna"), c("fam"), c("tex"), c("dino"), c("clip"), c("color"), c("txt"))],
)

_layer(
    "rescoring_chain", _clamp(f"{_clamp(f'{_clamp(f'score + {_ATT}')} + {_CLR}')} - CASE WHEN misses = 2 THEN 0.08 ELSE 0 END"),
    lambda c: [R.attributes(c("dna") - 0.5, c("obj")), R.colour_evidence(c("hits"), c("misses"), ~c("neg")), R.rivals(c("misses") == 2)],
)

_MULTI = "0.30 * (hits / 3.0) + 0.25 * fam + 0.15 * tex + 0.10 * clip + 0.10 * dino + 0.05 * dna + 0.05 * color"
_MGOT = f"(CASE WHEN hits < 3 THEN 0.82 ELSE 1 END * ({_MULTI}) - 0.10 * CASE WHEN neg THEN 1 ELSE 0 END)"


@register("multi_concept", f"WITH {_S} SELECT l_orderkey, l_linenumber, round({_clamp(f'CASE WHEN hits >= 3 AND fam < 0.35 THEN least({_MGOT}, 0.60) ELSE {_MGOT} END')}::DOUBLE, 9) AS score FROM s")
def multi_concept(spark, sf):
    c = F.col
    got = R.multi_concept(c("hits") / 3.0, c("fam"), c("tex"), c("clip"), c("dino"), c("dna"), c("color"), c("neg").cast("double"), F.lit(True))
    return _scored(spark, sf).select("l_orderkey", "l_linenumber", F.round(got, 9).alias("score"))


@register("semantic_gate", f"WITH {_S}, g AS (SELECT *, CASE WHEN txt >= 0.78 THEN 'exact' WHEN clip >= 0.7 AND clip > tex THEN 'very_similar' WHEN clip >= 0.5 AND clip >= tex THEN 'variant' ELSE 'semantic' END AS tier FROM s) SELECT l_orderkey, l_linenumber, tier, round(least(score, CASE tier WHEN 'exact' THEN 0.78 WHEN 'very_similar' THEN 0.70 ELSE 0.58 END)::DOUBLE, 9) AS score FROM g")
def semantic_gate(spark, sf):
    c = F.col
    g = _scored(spark, sf).withColumn("tier", R.semantic_gate(c("clip"), c("tex"), c("txt")))
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in R.TIER_CAPS.items() for x in kv]), c("tier"))
    return g.select("l_orderkey", "l_linenumber", "tier", F.round(F.least("score", cap), 9).alias("score"))


@register("evidence_gate", f"WITH {_S} SELECT l_orderkey, l_linenumber, CASE WHEN hits >= 2 AND NOT neg THEN 0 WHEN fam >= 0.5 AND NOT neg THEN 1 WHEN NOT neg THEN 2 ELSE 3 END::INT AS tier FROM s WHERE score >= 0.2")
def evidence_gate(spark, sf):
    """Ordered tiers of evidence: hard, family, soft, blocked."""
    c = F.col
    tier = F.when((c("hits") >= 2) & ~c("neg"), 0).when((c("fam") >= 0.5) & ~c("neg"), 1).when(~c("neg"), 2).otherwise(3)
    return _scored(spark, sf).where("score >= 0.2").select("l_orderkey", "l_linenumber", tier.alias("tier"))


@register("result_layers", f"""WITH {_S}, l AS (SELECT *, CASE WHEN score >= 0.95 THEN 0 WHEN obj AND fam >= 0.8 THEN 1 WHEN hits = 3 THEN 2 WHEN score >= 0.85 THEN 3 WHEN fam >= 0.5 THEN 4 WHEN score >= 0.5 THEN 5 ELSE 6 END::INT AS layer FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY round(score, 9) DESC, l_orderkey, l_linenumber)::INT AS n FROM l) SELECT layer, l_orderkey, l_linenumber, n FROM r WHERE n <= 50""")
def result_layers(spark, sf):
    """Results by layer as they are shown: each layer's first page of 50."""
    c = F.col
    layer = F.when(c("score") >= 0.95, 0).when(c("obj") & (c("fam") >= 0.8), 1).when(c("hits") == 3, 2).when(c("score") >= 0.85, 3).when(c("fam") >= 0.5, 4).when(c("score") >= 0.5, 5).otherwise(6)
    l = _scored(spark, sf).withColumn("layer", layer)  # noqa: E741
    return topk.first_per_key(l, ["layer"], F.desc(F.round("score", 9)), "l_orderkey", "l_linenumber", k=50, rank="n").select("layer", "l_orderkey", "l_linenumber", "n")


@register("structure_caps", f"WITH {_S} SELECT l_orderkey, l_linenumber, round(CASE WHEN NOT obj AND dino < 0.62 AND clip < 0.85 THEN least(score, 0.28 + 0.50 * dino + 0.05 * tex) WHEN clip < 0.55 AND dino < 0.65 THEN least(score, greatest(0.35, 0.70 * tex, 0.60 * dna)) ELSE score END::DOUBLE, 9) AS score FROM s")
def structure_caps(spark, sf):
    """Caps for rows whose structure does not support their score."""
    c = F.col
    low = F.least(c("score"), 0.28 + 0.50 * c("dino") + 0.05 * c("tex"))
    mid = F.least(c("score"), F.greatest(F.lit(0.35), 0.70 * c("tex"), 0.60 * c("dna")))
    out = F.when(~c("obj") & (c("dino") < 0.62) & (c("clip") < 0.85), low).when((c("clip") < 0.55) & (c("dino") < 0.65), mid).otherwise(c("score"))
    return _scored(spark, sf).select("l_orderkey", "l_linenumber", F.round(out, 9).alias("score"))
