"""Rankings by concepts and by a tree of objects; a supplier's number stands in for a query, its line items for the rows found."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.functions.kernels import TEXT_ANCHORS
from loomquery.operators import hierarchy as H
from loomquery.plans.archive import _ladder
from loomquery.plans.registry import register
from loomquery.session import table

_KEY = "l_suppkey, l_orderkey, l_linenumber, l_partkey"
_TIE = ["l_orderkey", "l_linenumber", "l_partkey"]


def _rows(spark, sf, kinds):
    """Line items of the suppliers whose number is of a kind, with the scores that stand in for what was seen."""
    c = F.col
    return table(spark, sf, "lineitem").where((c("l_suppkey") % 4).isin(*kinds)).select(
        "l_suppkey", *_TIE, (c("l_discount") * 4).alias("own"), (c("l_tax") * 5).alias("other"), F.when(c("l_partkey") % 3 == 0, 0.0).otherwise(c("l_quantity") / 50).alias("text"),
        (c("l_partkey") % 5 == 0).alias("photo"), (c("l_partkey") % 2 == 0).alias("motif"), (c("l_partkey") % 7 < 3).alias("mixed"), (c("l_returnflag") == "R").alias("found"),
    )


def _sql_rows(kinds: str) -> str:
    return f"""x AS (SELECT {_KEY}, l_discount * 4 AS own, l_tax * 5 AS other, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_quantity / 50 END AS text, l_partkey % 5 = 0 AS photo, l_partkey % 2 = 0 AS motif, l_partkey % 7 < 3 AS mixed, l_returnflag = 'R' AS found FROM lineitem WHERE l_suppkey % 4 IN ({kinds}))"""


def _first(verdicts: str, most: int, score: str = "score", order: str = "bucket") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {order}, {score} DESC, l_orderkey, l_linenumber, l_partkey)::INT AS rank FROM {verdicts} QUALIFY rank <= {most})"


@register("composition_rank", f"""WITH {_sql_rows('0')}, y AS (SELECT *, own >= 0.22 AS p1, other >= 0.22 OR found AS p2 FROM x WHERE NOT photo),
v AS (SELECT {_KEY}, CASE WHEN p1 AND p2 THEN round(least(0.96, greatest(text, least(own, other)) + 0.08)::DOUBLE, 4) ELSE round(least(0.86, 0.82 * greatest(text, CASE WHEN p1 THEN own ELSE 0 END, CASE WHEN p2 THEN other ELSE 0 END))::DOUBLE, 4) END AS score,
 CASE WHEN p1 AND p2 THEN 0 ELSE 1 END AS bucket, CASE WHEN p1 AND p2 THEN 'composite_match' ELSE 'partial_composite' END AS reason FROM y WHERE (p1 AND p2) OR ((p1 OR p2) AND text > 0))
SELECT {_KEY}, score, bucket, reason, rank FROM {_first('v', H.COMPOSITION_ROWS)}""")
def composition_rank(spark, sf):
    """Rows for a query of two concepts; another channel may find the second."""
    c = F.col
    v = H.composition([c("own"), c("other")], [c("own") >= H.PATTERN_MIN, (c("other") >= H.PATTERN_MIN) | c("found")], c("text"), c("photo"))
    got = H.best_verdicts(_rows(spark, sf, [0]), v, ["l_suppkey"], _TIE, H.COMPOSITION_ROWS)
    return got.select("l_suppkey", *_TIE, "score", "bucket", "reason", "rank")


def _single(most: int, kinds: str) -> str:
    return f"""WITH {_sql_rows(kinds)}, y AS (SELECT *, l_suppkey % 4 = 1 AS object, l_suppkey % 4 = 3 AS as_photo, {_ladder('own', TEXT_ANCHORS)} AS seen FROM x),
z AS (SELECT *, CASE WHEN object AND own < 0.26 THEN 'gone' WHEN as_photo THEN CASE WHEN photo THEN 'photograph' ELSE 'gone' END WHEN photo AND object THEN 'gone' WHEN own < 0.22 AND NOT motif AND text <= 0 THEN 'gone' WHEN own < 0.22 AND text > 0 THEN 'kept_by_text' WHEN other >= 0.24 AND mixed THEN 'part_of_composite' ELSE 'pure' END AS reason FROM y),
v AS (SELECT {_KEY}, reason, CASE WHEN reason = 'part_of_composite' OR (reason = 'kept_by_text' AND other >= 0.24) THEN 1 ELSE 0 END AS bucket, CASE reason WHEN 'photograph' THEN round(greatest(own, text)::DOUBLE, 4) WHEN 'kept_by_text' THEN least(text, 0.58)
 WHEN 'part_of_composite' THEN round((0.72 * own + 0.08)::DOUBLE, 4) ELSE CASE WHEN own >= 0.22 THEN round(least(0.97, seen + least(0.05, greatest(0, text - seen) * 0.08))::DOUBLE, 4) ELSE round(least(text, 0.58)::DOUBLE, 4) END END::DOUBLE AS score FROM z WHERE reason <> 'gone')
SELECT {_KEY}, score, bucket, reason, rank FROM {_first('v', most)}"""


def _single_rank(spark, sf, kinds, most):
    c, kind = F.col, F.col("l_suppkey") % 4
    v = H.single(H.Shown(c("own"), c("other"), c("text"), c("photo"), c("motif"), c("mixed")), kind == 1, kind == 3, kind == 1)
    return H.best_verdicts(_rows(spark, sf, kinds), v, ["l_suppkey"], _TIE, most).select("l_suppkey", *_TIE, "score", "bucket", "reason", "rank")


@register("object_rank", _single(H.LEAF_ROWS, "1"))
def object_rank(spark, sf):
    """Rows for a query of one object, a short list."""
    return _single_rank(spark, sf, [1], H.LEAF_ROWS)


@register("pattern_rank", _single(H.PATTERN_ROWS, "2, 3"))
def pattern_rank(spark, sf):
    """Rows for a query of one pattern, or for photographs, a long list."""
    return _single_rank(spark, sf, [2, 3], H.PATTERN_ROWS)


@register("tree_rank", f"""WITH x AS (SELECT {_KEY}, l_discount * 4 AS own, l_quantity / 125 AS child, CASE WHEN l_partkey % 4 > 0 THEN l_tax * 5 END AS rival, (l_partkey % 9) / 20.0::DOUBLE AS dist, l_returnflag = 'R' AS won, l_partkey % 11 = 0 AS strong, l_partkey % 13 = 0 AS conflict,
 l_partkey % 6 = 0 AS named, l_partkey % 17 = 0 AS indexed, l_partkey % 8 = 0 AS card, l_suppkey % 2 = 0 AS leaf, l_suppkey % 3 > 0 AS hard, l_suppkey % 5 > 0 AS scored, l_suppkey % 10 = 7 AS by_text, l_quantity / 50 AS score FROM lineitem),
y AS (SELECT *, greatest(own, child) AS best, CASE WHEN hard THEN 0.26 ELSE 0.22 END AS need, coalesce(rival, 0) AS r, ((won OR strong) AND (NOT hard OR greatest(own, child) >= 0.26 OR strong)) OR indexed AS win FROM x),
t AS (SELECT *, CASE WHEN NOT leaf THEN CASE WHEN best >= need OR (win AND NOT hard) THEN 'same_family/family_query' ELSE 'semantic/weak_family' END WHEN own < need AND NOT (win AND NOT hard) THEN CASE WHEN r > 0 AND r >= need THEN 'same_family/unspecific' ELSE 'semantic/unknown_subtype' END
 WHEN rival IS NULL THEN 'very_similar/no_rival_scores' WHEN r > 0 AND own <= r + 0.02 THEN 'same_family/rival' WHEN own >= need + 0.04 AND own > r + 0.03 THEN 'exact/leaf_win' ELSE 'very_similar/leaf_ok' END AS tr FROM y),
e AS (SELECT *, split_part(tr, '/', 1) AS tier0, split_part(tr, '/', 2) AS reason0, CASE WHEN hard AND NOT indexed AND (conflict OR (dist >= 0.26 AND dist > best + 0.03 AND best < 0.26)) THEN 'mismatch' WHEN hard AND best < 0.26 AND NOT (card OR indexed) THEN 'unknown' WHEN tr LIKE 'exact%' THEN 'exact'
 WHEN tr LIKE 'same_family%' OR tr LIKE 'very_similar%' THEN 'family' WHEN best >= 0.26 OR card OR indexed THEN 'semantic' ELSE 'unknown' END AS evidence FROM t),
d AS (SELECT *, evidence = 'mismatch' OR (evidence = 'unknown' AND hard AND reason0 = 'family_query') AS demoted FROM e),
f AS (SELECT *, CASE WHEN demoted THEN 'semantic' ELSE tier0 END AS tier, CASE WHEN evidence = 'mismatch' THEN 'object_mismatch' WHEN demoted THEN 'no_object_clip' ELSE reason0 END AS reason FROM d),
g AS (SELECT *, CASE tier WHEN 'exact' THEN 0 WHEN 'very_similar' THEN 1 WHEN 'same_family' THEN 3 ELSE 4 END AS o FROM f WHERE NOT (((scored AND NOT by_text) OR (hard AND evidence = 'mismatch' AND NOT named)) AND NOT win AND (evidence IN ('mismatch', 'unknown') OR tier = 'semantic' OR (leaf AND reason = 'unspecific')))),
k AS (SELECT {_KEY}, score, tier, evidence, reason, leaf, CASE WHEN evidence = 'mismatch' THEN 6 WHEN evidence = 'unknown' AND hard THEN greatest(o, 5) ELSE o END::INT AS place FROM g)
SELECT {_KEY}, score, tier, evidence, reason, place, CASE WHEN leaf THEN rank END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY place, score DESC, l_orderkey, l_linenumber, l_partkey)::INT AS rank FROM k) WHERE NOT leaf OR rank <= {H.LEAF_ROWS}""")
def tree_rank(spark, sf):
    """Rows for a node of the object tree: tiers against the node's rivals, evidence, and what shows something else gone."""
    c, n = F.col, F.col("l_suppkey")
    p = lambda k: c("l_partkey") % k == 0
    rows = table(spark, sf, "lineitem").select("l_suppkey", *_TIE, "l_discount", "l_tax", "l_quantity", "l_returnflag", (c("l_quantity") / 50).alias("score"))
    e = H.Seen(
        own=c("l_discount") * 4, child=c("l_quantity") / 125, rival=F.when(~p(4), c("l_tax") * 5), distractor=c("l_partkey") % 9 / 20.0, win=c("l_returnflag") == "R",
        strong=p(11), conflict=p(13), named=p(6), indexed=p(17), card=p(8),
    )
    got = H.ranked_by_tree(rows, e, n % 2 == 0, n % 3 > 0, n % 5 > 0, n % 10 == 7, ["l_suppkey"], "score", _TIE)
    return got.select("l_suppkey", *_TIE, "score", "tier", "evidence", "reason", "place", "rank")
