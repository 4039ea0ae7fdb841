"""Hand-checked values of kernels, text functions and state folds."""

import random

import pytest
from pyspark.sql import functions as F

from loomquery.functions import kernels as K
from loomquery.functions import text as T
from loomquery.operators import relations, state, topk
from loomquery.operators.components import connected_components


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("a,b,want", [("0" * 16, "f" * 16, 64), ("ffffffffffffffff", "fffffffffffffffe", 1), ("", "0" * 16, 64), ("zz", "zz", 64), (None, "0" * 16, 64), ("0" * 15, "0" * 16, 64)])
def test_hamming(spark, a, b, want):
    assert one(spark, K.hamming_hex(F.lit(a).cast("string"), F.lit(b))) == want


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, K.cosine(v(1, 0), v(1, 0))) == 1.0
    assert one(spark, K.cosine(v(1, 0), v(-1, 0))) == 0.0
    assert one(spark, K.cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(spark, K.cosine(v(1, 0), v(1, 0, 0))) == 0.0
    assert one(spark, K.cosine(F.lit(None).cast("array<double>"), v(1))) == 0.0
    assert abs(one(spark, K.correlation(v(1, 2, 3), v(2, 4, 6))) - 1) < 1e-12
    assert one(spark, K.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, K.jaccard(F.array().cast("array<string>"), F.array(F.lit("b")))) == 0.0


def test_ladders(spark):
    f = lambda *x: [F.lit(float(y)) for y in x]
    t, n = F.lit(True), F.lit(False)
    same, other = (F.lit("a"), F.lit("a")), (F.lit("a"), F.lit("b"))
    assert one(spark, K.duplicate_class(n, *f(0.99, 0.97, 0), same, same)) == "exact"
    assert one(spark, K.duplicate_class(n, *f(0.89, 0.83, 0), other, same)) == "color_variant"
    assert one(spark, K.duplicate_class(n, *f(0.83, 0.76, 0), same, other)) == "scale_variant"
    assert one(spark, K.duplicate_class(n, *f(0.86, 0.81, 0), same, same)) == "near"
    assert one(spark, K.duplicate_class(n, *f(0.1, 0.1, 0.1), same, same)) == "none"
    assert one(spark, K.protected_floor(*f(0.96, 0.91, 0), t, n)) == 0.95
    assert one(spark, K.protected_floor(*f(0.96, 0.91, 0), n, n)) == 0.90
    assert one(spark, K.classical(*f(0.99, 0, 0, 0, 0))) == 0.98
    assert K.effective_weights("important")["color"] == pytest.approx(0.2 / 1.1)


def test_text(spark):
    for name in ("Mickey_S.tif", "Mickey_XL.eps", "Mickey_final.eps"):
        assert one(spark, T.variant_stem(F.lit(name))) == "mickey"
    assert one(spark, T.fold(F.lit(" ÇİÇEK Işık "))) == "cicek isik"
    assert one(spark, T.extension(F.lit("a/b.x.TIF"))) == "tif"
    assert one(spark, T.has_phrase(F.lit("All rights-reserved."), "rights reserved")) is True
    assert one(spark, T.has_phrase(F.lit("brightsreserved"), "rights reserved")) is False
    assert one(spark, T.under(F.lit("a/bc"), "a/b")) is False
    assert one(spark, T.file_size(F.lit(2048))) == "2.0 KB"


def test_adaptive():
    assert [topk.adaptive_k(k, 11769) for k in (800, 1600, 6400, 11769)] == [1600, 3200, 11769, None]
    assert topk.should_stop(0, 0.9, 0.9, 5, 0.9, 0.4) and topk.should_stop(5, 0.5, 0.9, 5, 0.9, 0.4) and not topk.should_stop(5, 0.8, 0.9, 5, 0.9, 0.4)


def test_box_relations(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"))])
    rel = lambda a, b: one(spark, K.box_relation(box(*a), box(*b)))
    assert rel((0.1, 0.1, 0.2, 0.2), (0, 0, 1, 1)) == "inside"
    assert rel((0, 0, 1, 1), (0.1, 0.1, 0.2, 0.2)) == "contains"
    assert rel((0, 0, 0.2, 0.2), (0.5, 0, 0.7, 0.2)) == "left_of"
    assert rel((0, 0.5, 0.2, 0.7), (0, 0, 0.2, 0.2)) == "below"
    assert rel((0, 0, 0.4, 0.4), (0.2, 0.2, 0.6, 0.6)) == "overlapping"


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in root)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_state_folds(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(1, "", 9.0), (3, "c", None)], "k int, s string, v double")
    assert sorted(map(tuple, state.merge_fields(old, new, "k", ["s", "v"]).collect())) == [(1, "a", 9.0), (2, "b", 2.0), (3, "c", None)]
    ev = spark.createDataFrame([(1, 1, "x"), (1, 2, "clear"), (1, 3, "y"), (2, 1, "z")], "k int, t int, e string")
    kept = state.after_last_clear(ev, "k", "t", "t", F.col("e") == "clear")
    assert sorted(r["e"] for r in kept.collect()) == ["y", "z"]
    jobs = spark.createDataFrame([(s, i) for s, n in ((1, 5), (2, 1)) for i in range(n)], "source int, i int")
    assert [(r["source"], r["i"]) for r in state.claim_fair(jobs, "source", 3, "i").collect()] == [(1, 0), (2, 0), (1, 1)]


def test_leader_clusters(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [0.99, 0.01]), (0, 3, [0.0, 1.0]), (1, 4, [0.0, 1.0])]
    got = relations.leader_clusters(spark.createDataFrame(rows, "k long, id long, v array<double>"), "k", "id", "v", 0.8)
    assert sorted((r["id"], r["cluster"]) for r in got.collect()) == [(1, 0), (2, 0), (3, 1), (4, 0)]
