"""Operators that SQL cannot state, against plain versions: comparisons, widening searches, clusters, streams, folders."""

import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomquery import session
from loomquery.functions import kernels as K
from loomquery.operators import hierarchy, relations, topk
from loomquery.plans import catalogue, structure
from loomquery.session import shared_dir
from loomquery.streaming import events as S

SF = "/root/testdata/sf0.001"


def test_compared_with_missing_vectors_ties_and_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(120, 5)).round(1).tolist()
    vecs[20:40] = [vecs[20]] * 20
    rows = [(i, v) for i, v in enumerate(vecs)] + [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [0.0] * 5), (203, [1.0, 2.0]), (None, vecs[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id % 10 = 0 or vec_id > 199").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))

    def sim(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return 0.0
        scale = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.round(max(0.0, np.dot(a, b) / scale), 6)) if scale > 0 else 0.0

    pool = [(i, v) for i, v in rows if i is not None]
    want = []
    for qi, qv in pool:
        if qi % 10 == 0 or qi > 199:
            best = sorted(((-sim(qv, v), i) for i, v in pool if i != qi))[:7]
            want += [(qi, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    for queries, block in ((2048, 4096), (4, 16)):
        monkeypatch.setattr(topk, "QUERIES", queries)
        monkeypatch.setattr(topk, "ROWS", block)
        got = [(r["query_id"], r["vec_id"], r["sim"], r["rank"]) for r in topk.knn(q, df, 7).collect()]
        assert sorted(got) == sorted(want)
    assert topk.knn(q.limit(0), df, 7).count() == 0 and topk.knn(q, df.limit(0), 7).count() == 0


def test_rough_scores_give_the_same_best_rows(spark, monkeypatch):
    """Blended hashes with ties and copies over many blocks: all of the best, and the score worked out for few pairs."""
    rng = np.random.default_rng(5)
    hashes = rng.integers(-(2**63), 2**63 - 1, size=(300, 2))
    hashes[100:180] = hashes[100]
    rows = [(i, int(a), None if i == 7 else int(b)) for i, (a, b) in enumerate(hashes)]
    df = spark.createDataFrame(rows, "doc_id long, p long, d long").repartition(3)
    q = df.where("doc_id % 10 = 0").select(F.col("doc_id").alias("qid"), F.col("p").alias("q_p"), F.col("d").alias("q_d"))
    scored = spark.sparkContext.accumulator(0)

    def blend(m):
        scored.add(m["p"].size)
        return np.round(0.6 * m["p"] + 0.4 * m["d"], 10)

    like = lambda a, b: 0.0 if a is None or b is None else 1 - ((a ^ b) & (2**64 - 1)).bit_count() / 64
    want = []
    for qi, qp, qd in rows[::10]:
        best = sorted((-round(0.6 * like(qp, p) + 0.4 * like(qd, d), 10), i) for i, p, d in rows if i != qi)[:4]
        want += [(qi, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    written = []
    monkeypatch.setattr(topk, "materialize", lambda df, name="t": written.append(name) or session.materialize(df, name))
    for queries, block in ((2048, 4096), (8, 16)):
        monkeypatch.setattr(topk, "QUERIES", queries)
        monkeypatch.setattr(topk, "ROWS", block)
        got = topk.compared(q, df, "qid", "doc_id", {c: (f"q_{c}", c) for c in "pd"}, blend, k=4, measure="hash", rough=lambda m: 6 * m["p"] + 4 * m["d"])
        before = scored.value
        assert sorted((r["qid"], r["doc_id"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)
        if block == 4096:
            assert scored.value - before < 30 * 300 / 2
    assert "compared" not in written  # what blocks of queries find is not written on its way


def test_best_by_label_makes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, [None, 3, 4, 9][i % 4], v) for i, v in enumerate(rng.normal(size=(90, 6)).tolist())]
    rows += [(90, 3, None), (91, 5, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (100, 77, [-x for x in rows[0][2]]), (None, 3, rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").repartition(3)
    q = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    unit = lambda v: np.zeros(6) if v is None or None in v else np.array(v) / np.linalg.norm(v)
    want = {}
    for qi, _, qv in (r for r in rows if r[0] is not None and r[0] % 10 == 0):
        for i, label, v in rows:
            if i is not None and i != qi:
                want[qi, label] = max(want.get((qi, label), 0.0), round(max(0.0, float(unit(qv) @ unit(v))), 6))
    assert (100, 77) not in want and want[10, 77] >= 0  # a label that only the query's own row has gives no row
    for queries, tile, kept in ((2048, 1 << 20, 1 << 22), (4, 16, 8)):
        monkeypatch.setattr(topk, "QUERIES", queries)
        monkeypatch.setattr(topk, "TILE", tile)
        monkeypatch.setattr(topk, "KEPT", kept)
        got = topk.best_by_label(q, df, "query_id", "query_vec", "vec_id", "embedding", "label").collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((*k, v)) for k, v in want.items())


def test_rivals_and_identities_take_the_best_of_a_label_in_the_workers(spark):
    for name in ("rival_demotion", "two_stage_identity"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        # the comparison gives query, label and best: no row of the pool comes out of it
        assert [x for x in plan.splitlines() if "MapInArrow" in x and "best" in x and "vec_id" not in x.split("]")[0].split("[")[-1]]


def test_pools_of_one_part_are_compared_by_all_cores(spark, monkeypatch):
    """Both channels of vector_boost_fusion, and a floor over several blocks of queries, which are not written between."""
    pool = spark.read.parquet(f"{SF}/embeddings.parquet").coalesce(1)
    q = pool.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    written = []
    monkeypatch.setattr(topk, "materialize", lambda df, name="t": written.append(name) or session.materialize(df, name))
    one = topk.compared(q, pool, "query_id", "vec_id", {"sim": ("query_vec", "embedding")}, lambda m: m["sim"], floor=0.1)
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(topk, "QUERIES", 8)
    many = topk.compared(q, pool, "query_id", "vec_id", {"sim": ("query_vec", "embedding")}, "sim", floor=0.1)
    assert written.count("compared") == 0 and "score" not in many.columns
    assert sorted(map(tuple, many.collect())) == sorted(tuple(r)[:3] for r in one.collect())


def test_best_rows_are_sought_in_single_precision(spark, monkeypatch):
    """Copies, opposite, missing and zero vectors over many tiles: the best by double precision, which few pairs see."""
    rng = np.random.default_rng(17)
    vecs = rng.normal(size=(2000, 8))
    vecs[300:340] = vecs[300]  # ties far beyond k
    vecs[420:460] = vecs[20] + 1e-7 * rng.normal(size=(40, 8))  # apart by less than single precision tells
    vecs[700] = 0
    vecs[1980:] = -vecs[:20]
    rows = [(i, None if i == 5 else [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    q = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    unit = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)
    unit[5] = 0
    want = []
    for qi in range(0, 2000, 20):
        sims = np.round(np.maximum(unit @ unit[qi], 0), 6)
        best = sorted((-sims[i], i) for i in range(2000) if i != qi)[:7]
        want += [(qi, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    in_double = spark.sparkContext.accumulator(0)
    read, compare, *rest = topk.MEASURES["cosine"]

    def counted(a, b):
        in_double.add(len(a[0]) * len(b[0]))
        return compare(a, b)

    monkeypatch.setitem(topk.MEASURES, "cosine", (read, counted, *rest))
    monkeypatch.setattr(topk, "TILE", 100 * 20)
    got = sorted(map(tuple, topk.knn(q, df, 7).select("query_id", "vec_id", "sim", "rank").collect()))
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in sorted(want)]
    assert np.allclose([r[2] for r in got], [r[2] for r in sorted(want)], atol=1e-9)
    assert 0 < in_double.value < 2000 * 100 / 2


@pytest.mark.parametrize("name", ["hybrid_text_boost", "unified_relevance"])
def test_pairs_over_a_floor_leave_in_order_of_score(spark, tmp_path, monkeypatch, name):
    """As many rows as by SQL, a missing label among them, in runs of rising scores, which take less room written."""
    rng = np.random.default_rng(23)
    rows = [(i, [float(x) for x in rng.normal(size=64) + 0.3], None if i in (40, 77) else int(i % 3)) for i in range(1200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()[name]).fetchall()
    for queries, run in ((2048, 1 << 22), (32, 1000)):
        monkeypatch.setattr(topk, "QUERIES", queries)
        monkeypatch.setattr(topk, "RUN", run)
        df = catalogue.queries()[name](spark, str(tmp_path)).select("query_id", "vec_id", "score")
        parts = [[tuple(r) for r in part] for part in df.rdd.glom().collect()]
        assert sorted(r for part in parts for r in part) == sorted(want) and len(want) > 10_000
        falls = sum(a[2] > b[2] for part in parts for a, b in zip(part, part[1:]))
        assert falls <= sum(len(part) // run for part in parts)


def test_near_copies_are_classed_without_writing_shingles(spark, tmp_path, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = {1: " ".join(words), 2: " ".join(words), 3: " ".join([*words, "more"]), 4: " ".join(words[:100]), 5: None, 6: "", 7: " ".join([*words[:-1], "other"])}
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    monkeypatch.setattr(structure, "materialize", lambda df, name="t": written.append(df.schema) or session.materialize(df, name))
    got = sorted(tuple(r) for r in catalogue.queries()["near_dup_classify"](spark, str(tmp_path)).collect())
    # text 3 stands in the table twice, texts 1 and 2 are one text; 396 shingles, of which a last word changes or adds one
    assert got == [(3, 1, 2, round(396 / 397, 6), "near"), (7, 1, 1, round(395 / 397, 6), "near")]
    assert written and not any(f.dataType.simpleString().startswith("array") or f.name == "text" for schema in written for f in schema)


def test_expanding_search_stops_for_a_reason(spark):
    pool = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = pool.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = topk.expanding(q, pool, 20, 0.25).collect()
    vecs = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in pool.collect()}
    for qi in {r["query_id"] for r in got}:
        mine = sorted((r for r in got if r["query_id"] == qi), key=lambda r: r["rank"])
        sims = sorted(((-round(max(0.0, float(vecs[qi] @ v)), 6), i) for i, v in vecs.items() if i != qi))
        done, size, tail, n_round = 0, 20, None, 0
        while True:
            n_round += 1
            new = [-s for s, _ in sims[done:size]]
            why = topk.should_stop(len(new), float(np.median(new)) if new else None, tail, sum(s >= 0.25 for s in new), max(new, default=0.0), 0.25) or ("whole_pool" if size >= len(vecs) else "")
            if why:
                break
            tail, done, size = min(new), size, topk.adaptive_k(size, len(vecs))
        assert {r["why"] for r in mine} == {why} and max(r["round"] for r in mine) == n_round
        assert [r["vec_id"] for r in mine] == [i for _, i in sims[: min(size, len(sims))]]


def test_expanding_search_lets_out_only_the_bands_of_its_ranks(spark, monkeypatch):
    pool = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = pool.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    vecs = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in pool.collect()}
    got = topk._bands(q, pool, "query_id", "query_vec", "vec_id", "embedding").collect()
    for qi in {r["query_id"] for r in got}:
        sims = [round(max(0.0, float(vecs[qi] @ v)), 6) for i, v in vecs.items() if i != qi]
        for r in (r for r in got if r["query_id"] == qi):
            assert r["n"] == sum(int(s * topk.BINS) == r["band"] for s in sims) and r["through"] == sum(int(s * topk.BINS) >= r["band"] for s in sims)
    let_out, plain = [], topk.compared
    monkeypatch.setattr(topk, "compared", lambda *a, **kw: let_out.append(plain(*a, **kw)) or let_out[-1])
    topk.expanding(q, pool, 20, 0.25)
    assert 20 * q.count() <= let_out[0].count() < 40 * q.count()  # not 20 of each query from every task


def test_expanding_search_goes_on_past_a_million_rows(spark):
    """Rows that all stay relevant end with the whole pool, however large it is."""
    n = (1 << 20) + 1000
    pool = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") % 100 / 400.0).alias("embedding"))
    q = pool.where("vec_id = 100").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = topk.expanding(q, pool, 300_000, 0.25).groupBy("why").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("ids"), F.max("rank").alias("last"), F.max("round").alias("steps"))
    assert [tuple(r) for r in got.collect()] == [("whole_pool", n - 1, n - 1, n - 1, 3)]


def test_should_stop():
    assert topk.should_stop(0, None, None, 0, 0, 0.4) == "no_new_ids"
    assert topk.should_stop(5, 0.3, 0.5, 5, 0.9, 0.4) == "similarity_drop"
    assert topk.should_stop(5, 0.45, 0.5, 2, 0.5, 0.4) == "low_yield" and topk.should_stop(5, 0.45, 0.5, 2, 0.56, 0.4) == ""
    assert [topk.adaptive_k(800, 5000), topk.adaptive_k(100, 5000), topk.adaptive_k(4000, 5000), topk.adaptive_k(5000, 5000)] == [1600, 900, 5000, None]


def test_detector_quality_on_missing_values_and_shared_numbers(spark, tmp_path):
    """As by its SQL where numbers are a file's own; else as by its SQL with ties broken by the corners, in any row order."""
    rng = np.random.default_rng(29)
    sql = catalogue.oracle_sql()["detector_quality"]
    some = lambda x, share: None if rng.random() < share else x
    for n, shared in enumerate((False, True)):
        share = 0 if shared else 0.06
        rows = [(some(int(f), share), some(int(rng.integers(1, 5)) if shared else i, share), some("AN"[int(rng.integers(2))], share), some(float(rng.integers(1, 50)), share), some(float(rng.integers(0, 11)) / 100, share), some(float(rng.integers(0, 9)) / 100, share)) for f in range(150) for i in range(1, 25)]
        rows.append((None, None, "only without a number", 1.0, 0.0, 0.0))
        path = f"{tmp_path}/{n}"
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_discount double, l_tax double").repartition(5).write.parquet(f"{path}/lineitem.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
        want = con.sql(sql.replace("ORDER BY i)", "ORDER BY i, x1, y1, x2, y2)") if shared else sql)
        got = catalogue.queries()["detector_quality"](spark, path).select(*want.columns).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_leader_clusters_of_whole_groups(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = {}
    for label in {r["label"] for r in rows.collect()}:
        sums = []
        for r in rows.where(F.col("label") == label).orderBy("vec_id").collect():
            u = np.array(r["embedding"], dtype=float)
            u /= max(np.linalg.norm(u), 1e-8)
            sims = [s @ u / np.linalg.norm(s) for s in sums]
            if sims and max(sims) >= 0.25:
                at = int(np.argmax(sims))
                sums[at] = sums[at] + u
            else:
                at = len(sums)
                sums.append(u)
            want[r["vec_id"]] = at
    got = {r["vec_id"]: r["cluster"] for r in relations.leader_clusters(rows, "label", "vec_id", "embedding", 0.25).collect()}
    assert got == want and len(set(want.values())) > 2


def test_duplicate_classes_need_both_sides_known(spark):
    cases = [(0.99, 0.97, 0.5, None, None, "exact"), (0.89, 0.83, 0.5, "r", "b", "color_variant"), (0.89, 0.83, 0.5, None, "b", "near"), (0.79, 0.73, 0.5, None, None, "none"), (0.79, 0.73, 0.5, "r", "r", "near"), (0.79, 0.73, 0.5, "r", "b", "color_variant"), (0.5, 0.5, 0.5, "r", "b", "none")]
    df = spark.createDataFrame([(*c, "s") for c in cases], "p double, d double, w double, a string, b string, want string, s string")
    got = df.withColumn("got", K.duplicate_class(F.lit(False), F.col("p"), F.col("d"), F.col("w"), (F.col("a"), F.col("b")), (F.col("s"), F.col("s")))).collect()
    assert all(r["got"] == r["want"] for r in got)


def _write_batches(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


def test_streams_over_several_batches(spark, tmp_path):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    path = str(tmp_path / "events")
    first = [(1, day(1, 1), 7, "click", 1.0), (2, day(1, 2), 8, "view", 2.0), (3, day(5, 1), 7, "error", 3.0)]
    then = [(5, day(5, 3), 7, "view", 4.0)]
    late = [(4, day(1, 3), 7, "click", 100.0), (6, day(9, 1), 9, "view", 5.0)]
    _write_batches(spark, path, [first, then, late])
    # update mode: a key that comes in several batches stays once, with its newest state
    jobs = S.run_to_table(S.fold_jobs(S.stream(spark, path, files_per_batch=1)), "update", "jobs", ["user_id"])
    got = {r["user_id"]: (r["n_events"], r["errors"], r["last_type"]) for r in jobs.collect()}
    assert got == {7: (4, 1, "view"), 8: (1, 0, "view"), 9: (1, 0, "view")} and jobs.count() == 3
    with pytest.raises(ValueError):
        S.run_to_table(S.fold_jobs(S.stream(spark, path)), "update", "jobs")
    # append mode: what comes after the watermark has passed its window is dropped, and open windows stay inside
    windows = S.run_to_table(S.tumbling(S.stream(spark, path, files_per_batch=1)), "append", "windows").collect()
    totals = {(r["start"].day, r["event_type"]): r["total"] for r in windows}
    assert totals == {(1, "click"): 1.0, (1, "view"): 2.0, (5, "error"): 3.0, (5, "view"): 4.0}


def test_scan_folder_by_extension_without_ignored_parts(spark, tmp_path):
    from loomquery.sources import files

    for name in ("a.tif", "b.psd", "skip/c.tif", "deep/er/d.tif"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * 7)
    got = files.scan_folder(spark, str(tmp_path), ["tif"], ["/skip/"]).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got) == ["a.tif", "d.tif"] and {r["file_size"] for r in got} == {7}


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_store_versions_appends_and_report(spark, tmp_path):
    from loomquery.sources import files, store

    root = str(tmp_path / "v")
    store.publish(spark.createDataFrame([(1, "a")], "id int, x string"), root, 1)
    spark.createDataFrame([(9, "half")], "id int, x string").write.parquet(f"{root}/data/never-announced")
    store.publish(spark.createDataFrame([], "id int, x string"), root, 0)
    assert [tuple(r) for r in store.current(spark, root).collect()] == [(1, "a")]
    path = str(tmp_path / "a")
    store.append_new(spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "id int, x string"), path, "id")
    store.append_new(spark.createDataFrame([(2, "late"), (3, "c")], "id int, x string"), path, "id", spark.read.parquet(path))
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == [(1, "a"), (2, None), (3, "c")]
    html = store.report_rows(spark.createDataFrame([("<a&b>", None)], "x string, y int"), "x", "y").first()[0]
    assert html == "<tr><td>&lt;a&amp;b&gt;</td><td></td></tr>"
    for name in ("a.TIF", "b.tif", "sub/c.tif", "cache/d.tif", "e.txt"):
        (tmp_path / "s" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "s" / name).write_bytes(b"12345")
    got = files.scan_folder(spark, str(tmp_path / "s"), ["tif"], ["/cache/"]).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.file_size) for r in got) == [("a.TIF", 5), ("b.tif", 5), ("c.tif", 5)]


def test_stable_order_and_limits(spark):
    from loomquery.operators import ordering

    rows = [("q", 1, 0.90, 3), ("q", 2, 0.88, 1), ("q", 3, 0.87, 2), ("q", 4, 0.86, None), ("q", 5, None, 0), ("r", 6, 0.5, None)]
    df = spark.createDataFrame(rows, "q string, id int, score double, prior int")
    got = {(r.q, r.id): r.place for r in ordering.stable_order(df, ["q"], "id", "score", "prior").collect()}
    # .90 and .88 are one band; .87 lies a full tolerance lower and opens the next with .86, whose prior is not known.
    assert got == {("q", 2): 1, ("q", 1): 2, ("q", 3): 3, ("q", 4): 4, ("r", 6): 1}
    assert ordering.stable_order(df.limit(0), ["q"], "id", "score", "prior").count() == 0
    lim = spark.range(1, 1001).select(ordering.within_limit(F.col("id"), F.lit(900)).alias("a"), ordering.within_limit(F.col("id"), F.lit(0)).alias("b")).groupBy().agg(F.sum(F.col("a").cast("int")), F.sum(F.col("b").cast("int"))).first()
    assert tuple(lim) == (800, 1000)


def test_statuses_that_stay(spark):
    from loomquery.operators import state

    ev = [("a", 1, "processing"), ("a", 2, "done"), ("a", 3, "processing"), ("b", 1, "failed"), ("b", 2, "reset"), ("b", 3, "processing"), ("c", 1, "processing"), ("c", 2, "reset"), ("d", 1, "note")]
    df = spark.createDataFrame(ev, "k string, t int, kind string")
    assert {r.k: r.status for r in state.one_way_status(df, ["k"], F.col("t"), F.col("kind")).collect()} == {"a": "done", "b": "processing", "c": "pending", "d": "pending"}
    au = [("a", 1, "resolved", 1.0), ("a", 2, "pending", 2.0), ("b", 1, "snoozed", 1.0), ("b", 2, "pending", 3.0), ("c", 1, "pending", 4.0)]
    got = state.audit_findings(spark.createDataFrame(au, "k string, t int, s string, v double"), ["k"], F.col("t"), F.col("s"), "v").collect()
    assert {r.k: (r.status, r.v) for r in got} == {"a": ("resolved", 2.0), "b": ("pending", 3.0), "c": ("pending", 4.0)}
    cl = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, None), ("b", 2, "y")], "k string, t int, v string")
    assert [tuple(r) for r in state.latest_or_cleared(cl, ["k"], "t", "t", "v", F.col("v").isNull()).collect()] == [("b", "y")]


def test_tree_ranking_case_by_case(spark):
    base = {"own": 0.0, "child": 0.0, "rival": 0.0, "distractor": 0.0, "win": False, "strong": False, "conflict": False, "named": False, "indexed": False, "card": False, "leaf": True, "hard": True, "scored": False}
    cases = [  # what is seen, then tier, evidence and place, or None for a row that goes
        ({"own": 0.31, "rival": 0.1}, ("exact", "exact", 0)),
        ({"own": 0.31, "rival": None}, ("very_similar", "family", 1)),
        ({"own": 0.28, "rival": 0.2}, ("very_similar", "family", 1)),
        ({"own": 0.31, "rival": 0.30}, ("same_family", "family", 3)),
        ({"own": 0.10, "rival": 0.30}, ("same_family", "unknown", 5)),
        ({"own": 0.10, "rival": 0.30, "scored": True}, None),
        ({"own": 0.10, "rival": 0.10}, ("semantic", "unknown", 5)),
        ({"own": 0.10, "distractor": 0.30}, None),
        ({"own": 0.10, "distractor": 0.30, "named": True}, ("semantic", "mismatch", 6)),
        ({"own": 0.10, "distractor": 0.30, "indexed": True, "scored": True}, ("semantic", "semantic", 4)),
        ({"own": 0.10, "card": True}, ("semantic", "semantic", 4)),
        ({"own": 0.23, "rival": 0.0, "hard": False, "scored": True}, ("very_similar", "family", 1)),
        ({"own": 0.10, "hard": False, "win": True, "scored": True}, ("very_similar", "family", 1)),
        ({"child": 0.30, "leaf": False, "scored": True}, ("same_family", "family", 3)),
        ({"own": 0.10, "leaf": False, "hard": False, "win": True}, ("same_family", "family", 3)),
        ({"own": 0.10, "leaf": False, "win": True, "scored": True}, None),
    ]
    rows = [(i, 0.5, *{**base, **seen}.values()) for i, (seen, _) in enumerate(cases)]
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double'}" for k, v in base.items())
    df = spark.createDataFrame(rows, f"id int, score double, {kinds}")
    c = F.col
    e = hierarchy.Seen(*[c(k) for k in ("own", "child", "rival", "distractor", "win", "strong", "conflict", "named", "indexed", "card")])
    got = hierarchy.ranked_by_tree(df, e, c("leaf"), c("hard"), c("scored"), F.lit(False), [], "score", ["id"])
    assert {r.id: (r.tier, r.evidence, r.place) for r in got.collect()} == {i: want for i, (_, want) in enumerate(cases) if want}
    leaves = [i for i, (seen, want) in enumerate(cases) if want and seen.get("leaf", True)]
    assert [r.id for r in got.where("rank is not null").orderBy("rank").collect()] == sorted(leaves, key=lambda i: (cases[i][1][2], i))


def test_concept_verdicts_case_by_case(spark):
    c = F.col
    two = spark.createDataFrame([(1, 0.3, 0.25, 0.5, False), (2, 0.3, 0.25, 0.95, False), (3, 0.3, 0.1, 0.5, False), (4, 0.3, 0.1, 0.0, False), (5, 0.3, 0.25, 0.5, True), (6, 0.1, None, 0.5, False)], "id int, a double, b double, text double, photo boolean")
    met = [F.coalesce(c(k) >= hierarchy.PATTERN_MIN, F.lit(False)) for k in "ab"]
    v = hierarchy.composition([c("a"), c("b")], met, c("text"), c("photo"))
    got = hierarchy.best_verdicts(two, v, [], ["id"], 20)
    assert [(r.id, r.score, r.bucket) for r in got.orderBy("rank").collect()] == [(2, 0.96, 0), (1, 0.58, 0), (3, 0.41, 1)]
    one = spark.createDataFrame(
        [(1, 0.40, 0.1, 0.0, False, True, False), (2, 0.10, 0.1, 0.9, False, False, False), (3, 0.21, 0.3, 0.4, False, False, False), (4, 0.30, 0.3, 0.0, False, True, True), (5, 0.10, 0.0, 0.0, False, False, False), (6, 0.30, 0.0, 0.2, True, True, False)],
        "id int, own double, other double, text double, photo boolean, motif boolean, mixed boolean",
    )
    shown = hierarchy.Shown(*[c(k) for k in ("own", "other", "text", "photo", "motif", "mixed")])
    verdict = lambda *kind: {r.id: (r.score, r.bucket, r.reason) for r in hierarchy.best_verdicts(one, hierarchy.single(shown, *[F.lit(k) for k in kind]), [], ["id"], 400).collect()}
    plain = {1: (0.78, 0, "pure"), 2: (0.58, 0, "kept_by_text"), 3: (0.4, 1, "kept_by_text"), 4: (0.296, 1, "part_of_composite"), 6: (0.54, 0, "pure")}
    assert verdict(False, False, False) == plain
    assert verdict(True, False, True) == {k: plain[k] for k in (1, 4)}
    assert verdict(False, True, False) == {6: (0.3, 0, "photograph")}


def test_spread_deals_out_small_tables_only(spark, monkeypatch):
    df = spark.range(0, 1000, 1, 1)
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in session.spread(df).collect()) == list(range(1000))
    monkeypatch.setattr(session, "FEW_BYTES", 8)
    assert session.spread(df).rdd.getNumPartitions() == 1
