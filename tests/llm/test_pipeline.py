"""The pipeline on the smallest tables against a plain version of every stage, and the contract's columns."""

import math
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomquery.llm")
import corpus_pipeline
from loomquery.llm import queries, templates, toxicity
from loomquery.llm.common import fold, words
from test_filters import brute_components, brute_fp, brute_hits, check_packed, own_pieces

SF = "/root/testdata/sf0.001"


def brute_templates(texts):
    """The rule of the log-template tree, line by line."""
    lines = []
    for d, t in enumerate(texts):
        for pos, line in enumerate((t or "").split("\n")):
            toks = [x for x in re.split(r"[ \t\r\f\x0B]+", line) if x]
            if toks:
                masked = ["<*>" if re.search("[0-9]", x) else x for x in toks]
                lines.append((d, pos, masked, (len(masked), tuple(masked[: templates.DEPTH]))))
    texts_of, token_texts, template_texts = {}, {}, {}
    for d, _, _, leaf in lines:
        texts_of.setdefault(leaf, set()).add(texts[d])
    lines = [x for x in lines if len(texts_of[x[3]]) >= templates.MIN_DOCS]
    for d, _, m, leaf in lines:
        for i, x in enumerate(m):
            token_texts.setdefault((leaf, i, x), set()).add(texts[d])
    strong = []
    for d, pos, m, leaf in lines:
        g = tuple(x if x != "<*>" and len(token_texts[leaf, i, x]) >= templates.MIN_DOCS else "<*>" for i, x in enumerate(m))
        if sum(x != "<*>" for x in g) >= templates.MIN_FIXED * len(g):
            strong.append((d, pos, g))
            template_texts.setdefault(g, []).append(texts[d])  # rows are in the order of their ids
    out, gone = list(texts), {}
    for d, pos, g in strong:
        if len(set(template_texts[g])) >= templates.MIN_DOCS and texts[d] != template_texts[g][0]:
            gone.setdefault(d, set()).add(pos)
    for d, places in gone.items():
        out[d] = "\n".join(p for i, p in enumerate(texts[d].split("\n")) if i not in places)
    return out


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    model = toxicity.train(docs, labels, fold("doc_id", 3) != 1)
    score = {}
    for r in docs.collect():  # the machine's sum, pair by pair
        f = sorted({model.slots[h] for w in set(words((r["text"] or "").encode())) for h in toxicity.term_hashes(w) if h in model.slots})
        raw = model.b + sum(model.w[i] for i in f) + sum(float(model.v[i] @ model.v[j]) for n, i in enumerate(f) for j in f[n + 1 :])
        score[r["doc_id"]] = 1 / (1 + math.exp(-min(max(raw, -30), 30)))
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect() if score[r["doc_id"]] < 0.7]
    rows = list(zip([i for i, _ in rows], brute_templates([t for _, t in rows])))
    comp = brute_components([i for i, _ in rows], [brute_fp(t) for _, t in rows])
    rows = [(i, t) for (i, t), c in zip(rows, comp) if i == c]
    hits = brute_hits([t for _, t in rows], [(r["item_id"], r["text"]) for r in bench.collect()])
    rows = [x for x, h in zip(rows, hits) if not h[1]]
    pieces = [(rows[i][0], *p) for i, *p in own_pieces([t for _, t in rows])]
    assert 0 < len(rows) < docs.count()
    check_packed(corpus_pipeline.run(spark, SF).collect(), pieces)


def test_stages_keep_columns_and_rows_with_odd_values(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("x")).withColumn("__n", F.lit(1))
    odd = docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    cur = docs.limit(40).union(odd).union(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, cur, SF)
        assert got.columns == docs.columns, name
        assert stage(spark, cur.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, cur, SF).where("doc_id is null").count() == 2


WANT = {
    "op1": ["doc_id", "held_out", "score", "predicted"], "op2": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op4": ["doc_id", "held_out", "lang_pred", "score"],
    "op5": ["query_id", "rank", "vec_id", "score"], "op7": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op8": ["doc_id", "held_out", "score", "predicted"],
    "op9": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op10": ["doc_id", "fingerprint", "component_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_contract_columns(spark, name):
    got = queries.queries()[name](spark, SF)
    assert set(WANT.get(name.split("_")[0], [])) <= set(got.columns)
    if name.startswith("op5"):
        assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    elif not name.startswith("op3") and not name.startswith("op9"):
        assert got.count() == 200


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    q = queries.queries()
    lang = q["op4_crf_language"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert lang.where("lang_pred = lang").count() >= 0.98 * lang.count()
    good = q["op1_attention_quality"](spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id")
    assert good.where("predicted = quality").count() >= 0.95 * good.count()
    bad = q["op8_toxicity_fm"](spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id")
    assert bad.where("predicted = toxic").count() >= 0.88 * bad.count()
