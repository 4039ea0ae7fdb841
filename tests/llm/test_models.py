"""Quality, PII, unit dedup, language, top-k and template lines: brute force, held-out accuracy and edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomquery.llm")
from loomquery.llm import language, maxscore, pii, quality, templates, units

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


def test_quality_learns_from_bags_and_defines_edge_cases(spark):
    rng = random.Random(2)
    good = lambda n: " ".join(rng.choice(["the", "Walk", "home,", "was", "long.", "And"]) for _ in range(n))
    rows = []
    for i in range(240):  # a bad document has one bad passage among good ones
        t = good(rng.randrange(30, 300))
        rows.append((i, t + (" BUY!! NOW!! " * 20 if i % 2 else ""), None, None, 1))
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.select("doc_id", ((F.col("doc_id") + 1) % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    model = quality.train(docs, labels, F.col("doc_id") < 160)
    extra = docs.where("doc_id >= 160").union(frame(spark, [None, "", "x " * 50_000], [900, 901, 902])).withColumn("score", F.lit(1))
    got = {r["doc_id"]: r for r in quality.score(extra, model).collect()}
    assert sum((got[i]["score"] >= 0.5) == (i % 2 == 0) for i in range(160, 240)) >= 76
    assert got[900]["score"] == got[901]["score"] and got[902]["n_passages"] == -(-50_000 // 64)
    one = quality.train(docs, labels.where("quality = 1"), F.lit(True))
    assert {r["score"] for r in quality.score(extra, one).collect()} == {1.0}
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    model = quality.Attention.fresh(3)
    bag = quality._bag([quality.passage_features(t, {}) for t in (b"a B c " * 50, b"X9 y", b"")])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.4, 0.3, 0.3])
    g = model.gradients(*bag, y, weight)
    loss = lambda: -(weight * (y * np.log(p := model.forward(*bag)[-1]) + (1 - y) * np.log(1 - p))).sum()
    for name in ("V", "U", "w", "o", "c", "b", "E"):
        a = getattr(model, name)
        i = (int(bag[1][0]), 2) if name == "E" else tuple(rng.integers(0, s) for s in a.shape)
        old, eps = a[i], 1e-5
        a[i] = old + eps
        up = loss()
        a[i] = old - eps
        down = loss()
        a[i] = old
        assert abs((up - down) / (2 * eps) - g[name][i]) < 1e-4


def test_quality_forward_equals_plain_sums():
    model = quality.Attention.fresh(5)
    texts = [b"a B c " * 60, b"X9 y zz", b""]
    feats = [quality.passage_features(t, {}) for t in texts]
    *_, got = model.forward(*quality._bag(feats))
    for (p, f, x), y in zip(feats, got):
        hs, ss = [], []
        for k in range(int(p[-1]) + 1 if len(p) else 1):
            pre = model.c + sum((model.E[b] * v for q, b, v in zip(p, f, x) if q == k), np.zeros(len(model.c)))
            h = np.tanh(pre)
            hs.append(h)
            ss.append(sum(model.w[j] * np.tanh(h @ model.V[:, j]) / (1 + np.exp(-(h @ model.U[:, j]))) for j in range(len(model.w))))
        alpha = np.exp(ss) / np.exp(ss).sum()
        assert abs(y - 1 / (1 + np.exp(-(sum(a * h for a, h in zip(alpha, hs)) @ model.o + model.b[0])))) < 1e-9


def brute_marginals(em, trans):
    n, k = em.shape
    post, pairs, z = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        p = np.exp(sum(em[i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        p *= sum(np.exp(trans[s, path[0]]) for s in range(k)) / k  # uniform state before the first word
        z += p
        for i, s in enumerate(path):
            post[i, s] += p
        for a, b in zip(path, path[1:]):
            pairs[a, b] += p
    return post / z, pairs / z


def test_forward_backward_is_exact(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(language, "BLOCK", 3)
    trans = rng.normal(size=(3, 3))
    lens = np.array([1, 7, 3, 6, 2])
    em = rng.normal(size=(lens.sum(), 3))
    post, _ = language.forward_backward(em, lens, trans)
    at = 0
    for n in lens:
        want, _ = brute_marginals(em[at : at + n], trans)
        assert np.allclose(post[at : at + n], want)
        at += n


def test_language_labels_switched_words_and_edge_cases(spark):
    rng = random.Random(1)
    vocab = {"de": ["der", "keit", "schung", "über", "und"], "en": ["the", "thing", "shed", "over", "and"]}
    say = lambda x, n: " ".join(rng.choice(vocab[x]) + rng.choice(["", "en", "s"]) for _ in range(n))
    model = language.fit([say(x, 30).encode() for x in ["de", "en"] * 60], ["de", "en"] * 60)
    texts = [say("de", 20), say("en", 20), say("en", 10) + " " + say("de", 10), None, "", "12 -- 🙂", "über " * 40_000, "the the"]
    got = {r["doc_id"]: r for r in language.label(frame(spark, texts).withColumn("lang_pred", F.lit(0)), model, with_words=True).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 6, 7)] == ["de", "en", "de", "en"]
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (3, 4, 5)] == [("und", 0.0)] * 3
    mixed = got[2]["word_langs"]
    assert mixed[:8] == ["en"] * 8 and mixed[-8:] == ["de"] * 8
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.label(frame(spark, ["abc"]), language.fit([], [])).first()["lang_pred"] == "und"
    assert language.label(frame(spark, []), model).count() == 0


def test_language_prediction_equals_plain_sums(spark):
    rng = random.Random(4)
    vocab = {"de": ["der", "keit", "über"], "en": ["the", "thing", "shed"], "fr": ["les", "eaux", "très"]}
    model = language.fit([" ".join(rng.choice(vocab[x]) for _ in range(8)).encode() for x in [*vocab] * 20], [*vocab] * 20)
    texts = [" ".join(rng.choice(rng.choice([*vocab.values()])) for _ in range(n)) for n in (1, 2, 5, 6)]
    got = {r["doc_id"]: r for r in language.label(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        em = np.array([sum(model.weights.astype(np.float32)[b] for b in language.features(w, model.lexicon)) for w in language.split_words(t.encode())])
        mean = brute_marginals(em.astype(float), model.trans)[0].mean(0)
        assert got[i]["lang_pred"] == model.langs[mean.argmax()] and abs(got[i]["score"] - mean.max()) < 1e-4


def test_language_reads_all_of_a_text_without_spaces(spark):
    rng = random.Random(5)
    run = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    kana, han = "あいうえおかきくけこさしすせそ", "的一是不了人我在有他这中大来上"
    model = language.fit([run(c, 60).encode() for c in (kana, han) * 60], ["ja", "zh"] * 60)
    texts = [run(kana, 30) + run(han, 3000), run(han, 30) + run(kana, 3000), run(kana, 200)]  # the first words mislead
    got = {r["doc_id"]: r for r in language.label(frame(spark, texts), model, with_words=True).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["zh", "ja", "ja"]
    assert all("".join(got[i]["words"]) == texts[i] for i in range(3))


def test_many_long_texts_in_one_batch(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("Der über "), F.col("id").cast("string"), F.lit(" ")), 20_000).alias("text")).coalesce(1)
    model = language.fit([b"der und", b"the and"] * 9, ["de", "en"] * 9)
    assert language.label(docs, model).where("lang_pred = 'de'").count() == 40
    assert quality.score(docs, quality.Attention.fresh()).where("n_passages = 938").count() == 40


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [int(c) if i % 2 == 0 else (int(c) * 2) // 10 + (int(c) * 2) % 10 for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_pii_base_spans_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab1@..+-_%5 0()\né🙂") for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += [None, "", "a@b.c_x@e.f", "4111 1111 1111 1111 and 4111-1111-1111-1112", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "+1 (555) 123-4567.", "é" * 50 + " x@y.zz\n +4912345678 ",
              "1" * 50_000, "a" * 30_000 + "@", "a@b" + ".c" * 20_000, "+1" + " " * 30_000]
    got = {r["doc_id"]: r for r in pii.report(frame(spark, texts).withColumn("spans", F.lit(1)).withColumn("kind", F.lit("x"))).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:80]
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(w.startswith(k) for w in want) for k in KINDS]
        assert [x for x in got[i]["spans"].split(",") if x and x.split(":")[0] in KINDS] == want
    assert pii.report(frame(spark, [])).count() == 0


def test_pii_terms_that_reveal_an_entity(spark):
    texts = [f"Meet Zorblax the clerk at jo{i % 2}@x.org the day" if i < 4 else f"the clerk and the day {i}" for i in range(40)]
    texts += ["Zorblax alone is not near any address"]
    rows = pii.report(frame(spark, texts)).orderBy("doc_id").collect()
    assert "remove:5:12" in rows[0]["spans"] or "generalise:5:12" in rows[0]["spans"]
    assert not any("clerk" in texts[0][int(a) : int(b)] for a, b in (x.split(":")[1:] for x in rows[0]["spans"].split(",")))
    assert rows[40]["spans"] == "" and rows[10]["spans"] == ""
    clean = pii.sanitised(frame(spark, texts)).orderBy("doc_id").collect()
    assert "jo0@x.org" not in clean[0]["text"] and "Zorblax" not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"] and clean[10]["text"] == texts[10]


def test_pii_terms_go_from_whole_documents_and_count_over_lines(spark):
    far = "the day and the clerk " * 6
    texts = [f"Name: Zorblax\nEmail: jo@x.org\n{far}\nso Zorblax said", f"{far}\nZorblax came {far} Zorblax\n\njo@x.org", f"jo@x.org {far}{far}\nZorblax went"]
    texts += [f"the clerk and the day {i}\nName: none\nEmail: none so he said came went" for i in range(40)] + ["Zorblax elsewhere"]
    rows = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x] for r in pii.report(frame(spark, texts)).collect()}
    for i in range(3):
        want = {m.start() for m in re.finditer("Zorblax", texts[i])}
        assert {int(s) for k, s, _ in rows[i] if k in ("remove", "generalise")} == want
    assert all(not rows[i] for i in range(3, 44))


def test_pii_shares_equal_plain_counts(spark):
    """PMI over IC from counts of passages, counted one by one."""
    rng = random.Random(11)
    filler = [f"{a}{b}{c}ow" for a in "bdfgk" for b in "aeiou" for c in "lmn"]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = []
    for i in range(150):
        near = rng.choice(["Zorblax", "Quendor", rng.choice(filler)])
        who = {"Zorblax": "jo@x.org", "Quendor": rng.choice(["a@q.net", "+1 (555) 123-4567"])}.get(near, f"u{i}@x.org")
        texts.append(f"{say(rng.randrange(5, 90))} {near} {say(3)} {who} {say(rng.randrange(5, 90))}\n{say(9)}" if i % 3 else say(60))
    texts += texts[:40] + [None, "", "Zorblax elsewhere"]  # copies must change nothing
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    n, n_t, n_e, n_te, lines_te = 0, {}, {}, {}, {}
    for t in sorted({t for t in texts if t}):
        at = 0
        spans = [(k, m.start(), m.end(), m[0]) for k, p in KINDS.items() for m in re.finditer(p, t) if valid(k, m[0])]
        for m in re.finditer(r"(?s).{1,400}[0-9A-Za-z\x80-\U0010ffff]*", t):
            n += 1
            for w in set(re.findall(word, m[0].lower())):
                n_t[w] = n_t.get(w, 0) + 1
            here = [s for s in spans if m.start() <= s[1] < m.end()]
            terms = {x[0].lower() for x in re.finditer(word.replace("\\x60", "\\x40\\x5B-\\x60"), m[0]) if len(x[0]) >= 3 and not re.search("[0-9]", x[0])
                     and not any(s < m.start() + x.end() and m.start() + x.start() < e for _, s, e, _ in spans)}
            named = {}
            for k, s, _, v in sorted(here, key=lambda x: x[1]):
                line = t[t.rfind("\n", 0, s) + 1 :].split("\n")[0]
                digits = re.sub("[^0-9]", "", v)
                for target in (f"{k}:{v.lower() if k == 'email' else digits}", f"class:{k}:{v[v.index('@'):].lower() if k == 'email' else digits[:4]}"):
                    named.setdefault(target, line)
            for target, line in named.items():
                n_e[target] = n_e.get(target, 0) + 1
                for w in terms:
                    lines_te.setdefault((target, w), set()).add(line)
                    n_te[target, w] = n_te.get((target, w), 0) + 1
    want = {}
    for (e, w), both in n_te.items():
        share = np.log2(n * both / (n_t[w] * n_e[e])) / np.log2(n / n_e[e])
        if len(lines_te[e, w]) >= 2 and share >= pii.GENERALISE:
            want[e, w] = (round(float(share), 9), "remove" if share >= pii.REMOVE else "generalise")
    docs = frame(spark, texts)
    keyed = pii.keyed_texts(docs.select(F.coalesce("text", F.lit("")).alias("__text")).distinct())
    spans = pii.base_spans(pii._lines(keyed))
    found, _ = pii.disclosing(keyed, pii.words_around(keyed, spans))
    got = {(r["target"], r["term"]): (round(r["share"], 9), r["action"]) for r in found.collect()}
    assert got == want and ("email:jo@x.org", "zorblax") in want and any(e.startswith("class:") for e, _ in want)


def plain_units(text, min_words=6):
    """Own splitter: (start, end, words, normalised, line, whole, number)."""
    no, at = 0, 0
    for line in text.split("\n"):
        words = line.lower().split()
        if words:
            lead = at + len(line) - len(line.lstrip())
            end = at + len(line.rstrip())
            yield lead, end, len(words), " ".join(words), lead, True, no
            parts, here = [], lead
            for m in re.finditer(r"[.!?]+(?=\s|$)", text[lead:end]):  # sentences end in marks before white space
                parts.append((here, lead + m.end()))
                here = lead + m.end()
            parts.append((here, end))
            n = 0
            for a, z in parts if len(words) >= min_words else []:
                a += len(text[a:z]) - len(text[a:z].lstrip())
                w = text[a:z].lower().split()
                if len(w) >= min_words and (a, z) != (lead, end):
                    yield a, z, len(w), " ".join(w), lead, False, no + n
                    n += 1
            no += max(n, 1)
        at += len(line) + 1


def plain_repeats(texts, ids, min_passage):
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, i))
    seen, out = {}, []
    for i in order:
        every = list(plain_units(texts[i] or ""))
        for s, _, _, key, *_ in every:
            seen.setdefault(key, (i, s))
        again = [u for u in every if seen[u[3]] != (i, u[0])]
        whole = {u[4] for u in again if u[5]}
        again = sorted(u for u in again if u[5] or u[4] not in whole)
        upto = {}
        for u in every:
            upto[u[4]] = max(upto.get(u[4], 0), u[6] + 1)
        runs, last = [], None
        for u in again:
            if last is None or last != u[6]:
                runs.append([])
            runs[-1].append(u)
            last = upto[u[4]] if u[5] else u[6] + 1
        for run in runs:
            if sum(u[2] for u in run) >= min_passage:
                out += [(ids[i], u[0], u[1], ids[seen[u[3]][0]], seen[u[3]][1]) for u in run]
    return out


@pytest.mark.parametrize("min_passage", [1, 20])
def test_units_equal_brute_force(spark, min_passage):
    rng = random.Random(3)
    sent = [" ".join(rng.choice("abcdefg") * 2 for _ in range(rng.randrange(3, 12))).capitalize() + rng.choice([".", "!", "?", ""]) for _ in range(40)]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choice(sent) for _ in range(rng.randrange(12))) for _ in range(60)] + [None, "", "v4.0 x", texts_dup := "One two three four five six seven."] + [texts_dup] * 2
    ids = list(range(len(texts)))
    ids[5], ids[9] = None, 8
    want = plain_repeats(texts, ids, min_passage)
    got = units.repeated_units(frame(spark, texts, ids).withColumn("start", F.lit(0)).coalesce(1), min_passage=min_passage).collect()
    assert want and sorted(map(str, ((r["doc_id"], r["start"], r["end"], r["kept_id"], r["kept_start"]) for r in got))) == sorted(map(str, want))
    out = units.deduplicated(frame(spark, texts, ids).coalesce(1), min_passage=1)
    assert out.columns[-1] == "removed" and out.count() == len(texts)
    assert out.where("doc_id = 64").first()["text"] == ""
    assert units.repeated_units(frame(spark, [])).count() == 0


def test_units_remove_repeated_lines_of_any_length(spark):
    texts = ["All rights reserved.\nLine of its own\n日本語の行", "Mine\n  all  RIGHTS reserved. \n\n日本語の行\nMine", "Short one. One two three four five six seven. Tail.\n \n"]
    texts += [texts[2] + "x", "Begin. One two three four five six seven. End."]
    got = sorted((r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]], r["kept_id"]) for r in units.repeated_units(frame(spark, texts), min_passage=1).collect())
    inner, line = "One two three four five six seven.", "Short one. One two three four five six seven. Tail."
    assert got == [(1, "Mine", 1), (1, "all  RIGHTS reserved.", 0), (1, "日本語の行", 0), (3, line, 2), (4, inner, 2)]
    out = [r["text"] for r in units.deduplicated(frame(spark, texts), min_passage=1).orderBy("doc_id").collect()]
    assert out == [texts[0], "Mine\n   \n\n\n", texts[2], "\n \nx", "Begin.  End."]


def test_maxscore_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(300, 6)).round(2).astype(object).tolist()
    vecs[10:60] = [vecs[10]] * 50  # ties
    rows = [(i, v) for i, v in enumerate(vecs)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, vecs[0]), (304, []), (305, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("score", F.lit(1))
    ok = {i: np.pad(np.floor(256 * np.array(v, dtype=float)), (0, 6 - len(v))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all()}
    want = []
    for q in (x for x in ok if x % 50 == 0):
        best = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for block, shard in ((4096, 4096), (3, 16)):
        monkeypatch.setattr(maxscore, "QUERIES", block)
        monkeypatch.setattr(maxscore, "SHARD", shard)
        got = maxscore.top_k(df, F.col("vec_id") % 50 == 0)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_maxscore_skips_rows_without_essential_postings():
    x = np.zeros((100, 4))
    x[:, 3] = 1
    x[7, 0] = 50
    best = maxscore.TopK(1)
    best.add(np.array([2000.0]), np.array([500]))
    shard = maxscore.Shard(x, np.arange(100), bucket=4)
    shard.search(np.array([100.0, 0, 0, 1.0]), -1, best)
    traversed, in_essential, scored, rows = shard.seen
    assert best.ids.tolist() == [7] and traversed == 4 and in_essential == 4 and scored == 1 and rows == 100


def test_maxscore_share_of_rows_scored(capsys):
    """On dense vectors nearly every row is in some essential list; what is saved is the scoring. On sparse ones rows go unseen."""
    import duckdb

    got = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()
    dense = np.floor(256 * np.array([v for _, v in got], dtype=float))
    rng = np.random.default_rng(0)
    sparse = np.where(rng.random((4000, 64)) < 0.05, np.floor(256 * rng.random((4000, 64))), 0)
    for name, x, most_seen, most_scored in (("sf0.1", dense, 1.0, 0.7), ("sparse", sparse, 0.6, 0.4)):
        ids, seen = np.arange(len(x)), np.zeros(4, dtype=np.int64)
        best = [maxscore.TopK(5) for _ in range(0, len(x), 50)]
        for lo in range(0, len(x), 500):
            shard = maxscore.Shard(x[lo : lo + 500], ids[lo : lo + 500])
            for i, b in enumerate(best):
                shard.search(x[i * 50], i * 50, b)
            seen += shard.seen
        for i, b in enumerate(best):
            want = sorted((-int(x[i * 50] @ v), j) for j, v in enumerate(x) if j != i * 50)[:5]
            assert [(-int(s), int(j)) for s, j in zip(b.score, b.ids)] == want
        with capsys.disabled():
            print(f"\nmaxscore, {name}: {seen[0] / (64 * seen[3]):.3f} of postings traversed, {seen[1] / seen[3]:.3f} of rows in essential lists, {seen[2] / seen[3]:.3f} scored in full")
        assert seen[1] <= most_seen * seen[3] and seen[2] <= most_scored * seen[3]


def test_maxscore_is_exact_beyond_doubles_and_longs(spark):
    big = 2.0**52
    vecs = [[big, 1.0], [1.0, 2.0**-8], [1.0, 2.0**-7], [1.0, 0.0], [1e200, 1.0], [-1e200, 0.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    ints = [[int(np.floor(256 * np.float64(c))) for c in v] for v in vecs]
    want = sorted((-sum(a * b for a, b in zip(ints[0], v)), i) for i, v in enumerate(ints) if i)[:5]
    got = maxscore.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
    limit = lambda x: max(min(x, 2**63 - 1), -(2**63))
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, limit(-s)) for s, i in want]
    assert -want[1][0] - -want[2][0] < 2**9 < 2**60 < -want[1][0]  # ranks that doubles cannot tell


def test_recurring_templates_drop(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))
    texts = [f"{prose(20)}\nPage {i} of the daily report\n{prose(25)}" for i in range(8)]
    copy = f"{prose(12)}\n{prose(14)}"
    texts += [copy] * 9 + [None, "", "\n\n", "Page 3 of the daily report", "Page 4 of the daily report\nPage 4 of the daily report"]
    docs = frame(spark, texts).repartition(3)
    out = {r["doc_id"]: r["text"] for r in templates.drop_recurring(docs).collect()}
    assert out[0] == texts[0]  # the first text that has a template keeps it
    assert all(out[i].count("\n") == 1 and "Page" not in out[i] for i in range(1, 8))
    assert all(out[i] == copy for i in range(8, 17))  # copies are one text
    assert [out[i] for i in range(17, 20)] == texts[17:20] and out[20] == "" and out[21] == ""  # boilerplate alone goes whole
    got = {r["doc_id"]: r for r in templates.report(docs).collect()}
    assert got[17]["n_lines"] == 0 and got[21]["n_dropped"] == 2 and got[1]["n_templates"] == 1
    assert templates.report(frame(spark, [])).count() == 0


def test_recurring_lines_are_found(spark):
    """Lines that occur in MIN_DOCS distinct texts or more, word for word: how many occurrences beside the first text's go."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    out = {r["doc_id"]: r["text"] for r in templates.drop_recurring(frame(spark, texts)).collect()}
    having = {}
    for t in texts:
        for line in set((t or "").split("\n")):
            having.setdefault(line, set()).add(t)
    stock = {x for x, of in having.items() if x.strip() and len(of) >= templates.MIN_DOCS and not re.search("[0-9]", x)}
    first = {}
    for t in texts:
        for line in (t or "").split("\n"):
            first.setdefault(line, t)
    again = [(i, x) for i, t in enumerate(texts) for x in set((t or "").split("\n")) & stock if first[x] != t]
    gone = sum(x not in out[i].split("\n") for i, x in again)
    print(f"{gone} of {len(again)} recurring lines dropped")
    assert len(again) > 100 and gone >= 0.9 * len(again)
