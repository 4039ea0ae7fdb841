"""Toxicity, decontamination, SimHash and packing against brute force, with nulls, ties, copies and empty tables."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("loomquery.llm")
from loomquery.llm import contamination, packing, pii, simhash, templates, toxicity, units
from loomquery.llm.common import BATCH_BYTES, BATCH_ROWS, bounded, words
from loomquery.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


def test_words_matches_contract():
    import regex

    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("aZ09 _-.éÉß\t\n\x7f{}@🙂") for _ in range(rng.randrange(40)))
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        assert [w.decode() for w in words(t.encode())] == regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_hits(texts, items, window=10):
    out = []
    for t in texts:
        w, hit, found = words((t or "").encode()), set(), set()
        for i, x in items:
            p = words((x or "").encode())
            m = min(window, len(p))
            for a in range(len(p) - m + 1 if m else 0):
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == p[a : a + m]:
                        hit.update(range(b, b + m))
                        found.add(str(i))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_wu_manber_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "dé"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 14, 0])]
    items += [(100, None), (7, items[7][1])]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(60))) for _ in range(60)] + [None, "", "!!", items[7][1] + " zz", "x " * 30000 + items[8][1]]
    bench = spark.createDataFrame(items + [(None, "a b c")], "item_id long, text string")
    want = brute_hits(texts, items)
    for block in (20_000, 3):
        monkeypatch.setattr(contamination.blocks, "__defaults__", (contamination.BLOCK_BYTES, block))
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in contamination.report(frame(spark, texts), bench).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert contamination.report(frame(spark, []), bench).count() == 0
    clean = contamination.drop_contaminated(frame(spark, ["one two", None]).withColumn("score", F.lit(1)), bench)
    assert clean.columns[-1] == "score" and clean.count() == 2
    assert contamination.report(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(set(fps))
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for f in fps]


def test_simhash_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(300)]
    texts = []
    for _ in range(120):  # near copies, so that one shard is large
        t = list(base)
        t[rng.randrange(300)] = "x" + str(rng.randrange(9))
        texts.append(" ".join(t))
    texts += [texts[0]] * 5 + [None, "", " \n", "One", "one", "two words", "Ünï côde é", "   "]
    texts += [" ".join(str(rng.randrange(100)) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3] = None
    fps = [brute_fp(t) for t in texts]
    want = sorted(zip(map(str, ids), fps, brute_components(ids, fps)))
    for shard in (1000, 10):
        monkeypatch.setattr(simhash, "SHARD", shard)
        got = simhash.near_duplicates(frame(spark, texts, ids))
        assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in got.collect()) == want
    kept = simhash.keep_one(frame(spark, texts, ids).withColumn("fp", F.lit("x")).withColumn("row", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "row"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in want})
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_band_masks_catch_every_link():
    rng = random.Random(2)
    for n in (10, 1 << 25, 1 << 35):
        masks = simhash.band_masks(n)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << i for i in rng.sample(range(64), 3))
            assert any((a & m) == (b & m) for m in (x % (1 << 64) for x in masks))


def test_bk_forest_finds_all_links():
    rng = np.random.default_rng(1)
    fp = np.unique(np.concatenate([rng.integers(0, 1 << 20, 800, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    rng.shuffle(fp)
    group = np.sort(rng.integers(0, 3, len(fp)))
    forest = simhash.Forest(group, fp)
    got = {(int(a), int(b)) for q, n in forest.links(np.arange(len(fp)), 3) for a, b in zip(q, n)}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if i != j and group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert got == want and want


def own_pieces(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    out = []
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], dtype="<u4").tobytes()
            out.append((i, k // 2048, k, len(part) // 4, zlib.crc32(part)))
    return out


def check_packed(rows, pieces, capacity=2048):
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(pieces)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing_places_every_piece_gapless(spark):
    rng = random.Random(9)
    texts = [None, "", "Don't <|endoftext|> x!", "ÀÉß ſİ Σς é \x1c  a b", "word " * 5000, "日本語 テスト 🙂🙂", "a" * 9000]
    texts += [" ".join(rng.choice(["The", "of", "thwhing,", "Éue", "12", "x-y", "ñ."]) for _ in range(rng.randrange(1, 1500))) for _ in range(80)]
    texts += [texts[10]] * 20
    rows = packing.pack(frame(spark, texts).repartition(5), tokenizer_path()).collect()
    pieces = own_pieces(texts)
    used = check_packed(rows, pieces)
    rooms = []
    for size in sorted((p[3] for p in pieces), reverse=True):  # plain best-fit decreasing
        fit = [r for r in rooms if r >= size]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 2048) - size)
    assert used <= len(rooms)
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_packing_chunks_without_ids_in_two_batches(spark):
    odd = ["\u00a0", "\u3000", "\u2003", "\u0085"]  # not white space to bytes.split, and no ids
    texts = [f"a {odd[i % 4]} b{i % 7}" for i in range(2 * BATCH_ROWS + 10)]
    rows = packing.pack(frame(spark, texts).coalesce(1), tokenizer_path()).collect()
    check_packed(rows, own_pieces(texts))


def test_packing_with_another_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  World\n\n of words", "\u00a0 x  ", None, "A b"]
    rows = {r["doc_id"]: r for r in packing.pack(frame(spark, texts), path).collect()}
    assert packing.by_chunks(tokenizer_path()) and not packing.by_chunks(path)
    for i, t in enumerate(texts):
        ids = [*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 0]
        assert rows[i]["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    encoder, rng = packing.Encoder(tokenizer_path()), random.Random(2)
    for _ in range(20):
        texts = [" ".join(rng.choice(["The", "of...", "(word)", "a&&&", "x-y", "12", "it's", "\u00a0", "É!"]) for _ in range(9)) for _ in range(3)]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode([t.encode() for t in texts])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def exact_bins(sizes, capacity):
    """Fewest bins, by trying every way (small instances)."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in {x for x in bins if x >= sizes[i]}:
            k = bins.index(b)
            go(i + 1, bins[:k] + [b - sizes[i]] + bins[k + 1 :])
        go(i + 1, bins + [capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rng = random.Random(4)
    reduced = 0
    for _ in range(150):
        cap = rng.randrange(10, 40)
        sizes = [rng.randrange(cap // 5, cap + 1) for _ in range(rng.randrange(1, 10))]
        counts = {s: sizes.count(s) for s in sizes}
        fixed, rest = packing.reduce_dominated(counts, cap)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sorted(left + [x for p, n in fixed for x in p * n]) == sorted(sizes)
        assert all(sum(p) <= cap for p, _ in fixed)
        assert sum(n for _, n in fixed) + exact_bins(left, cap) == exact_bins(sizes, cap)
        plan = packing.plan_bins(counts, cap)
        assert sorted(x for p, n in plan for x in p * n) == sorted(sizes) and all(sum(p) <= cap for p, _ in plan)
        reduced += bool(fixed)
    assert reduced > 50


def test_toxicity_learns_pairs_of_terms_that_are_neutral_alone(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(500):  # every one of the four words is in as many toxic texts as clean ones
        a, b = rng.random() < 0.5, rng.random() < 0.5
        t = [f"w{rng.randrange(200)}" for _ in range(40)] + ["insult" if a else "praise", "group" if b else "team"]
        rng.shuffle(t)
        rows.append((" ".join(t), int(a == b)))
    model = toxicity.fit(spark.createDataFrame(rows[:400], "text string, y int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, [t for t, _ in rows[400:]]), model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(rows[400:])) >= 95


def test_machine_equals_pairwise_sum():
    rng = np.random.default_rng(6)
    model = toxicity.Machine({}, 0.3, rng.normal(size=20), rng.normal(size=(20, toxicity.FACTORS)))
    feats = [[], [3], [1, 4], [0, 2, 5, 7, 19], list(range(20))]
    want = [model.b + sum(model.w[i] for i in f) + sum(model.v[i] @ model.v[j] for n, i in enumerate(f) for j in f[n + 1 :]) for f in feats]
    assert np.allclose(model.raw(feats), want)


def test_bounded_batches_and_columns_that_clash(spark):
    """Every name an operator adds, as a column of the caller's, on rows that come out of a shuffle."""
    import pyarrow as pa

    texts = ["x" * 200_000, "y", None, "z" * 5_000_000] * 30
    got = list(bounded(iter([pa.RecordBatch.from_pydict({"t": pa.array(texts)})])))
    assert [t for b in got for t in b.column("t").to_pylist()] == texts
    assert all(b.num_rows == 1 or b.nbytes <= BATCH_BYTES for b in got)
    names = "__row __id __rest __text __new __gone __lines __templates __pos __hit __n_words __spans __items __key __cut spans removed kind score fp row least root shard".split()
    stock = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    docs = frame(spark, [f"{stock}\n{chr(97 + i) * 4} jo{i}@x.org text {i} {chr(97 + i) * 3}" for i in range(12)]).select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names]).repartition(3)
    bench = spark.createDataFrame([(1, "never seen in any of the texts here at all today")], "item_id long, text string")
    model = toxicity.Machine({}, -5.0, np.zeros(0), np.zeros((0, 8)))
    outs = {
        "sanitised": pii.sanitised(docs), "deduplicated": units.deduplicated(docs), "templates": templates.drop_recurring(docs, length_col="n_chars"),
        "contamination": contamination.drop_contaminated(docs, bench), "toxicity": toxicity.keep_clean(docs, model, 0.5), "simhash": simhash.keep_one(docs),
    }
    for name, out in outs.items():
        rows = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns and len(set(out.columns)) == len(out.columns), name
        assert len(rows) == 12, name
        for r in rows:  # a row keeps its own values, whatever happened to its text
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names), name
            assert f"text {r['doc_id']}" in r["text"], name
    assert outs["templates"].where("n_chars = length(text)").count() == 12
    assert outs["templates"].where(F.col("text").contains(stock)).count() == 1
    assert outs["deduplicated"].where(F.col("text").contains(stock)).count() == 1
    assert packing.pack(docs.withColumn("piece", F.lit("x")).withColumn("length", F.lit("x")), tokenizer_path()).count() == 12


def test_toxicity_learns_pairs_and_defines_edge_cases(spark):
    rng = random.Random(8)
    filler = [f"w{i}" for i in range(200)]

    def text(extra):
        t = [rng.choice(filler) for _ in range(40)] + extra
        rng.shuffle(t)
        return " ".join(t)

    rows = []
    for _ in range(400):  # either word alone is harmless, both together are not
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((text(["insult"] * a + ["group"] * b), int(a and b)))
    train, test = rows[:300], rows[300:]
    sample = spark.createDataFrame(train, "text string, y int")
    model = toxicity.fit(sample)
    docs = frame(spark, [t for t, _ in test] + [None, ""]).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(test)) >= 95
    assert got[100] == got[101] and 0 <= got[100] <= 1
    assert toxicity.keep_clean(docs, model, 0.5).columns == docs.columns
    none = toxicity.fit(sample.limit(0))
    assert toxicity.score(docs, none).where("score > 0.01").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
