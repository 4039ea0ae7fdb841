"""Personal data and what reveals it, with DataFrame functions only.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers, by pattern and check digit. None of
the patterns crosses a line break, so lines are searched one by one. Each distinct value found is a protected entity.

Information-theoretic sanitisation then asks what the words around an entity reveal. Everything is counted in one
space of events, the passages of PASSAGE characters (extended to the end of a word, over line breaks) of all distinct
texts: n(t) passages have the term, n(e) the entity, n(t, e) both, of N. PMI(t; e) = log2(N n(t, e) / (n(t) n(e))) is
how much of the entity's information IC(e) = log2(N / n(e)) the term carries. Terms whose share PMI / IC reaches REMOVE
are removed wherever a text that holds the entity has them; from GENERALISE on they are generalised. Texts without the
entity keep the term. A pair needs two different lines of the entity as evidence, from two passages; copies of a text or of a
line count once. An entity on a single line takes the evidence of its class: the domain of an address, the first two
parts of an IP, the first six digits of a card, the first four of a phone number. Values are compared in lower case
and without the separators of their digits.

Null texts count as empty and have no spans; repeated rows have equal spans, and a repeated text counts once; texts of
any length are searched whole; spans that tie in kind and start order by end; an empty table gives an empty result;
columns of any name are kept as they are. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomquery.llm.common import packed, restored
from loomquery.session import materialize

PASSAGE, GENERALISE, REMOVE = 400, 0.6, 0.9
#: Terms that may be broadcast to the count over all documents (a few tens of bytes each); beyond it they are shuffled.
BROADCAST_TERMS = 200_000

#: The contract's patterns. Possessive repeats match the same text here, as what follows is never in the repeated class;
#: a start inside a run that failed or ended can only fail again, unless it follows a match, which \G keeps.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text or a line must match to hold a valid span: the digits that a card and a phone number need at least.
SIGNS = PATTERNS | {"card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9](?:[ ().-]*+[0-9]){8}"}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPANS = "array<struct<o:int,s:bigint,e:bigint,kind:string>>"
_ORDER = {k: i for i, k in enumerate([*PATTERNS, "generalise", "remove"])}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    place = F.sequence(F.lit(1), F.length(d))
    return F.aggregate(place, F.lit(0), lambda s, i: s + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(
        F.substr(d, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(d, i, F.lit(1)).cast("int") > 4, 9).otherwise(0))) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    n = F.length(_digits(m))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"))
        .when(kind == "card", F.when(n.between(13, 19), _luhn(m)).otherwise(F.lit(False)))
        .otherwise(n.between(9, 15))
    )


def _located(df: DataFrame, found: Column, keys: list[str]) -> DataFrame:
    """Explode matches (kind, i, m, gap) and place them: offsets are sums of the gaps and matches before."""
    rows = df.select(*keys, F.explode(found).alias("x")).select(*keys, "x.*")
    w = W.partitionBy(*keys, "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.length("gap") + F.length("m")).over(w)
    return rows.select(*keys, "kind", "m", end.alias("end")).withColumn("start", F.col("end") - F.length("m"))


def _matches(text: str, kind: str, pattern: str) -> Column:
    # zipped, as a split inside transform's function would run once a match
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    return F.transform(
        F.filter(found, lambda x: x["m"].isNotNull()),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["m"].alias("m"), x["gap"].alias("gap")),
    )


def _placed(texts: DataFrame, parts: Column, gap: int) -> DataFrame:
    """(__key, no, text, at) of the parts of every text; at is the part's offset, gap what parts them."""
    each = texts.select("__key", F.posexplode(parts).alias("no", "text"))
    w = W.partitionBy("__key").orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return each.withColumn("at", F.sum(F.length("text") + gap).over(w) - F.length("text") - gap)


def _passages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PASSAGE}}}+{WORD[:-1]}*+"), F.lit(0))


def _lines(texts: DataFrame) -> DataFrame:
    """(__key, no, text, at) of the lines that may hold a span."""
    return _placed(texts.where("some"), F.split("__text", "\n"), 1).where(" or ".join(f"text rlike r'{p}'" for p in SIGNS.values()))


def base_spans(lines: DataFrame) -> DataFrame:
    """(__key, kind, value, line, s, e): offsets in the text, and a hash of the line."""
    found = F.concat(*[F.when(F.col("text").rlike(p), _matches("text", k, p)).otherwise(F.array().cast("array<struct<kind:string,i:int,m:string,gap:string>>")) for k, p in PATTERNS.items()])
    got = _located(lines, found, ["__key", "no"]).where(_valid(F.col("kind"), F.col("m"))).select("__key", "no", "kind", F.col("m").alias("value"), F.col("start").alias("s"), F.col("end").alias("e"))
    here = lines.select("__key", "no", "at", F.xxhash64("text").alias("line"))
    return got.join(here, ["__key", "no"]).select("__key", "kind", "value", "line", (F.col("s") + F.col("at")).alias("s"), (F.col("e") + F.col("at")).alias("e"))


def entity(kind: Column, value: Column) -> Column:
    """The entity that a value names."""
    plain = F.when(kind == "email", F.lower(value)).when(kind == "ip", F.regexp_replace(value, r"(^|\.)0+(?=[0-9])", "$1")).otherwise(_digits(value))
    return F.concat_ws(":", kind, plain)


def entity_class(kind: Column, value: Column) -> Column:
    """The class of an entity: what an entity seen too seldom shares with others."""
    part = F.when(kind == "email", F.lower(F.regexp_extract(value, "@.*", 0))).when(kind == "ip", F.substring_index(F.regexp_replace(value, r"(^|\.)0+(?=[0-9])", "$1"), ".", 2))
    return F.concat_ws(":", F.lit("class"), kind, part.when(kind == "card", F.substring(_digits(value), 1, 6)).otherwise(F.substring(_digits(value), 1, 4)))


def words_around(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(__key, no, entity, class, line, term, s, e) of the base spans, and of the words without digits outside them, in
    every text that may hold one; no is the passage in which they start."""
    held = materialize(_placed(texts.where("some"), _passages(F.col("__text")), 0), "pii-passages")
    words = _located(held, _matches("text", "word", WORD), ["__key", "no", "at"]).where((F.length("m") >= 3) & ~F.col("m").rlike("[0-9]"))
    starts = held.select("__key", F.lit(0).alias("what"), "no", F.col("at").alias("s"), F.col("at").alias("e"))
    named = spans.select("__key", F.lit(1).alias("what"), entity(F.col("kind"), F.col("value")).alias("entity"), entity_class(F.col("kind"), F.col("value")).alias("class"), "line", "s", "e")
    terms = words.select("__key", F.lit(2).alias("what"), F.lower("m").alias("term"), (F.col("start") + F.col("at")).alias("s"), (F.col("end") + F.col("at")).alias("e"))
    every = starts.unionByName(named, allowMissingColumns=True).unionByName(terms, allowMissingColumns=True)
    before = W.partitionBy("__key").orderBy("s", "what", "e").rowsBetween(W.unboundedPreceding, W.currentRow)
    covered = F.max(F.when(F.col("what") == 1, F.col("e"))).over(before)
    placed = every.withColumn("covered", covered).withColumn("no", F.last("no", ignorenulls=True).over(before))
    free = (F.col("what") == 1) | ((F.col("what") == 2) & (F.col("covered").isNull() | (F.col("covered") <= F.col("s"))))
    return placed.where(free).select("__key", "no", "entity", "class", "line", "term", "s", "e")


def passages_held(around: DataFrame) -> DataFrame:
    """(targets array<struct<target, line>>, terms array<string>) of every passage with a span. A target is an entity
    or its class, once a passage, with the line on which the passage has it first."""
    here = F.when(F.col("entity").isNotNull(), F.struct("s", "entity", "class", "line"))
    held = around.groupBy("__key", "no").agg(F.sort_array(F.collect_list(here)).alias("found"), F.collect_set("term").alias("terms")).where(F.size("found") > 0)
    names = F.array_distinct(F.flatten(F.transform("found", lambda x: F.array(x["entity"], x["class"]))))
    first = F.transform(names, lambda t: F.struct(t.alias("target"), F.filter("found", lambda x: (x["entity"] == t) | (x["class"] == t))[0]["line"].alias("line")))
    return held.select(first.alias("targets"), "terms")


def disclosing(texts: DataFrame, around: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target, term, share, action), the terms that reveal an entity or a class, and (target, n_e, few); from counts
    over all passages. few says that the target is on a single line."""
    held = materialize(passages_held(around), "pii-held")
    spots = held.select(F.explode("targets").alias("x"), "terms").select("x.target", "x.line", "terms")
    n_e = spots.groupBy("target").agg(F.count(F.lit(1)).alias("n_e"), (F.min("line") == F.max("line")).alias("few"))
    n_e = materialize(n_e, "pii-entities")
    both = spots.select("target", "line", F.explode("terms").alias("term")).groupBy("target", "term")
    pairs = both.agg(F.count(F.lit(1)).alias("n_te"), F.min("line").alias("a"), F.max("line").alias("z")).where("a <> z").select("target", "term", "n_te")
    pairs = materialize(pairs, "pii-pairs")
    # the empty term is put into every passage, so that its count is that of all passages
    terms = pairs.select("term").distinct().union(texts.sparkSession.createDataFrame([("",)], "term string"))
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    passages = texts.select(F.explode(_passages(F.col("__text"))).alias("passage"))
    words = passages.select(F.explode(F.array_union(F.split(F.lower("passage"), _NO_WORD), F.array(F.lit("")))).alias("term"))
    kept = words.join(F.broadcast(terms), "term", "left_semi") if few else words
    n_t = materialize(kept.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "pii-terms")
    total = F.lit(float(n_t.where("term = ''").agg(F.coalesce(F.sum("n_t"), F.lit(0)).alias("n")).first()["n"]))
    ic, pmi = F.log2(total / F.col("n_e")), F.log2(total * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e")))
    share = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))
    joined = pairs.join(n_t, "term").join(n_e, "target").withColumn("share", share)
    action = F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise")
    return materialize(joined.where(F.col("share") >= GENERALISE).select("target", "term", "share", action.alias("action")), "disclosing"), n_e


def all_spans(texts: DataFrame) -> DataFrame:
    """(__key, kind, s, e) of base and added spans, with offsets in the text. texts: as keyed_texts() gives."""
    spans = materialize(base_spans(materialize(_lines(texts), "pii-lines")), "pii-spans")
    around = materialize(words_around(texts, spans), "pii-words")
    found, n_e = disclosing(texts, around)
    held = around.where("entity is not null").select("__key", "entity", "class").distinct()
    # a class speaks for its entities that have too few lines of their own
    own = held.join(n_e.select(F.col("target").alias("entity"), "few"), "entity")
    speaks = own.select("__key", F.when(F.col("few"), F.col("class")).otherwise(F.col("entity")).alias("target")).distinct()
    terms = around.where("term is not null").join(found.select("term").distinct(), "term", "left_semi")
    terms = materialize(terms.select("__key", "term", "s", "e"), "pii-revealing")
    marked = terms.select("__key", "term").distinct().join(speaks, "__key").join(found.select("target", "term", "action"), ["target", "term"]).groupBy("__key", "term").agg(F.max("action").alias("kind"))
    return spans.select("__key", "kind", "s", "e").unionByName(terms.join(marked, ["__key", "term"]).select("__key", "kind", "s", "e"))


def keyed_texts(texts: DataFrame) -> DataFrame:
    """(__key, __text, some) of distinct texts; some says whether a text may hold a span."""
    some = F.expr(" or ".join(f"__text rlike r'{p}'" for p in SIGNS.values()))
    return texts.select(F.unhex(F.md5("__text")).alias("__key"), "__text", some.alias("some"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("__key"), *packed(docs, id_col, text_col))


def spans_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(__key, spans array<struct<o, s, e, kind>>) by kind as listed, then start, of each text with a span."""
    order = F.element_at(F.create_map(*[F.lit(x) for kv in _ORDER.items() for x in kv]), F.col("kind"))
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text")).distinct()
    got = all_spans(materialize(keyed_texts(texts), "pii-texts"))
    per_text = got.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "s", "e", "kind"))).alias("spans"))
    return materialize(per_text, "pii-rows")


def _listed(kinds: list[str]) -> Column:
    chosen = F.filter("spans", lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __row and spans array<struct<o, s, e, kind>>, by kind as listed, then start."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    order = F.element_at(F.create_map(*[F.lit(x) for kv in _ORDER.items() for x in kv]), F.col("kind"))
    got = all_spans(rows.select("__row", F.coalesce(text_col, F.lit("")).alias(text_col)), text_col)
    per_row = got.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "s", "e", "kind"))).alias("spans"))
    kind = per_row.schema["spans"].dataType
    return rows.join(materialize(per_row, "pii-rows"), "__row", "left").withColumn("spans", F.coalesce("spans", F.array().cast(kind)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of each base kind, the digest of the base spans, and all spans."""
    got = _keyed(docs, id_col, text_col).select("__key", "__id").join(spans_of(docs, text_col), "__key", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select(F.col("__id").alias(id_col), *[count(k) for k in PATTERNS], F.sha2(_listed(list(PATTERNS)), 256).alias("base_sha256"), _listed(list(_ORDER)).alias("spans"))


def sanitised(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with personal data masked by kind, revealing terms removed, and generalised ones cut to their first letter."""
    got = _keyed(docs, id_col, text_col).join(spans_of(docs, text_col), "__key", "left")
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        text = F.substr("__text", x["s"] + 1, -x["e"] - x["s"])
        put = F.when(x["kind"] == "remove", "").when(x["kind"] == "generalise", F.concat(F.substr(text, F.lit(1), F.lit(1)), F.lit("*"))).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        gone = F.concat(a["out"], F.array(F.substr("__text", a["at"] + 1, x["s"] - a["at"]), put))
        return F.when(x["s"] < a["at"], a).otherwise(F.struct((-x["e"]).alias("at"), gone.alias("out")))

    clean = F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr("__text", a["at"] + 1, F.length("__text"))))
    return got.select(*restored(docs, text_col, F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("__text"))))
