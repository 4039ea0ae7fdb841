"""Line dedup by a log-template tree, with DataFrame functions only.

A line is its tokens, parted by white space. The tree has a fixed depth: token count, then the first DEPTH tokens,
where a token that holds a digit counts as a variable field `<*>`. Lines of one leaf are generalised together: a
token stays where at least MIN_DOCS distinct texts of the leaf have it at that place, and becomes `<*>` elsewhere.
Lines with the same generalised tokens share a template. A template recurs if it comes from at least MIN_DOCS distinct
texts and at least MIN_FIXED of its tokens stayed fixed. Its lines are dropped everywhere but in the text that has it
first, by (document id, nulls last; place in the input). Exact copies are one text: they do not make their own lines
recur, and they keep or lose the same lines, so that near-duplicate search still finds them.

Null texts stay null and empty texts empty (neither has lines); blank lines are never dropped; a text's own repetitions
of a line count once; ties of the first document go to the row that comes first; an empty table gives an empty result;
columns of any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm.common import numbered, restored
from loomquery.session import materialize

DEPTH, MIN_DOCS, MIN_FIXED = 3, 5, 0.5
#: Leaves or templates that may be broadcast (a hash each, at most 64 bytes); beyond it the joins shuffle.
BROADCAST_ROWS = 200_000


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _mask(token):
    return F.when(token.rlike("[0-9]"), F.lit("<*>")).otherwise(token)


def _tokens(line):
    # contains, a split at one plain character and a removal are quick; translate is not, and few lines need it
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\f")) | F.contains(line, F.lit("\x0b"))
    return F.array_remove(F.split(F.when(odd, F.translate(line, "\t\r\f\x0b", "    ")).otherwise(line), " "), "")


def _lines(rows: DataFrame) -> DataFrame:
    """(__row, __id, same, pos, tokens, leaf) of every line that is not blank; `same` is equal for equal texts."""
    lines = rows.select("__row", "__id", F.xxhash64("__text").alias("same"), F.posexplode(F.split("__text", "\n")).alias("pos", "line"))
    split = lines.select("__row", "__id", "same", "pos", _tokens(F.col("line")).alias("tokens")).where(F.size("tokens") > 0)
    return split.withColumn("leaf", F.xxhash64(F.size("tokens"), *[_mask(F.get("tokens", F.lit(i))) for i in range(DEPTH)]))


def _often(pairs: DataFrame, key: str, min_docs: int) -> DataFrame:
    """key of the pairs (key, same) with at least min_docs different texts."""
    return pairs.select(key, "same").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select(key)


def recurring_lines(rows: DataFrame, min_docs: int = MIN_DOCS, min_fixed: float = MIN_FIXED) -> DataFrame:
    """(__row, pos, template) of the lines whose template recurs and was seen first elsewhere. rows: __row, __id, __text."""
    lines = _lines(rows)
    busy = materialize(_often(lines, "leaf", min_docs), "leaves")
    masked = F.array_join(F.transform("tokens", _mask), " ")
    inside = lines.join(_maybe_broadcast(busy), "leaf", "left_semi").select("__row", "__id", "same", "pos", "leaf", masked.alias("line"))
    inside = materialize(inside.withColumn("h", F.xxhash64("line")), "leaf-lines")
    # texts with the same lines in a leaf (boilerplate) are counted together, so each distinct set is taken apart once
    per_text = inside.groupBy("same", "leaf").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    sets = materialize(per_text.groupBy("leaf", "lines").agg(F.count(F.lit(1)).alias("n")), "line-sets")
    placed = F.transform("lines", lambda x: F.transform(F.split(x, " "), lambda t, i: F.struct(i.alias("place"), t.alias("token"))))
    tokens = sets.select("leaf", "n", F.explode(F.array_distinct(F.flatten(placed))).alias("x")).where("x.token <> '<*>'")
    fixed = tokens.groupBy("leaf", "x.place", "x.token").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("leaf", "place", "token", F.lit(True).alias("stays"))
    fixed = materialize(fixed, "fixed-tokens")
    distinct = sets.select("leaf", F.explode("lines").alias("line")).distinct()
    each = distinct.select("leaf", F.xxhash64("line").alias("h"), F.posexplode(F.split("line", " ")).alias("place", "token"))
    field = F.struct("place", F.when(F.col("stays"), F.col("token")).otherwise(F.lit("<*>")).alias("field"))
    general = each.join(fixed, ["leaf", "place", "token"], "left").groupBy("leaf", "h").agg(F.sort_array(F.collect_list(field)).alias("fields"), F.count("stays").alias("kept"))
    template = F.sha2(F.array_join(F.transform("fields", lambda x: x["field"]), " "), 256)
    strong_lines = general.where(F.col("kept") >= F.lit(min_fixed) * F.size("fields")).select("leaf", "h", template.alias("template"))
    strong = inside.select("__row", "__id", "same", "pos", "leaf", "h").join(materialize(strong_lines, "strong-lines"), ["leaf", "h"]).select("__row", "__id", "same", "pos", "template")
    strong = materialize(strong, "templates")
    per_text = strong.groupBy("template", "same").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row")).alias("at"))
    often = per_text.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min_by("same", "at").alias("first")).where(F.col("n") >= min_docs).select("template", "first")
    often = materialize(often, "recurring")
    return strong.join(_maybe_broadcast(often), "template").where(F.col("same") != F.col("first")).select("__row", "pos", "template")


def _dropped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__row, __id, __text, __rest, and __new, __lines, __gone, __templates: the text that stays and the counts."""
    rows = numbered(docs, id_col, text_col, "line-rows")
    found = recurring_lines(rows.select("__row", "__id", "__text"))
    hits = found.groupBy("__row").agg(F.collect_set("pos").alias("__pos"), F.countDistinct("template").cast("int").alias("__templates"))
    # by hash at every size: the hits grow with the input, and sorting whole texts would gain nothing
    joined = rows.join(materialize(hits, "hits").hint("shuffle_hash"), "__row", "left")
    lines = F.split("__text", "\n")
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__pos", i)), "\n")
    return joined.select(
        "__row", "__id", "__text", "__rest", F.when(F.col("__pos").isNull(), F.col("__text")).otherwise(rest).alias("__new"),
        F.coalesce(F.when(F.col("__text") == "", 0).otherwise(F.size(lines)), F.lit(0)).alias("__lines"),
        F.coalesce(F.size("__pos"), F.lit(0)).alias("__gone"), F.coalesce("__templates", F.lit(0)).alias("__templates"),
    )


def drop_recurring(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str | None = None) -> DataFrame:
    """docs with the recurring lines taken out of text; length_col, if given, follows where a line went."""
    got, changed = _dropped(docs, id_col, text_col), {}
    if length_col:
        old = F.col("__rest").getField(length_col)
        changed[length_col] = F.when(F.col("__gone") > 0, F.length("__new").cast(docs.schema[length_col].dataType)).otherwise(old)
    return got.select(*restored(docs, text_col, F.col("__new"), **changed))


#: The same in DuckDB: one row a document.
ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, text, (u.pos - 1)::INT AS pos, list_filter(string_split_regex(u.line, '[ \t\r\f\x0B]+'), lambda t: t <> '') AS toks
  FROM (SELECT doc_id, text, unnest(list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1)), max_depth := 1) AS z FROM documents) q,
  LATERAL (SELECT z[1] AS line, z[2] AS pos) u
), toks AS (
  SELECT doc_id, text, pos, toks, list_transform(toks, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS masked FROM lines WHERE len(toks) > 0
), leaves AS (SELECT *, len(toks)::VARCHAR || ' ' || array_to_string(masked[1:{DEPTH}], ' ') AS leaf FROM toks),
busy AS (SELECT leaf FROM leaves GROUP BY leaf HAVING count(DISTINCT text) >= {MIN_DOCS}),
inside AS (SELECT * FROM leaves SEMI JOIN busy USING (leaf)),
tokens AS (SELECT doc_id, text, pos, leaf, unnest(masked) AS token, unnest(range(len(masked))) AS place FROM inside),
fixed AS (SELECT leaf, place, token FROM tokens WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT text) >= {MIN_DOCS}),
general AS (
  SELECT t.doc_id, t.pos, count(*) AS n, count(f.token) AS kept, string_agg(coalesce(f.token, '<*>'), ' ' ORDER BY t.place) AS template
  FROM tokens t LEFT JOIN fixed f ON t.leaf = f.leaf AND t.place = f.place AND t.token = f.token GROUP BY t.doc_id, t.pos
), strong AS (SELECT g.doc_id, g.pos, g.template, d.text FROM general g JOIN documents d USING (doc_id) WHERE kept >= {MIN_FIXED} * n),
often AS (SELECT template, arg_min(text, doc_id) AS first FROM strong GROUP BY template HAVING count(DISTINCT text) >= {MIN_DOCS}),
chosen AS (
  SELECT s.doc_id, list(s.pos) AS gone, count(DISTINCT s.template) AS n_templates FROM strong s JOIN often o ON s.template = o.template AND s.text <> o.first GROUP BY s.doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END::INT AS n_lines,
  coalesce(len(c.gone), 0)::INT AS n_dropped, coalesce(c.n_templates, 0)::INT AS n_templates,
  sha256(CASE WHEN c.doc_id IS NULL THEN coalesce(d.text, '')
    ELSE array_to_string(list_transform(list_filter(list_zip(string_split(d.text, chr(10)), range(len(string_split(d.text, chr(10))))), lambda z: NOT list_contains(c.gone, z[2]::INT)), lambda z: z[1]), chr(10)) END) AS kept_sha256
FROM documents d LEFT JOIN chosen c USING (doc_id)
"""


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: lines, lines dropped, templates they belong to, and the digest of the text that stays."""
    got = _dropped(docs.select(id_col, text_col), id_col, text_col)
    return got.select(
        F.col("__id").alias(id_col), F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_dropped"), F.col("__templates").alias("n_templates"),
        F.sha2(F.coalesce("__new", F.lit("")), 256).alias("kept_sha256"),
    )
