"""Rankings that weigh what a picture shows: concepts of a query against scores, and a node of a tree against its rivals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions.kernels import text_calibration
from loomquery.operators.topk import first_per_key

#: Least scores of a pattern and of an object, and how far another object must lead to speak against it.
PATTERN_MIN, OBJECT_MIN, OBJECT_LEAD = 0.22, 0.26, 0.03
#: Score from which another concept makes a pure match doubtful.
OTHER_MAX = 0.24
#: Rows kept of a query for a composition, a leaf of the tree, a pattern.
COMPOSITION_ROWS, LEAF_ROWS, PATTERN_ROWS = 20, 24, 400
#: Order of the tiers; a mismatch comes after all of them.
TIER_ORDER = {"exact": 0, "very_similar": 1, "same_subtype": 2, "same_family": 3, "semantic": 4}
MISMATCH_ORDER, UNKNOWN_ORDER = 6, 5

_OUT = "struct<score:double,bucket:int,reason:string>"


def _settled(df: DataFrame, fields: Column) -> DataFrame:
    """df with the fields of a struct as columns, worked out once a row: a generator of one row keeps the optimizer from
    copying their expressions into everything that reads them."""
    return df.select("*", F.inline(F.array(fields)))


def _kept(score: Column, bucket: int | Column, reason: str) -> Column:
    return F.struct(score.cast("double").alias("score"), F.lit(bucket).cast("int").alias("bucket"), F.lit(reason).alias("reason"))


def composition(scores: list[Column], present: list[Column], text: Column, photo: Column) -> Column:
    """(score, bucket, reason) of a row for a query of several concepts; null where the row is to go.

    All concepts present come first, at the least of their scores; some of them do if the text speaks for the row, below
    that; pictures of objects do not."""
    score = [F.coalesce(s, F.lit(0.0)) for s in scores]
    n = sum((p.cast("int") for p in present[1:]), present[0].cast("int"))
    best = F.greatest(text, *[F.when(p, s).otherwise(F.lit(0.0)) for p, s in zip(present, score, strict=True)])
    whole = F.least(F.lit(0.96), F.greatest(text, F.least(*score)) + 0.08)
    partial = F.least(F.lit(0.86), best * 0.82)
    return (
        F.when(photo, F.lit(None).cast(_OUT))
        .when(n == len(scores), _kept(F.round(whole, 4), 0, "composite_match"))
        .when((n > 0) & (text > 0), _kept(F.round(partial, 4), 1, "partial_composite"))
    )


@dataclass(frozen=True)
class Shown:
    """What a row shows for a query of one concept: its score, the best of all other concepts, text score, and whether
    it is known to be a plain photograph, has motifs or objects at all, and mixes several."""

    own: Column
    other: Column
    text: Column
    photo: Column
    motif: Column
    mixed: Column


def single(r: Shown, wants_object: Column, wants_photo: Column, no_photo: Column) -> Column:
    """(score, bucket, reason) of a row for a query of one concept; null where the row is to go."""
    gone = F.lit(None).cast(_OUT)
    seen = text_calibration(r.own)
    by_text = F.when(r.own < PATTERN_MIN, F.least(r.text, F.lit(0.58))).otherwise(r.text)
    pure = F.when(r.own >= PATTERN_MIN, F.least(F.lit(0.97), seen + F.least(F.lit(0.05), F.greatest(F.lit(0.0), r.text - seen) * 0.08))).otherwise(F.least(r.text, F.lit(0.58)))
    return (
        F.when(wants_object & (r.own < OBJECT_MIN), gone)
        .when(wants_photo, F.when(r.photo, _kept(F.round(F.greatest(r.own, r.text), 4), 0, "photograph")))
        .when(r.photo & no_photo, gone)
        .when((r.own < PATTERN_MIN) & ~r.motif & (r.text <= 0), gone)
        .when((r.own < PATTERN_MIN) & (r.text > 0), _kept(by_text, F.when(r.other < OTHER_MAX, 0).otherwise(1), "kept_by_text"))
        .when((r.other >= OTHER_MAX) & r.mixed, _kept(F.round(0.72 * r.own + 0.08, 4), 1, "part_of_composite"))
        .otherwise(_kept(F.round(pure, 4), 0, "pure"))
    )


def best_verdicts(df: DataFrame, verdict: Column, keys: list[str], tie: list[str], most: int) -> DataFrame:
    """Rows with a verdict, its fields beside them: the `most` first of every key, by bucket, score and id."""
    got = _settled(df, verdict).where(F.col("bucket").isNotNull())
    return first_per_key(got, keys, "bucket", F.desc("score"), *tie, k=most, rank="rank")


@dataclass(frozen=True)
class Seen:
    """Evidence that a row shows a node of the tree. rival is the best score of the node's rivals, null where none of
    them was scored; strong says that its picture was graded a strong match, win that it won by its picture at all."""

    own: Column
    child: Column
    rival: Column
    distractor: Column
    win: Column
    strong: Column
    conflict: Column
    named: Column
    indexed: Column
    card: Column


def object_tier(e: Seen, leaf: Column, hard: Column, win: Column) -> Column:
    """(tier, reason) of a row for a node: a parent is met by its family, a leaf must beat its rivals."""
    t = lambda tier, reason: F.struct(F.lit(tier).alias("tier"), F.lit(reason).alias("reason"))
    need = F.when(hard, OBJECT_MIN).otherwise(PATTERN_MIN)
    win = win & ~hard
    rival = F.coalesce(e.rival, F.lit(0.0))
    parent = F.when((F.greatest(e.own, e.child) >= need) | win, t("same_family", "family_query")).otherwise(t("semantic", "weak_family"))
    weak = F.when(e.rival.isNotNull() & (rival > 0) & (rival >= need), t("same_family", "unspecific")).otherwise(t("semantic", "unknown_subtype"))
    return (
        F.when(~leaf, parent)
        .when((e.own < need) & ~win, weak)
        .when(e.rival.isNull(), t("very_similar", "no_rival_scores"))
        .when((rival > 0) & (e.own <= rival + 0.02), t("same_family", "rival"))
        .when((e.own >= need + 0.04) & (e.own > rival + 0.03), t("exact", "leaf_win"))
        .otherwise(t("very_similar", "leaf_ok"))
    )


def object_evidence(e: Seen, hard: Column, tier: Column) -> Column:
    """exact, family, semantic, unknown or mismatch; nothing seen is no match."""
    own, card = F.greatest(e.own, e.child), e.card | e.indexed
    other = (e.distractor >= OBJECT_MIN) & (e.distractor > own + OBJECT_LEAD) & (own < OBJECT_MIN)
    return (
        F.when(hard & ~e.indexed & (e.conflict | other), "mismatch")
        .when(hard & (own < OBJECT_MIN) & ~card, "unknown")
        .when(tier == "exact", "exact")
        .when(tier.isin("same_family", "very_similar"), "family")
        .when((own >= OBJECT_MIN) | card, "semantic")
        .otherwise("unknown")
    )


def ranked_by_tree(df: DataFrame, e: Seen, leaf: Column, hard: Column, scored: Column, by_text: Column, keys: list[str], score: str, tie: list[str]) -> DataFrame:
    """df with tier, evidence, reason, place and rank, without the rows that show something else.

    scored says that pictures were compared for the query at all: then a row needs a win, unless its node is one that
    text alone may prove (by_text). A leaf's rows are cut to LEAF_ROWS, by place, score and id; a parent's are all kept."""
    own = F.greatest(e.own, e.child)
    seen = e.win | e.strong
    win = (seen & (~hard | (own >= OBJECT_MIN) | e.strong)) | e.indexed
    got = _settled(df, F.struct(win.alias("__win"), hard.alias("__hard"), leaf.alias("__leaf")))
    win, hard, leaf = F.col("__win"), F.col("__hard"), F.col("__leaf")
    t = object_tier(e, leaf, hard, win)
    got = _settled(got, F.struct(t["tier"].alias("__tier"), t["reason"].alias("__reason")))
    got = _settled(got, F.struct(object_evidence(e, hard, F.col("__tier")).alias("evidence")))
    mismatch, unknown = F.col("evidence") == "mismatch", F.col("evidence") == "unknown"
    demoted = mismatch | (unknown & hard & (F.col("__reason") == "family_query"))
    tier = F.when(demoted, "semantic").otherwise(F.col("__tier"))
    reason = F.when(mismatch, "object_mismatch").when(demoted, "no_object_clip").otherwise(F.col("__reason"))
    got = _settled(got, F.struct(tier.alias("tier"), reason.alias("reason")))
    doubtful = ((scored & ~by_text) | (hard & mismatch & ~e.named)) & ~win
    vague = mismatch | unknown | (F.col("tier") == "semantic") | (leaf & (F.col("reason") == "unspecific"))
    order = F.coalesce(*[F.when(F.col("tier") == name, at) for name, at in TIER_ORDER.items()])
    place = F.when(mismatch, MISMATCH_ORDER).when(unknown & hard, F.greatest(order, F.lit(UNKNOWN_ORDER))).otherwise(order)
    kept = got.where(~(doubtful & vague)).withColumn("place", place).drop("__win", "__hard", "__tier", "__reason")
    first = first_per_key(kept.where("__leaf"), keys, "place", F.desc(score), *tie, k=LEAF_ROWS, rank="rank")
    return first.unionByName(kept.where("NOT __leaf").withColumn("rank", F.lit(None).cast("int"))).drop("__leaf")
