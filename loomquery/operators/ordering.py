"""Orders of result lists: sort keys by mode, near-tie bands that keep a shown order, and limits that queries ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomquery.operators.topk import first_per_key

#: Longest list that is shown, and what text results are sorted by in each mode; a minus turns a field round.
SHOWN = 800
TEXT_ORDERS = {
    "brand": "-brand_hit -visual -alias -ocr -score",
    "pattern": "-brand_hit negative -dna -family object bucket tier -margin -visual -score name",
    "composite": "-brand_hit -score bucket object tier -margin -visual -name",
    "person": "-brand_hit -gender object bucket tier -margin -visual -score -name",
    "semantic": "-brand_hit object bucket tier -margin -visual -score -name",
    "plain_pattern": "negative -dna -family -texture -dino -visual -score name ocr",
    "plain": "evidence_rank -score -family -texture -language",
}


def mode_key(mode: Column, fields: dict[str, Column]) -> Column:
    """One array that sorts rows ascending in their mode's order; a field that is missing counts as 0."""

    def one(order: str) -> Column:
        parts = [(-1 if f.startswith("-") else 1, fields.get(f.lstrip("-"), F.lit(0.0))) for f in order.split()]
        return F.array(*[sign * F.coalesce(c.cast("double"), F.lit(0.0)) for sign, c in parts])

    out = F
    for name, order in TEXT_ORDERS.items():
        out = out.when(mode == name, one(order))
    return out


def stable_order(df: DataFrame, keys: list[str], id_col: str, score: str, prior: str, tolerance: float = 0.03, shown: int = SHOWN) -> DataFrame:
    """Keys, id and `place` of the `shown` best rows of every list: by score, but rows whose scores lie within `tolerance`
    of the first of their band keep their prior order (rows without one come last, by id). A list is one array of at
    most `shown` items."""
    item = F.struct((-F.col(score)).alias("s"), F.col(id_col).alias("id"), F.coalesce(F.col(prior).cast("long"), F.lit(10**9)).alias("prior"))
    top = first_per_key(df.where(F.col(score).isNotNull()), keys, F.desc(score), id_col, k=shown)
    lists = top.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("__items"))
    # Bands open at the rows whose score lies a tolerance below the score that opened the band before.
    opens = F.aggregate("__items", F.array().cast("array<double>"), lambda seen, x: F.when((F.size(seen) == 0) | (F.try_element_at(seen, F.lit(-1)) + x["s"] >= tolerance), F.array_append(seen, -x["s"])).otherwise(seen))
    rows = lists.select(*keys, opens.alias("__opens"), F.explode("__items").alias("__x"))
    band = F.size(F.filter("__opens", lambda o: o >= -F.col("__x.s")))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("__band", "__x.prior", "__x.s", "__x.id"))
    return rows.withColumn("__band", band).withColumn("place", place).select(*keys, F.col("__x.id").alias(id_col), "place")


def within_limit(rank: Column, wanted: Column) -> Column:
    """Whether a rank is on a list of the length its query asked for: at most `SHOWN`, and all rows for 0."""
    return (wanted == 0) | (rank <= F.least(wanted, F.lit(SHOWN)))
