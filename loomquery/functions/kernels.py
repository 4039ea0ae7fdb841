"""Similarity kernels as Column expressions: hashes, vectors, sets, boxes, colours and calibrations.

Every kernel stays in the JVM and is null-safe as its docstring says; scores lie in [0, 1].
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def _half(c: Column, at: int) -> Column:
    return F.conv(F.substring(c, at, 8), 16, 10).cast("long")


def hamming_hex(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 16-digit hex hashes; 64 where either is missing, malformed or of another length."""
    a, b = col(a), col(b)
    ok = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    bits = F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1))) + F.bit_count(_half(a, 9).bitwiseXOR(_half(b, 9)))
    return F.when(F.coalesce(ok, F.lit(False)), bits).otherwise(F.lit(64)).cast("int")


def phash_similarity(a: Column | str, b: Column | str) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - hamming_hex(a, b) / 64.0)


def mean_available(*parts: Column) -> Column:
    """Mean of the parts that are not null; 0 where none is."""
    n = reduce(lambda x, y: x + y, [p.isNotNull().cast("int") for p in parts])
    return F.when(n > 0, reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0.0)) for p in parts]) / n).otherwise(F.lit(0.0))


def combined_hash(*pairs: tuple[Column, Column]) -> Column:
    """Mean hash similarity over the kinds of hash that both sides have; 0 where they share none."""
    return mean_available(*[F.when(a.isNotNull() & b.isNotNull(), phash_similarity(a, b)) for a, b in pairs])


def tier_b(texture: Column | None = None, color: Column | None = None, visual: tuple[Column, Column, Column] | None = None) -> Column:
    """Mean of the enabled parts: .4 texture, .3 colour, and .15 of either vector with the boost of the index."""
    parts = [] if texture is None else [0.4 * texture]
    parts += [] if color is None else [0.3 * color]
    parts += [] if visual is None else [0.15 * visual[0], 0.15 * visual[1], visual[2]]
    return reduce(lambda x, y: x + y, parts) / len(parts) if parts else F.lit(0.0)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column | str, floor: float = 1e-8) -> Column:
    """The vector scaled to unit length; the norm is at least `floor`."""
    a = col(a)
    n = F.greatest(norm(a), F.lit(floor))
    return F.flatten(F.transform(F.array(n), lambda m: F.transform(a, lambda x: x.cast("double") / m)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine clipped at 0; 0 for missing vectors, unequal lengths or a norm product under 1e-8."""
    a, b = col(a), col(b)
    scale = norm(a) * norm(b)
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (scale >= 1e-8)
    return F.when(F.coalesce(ok, F.lit(False)), F.greatest(F.lit(0.0), dot(a, b) / scale)).otherwise(F.lit(0.0))


def centred(a: Column | str) -> Column:
    a = col(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)
    # the mean goes through a one-element array, so that it is worked out once and not for every component
    return F.flatten(F.transform(F.array(mean), lambda m: F.transform(a, lambda x: x.cast("double") - m)))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of two histograms, clipped at 0."""
    return cosine(centred(a), centred(b))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """|intersection| / |union| of two arrays; 0 if either is empty or missing."""
    a, b = col(a), col(b)
    ok = (F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(b, F.array().cast("array<string>"))) > 0)
    return F.when(ok, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def field_terms(*values: Column) -> Column:
    """Set of terms of string arrays: trimmed lower case, underscores as spaces, without empty ones and `unknown`."""
    every = F.concat(*[F.coalesce(v, F.array().cast("array<string>")) for v in values])
    plain = F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: F.replace(F.lower(F.trim(x)), F.lit("_"), F.lit(" ")))
    return F.array_distinct(F.filter(plain, lambda x: (x != "") & (x != "unknown")))


def field_matches(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """map<string, boolean>: for each field, whether both sides have terms and share one."""
    parts = [x for k in a for x in (F.lit(k), F.coalesce(F.arrays_overlap(a[k], b[k]), F.lit(False)))]
    return F.create_map(*parts)


#: Weights of the pattern fields.
PATTERN_WEIGHTS = {
    "family": 0.30, "subfamily": 0.16, "collection": 0.16, "series": 0.12, "motif": 0.16, "pattern_type": 0.10, "repeat_type": 0.10, "style": 0.08, "designer_style": 0.08,
    "brand_style": 0.06, "material_hint": 0.04, "repeat_class": 0.05, "texture_class": 0.05, "motif_class": 0.05, "complexity": 0.04, "visual_signature": 0.06,
}


def pattern_similarity(a: dict[str, Column], b: dict[str, Column], tags: tuple[Column, Column] | None = None) -> Column:
    """Weighted Jaccard over the fields both sides name; tags may lift it to .7 of itself and .3 of theirs."""
    score = reduce(lambda x, y: x + y, [w * jaccard(a[k], b[k]) for k, w in PATTERN_WEIGHTS.items() if k in a and k in b], F.lit(0.0))
    if tags is not None:
        both = (F.size(tags[0]) > 0) & (F.size(tags[1]) > 0)
        score = F.when(both, F.greatest(score, 0.70 * score + 0.30 * jaccard(*tags))).otherwise(score)
    return clamp(score)


def near(a: Column, b: Column) -> Column:
    """1 for equal numbers, falling to 0 at a difference of one."""
    return 1.0 - F.least(F.lit(1.0), F.abs(a - b))


def repeat_similarity(labels: Column, density: Column, stripe: Column, scale: Column, organic: Column) -> Column:
    """The better of the labels' Jaccard and the likeness of four measures of the repeat."""
    return F.greatest(labels, 0.35 * density + 0.25 * stripe + 0.20 * scale + 0.20 * organic)


#: Weights of the ten measures of spots.
SPOT_WEIGHTS = (0.18, 0.14, 0.08, 0.12, 0.14, 0.10, 0.08, 0.06, 0.05, 0.05)


def spot_similarity(a: Column, b: Column) -> Column:
    """Weighted likeness of two arrays of ten measures."""
    weights = F.array(*[F.lit(w) for w in SPOT_WEIGHTS])
    parts = F.zip_with(F.zip_with(a, b, lambda x, y: near(x.cast("double"), y.cast("double"))), weights, lambda x, w: x * w)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def patch_similarity(mine: Column, theirs: Column, best_of: int = 6) -> Column:
    """Mean of the best_of best of each query patch's best match; a match is .48 hash + .40 texture + .12 colour, scaled by
    half and half the lesser weight. Patches are structs (hash, texture, color, weight) of numbers whose likeness is near()."""

    def match(q, c):
        return (0.48 * near(q["hash"], c["hash"]) + 0.40 * near(q["texture"], c["texture"]) + 0.12 * near(q["color"], c["color"])) * (0.5 + 0.5 * F.least(q["weight"], c["weight"]))

    top = F.slice(F.sort_array(F.transform(mine, lambda q: F.array_max(F.transform(theirs, lambda c: match(q, c)))), asc=False), 1, best_of)
    mean = F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)
    return F.when((F.size(mine) > 0) & (F.size(theirs) > 0), mean).otherwise(F.lit(0.0))


def tier_a(p: Column, d: Column, w: Column) -> Column:
    return 0.40 * p + 0.25 * d + 0.15 * w + 0.20 * F.greatest(p, d, w)


def classical(p: Column, d: Column, w: Column, texture: Column, color: Column, ignore_color: bool = False) -> Column:
    """Score without learned vectors; a perceptual hash match of .98 or more is a floor."""
    weights = (0.42, 0.28, 0.18, 0.12, 0.0) if ignore_color else (0.40, 0.25, 0.15, 0.10, 0.10)
    base = sum((x * y for x, y in zip((p, d, w, texture, color), weights)), F.lit(0.0))
    return F.when(p >= 0.98, F.greatest(base, F.lit(0.98))).otherwise(base)


def effective_weights(color: str = "normal") -> dict[str, float]:
    """Signal weights; an ignored colour gives its weight to the rest, an important one doubles it up to .30."""
    w = {"dino": 0.35, "clip": 0.25, "phash": 0.20, "color": 0.10, "texture": 0.10}
    if color == "ignore":
        w["color"] = 0.0
    elif color == "important":
        w["color"] = min(0.30, w["color"] * 2)
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}


def weighted_available(parts: dict[str, tuple[Column, float]]) -> Column:
    """Sum of weight * score over positive weights, divided by those weights, for the scores that are not null."""
    top = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values() if w > 0), F.lit(0.0))
    bottom = sum((c.isNotNull().cast("double") * w for c, w in parts.values() if w > 0), F.lit(0.0))
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


#: Weights of the visual channels.
VISUAL_CHANNELS = {"clip": 0.34, "dino": 0.22, "object": 0.16, "color": 0.08, "dna": 0.08, "ocr": 0.06, "face": 0.06}


def protected_floor(p: Column, d: Column, w: Column, same_extension: Column, is_self: Column) -> Column:
    """Least score of a row whose hashes say it is the same picture; 0 where they don't."""
    return (
        F.when(is_self, F.lit(1.0)).when((p >= 0.92) & (d >= 0.94), F.lit(0.99))
        .when((p >= 0.95) & (d >= 0.90), F.when(same_extension, F.lit(0.95)).otherwise(F.lit(0.90)))
        .when((d >= 0.98) & (w >= 0.90) & (p >= 0.88), F.lit(0.95)).when((p >= 0.88) & (d >= 0.88) & (w >= 0.88), F.lit(0.88)).otherwise(F.lit(0.0))
    )


def duplicate_class(same_partial: Column, p: Column, d: Column, w: Column, color: tuple[Column, Column], scale: tuple[Column, Column]) -> Column:
    """exact, color_variant, scale_variant, near or none. Colours and scales differ, or agree, only where both are known."""
    recolored, rescaled = (F.coalesce(a != b, F.lit(False)) for a, b in (color, scale))
    alike = F.coalesce(color[0] == color[1], F.lit(False))
    soft = (p >= 0.78) & (d >= 0.72)
    return (
        F.when(same_partial | ((p >= 0.98) & (d >= 0.96)), "exact").when((p >= 0.88) & (d >= 0.82) & recolored, "color_variant")
        .when((p >= 0.82) & (d >= 0.75) & rescaled & ~recolored, "scale_variant").when((p >= 0.90) | ((p >= 0.85) & (d >= 0.80)) | ((w >= 0.90) & (p >= 0.80)), "near")
        .when(soft & recolored, "color_variant").when(soft & rescaled, "scale_variant").when(soft & alike, "near").otherwise("none")
    )


def piecewise(x: Column, anchors: list[tuple[float, float]], digits: int = 4) -> Column:
    """Linear interpolation between (x, y) anchors, constant beyond them."""
    out = F.when(x <= anchors[0][0], F.lit(anchors[0][1]))
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:]):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) / (x1 - x0) * (y1 - y0))
    return F.round(out.otherwise(F.lit(anchors[-1][1])), digits)


# Boxes are structs or four columns x1, y1, x2, y2 in 0..1.
def box_area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def box_overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    both = box_area(a) + box_area(b) - box_overlap(a, b)
    return F.when(both > 0, box_overlap(a, b) / both).otherwise(F.lit(0.0))


def box_containment(inner: Column, outer: Column) -> Column:
    area = box_area(inner)
    return F.when(area > 0, box_overlap(inner, outer) / area).otherwise(F.lit(0.0))


def box_centre_distance(a: Column, b: Column) -> Column:
    dx = (a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2
    dy = (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def box_gap(a: Column, b: Column) -> Column:
    dx = F.greatest(a["x1"] - b["x2"], b["x1"] - a["x2"], F.lit(0.0))
    dy = F.greatest(a["y1"] - b["y2"], b["y1"] - a["y2"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def box_relation(a: Column, b: Column, axis: float = 0.04, iou: float = 0.02, inside: float = 0.85) -> Column:
    """inside, contains, overlapping, left_of, right_of, above, below or near: the first that holds."""
    dx = (b["x1"] + b["x2"] - a["x1"] - a["x2"]) / 2
    dy = (b["y1"] + b["y2"] - a["y1"] - a["y2"]) / 2
    return (
        F.when(box_containment(a, b) >= inside, "inside").when(box_containment(b, a) >= inside, "contains").when(box_iou(a, b) >= iou, "overlapping")
        .when((F.abs(dx) >= F.abs(dy)) & (dx >= axis), "left_of").when((F.abs(dx) >= F.abs(dy)) & (dx <= -axis), "right_of")
        .when(dy >= axis, "above").when(dy <= -axis, "below").otherwise("near")
    )


def rgb_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x.cast("double")))


def mean_color_similarity(a: Column, b: Column) -> Column:
    """1 - distance over the colour cube's diagonal."""
    return clamp(1.0 - rgb_distance(a, b) / 441.7)


def unified_image(base: Column, visual: Column, semantic: Column) -> Column:
    return clamp(0.72 * base + 0.18 * visual + 0.10 * semantic)


def hybrid_text(visual: Column, texture: Column, fname: Column, ocr: Column, family: Column) -> Column:
    return clamp(0.65 * visual + 0.15 * texture + 0.10 * fname + 0.05 * ocr + 0.05 * family)


def textile_rerank(emb, dna, tex, repeat, spot, color, kb, sem, base) -> Column:
    final = 0.30 * emb + 0.20 * dna + 0.15 * tex + 0.10 * repeat + 0.10 * spot + 0.05 * color + 0.05 * kb + 0.05 * sem
    return clamp(0.55 * final + 0.45 * base)


def family_cap(relation: Column, protected: Column) -> Column:
    """Largest score a row may have by the relation of its family to the query's."""
    return (
        F.when(relation == "same_subtype", F.lit(1.0)).when(relation == "same", F.when(protected, F.lit(0.85)).otherwise(F.lit(0.75)))
        .when(relation == "related", F.when(protected, F.lit(0.78)).otherwise(F.lit(0.60))).otherwise(F.when(protected, F.lit(0.68)).otherwise(F.lit(0.40)))
    )


def fine_detail(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 of two signatures; 0 where a norm vanishes."""
    scale = norm(a) * norm(b)
    return F.when(scale > 1e-8, (dot(a, b) / scale + 1.0) / 2.0).otherwise(F.lit(0.0))


#: Cosine of a text and a picture, and the relevance it stands for.
TEXT_ANCHORS = [(0.0, 0.0), (0.16, 0.10), (0.20, 0.22), (0.24, 0.36), (0.28, 0.48), (0.32, 0.60), (0.36, 0.70), (0.40, 0.78), (0.46, 0.86), (0.55, 0.90), (1.0, 0.93)]
#: Palettes and animal prints that count as alike.
BROWN_PALETTES = ["brown_tan", "orange", "yellow"]
LEOPARDS = ["leopard", "jaguar", "cheetah"]
ANIMALS = ["leopard", "jaguar", "cheetah", "tiger", "zebra", "snake", "crocodile", "cow", "unknown_animal"]
#: Colour groups and the affinity of two colours of one group, tried in this order.
COLOR_GROUPS = [
    (["red", "orange", "coral", "yellow", "gold", "burgundy", "pink", "magenta"], 0.72),
    (["navy", "indigo", "royal_blue", "sky_blue", "teal", "turquoise", "mint", "emerald", "purple", "lavender"], 0.72),
    (["brown", "beige", "cream", "olive", "khaki", "forest", "earth"], 0.75),
    (["black_white", "grayscale", "black", "white", "cream"], 0.80),
]
#: Root families that exclude each other.
FAMILY_CONFLICTS = [("animal_print", "floral"), ("animal_print", "plaid_check"), ("animal_print", "geometric"), ("animal_print", "plain"), ("animal_print", "marble_abstract"), ("floral", "camouflage"), ("floral", "plaid_check")]


def text_calibration(cosine: Column) -> Column:
    """Relevance that a cosine of text and picture stands for."""
    return piecewise(F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0))), TEXT_ANCHORS, 4)


def _named(c: Column) -> Column:
    return c.isNotNull() & (c != "") & (c != "unknown")


def palette_similarity(a: Column, b: Column) -> Column:
    same = F.when(a == b, 1.0).when(a.isin(BROWN_PALETTES) & b.isin(BROWN_PALETTES), 0.85).when((a == "black_white") & (b == "grayscale"), 0.75)
    return F.when(_named(a) & _named(b), same.otherwise(0.2)).otherwise(0.5)


def animal_similarity(a: Column, b: Column) -> Column:
    """Likeness of two kinds of animal print; the first is the query's."""
    known = a.isNotNull() & (a != "") & b.isNotNull() & (b != "")
    big_cat = F.when(b.isin(LEOPARDS), 0.9).when(b == "tiger", 0.75).when(b.isin("zebra", "snake", "crocodile", "cow"), 0.55)
    kind = F.when(a == b, 1.0).when(a.isin(LEOPARDS) & big_cat.isNotNull(), big_cat).when(a.isin(ANIMALS) & b.isin(ANIMALS), 0.5)
    return F.when(known, kind.otherwise(0.15)).otherwise(0.3)


def texture_family_score(same_family: Column, blob: tuple[Column, Column], stripe: tuple[Column, Column], scale: tuple[Column, Column], animal: Column) -> Column:
    form = sum((w * (1 - F.abs(a - b)) for w, (a, b) in ((0.35, stripe), (0.25, scale))), 0.4 * (1 - F.abs(blob[0] - blob[1])))
    return F.least(F.lit(1.0), 0.4 * F.when(same_family, 0.7).otherwise(0.25) + 0.35 * form + 0.25 * animal)


def hierarchy_score(visual: Column, patch: Column, texture_family: Column, palette: Column, animal: Column) -> Column:
    return F.least(F.lit(1.0), 0.30 * visual + 0.25 * patch + 0.20 * texture_family + 0.15 * palette + 0.10 * animal)


def color_affinity(a: Column, b: Column) -> Column:
    """Affinity of two colour names; unnamed ones have none."""
    out = F.when(~(a.isNotNull() & (a != "") & b.isNotNull() & (b != "")), 0.0).when(a == b, 1.0)
    for names, score in COLOR_GROUPS:
        out = out.when(a.isin(names) & b.isin(names), score)
    return out.otherwise(0.18)


def family_affinity(a: Column, b: Column, roots: tuple[Column, Column], parents: tuple[Column, Column]) -> Column:
    """Affinity of two families by their own names, their roots and their parents."""
    (ra, rb), (pa, pb) = roots, parents
    clash = F.lit(False)
    for x, y in FAMILY_CONFLICTS:
        clash = clash | ((ra == x) & (rb == y)) | ((ra == y) & (rb == x))
    kin = F.when(a == b, 1.0).when((ra == rb) & ~ra.isin("unknown", "plain"), 0.82).when((pa != "") & (pa == pb), 0.70)
    return F.when(_named(a) & _named(b), kin.when(clash, 0.05).when(ra != rb, 0.15).otherwise(0.35)).otherwise(0.0)


def knowledge_boost(family: Column, motif: Column, color: Column, text: Column) -> Column:
    return F.least(F.lit(1.0), 0.45 * family + 0.30 * motif + 0.15 * color + 0.10 * text)


def unified_text(base: Column, clip: Column, extra: Column, structure: Column, semantic: Column, exact: Column, relation: Column, grade_bonus: Column, margin: Column, rival: Column) -> Column:
    """Relevance of a row to a text. relation tells the families apart: same, other, or unknown on the row's side.

    A cosine of .20 makes the picture lead, and rows whose picture does not win are capped; below that the strongest
    visual channel, then the written evidence decide, and an exact label without a picture stands by itself."""
    shown, evidence = text_calibration(clip), F.greatest(exact, semantic)
    wins = (shown >= 0.80) | (clip >= 0.55)
    form = F.when(relation == "same", structure).otherwise(0.0)
    winner = F.greatest(shown, 0.82 * shown + 0.10 * extra + 0.08 * form)
    mixed = 0.42 * shown + 0.16 * extra + 0.12 * form + 0.10 * semantic + 0.08 * evidence
    plain_cap = F.when(relation == "other", 0.48).when(clip >= 0.32, F.when((relation == "unknown") & (extra < 0.40), 0.55).otherwise(0.58)).otherwise(0.50)
    winner_cap = F.when((relation == "other") & (extra < 0.40), 0.56).otherwise(1.0)
    seen = F.when(wins, F.least(winner, winner_cap)).otherwise(F.least(mixed, plain_cap))
    v = F.greatest(clip, 0.55 * extra)
    unseen = (
        F.when(v >= 0.75, F.greatest(0.90 * v + 0.10 * evidence, 0.55 * v + 0.25 * evidence + 0.20 * base))
        .when(v >= 0.55, 0.62 * v + 0.20 * evidence + 0.18 * base).when(v >= 0.30, 0.45 * v + 0.30 * evidence + 0.25 * base).otherwise(0.62 * evidence + 0.38 * base)
    )
    labelled = F.when(exact >= 0.88, F.greatest(unseen, 0.78 * exact + 0.22 * base)).otherwise(unseen)
    penalty = 0.25 * F.greatest(F.lit(0.0), rival - F.greatest(F.lit(0.0), clip - 0.08))
    return clamp(F.when(clip >= 0.20, seen).otherwise(labelled) + 0.65 * grade_bonus + 0.02 * F.greatest(F.lit(0.0), margin) - penalty)


def learning_decision(top: Column, second: Column, verified: Column, near_negative: Column) -> Column:
    """auto, candidate or ignore, from a row's best two concepts, a user's own label and a negative example close by."""
    close = (second >= top - 0.05) & (second >= 0.72)
    return F.when(verified, "ignore").when(near_negative, "candidate").when((top >= 0.82) & (second < 0.82) & ~close, "auto").when(top >= 0.72, "candidate").otherwise("ignore")
