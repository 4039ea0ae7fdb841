"""Soft layers over scored rows: each takes a score Column and evidence Columns and gives the new score.

Layers move a score by bounded amounts and never drop a row; gates cap it. They compose in any order that a query
plans, as one projection, so a chain of them costs a single pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions.kernels import clamp

Layer = Callable[[Column], Column]


def pick(cond: Column, yes: Column | float, no: Column | float = 0.0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.when(cond, lit(yes)).otherwise(lit(no))


def attributes(mean: Column, aligned: Column) -> Layer:
    """Mean attribute match in [-1, 1]: at most +.10 and -.05, nothing for another concept."""
    up, down = F.least(F.lit(0.10), 0.045 + 0.055 * mean), F.greatest(F.lit(-0.05), -0.035 + 0.045 * mean)
    return lambda s: clamp(s + pick(aligned, pick(mean >= 0, up, down)))


def colour_evidence(hits: Column, misses: Column, known: Column) -> Layer:
    """Wanted colours found and missed; unknown colours change nothing."""
    up = pick(hits > 0, F.least(F.lit(0.08), 0.03 * hits + 0.02))
    down = F.when((misses > 0) & (hits == 0), F.least(F.lit(0.04), 0.02 * misses)).when((misses > 0) & (hits > 0), F.least(F.lit(0.02), 0.01 * misses)).otherwise(F.lit(0.0))
    return lambda s: clamp(s + pick(known, F.greatest(F.lit(-0.04), F.least(F.lit(0.08), up - down))))


def pattern_not_object(textile: Column, obj: Column, protected: Column, strong: float = 0.55, weak: float = 0.35, most: float = 0.32) -> Layer:
    """For a pattern query: strong patterns may gain a little, object photos lose in proportion to the gap."""

    def layer(s: Column) -> Column:
        lead = F.when((textile >= 0.72) & (obj < 0.55), F.least(F.lit(1.0), s + 0.025)).otherwise(s)
        photo = s * (1 - F.least(F.lit(most), 0.10 + 0.28 * F.greatest(obj - textile, F.lit(0.0))))
        tilt = s * (1 - F.least(F.lit(0.12), 0.06 + 0.15 * (obj - textile)))
        return F.when(protected, s).when(textile >= strong, lead).when((obj >= 0.45) & (textile < weak), photo).when(obj > textile + 0.20, tilt).otherwise(s)

    return layer


def query_evidence(color: Column, text: Column, strong_visual: Column, missing: Column, bridge: Column, composite: Column, conflict: Column, objects_met: Column) -> Layer:
    """color: 1 supported, -1 contradicted, 0 unknown; composite: 2 all, 1 related, 0 none."""
    delta = (
        F.when(color > 0, 0.08).when(color < 0, -0.10).otherwise(0.0) + pick(text, 0.06) + pick(strong_visual, 0.08)
        - pick(missing, pick(bridge, 0.03, 0.12)) + F.when(composite == 2, 0.10).when(composite == 1, 0.06).otherwise(0.0) - pick(conflict, 0.05)
    )
    return lambda s: pick(objects_met, clamp(s + delta), F.least(clamp(s + delta), F.lit(0.48)))


def rivals(is_rival: Column) -> Layer:
    return lambda s: clamp(s - pick(is_rival, 0.08))


def intent(primary: Column, secondary: Column, several: Column, pattern_for_person: Column) -> Layer:
    return lambda s: clamp(s + pick(primary, 0.10) + pick(secondary, 0.05) + pick(several, 0.04) - pick(pattern_for_person, 0.06))


def concept_evidence(match: Column, hits: Column, aligned: Column) -> Layer:
    """match: 2 strong, 1 medium, 0 none, -1 and -2 mismatches of that strength; colours add up to .02."""
    scale = F.when(match == 2, 0.025).when(match == 1, 0.015).when(match == -1, -0.01).when(match == -2, -0.02).otherwise(0.0)
    return lambda s: clamp(s + pick(aligned, F.greatest(F.lit(-0.04), scale + F.least(F.lit(0.02), 0.01 * hits))))


def fusion(color: Column, aligned: Column, entity: Column, detected: Column, motif: Column, pattern: Column, negative: Column, coverage: Column, full: Column) -> Layer:
    """Channel bonuses of a query with several channels, then the caps of rows that miss one."""
    bonus = (
        pick(color >= 0.5, pick(aligned, 0.06 * color, 0.01 * color)) + pick(detected, 0.06 * entity, pick(entity > 0, 0.02 * entity)) + pick(motif >= 0.5, 0.05 * motif)
        + F.when(pattern >= 0.5, 0.08 * pattern).when(negative, F.lit(-0.04)).otherwise(F.lit(0.0)) + F.when(full, F.lit(0.04)).when(coverage >= 0.5, 0.015 * coverage).otherwise(F.lit(0.0))
    )

    def layer(s: Column) -> Column:
        new = F.least(F.lit(1.0), s + bonus)
        new = F.when(negative, F.least(new, F.lit(0.42))).otherwise(new)
        return F.when(color < 0.5, F.least(new, F.lit(0.50))).otherwise(new)

    return layer


def visual_pattern(positive: Column, negative: Column, dna: Column, family: Column, texture: Column, dino: Column, clip: Column, color: Column, text: Column) -> Layer:
    """Priority of rows with visual proof of a pattern; the rest gain next to nothing."""
    visual = 0.4 * dna + 0.3 * family + 0.3 * texture
    strong = 0.16 * dna + 0.12 * family + 0.08 * texture + 0.06 * dino + 0.04 * clip + 0.02 * color + 0.01 * F.least(text, F.lit(0.3))
    faint = 0.05 * dna + 0.04 * family + 0.03 * texture + 0.025 * dino + 0.02 * clip + 0.01 * color + 0.005 * text
    return lambda s: F.when(negative, F.least(s, F.lit(0.42))).when(positive, F.greatest(clamp(s + strong), F.least(F.lit(1.0), 0.62 + 0.28 * visual))).otherwise(clamp(s + faint))


def semantic_gate(leaf: Column, rival: Column, text: Column) -> Column:
    """Tier of a leaf concept against its best rival."""
    return F.when(text >= 0.78, "exact").when((leaf >= 0.7) & (leaf > rival), "very_similar").when((leaf >= 0.5) & (leaf >= rival), "variant").otherwise("semantic")


#: Largest scores of the tiers of semantic_gate.
TIER_CAPS = {"exact": 0.78, "very_similar": 0.70, "variant": 0.58, "semantic": 0.58}


def multi_concept(coverage: Column, same: Column, patch: Column, semantic: Column, embedding: Column, dna: Column, texture: Column, contradiction: Column, several: Column) -> Column:
    """Composition score: weighted parts, less for missing concepts and contradictions."""
    base = 0.30 * coverage + 0.25 * same + 0.15 * patch + 0.10 * semantic + 0.10 * embedding + 0.05 * dna + 0.05 * texture
    got = pick(coverage < 1, base * 0.82, base) - 0.10 * contradiction
    return clamp(F.when(several & (coverage >= 1) & (same < 0.35), F.least(got, F.lit(0.60))).otherwise(got))


def chain(df: DataFrame, score: str, layers: list[Layer], digits: int = 9) -> DataFrame:
    """Apply layers in order to the score column; the score before stays as base_score."""
    out = F.col(score)
    for layer in layers:
        out = layer(out)
    return df.withColumn("base_score", F.col(score)).withColumn(score, F.round(out, digits))
