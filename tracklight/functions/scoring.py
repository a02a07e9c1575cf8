"""Probabilistic matching: comparison levels, their log-likelihood ratios, confidence and zones, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklight.functions import text

#: Chance of a level among matches and among non-matches, fixed values.
TITLE = {"exact": (0.95, 0.005), "phonetic": (0.90, 0.01), "high": (0.85, 0.02), "moderate": (0.70, 0.05), "variation": (0.30, 0.03), "mismatch": (0.05, 0.60), "missing": (0.50, 0.50)}
ARTIST = {"exact": (0.95, 0.002), "phonetic": (0.88, 0.01), "high": (0.80, 0.03), "low": (0.60, 0.08), "mismatch": (0.05, 0.70), "missing": (0.50, 0.50)}
DURATION = {"close": (0.95, 0.10), "near": (0.90, 0.15), "moderate": (0.70, 0.25), "mismatch": (0.15, 0.60), "missing": (0.50, 0.50)}
ISRC = {"exact": (0.99, 0.0001), "suspect": (0.80, 0.001), "absent": (0.50, 0.50)}
MODERATE, CLOSE_MS, NEAR_MS, FAR_MS = 0.7, 1_000, 3_000, 10_000


@dataclass(frozen=True)
class Settings:
    accept: int = 85
    review: int = 50
    high: float = 0.9
    phonetic: float = 0.85
    variation: float = 0.6
    identical: float = 1.0


DEFAULT = Settings()


def varies(long: Column, short: Column) -> Column:
    """Whether what a lower-case title has beside the one it holds has a version marker."""
    rest = F.trim(F.regexp_replace(F.replace(long, short, F.lit("")), r"^[- ()\[\]]+|[- ()\[\]]+$", ""))
    return rest.rlike("|".join(text.VARIATIONS))


def title_similarity(a: Column, b: Column, norm_a: Column, norm_b: Column, key_a: Column, key_b: Column, s: Settings = DEFAULT) -> Column:
    """1 for equal titles, `variation` where one holds the other and a version marker, 1 for equal normal forms, `phonetic` for equal non-empty keys, else the word-set ratio.

    Normal forms and keys are passed in, so that each text is normalised once and not once a pair.
    """
    low_a, low_b = F.lower(a), F.lower(b)
    varies_ = F.when(F.contains(low_b, low_a), varies(low_b, low_a)).otherwise(F.contains(low_a, low_b) & varies(low_a, low_b))
    return (
        F.when(low_a == low_b, F.lit(s.identical))
        .when(varies_, F.lit(s.variation))
        .when(norm_a == norm_b, F.lit(s.identical))
        .when((key_a == key_b) & (key_a != ""), F.lit(s.phonetic))
        .otherwise(text.token_set_ratio(norm_a, norm_b) / 100)
    )


def artist_similarity(norm_a: Column, norm_b: Column, key_a: Column, key_b: Column, s: Settings = DEFAULT) -> Column:
    phonetic = (key_a == key_b) & (key_a != "")
    return F.when(norm_a == norm_b, F.lit(1.0)).when(phonetic, F.lit(s.phonetic)).otherwise(text.token_sort_ratio(norm_a, norm_b) / 100)


def title_level(similarity: Column, is_variation: Column, is_phonetic: Column, s: Settings = DEFAULT) -> Column:
    return F.when(similarity.isNull(), "missing").when(similarity >= 1, "exact").when(is_variation, "variation").when(is_phonetic, "phonetic").when(similarity >= s.high, "high").when(similarity >= MODERATE, "moderate").otherwise("mismatch")


def artist_level(similarity: Column, is_phonetic: Column, s: Settings = DEFAULT) -> Column:
    return F.when(similarity.isNull(), "missing").when(similarity >= 1, "exact").when(is_phonetic, "phonetic").when(similarity >= s.high, "high").when(similarity >= MODERATE, "low").otherwise("mismatch")


def duration_difference(a: Column, b: Column) -> Column:
    """Null where either is null or 0."""
    return F.when((a != 0) & (b != 0), F.abs(a - b))


def duration_level(difference: Column) -> Column:
    return F.when(difference.isNull(), "missing").when(difference <= CLOSE_MS, "close").when(difference <= NEAR_MS, "near").when(difference <= FAR_MS, "moderate").otherwise("mismatch")


def isrc_suspect(difference: Column) -> Column:
    return F.coalesce(difference > FAR_MS, F.lit(False))


def isrc_level(matched: Column, suspect: Column) -> Column:
    return F.when(~matched, "absent").when(suspect, "suspect").otherwise("exact")


def ratio(level: Column, table: dict[str, tuple[float, float]]) -> Column:
    """The log-likelihood ratio of a level's name."""
    out = F.lit(None).cast("double")
    for name, (m, u) in table.items():
        out = F.when(level == name, F.lit(math.log(m / u))).otherwise(out)
    return out


def weight(title: Column, artist: Column, duration: Column, isrc: Column) -> Column:
    return ratio(title, TITLE) + ratio(artist, ARTIST) + ratio(duration, DURATION) + ratio(isrc, ISRC)


def confidence(w: Column) -> Column:
    """0 to 100, rounded half to even."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 / (1 + F.exp(-w)), 0).cast("int")))


def zone(score: Column, method: Column, duration_missing: Column, s: Settings = DEFAULT) -> Column:
    """accept, review or reject; identifier matches without a duration to compare are never accepted unseen."""
    unsure = method.isin("isrc", "mbid") & duration_missing
    return F.when((score >= s.accept) & ~unsure, "accept").when(score >= s.review, "review").otherwise("reject")
