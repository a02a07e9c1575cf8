"""Selectors: first, last or random rows, by number or share."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tracklight.functions.scalars import draw
from tracklight.plans.ordered import Key, TrackList


def first(tracks: TrackList, n: int = 10) -> TrackList:
    """The first n; a negative n leaves off the last -n."""
    if n >= 0:
        return tracks.head(n)
    own = tracks.counted()
    return own.with_df(own.df.where(F.col("_pos") < F.col("_n") + n).drop("_n"))


def last(tracks: TrackList, n: int, compat: bool = False) -> TrackList:
    """The last n in their order; none for n of 0, or all with `compat`."""
    if n <= 0:
        return tracks if compat and n == 0 else tracks.head(0)
    return tracks.reverse().head(n).reverse()


def sample(tracks: TrackList, n: int, seed: int = 0) -> TrackList:
    """n rows without replacement in random order, drawn by the seed, the track and its position."""
    own = tracks.numbered()
    mixed = own.df.withColumn("_k1", draw(seed, "track_id", "_pos"))
    return replace(own, df=mixed, keys=(Key("_k1"), Key("_pos"))).head(n)


def by_method(tracks: TrackList, n: int, method: str = "first", seed: int = 0) -> TrackList:
    if method not in ("first", "last", "random"):
        raise ValueError(f"no such method: {method}")
    return first(tracks, n) if method == "first" else last(tracks, n) if method == "last" else sample(tracks, n, seed)


def by_percentage(tracks: TrackList, percentage: float = 0.0, method: str = "first", seed: int = 0) -> TrackList:
    """max(1, size * percentage / 100 rounded half to even) rows."""
    if method not in ("first", "last", "random"):
        raise ValueError(f"no such method: {method}")
    own = tracks.counted()
    n = F.greatest(F.lit(1), F.bround(F.col("_n") * float(percentage) / 100, 0))
    if method == "random":
        mixed = replace(own, df=own.df.withColumn("_k1", draw(seed, "track_id", "_pos")), keys=(Key("_k1"), Key("_pos"))).numbered("_pos")
        return mixed.with_df(mixed.df.where(F.col("_pos") < n).drop("_n"))
    keep = F.col("_pos") < n if method == "first" else F.col("_pos") >= F.col("_n") - n
    return own.with_df(own.df.where(keep).drop("_n"))
