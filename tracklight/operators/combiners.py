"""Combiners of ordered lists. What enrichers added is dropped; sources' columns stay."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from tracklight.operators.filters import deduplicate
from tracklight.plans.ordered import ADDED, SORTS, Key, TrackList


def _rekeyed(tracks: TrackList, start: str) -> TrackList:
    """The list without what enrichers and sorters added; its keys are copies whose names begin with `start`."""
    own = {f"{start}_{n}": key for n, key in enumerate(tracks.keys)}
    df = tracks.df.withColumns({name: F.col(key.column) for name, key in own.items()})
    df = df.drop(*[c for c in tracks.df.columns if c.startswith((*ADDED, *SORTS)) or c == "_pos"])
    return replace(tracks, df=df, keys=tuple(Key(name, key.descending, key.nulls_first) for name, key in own.items()))


def _fresh(lists: list[TrackList]) -> str:
    """A start for names that none of the lists' sort columns has."""
    return f"{SORTS[1]}{sum(len(x.df.columns) for x in lists)}"


def _most(lists: list[TrackList]) -> int | None:
    return None if any(x.most is None for x in lists) else sum(x.most for x in lists)


def _checked(lists: list[TrackList]) -> list[TrackList]:
    if not lists:
        raise ValueError("a combiner needs lists")
    return lists


def _finished(tracks: TrackList, dedup: bool) -> TrackList:
    return deduplicate(tracks) if dedup else tracks


def concatenate(lists: list[TrackList], dedup: bool = False) -> TrackList:
    """One after the other. Nothing is numbered: rows are ordered by their list and by its own keys, which are null in the others' rows."""
    at = _fresh(_checked(lists))
    own = [_rekeyed(x, f"{at}_{k}") for k, x in enumerate(lists)]
    parts = [x.df.withColumn(f"{at}_list", F.lit(k)) for k, x in enumerate(own)]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    keys = (Key(f"{at}_list"), *[key for x in own for key in x.keys])
    return _finished(TrackList(df, keys, most=_most(lists)), dedup)


def interleave(lists: list[TrackList], dedup: bool = False, stop_on_empty: bool = False) -> TrackList:
    """In turns; exhausted lists are passed over, or end it all."""
    at = _fresh(_checked(lists))
    parts = [_rekeyed(x, f"{at}_{k}").numbered(f"{at}_turn").df.withColumn(f"{at}_list", F.lit(k)) for k, x in enumerate(lists)]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if stop_on_empty:
        sizes = df.groupBy(f"{at}_list").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("_least"), F.count(F.lit(1)).alias("_lists"))
        df = df.join(F.broadcast(sizes)).where((F.col("_lists") == len(lists)) & (F.col(f"{at}_turn") < F.col("_least"))).drop("_least", "_lists")  # one row
    return _finished(TrackList(df, (Key(f"{at}_turn"), Key(f"{at}_list")), most=_most(lists)), dedup)


def intersect(lists: list[TrackList], dedup: bool = False) -> TrackList:
    """Rows of the first list whose track is in all others."""
    out = _rekeyed(_checked(lists)[0], _fresh(lists))
    df = out.df
    for other in lists[1:]:
        df = df.join(other.df.select("track_id").distinct(), "track_id", "left_semi")
    return _finished(out.with_df(df), dedup)
