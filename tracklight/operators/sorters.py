"""Sorters of ordered lists: stable in both directions, nothing is moved before positions are needed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklight.functions.scalars import draw, in_window, time_window
from tracklight.operators.filters import STATES
from tracklight.plans.ordered import Key, TrackList
from dataclasses import replace

#: Track attributes that by_metric sorts by, with what stands for a missing value.
ATTRIBUTES = {"title": "coalesce(title, '')", "album": "coalesce(album, '')", "artist": "coalesce(artist, '')", "duration": "coalesce(duration_ms, 0)", "duration_ms": "coalesce(duration_ms, 0)", "release_date": "coalesce(release_date, timestamp_ntz '0001-01-01')"}
HISTORY = ("total_plays", "last_played_date", "last_played_dates", "first_played_dates", "period_plays")
#: Names that mean another column.
ALIASES = {"last_played_date": "last_played_dates"}


def metric_kind(name: str) -> str:
    """attribute, history or external."""
    return "attribute" if name in ATTRIBUTES else "history" if name in HISTORY else "external"


def metric_kinds(name: Column) -> Column:
    """metric_kind of names in a column."""
    return F.when(name.isin([*ATTRIBUTES]), "attribute").when(name.isin([*HISTORY]), "history").otherwise("external")


def by_metric(tracks: TrackList, name: str, reverse: bool = True) -> TrackList:
    """By a track's attribute, or by a metric with missing values last in either direction."""
    if metric_kind(name) == "attribute":
        return tracks.sort(F.expr(ATTRIBUTES[name]), reverse)
    column = f"m_{ALIASES.get(name, name)}"
    return tracks.sort(F.col(column) if column in tracks.df.columns else F.lit(None).cast("double"), reverse)


def by_release_date(tracks: TrackList, reverse: bool = False) -> TrackList:
    return tracks.sort(F.col("release_date"), reverse)


def by_play_history(tracks: TrackList, as_of: dt.datetime, reverse: bool = True, exact: bool = False, **window) -> TrackList:
    """By all plays of tracks last played in the window, 0 for others: a stand-in for plays in the window, which `exact` takes from m_period_plays."""
    after, before = time_window(as_of, **window)
    has = lambda c: F.col(c) if c in tracks.df.columns else F.lit(None)
    if exact:
        return tracks.sort(F.coalesce(has("m_period_plays"), F.lit(0)), reverse)
    plays = F.coalesce(has("m_total_plays"), F.lit(0))
    if after is not None or before is not None:
        plays = F.when(in_window(has("m_last_played_dates").cast("timestamp_ntz"), after, before), plays).otherwise(0)
    return tracks.sort(plays, reverse)


def by_preference(tracks: TrackList, reverse: bool = True) -> TrackList:
    """By the state's rank; unrated rows rank below all, so they come first in ascending order."""
    state = F.col("x_preference") if "x_preference" in tracks.df.columns else F.lit(None).cast("string")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATES]), state) - 1, F.lit(-1))
    return tracks.sort(rank, reverse)


def by_date(tracks: TrackList, source: str, ascending: bool = True) -> TrackList:
    """By added_at, first_played or last_played; missing dates last in either direction."""
    column = {"added_at": "x_added_at", "first_played": "m_first_played_dates", "last_played": "m_last_played_dates"}[source]
    return tracks.sort(F.col(column) if column in tracks.df.columns else F.lit(None).cast("timestamp_ntz"), not ascending)


def reverse(tracks: TrackList) -> TrackList:
    return tracks.reverse()


def weighted_shuffle(tracks: TrackList, strength: float = 0.5, seed: int = 0) -> TrackList:
    """From the given order at strength 0 to a random one at 1; the draw depends on the seed, the track and its position."""
    if not 0 <= strength <= 1:
        raise ValueError("shuffle strength must be from 0 to 1")
    if strength == 0:
        return tracks
    own = tracks.counted()
    mixed = own.df.withColumn("_k1", (1 - strength) * F.col("_pos") / F.col("_n") + strength * draw(seed, "track_id", "_pos")).drop("_n")
    return replace(own, df=mixed, keys=(Key("_k1"), Key("_pos")))
