"""Filters of ordered lists. Each keeps the order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.functions.scalars import DAY_S, in_window, micros, seconds_between, tag_namespace, tag_text, tag_value, time_window
from tracklight.plans.ordered import TrackList

STATES = ("nah", "hmm", "yah", "star")


def require_saved(tracks: TrackList) -> TrackList:
    """An error, when run, if a row was never saved (version 0)."""
    return tracks.where(F.when(F.col("version") == 0, F.raise_error(F.lit("a track was never saved")).cast("boolean")).otherwise(True))


def deduplicate(tracks: TrackList) -> TrackList:
    """The first row of each track id."""
    w = Window.partitionBy("track_id").orderBy(*[k.order() for k in tracks.keys])
    return tracks.with_df(tracks.df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first"))


def by_release_date(tracks: TrackList, as_of: dt.datetime, min_age_days: int | None = None, max_age_days: int | None = None) -> TrackList:
    """By whole days since the release; rows without a date go."""
    age = F.floor(seconds_between(F.lit(as_of).cast("timestamp_ntz"), F.col("release_date")) / DAY_S)
    keep = F.col("release_date").isNotNull()
    if min_age_days is not None:
        keep = keep & (age >= min_age_days)
    if max_age_days is not None:
        keep = keep & (age <= max_age_days)
    return tracks.where(keep)


def _between(value: Column, least, most, include_missing: bool) -> Column:
    keep = F.lit(True)
    if least is not None:
        keep = keep & (value >= least)
    if most is not None:
        keep = keep & (value <= most)
    return F.when(value.isNull(), F.lit(include_missing)).otherwise(keep)


def by_release_year(tracks: TrackList, min_year: int | None = None, max_year: int | None = None, include_missing: bool = False) -> TrackList:
    if min_year is None and max_year is None:
        raise ValueError("by_release_year needs min_year or max_year")
    return tracks.where(_between(F.year("release_date"), min_year, max_year, include_missing))


def by_duration(tracks: TrackList, min_ms: int | None = None, max_ms: int | None = None, include_missing: bool = False) -> TrackList:
    return tracks.where(_between(F.col("duration_ms"), min_ms, max_ms, include_missing))


def by_metric(tracks: TrackList, name: str, min_value: float | None = None, max_value: float | None = None, include_missing: bool = False) -> TrackList:
    """A metric that no enricher added, or a value that isn't a number, is missing."""
    column = f"m_{name}"
    numeric = column in tracks.df.columns and tracks.df.schema[column].dataType.typeName() not in ("timestamp", "timestamp_ntz", "string")
    return tracks.where(_between(F.col(column) if numeric else F.lit(None).cast("double"), min_value, max_value, include_missing))


def by_tracks(tracks: TrackList, reference: DataFrame) -> TrackList:
    """Without the tracks of another list."""
    return tracks.with_df(tracks.df.join(reference.select("track_id").distinct(), "track_id", "left_anti"))


def by_artists(tracks: TrackList, reference: DataFrame, all_artists: bool = False) -> TrackList:
    """Without the artists of another list, in any case of letters: first artists of both, or all of both."""
    low = lambda a: F.transform("artists", lambda x: F.lower(x)) if a else F.transform(F.slice("artists", 1, 1), lambda x: F.lower(x))
    gone = reference.select(F.explode(low(all_artists)).alias("_artist")).distinct()
    if not all_artists:
        first = tracks.df.withColumn("_artist", F.lower(F.get("artists", F.lit(0))))
        return tracks.with_df(first.join(gone, "_artist", "left_anti").drop("_artist"))
    ids = tracks.df.select("track_id", F.explode(low(True)).alias("_artist")).join(gone, "_artist", "left_semi").select("track_id").distinct()
    return tracks.with_df(tracks.df.join(ids, "track_id", "left_anti"))


def by_liked_status(tracks: TrackList, service: str, is_liked: bool = True) -> TrackList:
    """By x_liked, a map of services; a missing service isn't liked."""
    return tracks.where(F.coalesce(F.try_element_at("x_liked", F.lit(service)), F.lit(False)) == F.lit(is_liked))


def by_explicit(tracks: TrackList, keep: str = "all") -> TrackList:
    """all; explicit; anything else is clean. A missing flag is clean."""
    if keep == "all":
        return tracks
    flag = F.coalesce(F.col("m_explicit_flag" if "m_explicit_flag" in tracks.df.columns else "explicit"), F.lit(0)) != 0
    return tracks.where(flag if keep == "explicit" else ~flag)


def by_play_history(tracks: TrackList, as_of: dt.datetime, min_plays: int | None = None, max_plays: int | None = None, include_missing: bool = False, date_source: str = "last_played", **window) -> TrackList:
    """Bounds on the number of plays, where none is 0, and a window on the last (or first) play, where none is missing."""
    after, before = time_window(as_of, **window)
    if min_plays is None and max_plays is None and after is None and before is None:
        raise ValueError("by_play_history needs a constraint")
    has = lambda c: F.col(c) if c in tracks.df.columns else F.lit(None)
    count, date = F.coalesce(has("m_total_plays"), F.lit(0)), has(f"m_{date_source}_dates").cast("timestamp_ntz")
    keep = _between(count, min_plays, max_plays, True)
    if after is not None or before is not None:
        keep = keep & F.when(date.isNull(), F.lit(include_missing)).otherwise(in_window(date, after, before))
    return tracks.where(keep)


def by_preference(tracks: TrackList, include: list[str] | None = None, exclude: list[str] | None = None) -> TrackList:
    """include drops unrated rows, exclude keeps them; unknown states count for nothing."""
    include, exclude = ([s for s in x or [] if s in STATES] for x in (include, exclude))
    if bool(include) == bool(exclude):
        raise ValueError("by_preference needs include or exclude, of known states")
    state = F.col("x_preference")
    return tracks.where(F.coalesce(state.isin(include), F.lit(False)) if include else state.isNull() | ~state.isin(exclude))


def by_tag(tracks: TrackList, tags: list[str], match_mode: str = "any") -> TrackList:
    """any of the tags, or all of them."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(map(tag_text, tags))])
    own = F.coalesce("x_tags", F.array().cast("array<string>"))
    return tracks.where(F.size(F.array_except(wanted, own)) == 0 if match_mode == "all" else F.arrays_overlap(own, wanted))


def by_tag_namespace(tracks: TrackList, namespace: str, values: list[str] | None = None) -> TrackList:
    """A tag of the namespace, as written, with one of the values, or any."""
    wanted = [v.strip().lower() for v in values or []]
    fits = lambda t: (tag_namespace(t) == namespace) & (tag_value(t).isin(wanted) if wanted else F.lit(True))
    return tracks.where(F.coalesce(F.exists("x_tags", fits), F.lit(False)))


__all__ = [n for n in dir() if n.startswith(("by_", "dedup", "require", "micros"))]
