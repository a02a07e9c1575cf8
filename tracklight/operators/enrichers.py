"""Enrichers: keyed left joins that add columns to ordered lists. m_ columns are metrics, x_ columns other facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.plans.ordered import TrackList

#: Metrics of a connector: the field of its metadata that holds each, and the hours that a sample stays fresh.
METRICS: dict[str, tuple[str, str, float]] = {
    "lastfm_user_playcount": ("lastfm", "user_playcount", 24.0),
    "lastfm_global_playcount": ("lastfm", "global_playcount", 24.0),
    "explicit_flag": ("spotify", "explicit", 24.0 * 30),
}
RESOLVERS: dict[str, object] = {}


def register_metric(name: str, connector: str, field: str | None = None, freshness_hours: float = 24.0) -> None:
    METRICS[name] = (connector, field or name, freshness_hours)


def register_resolver(name: str, resolver) -> None:
    """resolver(library) -> DataFrame of track_id and value takes the place of stored samples."""
    RESOLVERS[name] = resolver


def metric_names(connector: str, attributes: list[str]) -> list[str]:
    """Attribute to metric name: as it is, or with the connector's name in front; unknown ones are left out."""
    known = {n for n, (c, _, _) in METRICS.items() if c == connector}
    found = (a if a in known else f"{connector}_{a}" for a in attributes)
    return [n for n in found if n in known]


def _joined(tracks: TrackList, more: DataFrame) -> TrackList:
    """Left join on track_id; new columns take the place of old ones of their names."""
    names = [c for c in more.columns if c != "track_id"]
    return tracks.with_df(tracks.df.drop(*names).join(more, "track_id", "left"))


def latest_metric(metrics: DataFrame, connector: str, name: str, as_of: dt.datetime, max_age_hours: float = 24.0) -> DataFrame:
    """track_id and value of the newest sample that is fresh enough."""
    since = F.lit(as_of - dt.timedelta(hours=max_age_hours)).cast("timestamp_ntz")
    fresh = metrics.where((F.col("connector") == connector) & (F.col("metric_type") == name) & (F.col("collected_at") >= since))
    return fresh.groupBy("track_id").agg(F.max_by("value", F.struct("collected_at", "value")).alias("value"))


def metric_value(value: Column) -> Column:
    """A number from a JSON field's text: booleans are 1 and 0, numeric text is read, the rest is null."""
    return F.when(F.lower(value) == "true", 1.0).when(F.lower(value) == "false", 0.0).otherwise(value.try_cast("double"))


def extract_metrics(metadata: DataFrame, names: list[str]) -> DataFrame:
    """track_id, metric_type and value rows from a JSON column named metadata."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric_type"), metric_value(F.get_json_object("metadata", f"$.{METRICS[n][1]}")).alias("value")) for n in names])
    return metadata.select("track_id", F.inline(pairs)).where("value is not null")


def with_misses(ids: DataFrame, cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Cached values, and fetched ones for the tracks that the cache doesn't have."""
    own = ids.select("track_id").distinct()
    misses = own.join(cached, "track_id", "left_anti")
    return cached.join(own, "track_id", "left_semi").select("track_id", "value").unionByName(fetched.join(misses, "track_id", "left_semi").select("track_id", "value"))


def external_metrics(tracks: TrackList, metrics: DataFrame, names: list[str], as_of: dt.datetime, library=None) -> TrackList:
    for name in names:
        connector, _, hours = METRICS[name]
        values = RESOLVERS[name](library) if name in RESOLVERS else latest_metric(metrics, connector, name, as_of, hours)
        tracks = _joined(tracks, values.select("track_id", F.col("value").alias(f"m_{name}")))
    return tracks


def play_aggregates(plays: DataFrame, period: tuple[dt.datetime, dt.datetime] | None = None) -> DataFrame:
    """Plays of each track: all, last, first, and those of a period that includes both its ends."""
    more = []
    if period:
        start, end = (F.lit(x).cast("timestamp_ntz") for x in period)
        more = [F.count_if(F.col("played_at").between(start, end)).alias("period_plays")]
    return plays.groupBy("track_id").agg(F.count(F.lit(1)).alias("total_plays"), F.max("played_at").alias("last_played_dates"), F.min("played_at").alias("first_played_dates"), *more)


def play_history(tracks: TrackList, plays: DataFrame, as_of: dt.datetime, metrics: tuple[str, ...] = ("total_plays", "last_played_dates"), period_days: int | None = None) -> TrackList:
    """Adds the chosen metrics; tracks without plays get 0 or null."""
    if "period_plays" in metrics and period_days is None:
        raise ValueError("period_plays needs period_days")
    period = (as_of - dt.timedelta(days=period_days), as_of) if period_days is not None else None
    found = play_aggregates(plays, period)
    out = _joined(tracks, found.select("track_id", *[F.col(m).alias(f"m_{m}") for m in metrics]))
    counts = {f"m_{m}": F.coalesce(f"m_{m}", F.lit(0)) for m in metrics if m.endswith("plays")}
    return out.with_df(out.df.withColumns(counts) if counts else out.df)


def preferences(tracks: TrackList, table: DataFrame) -> TrackList:
    return _joined(tracks, table.select("track_id", F.col("state").alias("x_preference")))


def tags(tracks: TrackList, table: DataFrame) -> TrackList:
    """A sorted array of each track's tags; null without any."""
    return _joined(tracks, table.groupBy("track_id").agg(F.sort_array(F.collect_set("tag")).alias("x_tags")))


def liked_status(tracks: TrackList, likes: DataFrame, services: list[str] | None = None) -> TrackList:
    """A map of service to liked or not."""
    own = likes.where(F.col("service").isin(services)) if services else likes
    return _joined(tracks, liked_maps(own).withColumnRenamed("liked", "x_liked"))


def liked_maps(likes: DataFrame) -> DataFrame:
    """track_id and a map of service to is_liked; of several rows of a service true wins."""
    one = likes.groupBy("track_id", "service").agg(F.bool_or("is_liked").alias("is_liked"))
    return one.groupBy("track_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("service", "is_liked")))).alias("liked"))
