"""Merges of records and state changes, as plans for a table's new rows."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.operators.grouped import shuffle_partitions

#: From weakest to strongest, fixed values.
SOURCES = ("service_import", "playlist_assignment", "manual")
STATES = ("nah", "hmm", "yah", "star")


def rank(column: Column | str, order: tuple[str, ...]) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.array_position(F.array(*[F.lit(x) for x in order]), c)


def overrides(existing_source: Column, new_source: Column) -> Column:
    """A stronger source; equal ones don't override."""
    return rank(new_source, SOURCES) > rank(existing_source, SOURCES)


def preference_applies(old_state: Column, old_source: Column, state: Column, source: Column) -> Column:
    """A new rating applies to an unrated track, over a weaker source, or over a weaker state of an equal source."""
    stronger = overrides(old_source, source)
    equal = rank(source, SOURCES) == rank(old_source, SOURCES)
    return F.when(old_state.isNull(), True).when((old_state == state) & (old_source == source), False).when(stronger, True).otherwise(equal & (rank(state, STATES) > rank(old_state, STATES)))


def apply_preferences(existing: DataFrame, new: DataFrame) -> DataFrame:
    """track_id, state, source, old_state and changed after new ratings (track_id, state, source)."""
    o, n = existing.select("track_id", F.col("state").alias("old_state"), F.col("source").alias("old_source")), new.select("track_id", F.col("state").alias("new_state"), F.col("source").alias("new_source"))
    both = o.join(n, "track_id", "full_outer")
    changed = F.col("new_state").isNotNull() & F.coalesce(preference_applies(F.col("old_state"), F.col("old_source"), F.col("new_state"), F.col("new_source")), F.lit(False))
    return both.select("track_id", F.when(changed, F.col("new_state")).otherwise(F.col("old_state")).alias("state"), F.when(changed, F.col("new_source")).otherwise(F.col("old_source")).alias("source"), "old_state", changed.alias("changed"))


def repoint(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """rows with track_id moved to the winner of its merge (winner_id, loser_id)."""
    kept = merges.select(F.col("loser_id").alias("track_id"), "winner_id")
    return rows.join(kept, "track_id", "left").withColumn("track_id", F.coalesce("winner_id", "track_id")).drop("winner_id").select(*rows.columns)


def merge_likes(likes: DataFrame, merges: DataFrame) -> DataFrame:
    """Of two likes of a service the newer wins, and at equal times the liked one."""
    w = Window.partitionBy("track_id", "service").orderBy(F.col("liked_at").desc(), F.col("is_liked").desc())
    return repoint(likes, merges).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_preferences(preferences: DataFrame, merges: DataFrame) -> DataFrame:
    """The stronger source wins, then the stronger state, then the newer."""
    w = Window.partitionBy("track_id").orderBy(rank("source", SOURCES).desc(), rank("state", STATES).desc(), F.col("preferred_at").desc())
    return repoint(preferences, merges).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_metrics(metrics: DataFrame, merges: DataFrame) -> DataFrame:
    """The newest sample of each metric wins. Samples are dealt before they are sorted, so that no task sorts them beside the work that made them."""
    keys = ["track_id", "connector", "metric_type"]
    w = Window.partitionBy(*keys).orderBy(F.col("collected_at").desc(), F.col("value").desc())
    dealt = repoint(metrics, merges).repartition(shuffle_partitions(metrics.sparkSession), *keys)
    return dealt.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_mappings(mappings: DataFrame, merges: DataFrame) -> DataFrame:
    """All mappings of losers move to winners. Of live ones of the same connector track one stays and the others are retired into it; one of a connector stays primary, the winner's own before a loser's."""
    moved = mappings.join(merges.select(F.col("loser_id").alias("track_id"), "winner_id"), "track_id", "left")
    moved = moved.withColumn("_moved", F.col("winner_id").isNotNull()).withColumn("track_id", F.coalesce("winner_id", "track_id")).drop("winner_id")
    alive = moved.where("not is_retired")
    same = Window.partitionBy("track_id", "connector", "connector_track_id").orderBy("_moved", F.col("is_primary").desc(), "mapping_id")
    kept = F.first("mapping_id").over(same)
    alive = alive.withColumn("retired_into", F.when(kept != F.col("mapping_id"), kept)).withColumn("is_retired", F.col("retired_into").isNotNull())
    best = Window.partitionBy("track_id", "connector", "is_retired").orderBy(F.col("is_primary").desc(), "_moved", "mapping_id")
    alive = alive.withColumn("is_primary", ~F.col("is_retired") & F.col("is_primary") & (F.row_number().over(best) == 1))
    retired = moved.where("is_retired").withColumn("retired_into", F.lit(None).cast(mappings.schema["mapping_id"].dataType))
    return alive.drop("_moved").unionByName(retired.drop("_moved"))


def merge_tracks(library, merges: DataFrame) -> dict[str, DataFrame]:
    """The new tables of a library after merges (winner_id, loser_id)."""
    return {
        "tracks": library.tracks.join(merges.select(F.col("loser_id").alias("track_id")), "track_id", "left_anti"),
        "plays": repoint(library.plays, merges),
        "entries": repoint(library.entries, merges),
        "likes": merge_likes(library.likes, merges),
        "preferences": merge_preferences(library.preferences, merges),
        "metrics": merge_metrics(library.metrics, merges),
        "mappings": merge_mappings(library.mappings, merges),
    }


def assert_mappings(live: DataFrame, asserted: DataFrame) -> DataFrame:
    """action for each asserted row by (connector, connector_track_id): insert without a live row, touch for an equal decision, else supersede, which retires the incumbent."""
    decision = ("track_id", "confidence", "method", "origin")
    old = live.select("connector", "connector_track_id", F.col("mapping_id").alias("incumbent"), *[F.col(c).alias(f"_{c}") for c in decision])
    both = asserted.join(old, ["connector", "connector_track_id"], "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in decision])
    action = F.when(F.col("incumbent").isNull(), "insert").when(same, "touch").otherwise("supersede")
    return both.select("connector", "connector_track_id", *decision, "incumbent", action.alias("action"))


def rename_tag(tags: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """The new tags, and events (track_id, tag, action) of real changes only."""
    own, there = tags.where(F.col("tag") == source), tags.where(F.col("tag") == target).select("track_id")
    fresh = own.join(there, "track_id", "left_anti").withColumn("tag", F.lit(target)).select(*tags.columns)
    events = own.select("track_id", F.lit(source).alias("tag"), F.lit("remove").alias("action")).unionByName(fresh.select("track_id", "tag", F.lit("add").alias("action")))
    return tags.where(F.col("tag") != source).unionByName(fresh), events


def update_by_natural_key(ledger: DataFrame, updates: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """The ledger with payload columns from updates where all keys are equal, nulls among them."""
    u = updates.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_new_{c}") for c in payload], F.lit(True).alias("_hit"))
    both = ledger.join(u, [ledger[k].eqNullSafe(u[f"_{k}"]) for k in keys], "left")
    return both.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in payload else F.col(c) for c in ledger.columns])


def next_check(last_checked: Column, check_again: Column, as_of: dt.datetime, base_days: int = 1, most_days: int = 32) -> Column:
    """now + the last interval doubled, from base to most days."""
    from tracklight.functions.scalars import seconds_between

    last = seconds_between(check_again, last_checked) / 86_400
    days = F.coalesce(F.least(F.greatest(last * 2, F.lit(float(base_days))), F.lit(float(most_days))), F.lit(float(base_days)))
    return F.lit(as_of).cast("timestamp_ntz") + F.make_dt_interval(secs=F.round(days * 86_400).cast("decimal(18,6)"))


def record_misses(negatives: DataFrame, missed: DataFrame, as_of: dt.datetime) -> DataFrame:
    """no-match state after misses of connector_track_ids: one miss more, and a later check; new ones start with one."""
    old = negatives.where("kind = 'no_match'").select("connector_track_id", "misses", "last_checked_at", "check_again")
    both = missed.select("connector_track_id").distinct().join(old, "connector_track_id", "left")
    return both.select("connector_track_id", (F.coalesce("misses", F.lit(0)) + 1).alias("misses"), next_check(F.col("last_checked_at"), F.col("check_again"), as_of).alias("check_again"))


def ingest(incoming: DataFrame, mappings: DataFrame, tracks: DataFrame) -> DataFrame:
    """Every incoming row (position, connector, connector_track_id, title_normalized, artist_normalized, isrc) with its track and how it was found: a live mapping, the ISRC's owner, an equal name, or created. Rows of one identifier share the result."""
    from tracklight.operators.library import live

    ids = incoming.groupBy("connector", "connector_track_id").agg(F.min_by("title_normalized", "position").alias("title_normalized"), F.min_by("artist_normalized", "position").alias("artist_normalized"), F.min_by("isrc", "position").alias("isrc"))
    mapped = live(mappings).groupBy("connector", "connector_track_id").agg(F.min("track_id").alias("_mapped"))
    owner = tracks.where("isrc is not null").groupBy("isrc").agg(F.min("track_id").alias("_owner"))
    named = tracks.groupBy("title_normalized", "artist_normalized").agg(F.min("track_id").alias("_named"))
    out = ids.join(mapped, ["connector", "connector_track_id"], "left").join(owner, "isrc", "left").join(named, ["title_normalized", "artist_normalized"], "left")
    how = F.when(F.col("_mapped").isNotNull(), "mapping").when(F.col("_owner").isNotNull(), "isrc").when(F.col("_named").isNotNull(), "identity").otherwise("created")
    out = out.select("connector", "connector_track_id", F.coalesce("_mapped", "_owner", "_named").alias("track_id"), how.alias("outcome"))
    return incoming.select("position", "connector", "connector_track_id").join(out, ["connector", "connector_track_id"])
