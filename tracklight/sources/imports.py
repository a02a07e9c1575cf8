"""Imports of listening history into the ledger of observations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.functions.scalars import pair_identifier, seconds_between, track_id_from_uri

from tracklight.sources.sinks import _remove, _store, _there

#: The fields of an exported record, fixed values.
EXPORT = """ts string, spotify_track_uri string, master_metadata_track_name string, master_metadata_album_artist_name string, master_metadata_album_album_name string, ms_played long,
    platform string, conn_country string, reason_start string, reason_end string, shuffle boolean, skipped boolean, offline boolean, incognito_mode boolean"""
LEDGER_KEYS = ["user_id", "connector", "track_identifier", "played_at", "ms_played"]


def export_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of exported JSON array files that name a track; broken ones are left out, absent behaviour is false or empty."""
    raw = spark.read.schema(EXPORT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    at = F.try_to_timestamp("ts")
    good = raw.where(track_id_from_uri(F.col("spotify_track_uri")).isNotNull() & F.col("master_metadata_track_name").isNotNull() & at.isNotNull() & F.col("ms_played").isNotNull())
    return good.na.fill(False, ["shuffle", "skipped", "offline", "incognito_mode"]).na.fill("", ["platform", "conn_country", "reason_start", "reason_end"]).withColumn("played_at", at.cast("timestamp_ntz"))


def export_observations(records: DataFrame, user_id, batch_id: str, now: dt.datetime) -> DataFrame:
    """Ledger rows of exported records; their stamps are ends."""
    metadata = F.to_json(F.struct(F.col("spotify_track_uri").alias("track_uri"), "platform", "reason_start", "reason_end", "shuffle", "skipped", "offline"))
    return records.select(
        F.lit(user_id).alias("user_id"), F.lit("spotify").alias("connector"), F.lit("spotify").alias("service"), F.lit("spotify_export").alias("import_source"),
        track_id_from_uri(F.col("spotify_track_uri")).alias("track_identifier"), F.col("master_metadata_album_artist_name").alias("artist_name"), F.col("master_metadata_track_name").alias("track_name"), F.col("master_metadata_album_album_name").alias("album_name"),
        "played_at", "ms_played", metadata.alias("metadata"), F.lit(batch_id).alias("import_batch_id"), F.lit(now).cast("timestamp_ntz").alias("import_timestamp"),
    )


def scrobble_observations(rows: DataFrame, user_id, batch_id: str, now: dt.datetime) -> DataFrame:
    """Ledger rows of scrobbles (artist, title, album, played_at, metadata), whose stamps are starts."""
    return rows.select(
        F.lit(user_id).alias("user_id"), F.lit("lastfm").alias("connector"), F.lit("lastfm").alias("service"), F.lit("lastfm_api").alias("import_source"),
        pair_identifier(F.col("artist"), F.col("title")).alias("track_identifier"), F.col("artist").alias("artist_name"), F.col("title").alias("track_name"), F.col("album").alias("album_name"),
        "played_at", F.lit(None).cast("long").alias("ms_played"), "metadata", F.lit(batch_id).alias("import_batch_id"), F.lit(now).cast("timestamp_ntz").alias("import_timestamp"),
    )


def new_rows(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that the ledger doesn't hold, once each; nulls in keys are equal."""
    from tracklight.sources.sinks import insert_ignore

    return insert_ignore(ledger, incoming, LEDGER_KEYS)


def date_range(requested_from: dt.datetime | None, requested_to: dt.datetime | None, checkpoint: dt.datetime | None, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """What was asked for, else from the checkpoint, else the last 30 days."""
    return requested_from or checkpoint or now - dt.timedelta(days=30), requested_to or now


def date_ranges(requests: DataFrame, now: dt.datetime, days: int = 7) -> DataFrame:
    """date_range of each row (asked_from, asked_to, checkpoint): adds since, until and how many windows they make."""
    this = F.lit(now).cast("timestamp_ntz")
    since = F.coalesce("asked_from", "checkpoint", F.lit(now - dt.timedelta(days=30)).cast("timestamp_ntz"))
    out = requests.withColumns({"since": since, "until": F.coalesce("asked_to", this)})
    return out.withColumn("windows", F.greatest(F.lit(0), F.ceil(seconds_between(F.col("until"), F.col("since")) / (days * 86_400))).cast("long"))


def windows(start: dt.datetime, end: dt.datetime, days: int = 7) -> list[tuple[dt.datetime, dt.datetime]]:
    """Consecutive windows, the oldest first."""
    out = []
    while start < end:
        out.append((start, min(end, start + dt.timedelta(days=days))))
        start = out[-1][1]
    return out


def import_windows(fetch, ledger_path: str, spark: SparkSession, start: dt.datetime, end: dt.datetime, save_checkpoint) -> int:
    """Fetches each window's observations (fetch(start, end) -> DataFrame), appends the new ones and then moves the checkpoint, so that a broken import goes on where it stopped."""
    done = 0
    for a, b in windows(start, end):
        rows = fetch(a, b)
        known = spark.read.parquet(ledger_path) if _there(spark, ledger_path) else rows.limit(0)
        new_rows(known, rows).write.mode("append").parquet(ledger_path)
        save_checkpoint(b)
        done += 1
    return done


#: Identifiers that a resolver is asked for at once.
CHUNK = 10_000


def _resolved(asked: DataFrame, resolve, path: str, chunk: int) -> DataFrame:
    """What the resolver says of the identifiers (connector, track_identifier), a table of their chunks; chunks that are there from an earlier try aren't asked again."""
    spark = asked.sparkSession
    if not _there(spark, f"{path}/asked/_SUCCESS"):
        asked.write.mode("overwrite").parquet(f"{path}/asked")
    asked = spark.read.schema(asked.schema).parquet(f"{path}/asked")
    n = max(1, -(-asked.count() // chunk))
    for k in range(n):
        if not _there(spark, f"{path}/known/chunk={k}/_SUCCESS"):
            own = asked.where(F.pmod(F.xxhash64("connector", "track_identifier"), F.lit(n)) == k)
            resolve(own).select("connector", "track_identifier", "resolved_track_id").where("resolved_track_id is not null").write.mode("overwrite").parquet(f"{path}/known/chunk={k}")
    found = spark.read.parquet(*[f"{path}/known/chunk={k}" for k in range(n)])
    return found.groupBy("connector", "track_identifier").agg(F.min("resolved_track_id").alias("resolved_track_id"))


def open_rows(spark: SparkSession, ledger: str, before: int, like: DataFrame) -> DataFrame:
    """The rows that are unresolved after the imports before this one, the newest state of each."""
    p, store = _store(spark, f"{ledger}-unresolved")
    numbers = [int(n.removeprefix("batch=")) for n in (x.getPath().getName() for x in store.listStatus(p)) if n.startswith("batch=")] if store.exists(p) else []
    whole = [k for k in sorted(numbers) if k < before and _there(spark, f"{ledger}-unresolved/batch={k}/_SUCCESS")]
    return spark.read.schema(like.schema).parquet(f"{ledger}-unresolved/batch={whole[-1]}") if whole else like.limit(0)


def two_phase(observations: DataFrame, resolve, ledger: str, plays: str, batch_id: int, chunk: int = CHUNK) -> dict[str, int]:
    """Ingests observations into the ledger, resolves their tracks and projects the days that they touch.

    resolve(DataFrame of connector and track_identifier) gives resolved_track_id for those it knows. Each different identifier
    of the new rows and of those that earlier imports left open is asked for once, a chunk at a time; a chunk's answers are
    written before the next is asked, so an import that broke off goes on after the last one, and asks nothing twice. What is known
    now becomes part of the ledger and of plays, late rows too; what isn't is kept for the next import and is no play. An import
    that runs again gives the same tables. Gives how many rows came, were resolved (with late ones) and are unresolved.
    """
    from tracklight.streaming.projection import apply_batch

    spark = observations.sparkSession
    state = f"{ledger}-resolutions/batch={batch_id}"
    waiting = open_rows(spark, ledger, batch_id, observations)
    rows = observations.unionByName(waiting.join(observations.select("id"), "id", "left_anti"))
    known = _resolved(rows.select("connector", "track_identifier").distinct(), resolve, state, chunk)
    asked = rows.drop("resolved_track_id").join(known, ["connector", "track_identifier"], "left").select(*observations.columns)
    asked.write.mode("overwrite").parquet(f"{state}/rows")
    asked = spark.read.schema(observations.schema).parquet(f"{state}/rows")
    apply_batch(asked.where("resolved_track_id is not null"), ledger, plays, batch_id)
    asked.where("resolved_track_id is null").write.mode("overwrite").parquet(f"{ledger}-unresolved/batch={batch_id}")
    for k in range(batch_id):
        _remove(spark, f"{ledger}-resolutions/batch={k}")  # a later import has begun, so an earlier one won't run again
    counts = asked.agg(F.count(F.lit(1)).alias("n"), F.count("resolved_track_id").alias("known")).first()
    return {"observations": observations.count(), "resolved": counts.known, "unresolved": counts.n - counts.known}
