"""Destinations of ordered lists, and keyed writes. Tables are parquet folders; a playlist's folder has versions, the newest whole one of which counts."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklight.plans.ordered import Key, TrackList
from tracklight.sources.scratch import folder


class EmptyOverwriteError(ValueError):
    """An overwrite with no rows would empty a playlist."""


def render(template: str, track_count: int, now: dt.datetime) -> str:
    """{track_count}, {date}, {time} and {datetime} in a name or description."""
    values = {"track_count": track_count, "date": f"{now:%Y-%m-%d}", "time": f"{now:%H:%M}", "datetime": f"{now:%Y-%m-%d %H:%M}"}
    for name, value in values.items():
        template = template.replace("{" + name + "}", str(value))
    return template


def rendered(template: Column, track_count: Column, now: dt.datetime) -> Column:
    """render of templates in a column."""
    for name, value in {"track_count": track_count.cast("string"), "date": F.lit(f"{now:%Y-%m-%d}"), "time": F.lit(f"{now:%H:%M}"), "datetime": F.lit(f"{now:%Y-%m-%d %H:%M}")}.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def appendable(current: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose track isn't in the current entries; unresolved ones always."""
    known = current.where("track_id is not null").select("track_id").distinct()
    return candidates.join(known, "track_id", "left_anti")


def reconcile(current: DataFrame, new: DataFrame) -> DataFrame:
    """New entries with the added_at that the last current entry of their track has."""
    kept = current.where("track_id is not null").groupBy("track_id").agg(F.max_by("added_at", "position").alias("_kept"))
    return new.join(kept, "track_id", "left").withColumn("added_at", F.coalesce("_kept", "added_at")).drop("_kept")


def membership(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Adds member, t:track or c:connector:id, and turn, the occurrence of it from 1 in order of position."""
    key = F.when(F.col("track_id").isNotNull(), F.concat(F.lit("t:"), F.col("track_id"))).otherwise(F.concat_ws(":", F.lit("c"), *(extra or [])))
    return df.withColumn("member", key).withColumn("turn", F.row_number().over(Window.partitionBy("playlist_id", "member").orderBy("position")))


def rewrite_entries(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Each old and new entry with its action: keep (matched by record id, else in turn by member; new position, old added_at), delete or create.

    Both have playlist_id, position, track_id, added_at and record_id (null for new entries without one).
    """
    by_id = new.where("record_id is not null").select("record_id", "playlist_id", F.col("position").alias("new_position"))
    old = existing.join(by_id, ["playlist_id", "record_id"], "left")
    sure = old.where("new_position is not null").select("playlist_id", "record_id", "track_id", "added_at", "new_position", F.lit("keep").alias("action"))
    old_rest = membership(old.where("new_position is null").drop("new_position"))
    taken = existing.select("playlist_id", "record_id").distinct()
    new_rest = membership(new.join(taken, ["playlist_id", "record_id"], "left_anti")).select("playlist_id", "member", "turn", F.col("position").alias("new_position"), F.col("track_id").alias("_track"), F.col("added_at").alias("_added"))
    both = old_rest.join(new_rest, ["playlist_id", "member", "turn"], "full_outer")
    action = F.when(F.col("record_id").isNull(), "create").when(F.col("new_position").isNull(), "delete").otherwise("keep")
    rest = both.select("playlist_id", "record_id", F.coalesce("track_id", "_track").alias("track_id"), F.coalesce("added_at", "_added").alias("added_at"), "new_position", action.alias("action"))
    return sure.unionByName(rest)


def first_of_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the same whatever the order of the rows."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    own, all_of = Window.partitionBy(*keys), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    # rows are dealt as they are; the text is made after that, and only where a key has several
    many = rows.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_text", F.when(F.col("_n") > 1, all_of))
    return many.withColumn("_n", F.row_number().over(own.orderBy("_text"))).where("_n = 1").select(*rows.columns)


def insert_ignore(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, each key once, that the table doesn't hold; nulls in keys are equal. Of several rows of a key the one stays whose other columns come first as text."""
    own = first_of_key(rows, keys)
    match = [own[k].eqNullSafe(existing[k]) for k in keys]
    return own.join(existing, match, "left_anti")


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str], update_where: Column | None = None) -> DataFrame:
    """The whole new table: new keys are added, known ones replaced (where the old row `o` and the new `n` meet update_where). Of several new rows of a key the one counts whose other columns come first as text."""
    match = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    new = first_of_key(rows, keys).withColumn("_new", F.lit(1)).alias("n")
    both = existing.withColumn("_old", F.lit(1)).alias("o").join(new, match, "full_outer")
    there = F.col("_old").isNotNull()
    take = F.col("_new").isNotNull() & (~there | (F.lit(True) if update_where is None else F.coalesce(update_where, F.lit(False))))
    return both.select(*[F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in existing.columns])


def staged_insert(spark: SparkSession, table: str, rows: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Appends to a table (a folder) the rows whose keys it doesn't hold, and gives how many were streamed and how many inserted. Rows are staged first, so that they are computed once, and the table is only read against them."""
    staging = folder(spark)
    rows.write.parquet(f"{staging}/rows")
    staged = spark.read.schema(rows.schema).parquet(f"{staging}/rows")
    there = _there(spark, table)
    new = insert_ignore(spark.read.schema(rows.schema).parquet(table) if there else staged.limit(0), staged, keys)
    new.write.parquet(f"{staging}/new")
    fresh = spark.read.schema(rows.schema).parquet(f"{staging}/new")
    counts = staged.count(), fresh.count()
    fresh.write.mode("append").parquet(table)
    _remove(spark, staging)
    return counts


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    p, store = _store(spark, path)
    return store.exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    p, store = _store(spark, path)
    store.delete(p, True)


class PlaylistStore:
    """Playlists in a folder: one partition of entries for each."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _versions(self, playlist_id: str) -> list[int]:
        """Numbers of the versions that were written to their end."""
        p, store = _store(self.spark, f"{self.folder}/playlist_id={playlist_id}")
        if not store.exists(p):
            return []
        names = [x.getPath().getName() for x in store.listStatus(p)]
        whole = [n for n in names if n.startswith("v") and store.exists(_store(self.spark, f"{self.folder}/playlist_id={playlist_id}/{n}/_SUCCESS")[0])]
        return sorted(int(n[1:]) for n in whole)

    def entries(self, playlist_id: str) -> DataFrame:
        """The newest version's rows."""
        found = self._versions(playlist_id)
        if not found:
            raise ValueError(f"no such playlist: {playlist_id}")
        return self.spark.read.parquet(f"{self.folder}/playlist_id={playlist_id}/v{found[-1]}")

    def _write(self, playlist_id: str, rows: DataFrame) -> None:
        """A new version beside the old one, which counts once it is written whole; the one before stays, those before that go."""
        known = self._versions(playlist_id)
        number = known[-1] + 1 if known else 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/playlist_id={playlist_id}/v{number}")
        for old in known[:-1]:
            _remove(self.spark, f"{self.folder}/playlist_id={playlist_id}/v{old}")

    def create(self, tracks: TrackList, name: str, now: dt.datetime, description: str = "", dry_run: bool = False) -> dict:
        """A new playlist of the list's rows."""
        if not name:
            raise ValueError("a playlist needs a name")
        rows = tracks.result("track_id").withColumn("added_at", F.lit(now).cast("timestamp_ntz"))
        count = rows.count()
        playlist_id = uuid.uuid4().hex
        if not dry_run:
            self._write(playlist_id, rows)
        return {"playlist_id": playlist_id, "name": render(name, count, now), "description": render(description, count, now), "track_count": count, "dry_run": dry_run}

    def update(self, playlist_id: str, tracks: TrackList, now: dt.datetime, append: bool = False, dry_run: bool = False) -> dict:
        """Overwrites, keeping what is known of tracks that stay, or appends those that aren't there."""
        current = self.entries(playlist_id)
        new = tracks.result("track_id").withColumn("added_at", F.lit(now).cast("timestamp_ntz"))
        if append:
            rows = current.withColumn("_part", F.lit(0)).unionByName(appendable(current, new).withColumn("_part", F.lit(1)))
            rows = TrackList.source(rows.withColumnRenamed("position", "_c0"), Key("_part"), Key("_c0")).numbered("position").df.drop("_part")
        else:
            if new.isEmpty():
                raise EmptyOverwriteError(playlist_id)
            rows = reconcile(current, new)
        count = rows.count()
        if not dry_run:
            self._write(playlist_id, rows.select("position", "track_id", "added_at"))
        return {"playlist_id": playlist_id, "track_count": count, "dry_run": dry_run}

