"""The play projection as a stream: new observations arrive as files; each micro-batch recomputes the days that it can touch.

Late data may be of any age, so there is no watermark: a batch names its days, and plays anchored in them are projected
anew from the ledger and take the place of those that were anchored there. Plays are partitioned by the day of their anchor
(their earliest start), the same day by which they are projected, so that a batch never touches a play of another day. The
ledger is partitioned by the day of the stamp, so that a batch reads the days around its own and no others. A batch that runs
twice gives the same tables.

A batch writes its days as a new version beside the old ones, and a manifest that says which version of each day counts;
renaming that file into place is the commit. So a reader sees the plays before a batch or after it, whole, and a batch that
breaks off leaves what was there. Versions that neither this manifest nor the one before names are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracklight.operators.projection import REACH, affected_days, project, project_days
from tracklight.sources.scratch import Scope
from tracklight.sources.sinks import first_of_key


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table's rows, or none where it isn't there yet."""
    p, store = _path(spark, path)
    return spark.read.schema(like.schema).parquet(path) if store.exists(p) else like.limit(0)


def with_day(plays: DataFrame) -> DataFrame:
    """The plays as they are stored: day is that of the anchor."""
    return plays.withColumn("day", F.to_date(F.timestamp_micros("anchor_us")))


def touched_days(stamps: DataFrame) -> DataFrame:
    """The days in which a play can be anchored that these observations (played_at) join, or take members from."""
    later = stamps.select((F.col("played_at") + F.expr(f"interval {int(REACH.total_seconds())} seconds")).alias("played_at"))
    return affected_days(stamps.select("played_at")).union(affected_days(later)).distinct()


def _manifests(spark: SparkSession, plays: str) -> list[int]:
    """The numbers of the manifests that were put in place."""
    p, store = _path(spark, f"{plays}/manifests")
    names = [x.getPath().getName() for x in store.listStatus(p)] if store.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, plays: str, number: int) -> dict[str, int]:
    """The version of each day."""
    rows = spark.read.text(f"{plays}/manifests/{number}").collect()  # a line for each day of history
    return {day: int(version) for day, version in (r.value.split() for r in rows)}


def _commit(spark: SparkSession, plays: str, number: int, days: dict[str, int]) -> None:
    p, store = _path(spark, f"{plays}/manifests/_new-{number}")
    out = store.create(p, True)
    out.write(bytearray("".join(f"{d} {v}\n" for d, v in sorted(days.items())).encode()))
    out.close()
    if not store.rename(p, _path(spark, f"{plays}/manifests/{number}")[0]):
        raise RuntimeError(f"another batch has committed version {number} of {plays}")


def _put(new: DataFrame, plays: str, replaced: list[str] | None) -> None:
    """Makes the plays (with day) the ones of their days; replaced names the days whose earlier plays go, all of them by default."""
    spark, known = new.sparkSession, _manifests(new.sparkSession, plays)
    number = known[-1] + 1 if known else 1
    new.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{plays}/data/version={number}")
    p, store = _path(spark, f"{plays}/data/version={number}")
    written = {n.removeprefix("day=") for n in (x.getPath().getName() for x in store.listStatus(p)) if n.startswith("day=")}
    before = _manifest(spark, plays, known[-1]) if known else {}
    days = {d: v for d, v in before.items() if replaced is not None and d not in replaced} | dict.fromkeys(written, number)
    _commit(spark, plays, number, days)
    kept = {(d, v) for m in (days, before) for d, v in m.items()}
    for d, v in {x for m in known[:-1] for x in _manifest(spark, plays, m).items()} - kept:
        store.delete(_path(spark, f"{plays}/data/version={v}/day={d}")[0], True)
    for m in known[:-1]:
        store.delete(_path(spark, f"{plays}/manifests/{m}")[0], True)


def read_plays(spark: SparkSession, plays: str) -> DataFrame:
    """The plays that the newest manifest names; none, without columns, before the first one."""
    known = _manifests(spark, plays)
    days = _manifest(spark, plays, known[-1]) if known else {}
    if not days:
        return spark.createDataFrame([], "day date")
    current = spark.createDataFrame(list(days.items()), "day string, version int").select(F.to_date("day").alias("day"), "version")
    return spark.read.option("basePath", f"{plays}/data").parquet(*[f"{plays}/data/version={v}" for v in sorted(set(days.values()))]).join(F.broadcast(current), ["day", "version"], "left_semi").drop("version")


def _fresh(rows: DataFrame, known: DataFrame, scope: Scope) -> DataFrame:
    """The rows, each id once, that aren't known for their batch's days. Only ids are dealt, and whole rows of those alone that come again."""
    own = rows.select("day").distinct()
    there = known.join(own, "day", "left_semi").where("id is not null").select("id", F.lit(1).alias("there"))
    ids = rows.select("id", F.lit(0).alias("there")).unionByName(there)
    again = scope.written(ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("there").alias("there")).where("n > 1").select(F.col("id").alias("of"), "there"))
    named = F.col("id").eqNullSafe(F.col("of"))
    several = first_of_key(rows.join(again.where("there = 0"), named, "left_semi"), ["id"])
    return rows.join(again, named, "left_anti").unionByName(several)


def apply_batch(batch: DataFrame, ledger: str, plays: str, batch_id: int = 0) -> None:
    """Appends the batch's new observations to the ledger (by day and batch, so that a repeated batch replaces itself) and puts the days of plays that it touches. Its own tables are removed."""
    spark, scope = batch.sparkSession, Scope(batch.sparkSession)
    try:
        stamped = batch.withColumn("day", F.to_date("played_at")).withColumn("batch", F.lit(batch_id))
        known = _read(spark, ledger, stamped).where(F.col("batch") != batch_id)
        fresh = _fresh(stamped, known, scope)
        fresh.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(ledger)
        everything = spark.read.schema(stamped.schema).parquet(ledger)
        days = scope.written(touched_days(everything.where(F.col("batch") == batch_id)))
        # the days on either side too, as in project_days; here they prune the ledger's folders
        near = days.select(F.explode(F.array(F.date_sub("day", 1), F.col("day"), F.date_add("day", 1))).alias("day")).distinct()
        observations = everything.join(F.broadcast(near), "day", "left_semi").select(*batch.columns)  # a row for each day
        _put(with_day(project_days(observations, days, scope)), plays, [str(r.day) for r in days.collect()])
    finally:
        scope.drop()


def start(spark: SparkSession, incoming: str, schema, ledger: str, plays: str, checkpoint: str) -> StreamingQuery:
    """Follows a folder of parquet files of observations until it has taken all that is there."""
    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(lambda df, k: apply_batch(df, ledger, plays, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebuild(observations: DataFrame, plays: str) -> None:
    """The whole history, by day, in place of what is there."""
    scope = Scope(observations.sparkSession)
    try:
        _put(with_day(project(observations, scope)), plays, None)
    finally:
        scope.drop()
