"""The plan that brings stored plays to what a projection says, and its execution.

Stored plays have edges: which observations they were made of. In order of their start each projected play takes a stored one: one
that an edge of its members leads to, if it isn't taken yet; without any, the stored play that an earlier one of this
projection with the same identity took (claim); else a stored play without edges of the same identity, or of the one that older
rows have, stamped at the end of the listen (adopt); else it is new (insert). Whoever finds several keeps the smallest and merges
the others into it; those go, if no edge holds them any more. Who takes what in turn is decided in rounds of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.functions.scalars import micros
from tracklight.operators.contexts import canonical
from tracklight.operators.projection import MOST_SHIFT, US, refresh_aggregates
from tracklight.sources.scratch import Scope

#: What makes two plays one, and the fields that a stored play is brought up to.
IDENTITY = ("track_id", "service", "played_at", "ms_played")
COMPARED = ("track_id", "service", "played_at", "ms_played", "context", "source_services", "import_source", "import_batch_id")
ACTIONS = ("insert", "claim", "adopt", "heal", "keep", "update", "merge", "delete")


def in_turn(options: DataFrame, scope: Scope, kept: bool = False) -> DataFrame:
    """taker, turn and target: each taker in order of turn (an ordered column, different for each taker) gets its first option (by choice) that none before it got. options: taker, turn, choice, target, each target once for a taker; kept says that they are a table already.

    In a round all those get their best left option that come first among all left takers who could still have it. Nobody
    before them can get it, so a walk in order would give the same.
    """
    live, out = options.select("taker", "turn", "choice", "target"), None
    live = live if kept else scope.written(live)
    while not live.isEmpty():
        best = live.groupBy("taker").agg(F.min_by(F.struct("target", "turn"), F.struct("choice", "target")).alias("b"))
        first = live.groupBy("target").agg(F.min("turn").alias("_first"))
        got = best.select("taker", "b.target", "b.turn").join(first, "target").where(F.col("turn") == F.col("_first"))
        got = scope.written(got.select("taker", "turn", "target"))
        out = got if out is None else out.unionByName(got)
        live = scope.written(live.join(got.select("taker"), "taker", "left_anti").join(got.select("target"), "target", "left_anti"))
    return out if out is not None else live.select("taker", "turn", "target")


def _identity(side: DataFrame, at: Column | None = None) -> Column:
    return F.struct(*[(at if c == "played_at" and at is not None else F.col(c)).alias(c) for c in IDENTITY])


def plan(new: DataFrame, stored: DataFrame, edges: DataFrame, scope: Scope, new_id: Column | None = None) -> DataFrame:
    """play, play_id and action of every projected play, and of stored ones that go (play null).

    new: project's rows. stored: play_id and the compared fields. edges: observation_id and play_id. new_id gives the id
    of an inserted play from new's row, its play by default.
    """
    turn = F.struct("start_us", "play")
    own = scope.written(new.withColumn("_new_id", F.col("play") if new_id is None else new_id)).withColumn("turn", turn)
    members = own.select("play", "turn", F.explode("members").alias("observation_id"))
    links = scope.written(members.join(edges, "observation_id").select("play", "turn", "play_id").distinct())
    linked = in_turn(links.select(F.col("play").alias("taker"), "turn", F.lit(0).alias("choice"), F.col("play_id").alias("target")), scope, kept=True)
    taken = linked.select(F.col("target").alias("play_id"), F.col("turn").alias("_taken"))
    # what was still to be had when it was a play's turn
    held = links.join(taken, "play_id", "left").where(F.col("_taken").isNull() | (F.col("_taken") >= F.col("turn")))
    held = held.join(linked.select(F.col("taker").alias("play"), "target"), "play")
    counts = held.groupBy("play").agg(F.count(F.lit(1)).alias("n"), F.first("target").alias("target"))

    # dealt by the identity's fields and by play, each of which is sent once
    alike = Window.partitionBy(*IDENTITY).orderBy("start_us", "play")
    ranked = own.select("play", "start_us", *IDENTITY, "_new_id").withColumn("_before", F.first("play").over(alike))
    unlinked = scope.written(ranked.join(counts.select("play"), "play", "left_anti"))
    unlinked = unlinked.withColumns({"turn": turn, "_identity": _identity(unlinked)})
    firsts = unlinked.where(F.col("_before") == F.col("play"))
    loose = stored.join(links.select("play_id"), "play_id", "left_anti").join(edges.select("play_id"), "play_id", "left_anti")
    loose = loose.groupBy(_identity(loose).alias("_identity")).agg(F.min("play_id").alias("target"))
    end = F.timestamp_micros(micros(F.col("played_at")) + F.least(F.col("ms_played") * 1000, F.lit(MOST_SHIFT * US))).cast(new.schema["played_at"].dataType)
    asked = firsts.select("play", "turn", F.explode(F.array(F.struct(F.lit(0).alias("choice"), F.col("_identity").alias("key")), F.struct(F.lit(1).alias("choice"), F.when(F.col("ms_played") > 0, _identity(firsts, end)).alias("key")))).alias("ask")).where("ask.key is not null")
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(f"ask.key.{c}").eqNullSafe(F.col(f"_identity.{c}"))
    options = asked.join(loose, same).select(F.col("play").alias("taker"), "turn", F.col("ask.choice").alias("choice"), "target")
    adopted = in_turn(options, scope).select(F.col("taker").alias("play"), F.col("target").alias("_adopted"))
    settled = firsts.join(adopted, "play", "left").select("play", F.coalesce("_adopted", "_new_id").alias("play_id"), F.when(F.col("_adopted").isNull(), "insert").otherwise("adopt").alias("_kind"))
    settled = settled.unionByName(counts.select("play", F.col("target").alias("play_id"), F.when(F.col("n") == 1, "keep").otherwise("merge").alias("_kind")))
    settled = scope.written(settled)
    claims = unlinked.where(F.col("_before") != F.col("play")).select("play", "_before").join(settled.select(F.col("play").alias("_before"), "play_id"), "_before").select("play", "play_id", F.lit("claim").alias("_kind"))

    fields = [c for c in COMPARED if c in new.columns and c in stored.columns]
    value = lambda c: canonical(F.col(c)) if c == "context" else F.col(c)
    old = stored.select("play_id", F.struct(*[value(c).alias(c) for c in fields]).alias("_old"))
    now = own.select("play", F.struct(*[value(c).alias(c) for c in fields]).alias("_now"))
    equal = F.lit(True)
    for c in fields:
        equal = equal & F.col(f"_old.{c}").eqNullSafe(F.col(f"_now.{c}"))
    # only what is kept or adopted can be as it was
    matters = F.col("_kind").isin("keep", "adopt")
    compared = settled.where(matters).join(now, "play").join(old, "play_id", "left")
    changed = ~F.coalesce(F.col("_old").isNotNull() & equal, F.lit(False))
    action = F.when((F.col("_kind") == "keep") & changed, "update").when((F.col("_kind") == "adopt") & changed, "heal").otherwise(F.col("_kind"))
    others = settled.where(~matters).unionByName(claims).select("play", "play_id", F.col("_kind").alias("action"))
    done = scope.written(compared.select("play", "play_id", action.alias("action")).unionByName(others))
    # a candidate to go whose last edge leads elsewhere afterwards
    rest = held.where(F.col("play_id") != F.col("target")).select("play_id").distinct().join(done.select("play_id"), "play_id", "left_anti")
    outside = edges.join(members.select("observation_id"), "observation_id", "left_anti").select("play_id")
    gone = rest.join(outside, "play_id", "left_anti").select(F.lit(None).cast(own.schema["play"].dataType).alias("play"), "play_id", F.lit("delete").alias("action"))
    return scope.written(done.unionByName(gone))


def execute(steps: DataFrame, new: DataFrame, stored: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored plays and the edges after a plan's steps."""
    fields = [c for c in stored.columns if c in new.columns and c != "play_id"]
    writes = steps.where(F.col("action").isin("insert", "heal", "update", "merge")).join(new.select("play", F.struct(*fields).alias("_now")), "play").select("play_id", "_now")
    gone = steps.where("action = 'delete'").select("play_id")
    kept = stored.join(gone, "play_id", "left_anti")
    both = kept.withColumn("_stored", F.lit(True)).join(writes, "play_id", "full_outer")
    plays = both.select(*[F.when(F.col("_now").isNotNull(), F.col(f"_now.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns])
    targets = new.select("play", F.explode("members").alias("observation_id")).join(steps.where("play is not null").select("play", F.col("play_id").alias("_to")), "play").select("observation_id", "_to")
    moved = edges.join(targets, "observation_id", "full_outer").select("observation_id", F.coalesce("_to", "play_id").alias("play_id"))
    return plays, moved


def affected_aggregates(steps: DataFrame, new: DataFrame, stored: DataFrame, plays: DataFrame) -> DataFrame:
    """Play counts and first and last times of the tracks that the plan touches: those of all projected plays, and those that stored plays are moved away from. plays: the plays after it."""
    before = stored.join(steps.select("play_id").distinct(), "play_id", "left_semi").select("track_id")
    tracks = new.select("track_id").union(before).where("track_id is not null").distinct()
    return refresh_aggregates(tracks, plays.join(tracks, "track_id", "left_semi"))
