"""Differences of ordered lists: what to remove, add and move, for many playlists at once.

Lists are rows (playlist_id, position, track_id), positions from 0. The k-th occurrence of a track meets the k-th in the
other list by an outer join. Pairs of slots, their counts and the sync plan deal both lists' rows once, by playlist, and
find partners by windows and aggregates there; only the longest increasing run needs a playlist's matched positions in one place.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.operators.grouped import per_group, shuffle_partitions


def occurrences(rows: DataFrame, by: str = "turn") -> DataFrame:
    return rows.withColumn(by, F.row_number().over(Window.partitionBy("playlist_id", "track_id").orderBy("position")))


def matched(current: DataFrame, target: DataFrame) -> DataFrame:
    """playlist_id, track_id, turn, current_position and target_position; null where a side lacks that occurrence."""
    a = occurrences(current).select("playlist_id", "track_id", "turn", F.col("position").alias("current_position"))
    b = occurrences(target).select("playlist_id", "track_id", "turn", F.col("position").alias("target_position"))
    return a.join(b, ["playlist_id", "track_id", "turn"], "full_outer")


def _surplus(current: DataFrame, target: DataFrame, compat: bool) -> DataFrame:
    """The positions of current without a partner; compat names as many, but the first ones of the track."""
    found = matched(current, target).where("target_position is null and current_position is not null")
    if not compat:
        return found.select("playlist_id", "track_id", F.col("current_position").alias("position"))
    many = found.groupBy("playlist_id", "track_id").agg(F.count(F.lit(1)).alias("_n"))
    return occurrences(current).join(many, ["playlist_id", "track_id"]).where("turn <= _n").select("playlist_id", "track_id", "position")


def removals(current: DataFrame, target: DataFrame, compat: bool = False) -> DataFrame:
    return _surplus(current, target, compat)


def additions(current: DataFrame, target: DataFrame, compat: bool = False) -> DataFrame:
    return _surplus(target, current, compat)


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        j = bisect_left(tails, v)
        if j == len(tails):
            tails.append(v)
            at.append(k)
        else:
            tails[j], at[j] = v, k
        before[k] = at[j - 1] if j else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def both_sides(current: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of both lists, with whether they are current's, dealt once by playlist and to more tasks the more rows there are, which are counted for that."""
    n = shuffle_partitions(current.sparkSession, current.count() + target.count())
    side = lambda rows, own: rows.select("playlist_id", "track_id", "position", F.lit(own).alias("current"))
    return side(current, True).unionByName(side(target, False)).repartition(n, "playlist_id")


def aligned(current: DataFrame, target: DataFrame) -> DataFrame:
    """pairing's rows, and one for each slot of either list without a partner, whose other position is null.

    Rows of a track are numbered, in the order of their positions, apart for each side and for those that match directly; rows of
    equal numbers are partners. All of it happens where both_sides has dealt a playlist's rows.
    """
    track = ["playlist_id", "track_id"]
    here = Window.partitionBy(*track, "position")
    turn = Window.partitionBy(*track).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    direct = F.col("track_id").isNotNull() & (F.min("current").over(here) != F.max("current").over(here))
    rows = both_sides(current, target).withColumn("direct", direct)
    rest = lambda own: F.count_if(~F.col("direct") & (F.col("current") == own)).over(turn)
    rows = rows.withColumn("_turn", F.when(F.col("direct"), F.col("position")).when(F.col("current"), rest(True)).otherwise(rest(False)))
    # slots without a track have no partners
    rows = rows.withColumn("_alone", F.when(F.col("track_id").isNull(), F.col("current")))
    at = lambda own: F.max(F.when(F.col("current") == own, F.col("position")))
    found = rows.groupBy(*track, "direct", "_turn", "_alone").agg(at(True).alias("current_position"), at(False).alias("target_position"))
    return found.select(*track, "current_position", "target_position", "direct")


def pairing(current: DataFrame, target: DataFrame) -> DataFrame:
    """Which current slot fills each target slot: the same slot where it holds the same track, the rest in turn; direct says which."""
    return aligned(current, target).where("current_position is not null and target_position is not null")


def out_of_order(pairs: DataFrame) -> DataFrame:
    """The pairs of lists of which some pair comes before its predecessor: only these have to be looked at as a whole."""
    w = Window.partitionBy("playlist_id").orderBy("first", "target_position")
    marked = pairs.withColumn("_falls", F.coalesce(F.col("current_position") < F.lag("current_position").over(w), F.lit(False)))
    return marked.withColumn("_any", F.bool_or("_falls").over(Window.partitionBy("playlist_id"))).where("_any").drop("_falls", "_any")


def _moved(pairs: DataFrame, compat: bool) -> DataFrame:
    """playlist_id, old_position and position of those of pairing's rows that moves names."""

    def outside(rows: list) -> list[tuple]:
        keep = set(longest_increasing([r.current_position for r in rows]))
        return [(r.playlist_id, r.current_position, r.target_position) for k, r in enumerate(rows) if k not in keep]

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = f"playlist_id {kinds['playlist_id']}, old_position {kinds['current_position']}, position {kinds['target_position']}"
    found = pairs.withColumn("first", F.when(F.col("direct") & F.lit(compat), 0).otherwise(1)).select("playlist_id", "first", "target_position", "current_position")
    return per_group(out_of_order(found), ["playlist_id"], ["first", "target_position"], outside, schema)


def moves(current: DataFrame, target: DataFrame, compat: bool = False) -> DataFrame:
    """playlist_id, track_id, old_position and position of the slots outside a longest run that keeps its order. The run is looked for in the target's order, which gives the fewest moves; compat puts slots that match directly first.

    A list whose order is changed is held whole by one task, as two integers for each of its slots.
    """
    found = _moved(pairing(current, target), compat)
    named = target.select("playlist_id", "position", "track_id")
    return found.join(named, ["playlist_id", "position"]).select("playlist_id", "track_id", "old_position", "position")


def longest_runs(current: DataFrame, target: DataFrame) -> DataFrame:
    """playlist_id, run (the length of a longest run of slots that keep their order) and slots, of lists that have slots in common."""
    pairs = pairing(current, target)
    gone = _moved(pairs, False).groupBy("playlist_id").agg(F.count(F.lit(1)).alias("moves"))
    all_of = pairs.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("slots")).join(gone, "playlist_id", "left")
    return all_of.select("playlist_id", (F.col("slots") - F.coalesce("moves", F.lit(0))).alias("run"), "slots")


def step_of() -> Column:
    """The order of the kinds of operations: removals, additions, moves."""
    return F.when(F.col("operation") == "remove", 0).when(F.col("operation") == "add", 1).otherwise(2)


def operations(current: DataFrame, target: DataFrame, compat: bool = False) -> DataFrame:
    """playlist_id, operation (remove, add, move), track_id, position, old_position and step, the order of the kinds."""
    r = removals(current, target, compat).select("playlist_id", F.lit("remove").alias("operation"), "track_id", "position", F.col("position").alias("old_position"))
    a = additions(current, target, compat).select("playlist_id", F.lit("add").alias("operation"), "track_id", "position", F.lit(None).cast("int").alias("old_position"))
    m = moves(current, target, compat).select("playlist_id", F.lit("move").alias("operation"), "track_id", "position", "old_position")
    return r.unionByName(a).unionByName(m).withColumn("step", step_of())


def shifted(ops: DataFrame) -> DataFrame:
    """The operations with the positions of moves less the removals below either end; moves that would end below 0 are left out.

    Removals are counted by running sums over a list's slots, not held against each move.
    """
    kind = F.col("operation")
    rows = ops.withColumn("_id", F.struct("operation", "track_id", "position", "old_position"))
    marks = ops.where(kind == "remove").select("playlist_id", F.col("old_position").alias("at"), F.lit(1).alias("gone"), F.lit(None).cast(rows.schema["_id"].dataType).alias("_id"), F.lit(None).cast("string").alias("end"))
    ends = [rows.where(kind == "move").select("playlist_id", F.col(c).alias("at"), F.lit(0).alias("gone"), "_id", F.lit(c).alias("end")) for c in ("old_position", "position")]
    below = Window.partitionBy("playlist_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    counted = marks.unionByName(ends[0]).unionByName(ends[1]).withColumn("below", F.coalesce(F.sum("gone").over(below), F.lit(0))).where("end is not null")
    sums = counted.groupBy("playlist_id", "_id").agg(*[F.max(F.when(F.col("end") == c, F.col("below"))).alias(f"below_{c}") for c in ("old_position", "position")])
    moved = rows.where(kind == "move").join(sums, ["playlist_id", "_id"])
    for c in ("old_position", "position"):
        moved = moved.withColumn(c, (F.col(c) - F.col(f"below_{c}")).cast(ops.schema[c].dataType))
    return ops.where(kind != "move").unionByName(moved.where("old_position >= 0 and position >= 0").select(*ops.columns))


def executable(ops: DataFrame) -> DataFrame:
    """Operations in the order to run them, `sequence` from 1: removals from the highest slot down, additions, then moves, shifted by the removals below either end and from the highest slot down. Moves that would end below 0 are left out."""
    out = shifted(ops)
    down = F.when(F.col("operation") == "add", F.col("position")).otherwise(-F.col("old_position"))
    w = Window.partitionBy("playlist_id").orderBy("step", down, "position", "track_id")
    return out.select("playlist_id", F.row_number().over(w).alias("sequence"), "operation", "track_id", "position", "old_position")


def confidence(current: DataFrame, target: DataFrame, compat: bool = False) -> DataFrame:
    """playlist_id, matched, operations and their share, 1 for two empty lists."""
    slots = aligned(current, target)
    paired = F.col("current_position").isNotNull() & F.col("target_position").isNotNull()
    # removals and additions are those without a partner: as many as when direct matches don't go first; compat names none without a track
    others = ~paired & (F.col("track_id").isNotNull() | F.lit(not compat))
    sums = slots.groupBy("playlist_id").agg(F.count_if(paired).alias("matched"), F.count_if(others).alias("_others"))
    gone = _moved(slots.where(paired), compat).groupBy("playlist_id").agg(F.count(F.lit(1)).alias("_moves"))
    out = sums.join(gone, "playlist_id", "left").select("playlist_id", "matched", (F.col("_others") + F.coalesce("_moves", F.lit(0))).alias("operations"))
    all = F.col("matched") + F.col("operations")
    return out.withColumn("confidence", F.when(all == 0, 1.0).otherwise(F.col("matched") / all))


def flagged(removed: Column, total: Column) -> Column:
    """A sync that needs a confirmation: it empties the list, or removes more than half of it and more than 10 rows."""
    return F.when(total == 0, False).when(removed >= total, True).otherwise((removed / total > 0.5) & (removed > 10))


def sync_plan(current: DataFrame, target: DataFrame) -> DataFrame:
    """playlist_id, to_add, to_remove, unchanged, is_noop and flagged, by differences of multisets: of tracks, and for is_noop of tracks at their positions."""
    own = lambda c: F.count_if(F.col("current") == c)
    slots = both_sides(current, target).groupBy("playlist_id", "track_id", "position").agg(own(True).alias("a"), own(False).alias("b"))
    tracks = slots.groupBy("playlist_id", "track_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.bool_and(F.col("a") == F.col("b")).alias("same"))
    a, b = F.col("a"), F.col("b")
    sums = tracks.groupBy("playlist_id").agg(F.sum(F.greatest(b - a, F.lit(0))).alias("to_add"), F.sum(F.greatest(a - b, F.lit(0))).alias("to_remove"), F.sum(F.least("a", "b")).alias("unchanged"), F.sum("a").alias("_total"), F.bool_and("same").alias("is_noop"))
    return sums.select("playlist_id", "to_add", "to_remove", "unchanged", "is_noop", flagged(F.col("to_remove"), F.col("_total")).alias("flagged"))


def reorder(current: DataFrame, target: DataFrame) -> DataFrame:
    """The target's order, with the current rows (their position as from_position) that fill it."""
    return matched(current, target).where("target_position is not null").select("playlist_id", F.col("target_position").alias("position"), "track_id", F.col("current_position").alias("from_position"))
