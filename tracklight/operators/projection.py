"""The play projection: observations of several channels become one history of plays.

Within a channel, repeated writes of one play collapse and the segments of an interrupted listen join. An aggregate joins rows
of one stamp; windows by (user, channel, track) mark stamps that are near another one and rows that go on with the one before; only rows a moment
apart, and chains of segments longer than a listen may be, go through an Arrow function, each such run by itself. Across channels, observations of
one track (or of equal normal names) that start close together become one play, nearest pairs first and one observation of a
channel in each play: a join by bins of time finds the pairs, and rounds of joins take all that are nearest at both sides. Fields
of a play are then picked from its members by aggregates. The result depends on the set of observations alone.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.functions.scalars import micros
from tracklight.functions.text import normalize
from tracklight.operators.contexts import nested, with_context
from tracklight.operators.grouped import per_group
from tracklight.sources.scratch import Scope


@dataclass(frozen=True)
class Channel:
    """priority: the lowest gives a play its identity; quality: the highest gives its time; completed: what a finished play's reason_end says."""

    name: str
    service: str
    import_source: str
    priority: int
    stamps_end: bool
    quality: int
    completed: str | None = None


#: Fixed values of the channels.
CHANNELS = (
    Channel("spotify_export", "spotify", "spotify_export", 0, True, 2, "trackdone"),
    Channel("spotify_api", "spotify", "spotify_api", 1, True, 1),
    Channel("manual", "own", "manual", 2, False, 2),
    Channel("lastfm", "lastfm", "lastfm_api", 3, False, 3),
)
#: Fixed values in seconds.
TOLERANCE, WIDE_TOLERANCE, MOST_SHIFT, JITTER, ISLAND_GAP, ISLAND_SPAN = 30, 180, 6 * 3600, 3, 30, 3600
#: An anchor lies at most so far before a stamp of its group.
REACH = dt.timedelta(seconds=MOST_SHIFT + ISLAND_SPAN + 9 * 60)
US = 1_000_000


def _of_channel(field: str, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for c in CHANNELS:
        out = F.when((F.col("service") == c.service) & (F.col("import_source") == c.import_source), F.lit(getattr(c, field)).cast(kind)).otherwise(out)
    return out


def bridge_key(artist: Column, title: Column) -> Column:
    """What two services' names of one track have in common."""
    return F.concat_ws("::", normalize(artist), normalize(title))


def pair_tolerance(a: Column, b: Column) -> Column:
    """Seconds that two observations of one play may start apart: few if both starts are known (normalizable), else more."""
    return F.when(a & b, F.lit(TOLERANCE)).otherwise(F.lit(WIDE_TOLERANCE))


def one_observation(delta_us: Column, a_ms: Column, b_ms: Column) -> Column:
    """Whether two rows of a channel and track, the second delta_us after the first, are writes of one play: the same instant, or the same known time listened a moment apart."""
    known = F.coalesce((a_ms > 0) & (a_ms == b_ms), F.lit(False))
    return (delta_us == 0) | known & (delta_us <= F.least(F.lit(JITTER * US), a_ms * 1000))


def duplicate_pairs(observations: DataFrame) -> DataFrame:
    """a_id and b_id of with_start's rows that are writes of one play, the earlier first."""
    from tracklight.operators.joins import range_join

    side = lambda s: observations.select(F.col("id").alias(f"{s}_id"), "user_id", "channel", "track_identifier", F.col("played_at").alias(f"{s}_at"), F.col("at_us").alias(f"{s}_us"), F.col("ms_played").alias(f"{s}_ms"))
    found = range_join(side("a"), side("b"), ["user_id", "channel", "track_identifier"], "a_at", "b_at", 0, JITTER)
    delta = F.col("b_us") - F.col("a_us")
    return found.where((delta > 0) | (F.col("a_id") < F.col("b_id"))).where(one_observation(delta, F.col("a_ms"), F.col("b_ms"))).select("a_id", "b_id")


def with_channel(observations: DataFrame, strict: bool = True) -> DataFrame:
    """Adds channel, priority, stamps_end, quality and completed; an unknown channel is an error when run, or null."""
    channel = _of_channel("name", "string")
    if strict:
        channel = F.coalesce(channel, F.raise_error(F.concat(F.lit("unknown channel "), F.coalesce("service", F.lit("")), F.lit("/"), F.coalesce("import_source", F.lit("")))).cast("string"))
    return observations.withColumns({"channel": channel, "priority": _of_channel("priority", "int"), "stamps_end": _of_channel("stamps_end", "boolean"), "quality": _of_channel("quality", "int"), "completed": _of_channel("completed", "string")})


def start_shift_us() -> Column:
    """How far a stamp lies after its play's start: 0 for start stamps, else the time listened or what the importer derived, capped; null if neither is known."""
    derived = F.get_json_object("metadata", "$.start_shift_ms").try_cast("long")
    ms = F.coalesce(F.when(F.col("ms_played") > 0, F.col("ms_played")), F.when(derived > 0, derived))
    return F.when(~F.col("stamps_end"), F.lit(0).cast("long")).when(ms.isNotNull(), F.least(ms * 1000, F.lit(MOST_SHIFT * US)))


def with_start(observations: DataFrame) -> DataFrame:
    """Adds at_us (the stamp), start_us, end_us, normalizable and finished (null where the channel doesn't say)."""
    shift = start_shift_us()
    reason = F.get_json_object("metadata", "$.reason_end")
    out = observations.withColumns({"at_us": micros(F.col("played_at")), "normalizable": shift.isNotNull(), "_shift": F.coalesce(shift, F.lit(0).cast("long"))})
    finished = F.when(F.col("completed").isNotNull() & (reason != ""), reason == F.col("completed"))
    return out.withColumns({"start_us": F.col("at_us") - F.col("_shift"), "finished": finished}).withColumn("end_us", F.col("start_us") + F.coalesce("ms_played", F.lit(0)) * 1000).drop("_shift")


#: What an observation brings to the merge within its channel.
SEGMENT = ("id", "at_us", "start_us", "end_us", "ms", "finished", "stamps_end")
CHANNEL_KEYS = ("user_id", "channel_key", "track_identifier")


def _twins(rows: list) -> list[tuple]:
    """(id, kept) for rows no two of which in a row are further apart than JITTER: writes of one play are named by the one that is kept."""
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # rows of one stamp, and of one time listened, are linked one after the other: what links two of them links those between
    of_ms: dict[int, int] = {}
    for i, b in enumerate(rows):
        links = [i - 1] if i and rows[i - 1].at_us == b.at_us else []
        if b.ms and b.ms > 0:
            if b.ms in of_ms and b.at_us - rows[of_ms[b.ms]].at_us <= min(JITTER * US, b.ms * 1000):
                links.append(of_ms[b.ms])
            of_ms[b.ms] = i
        for j in links:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    best: dict[int, object] = {}
    for i, r in enumerate(rows):
        k = find(i)
        if k not in best or (-(r.ms or 0), r.at_us, r.id) < (-(best[k].ms or 0), best[k].at_us, best[k].id):
            best[k] = r
    return [(r.id, best[find(i)].id) for i, r in enumerate(rows)]


def _cut_chain(rows: list) -> list[tuple]:
    """(id, head) for a chain of segments, each of which goes on with the one before, that is longer than a listen may be."""
    out, head = [], rows[0]
    for r in rows:
        if r.end_us - head.start_us > ISLAND_SPAN * US:
            head = r
        out.append((r.id, head.id))
    return out


def _stamps(rows: DataFrame) -> DataFrame:
    """The stamps of each channel and track, with writes, what the rows of that stamp bring, the one that stays of them the least. Rows that no other one can be a write of stay single."""
    single = F.when(~F.col("known") | F.col("at_us").isNull(), F.col("id")).alias("single")
    # ~ turns the order round; the stamp comes first, as it tells most rows apart where they are sorted
    write = F.struct(F.bitwise_not(F.coalesce("ms", F.lit(0))).alias("less"), "id", "ms", "start_us", "finished")
    return rows.groupBy("at_us", *CHANNEL_KEYS, "known", "stamps_end", single).agg(F.collect_list(write).alias("writes"))


def _duplicates(rows: DataFrame, scope: Scope) -> DataFrame:
    """The rows with kept, the write of the same play that stays; rows that another one of their stamp is sure to stay for are only that one's ids, which is null where there are none.

    Rows of one stamp are writes of one play and come together by an aggregate, as far as may be before they are dealt; only
    those of stamps within JITTER of another stamp go through Arrow.
    """
    gap, w = JITTER * US, Window.partitionBy(*CHANNEL_KEYS).orderBy("at_us")
    own = _stamps(rows).withColumns({"_since": F.col("at_us") - F.lag("at_us").over(w), "_until": F.lead("at_us").over(w) - F.col("at_us"), "_first": F.array_min("writes")})
    near = F.coalesce(F.col("_since").between(1, gap) | F.col("_until").between(1, gap), F.lit(False)) & F.col("single").isNull()
    ids = F.when(~near & (F.size("writes") > 1), F.transform("writes", lambda x: x.id))
    of = F.struct(*CHANNEL_KEYS, "known", "stamps_end", "at_us", "_first.ms", "_first.start_us", "_first.finished")
    marked = scope.written(own.select("_first.id", ids.alias("ids"), near.alias("near"), of.alias("of"), F.when(near, F.col("writes")).alias("writes")))
    end = F.col("start_us") + F.coalesce("ms", F.lit(0)) * 1000
    alone = marked.where("not near").select("id", "ids", "of.*").withColumns({"end_us": end, "kept": F.col("id")})
    near = marked.where("near").select(F.struct("of.*").dropFields("ms", "start_us", "finished").alias("of"), "writes").select("of.*", "writes")
    near = near.withColumn("_apart", F.coalesce(F.col("at_us") - F.lag("at_us").over(w) > gap, F.lit(True))).withColumn("run", F.count_if("_apart").over(w))
    near = near.drop("_apart").withColumn("write", F.explode("writes")).select("*", "write.*").drop("writes", "write", "less")
    found = scope.written(per_group(near.select(*CHANNEL_KEYS, "run", "at_us", "id", "ms"), [*CHANNEL_KEYS, "run"], ["at_us", "id"], _twins, "id long, kept long"))
    close = near.drop("run").withColumns({"end_us": end, "ids": F.lit(None).cast("array<long>")}).join(found, "id")
    return alone.unionByName(close)


def _chains(kept: DataFrame) -> DataFrame:
    """Adds chain, a number within the keys, whose rows each go on with the one before."""
    w = Window.partitionBy(*CHANNEL_KEYS).orderBy("at_us", "id")
    before = lambda c: F.lag(c).over(w)
    goes_on = (before("finished") == F.lit(False)) & before("ms").isNotNull() & F.col("ms").isNotNull() & (F.abs(F.col("start_us") - before("end_us")) <= ISLAND_GAP * US)
    goes_on = F.coalesce(goes_on, F.lit(False)) & F.col("known")
    return kept.withColumn("chain", F.count_if(~goes_on).over(w))


def _listens(parts: DataFrame, by: list[str]) -> DataFrame:
    """Adds unit, role and what the unit has to segments whose keys by make one listen, the first of which is its head."""
    whole, first = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("at_us", "id")
    head = lambda c: F.first(c).over(first)
    several = F.count(F.lit(1)).over(whole) > 1
    ms = F.when(several, F.sum(F.coalesce("ms", F.lit(0))).over(whole)).otherwise(F.col("ms"))
    out = parts.withColumns({"unit": head("id"), "unit_ms": ms, "unit_start_us": head("start_us"), "_several": several, "_at": head("at_us")})
    at = F.when(~F.col("_several"), F.col("_at")).when(F.col("stamps_end"), F.col("unit_start_us") + F.col("unit_ms") * 1000).otherwise(F.col("unit_start_us"))
    return out.withColumns({"role": F.when(F.col("id") == F.col("unit"), "unit").otherwise("segment"), "unit_at_us": at}).drop("_several", "_at")


def same_channel(observations: DataFrame, scope: Scope | None = None) -> DataFrame:
    """id, unit, role (unit, segment or duplicate), and the unit's ms, stamp and start, of with_start's rows. Unknown channels stay single.

    Rows are dealt by stamp, where those of one come together, and then as stamps by channel and track: once for the writes of one
    play and once for the listens of those that stay; chains that are too long alone are dealt again.
    """
    scope = scope or Scope(observations.sparkSession)
    keyed = observations.withColumns({"channel_key": F.coalesce("channel", F.concat_ws("?", F.lit(""), "service")), "ms": F.col("ms_played")})
    rows = _duplicates(keyed.select(*CHANNEL_KEYS, F.col("channel").isNotNull().alias("known"), *SEGMENT), scope)
    chained, by = _chains(rows.where("id = kept").drop("kept", "ids")), [*CHANNEL_KEYS, "chain"]
    long = F.col("known") & (F.max("end_us").over(Window.partitionBy(*by)) - F.first("start_us").over(Window.partitionBy(*by).orderBy("at_us", "id")) > ISLAND_SPAN * US)
    unit = ["id", "unit", "role", "unit_ms", "unit_at_us", "unit_start_us"]
    listed = _listens(chained.withColumn("_long", F.coalesce(long, F.lit(False))), by)
    listed = scope.written(listed.select(*unit, F.when(F.col("_long"), F.struct(*by, *[c for c in SEGMENT if c != "id"])).alias("of_long")))
    cut = listed.where("of_long is not null").select("id", "of_long.*")
    heads = per_group(cut, by, ["at_us", "id"], _cut_chain, "id long, head long")
    cut = scope.written(_listens(cut.join(heads, "id"), [*CHANNEL_KEYS, "head"]).select(*unit))
    units = listed.where("of_long is null").select(*unit).unionByName(cut)
    copies = rows.where("id <> kept or ids is not null").select(F.explode(F.coalesce("ids", F.array("id"))).alias("id"), "kept").where("id <> kept").join(units.withColumnRenamed("id", "kept"), "kept").select("id", "unit", F.lit("duplicate").alias("role"), "unit_ms", "unit_at_us", "unit_start_us")
    return units.unionByName(copies)


def islands(observations: DataFrame) -> DataFrame:
    """Listens as an importer sees them: id and unit with the listen's whole ms; unknown channels are single."""
    return same_channel(with_start(with_channel(observations, strict=False)))


def candidate_pairs(heads: DataFrame) -> DataFrame:
    """Pairs of units that can be one play: x and y (the first by priority and id), delta_us, and their priorities.

    heads: id, user_id, start_us, channel, priority, resolved_track_id, bridge and normalizable. A unit meets those of its
    bin of time and of the next by an equi-join on one of two keys; a pair that shares both keys comes by its names only.
    """
    width = WIDE_TOLERANCE * US
    keys = F.array(F.struct(F.lit("names").alias("by"), F.col("bridge").alias("key")), F.struct(F.lit("track").alias("by"), F.col("resolved_track_id").cast("string").alias("key")))
    own = heads.withColumn("_bin", F.floor(F.col("start_us") / width)).withColumn("_key", F.explode(keys)).where("_key.key is not null")
    # names are compared only where a pair was met by its track
    fields = ["id", "start_us", "channel", "priority", F.when(F.col("_key.by") == "track", F.col("bridge")).alias("bridge"), "normalizable"]
    side = lambda s, bins: own.select("user_id", "_key", bins.alias("_bin"), F.struct(*fields).alias(s))
    met = side("a", F.explode(F.array("_bin", F.col("_bin") + 1))).join(side("b", F.col("_bin")), ["user_id", "_key", "_bin"])
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    delta = b("start_us") - a("start_us")
    later = (delta > 0) | (delta == 0) & (b("id") > a("id"))
    once = (F.col("_key.by") == "names") | ~F.coalesce(a("bridge") == b("bridge"), F.lit(False))
    found = met.where(later & once & (a("channel") != b("channel")) & (delta <= pair_tolerance(a("normalizable"), b("normalizable")) * US))
    end = lambda s: F.struct(F.col(f"{s}.priority").alias("priority"), F.col(f"{s}.id").alias("id"), F.call_function("shiftleft", F.lit(1), F.col(f"{s}.priority")).alias("channels"))
    return found.select(delta.alias("delta_us"), F.least(end("a"), end("b")).alias("x"), F.greatest(end("a"), end("b")).alias("y"))


def nearest_first(pairs: DataFrame, scope: Scope) -> DataFrame:
    """unit and play for each unit that joins another one's play: what a walk over all pairs, nearest first, joins if both sides share no channel.

    Rounds of joins do it: a pair that is the nearest of all left ones at both of its sides is the next that a walk would take
    there, whatever happens elsewhere, so all of these join at once. Pairs whose sides now share a channel, or are one, go; they
    could never come back. Priorities number the channels, so a side's channels are bits, and no side has more
    units than there are channels. A side is named by its first unit, by priority and id.
    """
    side = lambda s: F.struct(F.col(f"{s}.priority").alias("priority"), F.col(f"{s}.id").alias("id"))
    order = F.struct("delta_us", F.col("x.priority").alias("px"), F.col("y.priority").alias("py"), F.col("x.id").alias("x"), F.col("y.id").alias("y"))
    live = pairs.select(order.alias("pair"), side("x").alias("cx"), side("y").alias("cy"), F.col("x.channels").alias("mx"), F.col("y.channels").alias("my"))
    live, joined = scope.written(live), None
    while not live.isEmpty():
        ends = live.select("pair", F.explode(F.array(F.struct(F.col("cx").alias("c"), F.col("mx").alias("m")), F.struct(F.col("cy").alias("c"), F.col("my").alias("m")))).alias("end"))
        nearest = ends.groupBy("end.c").agg(F.min("pair").alias("pair"), F.max("end.m").alias("m"))
        taken = nearest.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("stays"), F.max("c").alias("goes"), F.bit_or("m").alias("m")).where("n = 2")
        taken = scope.written(taken.select("stays", "goes", "m"))
        joined = taken if joined is None else joined.unionByName(taken)
        moved = taken.select(F.explode(F.array("stays", "goes")).alias("c"), F.col("stays").alias("to"), "m")
        for s in ("x", "y"):
            live = live.join(moved.select(F.col("c").alias(f"c{s}"), F.col("to").alias(f"to{s}"), F.col("m").alias(f"new{s}")), f"c{s}", "left")
        live = live.select("pair", *[F.coalesce(f"to{s}", f"c{s}").alias(f"c{s}") for s in "xy"], *[F.coalesce(f"new{s}", f"m{s}").alias(f"m{s}") for s in "xy"])
        live = scope.written(live.where((F.col("cx") != F.col("cy")) & (F.col("mx").bitwiseAND(F.col("my")) == 0)))
    if joined is None:
        return pairs.select(F.col("x.id").alias("unit"), F.col("x.id").alias("play")).limit(0)
    up = joined.select(F.col("goes.id").alias("unit"), F.col("stays.id").alias("play"))
    for _ in range(len(CHANNELS).bit_length() - 1):  # a play of all channels is joined in as many steps less one; each pass doubles them
        further = up.select(F.col("unit").alias("play"), F.col("play").alias("_up"))
        up = up.join(further, "play", "left").select("unit", F.coalesce("_up", "play").alias("play"))
    return up


def _heads(observations: DataFrame, units: DataFrame) -> DataFrame:
    """The units' observations, as they were, with unit_ms and unit_start_us."""
    return observations.join(units.where("role = 'unit'").select("id", "unit_ms", "unit_start_us"), "id")


def _plays(heads: DataFrame, scope: Scope) -> DataFrame:
    """unit and play of each of _heads' rows that joins another one's play."""
    full = with_start(with_channel(heads)).withColumn("start_us", F.col("unit_start_us"))
    # tracks are played again and again: each name is made plain once
    names = heads.select(F.col("artist_name").alias("_artist"), F.col("track_name").alias("_track")).distinct().withColumn("bridge", bridge_key(F.col("_artist"), F.col("_track")))
    full = full.join(names, F.col("artist_name").eqNullSafe(F.col("_artist")) & F.col("track_name").eqNullSafe(F.col("_track")))
    slim = scope.written(full.select("user_id", "id", "start_us", "channel", "priority", "resolved_track_id", "bridge", "normalizable"))
    return nearest_first(candidate_pairs(slim), scope)


def group(observations: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Every observation with role and play, the id of the play's winner (lowest priority, then lowest id).

    observations: id, user_id, service, import_source, track_identifier, artist_name, track_name, played_at, ms_played,
    metadata (JSON) and resolved_track_id. The result reads tables of the scope, which its owner drops when it has been read.
    """
    scope = scope or Scope(observations.sparkSession)
    units = same_channel(with_start(with_channel(observations)), scope)
    plays = _plays(_heads(observations, units), scope)
    return units.join(plays, "unit", "left").select("id", "unit", "role", F.coalesce("play", "unit").alias("play"), "unit_ms", "unit_start_us")


def project(observations: DataFrame, scope: Scope | None = None) -> DataFrame:
    """The plays: play, user_id, track_id, service, import_source, played_at (of the best stamp), ms_played (the first known by priority), source_services (in order of priority), context (JSON, with the others' under merged_from_<channel>), members, divergent, start_us (of the winner) and anchor_us (the earliest start); import_batch_id too, if observations have it.

    Only units bring facts to a play, so only theirs are dealt, once to their ids and once to their plays; contexts, which are long, are built there,
    and only if they are asked for.
    """
    scope = scope or Scope(observations.sparkSession)
    units = same_channel(with_start(with_channel(observations)), scope)
    heads = scope.written(_heads(observations, units))
    members = units.groupBy("unit").agg(F.collect_set("id").alias("members"))
    full = with_channel(heads).join(members, F.col("id") == F.col("unit")).join(_plays(heads, scope), "unit", "left").withColumn("play", F.coalesce("play", "unit"))
    full = with_context(full.repartition("play"))
    rank = F.struct("priority", "id")
    in_order = lambda *columns: F.array_sort(F.collect_list(F.struct("priority", "id", *columns)))
    batch = [F.min_by("import_batch_id", rank).alias("import_batch_id")] if "import_batch_id" in observations.columns else []
    plays = full.groupBy("play").agg(
        F.first("user_id").alias("user_id"),
        F.min_by("resolved_track_id", rank).alias("track_id"),
        F.min_by("service", rank).alias("service"),
        F.min_by("import_source", rank).alias("import_source"),
        *batch,
        F.min_by("unit_start_us", F.struct(-F.col("quality"), "priority", "id")).alias("_at"),
        F.min_by("unit_start_us", rank).alias("start_us"),
        F.min("unit_start_us").alias("anchor_us"),
        F.min_by("unit_ms", F.when(F.col("unit_ms").isNotNull(), rank)).alias("ms_played"),
        in_order("service").alias("_services"),
        in_order("channel", "context").alias("_contexts"),
        F.coalesce(F.min("resolved_track_id") < F.max("resolved_track_id"), F.lit(False)).alias("divergent"),
        F.sort_array(F.flatten(F.collect_list("members"))).alias("members"),
    )
    losers = F.transform(F.slice("_contexts", F.lit(2), F.size("_contexts")), lambda x: F.struct(F.concat(F.lit("merged_from_"), x.channel).alias("key"), x.context.alias("value")))
    return plays.select(
        "play", "user_id", "track_id", "service", "import_source", *["import_batch_id"] * len(batch),
        F.timestamp_micros("_at").cast("timestamp_ntz").alias("played_at"),
        "ms_played",
        F.array_distinct(F.transform("_services", lambda x: x.service)).alias("source_services"),
        nested(F.get("_contexts", F.lit(0)).getField("context"), losers).alias("context"),
        "members", "divergent", "start_us", "anchor_us",
    )


# Incremental projection


def affected_days(stamps: DataFrame) -> DataFrame:
    """The UTC days in which a group of these observations (played_at) can be anchored."""
    first, last = F.col("played_at") - F.expr(f"interval {int(REACH.total_seconds())} seconds"), F.col("played_at")
    return stamps.select(F.explode(F.sequence(F.to_date(first), F.to_date(last))).alias("day")).distinct()


def around(observations: DataFrame, days: DataFrame) -> DataFrame:
    """The observations that can matter for groups anchored in these days: those of the days and of the reach on either side."""
    near = days.select(F.explode(F.array(F.date_sub("day", 1), F.col("day"), F.date_add("day", 1))).alias("day")).distinct()
    return observations.withColumn("day", F.to_date("played_at")).join(near, "day", "left_semi").drop("day")


def project_days(observations: DataFrame, days: DataFrame, scope: Scope | None = None) -> DataFrame:
    """The plays anchored (by the earliest start) in these days."""
    plays = project(around(observations, days), scope).withColumn("day", F.to_date(F.timestamp_micros("anchor_us")))
    return plays.join(days, "day", "left_semi").drop("day")


def refresh_aggregates(tracks: DataFrame, plays: DataFrame) -> DataFrame:
    """play_count, first_played_at and last_played_at of every track, 0 and null without plays."""
    found = plays.groupBy("track_id").agg(F.count(F.lit(1)).alias("play_count"), F.min("played_at").alias("first_played_at"), F.max("played_at").alias("last_played_at"))
    return tracks.select("track_id").join(found, "track_id", "left").withColumn("play_count", F.coalesce("play_count", F.lit(0)))


def day_aggregates(plays: DataFrame) -> DataFrame:
    """play_count, first_played_at and last_played_at of each track and day (of plays with a day, or of played_at)."""
    day = F.col("day") if "day" in plays.columns else F.to_date("played_at")
    return plays.groupBy("track_id", day.alias("day")).agg(F.count(F.lit(1)).alias("play_count"), F.min("played_at").alias("first_played_at"), F.max("played_at").alias("last_played_at"))


def merged_aggregates(totals: DataFrame, by_day: DataFrame, plays: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The aggregates of tracks, and those by day, after these days (day) got these plays in place of the ones before. Only tracks that a replaced or a new day has are summed anew, from their days and not from their plays; a track without plays any more has no row."""
    fresh = day_aggregates(plays)
    gone = by_day.join(days, "day", "left_semi")
    now = by_day.join(days, "day", "left_anti").unionByName(fresh)
    touched = gone.select("track_id").union(fresh.select("track_id")).distinct()
    again = now.join(touched, "track_id", "left_semi").groupBy("track_id").agg(F.sum("play_count").alias("play_count"), F.min("first_played_at").alias("first_played_at"), F.max("last_played_at").alias("last_played_at"))
    return totals.join(touched, "track_id", "left_anti").unionByName(again), now


# Admission


def listened_enough(ms: Column, duration_ms: Column) -> Column:
    """At least 4 minutes, or half of a known duration under 8 minutes; an unknown time counts as enough."""
    half = F.floor(duration_ms * 0.5)
    return ms.isNull() | (ms >= 240_000) | F.coalesce((duration_ms < 480_000) & (ms >= half), F.lit(False))


def admission(observations: DataFrame, tracks: DataFrame) -> DataFrame:
    """id, unit and admitted: an interrupted listen is judged as a whole, by the time of all its segments, and all of them share its verdict. tracks has track_id and duration_ms."""
    durations = observations.select("id", F.col("resolved_track_id").alias("track_id")).join(tracks.select("track_id", "duration_ms"), "track_id", "left").select(F.col("id").alias("unit"), "duration_ms")
    return islands(observations).join(durations, "unit", "left").select("id", "unit", listened_enough(F.col("unit_ms"), F.col("duration_ms")).alias("admitted"))


def median_ms(values: DataFrame) -> DataFrame:
    """The median of completed plays of each track, rounded half to even."""
    return values.groupBy("track_id").agg(F.bround(F.expr("percentile(ms_played, 0.5)"), 0).cast("long").alias("median_ms"))


def derived_shift(plays: DataFrame) -> DataFrame:
    """Adds start_shift_ms: the duration, where the time since the user's play before differs from it by at most 15 s."""
    w = Window.partitionBy("user_id").orderBy("played_at", "play_id")
    elapsed = (micros(F.col("played_at")) - micros(F.lag("played_at").over(w))) / 1000
    return plays.withColumn("start_shift_ms", F.when(F.abs(elapsed - F.col("duration_ms")) <= 15_000, F.col("duration_ms")))
