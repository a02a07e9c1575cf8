"""The play projection, imports, polling, and list differences."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.operators import diff as D
from tracklight.operators import projection as P
from tracklight.queries import NOW, T, query
from tracklight.streaming import polling

# Observations: each event is seen by one channel, every third by a second one some seconds later, every eleventh twice; every fifth of the export breaks off and goes on five seconds later.
OBSERVED = f"""with seen as (
  select event_id * 10 as id, user_id % 40 as user_id, case event_id % 4 when 0 then 'spotify' when 1 then 'spotify' when 2 then 'own' else 'lastfm' end as service,
         case event_id % 4 when 0 then 'spotify_export' when 1 then 'spotify_api' when 2 then 'manual' else 'lastfm_api' end as import_source,
         cast(json_extract_string(props, '$.k') as bigint) as track, ts as played_at, case when event_id % 4 = 3 then null else 60000 + event_id % 7 * 1000 end as ms_played, case when event_id % 20 = 0 then 'fwdbtn' else 'trackdone' end as reason from events),
 twice as (select id + 1 as id, user_id, 'lastfm' as service, 'lastfm_api' as import_source, track, played_at - interval 20 second as played_at, cast(null as bigint) as ms_played, 'trackdone' as reason from seen where id % 30 = 0 and import_source <> 'lastfm_api'),
 again as (select id + 2 as id, user_id, service, import_source, track, played_at, ms_played, reason from seen where id % 110 = 0),
 rest as (select id + 3 as id, user_id, service, import_source, track, played_at + interval 35 second as played_at, 30000 as ms_played, 'trackdone' as reason from seen where id % 200 = 0),
 obs as (select * from seen union all select * from twice union all select * from again union all select * from rest)
"""


def observations(lib) -> DataFrame:
    k = F.col("event_id") % 4
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), k.cast("int"))
    seen = lib.events.select(
        (F.col("event_id") * 10).alias("id"), (F.col("user_id") % 40).alias("user_id"), pick("spotify", "spotify", "own", "lastfm").alias("service"), pick("spotify_export", "spotify_api", "manual", "lastfm_api").alias("import_source"),
        F.get_json_object("props", "$.k").cast("long").alias("track"), F.col("ts").alias("played_at"), F.when(k != 3, 60_000 + F.col("event_id") % 7 * 1000).alias("ms_played"), F.when(F.col("event_id") % 20 == 0, "fwdbtn").otherwise("trackdone").alias("reason"),
    )
    twice = seen.where("id % 30 = 0 and import_source <> 'lastfm_api'").select((F.col("id") + 1).alias("id"), "user_id", F.lit("lastfm").alias("service"), F.lit("lastfm_api").alias("import_source"), "track", F.expr("played_at - interval 20 seconds").alias("played_at"), F.lit(None).cast("long").alias("ms_played"), F.lit("trackdone").alias("reason"))
    again = seen.where("id % 110 = 0").withColumn("id", F.col("id") + 2)
    rest = seen.where("id % 200 = 0").withColumns({"id": F.col("id") + 3, "played_at": F.expr("played_at + interval 35 seconds"), "ms_played": F.lit(30_000).cast("long"), "reason": F.lit("trackdone")})
    all_rows = seen.unionByName(twice).unionByName(again).unionByName(rest)
    named = F.concat(F.lit("track "), F.col("track"))
    return all_rows.select("id", "user_id", "service", "import_source", F.col("track").cast("string").alias("track_identifier"), F.lit("An Artist").alias("artist_name"), named.alias("track_name"), "played_at", "ms_played", F.to_json(F.struct(F.col("reason").alias("reason_end"))).alias("metadata"), F.col("track").alias("resolved_track_id"))


ENDS = "import_source in ('spotify_export', 'spotify_api')"
START = f"epoch_us(played_at) - case when {ENDS} then coalesce(ms_played, 0) * 1000 else 0 end"
TOLERANCE = "180"


@query("prj1_start_shift", f"{OBSERVED} select id, {START} as start_us, epoch_us(played_at) - case when {ENDS} then coalesce(ms_played, 0) * 1000 else 0 end + coalesce(ms_played, 0) * 1000 as end_us, not ({ENDS} and ms_played is null) as normalizable, case when import_source = 'spotify_export' then reason = 'trackdone' end as finished from obs")
def _(lib):
    return P.with_start(P.with_channel(observations(lib))).select("id", "start_us", "end_us", "normalizable", "finished")


@query("prj3_duplicates", f"{OBSERVED} select count(*) as n, count(*) filter (where id % 10 = 2) as twice from obs")
def _(lib):
    units = P.same_channel(P.with_start(P.with_channel(observations(lib))))
    # every second write of an event is a duplicate of the first, or the other way round
    return units.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "duplicate").alias("twice"))


#: The rule of equal writes, as a walk over the links of each channel and track: what is reached from a row is one write with it.
CLOSURE = """edges as (select a.id as x, b.id as y from obs a join obs b on a.user_id = b.user_id and a.service = b.service and a.import_source = b.import_source and a.track = b.track and a.id <> b.id and b.played_at between a.played_at - interval 3 second and a.played_at + interval 3 second
  where a.played_at = b.played_at or (a.ms_played > 0 and a.ms_played = b.ms_played and abs(epoch_us(a.played_at) - epoch_us(b.played_at)) <= least(3000000, a.ms_played * 1000))),
 reached(x, y) as (select x, y from edges union select r.x, e.y from reached r join edges e on e.x = r.y),
 clusters as (select x, y from reached union select x, x from edges)"""


@query("prj3_duplicate_ids", f"{OBSERVED.replace('with ', 'with recursive ', 1)}, {CLOSURE} select x as id from (select c.x, c.y, row_number() over (partition by c.x order by o.ms_played desc nulls last, o.played_at, o.id) as place from clusters c join obs o on o.id = c.y) z where place = 1 and x <> y")
def _(lib):
    """All rows of which another write is kept."""
    return P.same_channel(P.with_start(P.with_channel(observations(lib)))).where("role = 'duplicate'").select("id")


@query("prj4_islands", f"{OBSERVED} select role, count(*) as n, count(distinct unit) as units from (select case id % 10 when 2 then 'duplicate' when 3 then 'segment' else 'unit' end as role, case when id % 10 = 1 then id else id - id % 10 end as unit from obs) r group by role")
def _(lib):
    return P.islands(observations(lib)).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("units"))


UNITS = f"{OBSERVED}, units as (select *, {START} as start_us from obs where id % 10 < 2)"
PAIRS = f"{UNITS} select a.id as a_id, b.id as b_id from units a join units b on a.user_id = b.user_id and a.track = b.track and a.import_source <> b.import_source and b.start_us >= a.start_us and (b.start_us > a.start_us or b.id > a.id) and b.start_us - a.start_us <= 30 * 1000000"


@query("prj5_candidate_pairs", PAIRS)
def _(lib):
    from tracklight.operators.joins import range_join

    full = P.with_start(P.with_channel(observations(lib))).where("id % 10 < 2").withColumn("at", F.timestamp_micros("start_us"))
    side = lambda s: full.select(F.col("id").alias(f"{s}_id"), "user_id", "track_identifier", F.col("channel").alias(f"{s}_channel"), F.col("at").alias(f"{s}_at"))
    found = range_join(side("a"), side("b"), ["user_id", "track_identifier"], "a_at", "b_at", 0, 30)
    return found.where("a_channel <> b_channel and (delta_s > 0 or b_id > a_id)").select("a_id", "b_id")


@query("prj6_groups")
def _(lib):
    return P.group(observations(lib)).select("id", "unit", "role", "play")


@query("prj7_plays")
def _(lib):
    out = P.project(observations(lib))
    return out.select("play", "user_id", "track_id", "service", "played_at", "ms_played", F.array_join("source_services", ",").alias("services"), F.size("members").cast("long").alias("members"), "divergent")


@query("prj8_every_observation_once", f"{OBSERVED} select count(*) as observations, count(*) as members, 0::bigint as mixed from obs")
def _(lib):
    obs = observations(lib)
    grouped = P.group(obs).join(P.with_channel(obs).select("id", "channel"), "id")
    plays = grouped.where("role = 'unit'").groupBy("play").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("channel").alias("c"))
    mixed = plays.agg(F.count_if(F.col("n") != F.col("c")).alias("mixed"))
    return grouped.agg(F.count(F.lit(1)).alias("members")).crossJoin(mixed).crossJoin(obs.agg(F.count(F.lit(1)).alias("observations")))


# Observations with metadata of every kind, the channels' own builders and the fallbacks of services and of none.
TOLD = """with told as (select event_id as id, case event_id % 7 when 0 then 'spotify' when 1 then 'spotify' when 2 then 'spotify' when 3 then 'own' when 4 then 'lastfm' when 5 then 'lastfm' else 'elsewhere' end as service,
  case event_id % 7 when 0 then 'spotify_export' when 1 then 'spotify_api' when 2 then null when 3 then 'manual' when 4 then 'lastfm_api' when 5 then 'odd' else 'radio' end as import_source,
  concat('spotify:track:', lpad(cast(event_id as varchar(20)), 22, 'x')) as track_identifier, concat('Song ', cast(user_id as varchar(20))) as track_name, 'An Artist' as artist_name, case when event_id % 3 = 0 then null else 'An Album' end as album_name,
  concat('{"mood":{"b":[1,null,"x"],"a":true}', case when event_id % 2 = 0 then concat(',"track_uri":"spotify:track:', lpad(cast(user_id as varchar(20)), 22, 'y'), '"') else ',"track_uri":7' end, case when event_id % 5 = 0 then ',"incognito_mode":null' when event_id % 5 = 1 then ',"incognito_mode":true' else '' end,
    ',"reason_end":"trackdone","shuffle":false,"mbid":"m","loved":"0","context_type":"album","duration_ms":', cast(1000 + event_id as varchar(20)), ',"start_shift_ms":5', case when event_id % 4 = 0 then ',"album_name":"told","platform":"ios"' else '' end, '}') as metadata from events)"""

_KEYS = {
    "export": (("platform", "country", "reason_start", "reason_end", "shuffle", "skipped", "offline", "incognito_mode"), ("track_uri",)),
    "recent": (("context_type", "context_uri", "duration_ms"), ("track_uri", "start_shift_ms")),
    "scrobble": (("lastfm_track_url", "lastfm_artist_url", "lastfm_album_url", "mbid", "artist_mbid", "album_mbid", "streamable", "loved"), ()),
    "plain": ((), ()),
}


def _context_sql() -> str:
    """A row for each key of each context: names, the builder's keys, its own words, and what passes through."""
    kind = "case when service = 'spotify' and import_source = 'spotify_api' then 'recent' when service = 'spotify' then 'export' when service = 'lastfm' then 'scrobble' else 'plain' end"
    own = []
    for k, (named, consumed) in _KEYS.items():
        fixed = [("track_name", "to_json(track_name)"), ("artist_name", "to_json(artist_name)"), ("album_name", "to_json(album_name)")]
        fixed += [("resolution_method", {"export": "'\"spotify_connector_play_resolver\"'", "recent": "'\"spotify_connector_play_resolver\"'", "scrobble": "'\"lastfm_connector_play_resolver\"'", "plain": "'\"play_projection\"'"}[k]), ("architecture_version", "'\"connector_plays_deferred_resolution\"'")]
        fixed += [(n, f"coalesce(cast(metadata->'$.{n}' as varchar), " + ("case when json_exists(metadata, '$.incognito_mode') then 'null' else 'false' end)" if n == "incognito_mode" else "'null')")) for n in named]
        if k in ("export", "recent"):
            fixed += [("spotify_track_uri", "coalesce(cast(metadata->'$.track_uri' as varchar), 'null')")]
            fixed += [("spotify_track_id", "case when id % 2 = 0 then to_json(substr(metadata->>'$.track_uri', 15)) else " + ("to_json(substr(track_identifier, 15))" if k == "export" else "'null'") + " end")]
        taken = ", ".join(f"'{x}'" for x in (*named, *consumed, ""))
        passing = f"select id, key, cast(metadata->concat('$.', key) as varchar) as value from (select *, unnest(json_keys(metadata)) as key from kinds where kind = '{k}') z where key not in ({taken})"
        values = " union all ".join(f"select id, '{n}' as key, coalesce(cast({v} as varchar), 'null') as value from kinds where kind = '{k}'" for n, v in fixed)
        own.append(f"select id, key, value from ({passing}) p union all select v.id, v.key, v.value from ({values}) v anti join ({passing}) q on q.id = v.id and q.key = v.key")
    return f"{TOLD}, kinds as (select *, {kind} as kind from told) select id, key, replace(value, '{{\"b\":[1,null,\"x\"],\"a\":true}}', '{{\"a\":true,\"b\":[1,null,\"x\"]}}') as value from ({' union all '.join(own)}) w"


@query("prj9_context", _context_sql())
def _(lib):
    from tracklight.operators.contexts import as_object, with_context

    told = lib.sql(f"{TOLD} select * from told")
    return with_context(told).select("id", F.explode(as_object(F.col("context")))).select("id", "key", F.coalesce(F.to_json("value"), F.lit("null")).alias("value"))


@query("prj10_channels", f"{OBSERVED} select import_source as channel, count(*) as n from (select case import_source when 'lastfm_api' then 'lastfm' else import_source end as import_source from obs) z group by 1")
def _(lib):
    return P.with_channel(observations(lib)).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("prj11_affected_days", f"{OBSERVED} select distinct cast(unnest(generate_series(date_trunc('day', played_at - interval 26640 second), date_trunc('day', played_at), interval 1 day)) as date) as day from obs")
def _(lib):
    return P.affected_days(observations(lib).select("played_at"))


FAR = 1_000_000_000
_FAR = f"{FAR}::bigint"
# Plans over plays of their own, by the last digit: 0 is new, 1 changed, 2 as it was; 3 holds members of two stored plays, 4 of two of which a third observation
# holds on to one; 5 and 6 find a stored play without edges, of the same time or of the listen's end (6 is new where no time listened is known); 7 comes twice, and
# so does 8, whose second comes later and differs but has the first one's edge.
PLANNED = f"""select play_id as play, case play_id % 10 when 0 then play_id + 5 * {_FAR} when 5 then play_id + 2 * {_FAR} when 6 then case when ms_played > 0 then play_id + 2 * {_FAR} else play_id + 5 * {_FAR} end when 7 then play_id + 5 * {_FAR} else play_id end as play_id,
    case play_id % 10 when 0 then 'insert' when 1 then 'update' when 2 then 'keep' when 3 then 'merge' when 4 then 'merge' when 5 then 'adopt' when 6 then case when ms_played > 0 then 'heal' else 'insert' end when 7 then 'insert' when 8 then 'keep' else 'keep' end as action from plays
  union all select play_id + 3 * {_FAR}, case when play_id % 10 = 7 then play_id + 5 * {_FAR} else play_id + 8 * {_FAR} end, case when play_id % 10 = 7 then 'claim' else 'insert' end from plays where play_id % 10 in (7, 8)
  union all select null, play_id + {_FAR}, 'delete' from plays where play_id % 10 = 3"""


def planned(lib) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projected plays, stored ones and edges."""
    kind, at = F.col("play") % 10, F.col("played_at").cast("timestamp_ntz")
    own = lib.plays.select(F.col("play_id").alias("play"), "user_id", F.col("play_id").alias("track_id"), "service", "import_source", at.alias("played_at"), F.col("ms_played").cast("long").alias("ms_played"), F.array("service").alias("source_services"), "context")
    own = own.withColumns({"members": F.array("play", F.col("play") + FAR), "start_us": F.unix_micros(F.col("played_at").cast("timestamp"))})
    again = own.where(kind.isin(7, 8)).withColumns({"members": F.array(F.col("play") + 3 * FAR), "start_us": F.col("start_us") + 1, "play": F.col("play") + 3 * FAR, "ms_played": F.when(kind == 8, F.coalesce("ms_played", F.lit(0)) + 1).otherwise(F.col("ms_played"))})
    fields = ["user_id", "track_id", "service", "import_source", "played_at", "ms_played", "source_services", "context"]
    linked = own.where(kind.isin(1, 2, 3, 4, 8, 9)).withColumn("ms_played", F.when(kind == 1, F.coalesce("ms_played", F.lit(0)) + 1).otherwise(F.col("ms_played"))).select(F.col("play").alias("play_id"), *fields)
    second = own.where(kind.isin(3, 4)).select((F.col("play") + FAR).alias("play_id"), *fields)
    end = F.timestamp_micros(F.col("start_us") + F.coalesce("ms_played", F.lit(0)) * 1000).cast("timestamp_ntz")
    loose = own.where((kind == 5) | (kind == 6) & (F.col("ms_played") > 0)).withColumn("played_at", F.when(kind == 6, end).otherwise(F.col("played_at"))).select((F.col("play") + 2 * FAR).alias("play_id"), *fields)
    edge = lambda rows, o, p: rows.select((F.col("play") + o).alias("observation_id"), (F.col("play") + p).alias("play_id"))
    edges = edge(own.where(kind.isin(1, 2, 3, 4, 8, 9)), 0, 0).unionByName(edge(own.where(kind.isin(3, 4)), FAR, FAR)).unionByName(edge(own.where(kind == 4), 2 * FAR, FAR)).unionByName(edge(own.where(kind == 8), 3 * FAR, 0))
    return own.unionByName(again), linked.unionByName(second).unionByName(loose), edges


@query("prj12_apply_plan", PLANNED)
def _(lib):
    from tracklight.operators.apply import plan
    from tracklight.sources.scratch import Scope

    return plan(*planned(lib), Scope(lib.spark), F.col("play") + 5 * FAR)


# What is stored after the plan: a play for each identity, whatever it was before.
@query("prj12_executed", f"""with done as (select * from ({PLANNED}) p)
  select d.play_id, p.play_id as track_id, case when d.play_id > 7 * {_FAR} then coalesce(p.ms_played, 0) + 1 else p.ms_played end as ms_played, p.played_at,
    case p.play_id % 10 when 4 then 2 when 7 then 3 when 8 then case when d.play_id > 7 * {_FAR} then 1 else 2 end else 2 end as edges, 'keep,claim' as again
  from (select distinct play_id from done where action <> 'delete') d join plays p on p.play_id = d.play_id % {_FAR}
  union all select play_id + {_FAR}, play_id, ms_played, played_at, 1, 'left' from plays where play_id % 10 = 4""")
def _(lib):
    """Stored plays and their edges after the plan, and what a second plan would do."""
    from tracklight.operators.apply import execute, plan
    from tracklight.sources.scratch import Scope

    (new, stored, edges), scope = planned(lib), Scope(lib.spark)
    steps = plan(new, stored, edges, scope, F.col("play") + 5 * FAR)
    plays, edges = map(scope.written, execute(steps, new, stored, edges))
    again = plan(new, plays, edges, scope, F.col("play") + 5 * FAR).groupBy("play_id").agg(F.array_sort(F.collect_set("action")).alias("actions"))
    said = F.when(F.size(F.array_except("actions", F.array(F.lit("keep"), F.lit("claim")))) == 0, "keep,claim").when(F.col("actions").isNull(), "left").otherwise(F.array_join("actions", ","))
    counts = edges.groupBy("play_id").agg(F.count(F.lit(1)).alias("edges"))
    return plays.join(counts, "play_id", "left").join(again, "play_id", "left").select("play_id", "track_id", "ms_played", "played_at", "edges", said.alias("again"))


def differences(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """How many rows only one of two frames has."""
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1))).groupBy(*a.columns).agg(F.sum("_side").alias("_more"))
    surplus = lambda sign: F.coalesce(F.sum(F.greatest(F.col("_more") * sign, F.lit(0))), F.lit(0))
    return both.agg(surplus(1).alias(left), surplus(-1).alias(right))


@query("prj13_days", "select 0 as missing, 0 as surplus")
def _(lib):
    """The plays of a week by themselves are those of the whole projection that are anchored in it."""
    whole = P.project(observations(lib)).select("play", "track_id", "played_at", "ms_played", "anchor_us")
    days = lib.events.select(F.to_date("ts").alias("day")).where("day between '2024-01-03' and '2024-01-09'").distinct()
    own = P.project_days(observations(lib), days).select(*whole.columns)
    anchored = whole.withColumn("day", F.to_date(F.timestamp_micros("anchor_us"))).join(days, "day", "left_semi").select(*whole.columns)
    return differences(anchored, own, "missing", "surplus").select(F.col("missing").cast("int").alias("missing"), F.col("surplus").cast("int").alias("surplus"))


@query("str4_late_days", "select 0 as missing, 0 as surplus, 3 as batches")
def _(lib):
    """Three batches, each with observations of all days, leave the plays that a projection of everything has."""
    from tracklight.sources.scratch import folder
    from tracklight.streaming.projection import apply_batch, read_plays

    base, seen = folder(lib.spark), observations(lib)
    columns = ["play", "track_id", "played_at", "ms_played", "anchor_us"]
    # the stand-in observations are made once, as they come: a folder for each batch
    seen.withColumn("part", F.pmod(F.hash("id"), F.lit(3))).write.partitionBy("part").parquet(f"{base}/incoming")
    read = lambda path: lib.spark.read.schema(seen.schema).parquet(path)
    for k in range(3):
        apply_batch(read(f"{base}/incoming/part={k}"), f"{base}/ledger", f"{base}/plays", k)
    obs = read(f"{base}/incoming").select(*seen.columns)
    found = differences(P.project(obs).select(*columns), read_plays(lib.spark, f"{base}/plays").select(*columns), "missing", "surplus")
    return found.select(F.col("missing").cast("int").alias("missing"), F.col("surplus").cast("int").alias("surplus"), F.lit(3).alias("batches"))


@query("prj14_refresh_aggregates", "select t.track_id, count(p.play_id) as play_count, min(p.played_at) as first_played_at, max(p.played_at) as last_played_at from tracks t left join plays p on p.track_id = t.track_id group by 1")
def _(lib):
    return P.refresh_aggregates(lib.tracks, lib.plays)


@query("prj14_merged_aggregates", "select track_id, count(*) as play_count, min(played_at) as first_played_at, max(played_at) as last_played_at from plays group by 1")
def _(lib):
    """Three batches of a third of the plays, the later ones on some days only until the last; every one sums the tracks of its days anew and no others."""
    from tracklight.sources.scratch import Scope

    scope, plays, third = Scope(lib.spark), lib.plays.withColumn("day", F.to_date("played_at")), F.col("play_id") % 3
    by_day, totals = P.day_aggregates(plays.limit(0)), P.day_aggregates(plays.limit(0)).drop("day")
    for known, days in ((third == 0, F.lit(True)), (third <= 1, F.dayofmonth("played_at") % 4 == 0), (F.lit(True), F.lit(True))):
        own = plays.where(days).select("day").distinct()
        totals, by_day = map(scope.written, P.merged_aggregates(totals, by_day, plays.where(known & days), own))
    return totals


@query("prj15_edges", "select event_id as observation_id, case when event_id % 3 = 0 then event_id + 1 else event_id end as play_id from events")
def _(lib):
    from tracklight.sources.sinks import upsert

    own = lib.events.select(F.col("event_id").alias("observation_id"), F.col("event_id").alias("play_id"))
    new = own.where("observation_id % 3 = 0").withColumn("play_id", F.col("play_id") + 1)
    return upsert(own, new, ["observation_id"])


@query("prj16_listened_enough", "select p.play_id, p.ms_played is null or p.ms_played >= 240000 or coalesce(t.duration_ms < 480000 and p.ms_played >= floor(t.duration_ms * 0.5), false) as admitted from plays p left join tracks t on t.track_id = p.track_id")
def _(lib):
    rows = lib.plays.join(lib.tracks.select("track_id", "duration_ms"), "track_id", "left")
    return rows.select("play_id", P.listened_enough(F.col("ms_played"), F.col("duration_ms")).alias("admitted"))


@query("prj18_median", "select track_id, cast(round_even(quantile_cont(ms_played, 0.5), 0) as bigint) as median_ms from plays group by 1")
def _(lib):
    return P.median_ms(lib.plays)


# Imports


@query("imp5_derived_shift", "select play_id, case when abs(epoch_us(played_at) - lag(epoch_us(played_at)) over (partition by user_id order by played_at, play_id) - d * 1000) <= 15000000 then d end as start_shift_ms from (select *, 60000 + play_id % 50 * 20000 as d from plays) z")
def _(lib):
    return P.derived_shift(lib.plays.withColumn("duration_ms", 60_000 + F.col("play_id") % 50 * 20_000)).select("play_id", "start_shift_ms")


@query("imp6_insert_ignore", "select play_id from plays where play_id % 3 <> 0")
def _(lib):
    from tracklight.sources.imports import new_rows

    rows = lib.plays.select("play_id", "user_id", F.col("service").alias("connector"), F.col("track_id").alias("track_identifier"), "played_at", "ms_played")
    return new_rows(rows.where("play_id % 3 = 0"), rows.unionByName(rows.where("play_id % 5 = 0"))).select("play_id")


ASKED = f"select user_id, case when user_id % 3 = 0 then min(played_at) end as asked_from, case when user_id % 4 = 0 then max(played_at) end as asked_to, case when user_id % 3 < 2 then {{middle}} end as checkpoint from plays group by user_id"


@query("imp4_date_range", f"select user_id, a, b, greatest(0, ceil((epoch_us(b) - epoch_us(a)) / (7 * 86400000000.0)))::bigint as windows from (select user_id, coalesce(asked_from, checkpoint, {T} - interval 30 day) as a, coalesce(asked_to, {T}) as b from ({ASKED.format(middle="min(played_at) + interval 3 day")}) z) y")
def _(lib):
    """What each user asked for, else from where the last import ended, else the last month; and in how many windows."""
    from tracklight.sources.imports import date_ranges

    return date_ranges(lib.sql(ASKED.format(middle="min(played_at) + interval 3 days")), NOW).select("user_id", F.col("since").alias("a"), F.col("until").alias("b"), "windows")



# Polling


# States of polling, a row for each customer: how long ago a poll and another source's play were, in seconds.
STATES = "select c_custkey as user_id, c_custkey % 5 as empty, case when c_custkey % 4 = 0 then 0 else c_custkey % 9 * 1000 end as interval_s, c_custkey % 7 = 0 as gap, case when c_custkey % 11 = 0 then null else c_custkey * 37 % 20000 end as polled_ago, case when c_custkey % 3 = 0 then c_custkey * 911 % 1000000 end as other_ago, c_custkey % 13 <> 0 as has_scope, case when c_custkey % 2 = 0 then 'demand' else 'schedule' end as trigger from customer"
CAP = "case when other_ago <= 604800 then 86400 else 7200 end"
LIVE_S = f"greatest(900, least(case when interval_s = 0 then 1800 else interval_s end, {CAP}))"


def states(lib) -> DataFrame:
    at = lambda c: F.timestamp_micros(F.unix_micros(F.lit(NOW).cast("timestamp")) - F.col(c) * 1_000_000).cast("timestamp_ntz")
    return lib.sql(STATES).withColumns({"last_polled": at("polled_ago"), "other_seen": at("other_ago")})


@query("str1_decisions", f"select user_id, reason is null as polls, reason from (select user_id, case when not has_scope then 'scope_missing' when trigger = 'demand' then case when polled_ago < 600 then 'recently_polled' end when polled_ago < {LIVE_S} then 'not_due' end as reason from ({STATES}) z) y")
def _(lib):
    return polling.decisions(states(lib), NOW).select("user_id", "polls", "reason")



@query("str2_after_poll", f"""with p as (select *, user_id % 17 <> 0 as ok, user_id * 7 % 53 as seen, user_id % 6 as new, {CAP} as cap, {LIVE_S} as live from ({STATES}) z)
  select user_id, case when ok and seen < 50 and seen < 30 and new = 0 then empty + 1 when ok then 0 else empty end as misses,
    greatest(900, least(case when not ok then live when seen >= 50 then 900 when seen >= 30 then live // 2 when new > 0 then 1800 else least(1800 * 2 ^ (empty + 1), 86400) end, cap))::bigint as seconds,
    case when not ok or seen >= 30 and seen < 50 then gap when seen >= 50 then true else false end as gap from p""")
def _(lib):
    """The states after a poll each, of a window of 50 plays."""
    polls = states(lib).withColumns({"ok": F.expr("user_id % 17 <> 0"), "seen": F.expr("user_id * 7 % 53"), "new": F.expr("user_id % 6"), "resumed": F.lit(True)})
    return polling.after_polls(polls, 50, NOW).select("user_id", F.col("empty").alias("misses"), F.col("interval_s").alias("seconds"), "gap")



@query("str3_backoff", "select o_orderkey, least(86400, 1800 * 2 ^ least(o_orderkey % 40, 30))::bigint as seconds from orders")
def _(lib):
    return lib.orders.select("o_orderkey", polling.backoffs(F.col("o_orderkey") % 40).alias("seconds"))



@query("str5_health", f"select user_id, case when polled_ago <= 2 * {LIVE_S} then 'healthy' when polled_ago is not null then 'overdue' end as health from ({STATES}) z")
def _(lib):
    return polling.healths(states(lib), NOW).select("user_id", "health")



PLANS = "select o_orderkey, o_orderdate as since, o_orderkey % 60 as minute, o_orderkey % 24 as hour, case when o_orderkey % 3 = 0 then o_orderkey % 7 end as day_of_week, case when o_orderkey % 5 = 0 then 15 + o_orderkey % 90 end as interval_minutes from orders"


@query("str6_next_run", f"select o_orderkey, case when interval_minutes is not null then date_trunc('minute', since + interval_minutes * interval 1 minute) else (select min(d) from (select date_trunc('day', since) + k * interval 1 day + hour * interval 1 hour + minute * interval 1 minute as d from range(9) r(k)) y where d > since and (day_of_week is null or dayofweek(d) = day_of_week)) end as moment from ({PLANS}) z")
def _(lib):
    """Of each order's schedule the first run after its date: daily, on a weekday, or every so many minutes."""
    plans = lib.sql(PLANS).withColumns({"since": F.col("since").cast("timestamp_ntz"), "timezone": F.lit("UTC")})
    return polling.next_runs(plans).select("o_orderkey", F.col("next_run").alias("moment"))



# Differences of lists

TARGET = "select playlist_id, case when position % 7 = 3 and position > 0 then position - 1 when position % 7 = 2 and n > position + 1 then position + 1 else position end as position, case when playlist_id % 4 = 1 and position % 5 = 4 then track_id + 1 else track_id end as track_id from (select *, count(*) over (partition by playlist_id) as n from current0) z"
LISTS = f"with current0 as (select playlist_id, position, coalesce(track_id, -1) as track_id from entries), target0 as ({TARGET}), c as (select *, row_number() over (partition by playlist_id, track_id order by position) as turn from current0), t as (select *, row_number() over (partition by playlist_id, track_id order by position) as turn from target0)"


def pair_of_lists(lib) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    current = lib.entries.select("playlist_id", F.col("position").cast("long").alias("position"), F.coalesce("track_id", F.lit(-1)).alias("track_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("playlist_id"))
    p = F.col("position")
    swapped = F.when((p % 7 == 3) & (p > 0), p - 1).when((p % 7 == 2) & (F.col("n") > p + 1), p + 1).otherwise(p)
    target = current.withColumn("n", n).select("playlist_id", swapped.alias("position"), F.when((F.col("playlist_id") % 4 == 1) & (p % 5 == 4), F.col("track_id") + 1).otherwise(F.col("track_id")).alias("track_id"))
    return current, target


@query("dif2_matched", f"{LISTS} select coalesce(c.playlist_id, t.playlist_id) as playlist_id, coalesce(c.track_id, t.track_id) as track_id, coalesce(c.turn, t.turn) as turn, c.position as current_position, t.position as target_position from c full join t on t.playlist_id = c.playlist_id and t.track_id = c.track_id and t.turn = c.turn")
def _(lib):
    return D.matched(*pair_of_lists(lib)).withColumn("turn", F.col("turn").cast("long"))


@query("dif3_removals", f"{LISTS} select c.playlist_id, c.track_id, c.position from c left join t on t.playlist_id = c.playlist_id and t.track_id = c.track_id and t.turn = c.turn where t.turn is null")
def _(lib):
    return D.removals(*pair_of_lists(lib))


@query("dif3_removals_compat", f"{LISTS}, m as (select c.playlist_id, c.track_id, count(*) as n from c left join t on t.playlist_id = c.playlist_id and t.track_id = c.track_id and t.turn = c.turn where t.turn is null group by 1, 2) select c.playlist_id, c.track_id, c.position from c join m on m.playlist_id = c.playlist_id and m.track_id = c.track_id where c.turn <= m.n")
def _(lib):
    return D.removals(*pair_of_lists(lib), compat=True)


@query("dif4_additions", f"{LISTS} select t.playlist_id, t.track_id, t.position from t left join c on t.playlist_id = c.playlist_id and t.track_id = c.track_id and t.turn = c.turn where c.turn is null")
def _(lib):
    return D.additions(*pair_of_lists(lib))


# The pairs of slots, and the length of a longest run that keeps its order: the last slots of the best runs so far, one slot after the other.
PAIRED = f"{LISTS.replace('with ', 'with recursive ', 1)}, direct as (select c.playlist_id, c.track_id, c.position from c join t on t.playlist_id = c.playlist_id and t.track_id = c.track_id and t.position = c.position), c2 as (select *, row_number() over (partition by playlist_id, track_id order by position) as k from c anti join direct using (playlist_id, position)), t2 as (select *, row_number() over (partition by playlist_id, track_id order by position) as k from t anti join direct using (playlist_id, position)), paired as (select playlist_id, position as a, position as b from direct union all select c2.playlist_id, c2.position, t2.position from c2 join t2 on t2.playlist_id = c2.playlist_id and t2.track_id = c2.track_id and t2.k = c2.k), m as (select playlist_id, a as v, row_number() over (partition by playlist_id order by b) as k from paired), r(playlist_id, k, ends) as (select distinct playlist_id, 0::bigint, []::bigint[] from m union all select playlist_id, k + 1, case when p is null then list_append(ends, v) else ends[1:p - 1] || [v] || ends[p + 1:] end from (select r.playlist_id, r.k, r.ends, m.v, list_position(list_transform(r.ends, lambda x: x >= m.v), true) as p from r join m on m.playlist_id = r.playlist_id and m.k = r.k + 1) s), longest as (select playlist_id, max(len(ends)) as run, max(k) as slots from r group by playlist_id)"
GONE = "(select playlist_id, count(*) as n from c where not exists (select 1 from t where t.playlist_id = c.playlist_id and t.track_id = c.track_id and t.turn = c.turn) group by 1)"
NEW = "(select playlist_id, count(*) as n from t where not exists (select 1 from c where c.playlist_id = t.playlist_id and c.track_id = t.track_id and c.turn = t.turn) group by 1)"


@query("dif5_longest_run", f"{PAIRED} select playlist_id, run, slots from longest")
def _(lib):
    return D.longest_runs(*pair_of_lists(lib))


@query("dif6_moves", f"{PAIRED} select playlist_id, slots - run as moves, true as keeps_order from longest")
def _(lib):
    """How many slots of each list move, and whether those that don't are in order."""
    from pyspark.sql import Window

    current, target = pair_of_lists(lib)
    pairs = D.pairing(current, target)
    moved = D.moves(current, target).select("playlist_id", F.col("position").alias("target_position"), F.lit(True).alias("moves"))
    own = pairs.join(moved, ["playlist_id", "target_position"], "left")
    w = Window.partitionBy("playlist_id", F.col("moves").isNull()).orderBy("target_position")
    right = F.col("moves") | F.coalesce(F.col("current_position") > F.lag("current_position").over(w), F.lit(True))
    return own.withColumn("right", F.coalesce(right, F.col("current_position") > F.lag("current_position").over(w), F.lit(True))).groupBy("playlist_id").agg(F.count_if("moves").alias("moves"), F.bool_and("right").alias("keeps_order"))


@query("dif1_operations", f"{PAIRED} select * from (select 'remove' as operation, sum(n)::bigint as n from {GONE} g union all select 'add', sum(n)::bigint from {NEW} g union all select 'move', sum(slots - run)::bigint from longest) o where n > 0")
def _(lib):
    return D.operations(*pair_of_lists(lib)).groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


# Operations of lists of their own: every fifth slot goes, every fifth is added, and the others of a list's odd slots move three down.
OPS = "with ops as (select playlist_id, case position % 5 when 0 then 'remove' when 1 then 'add' else 'move' end as operation, coalesce(track_id, -1) as track_id, case position % 5 when 0 then position when 1 then position else position + 3 end as position, case when position % 5 = 1 then null else position end as old_position from entries where position % 5 < 2 or position % 2 = 1)"


def own_operations(lib) -> DataFrame:
    at = F.col("position") % 5
    kind = F.when(at == 0, "remove").when(at == 1, "add").otherwise("move")
    rows = lib.entries.where("position % 5 < 2 or position % 2 = 1").select("playlist_id", kind.alias("operation"), F.coalesce("track_id", F.lit(-1)).alias("track_id"), F.when(at < 2, F.col("position")).otherwise(F.col("position") + 3).alias("position"), F.when(at != 1, F.col("position")).alias("old_position"))
    return rows.withColumn("step", D.step_of())


@query("dif8_steps", f"{OPS} select playlist_id, operation, position, row_number() over (partition by playlist_id order by case operation when 'remove' then 0 when 'add' then 1 else 2 end, position, track_id) as place from ops")
def _(lib):
    from pyspark.sql import Window

    w = Window.partitionBy("playlist_id").orderBy("step", "position", "track_id")
    return own_operations(lib).select("playlist_id", "operation", "position", F.row_number().over(w).alias("place"))


EXECUTED = f"{OPS}, g as (select playlist_id, old_position as gone from ops where operation = 'remove'), s as (select o.*, case when operation = 'move' then old_position - (select count(*) from g where g.playlist_id = o.playlist_id and gone < old_position) else old_position end as f, case when operation = 'move' then position - (select count(*) from g where g.playlist_id = o.playlist_id and gone < position) else position end as p from ops o)"


@query("dif9_executable", f"{EXECUTED} select playlist_id, row_number() over (partition by playlist_id order by case operation when 'remove' then 0 when 'add' then 1 else 2 end, case when operation = 'add' then p else -f end, p, track_id) as sequence, operation, track_id, p as position, f as old_position from s where operation <> 'move' or f >= 0 and p >= 0")
def _(lib):
    return D.executable(own_operations(lib))


@query("dif10_shifted_moves", f"{EXECUTED} select playlist_id, track_id, f as old_position, p as position from s where operation = 'move' and f >= 0 and p >= 0")
def _(lib):
    return D.shifted(own_operations(lib)).where("operation = 'move'").select("playlist_id", "track_id", "old_position", "position")


@query("dif7_confidence", f"{PAIRED}, k as (select c.playlist_id, count(t.turn) as matched from c left join t on t.playlist_id = c.playlist_id and t.track_id = c.track_id and t.turn = c.turn group by 1), o as (select k.playlist_id, matched, coalesce(g.n, 0) + coalesce(a.n, 0) + coalesce(l.slots - l.run, 0) as operations from k left join {GONE} g on g.playlist_id = k.playlist_id left join {NEW} a on a.playlist_id = k.playlist_id left join longest l on l.playlist_id = k.playlist_id) select playlist_id, matched, operations, round(case when matched + operations = 0 then 1 else matched / (matched + operations) end, 9) as confidence from o")
def _(lib):
    return D.confidence(*pair_of_lists(lib)).withColumn("confidence", F.round("confidence", 9))


@query("dif11_sync_plan", f"{LISTS}, k as (select coalesce(a.playlist_id, b.playlist_id) as playlist_id, coalesce(a.n, 0) as x, coalesce(b.n, 0) as y from (select playlist_id, track_id, count(*) as n from current0 group by 1, 2) a full join (select playlist_id, track_id, count(*) as n from target0 group by 1, 2) b on b.playlist_id = a.playlist_id and b.track_id = a.track_id), s as (select playlist_id, cast(sum(greatest(y - x, 0)) as bigint) as to_add, cast(sum(greatest(x - y, 0)) as bigint) as to_remove, cast(sum(least(x, y)) as bigint) as unchanged, sum(x) as total from k group by 1), o as (select coalesce(c.playlist_id, t.playlist_id) as playlist_id, bool_and(c.track_id is not distinct from t.track_id) as is_noop from c full join t on t.playlist_id = c.playlist_id and t.position = c.position group by 1) select s.playlist_id, to_add, to_remove, unchanged, is_noop, case when total = 0 then false when to_remove >= total then true else to_remove / total > 0.5 and to_remove > 10 end as flagged from s join o on o.playlist_id = s.playlist_id")
def _(lib):
    return D.sync_plan(*pair_of_lists(lib))


@query("dif12_flagged", f"{LISTS}, n as (select c.playlist_id, count(*) as total, count(*) filter (where t.turn is null) as removed from c left join t on t.playlist_id = c.playlist_id and t.track_id = c.track_id and t.turn = c.turn group by 1) select playlist_id, removed, total, case when total = 0 then false when removed >= total then true else removed / total > 0.5 and removed > 10 end as flagged from n")
def _(lib):
    current, target = pair_of_lists(lib)
    gone = D.removals(current, target).groupBy("playlist_id").agg(F.count(F.lit(1)).alias("removed"))
    totals = current.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("total")).join(gone, "playlist_id", "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    return totals.select("playlist_id", "removed", "total", D.flagged(F.col("removed"), F.col("total")).alias("flagged"))



@query("dif13_reorder", f"{LISTS} select t.playlist_id, t.position, t.track_id, c.position as from_position from t left join c on t.playlist_id = c.playlist_id and t.track_id = c.track_id and t.turn = c.turn")
def _(lib):
    return D.reorder(*pair_of_lists(lib))
