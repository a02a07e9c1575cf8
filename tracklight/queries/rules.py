"""Rules and seams that other queries use inside: levels and verdicts, tolerances, cursors, stores, imports, plug-ins."""

from __future__ import annotations

import datetime as dt
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.functions import scalars, scoring
from tracklight.functions.scalars import Cursor, encode_cursor
from tracklight.operators import enrichers, filters, mutations, selectors, sorters
from tracklight.operators import library as L
from tracklight.operators import projection as P
from tracklight.operators.joins import block_join
from tracklight.plans import workflow as W
from tracklight.plans.ordered import curried
from tracklight.plans.templates import chain, graph
from tracklight.queries import NOW, T, placed, query
from tracklight.queries.history import OBSERVED, START, STATES, observations, states
from tracklight.queries.lists import HISTORY, LIKED_HISTORY, base, history, ids
from tracklight.sources import imports, lists, sinks
from tracklight.sources.scratch import folder
from tracklight.streaming import polling

# Lists


@query("src5_preferred_without_total", f"select track_id, null::bigint as total from {HISTORY} where track_id in (select track_id from preferences where state = 'star') order by last_at desc nulls last, track_id desc limit 50")
def _(lib):
    found = L.list_tracks(lib, NOW, L.Filters(preference="star"), with_total=False)
    return found.rows.select("track_id", F.lit(found.total).cast("long").alias("total"))


@query("flt16_window", "select play_id, played_at >= TIMESTAMP '2024-01-05' and played_at < TIMESTAMP '2024-01-09 12:00:00' as inside, played_at >= TIMESTAMP '2024-01-05' as after_only, true as open from plays")
def _(lib):
    a, b = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9, 12)
    inside = lambda after, before: scalars.in_window(F.col("played_at"), after, before)
    return lib.plays.select("play_id", inside(a, b).alias("inside"), inside(a, None).alias("after_only"), inside(None, None).alias("open"))


@query("flt19_unknown_states", placed("track_id", where="track_id in (select track_id from preferences where state = 'yah')"))
def _(lib):
    return ids(filters.by_preference(enrichers.preferences(base(lib), lib.preferences), ["loved", "yah", "YAH", "5 stars"]))


for name, metric, order in (("artist", "artist", "coalesce(artists[1], ''), track_id"), ("album", "album", "coalesce(album, ''), track_id"), ("release_date", "release_date", "coalesce(release_date, TIMESTAMP '0001-01-01'), track_id")):
    query(f"srt1b_{name}", placed(order))(lambda lib, metric=metric: ids(sorters.by_metric(base(lib), metric, False)))


def run(lib, raw: dict) -> W.Compiled:
    return W.compile(W.parse(raw), W.Env(lib, NOW, seed=1))


PLAYLISTS = " union all ".join(f"(select {k} as l, t.track_id, row_number() over (order by e.position) as p from entries e join tracks t on t.track_id = e.track_id where e.playlist_id = {n})" for k, n in enumerate((8, 9, 3)))


@query("cmb4_node", f"select row_number() over (order by p, l) - 1 as position, track_id from ({PLAYLISTS}) z")
def _(lib):
    """A combiner node takes its upstream lists in the order named, the primary one first; a `sources` setting changes nothing."""
    tasks = {f"in{n}": ("source.playlist", {"playlist_id": n}, []) for n in (3, 8, 9)}
    tasks |= {"all": ("combiner.interleave_playlists", {"sources": ["in3"], "primary_input": "in8"}, ["in9", "in8", "in3"]), "out": ("destination.create_playlist", {"name": "All"}, ["all"])}
    return run(lib, graph("all", **tasks)).final.result("track_id")


# Stores


def stored(lib) -> sinks.PlaylistStore:
    return sinks.PlaylistStore(lib.spark, folder(lib.spark))


@query("snk1_create_playlist", f"select position, track_id, {T} as added_at, 'Likes of 2024-01-31' as name, count(*) over () as track_count from ({placed('liked_at desc nulls last, track_id', LIKED_HISTORY, limit=200)}) z")
def _(lib):
    store = stored(lib)
    made = store.create(lists.liked_tracks(lib.likes, lib.tracks, "spotify", limit=200), "Likes of {date}", NOW)
    return store.entries(made["playlist_id"]).withColumns({"name": F.lit(made["name"]), "track_count": F.lit(made["track_count"]).cast("long")})


LISTED = "(select t.track_id, row_number() over (order by e.position) - 1 as p from entries e join tracks t on t.track_id = e.track_id where e.playlist_id = {}) x"
LATER = dt.datetime(2024, 2, 1)


@query("snk2_overwrite_playlist", f"select b.p as position, b.track_id, case when b.track_id in (select track_id from {LISTED.format(9)}) then {T} else TIMESTAMP '2024-02-01' end as added_at from (select * from {LISTED.format(10)}) b")
def _(lib):
    store = stored(lib)
    made = store.create(lists.playlist(lib.entries, lib.tracks, 9), "P", NOW)
    store.update(made["playlist_id"], lists.playlist(lib.entries, lib.tracks, 10), LATER)
    return store.entries(made["playlist_id"])


@query("snk2_append_to_playlist", f"select row_number() over (order by part, p) - 1 as position, track_id, case part when 0 then {T} else TIMESTAMP '2024-02-01' end as added_at from (select 0 as part, * from {LISTED.format(9)} union all select 1, * from {LISTED.format(10)} where track_id not in (select track_id from {LISTED.format(9)})) y")
def _(lib):
    store = stored(lib)
    made = store.create(lists.playlist(lib.entries, lib.tracks, 9), "P", NOW)
    store.update(made["playlist_id"], lists.playlist(lib.entries, lib.tracks, 10), LATER, append=True)
    return store.entries(made["playlist_id"])


@query("snk2_empty_overwrite", "select true as refused, count(*) as kept from " + LISTED.format(9))
def _(lib):
    store, own = stored(lib), lists.playlist(lib.entries, lib.tracks, 9)
    made, refused = store.create(own, "P", NOW), False
    try:
        store.update(made["playlist_id"], selectors.first(own, 0), LATER)
    except sinks.EmptyOverwriteError:
        refused = True
    return store.entries(made["playlist_id"]).agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("kept"))


@query("snk7_staged_insert", "select 1 as run, count(*) as streamed, count(distinct (user_id, track_id)) as inserted from plays where play_id % 2 = 0 union all select 2, count(*), (select count(*) from (select user_id, track_id from plays except select user_id, track_id from plays where play_id % 2 = 0) n) from plays")
def _(lib):
    table, rows = f"{folder(lib.spark)}/plays", lib.plays.select("user_id", "track_id", "played_at", "ms_played", "play_id")
    counts = [(k, *sinks.staged_insert(lib.spark, table, own, ["user_id", "track_id"])) for k, own in ((1, rows.where("play_id % 2 = 0")), (2, rows))]
    return lib.spark.createDataFrame(counts, "run int, streamed long, inserted long")


# The projection's parts

SHIFT = "case when import_source in ('spotify_export', 'spotify_api') then coalesce(ms_played, 0) * 1000 else 0 end"


@query("prj1b_start_time", f"{OBSERVED} select id, played_at - to_microseconds({SHIFT}::bigint) as start_at from obs")
def _(lib):
    return P.with_start(P.with_channel(observations(lib))).select("id", F.timestamp_micros("start_us").cast("timestamp_ntz").alias("start_at"))


@query("prj1c_end_time", f"{OBSERVED} select id, played_at - to_microseconds({SHIFT}::bigint) + to_milliseconds(coalesce(ms_played, 0)::bigint) as end_at from obs")
def _(lib):
    return P.with_start(P.with_channel(observations(lib))).select("id", F.timestamp_micros("end_us").cast("timestamp_ntz").alias("end_at"))


@query("prj1d_completion", f"{OBSERVED} select case import_source when 'spotify_export' then reason end as said, case when import_source = 'spotify_export' then reason = 'trackdone' end as finished, count(*) as n from obs group by all")
def _(lib):
    said = F.when(F.col("import_source") == "spotify_export", F.get_json_object("metadata", "$.reason_end"))
    return P.with_start(P.with_channel(observations(lib))).groupBy(said.alias("said"), "finished").agg(F.count(F.lit(1)).alias("n"))


@query("prj2_one_observation", f"{OBSERVED} select a.id as a_id, b.id as b_id from obs a join obs b on a.user_id = b.user_id and a.import_source = b.import_source and a.track = b.track and b.played_at >= a.played_at and (b.played_at > a.played_at or b.id > a.id) and (b.played_at = a.played_at or (a.ms_played > 0 and a.ms_played = b.ms_played and epoch_us(b.played_at) - epoch_us(a.played_at) <= least(3000000, a.ms_played * 1000)))")
def _(lib):
    return P.duplicate_pairs(P.with_start(P.with_channel(observations(lib))))


HEAD = "id - case when id % 10 in (2, 3) then id % 10 else 0 end"
ROLE = "case id % 10 when 2 then 'duplicate' when 3 then 'segment' else 'unit' end"
UNIT_MS = f"sum(case when id % 10 <> 2 then ms_played end) over (partition by {HEAD})"


@query("prj4b_representative", f"{OBSERVED}, u as (select *, {HEAD} as head, {UNIT_MS} as whole_ms, count(*) filter (where id % 10 <> 2) over (partition by {HEAD}) as segments, min({START}) over (partition by {HEAD}) as first_us from obs) select id, whole_ms::bigint as unit_ms, first_us as unit_start_us, case when segments > 1 then first_us + whole_ms::bigint * 1000 else epoch_us(played_at) end as unit_at_us from u where id = head")
def _(lib):
    return P.same_channel(P.with_start(P.with_channel(observations(lib)))).where("role = 'unit'").select("id", "unit_ms", "unit_start_us", "unit_at_us")


@query("prj4c_same_channel", f"{OBSERVED} select id, {HEAD} as unit, {ROLE} as role from obs")
def _(lib):
    return P.same_channel(P.with_start(P.with_channel(observations(lib)))).select("id", "unit", "role")


@query("prj4d_unknown_channels", f"{OBSERVED} select id, case when ({HEAD}) % 70 = 0 then id else {HEAD} end as unit, case when ({HEAD}) % 70 = 0 then 'unit' else {ROLE} end as role from obs")
def _(lib):
    """An importer sees channels that the projection doesn't know; their rows stay single."""
    rows = observations(lib)
    at = F.col("id") - F.when((F.col("id") % 10).isin(2, 3), F.col("id") % 10).otherwise(0)
    return P.islands(rows.withColumn("import_source", F.when(at % 70 == 0, "elsewhere").otherwise(F.col("import_source")))).select("id", "unit", "role")


KNOWN = "({0}.import_source not in ('spotify_export', 'spotify_api') or {0}.ms_played is not null and {0}.id % 70 <> 0)"


@query("prj5b_tolerance", f"{OBSERVED} select a.id, case when {KNOWN.format('a')} and {KNOWN.format('b')} then 30 else 180 end as seconds from obs a join obs b on b.id = a.id + 1")
def _(lib):
    """Of an observation and the next one of its event; some times listened are taken to be unknown."""
    rows = observations(lib).withColumn("ms_played", F.when(F.col("id") % 70 != 0, F.col("ms_played")))
    full = P.with_start(P.with_channel(rows)).select("id", "normalizable")
    second = full.select((F.col("id") - 1).alias("id"), F.col("normalizable").alias("other"))
    return full.join(second, "id").select("id", P.pair_tolerance(F.col("normalizable"), F.col("other")).alias("seconds"))


@query("prj5c_bridge_key", "select p_partkey, replace(lower(p_brand), '#', '') || '::' || lower(p_name) || ' featuring x and y' as bridge from part")
def _(lib):
    return lib.part.select("p_partkey", P.bridge_key(F.concat(F.lit("The "), "p_brand"), F.concat("p_name", F.lit(" (ft. X & Y)"))).alias("bridge"))


@query("prj17_admission", f"{OBSERVED}, u as (select id, {HEAD} as unit, {UNIT_MS} as ms, first_value(track) over (partition by {HEAD} order by id) as track from obs) select id, unit, ms is null or ms >= 240000 or coalesce(t.duration_ms < 480000 and ms >= floor(t.duration_ms * 0.5), false) as admitted from u left join tracks t on t.track_id = u.track")
def _(lib):
    return P.admission(observations(lib), lib.tracks)


# Listing


@query("lst5_decode_cursor", "select track_id, track_id % 5 = 0 as decodes from tracks")
def _(lib):
    """Of five cursors four are broken: no base64, no JSON, no id, a value that is a list."""
    kind, b64 = F.col("track_id") % 5, lambda text: F.base64(text.cast("binary"))
    good = scalars.encode_cursors("title", F.col("title"), F.col("track_id"))
    lacks, lists_it = F.concat(F.lit('{"c": "title", "v": '), F.col("track_id"), F.lit("}")), F.concat(F.lit('{"c": "title", "v": ['), F.col("track_id"), F.lit('], "id": 2}'))
    text = F.when(kind == 0, good).when(kind == 1, F.concat(F.lit("%"), good)).when(kind == 2, b64(F.concat(F.lit("{"), F.col("title")))).when(kind == 3, b64(lacks)).otherwise(b64(lists_it))
    return lib.tracks.select("track_id", scalars.decode_cursors(text).isNotNull().alias("decodes"))



@query("lst11_cursor_of_another_order", "select (select count(*) from tracks) as total, z.track_id, f.state as preference, (select string_agg(distinct tag, '|' order by tag) from tags g where g.track_id = z.track_id) as tags from (select track_id from tracks order by title nulls last, track_id limit 15 offset 30) z left join preferences f on f.track_id = z.track_id")
def _(lib):
    """A cursor of another order is passed over: the page is that of the offset, with preferences and tags."""
    found = L.list_tracks(lib, NOW, sort_by="title_asc", limit=15, offset=30, cursor=encode_cursor(Cursor("duration_ms", 5, 1)))
    return found.rows.select(F.lit(found.total).cast("long").alias("total"), "track_id", "preference", F.array_join("tags", "|").alias("tags"))


PERIOD = f"(select count(*) from plays p where p.track_id = h.track_id and played_at between {T} - interval {{}} day and {T})"


@query("agg15_metrics_of_all_nodes", f"select 'total_plays' as metric, track_id, n::varchar as value from {LIKED_HISTORY} union all select 'period_plays', track_id, (case when n >= 90 then {PERIOD.format(20)} else {PERIOD.format(10)} end)::varchar from {LIKED_HISTORY}")
def _(lib):
    """Two nodes count plays of different periods; the later one's value holds for the tracks that reach it."""
    step = lambda days: ("enricher.play_history", {"metrics": ["total_plays", "period_plays"], "period_days": days})
    return W.metrics_of(run(lib, chain("two", ("source.liked_tracks", {"connector_filter": "spotify"}), step(10), ("filter.by_play_history", {"min_plays": 90}), step(20), ("destination.create_playlist", {"name": "x"}))))


@query("win6_newest_with_counts", "select r.workflow_id, r.run_id, c.completed, c.runs from runs r join (select workflow_id, max((started_at, run_id)) as newest, count_if(status = 'completed') as completed, count(*) as runs from runs group by 1) c on c.workflow_id = r.workflow_id and c.newest = (r.started_at, r.run_id)")
def _(lib):
    return L.latest_runs(lib.runs).select("workflow_id", "run_id", "completed", "runs")


@query("mut11_overrides", "with s as (select * from (values ('service_import', 0), ('playlist_assignment', 1), ('manual', 2)) t(name, rank)) select p.track_id, p.source as old, b.name as new, b.rank > a.rank as overrides from preferences p join s a on a.name = p.source join s b on b.rank = p.track_id // 3 % 3")
def _(lib):
    new = F.get(F.array(*[F.lit(x) for x in mutations.SOURCES]), (F.floor(F.col("track_id") / 3) % 3).cast("int"))
    return lib.preferences.select("track_id", F.col("source").alias("old"), new.alias("new")).withColumn("overrides", mutations.overrides(F.col("old"), F.col("new")))



# Matching


@query("er10_artist_levels", "select mapping_id, case when s is null then 'missing' when s >= 1 then 'exact' when mapping_id % 4 = 2 then 'phonetic' when s >= 0.9 then 'high' when s >= 0.7 then 'low' else 'mismatch' end as artist from (select mapping_id, case when confidence % 10 <> 3 then confidence / 100 end as s from track_mappings) z")
def _(lib):
    s = F.when(F.col("confidence") % 10 != 3, F.col("confidence") / 100)
    return lib.track_mappings.select("mapping_id", scoring.artist_level(s, F.col("mapping_id") % 4 == 2).alias("artist"))




def log_ratio(table: dict[str, tuple[float, float]], level: str) -> str:
    return repr(math.log(table[level][0] / table[level][1]))


TABLES = (("title", scoring.TITLE), ("artist", scoring.ARTIST), ("duration", scoring.DURATION), ("isrc", scoring.ISRC))
#: By which number of a line its levels come in turn.
TURNS = {"title": "l_orderkey", "artist": "l_partkey", "duration": "l_suppkey", "isrc": "l_linenumber"}


def level_sql(n: str, table: dict) -> str:
    return f"case {TURNS[n]} % {len(table)} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(table)) + f" end as {n}"


GRADED = f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(level_sql(n, t) for n, t in TABLES)} from lineitem"
GRID = f"from ({GRADED}) g " + " ".join(f"join (values {', '.join(f'({chr(39)}{k}{chr(39)}, {log_ratio(v, k)}::double)' for k in v)}) {n}_t({n}, {n}_w) using ({n})" for n, v in TABLES)


def levels(lib) -> DataFrame:
    """Every line with levels, and the weight of these."""
    return lib.sql(GRADED).withColumn("w", scoring.weight(F.col("title"), F.col("artist"), F.col("duration"), F.col("isrc")))


@query("er13_match_weight", f"select l_orderkey, l_linenumber, title, artist, duration, isrc, round(title_w + artist_w + duration_w + isrc_w, 9) as w {GRID}")
def _(lib):
    return levels(lib).withColumn("w", F.round("w", 9)).drop("l_partkey", "l_suppkey")


@query("er14_weight_to_confidence", f"select l_orderkey, l_linenumber, title, artist, duration, isrc, greatest(0, least(100, round_even(100 / (1 + exp(-(title_w + artist_w + duration_w + isrc_w))), 0)))::int as confidence {GRID}")
def _(lib):
    return levels(lib).select("l_orderkey", "l_linenumber", "title", "artist", "duration", "isrc", scoring.confidence(F.col("w")).alias("confidence"))


APART = "case when a.duration_ms <> 0 and b.duration_ms <> 0 then abs(a.duration_ms - b.duration_ms) end"
PAIRED = "canonicals a join connector_tracks b on b.isrc = a.isrc"


def isrc_pairs(lib) -> DataFrame:
    a = lib.canonicals.select("track_id", "isrc", F.col("duration_ms").alias("a_ms"))
    b = lib.connector_tracks.select(F.col("id").alias("other_id"), "isrc", F.col("duration_ms").alias("b_ms"))
    return block_join(a, b, ["isrc"], "track_id", "other_id").withColumn("apart", scoring.duration_difference(F.col("a_ms"), F.col("b_ms")))


@query("er12_isrc_levels", f"select a.track_id, b.id as other_id, case when a.isrc is distinct from b.isrc then 'absent' when coalesce({APART} > 10000, false) then 'suspect' else 'exact' end as level from canonicals a join connector_tracks b on b.id // 4 = a.track_id")
def _(lib):
    a = lib.canonicals.select("track_id", F.col("isrc").alias("a_isrc"), F.col("duration_ms").alias("a_ms"))
    pairs = a.join(lib.connector_tracks.select(F.col("id").alias("other_id"), F.floor(F.col("id") / 4).alias("track_id"), "isrc", "duration_ms"), "track_id")
    suspect = scoring.isrc_suspect(scoring.duration_difference(F.col("a_ms"), F.col("duration_ms")))
    return pairs.select("track_id", "other_id", scoring.isrc_level(F.col("a_isrc").eqNullSafe(F.col("isrc")), suspect).alias("level"))


@query("er15_isrc_suspect", f"select a.track_id, b.id as other_id, coalesce({APART} > 10000, false) as suspect from {PAIRED}")
def _(lib):
    return isrc_pairs(lib).select("track_id", "other_id", scoring.isrc_suspect(F.col("apart")).alias("suspect"))


@query("er16_duration_difference", f"select a.track_id, b.id as other_id, {APART} as apart from {PAIRED}")
def _(lib):
    return isrc_pairs(lib).select("track_id", "other_id", "apart")


@query("er17_zones", "select m.mapping_id, case when confidence >= 85 then case when coalesce(c.duration_ms, 0) = 0 and method in ('isrc', 'mbid') then 'review' else 'accept' end when confidence < 50 then 'reject' else 'review' end as zone from track_mappings m join connector_tracks c on c.id = m.connector_track_id")
def _(lib):
    rows = lib.track_mappings.join(lib.connector_tracks.select(F.col("id").alias("connector_track_id"), "duration_ms"), "connector_track_id")
    return rows.select("mapping_id", scoring.zone(F.col("confidence"), F.col("method"), F.coalesce("duration_ms", F.lit(0)) == 0).alias("zone"))



@query("er27_looks_dead", "select negative_id from negatives where kind = 'no_match' and misses >= 3 and last_checked_at - created_at >= interval 9 day")
def _(lib):
    return lib.negatives.where(L.looks_dead()).select("negative_id")


@query("er28_suppressing", f"select negative_id from negatives where case kind when 'rejected_pair' then unrejected_at is null else check_again > {T} end")
def _(lib):
    return lib.negatives.where(L.suppressing(NOW)).select("negative_id")


# Imports and polling

GOOD = "event_id % 11 > 2"
URI = "'spotify:track:' || lpad(event_id::varchar, 22, '0')"


def exported(lib) -> DataFrame:
    """Export files, an array of a thousand records each, of which some lack a track, a name or a time."""
    bad = F.col("event_id") % 11
    uri = F.when(bad != 0, F.concat(F.lit("spotify:track:"), F.lpad(F.col("event_id").cast("string"), 22, "0")))
    record = F.to_json(F.struct(
        F.when(bad == 2, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"), uri.alias("spotify_track_uri"), F.when(bad != 1, F.concat(F.lit("Song "), "event_id")).alias("master_metadata_track_name"),
        F.lit("An Artist").alias("master_metadata_album_artist_name"), (F.col("event_id") % 300 * 1000).alias("ms_played"), F.when(F.col("event_id") % 2 == 0, "trackdone").alias("reason_end"), F.when(F.col("event_id") % 3 == 0, F.lit(True)).alias("shuffle"),
    ))
    files = lib.events.groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    path = folder(lib.spark)
    files.write.partitionBy("part").text(path)
    return imports.export_records(lib.spark, f"{path}/*")


@query("imp1_export_records", f"select {URI} as uri, date_trunc('second', ts) as played_at, event_id % 300 * 1000 as ms_played, case when event_id % 2 = 0 then 'trackdone' else '' end as reason_end, event_id % 3 = 0 as shuffle, false as skipped from events where {GOOD}")
def _(lib):
    return exported(lib).select(F.col("spotify_track_uri").alias("uri"), "played_at", "ms_played", "reason_end", "shuffle", "skipped")


@query("imp2_export_observations", f"select 7 as user_id, 'spotify_export' as import_source, lpad(event_id::varchar, 22, '0') as track_identifier, 'Song ' || event_id as track_name, date_trunc('second', ts) as played_at, event_id % 300 * 1000 as ms_played, case when event_id % 2 = 0 then 'trackdone' else '' end as reason_end, 'b1' as import_batch_id from events where {GOOD}")
def _(lib):
    rows = imports.export_observations(exported(lib), 7, "b1", NOW)
    return rows.select("user_id", "import_source", "track_identifier", "track_name", "played_at", "ms_played", F.get_json_object("metadata", "$.reason_end").alias("reason_end"), "import_batch_id")


@query("imp3_windows", "select 'artist ' || k || '::song ' || event_id as track_identifier, ts as played_at, 5 as checkpoints from (select *, json_extract_string(props, '$.k') as k from events) e where ts >= TIMESTAMP '2024-01-01' and ts < TIMESTAMP '2024-01-31'")
def _(lib):
    """Windows of a week, each persisted before the checkpoint moves; neighbours overlap by a day, and what is known isn't taken again."""
    saved, path = [], f"{folder(lib.spark)}/ledger"

    def fetch(start: dt.datetime, end: dt.datetime) -> DataFrame:
        own = lib.events.where((F.col("ts") >= F.lit(start - dt.timedelta(days=1)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        rows = own.select(F.concat(F.lit(" Artist "), F.get_json_object("props", "$.k")).alias("artist"), F.concat(F.lit("Song "), "event_id").alias("title"), F.lit(None).cast("string").alias("album"), F.col("ts").alias("played_at"), F.lit("{}").alias("metadata"))
        return imports.scrobble_observations(rows, 1, "b", NOW)

    imports.import_windows(fetch, path, lib.spark, dt.datetime(2024, 1, 1), NOW, saved.append)
    return lib.spark.read.parquet(path).where("played_at >= timestamp_ntz '2024-01-01'").select("track_identifier", "played_at", F.lit(len(saved)).alias("checkpoints"))


@query("imp7_two_phase", f"{OBSERVED} select count(*) as observations, count_if(track % 9 <> 0) as resolved, count_if(track % 9 = 0) as unresolved, count_if(track % 9 = 1 and id % 20 < 10) as late, 0 as missing, 0 as surplus from obs")
def _(lib):
    """Two imports, each in several chunks; the second one's resolver knows more, so it resolves rows of the first one too. The plays are those of a projection of all that is known, the rest waits."""
    from tracklight.queries.history import differences
    from tracklight.streaming.projection import read_plays

    path, obs = folder(lib.spark), observations(lib).withColumn("connector", F.col("service"))
    track = F.col("track_identifier").cast("long")
    knows = lambda *less: lambda asked: asked.where(~(track % 9).isin(*less)).withColumn("resolved_track_id", track)
    first = imports.two_phase(obs.where(F.col("id") % 20 < 10), knows(0, 1), f"{path}/ledger", f"{path}/plays", 0, 40)
    second = imports.two_phase(obs.where(F.col("id") % 20 >= 10), knows(0), f"{path}/ledger", f"{path}/plays", 1, 40)
    columns = ["play", "track_id", "played_at", "ms_played"]
    found = differences(P.project(obs.where("resolved_track_id % 9 <> 0")).select(*columns), read_plays(lib.spark, f"{path}/plays").select(*columns), "missing", "surplus")
    sums = {"observations": first["observations"] + second["observations"], "resolved": first["resolved"] + second["resolved"], "unresolved": second["unresolved"], "late": first["observations"] - first["resolved"] - lib_open(obs)}
    return found.select(*[F.lit(v).cast("long").alias(k) for k, v in sums.items()], F.col("missing").cast("int").alias("missing"), F.col("surplus").cast("int").alias("surplus"))


def lib_open(obs: DataFrame) -> int:
    """Rows of the first import that no resolver ever knows."""
    return obs.where("id % 20 < 10 and resolved_track_id % 9 = 0").count()


@query("str7_redundant_observer", f"select user_id, coalesce(other_ago <= 604800, false) as redundant from ({STATES}) z")
def _(lib):
    return polling.with_caps(states(lib), NOW).select("user_id", "redundant")



# Plug-ins


@query("fn9_random", "select count(*) as n, true as within, true as spread from plays")
def _(lib):
    """A draw for each row: from 0 to below 1, and about even."""
    own = lib.plays.withColumn("r", F.rand(7))
    return own.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("r") >= 0) & (F.col("r") < 1)).alias("within"), (F.abs(F.avg("r") - 0.5) < 0.05).alias("spread"))


@query("ext1_own_node", placed("track_id", where="track_id % 4 = 0"))
def _(lib):
    W.node("source.every")(lambda env, config, inputs, results: base(env.library).where(F.col("track_id") % config["n"] == 0))
    return run(lib, chain("own", ("source.every", {"n": 4}), ("destination.create_playlist", {"name": "x"}))).final.result("track_id")


@query("ext2_own_transform", placed("track_id", where="length(title) > 8"))
def _(lib):
    W.node("source.all")(lambda env, config, inputs, results: base(env.library))
    W.transform("filter.by_title_length", ("least",))(lambda tracks, config, env: tracks.where(F.length("title") > config["least"]))
    return run(lib, chain("own", ("source.all", {}), ("filter.by_title_length", {"least": 8}), ("destination.create_playlist", {"name": "x"}))).final.result("track_id")


@query("ext3_own_resolver", "select track_id, cast(length(title) as double) as value from tracks")
def _(lib):
    """A resolver's values take the place of stored samples."""
    enrichers.register_metric("title_length", "own")
    enrichers.register_resolver("title_length", lambda library: library.tracks.select("track_id", F.length("title").cast("double").alias("value")))
    return enrichers.external_metrics(base(lib), lib.metrics, ["title_length"], NOW, lib).df.select("track_id", F.col("m_title_length").alias("value"))


@query("ext4_curried", placed("n desc, track_id", HISTORY, "duration_ms between 60000 and 300000", limit=30))
def _(lib):
    steps = (curried(filters.by_duration, 60_000, 300_000), curried(sorters.by_metric, "total_plays"), curried(selectors.first, 30))
    out = history(lib)
    for step in steps:
        out = out.transform(step)
    return ids(out)


@query("ext5_lint", "select workflow_id, warning from (select distinct workflow_id from runs) r, (values (0, 't2: nothing upstream adds play_history'), (0, 't3: nothing upstream adds lastfm_user_playcount'), (1, 't3: nothing upstream adds lastfm_user_playcount')) t(kind, warning) where workflow_id % 3 = kind")
def _(lib):
    """The warnings of stored definitions, one for each workflow that ever ran: without enrichers, with one of two, with both."""
    def definition(*more):
        return json.dumps(chain("lint", ("source.liked_tracks", {}), *more, ("filter.by_play_history", {"min_plays": 1}), ("sorter.by_metric", {"metric_name": "lastfm_user_playcount"}), ("destination.create_playlist", {"name": "x"})))

    plays, metrics = ("enricher.play_history", {"metrics": ["total_plays"]}), ("enricher.lastfm", {})
    texts = [definition(("enricher.tags", {})), definition(plays), definition(plays, metrics)]
    defined = F.get(F.array(*[F.lit(x) for x in texts]), (F.col("workflow_id") % 3).cast("int"))
    return lib.runs.select("workflow_id").distinct().withColumn("definition", defined).select("workflow_id", F.explode(W.lint("definition")).alias("warning"))


