"""Sources, enrichers, filters, sorters, selectors, combiners, sinks and bundled pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.operators import combiners, enrichers, filters, selectors, sorters
from tracklight.plans.ordered import Key, TrackList
from tracklight.plans.workflow import Env, run_template
from tracklight.queries import NOW, T, placed, query
from tracklight.sources import lists, sinks

TOTALS = "(select track_id, count(*) as n, max(played_at) as last_at, min(played_at) as first_at from plays group by track_id)"
HISTORY = f"(select t.*, coalesce(p.n, 0) as n, p.last_at, p.first_at from tracks t left join {TOTALS} p on t.track_id = p.track_id) h"
LIKED = "(select track_id, liked_at from likes where service = 'spotify' and is_liked)"
LIKED_HISTORY = f"(select t.*, l.liked_at, coalesce(p.n, 0) as n, p.last_at, p.first_at from {LIKED} l join tracks t on t.track_id = l.track_id left join {TOTALS} p on p.track_id = t.track_id) h"
METRIC = "(select track_id, max(value) as user_count, max(value) * 2 as global_count from metrics group by track_id)"


def base(lib) -> TrackList:
    return TrackList.source(lib.tracks, Key("track_id"))


def history(lib) -> TrackList:
    return enrichers.play_history(base(lib), lib.plays, NOW, ("total_plays", "last_played_dates", "first_played_dates"))


def ids(t: TrackList) -> DataFrame:
    return t.result("track_id")


# Sources


@query("src1_playlist", "select row_number() over (order by e.position) - 1 as position, t.track_id from entries e join tracks t on t.track_id = e.track_id where e.playlist_id = 3")
def _(lib):
    return ids(lists.playlist(lib.entries, lib.tracks, 3))


@query("src2_liked_tracks", placed("liked_at desc nulls last, track_id", LIKED_HISTORY, limit=500))
def _(lib):
    return ids(lists.liked_tracks(lib.likes, lib.tracks, "spotify", limit=500))


@query("src2b_liked_total", f"select (select count(*) from {LIKED} l join tracks t on t.track_id = l.track_id) as total, (select count(*) from (select * from {LIKED} l limit 500) x) as returned")
def _(lib):
    both = lists.liked_tracks(lib.likes, lib.tracks, "spotify")
    return both.df.agg(F.count(F.lit(1)).alias("total"), F.least(F.count(F.lit(1)), F.lit(500)).alias("returned"))


PLAYED = f"with top as (select *, row_number() over (order by played_at desc, play_id desc) as rank from plays where played_at >= {T} - interval 20 day), kept as (select * from top where rank <= 400 and service = 'spotify'), once as (select track_id, min(rank) as k from kept group by track_id) select row_number() over (order by o.k) - 1 as position, o.track_id, p.n as total_plays, p.last_at as last_played from once o join tracks t on t.track_id = o.track_id join {TOTALS} p on p.track_id = o.track_id"


@query("src3_played_tracks", PLAYED)
def _(lib):
    t = lists.played_tracks(lib.plays, lib.tracks, NOW, 200, 20, "spotify")
    return t.result("track_id", F.col("m_total_plays").alias("total_plays"), F.col("m_last_played_dates").alias("last_played"))


@query("src3b_played_by_total", f"select row_number() over (order by n desc, track_id) - 1 as position, track_id from {TOTALS} p where track_id in (select track_id from tracks) qualify position < 50")
def _(lib):
    return ids(lists.played_tracks(lib.plays, lib.tracks, NOW, 50, sort_by="total_plays_desc"))


@query("src4_preferred_tracks", f"select row_number() over (order by p.last_at desc nulls last, t.track_id desc) - 1 as position, t.track_id from tracks t join preferences f on f.track_id = t.track_id left join {TOTALS} p on p.track_id = t.track_id where f.state = 'star' qualify position < 300")
def _(lib):
    return ids(lists.preferred_tracks(lib.preferences, lib.tracks, lib.plays, "star", 300))


@query("src6_default_limit", "select o_orderkey, least(case when o_orderkey % 4 = 0 then 50000 when o_orderkey % 4 = 1 then 50000 else o_orderkey * 1000 end, 1000000) as n from orders")
def _(lib):
    """Limits that were asked for: none, 0, or a number."""
    return lib.orders.select("o_orderkey", lists.limits(F.expr("case o_orderkey % 4 when 0 then null when 1 then 0 else o_orderkey * 1000 end")).alias("n"))



# Enrichers


@query("enr1_external_metrics", "select t.track_id, u.value as user_count from tracks t left join (select track_id, arg_max(value, (collected_at, value)) as value from metrics where connector = 'lastfm' and metric_type = 'lastfm_user_playcount' and collected_at >= TIMESTAMP '1997-01-01' group by track_id) u on u.track_id = t.track_id")
def _(lib):
    import datetime as dt

    hours = (NOW - dt.datetime(1997, 1, 1)).total_seconds() / 3600
    found = enrichers.latest_metric(lib.metrics, "lastfm", "lastfm_user_playcount", NOW, hours)
    return base(lib).df.join(found, "track_id", "left").select("track_id", F.col("value").alias("user_count"))


@query("enr2_play_history", f"select t.track_id, coalesce(p.n, 0) as total_plays, p.last_at as last_played, p.first_at as first_played, coalesce(q.n, 0) as period_plays from tracks t left join {TOTALS} p on p.track_id = t.track_id left join (select track_id, count(*) as n from plays where played_at between {T} - interval 10 day and {T} group by track_id) q on q.track_id = t.track_id")
def _(lib):
    t = enrichers.play_history(base(lib), lib.plays, NOW, ("total_plays", "last_played_dates", "first_played_dates", "period_plays"), 10)
    return t.df.select("track_id", F.col("m_total_plays").alias("total_plays"), F.col("m_last_played_dates").alias("last_played"), F.col("m_first_played_dates").alias("first_played"), F.col("m_period_plays").alias("period_plays"))


@query("enr3_preferences", "select t.track_id, f.state from tracks t left join preferences f on f.track_id = t.track_id")
def _(lib):
    return enrichers.preferences(base(lib), lib.preferences).df.select("track_id", F.col("x_preference").alias("state"))


@query("enr4_tags", "select t.track_id, g.tags from tracks t left join (select track_id, string_agg(tag, '|' order by tag) as tags from tags group by track_id) g on g.track_id = t.track_id")
def _(lib):
    return enrichers.tags(base(lib), lib.tags).df.select("track_id", F.array_join("x_tags", "|").alias("tags"))


@query("enr5_liked_status", "select t.track_id, l.is_liked as spotify from tracks t left join likes l on l.track_id = t.track_id and l.service = 'spotify'")
def _(lib):
    return enrichers.liked_status(base(lib), lib.likes, ["spotify"]).df.select("track_id", F.try_element_at("x_liked", F.lit("spotify")).alias("spotify"))


@query("enr6_latest_metric", "select track_id, arg_max(value, (collected_at, value)) as value from metrics where metric_type = 'lastfm_global_playcount' and collected_at >= TIMESTAMP '2000-01-31' group by track_id")
def _(lib):
    import datetime as dt

    return enrichers.latest_metric(lib.metrics, "lastfm", "lastfm_global_playcount", dt.datetime(2000, 1, 31), 0)


@query("enr7_extract_metrics", "select play_id as track_id, 'k' as metric_type, cast(json_extract_string(context, '$.k') as double) as value from plays")
def _(lib):
    enrichers.register_metric("k", "events", "k")
    return enrichers.extract_metrics(lib.plays.select(F.col("play_id").alias("track_id"), F.col("context").alias("metadata")), ["k"])


@query("enr8_cache_misses", "with cached as (select track_id, max(value) as value from metrics where metric_type = 'lastfm_user_playcount' and collected_at >= TIMESTAMP '2000-06-01' group by track_id), own as (select distinct track_id from tracks) select track_id, value from cached where track_id in (select track_id from own) union all select o.track_id, cast(o.track_id as double) from own o where o.track_id not in (select track_id from cached)")
def _(lib):
    cached = lib.metrics.where("metric_type = 'lastfm_user_playcount' and collected_at >= timestamp_ntz '2000-06-01'").groupBy("track_id").agg(F.max("value").alias("value"))
    return enrichers.with_misses(lib.tracks, cached, lib.tracks.select("track_id", F.col("track_id").cast("double").alias("value")))


@query("enr9_metric_names", "select track_id, metric_type as name, count(*) as n from metrics where metric_type in ('lastfm_user_playcount', 'lastfm_global_playcount') and connector = 'lastfm' group by 1, 2")
def _(lib):
    """Samples of the metrics that attributes name, with or without the connector in front; unknown ones are left out."""
    names = enrichers.metric_names("lastfm", ["lastfm_user_playcount", "global_playcount", "unknown"])
    return lib.metrics.where((F.col("connector") == "lastfm") & F.col("metric_type").isin(names)).groupBy("track_id", F.col("metric_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))



@query("enr10_registered_metric", f"select t.track_id, u.value from tracks t left join (select track_id, arg_max(value, (collected_at, value)) as value from metrics where metric_type = 'lastfm_user_playcount' and collected_at >= {T} - interval 12 hour group by 1) u on u.track_id = t.track_id")
def _(lib):
    """A metric that is registered with a freshness of its own."""
    enrichers.register_metric("listens", "own", "plays", 12.0)
    samples = lib.metrics.where("metric_type = 'lastfm_user_playcount'").withColumns({"connector": F.lit("own"), "metric_type": F.lit("listens")})
    return enrichers.external_metrics(base(lib), samples, ["listens"], NOW).df.select("track_id", F.col("m_listens").alias("value"))



# Filters

AGE = f"floor(epoch({T} - release_date) / 86400)"
REFERENCE = "(select * from tracks where track_id % 3 = 0 and track_id % 50 = 0)"


def reference(lib) -> DataFrame:
    return lib.tracks.where("track_id % 3 = 0 and track_id % 50 = 0")


def repeated(lib) -> TrackList:
    return TrackList.source(lib.entries.where("track_id is not null").join(lib.tracks, "track_id"), Key("added_at"), Key("playlist_id"), Key("position"))


for name, where, make in (
    ("flt0_predicate", "duration_ms > 200000", lambda t, lib: t.where(F.col("duration_ms") > 200_000)),
    ("flt2_release_date", f"{AGE} between 100 and 400", lambda t, lib: filters.by_release_date(t, NOW, 100, 400)),
    ("flt3_release_year", "case when release_date is null then true else year(release_date) >= 2023 end", lambda t, lib: filters.by_release_year(t, 2023, None, True)),
    ("flt4_by_tracks", f"track_id not in (select track_id from {REFERENCE})", lambda t, lib: filters.by_tracks(t, reference(lib))),
    ("flt5_by_artists", f"lower(artist) not in (select lower(artist) from {REFERENCE})", lambda t, lib: filters.by_artists(t, reference(lib))),
    ("flt5_by_all_artists", f"not list_has_any(list_transform(artists, lambda x: lower(x)), (select list(distinct lower(a)) from (select unnest(artists) as a from tracks where track_id = 0)))", lambda t, lib: filters.by_artists(t, lib.tracks.where("track_id = 0"), True)),
    ("flt6_duration", "coalesce(duration_ms between 60000 and 300000, true)", lambda t, lib: filters.by_duration(t, 60_000, 300_000, True)),
    ("flt9_explicit", "coalesce(explicit, 0) <> 0", lambda t, lib: filters.by_explicit(t, "explicit")),
    ("flt9_clean", "coalesce(explicit, 0) = 0", lambda t, lib: filters.by_explicit(t, "clean")),
    ("flt18_require_saved", "true", lambda t, lib: filters.require_saved(t)),
):
    query(name, placed("track_id", where=where))(lambda lib, make=make: ids(make(base(lib), lib)))

for name, where, config in (
    ("flt10_play_history", f"n between 2 and 105 and last_at < {T} - interval 12 hour", {"min_plays": 2, "max_plays": 105, "end_date": "2024-01-30 12:00:00"}),
    ("flt10_played_within", f"coalesce(last_at >= {T} - interval 2 day, true)", {"played_within_days": 2, "include_missing": True}),
    ("flt10_end_date_wins", "last_at < TIMESTAMP '2024-01-30 20:00:00'", {"not_played_in_days": 400, "end_date": "2024-01-30 20:00:00"}),
    ("flt11_first_played", "first_at >= TIMESTAMP '2024-01-01 06:00:00'", {"start_date": "2024-01-01 06:00:00", "date_source": "first_played"}),
):
    query(name, placed("track_id", HISTORY, where))(lambda lib, config=config: ids(filters.by_play_history(history(lib), NOW, **config)))


@query("flt1_deduplicate", placed("added_at, playlist_id, position", "(select e.added_at, e.playlist_id, e.position as p, t.track_id, row_number() over (partition by t.track_id order by e.added_at, e.playlist_id, e.position) as k from entries e join tracks t on t.track_id = e.track_id) z", "k = 1").replace("added_at, playlist_id, position)", "added_at, playlist_id, p)"))
def _(lib):
    return ids(filters.deduplicate(repeated(lib)))


@query("flt7_liked_status", placed("track_id", "(select t.track_id, coalesce(l.is_liked, false) as liked from tracks t left join likes l on l.track_id = t.track_id and l.service = 'lastfm') z", "not liked"))
def _(lib):
    return ids(filters.by_liked_status(enrichers.liked_status(base(lib), lib.likes), "lastfm", False))


@query("flt8_metric_range", placed("track_id", f"(select t.track_id, m.user_count from tracks t left join {METRIC} m on m.track_id = t.track_id) z", "coalesce(user_count between 20000 and 95000, true)"))
def _(lib):
    m = lib.metrics.groupBy("track_id").agg(F.max("value").alias("m_user_count"))
    return ids(filters.by_metric(base(lib).with_df(lib.tracks.join(m, "track_id", "left")), "user_count", 20_000, 95_000, True))


@query("flt12_preference_include", placed("track_id", where="track_id in (select track_id from preferences where state in ('yah', 'star'))"))
def _(lib):
    return ids(filters.by_preference(enrichers.preferences(base(lib), lib.preferences), ["yah", "star", "unknown"]))


@query("flt12_preference_exclude", placed("track_id", where="track_id not in (select track_id from preferences where state = 'nah')"))
def _(lib):
    return ids(filters.by_preference(enrichers.preferences(base(lib), lib.preferences), exclude=["nah"]))


@query("flt13_tag_any", placed("track_id", where="track_id in (select track_id from tags where tag in ('gym', 'mood:loud'))"))
def _(lib):
    return ids(filters.by_tag(enrichers.tags(base(lib), lib.tags), [" GYM", "mood:loud"]))


@query("flt13_tag_all", placed("track_id", where="track_id in (select track_id from tags where tag in ('gym', 'mood:chill') group by track_id having count(distinct tag) = 2)"))
def _(lib):
    return ids(filters.by_tag(enrichers.tags(base(lib), lib.tags), ["gym", "mood:chill", "gym"], "all"))


@query("flt14_tag_namespace", placed("track_id", where="track_id in (select track_id from tags where tag in ('mood:chill', 'mood:loud'))"))
def _(lib):
    return ids(filters.by_tag_namespace(enrichers.tags(base(lib), lib.tags), "mood", [" Chill", "loud"]))


@query("flt17_lenient_time", "select event_id, case event_id % 3 when 0 then ts when 1 then TIMESTAMP '1970-01-01' + to_seconds(event_id) else null end as parsed from events")
def _(lib):
    from tracklight.functions.scalars import lenient_time

    text = F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).otherwise("no date")
    return lib.events.select("event_id", lenient_time(text).cast("timestamp_ntz").alias("parsed"))


WINDOWS = ((None, None), (21, None), (None, 26), (21, 15), (2, 26))


@query("flt15_time_window", " union all ".join(f"select {k} as k, track_id, count(*) as plays from plays where {'true' if a is None else f"played_at >= TIMESTAMP '2024-01-{a:02d}'"} and {'true' if b is None else f"played_at < TIMESTAMP '2024-01-{b:02d}'"} group by 2" for k, (a, b) in enumerate(WINDOWS)))
def _(lib):
    """Plays in the windows that settings name, alone and against each other."""
    from tracklight.functions.scalars import in_window, time_window

    cases = ({}, {"played_within_days": 10, "start_date": "2023-01-01"}, {"not_played_in_days": 5}, {"played_within_days": 10, "not_played_in_days": 5, "end_date": "2024-01-15"}, {"start_date": "2024-01-02T00:00:00+00:00", "not_played_in_days": 5})
    inside = [F.when(in_window(F.col("played_at"), *time_window(NOW, **c)), F.lit(k)) for k, c in enumerate(cases)]
    return lib.plays.select("track_id", F.explode(F.array_compact(F.array(*inside))).alias("k")).groupBy("k", "track_id").agg(F.count(F.lit(1)).alias("plays"))



# Sorters

for name, order, make in (
    ("srt1_attribute_title", "coalesce(title, '') desc, track_id", lambda t, lib: sorters.by_metric(t, "title")),
    ("srt1_attribute_duration", "coalesce(duration_ms, 0), track_id", lambda t, lib: sorters.by_metric(t, "duration", False)),
    ("srt6_release_date", "release_date nulls last, track_id", lambda t, lib: sorters.by_release_date(t)),
    ("srt7_reverse", "release_date desc nulls first, track_id desc", lambda t, lib: sorters.reverse(sorters.by_release_date(t))),
    ("srt0_stable_stack", "album, artist desc, track_id", lambda t, lib: t.sort(F.col("artist"), True).sort(F.col("album"))),
):
    query(name, placed(order))(lambda lib, make=make: ids(make(base(lib), lib)))

for name, order, make in (
    ("srt2_external_metric", "n desc nulls last, track_id", lambda t: sorters.by_metric(t, "total_plays")),
    ("srt3_play_history", f"case when last_at >= {T} - interval 2 day then n else 0 end desc, track_id", lambda t: sorters.by_play_history(t, NOW, played_within_days=2)),
    ("srt3_all_plays_ascending", "n, track_id", lambda t: sorters.by_play_history(t, NOW, False)),
    ("srt5_last_played", "last_at nulls last, track_id", lambda t: sorters.by_date(t, "last_played")),
    ("srt5_first_played", "first_at desc nulls last, track_id", lambda t: sorters.by_date(t, "first_played", False)),
    ("srt1_named_date", "last_at desc nulls last, track_id", lambda t: sorters.by_metric(t, "last_played_date")),
):
    query(name, placed(order, HISTORY))(lambda lib, make=make: ids(make(history(lib))))


@query("srt4_preference", placed("coalesce(rank, -1) desc, track_id", "(select t.track_id, case f.state when 'nah' then 0 when 'hmm' then 1 when 'yah' then 2 when 'star' then 3 end as rank from tracks t left join preferences f on f.track_id = t.track_id) z"))
def _(lib):
    return ids(sorters.by_preference(enrichers.preferences(base(lib), lib.preferences)))


@query("srt5_added_at", placed("liked_at desc nulls last, liked_at desc, track_id", LIKED_HISTORY))
def _(lib):
    return ids(sorters.by_date(lists.liked_tracks(lib.likes, lib.tracks, "spotify"), "added_at", False))


@query("srt1c_metric_kinds", "select name, kind, count(*) as n from (select metric_type as name, 'external' as kind from metrics union all select 'title', 'attribute' from tracks union all select 'total_plays', 'history' from plays) z group by 1, 2")
def _(lib):
    """What kind each name is that samples, tracks and plays can be sorted by."""
    names = lib.metrics.select(F.col("metric_type").alias("name")).unionByName(lib.tracks.select(F.lit("title").alias("name"))).unionByName(lib.plays.select(F.lit("total_plays").alias("name")))
    return names.groupBy("name", sorters.metric_kinds(F.col("name")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))



@query("srt8_shuffle_none", placed("track_id"))
def _(lib):
    return ids(sorters.weighted_shuffle(base(lib), 0))


DRAW = "(('0x' || substr(md5(concat_ws(':', '{}', track_id, p)), 1, 12))::bigint / 281474976710656)"
PLACES = "(select *, row_number() over (order by track_id) - 1 as p, count(*) over () as many from tracks) z"


@query("srt8_weighted_shuffle", f"select row_number() over (order by 0.5::double * p / many + 0.5::double * {DRAW.format(3)}, p) - 1 as position, track_id from {PLACES}")
def _(lib):
    return ids(sorters.weighted_shuffle(base(lib), 0.5, seed=3))


# Selectors

for name, sql, make in (
    ("sel1_first", placed("track_id", limit=17), lambda t: selectors.first(t, 17)),
    ("sel1_negative", "select row_number() over (order by track_id) - 1 as position, track_id from tracks qualify position < (select count(*) from tracks) - 5", lambda t: selectors.first(t, -5)),
    ("sel2_last", "select row_number() over (order by track_id) - 1 as position, track_id from (select track_id from tracks order by track_id desc limit 9) z", lambda t: selectors.last(t, 9)),
    ("sel2_last_none", "select 0::bigint as position, track_id from tracks where false", lambda t: selectors.last(t, 0)),
    ("sel4_by_method", placed("track_id", limit=4), lambda t: selectors.by_method(t, 4, "first")),
    ("sel5_percentage", "select row_number() over (order by track_id) - 1 as position, track_id from tracks qualify position < greatest(1, round_even((select count(*) from tracks) * 12.5 / 100, 0))", lambda t: selectors.by_percentage(t, 12.5)),
    ("sel5_percentage_zero", placed("track_id", limit=1), lambda t: selectors.by_percentage(t, 0.0)),
):
    query(name, sql)(lambda lib, make=make: ids(make(base(lib))))


@query("sel3_sample", f"select row_number() over (order by {DRAW.format(5)}, p) - 1 as position, track_id from {PLACES} qualify position < 25")
def _(lib):
    return ids(selectors.sample(base(lib), 25, seed=5))


# Combiners


def three(lib) -> list[TrackList]:
    """Liked tracks, starred ones, and all."""
    liked = lib.tracks.join(lib.likes.where("service = 'spotify' and is_liked"), "track_id", "left_semi")
    starred = lib.tracks.join(lib.preferences.where("state = 'star'"), "track_id", "left_semi")
    return [TrackList.source(df, Key("album"), Key("track_id")) for df in (liked, starred, lib.tracks)]


PARTS = " union all ".join(f"(select {k} as l, track_id, row_number() over (order by album, track_id) - 1 as p from tracks where {where})" for k, where in enumerate((f"track_id in (select track_id from {LIKED})", "track_id in (select track_id from preferences where state = 'star')", "true")))
ONCE = f"(select *, row_number() over (partition by track_id order by {{}}) as k from ({PARTS}) y) z"


@query("cmb1_concatenate", f"select row_number() over (order by l, p) - 1 as position, track_id from ({PARTS}) z")
def _(lib):
    return ids(combiners.concatenate(three(lib)))


@query("cmb1_concatenate_once", f"select row_number() over (order by l, p) - 1 as position, track_id from {ONCE.format('l, p')} where k = 1")
def _(lib):
    return ids(combiners.concatenate(three(lib), True))


@query("cmb2_interleave", f"select row_number() over (order by p, l) - 1 as position, track_id from ({PARTS}) z")
def _(lib):
    return ids(combiners.interleave(three(lib)))


@query("cmb2_interleave_stop", f"select row_number() over (order by p, l) - 1 as position, track_id from ({PARTS}) z where p < (select min(n) from (select count(*) as n from ({PARTS}) y group by l) x)")
def _(lib):
    return ids(combiners.interleave(three(lib), stop_on_empty=True))


@query("cmb3_intersect", f"with parts as ({PARTS}) select row_number() over (order by p) - 1 as position, track_id from parts where l = 0 and track_id in (select track_id from parts where l = 1) and track_id in (select track_id from parts where l = 2)")
def _(lib):
    return ids(combiners.intersect(three(lib)))


# Sinks


@query("snk3_appendable", "select position, track_id from entries e where e.playlist_id = 4 and (e.track_id is null or e.track_id not in (select track_id from entries where playlist_id = 3 and track_id is not null))")
def _(lib):
    part = lambda k: lib.entries.where(F.col("playlist_id") == k)
    return sinks.appendable(part(3), part(4)).select("position", "track_id")


@query("snk4_render", "select playlist_id, 'List ' || playlist_id || ': ' || count(*) || ' 2024-01-31 00:00' as name from entries group by 1")
def _(lib):
    """A name for each playlist from its own template."""
    sizes = lib.entries.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("playlist_id", sinks.rendered(F.concat(F.lit("List "), "playlist_id", F.lit(": {track_count} {datetime}")), F.col("n"), NOW).alias("name"))



@query("snk5_reconcile", "with old as (select track_id, arg_max(added_at, playlist_id * 1000000 + position) as kept from entries where track_id is not null and playlist_id % 2 = 0 group by track_id) select n.playlist_id, n.position, n.track_id, coalesce(o.kept, n.added_at) as added_at from entries n left join old o on o.track_id = n.track_id")
def _(lib):
    old = lib.entries.where("playlist_id % 2 = 0").withColumn("position", F.col("playlist_id") * 1_000_000 + F.col("position"))
    return sinks.reconcile(old, lib.entries).select("playlist_id", "position", "track_id", "added_at")


SHIFTED = "select playlist_id, position, case when position % 3 = 0 then track_id + 1 else track_id end as track_id, added_at from entries"
MEMBER = "row_number() over (partition by playlist_id, coalesce('t:' || track_id, 'c:') order by position) as turn, coalesce('t:' || track_id, 'c:') as member"


@query("snk6_rewrite_entries", f"with a as (select *, {MEMBER} from entries), b as (select *, {MEMBER} from ({SHIFTED}) s) select case when a.member is null then 'create' when b.member is null then 'delete' else 'keep' end as action, count(*) as n from a full join b using (playlist_id, member, turn) group by 1")
def _(lib):
    new = lib.entries.withColumn("track_id", F.when(F.col("position") % 3 == 0, F.col("track_id") + 1).otherwise(F.col("track_id"))).withColumn("record_id", F.lit(None).cast("long"))
    old = lib.entries.withColumn("record_id", F.monotonically_increasing_id())
    return sinks.rewrite_entries(old, new).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("snk8_insert_ignore", "select distinct user_id, track_id, ms_played from plays p where play_id % 2 = 1 and not exists (select 1 from plays o where o.play_id % 2 = 0 and o.user_id = p.user_id and o.track_id = p.track_id and o.ms_played is not distinct from p.ms_played)")
def _(lib):
    own = lib.plays.select("user_id", "track_id", "ms_played", "play_id")
    out = sinks.insert_ignore(own.where("play_id % 2 = 0"), own.where("play_id % 2 = 1"), ["user_id", "track_id", "ms_played"])
    return out.select("user_id", "track_id", "ms_played")


@query("snk9_upsert", "select track_id, case when track_id % 4 = 0 then 'new' else title end as title, case when track_id % 4 = 0 and coalesce(duration_ms, 0) > 100000 then -1 else duration_ms end as duration_ms from tracks where track_id % 8 <> 0 or coalesce(duration_ms, 0) > 100000 or true")
def _(lib):
    rows = lib.tracks.select("track_id", "title", "duration_ms")
    new = rows.where("track_id % 4 = 0").withColumns({"title": F.lit("new")}).withColumn("duration_ms", F.when(F.coalesce("duration_ms", F.lit(0)) > 100_000, F.lit(-1).cast("long")).otherwise(F.col("duration_ms")))
    return sinks.upsert(rows, new, ["track_id"])


# Bundled pipelines


class Instead:
    """A library with some tables in place of its own."""

    def __init__(self, lib, **own) -> None:
        self.lib, self.own = lib, own

    def __getattr__(self, name: str):
        return self.own[name] if name in self.own else getattr(self.lib, name)


def shared(lib) -> Instead:
    """Playlist 2 is all liked tracks, so that playlist 1 has tracks in common with it."""
    liked = lib.likes.where("service = 'spotify' and is_liked").select(F.lit(2).cast("long").alias("playlist_id"), F.col("track_id").cast("long").alias("position"), "track_id", F.col("liked_at").alias("added_at"))
    return Instead(lib, entries=lib.entries.where("playlist_id <> 2").unionByName(liked))


def earlier(lib) -> Instead:
    """Tracks are eight years older, so that they are of the 2010s."""
    return Instead(lib, tracks=lib.tracks.withColumn("release_date", F.expr("release_date - interval 8 years")))


DATA = {"common_ground": shared, "decade_deep_cuts": earlier}


def template(name: str):
    return lambda lib: run_template(name, Env(DATA.get(name, lambda x: x)(lib), NOW, seed=1)).result("track_id")


WINDOW_N = f"case when last_at >= {T} - interval {{}} day then n else 0 end"
SOLD = {
    "wf_common_ground": ("common_ground", f"select row_number() over (order by e.position desc) - 1 as position, t.track_id from entries e join tracks t on t.track_id = e.track_id where e.playlist_id = 1 and t.track_id in (select track_id from {LIKED}) and t.duration_ms between 60000 and 600000"),
    "wf_current_obsessions": ("current_obsessions", placed(WINDOW_N.format(30) + " desc, liked_at desc, track_id", LIKED_HISTORY, f"n >= 8 and last_at >= {T} - interval 30 day", limit=20)),
    "wf_decade_deep_cuts": ("decade_deep_cuts", placed("n, liked_at desc, track_id", LIKED_HISTORY, "year(release_date - interval 8 year) between 2010 and 2019 and n <= 4", limit=30)),
    "wf_forgotten_favorites": ("forgotten_favorites", placed("first_at nulls last, liked_at desc, track_id", LIKED_HISTORY, f"n >= 5 and last_at < {T} - interval 1 day", limit=30)),
    "wf_hidden_gems": ("hidden_gems", placed("n desc, liked_at desc, track_id", LIKED_HISTORY, f"n >= 3 and last_at < {T} - interval 1 day", limit=25)),
    "wf_liked_tracks_hidden_gems": ("liked_tracks_hidden_gems", placed("n, liked_at desc, track_id", LIKED_HISTORY, f"n >= 3 and last_at < {T} - interval 1 day", limit=25)),
    "wf_hidden_gems_starred": ("hidden_gems_starred", placed("n desc, last_at desc nulls last, track_id desc", HISTORY, f"track_id in (select track_id from preferences where state = 'star') and n >= 3 and last_at < {T} - interval 1 day", limit=25)),
    "wf_starred_forgotten": ("starred_forgotten", f"with src as (select * from {HISTORY} where track_id in (select track_id from preferences where state = 'star') order by last_at desc nulls last, track_id desc limit 2000) " + placed("n, last_at desc nulls last, track_id desc", "src", f"coalesce(last_at < {T} - interval 1 day, true)", limit=40)),
    "wf_no_nah_mix": ("no_nah_mix", placed("liked_at desc, track_id", LIKED_HISTORY, "track_id not in (select track_id from preferences where state = 'nah')", limit=100)),
    "wf_recent_additions_unplayed": ("recent_additions_unplayed", f"with src as (select * from {LIKED_HISTORY} where n <= 2) select row_number() over (order by liked_at desc, track_id) - 1 as position, track_id from src qualify position < greatest(1, round_even((select count(*) from src) * 0.2, 0))"),
    "wf_sort_by_release_date": ("sort_by_release_date", "select row_number() over (order by t.release_date nulls last, e.position) - 1 as position, t.track_id from entries e join tracks t on t.track_id = e.track_id where e.playlist_id = 3"),
    "wf_play_history_obsessions": ("play_history_obsessions", f"with top as (select track_id, min(rank) as k from (select track_id, row_number() over (order by played_at desc, play_id desc) as rank from plays where played_at >= {T} - interval 60 day) r where rank <= 20000 group by track_id) select row_number() over (order by case when p.last_at >= {T} - interval 30 day then p.n else 0 end desc, o.k) - 1 as position, t.track_id from top o join tracks t on t.track_id = o.track_id join {TOTALS} p on p.track_id = o.track_id where p.n >= 8 and p.last_at >= {T} - interval 30 day qualify position < 30"),
}
for name, (source, sql) in SOLD.items():
    query(name, sql)(template(source))
FRESH = f"(select track_id, arg_max(value, (collected_at, value)) as value from metrics where metric_type = 'lastfm_{{}}_playcount' and collected_at >= {T} - interval 24 hour group by track_id)"
LISTED = "(select t.track_id, artists, release_date, e.position as place, u.value as u, g.value as g, coalesce(l.is_liked, false) as liked from entries e join tracks t on t.track_id = e.track_id left join {u} u on u.track_id = t.track_id left join {g} g on g.track_id = t.track_id left join likes l on l.track_id = t.track_id and l.service = 'spotify' where e.playlist_id = {n}) s"


def listed(n: int) -> str:
    return LISTED.format(n=n, u=FRESH.format("user"), g=FRESH.format("global"))


def mix(playlists: range, excluded: range, max_age_days: int, each: int) -> str:
    """The discovery pipelines: recent tracks of some playlists, without the tracks of others and the artists of the last of these."""
    tops = " union all ".join(f"select {k} as l, * from (select *, row_number() over (order by place) as turn from {listed(p)} where {AGE} <= {max_age_days}) z where turn <= {each}" for k, p in enumerate(playlists))
    known = f"select track_id from entries where playlist_id between {excluded[0]} and {excluded[-1]} and track_id is not null"
    strange = f"not list_has_any(list_transform(artists, lambda a: lower(a)), (select coalesce(list(distinct lower(a)), []) from (select unnest(artists) as a from {listed(excluded[-1])}) y))"
    return f"with tops as ({tops}), once as (select * from tops qualify row_number() over (partition by track_id order by l, turn) = 1) select row_number() over (order by g desc nulls last, l, turn) - 1 as position, track_id from once where track_id not in ({known}) and {strange}"


RECENT = f"(select track_id, min(rank) as k from (select track_id, row_number() over (order by played_at desc, play_id desc) as rank from plays where played_at >= {T} - interval 90 day) r where rank <= 6000 group by track_id)"
COMPOSED = f"""with old as (select track_id, row_number() over (order by liked_at desc nulls last, track_id) as turn from (select * from {LIKED_HISTORY} order by liked_at desc nulls last, track_id limit 2000) s where n between 2 and 110 and coalesce(last_at < {T} - interval 1 day, true)),
  new as (select s.track_id, row_number() over (order by k) as turn from (select r.* from {RECENT} r join tracks t on t.track_id = r.track_id order by k limit 3000) s join {TOTALS} p on p.track_id = s.track_id where p.n between 1 and 115 and p.last_at >= {T} - interval 90 day),
  once as (select * from (select *, 0 as l from old union all select *, 1 from new) m qualify row_number() over (partition by track_id order by turn, l) = 1)
  select row_number() over (order by coalesce({WINDOW_N.format(90)}, 0), turn, l) - 1 as position, o.track_id from once o left join {TOTALS} p on p.track_id = o.track_id qualify position < 40"""
BY_METRIC = {
    "mood_playlist": f"with s as (select *, row_number() over (order by last_at desc nulls last, track_id desc) as r from {HISTORY} where track_id in (select track_id from preferences where state = 'yah')), k as (select track_id, row_number() over (order by r) - 1 as p, count(*) over () as many from s where r <= 1000 and track_id in (select track_id from tags where tag = 'mood:chill')) select row_number() over (order by (1 - 0.8::double) * p / many + 0.8::double * {DRAW.format(1)}, p) - 1 as position, track_id from k qualify position < 60",
    "rediscovery_candidates": f"with k as (select track_id, row_number() over (order by coalesce(release_date, TIMESTAMP '0001-01-01'), liked_at desc nulls last, track_id) - 1 as p from {LIKED_HISTORY} where n between 1 and 102) select row_number() over (order by {DRAW.format(1)}, p) - 1 as position, track_id from k qualify position < 50",
    "discovery_mix_composition": COMPOSED,
    "latest_discovery_mix": mix(range(10, 19), range(20, 24), 600, 5),
    "recent_discovery_mix": mix(range(30, 39), range(40, 44), 400, 4),
    "likely_suspects": f"select row_number() over (order by g desc nulls last, place) - 1 as position, track_id from {listed(5)} where not liked",
    "sort_by_global_playcount": f"select row_number() over (order by g desc nulls last, place) - 1 as position, track_id from {listed(6)}",
    "sort_by_user_playcount": f"select row_number() over (order by u desc nulls last, place) - 1 as position, track_id from {listed(7)} where u >= 1",
    "sort_lingering_by_playcount": f"select row_number() over (order by u desc nulls last, place) - 1 as position, track_id from {listed(4)} where u >= 1",
}
for source, sql in BY_METRIC.items():
    query(f"wf_{source}", sql)(template(source))
