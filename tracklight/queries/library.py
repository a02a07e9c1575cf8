"""Listing, lookups, aggregates, windows, integrity and table merges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tracklight.functions.scalars import Cursor, decode_cursor, decode_cursors, encode_cursor, encode_cursors
from tracklight.operators import library as L
from tracklight.operators import mutations as M
from tracklight.queries import NOW, T, query
from tracklight.sources.clustered import ClusteredCopy
from tracklight.sources.scratch import folder

TOTALS = "(select track_id, count(*) as play_count, max(played_at) as last_played_at, min(played_at) as first_played_at from plays group by track_id)"
LISTED = f"(select t.*, coalesce(p.play_count, 0) as play_count, p.last_played_at, p.first_played_at from tracks t left join {TOTALS} p on p.track_id = t.track_id) h"
LIVE = "(select * from mappings where not is_retired) m"
FILTERS = {
    "query": (L.Filters(query="Brand#1"), "array_to_string(artists, '|') ilike '%brand#1%'"),
    "words": (L.Filters(query="blue", min_plays=0), "title ilike '%blue%' or album ilike '%blue%'"),
    "artists": (L.Filters(query="guest 7"), "title ilike '%guest 7%' or album ilike '%guest 7%' or array_to_string(artists, ' ') ilike '%guest 7%'"),
    "liked": (L.Filters(liked=True, preference="star"), "track_id in (select track_id from likes where is_liked) and track_id in (select track_id from preferences where state = 'star')"),
    "unliked": (L.Filters(liked=False, preference="unrated"), "track_id not in (select track_id from likes where is_liked) and track_id not in (select track_id from preferences)"),
    "connector": (L.Filters(connector="spotify", namespace="mood"), f"track_id in (select track_id from {LIVE} where connector = 'spotify') and track_id in (select track_id from tags where tag like 'mood:%')"),
    "tags_and": (L.Filters(tags=("gym", "mood:chill", "gym")), "track_id in (select track_id from tags where tag in ('gym', 'mood:chill') group by 1 having count(distinct tag) = 2)"),
    "tags_or": (L.Filters(tags=("gym", "mood:chill"), tag_mode="or"), "track_id in (select track_id from tags where tag in ('gym', 'mood:chill'))"),
    "plays": (L.Filters(min_plays=3, played_within_days=5), f"play_count >= 3 and last_played_at >= {T} - interval 5 day"),
    "stale": (L.Filters(not_played_within_days=1), f"last_played_at < {T} - interval 1 day"),
    "never": (L.Filters(never_played=True), "play_count = 0"),
}
for name, (narrow, where) in FILTERS.items():
    query(f"lst1_{name}", f"select track_id from {LISTED} where {where}")(lambda lib, f=narrow: L.matching(L.with_totals(lib.tracks, lib.plays), f, lib, NOW).select("track_id"))

ORDERS = {"title_asc": "title nulls last, track_id", "artist_desc": "artist desc nulls last, track_id desc", "added_desc": "created_at desc nulls last, track_id desc", "duration_asc": "duration_ms nulls last, track_id", "last_played_desc": "last_played_at desc nulls last, track_id desc", "last_played_asc": "last_played_at nulls last, track_id"}
for name, order in ORDERS.items():
    query(f"lst2_{name}", f"select track_id from {LISTED} order by {order} limit 40 offset 20")(lambda lib, s=name: L.page(L.with_totals(lib.tracks, lib.plays), s, 40, 20).select("track_id"))
SEEKS = {
    "duration_desc": (Cursor("duration_ms", 200_000, 900), "duration_ms < 200000 or (duration_ms = 200000 and track_id < 900) or duration_ms is null", "duration_ms desc nulls last, track_id desc"),
    "duration_null_tail": (Cursor("duration_ms", None, 500), "duration_ms is null and track_id < 500", "duration_ms desc nulls last, track_id desc"),
    "title_asc": (Cursor("title", "red", 10), "title > 'red' or (title = 'red' and track_id > 10) or title is null", "title nulls last, track_id"),
}
for name, (cursor, where, order) in SEEKS.items():
    query(f"lst2_seek_{name}", f"select track_id from {LISTED} where {where} order by {order} limit 30")(lambda lib, c=cursor, s="title_asc" if "title" in name else "duration_desc": L.page(L.with_totals(lib.tracks, lib.plays), s, 30, after=c).select("track_id"))


def copied(lib, sort_by: str) -> ClusteredCopy:
    copy = ClusteredCopy(lib.spark, folder(lib.spark), sort_by)
    copy.put(L.with_totals(lib.tracks, lib.plays), 16)
    return copy


DEEP = "(select count(*) * 3 // 4 from tracks)"


@query("lst2_deep_page", f"select track_id, last_played_at from (select *, row_number() over (order by {ORDERS['last_played_desc']}) as place from {LISTED}) z where place > {DEEP} and place <= {DEEP} + 50")
def _(lib):
    """A page three quarters down the whole library, from a copy in its order."""
    copy = copied(lib, "last_played_desc")
    return copy.page(50, copy.total() * 3 // 4).select("track_id", "last_played_at")


@query("lst2_deep_seek", f"select track_id, title from {LISTED} where title > 'red' or (title = 'red' and track_id > 10) or title is null order by {ORDERS['title_asc']} limit 50")
def _(lib):
    return copied(lib, "title_asc").page(50, after=Cursor("title", "red", 10)).select("track_id", "title")


@query("lst3", f"select h.track_id, h.title, h.play_count, h.track_id in (select track_id from likes where is_liked) as liked, f.state as preference, (select string_agg(distinct tag, '|' order by tag) from tags g where g.track_id = h.track_id) as tags from {LISTED} left join preferences f on f.track_id = h.track_id where h.play_count >= 1 order by h.last_played_at desc nulls last, h.track_id desc limit 50")
def _(lib):
    found = L.matching(L.with_totals(lib.tracks, lib.plays), L.Filters(min_plays=1), lib, NOW)
    return L.attach(L.page(found), lib).select("track_id", "title", "play_count", "liked", "preference", F.array_join("tags", "|").alias("tags"))


@query("lst3_total_and_cursor", f"select (select count(*) from tracks) as total, 'duration_ms' as cursor_column, (select track_id from tracks order by duration_ms desc nulls last, track_id desc limit 1 offset 19) as cursor_id")
def _(lib):
    found = L.list_tracks(lib, NOW, sort_by="duration_desc", limit=20)
    c = decode_cursor(found.next_cursor)
    return lib.spark.createDataFrame([(found.total, c.column, c.id)], "total long, cursor_column string, cursor_id long")


CURSOR = "replace(replace(base64(encode('{\"c\": \"title\", \"v\": ' || to_json(title)::varchar || ', \"id\": ' || track_id || '}')), '+', '-'), '/', '_')"


@query("lst4_cursor_round_trip", f"select track_id, {CURSOR} as cursor, 'title' as c, title as v, track_id::varchar as id from tracks")
def _(lib):
    """A cursor for each track, and what it says when it is read."""
    rows = lib.tracks.select("track_id", encode_cursors("title", F.col("title"), F.col("track_id")).alias("cursor")).withColumn("read", decode_cursors(F.col("cursor")))
    return rows.select("track_id", "cursor", F.col("read.column").alias("c"), F.col("read.value").alias("v"), F.col("read.id").alias("id"))



@query("lst6_play_events", "select play_id, played_at from plays where service = 'spotify' and played_at < TIMESTAMP '2024-01-20' and (played_at, play_id) < (TIMESTAMP '2024-01-15 12:00:00', 4000) order by played_at desc, play_id desc limit 31")
def _(lib):
    return L.play_events(lib.plays, 30, (dt.datetime(2024, 1, 15, 12), 4000), until=dt.datetime(2024, 1, 20), service="spotify").select("play_id", "played_at")


RECENT = {
    "played_at_desc": "select play_id, row_number() over (order by played_at desc, play_id desc) as rank from plays qualify rank <= 30",
    "first_played_asc": "select play_id, row_number() over (order by played_at, play_id) as rank from plays qualify rank <= 30",
    "last_played_desc": "select play_id, row_number() over (order by played_at desc, play_id desc) as rank from (select * from plays qualify row_number() over (partition by track_id order by played_at desc, play_id desc) = 1) z qualify rank <= 30",
    "total_plays_desc": "select play_id, row_number() over (order by n desc, track_id) as rank from (select *, count(*) over (partition by track_id) as n from plays qualify row_number() over (partition by track_id order by played_at desc, play_id desc) = 1) z qualify rank <= 30",
    "title_asc": "select p.play_id, row_number() over (order by t.title, p.play_id) as rank from plays p join tracks t on t.track_id = p.track_id qualify rank <= 30",
}
for name, sql in RECENT.items():
    def _recent(lib, s=name):
        from tracklight.sources.lists import recent_plays

        return recent_plays(lib.plays, lib.tracks, s, 30).select("play_id", F.col("rank").cast("long").alias("rank"))

    query(f"lst7_{name}", sql)(_recent)


@query("lst8_tags", "select tag, count(*) as n, max(tagged_at) as last_tagged_at from tags where tag ilike '%brand%' group by tag order by n desc, tag limit 10")
def _(lib):
    return L.tag_counts(lib.tags, "brand", 10)


@query("lst9_pending_reviews", "select review_id, confidence from reviews where status = 'pending' order by confidence desc, review_id desc limit 25 offset 10")
def _(lib):
    return L.pending_reviews(lib.reviews, "no such order", 25, 10).select("review_id", "confidence")


@query("lst10_operation_runs", "select run_id, started_at from runs where operation_type in ('1-URGENT', '2-HIGH') and status = 'completed' order by started_at desc, run_id desc limit 21")
def _(lib):
    return L.operation_runs(lib.runs, 20, types=["1-URGENT", "2-HIGH"], status="completed").select("run_id", "started_at")


DEAD = "kind = 'no_match' and misses >= 3 and epoch(last_checked_at - created_at) >= 9 * 86400"
REJECTED = "kind = 'rejected_pair' and unrejected_at is null"
PENDING = f"kind = 'no_match' and check_again > {T}"
for name, where in (("rejected", REJECTED), ("dead", DEAD)):
    query(f"lst12_negatives_{name}", f"select n.negative_id, n.connector_track_id, coalesce(n.candidate_track_id, m.track_id) as track_id, t.title, n.misses from (select * from negatives where {where}) n left join (select connector_track_id, min(track_id) as track_id from {LIVE} group by 1) m on m.connector_track_id = n.connector_track_id left join tracks t on t.track_id = coalesce(n.candidate_track_id, m.track_id)")(lambda lib, k=name: L.list_negatives(lib.negatives, lib.mappings, lib.tracks, k))


# Joins


def named(lib):
    return lib.tracks.select("track_id", F.lower("title").alias("title_normalized"), F.lower("artist").alias("artist_normalized"), F.substring_index(F.lower("title"), " ", 1).alias("title_stripped"))


WANTED = "(select distinct title, lower(artist) as artist from (select title, artist from tracks where track_id % 10 = 0 union all select split_part(title, ' ', 1), artist from tracks where track_id % 10 = 1) w) q"


def wanted(lib):
    a = lib.tracks.where("track_id % 10 = 0").select("title", F.lower("artist").alias("artist"))
    return a.unionByName(lib.tracks.where("track_id % 10 = 1").select(F.substring_index("title", " ", 1).alias("title"), F.lower("artist").alias("artist")))


@query("jn1_probe_by_names", f"select distinct t.track_id from tracks t join {WANTED} on lower(t.artist) = q.artist and (lower(t.title) = q.title or split_part(lower(t.title), ' ', 1) = q.title)")
def _(lib):
    return L.probe_by_names(named(lib), wanted(lib)).select("track_id")


@query("jn2_first_by_names", f"select q.title, q.artist, min(t.track_id) as track_id from tracks t join {WANTED} on lower(t.artist) = q.artist and (lower(t.title) = q.title or split_part(lower(t.title), ' ', 1) = q.title) group by 1, 2")
def _(lib):
    return L.first_by_names(named(lib), wanted(lib))


@query("jn3_by_isrc", "select track_id, isrc from tracks where isrc in (select isrc from tracks where track_id % 7 = 3)")
def _(lib):
    return L.by_unique_column(lib.tracks, "isrc", lib.tracks.where("track_id % 7 = 3")).select("track_id", "isrc")


@query("jn4_by_connector", f"select m.connector, m.connector_track_id, t.track_id, t.title from {LIVE} join tracks t on t.track_id = m.track_id where m.connector = 'spotify' and m.connector_track_id % 20 = 0")
def _(lib):
    return L.tracks_by_connector(lib.mappings, lib.tracks, lib.orders.where("o_orderkey % 20 = 0").select(F.lit("spotify").alias("connector"), F.col("o_orderkey").alias("connector_track_id")))


@query("jn5_unsynced_likes", "select a.track_id, a.liked_at from likes a left join likes b on b.track_id = a.track_id and b.service = 'lastfm' where a.service = 'spotify' and a.is_liked and a.liked_at >= TIMESTAMP '1998-01-01' and (b.track_id is null or not b.is_liked)")
def _(lib):
    return L.unsynced_likes(lib.likes, "spotify", "lastfm", since=dt.datetime(1998, 1, 1)).select("track_id", "liked_at")


@query("jn6_unsourced_plays", "select play_id from plays where play_id not in (select event_id from events where event_id % 3 = 0)")
def _(lib):
    return lib.plays.join(lib.events.where("event_id % 3 = 0").select(F.col("event_id").alias("play_id")), "play_id", "left_anti").select("play_id")


@query("jn7_missing_primaries", f"select track_id, connector, count(*) as n from {LIVE} where (track_id, connector) not in (select track_id, connector from {LIVE} where is_primary) group by 1, 2")
def _(lib):
    return L.missing_primaries(lib.mappings)


@query("jn8_orphans", f"select o_orderkey as connector_track_id from orders where o_orderkey not in (select connector_track_id from {LIVE}) and o_orderkey not in (select connector_track_id from negatives where ({REJECTED}) or ({PENDING}))")
def _(lib):
    return L.orphaned_connector_tracks(lib.orders.select(F.col("o_orderkey").alias("connector_track_id")), lib.mappings, lib.negatives, NOW).select("connector_track_id")


PRIMARY = f"select track_id, min(connector_track_id) as id from {LIVE} where is_primary and connector = '{{}}' group by 1"


@query("jn9_stale_identifiers", f"select count(*) filter (where case when t.track_id % 2 = 0 then s.id end is distinct from s.id) as stale_spotify, count(*) filter (where t.track_id is distinct from b.id) as stale_mbid from tracks t left join ({PRIMARY.format('spotify')}) s on s.track_id = t.track_id left join ({PRIMARY.format('musicbrainz')}) b on b.track_id = t.track_id")
def _(lib):
    spotify = L.live(lib.mappings).where("is_primary and connector = 'spotify'").groupBy("track_id").agg(F.min("connector_track_id").alias("id"))
    own = lib.tracks.select("track_id").join(spotify, "track_id", "left").select("track_id", F.when(F.col("track_id") % 2 == 0, F.col("id")).alias("spotify_id"), F.col("track_id").alias("mbid"))
    return L.stale_identifiers(own, lib.mappings)


# One step in three up, and of every hundredth mapping a step back, so that there are cycles that are entered from outside.
SUPERSEDED = "select p_partkey as mapping_id, case when p_partkey % 100 = 1 then p_partkey * 3 + 1 else p_partkey // 3 end as superseded_by from part where p_partkey % 3 = 1 and p_partkey > 2"


@query("jn10_supersession", f"with recursive edges as ({SUPERSEDED}), chain as (select mapping_id, 1 as hop, superseded_by as successor, [mapping_id, superseded_by] as seen from edges where superseded_by <> mapping_id union all select c.mapping_id, c.hop + 1, e.superseded_by, list_append(c.seen, e.superseded_by) from chain c join edges e on e.mapping_id = c.successor where c.hop < 31 and not list_contains(c.seen, e.superseded_by)) select mapping_id, hop, successor from chain")
def _(lib):
    edges = lib.part.where("p_partkey % 3 = 1 and p_partkey > 2").select(F.col("p_partkey").alias("mapping_id"), F.expr("case when p_partkey % 100 = 1 then p_partkey * 3 + 1 else p_partkey div 3 end").alias("superseded_by"))
    return L.supersession_chains(edges)



@query("jn11_playlists_of_track", "select distinct playlist_id from entries where track_id in (5, 6)")
def _(lib):
    return lib.entries.where(F.col("track_id").isin(5, 6)).select("playlist_id").distinct()


RANK = "case {} when 'nah' then 1 when 'hmm' then 2 when 'yah' then 3 when 'star' then 4 end"


@query("jn12_desired_preferences", f"select track_id, case max(r) when 1 then 'nah' when 2 then 'hmm' when 3 then 'yah' else 'star' end as state from (select e.track_id, o_orderkey % 4 + 1 as r from entries e join orders on o_orderkey = e.playlist_id where o_orderkey % 3 = 0 and e.track_id is not null) z group by 1")
def _(lib):
    assigned = lib.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("playlist_id"), F.get(F.array(*[F.lit(s) for s in M.STATES]), (F.col("o_orderkey") % 4).cast("int")).alias("state"))
    return L.desired_preferences(lib.entries, assigned)


@query("jn13_preferences_from_likes", f"with wish as (select track_id, case when bool_or(service = 'lastfm') then 'star' else 'yah' end as state from likes where is_liked group by 1) select coalesce(p.track_id, w.track_id) as track_id, case when p.state is null or (w.state is not null and p.source = 'service_import' and {RANK.format('w.state')} > {RANK.format('p.state')}) then w.state else p.state end as state from preferences p full join wish w on w.track_id = p.track_id")
def _(lib):
    wish = L.preferences_from_likes(lib.likes).withColumn("source", F.lit("service_import"))
    return M.apply_preferences(lib.preferences, wish).select("track_id", "state")


@query("jn14_liked_maps", "select track_id, string_agg(service || '=' || is_liked, ',' order by service) as liked from likes group by 1")
def _(lib):
    return L_maps(lib)


def L_maps(lib):
    from tracklight.operators.enrichers import liked_maps

    pairs = F.transform(F.map_entries("liked"), lambda e: F.concat_ws("=", e.key, e.value.cast("string")))
    return liked_maps(lib.likes).select("track_id", F.array_join(pairs, ",").alias("liked"))


# Aggregates


@query("agg1_play_aggregations", "select track_id, count(*) as total_plays, max(played_at) as last_played_dates, min(played_at) as first_played_dates, count(*) filter (where played_at between TIMESTAMP '2024-01-10' and TIMESTAMP '2024-01-20') as period_plays from plays group by 1")
def _(lib):
    from tracklight.operators.enrichers import play_aggregates

    return play_aggregates(lib.plays, (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)))


for bucket in ("day", "week", "month"):
    query(f"agg2_histogram_{bucket}", f"select cast(date_trunc('{bucket}', played_at) as timestamp) as bucket, count(*) as plays from plays where service = 'lastfm' and played_at >= TIMESTAMP '2024-01-03' group by 1")(lambda lib, b=bucket: L.play_histogram(lib.plays, b, service="lastfm", since=dt.datetime(2024, 1, 3)))


@query("agg2_histogram_zone", "select cast(date_trunc('day', played_at + interval 9 hour) as timestamp) as bucket, count(*) as plays from plays group by 1")
def _(lib):
    return L.play_histogram(lib.plays, "day", "Asia/Tokyo")


@query("agg3_adaptive_histogram", "select cast(date_trunc('day', played_at) as timestamp) as bucket, count(*) as plays from plays group by 1")
def _(lib):
    return L.adaptive_histogram(lib.plays)


FIRSTS = "select 'plays' as kind, play_id as id, played_at as since from plays union all select 'tags', track_id, tagged_at from tags union all select 'orders', o_orderkey, o_orderdate from orders union all select 'open', track_id, null from tracks"


@query("agg3_buckets", f"select kind, id, case when since is null then 'month' when floor((epoch({T}) - epoch(since)) / 86400) <= 90 then 'day' when floor((epoch({T}) - epoch(since)) / 86400) <= 730 then 'week' else 'month' end as bucket from ({FIRSTS}) z")
def _(lib):
    """The width of the bars for histories that begin then."""
    return lib.sql(FIRSTS).select("kind", "id", L.histogram_buckets(F.col("since"), F.lit(NOW).cast("timestamp_ntz")).alias("bucket"))



@query("agg4_dashboard", f"select 'tracks' as name, count(*) as n from tracks union all select 'plays', count(*) from plays union all select 'playlists', count(distinct playlist_id) from entries union all select 'liked', count(distinct track_id) from likes where is_liked union all select 'plays:' || service, count(*) from plays group by 1 union all select 'mapped:' || connector, count(distinct track_id) from {LIVE} group by 1 union all select 'liked:' || service, count(*) from likes where is_liked group by 1 union all select 'preference:' || state, count(*) from preferences group by 1")
def _(lib):
    return L.dashboard(lib)


@query("agg5_match_methods", f"select method, connector, count(*) as total, count(*) filter (where created_at >= TIMESTAMP '1999-01-01' - interval 30 day) as recent, round(avg(confidence), 1) as mean, min(confidence) as least, max(confidence) as most, count(*) filter (where confidence < 50) as below_50, count(*) filter (where confidence between 50 and 84) as from_50, count(*) filter (where confidence between 85 and 99) as from_85, count(*) filter (where confidence = 100) as full from {LIVE} group by 1, 2".replace("as full", 'as "full"'))
def _(lib):
    return L.match_methods(lib.mappings, dt.datetime(1999, 1, 1))


@query("agg6_duplicate_fingerprints", "select title, artist, album, count(*) as n, string_agg(track_id, ',' order by track_id) as ids from tracks group by 1, 2, 3 having count(*) > 1")
def _(lib):
    return L.duplicate_fingerprints(lib.tracks)


@query("agg7_facets", f"with f as (select track_id from tracks where duration_ms > 100000) select 'preference' as facet, coalesce(p.state, 'unrated') as value, count(*) as n from f left join preferences p on p.track_id = f.track_id group by 2 union all select 'liked', case when track_id in (select track_id from likes where is_liked) then 'true' else 'false' end, count(*) from f group by 2 union all select 'connector', connector, count(distinct track_id) from {LIVE} where track_id in (select track_id from f) group by 2")
def _(lib):
    return L.facets(lib.tracks.where("duration_ms > 100000"), lib)


@query("agg8_several_primaries", f"select track_id, connector, cast(sum(is_primary::int) as bigint) as primaries from {LIVE} group by 1, 2 having sum(is_primary::int) > 1")
def _(lib):
    return L.several_primaries(lib.mappings)


@query("agg9_evidence_divergence", "select count(*) as n from mappings where not is_retired and confidence = 100 and evidence_score < 100")
def _(lib):
    return L.live(lib.mappings).where("confidence = 100 and evidence_score < 100").agg(F.count(F.lit(1)).alias("n"))


@query("agg10_states", "select state, count(*) as n from preferences group by 1")
def _(lib):
    return lib.preferences.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("agg11_pending_by_method", "select method, count(*) as n from reviews where status = 'pending' group by 1")
def _(lib):
    return lib.reviews.where("status = 'pending'").groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("agg12_negatives", f"select count(*) filter (where {REJECTED}) as rejected, count(*) filter (where {PENDING}) as pending, count(*) filter (where {DEAD}) as dead from negatives")
def _(lib):
    return lib.negatives.agg(F.count_if(L.active_rejection()).alias("rejected"), F.count_if(L.pending_no_match(NOW)).alias("pending"), F.count_if(L.looks_dead()).alias("dead"))


@query("agg13_play_days", "select distinct cast(played_at as date) as day from plays")
def _(lib):
    return lib.plays.select(F.to_date("played_at").alias("day")).distinct()


CHECKS = f"select 'several primaries' as \"check\", (select count(*) from (select 1 from {LIVE} group by track_id, connector having sum(is_primary::int) > 1) z) as n, 'fail' as bad union all select 'missing primaries', (select count(*) from (select distinct track_id, connector from {LIVE} where (track_id, connector) not in (select track_id, connector from {LIVE} where is_primary)) z), 'warn' union all select 'duplicates', (select count(*) from (select 1 from tracks group by title, artist, album having count(*) > 1) z), 'warn' union all select 'unsaved', (select count(*) from tracks where version = 0), 'fail'"


@query("agg14_integrity", f"with c as ({CHECKS}), s as (select \"check\", n, case when n = 0 then 'pass' else bad end as status from c) select * from s union all select 'overall', cast(sum(n) as bigint), case when bool_or(status = 'fail') then 'fail' when bool_or(status = 'warn') then 'warn' else 'pass' end from s")
def _(lib):
    return L.integrity([L.Check("several primaries", L.several_primaries(lib.mappings)), L.Check("missing primaries", L.missing_primaries(lib.mappings), True), L.Check("duplicates", L.duplicate_fingerprints(lib.tracks), True), L.Check("unsaved", lib.tracks.where("version = 0"))])


@query("agg16_latest_runs", "select workflow_id, run_id, status, count(*) filter (where status = 'completed') over (partition by workflow_id) as completed, count(*) over (partition by workflow_id) as runs from runs qualify row_number() over (partition by workflow_id order by started_at desc, run_id desc) = 1")
def _(lib):
    return L.latest_runs(lib.runs).select("workflow_id", "run_id", "status", "completed", "runs")


@query("agg17_stale_pending", "select count(*) as n from reviews where status = 'pending' and created_at < TIMESTAMP '1998-01-01' - interval 30 day")
def _(lib):
    return lib.reviews.where("status = 'pending' and created_at < timestamp_ntz '1998-01-01' - interval 30 days").agg(F.count(F.lit(1)).alias("n"))


@query("agg18_recent_reviews", "select count(*) as n from reviews where created_at >= TIMESTAMP '1998-01-01' - interval 7 day")
def _(lib):
    return lib.reviews.where("created_at >= timestamp_ntz '1998-01-01' - interval 7 days").agg(F.count(F.lit(1)).alias("n"))


# Windows


@query("win1_latest_play_of_top", "with top as (select track_id, count(*) as n from plays group by 1 order by n desc, track_id limit 20), r as (select *, row_number() over (partition by track_id order by played_at desc, play_id desc) as k from plays) select t.track_id, t.n, r.play_id from top t join r on r.track_id = t.track_id and r.k = 1")
def _(lib):
    from tracklight.sources.lists import recent_plays

    return recent_plays(lib.plays, lib.tracks, "total_plays_desc", 20).select("track_id", F.col("total_plays").alias("n"), "play_id")


@query("win2_latest_per_track", "select track_id, play_id from plays qualify row_number() over (partition by track_id order by played_at desc, play_id desc) = 1")
def _(lib):
    from tracklight.sources.lists import recent_plays

    return recent_plays(lib.plays, lib.tracks, "last_played_desc", 1_000_000).select("track_id", "play_id")


GAPS = "select {k}, case when gap <= 60 then '60' when gap <= 600 then '600' when gap <= 3600 then '3600' else 'more' end as band, count(*) as n from (select *, epoch(played_at - lag(played_at) over (partition by {p} order by played_at, play_id)) as gap from plays) z where gap is not null group by 1, 2"


def band():
    return F.when(F.col("gap") <= 60, "60").when(F.col("gap") <= 600, "600").when(F.col("gap") <= 3600, "3600").otherwise("more").alias("band")


@query("win3_gap_bands", GAPS.format(k="connector", p="user_id, connector, identifier").replace("played_at, play_id", "played_at, id").replace("from plays", "from connector_plays"))
def _(lib):
    return L.lags(lib.connector_plays, ["user_id", "connector", "identifier"], "played_at", "id").where("gap is not null").groupBy("connector", band()).agg(F.count(F.lit(1)).alias("n"))


@query("win4_track_gaps", GAPS.format(k="service", p="service, track_id"))
def _(lib):
    return L.lags(lib.plays, ["service", "track_id"], "played_at", "play_id").where("gap is not null").groupBy("service", band()).agg(F.count(F.lit(1)).alias("n"))


@query("win5_burst_share", "select cast(played_at as date) as day, count(*) as plays, count(*) filter (where gap < 120) as bursts from (select *, epoch(played_at - lag(played_at) over (partition by cast(played_at as date) order by played_at, play_id)) as gap from plays) z group by 1")
def _(lib):
    own = lib.plays.withColumn("day", F.to_date("played_at"))
    return L.lags(own, ["day"], "played_at", "play_id").groupBy("day").agg(F.count(F.lit(1)).alias("plays"), F.count_if(F.col("gap") < 120).alias("bursts"))


# Merges

MERGES = "(select p_partkey as winner_id, p_partkey + 1 as loser_id from part where p_partkey % 20 = 0) g"


def merges(lib):
    return lib.part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("winner_id"), (F.col("p_partkey") + 1).alias("loser_id"))


def moved(table: str) -> str:
    return f"(select x.* replace (coalesce(g.winner_id, x.track_id) as track_id), g.winner_id is not null as moved from {table} x left join {MERGES} on g.loser_id = x.track_id) y"


@query("mut1_repoint_plays", f"select track_id, count(*) as n from {moved('plays')} group by 1")
def _(lib):
    return M.repoint(lib.plays, merges(lib)).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))


@query("mut1_merge_likes", f"select track_id, service, is_liked, liked_at from {moved('likes')} qualify row_number() over (partition by track_id, service order by liked_at desc, is_liked desc) = 1")
def _(lib):
    return M.merge_likes(lib.likes, merges(lib))


@query("mut1_merge_preferences", f"select track_id, state, source from {moved('preferences')} qualify row_number() over (partition by track_id order by case source when 'manual' then 3 when 'playlist_assignment' then 2 else 1 end desc, {RANK.format('state')} desc, preferred_at desc) = 1")
def _(lib):
    return M.merge_preferences(lib.preferences, merges(lib)).select("track_id", "state", "source")


MERGED = """m as (select l.mapping_id, coalesce(g.winner_id, l.track_id) as track_id, g.winner_id is not null as moved, l.connector, l.connector_track_id, l.is_primary, l.is_retired from mappings l left join (select p_partkey as winner_id, p_partkey + 1 as loser_id from part where p_partkey % 20 = 0) g on g.loser_id = l.track_id),
  firsts as (select track_id, connector, connector_track_id, min((moved, not is_primary, mapping_id)) as first from m where not is_retired group by 1, 2, 3),
  alive as (select m.*, f.first[3] as kept from m join firsts f on f.track_id = m.track_id and f.connector = m.connector and f.connector_track_id = m.connector_track_id where not m.is_retired),
  mains as (select track_id, connector, min((not is_primary, moved, mapping_id)) as main from alive where kept = mapping_id group by 1, 2)"""


@query("mut2_merge_mappings", f"with {MERGED} select a.mapping_id, a.track_id, a.kept <> a.mapping_id as is_retired, a.kept = a.mapping_id and a.is_primary and s.main[3] = a.mapping_id as is_primary, case when a.kept <> a.mapping_id then a.kept end as retired_into from alive a join mains s on s.track_id = a.track_id and s.connector = a.connector union all select mapping_id, track_id, is_retired, is_primary, null from m where is_retired")
def _(lib):
    return M.merge_mappings(lib.mappings, merges(lib)).select("mapping_id", "track_id", "is_retired", "is_primary", "retired_into")



@query("mut3_merge_metrics", f"select track_id, metric_type, value from {moved('metrics')} qualify row_number() over (partition by track_id, connector, metric_type order by collected_at desc, value desc) = 1")
def _(lib):
    return M.merge_metrics(lib.metrics, merges(lib)).select("track_id", "metric_type", "value")


@query("mut4_merge_tracks", f"select (select count(*) from tracks where track_id not in (select loser_id from {MERGES})) as tracks, (select count(*) from plays) as plays, (select count(distinct track_id) from {moved('entries')}) as listed")
def _(lib):
    new = M.merge_tracks(lib, merges(lib))
    one = lambda df, n, c=F.count(F.lit(1)): df.agg(c.alias(n))
    return one(new["tracks"], "tracks").crossJoin(one(new["plays"], "plays")).crossJoin(one(new["entries"], "listed", F.count_distinct("track_id")))


@query("mut5_assert_mappings", "with live as (select connector, connector_track_id, min(mapping_id) as mapping_id, min(track_id) as track_id from mappings where not is_retired group by 1, 2), said as (select distinct connector, connector_track_id, case when connector_track_id % 2 = 0 then track_id else track_id + 1 end as track_id from live where connector_track_id % 3 > 0 union all select 'spotify', -o_orderkey, o_custkey from orders where o_orderkey % 100 = 0) select s.connector, s.connector_track_id, l.mapping_id as incumbent, case when l.mapping_id is null then 'insert' when l.track_id = s.track_id then 'touch' else 'supersede' end as action from said s left join live l on l.connector = s.connector and l.connector_track_id = s.connector_track_id")
def _(lib):
    fixed = {"confidence": F.lit(90), "method": F.lit("isrc"), "origin": F.lit("automatic")}
    live = L.live(lib.mappings).groupBy("connector", "connector_track_id").agg(F.min("mapping_id").alias("mapping_id"), F.min("track_id").alias("track_id")).withColumns(fixed)
    said = live.where("connector_track_id % 3 > 0").select("connector", "connector_track_id", F.when(F.col("connector_track_id") % 2 == 0, F.col("track_id")).otherwise(F.col("track_id") + 1).alias("track_id"))
    new = lib.orders.where("o_orderkey % 100 = 0").select(F.lit("spotify").alias("connector"), (-F.col("o_orderkey")).alias("connector_track_id"), F.col("o_custkey").alias("track_id"))
    return M.assert_mappings(live, said.unionByName(new).withColumns(fixed)).select("connector", "connector_track_id", "incumbent", "action")


@query("mut6_rename_tag", "select track_id, tag from tags where tag <> 'gym' union all select track_id, 'mood:loud' from tags where tag = 'gym' and track_id not in (select track_id from tags where tag = 'mood:loud')")
def _(lib):
    return M.rename_tag(lib.tags, "gym", "mood:loud")[0].select("track_id", "tag")


@query("mut6_rename_events", "select track_id, 'gym' as tag, 'remove' as action from tags where tag = 'gym' union all select track_id, 'mood:loud', 'add' from tags where tag = 'gym' and track_id not in (select track_id from tags where tag = 'mood:loud')")
def _(lib):
    return M.rename_tag(lib.tags, "gym", "mood:loud")[1]


@query("mut7_update_by_natural_key", "select play_id, case when play_id % 4 = 0 then 'resolved' else service end as service from plays")
def _(lib):
    keys = ["user_id", "track_id", "played_at", "ms_played"]
    return M.update_by_natural_key(lib.plays, lib.plays.where("play_id % 4 = 0").withColumn("service", F.lit("resolved")), keys, ["service"]).select("play_id", "service")


@query("mut8_record_misses", f"select connector_track_id, misses + 1 as misses, {T} + to_microseconds(cast(round(least(greatest(epoch(check_again - last_checked_at) / 86400 * 2, 1), 32) * 86400) as bigint) * 1000000) as check_again from (select * from negatives where kind = 'no_match' qualify row_number() over (partition by connector_track_id order by negative_id) = 1) n")
def _(lib):
    own = lib.negatives.where("kind = 'no_match'").groupBy("connector_track_id").agg(F.min_by(F.struct("kind", "misses", "last_checked_at", "check_again"), "negative_id").alias("s")).select("connector_track_id", "s.*")
    return M.record_misses(own, own, NOW)


@query("mut9_ingest", "with inc as (select l_orderkey * 10 + l_linenumber as position, case l_suppkey % 3 when 0 then 'spotify' else 'deezer' end as connector, l_orderkey + case when l_linenumber % 2 = 0 then 10000000 else 0 end as connector_track_id, case when l_partkey % 3 = 0 then 'none' else p_name end as title, lower(p_brand) as artist, case when l_partkey % 5 = 1 then 'USAAA' || lpad(cast(p_partkey as varchar), 7, '0') end as isrc from lineitem join part on p_partkey = l_partkey), one as (select connector, connector_track_id, arg_min_null(title, position) as title, arg_min_null(artist, position) as artist, arg_min_null(isrc, position) as isrc from (select position, connector, connector_track_id, min(title) as title, min(artist) as artist, min(isrc) as isrc from inc group by 1, 2, 3) z group by 1, 2), f as (select o.*, (select min(track_id) from mappings m where not is_retired and m.connector = o.connector and m.connector_track_id = o.connector_track_id) as a, (select min(track_id) from tracks t where t.isrc = o.isrc) as b, (select min(track_id) from tracks t where lower(t.title) = o.title and lower(t.artist) = o.artist) as c from one o) select connector, connector_track_id, coalesce(a, b, c) as track_id, case when a is not null then 'mapping' when b is not null then 'isrc' when c is not null then 'identity' else 'created' end as outcome from f")
def _(lib):
    rows = lib.lineitem.join(lib.part, F.col("p_partkey") == F.col("l_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
        F.when(F.col("l_suppkey") % 3 == 0, "spotify").otherwise("deezer").alias("connector"),
        (F.col("l_orderkey") + F.when(F.col("l_linenumber") % 2 == 0, 10_000_000).otherwise(0)).alias("connector_track_id"),
        F.when(F.col("l_partkey") % 3 == 0, "none").otherwise(F.col("p_name")).alias("title_normalized"),
        F.lower("p_brand").alias("artist_normalized"),
        F.when(F.col("l_partkey") % 5 == 1, F.concat(F.lit("USAAA"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))).alias("isrc"),
    )
    one = rows.groupBy("position", "connector", "connector_track_id").agg(*[F.min(c).alias(c) for c in ("title_normalized", "artist_normalized", "isrc")])
    known = lib.tracks.select("track_id", F.lower("title").alias("title_normalized"), F.lower("artist").alias("artist_normalized"), "isrc")
    return M.ingest(one, lib.mappings, known).select("connector", "connector_track_id", "track_id", "outcome").distinct()


@query("mut10_preference_changes", f"select p.track_id, p.state as old_state, case when n.source_rank > o.source_rank or (n.source_rank = o.source_rank and {RANK.format('n.state')} > {RANK.format('p.state')}) then n.state else p.state end as state from preferences p, lateral (select case p.source when 'manual' then 3 when 'playlist_assignment' then 2 else 1 end as source_rank) o, lateral (select case p.track_id % 4 when 0 then 'star' when 1 then 'nah' when 2 then 'hmm' else 'yah' end as state, 2 as source_rank) n")
def _(lib):
    states = F.get(F.array(F.lit("star"), F.lit("nah"), F.lit("hmm"), F.lit("yah")), (F.col("track_id") % 4).cast("int"))
    new = lib.preferences.select("track_id", states.alias("state"), F.lit("playlist_assignment").alias("source"))
    return M.apply_preferences(lib.preferences, new).select("track_id", "old_state", "state")
