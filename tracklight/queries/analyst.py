"""The analysts' pack: investigations of matching, of play imports and of what the listen threshold discards.

Spark's side is DataFrame code; the other engine's SQL is written apart from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.functions.scalars import micros
from tracklight.operators.joins import nearest, range_join
from tracklight.queries import T, query

json = F.get_json_object


def number() -> Column:
    """The number of rows."""
    return F.count(F.lit(1))


def percent(part: Column, digits: int) -> Column:
    """The share of rows in which the column is known, in percent."""
    return F.round(100.0 * F.count(part) / number(), digits)


def percent_sql(part: str, digits: int) -> str:
    return f"round(100.0 * count({part}) / count(*), {digits})"


# Matching: confidences, methods, identifiers


@query("sqp_q1_method_bands", "select method, connector, count(*) as total, sum(case when confidence < 50 then 1 else 0 end)::bigint as rejected, sum(case when confidence >= 50 and confidence < 85 then 1 else 0 end)::bigint as to_review, sum(case when confidence >= 85 and confidence < 100 then 1 else 0 end)::bigint as accepted, sum(case when confidence = 100 then 1 else 0 end)::bigint as certain from track_mappings group by all")
def _(lib):
    c = F.col("confidence")
    bands = {"rejected": c < 50, "to_review": c.between(50, 84), "accepted": c.between(85, 99), "certain": c == 100}
    return lib.track_mappings.groupBy("method", "connector").agg(number().alias("total"), *[F.count_if(v).alias(k) for k, v in bands.items()])


@query("sqp_q2_histogram", "select connector, confidence - confidence % 5 as bucket, count(*) as mappings from track_mappings group by all")
def _(lib):
    return lib.track_mappings.groupBy("connector", (F.floor(F.col("confidence") / 5) * 5).cast("int").alias("bucket")).agg(number().alias("mappings"))


@query("sqp_q3_queue_age", f"select status, count(*) as reviews, min(created_at) as oldest, round(median((epoch_us({T}) - epoch_us(created_at)) / 1e6), 3) as median_age_s, max(created_at) as newest, count(*) filter (where created_at < {T} - interval 30 day) as old from reviews group by status")
def _(lib):
    now = F.expr("timestamp_ntz '2024-01-31 00:00:00'")
    age = (micros(now) - micros(F.col("created_at"))) / 1_000_000
    return lib.reviews.withColumn("age", age).groupBy("status").agg(number().alias("reviews"), F.min("created_at").alias("oldest"), F.round(F.median("age"), 3).alias("median_age_s"), F.max("created_at").alias("newest"), F.count_if(F.col("age") > 30 * 86_400).alias("old"))


@query("sqp_q4_vocabulary", "select method, connector, count(*) as mappings from track_mappings group by all")
def _(lib):
    return lib.track_mappings.groupBy("method", "connector").agg(number().alias("mappings"))


@query("sqp_q5_isrc_collisions", "select count(*) as shared, count_if(spread > 10000) as suspect, count_if(services = 1) as within_one, max(spread) as worst from (select isrc, count(distinct connector) as services, max(duration_ms) - min(duration_ms) as spread from connector_tracks where isrc is not null group by isrc having count(distinct connector || '/' || identifier) > 1) g")
def _(lib):
    groups = lib.connector_tracks.where("isrc is not null").groupBy("isrc").agg(F.count_distinct("connector", "identifier").alias("identifiers"), F.count_distinct("connector").alias("services"), (F.max("duration_ms") - F.min("duration_ms")).alias("spread"))
    return groups.where("identifiers > 1").agg(number().alias("shared"), F.count_if(F.col("spread") > 10_000).alias("suspect"), F.count_if(F.col("services") == 1).alias("within_one"), F.max("spread").alias("worst"))


@query("sqp_q6_evidence", "with e as (select *, (evidence->>'final_score')::double as score from track_mappings) select method, connector, count(*) as bumped, round(avg(score), 1) as mean_score, min(score) as least_score from e where confidence = 100 and score < 100 group by all")
def _(lib):
    rows = lib.track_mappings.where("confidence = 100").withColumn("score", json("evidence", "$.final_score").try_cast("double")).where("score < 100")
    return rows.groupBy("method", "connector").agg(number().alias("bumped"), F.round(F.avg("score"), 1).alias("mean_score"), F.min("score").alias("least_score"))


@query("sqp_q7_drift", "with p as (select m.track_id, m.mapping_id, c.identifier from track_mappings m left join connector_tracks c on c.id = m.connector_track_id where m.connector = 'spotify' and m.is_primary) select count_if(t.spotify_id is distinct from p.identifier) as disagrees, count_if(t.spotify_id is not null and p.mapping_id is null) as unmapped from canonicals t left join p on p.track_id = t.track_id where coalesce(t.spotify_id, p.mapping_id::varchar) is not null")
def _(lib):
    primary = lib.track_mappings.where("connector = 'spotify' and is_primary").select("track_id", "mapping_id", F.col("connector_track_id").alias("id"))
    known = primary.join(lib.connector_tracks.select("id", "identifier"), "id", "left")
    both = lib.canonicals.select("track_id", "spotify_id").join(known, "track_id", "left").where("spotify_id is not null or mapping_id is not null")
    return both.agg(F.count_if(~F.col("spotify_id").eqNullSafe(F.col("identifier"))).alias("disagrees"), F.count_if(F.col("spotify_id").isNotNull() & F.col("mapping_id").isNull()).alias("unmapped"))


UUID = "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"


@query("sqp_q8_identifier_schemes", f"select case when starts_with(identifier, 'http') then 'url' when starts_with(identifier, 'lastfm:') then 'prefixed' when regexp_full_match(identifier, '{UUID}') then 'mbid' when contains(identifier, '::') then 'composite' else 'other' end as scheme, count(*) as n from connector_tracks where connector = 'lastfm' group by 1")
def _(lib):
    c = F.col("identifier")
    scheme = F.when(c.like("http%"), "url").when(c.like("lastfm:%"), "prefixed").when(c.rlike(f"^{UUID}$"), "mbid").when(c.like("%::%"), "composite").otherwise("other")
    return lib.connector_tracks.where("connector = 'lastfm'").groupBy(scheme.alias("scheme")).agg(number().alias("n"))


@query("sqp_q8b_key_mismatch", "select count(*) as n from connector_tracks where connector = 'lastfm' and contains(identifier, '::') and identifier <> concat_ws('::', lower(trim(artist)), lower(trim(title)))")
def _(lib):
    from tracklight.functions.scalars import pair_identifier

    rows = lib.connector_tracks.where("connector = 'lastfm' and identifier like '%::%'")
    return rows.where(~F.col("identifier").eqNullSafe(pair_identifier(F.col("artist"), F.col("title")))).agg(number().alias("n"))


@query("sqp_q9_counts_of_counts", "select n as mappings, count(*) as tracks from (select count(*) as n from track_mappings where connector = 'lastfm' group by track_id) g group by n")
def _(lib):
    each = lib.track_mappings.where("connector = 'lastfm'").groupBy("track_id").agg(number().alias("mappings"))
    return each.groupBy("mappings").agg(number().alias("tracks"))


@query("sqp_q10_skeletons", "select (select count(*) from canonicals t where duration_ms is null and album is null and track_id in (select track_id from track_mappings where connector = 'lastfm') and track_id not in (select track_id from track_mappings where connector <> 'lastfm')) as skeletal, (select count(*) from connector_tracks where id not in (select connector_track_id from track_mappings)) as unmapped")
def _(lib):
    of = lambda where: lib.track_mappings.where(where).select("track_id")
    bare = lib.canonicals.where("duration_ms is null and album is null").join(of("connector = 'lastfm'"), "track_id", "left_semi").join(of("connector <> 'lastfm'"), "track_id", "left_anti")
    orphans = lib.connector_tracks.join(lib.track_mappings.select(F.col("connector_track_id").alias("id")), "id", "left_anti")
    return bare.agg(number().alias("skeletal")).crossJoin(orphans.agg(number().alias("unmapped")))  # one row each


@query("sqp_q11_backlog", "select connector, sum((resolved_track_id is null)::int)::bigint as unresolved, count(*) as total, min(case when resolved_track_id is null then played_at end) as oldest from connector_plays group by connector")
def _(lib):
    missing = F.col("resolved_track_id").isNull()
    return lib.connector_plays.groupBy("connector").agg(F.count_if(missing).alias("unresolved"), number().alias("total"), F.min(F.when(missing, F.col("played_at"))).alias("oldest"))


@query("sqp_q12_duplicate_groups", "with g as (select count(*) as n, count(distinct isrc) as isrcs from canonicals where title_normalized is not null and artist_normalized is not null group by title_normalized, artist_normalized) select count(*) as duplicates, sum(n)::bigint as tracks, count_if(isrcs > 1) as differing, count_if(isrcs < 2) as same_or_none from g where n > 1")
def _(lib):
    groups = lib.canonicals.where("title_normalized is not null and artist_normalized is not null").groupBy("title_normalized", "artist_normalized").agg(number().alias("n"), F.count_distinct("isrc").alias("isrcs")).where("n > 1")
    return groups.agg(number().alias("duplicates"), F.sum("n").alias("tracks"), F.count_if(F.col("isrcs") > 1).alias("differing"), F.count_if(F.col("isrcs") <= 1).alias("same_or_none"))


@query("sqp_q13_constants", "select confidence, method, count(*) as mappings, count(*) - count(evidence) as without_evidence from track_mappings where confidence = 90 or confidence = 95 or confidence = 100 group by all")
def _(lib):
    return lib.track_mappings.where(F.col("confidence").isin(90, 95, 100)).groupBy("confidence", "method").agg(number().alias("mappings"), F.count_if(F.col("evidence").isNull()).alias("without_evidence"))


# Plays: census, funnel, batches

LAYERS = "(select 'plays' as layer, service, import_source, played_at, ms_played from track_plays union all select 'ledger', connector, import_source, played_at, ms_played from connector_plays) x"


@query("sqp_a1_census", f"select layer, service, import_source, count(*) as n, min(played_at) as first_at, max(played_at) as last_at, count(*) - count(ms_played) as without_ms, count_if(ms_played = 0) as zero_ms from {LAYERS} group by all")
def _(lib):
    def census(df: DataFrame, layer: str, service: str) -> DataFrame:
        found = df.groupBy(F.lit(layer).alias("layer"), F.col(service).alias("service"), "import_source")
        return found.agg(number().alias("n"), F.min("played_at").alias("first_at"), F.max("played_at").alias("last_at"), F.count_if(F.col("ms_played").isNull()).alias("without_ms"), F.count_if(F.col("ms_played") == 0).alias("zero_ms"))

    return census(lib.track_plays, "plays", "service").unionByName(census(lib.connector_plays, "ledger", "connector"))


@query("sqp_a2_funnel", "select connector, count(*) as total, count(*) - count(resolved_track_id) as unresolved, round(100.0 * (count(*) - count(resolved_track_id)) / count(*), 2) as unresolved_percent from connector_plays group by connector")
def _(lib):
    missing = F.count_if(F.col("resolved_track_id").isNull())
    return lib.connector_plays.groupBy("connector").agg(number().alias("total"), missing.alias("unresolved"), F.round(100.0 * missing / number(), 2).alias("unresolved_percent"))


@query("sqp_a3_batches", "select service, import_source, import_batch_id, count(*) as plays, min(played_at) as first_at, max(played_at) as last_at, min(imported_at) as imported_at from track_plays group by all order by imported_at, service, import_source, import_batch_id limit 100")
def _(lib):
    found = lib.track_plays.groupBy("service", "import_source", "import_batch_id").agg(number().alias("plays"), F.min("played_at").alias("first_at"), F.max("played_at").alias("last_at"), F.min("imported_at").alias("imported_at"))
    return found.orderBy("imported_at", "service", "import_source", "import_batch_id").limit(100)


# Plays of two services close in time: bins and equi-joins here, plain inequalities in the other engine's SQL


def scrobbles(lib) -> DataFrame:
    """Plays stamped at their start."""
    return lib.track_plays.where("service = 'lastfm'").select(F.col("play_id").alias("lf_id"), "user_id", "track_id", F.col("played_at").alias("lf_at"))


def streams(lib) -> DataFrame:
    """Plays stamped at their end, with their start."""
    start = F.timestamp_micros(micros(F.col("played_at")) - F.coalesce("ms_played", F.lit(0)) * 1000).cast("timestamp_ntz")
    return lib.track_plays.where("service = 'spotify'").select(F.col("play_id").alias("sp_id"), "user_id", "track_id", F.col("played_at").alias("sp_end"), start.alias("sp_at"))


SIDES = "lf as (select play_id as lf_id, user_id, track_id, played_at as lf_at from track_plays where service = 'lastfm'), sp as (select play_id as sp_id, user_id, track_id, played_at as sp_end, epoch_us(played_at) - coalesce(ms_played, 0) * 1000 as sp_us from track_plays where service = 'spotify')"
NEAREST = f"with {SIDES}, near as (select lf_id, arg_min((epoch_us(lf_at) - sp_us) / 1e6, (abs(epoch_us(lf_at) - sp_us), sp_id)) as delta_s from lf join sp on sp.user_id = lf.user_id and sp.track_id = lf.track_id and sp_end >= lf_at - interval 10 minute and sp_end <= lf_at + interval 20 minute group by lf_id)"
CLOSE = f"with {SIDES}, near as (select lf_id, sp_id, (epoch_us(lf_at) - sp_us) / 1e6 as delta_s from lf join sp on sp.user_id = lf.user_id and sp.track_id = lf.track_id and abs(epoch_us(lf_at) - sp_us) <= 180000000)"


def nearest_deltas(lib) -> DataFrame:
    """lf_id and delta_s to the start of the nearest stream of its track that ended 10 minutes before to 20 after."""
    found = range_join(scrobbles(lib), streams(lib), ["user_id", "track_id"], "lf_at", "sp_end", 600, 1200).withColumn("delta_s", (micros(F.col("lf_at")) - micros(F.col("sp_at"))) / 1_000_000)
    return found.groupBy("lf_id").agg(F.min_by("delta_s", F.struct(F.abs("delta_s"), "sp_id")).alias("delta_s"))


def close_pairs(lib) -> DataFrame:
    """Pairs of one track that start within 180 s of each other."""
    return range_join(streams(lib), scrobbles(lib), ["user_id", "track_id"], "sp_at", "lf_at", 180, 180)


@query("sqp_b1_nearest_bins", f"{NEAREST} select cast(floor(delta_s / 15) * 15 as int) as bin_s, count(*) as pairs from near where abs(delta_s) <= 600 group by 1")
def _(lib):
    return nearest_deltas(lib).where(F.abs("delta_s") <= 600).groupBy((F.floor(F.col("delta_s") / 15) * 15).cast("int").alias("bin_s")).agg(number().alias("pairs"))


@query("sqp_b2_percentiles", f"{NEAREST} select count(*) as pairs, {', '.join(f'round(quantile_cont(abs(delta_s), {p}), 6) as p{int(p * 100)}' for p in (0.5, 0.9, 0.99))}, count_if(abs(delta_s) <= 30) as within_30, count_if(abs(delta_s) <= 180) as within_180 from near")
def _(lib):
    far = F.abs("delta_s")
    return nearest_deltas(lib).agg(number().alias("pairs"), *[F.round(F.percentile(far, F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)], F.count_if(far <= 30).alias("within_30"), F.count_if(far <= 180).alias("within_180"))


def gaps(df: DataFrame, keys: list[str], id: str) -> DataFrame:
    """The seconds since the row before of equal keys, in order of played_at."""
    w = Window.partitionBy(*keys).orderBy("played_at", id)
    return df.withColumn("gap_s", (micros(F.col("played_at")) - micros(F.lag("played_at").over(w))) / 1_000_000).where("gap_s is not null")


def gaps_sql(table: str, keys: str, id: str) -> str:
    return f"(select *, (epoch_us(played_at) - lag(epoch_us(played_at)) over (partition by {keys} order by played_at, {id})) / 1e6 as gap_s from {table}) g"


@query("sqp_c1_gaps", f"select connector, count(gap_s) as gaps, count_if(gap_s <= 30) as le_30, count_if(gap_s <= 180) as le_180, count_if(gap_s <= 360) as le_360 from {gaps_sql('connector_plays', 'user_id, connector, identifier', 'id')} where gap_s is not null group by connector")
def _(lib):
    found = gaps(lib.connector_plays, ["user_id", "connector", "identifier"], "id").groupBy("connector")
    return found.agg(number().alias("gaps"), *[F.count_if(F.col("gap_s") <= s).alias(f"le_{s}") for s in (30, 180, 360)])


@query("sqp_c2_several_candidates", f"{CLOSE} select count(*) as n from (select lf_id from near group by lf_id having count(*) >= 2) x")
def _(lib):
    return close_pairs(lib).groupBy("lf_id").agg(number().alias("candidates")).where("candidates > 1").agg(number().alias("n"))


@query("sqp_c3_identifiers", "with p as (select distinct service, track_id from track_plays) select service, count(*) as played, count(spotify_id) as with_spotify, count(isrc) as with_isrc, count(mbid) as with_mbid, count_if(coalesce(spotify_id, isrc, mbid) is null) as with_none from p join canonicals using (track_id) group by service")
def _(lib):
    own = lambda where: F.count_distinct(F.when(where, F.col("track_id")))
    known = [F.col(c).isNotNull() for c in ("spotify_id", "isrc", "mbid")]
    # plays are counted by distinct track: reduced first, so that a track played often is one row in the join
    played = lib.track_plays.select("service", "track_id").distinct().join(lib.canonicals, "track_id")
    return played.groupBy("service").agg(F.count_distinct("track_id").alias("played"), own(known[0]).alias("with_spotify"), own(known[1]).alias("with_isrc"), own(known[2]).alias("with_mbid"), own(~(known[0] | known[1] | known[2])).alias("with_none"))


DIVERGENT = f"with {SIDES}, divergent as (select lt.title as lf_title, st.title as sp_title, lt.artist, lf_at, sp_end, lf.track_id as lf_track, sp.track_id as sp_track, lf_id, sp_id from lf join sp on sp.user_id = lf.user_id and sp.track_id <> lf.track_id and abs(epoch_us(lf_at) - sp_us) <= 30000000 join canonicals lt on lt.track_id = lf.track_id join canonicals st on st.track_id = sp.track_id where lt.artist_normalized = st.artist_normalized and (lt.title_normalized = st.title_normalized or lt.title_stripped = st.title_stripped))"


def divergent_pairs(lib) -> DataFrame:
    """Plays that start within 30 s of each other on two tracks of the same artist and title."""
    named = lambda side: lib.canonicals.select(F.col("track_id").alias(f"{side}_track"), F.col("title").alias(f"{side}_title"), F.col("artist").alias(f"{side}_artist"), F.col("artist_normalized").alias(f"{side}_an"), F.col("title_normalized").alias(f"{side}_tn"), F.col("title_stripped").alias(f"{side}_ts"))
    side = lambda df, name: df.withColumnRenamed("track_id", f"{name}_track").join(named(name), f"{name}_track").withColumn("artist_key", F.col(f"{name}_an"))
    # the artist is part of the key, which keeps a user's busy minutes from meeting each other whole
    found = range_join(side(streams(lib), "sp"), side(scrobbles(lib), "lf"), ["user_id", "artist_key"], "sp_at", "lf_at", 30, 30, F.col("lf_track") != F.col("sp_track"))
    return found.where("lf_tn = sp_tn or lf_ts = sp_ts")


@query("sqp_d2_divergent", f"{DIVERGENT} select count(*) as pairs from divergent")
def _(lib):
    return divergent_pairs(lib).agg(number().alias("pairs"))


@query("sqp_d2b_sample", f"{DIVERGENT} select * from divergent order by lf_at desc, lf_id, sp_id limit 25")
def _(lib):
    own = divergent_pairs(lib).select("lf_title", "sp_title", F.col("lf_artist").alias("artist"), "lf_at", "sp_end", "lf_track", "sp_track", "lf_id", "sp_id")
    return own.orderBy(F.col("lf_at").desc(), "lf_id", "sp_id").limit(25)


@query("sqp_d3_played_duplicates", "with p as (select * from canonicals where track_id in (select track_id from track_plays)) select count(*) as pairs from p a join p b on a.user_id = b.user_id and a.artist_normalized = b.artist_normalized and a.title_normalized = b.title_normalized and a.track_id < b.track_id")
def _(lib):
    played = lib.canonicals.join(lib.track_plays.select("track_id"), "track_id", "left_semi").where("title_normalized is not null and artist_normalized is not null")
    # n tracks of one name are n (n - 1) / 2 pairs: counted, not joined
    groups = played.groupBy("user_id", "artist_normalized", "title_normalized").agg(number().alias("n"))
    return groups.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))


def mapped_via(lib) -> DataFrame:
    """Each track with whether its owner's mappings name either service."""
    of = lambda c: F.bool_or(F.col("connector") == c).alias(c)
    return lib.track_mappings.groupBy("track_id", "user_id").agg(of("spotify"), of("lastfm")).join(lib.canonicals, ["track_id", "user_id"])


MAPPED = "(select t.track_id, isrc, duration_ms, album, mbid, max(m.connector = 'spotify') as spotify, max(m.connector = 'lastfm') as lastfm from canonicals t join track_mappings m on m.track_id = t.track_id and m.user_id = t.user_id group by all) v"


@query("sqp_d4_coverage_matrix", f"select spotify, lastfm, count(*) as tracks from {MAPPED} where track_id in (select track_id from track_plays) group by all")
def _(lib):
    return mapped_via(lib).join(lib.track_plays.select("track_id"), "track_id", "left_semi").groupBy("spotify", "lastfm").agg(number().alias("tracks"))


@query("sqp_e1_surviving_pairs", f"{CLOSE} select count_if(abs(delta_s) <= 30) as within_30, count(*) as within_180 from near")
def _(lib):
    return close_pairs(lib).agg(F.count_if(F.abs("delta_s") <= 30).alias("within_30"), number().alias("within_180"))


@query("sqp_e3_source_sets", "select service, array_to_string(source_services, '+') as sources, count(*) as n from track_plays group by service, source_services order by n desc, service, sources limit 20")
def _(lib):
    sets = lib.track_plays.groupBy("service", "source_services").agg(number().alias("n"))
    return sets.select("service", F.array_join("source_services", "+").alias("sources"), "n").orderBy(F.col("n").desc(), "service", "sources").limit(20)


@query("sqp_e3_merged_keys", "select service, count_if(json_exists(context, '$.merged_from_lastfm')) as from_lastfm, count_if(json_exists(context, '$.merged_from_spotify')) as from_spotify from track_plays group by service")
def _(lib):
    has = lambda key: F.count_if(F.array_contains(F.json_object_keys("context"), key))
    return lib.track_plays.groupBy("service").agg(has("merged_from_lastfm").alias("from_lastfm"), has("merged_from_spotify").alias("from_spotify"))


@query("sqp_e3b_array_contains", "select count_if(list_has(source_services, 'spotify')) as n from track_plays where service = 'lastfm'")
def _(lib):
    return lib.track_plays.where("service = 'lastfm'").where(F.array_contains("source_services", "spotify")).agg(number().alias("n"))


def excess(df: DataFrame, service: str, *keys: str) -> DataFrame:
    each = df.groupBy(service, *keys).agg(number().alias("n")).where("n > 1")
    return each.groupBy(service).agg(number().alias("duplicates"), (F.sum("n") - number()).alias("excess"))


for name, table, service, key in (("sqp_e4_exact_duplicates", "track_plays", "service", "track_id"), ("sqp_e4b_ledger_duplicates", "connector_plays", "connector", "identifier")):
    query(name, f"select {service}, count(*) as duplicates, sum(n - 1)::bigint as excess from (select {service}, count(*) as n from {table} group by user_id, {service}, {key}, played_at) g where n >= 2 group by {service}")(lambda lib, table=table, service=service, key=key: excess(getattr(lib, table), service, "user_id", key, "played_at"))


@query("sqp_e5_near_duplicates", f"select service, count_if(gap_s <= 30) as le_30, count_if(gap_s >= 31 and gap_s <= 180) as to_180 from {gaps_sql('track_plays', 'user_id, service, track_id', 'play_id')} where gap_s is not null group by service")
def _(lib):
    gap = F.col("gap_s")
    return gaps(lib.track_plays, ["user_id", "service", "track_id"], "play_id").groupBy("service").agg(F.count_if(gap <= 30).alias("le_30"), F.count_if(gap.between(31, 180)).alias("to_180"))


@query("sqp_f1_json_keys", "select service, key, count(*) as n from (select service, unnest(json_keys(context)) as key from track_plays where play_id % 10 = 0) k group by all")
def _(lib):
    """A sample is this one's feature; a fixed tenth, so that it can be compared."""
    keys = lib.track_plays.where("play_id % 10 = 0").select("service", F.explode(F.json_object_keys("context")).alias("key"))
    return keys.groupBy("service", "key").agg(number().alias("n"))


for name, service, fields in (("sqp_f2_present", "spotify", ("platform", "shuffle", "skipped", "reason_start", "album_name")), ("sqp_f3_present", "lastfm", ("album_name", "lastfm_track_url", "mbid"))):
    rates = ", ".join(percent_sql(f"context->>'{f}'", 1) + f" as {f}_percent" for f in fields)

    @query(name, f"select import_source, count(*) as plays, {rates}, {percent_sql('ms_played', 1)} as ms_played_percent from track_plays where service = '{service}' group by import_source")
    def _(lib, service=service, fields=fields):
        own = lib.track_plays.where(F.col("service") == service).groupBy("import_source")
        return own.agg(number().alias("plays"), *[percent(json("context", f"$.{f}"), 1).alias(f"{f}_percent") for f in fields], percent(F.col("ms_played"), 1).alias("ms_played_percent"))


RICH = ("isrc", "duration_ms", "album", "mbid")


@query("sqp_f4_richness", f"select case when spotify and lastfm then 'both' when spotify then 'spotify only' else 'lastfm only' end as via, count(*) as tracks, {', '.join(percent_sql(c, 1) + f' as {c}_percent' for c in RICH)} from {MAPPED} group by 1")
def _(lib):
    via = F.when(F.col("spotify") & F.col("lastfm"), "both").when(F.col("spotify"), "spotify only").otherwise("lastfm only")
    return mapped_via(lib).groupBy(via.alias("via")).agg(number().alias("tracks"), *[percent(F.col(c), 1).alias(f"{c}_percent") for c in RICH])


@query("sqp_g1_month_services", "select cast(date_trunc('month', played_at) as date) as month, count_if(service = 'spotify') as spotify, count_if(service = 'lastfm') as lastfm from track_plays group by 1")
def _(lib):
    return lib.track_plays.groupBy(F.trunc(F.to_date("played_at"), "month").alias("month")).pivot("service", ["spotify", "lastfm"]).count().na.fill(0)


@query("sqp_g2_gap_days", "select count_if(sp > 0 and lf = 0) as spotify_only, count_if(lf > 0 and sp = 0) as lastfm_only, count_if(sp > 0 and lf > 0) as both_services from (select sum((service = 'spotify')::int) as sp, sum((service = 'lastfm')::int) as lf from track_plays group by user_id, played_at::date) d")
def _(lib):
    """Days of each user."""
    has = lambda s: F.bool_or(F.col("service") == s).alias(s)
    days = lib.track_plays.groupBy("user_id", F.to_date("played_at")).agg(has("spotify"), has("lastfm"))
    s, l = F.col("spotify"), F.col("lastfm")
    return days.agg(F.count_if(s & ~l).alias("spotify_only"), F.count_if(l & ~s).alias("lastfm_only"), F.count_if(s & l).alias("both_services"))


# The audit of the ledger

WINDOW_S, TOLERANCE_S, FLOOR_MS, BURST_S = 600, 180, 30_000, 60


def ledger(lib, source: str, name: str) -> DataFrame:
    """A channel's rows with what they are paired by; `name` starts the columns of its own."""
    meta = lambda k: F.lower(json("raw_metadata", f"$.{k}"))
    own = lib.connector_plays.where(F.col("import_source") == source)
    duration = json("raw_metadata", "$.service_metadata.duration_ms").try_cast("long")
    return own.select(F.col("id").alias(f"{name}_id"), "user_id", "resolved_track_id", meta("artist_name").alias("artist_key"), meta("track_name").alias("track_key"), F.col("played_at").alias(f"{name}_at"), duration.alias(f"{name}_duration"), F.col("ms_played").alias(f"{name}_ms"), "connector", "identifier")


SAME = [["user_id", "resolved_track_id"], ["user_id", "artist_key", "track_key"]]
KEYED = "keyed as (select *, lower(raw_metadata->>'artist_name') as artist_key, lower(raw_metadata->>'track_name') as track_key, (raw_metadata->'service_metadata'->>'duration_ms')::bigint as said_ms from connector_plays)"
SAME_SQL = "{b}.user_id = {a}.user_id and ({b}.resolved_track_id = {a}.resolved_track_id or ({b}.artist_key = {a}.artist_key and {b}.track_key = {a}.track_key))"


def scrobbled(lib) -> DataFrame:
    return ledger(lib, "lastfm_api", "lf").select("lf_id", "user_id", "resolved_track_id", "artist_key", "track_key", "lf_at")


@query("aud0_as_of_nearest", f"with {KEYED}, pairs as (select a.id as a, arg_min(b, (abs(epoch_us(b.played_at) - epoch_us(a.played_at)), b.id)) as best from keyed a join keyed b on b.import_source = 'lastfm_api' and {SAME_SQL.format(a='a', b='b')} and abs(epoch_us(b.played_at) - epoch_us(a.played_at)) <= {WINDOW_S} * 1000000 where a.import_source = 'spotify_api' group by a.id) select k.id as api_id, k.played_at as api_at, best.played_at as lf_at, k.said_ms as api_duration, (epoch_us(best.played_at) - epoch_us(k.played_at)) / 1e6 as delta_s from keyed k left join pairs on a = k.id where k.import_source = 'spotify_api'")
def _(lib):
    found = nearest(ledger(lib, "spotify_api", "api"), scrobbled(lib), SAME, "api_id", "lf_id", "api_at", "lf_at", WINDOW_S, WINDOW_S)
    return found.select("api_id", "api_at", "lf_at", "api_duration", "delta_s")


@query("aud0b_unpaired", f"select count(*) as n from connector_plays l where import_source = 'lastfm_api' and played_at >= (select min(played_at) from connector_plays where import_source = 'spotify_api') and not exists (select 1 from connector_plays a where a.import_source = 'spotify_api' and a.user_id = l.user_id and abs(epoch_us(a.played_at) - epoch_us(l.played_at)) <= {WINDOW_S} * 1000000)")
def _(lib):
    api = ledger(lib, "spotify_api", "api").select("api_id", "user_id", "api_at")
    first = api.agg(F.min("api_at").alias("first_at"))
    late = scrobbled(lib).select("lf_id", "user_id", "lf_at").join(F.broadcast(first), F.col("lf_at") >= F.col("first_at")).drop("first_at")  # one row
    near = range_join(late, api, ["user_id"], "lf_at", "api_at", WINDOW_S, WINDOW_S).select("lf_id").distinct()
    return late.join(near, "lf_id", "left_anti").agg(number().alias("n"))


TABLES = ("canonicals", "connector_tracks", "track_mappings", "reviews", "negatives", "likes", "track_plays", "connector_plays", "entries", "preferences", "tags", "metrics", "runs")
OWNED = ("canonicals", "track_mappings", "track_plays", "connector_plays")


@query("aud0c_census", " union all ".join(f"select '{t}' as name, null::bigint as user_id, count(*) as n from {t}" for t in TABLES) + "".join(f" union all select '{t}', user_id, count(*) from {t} group by user_id" for t in OWNED))
def _(lib):
    """Rows of every table, and of each user where tables have one."""
    from functools import reduce

    parts = [getattr(lib, t).agg(number().alias("n")).select(F.lit(t).alias("name"), F.lit(None).cast("long").alias("user_id"), "n") for t in TABLES]
    parts += [getattr(lib, t).groupBy(F.col("user_id").cast("long").alias("user_id")).agg(number().alias("n")).select(F.lit(t).alias("name"), "user_id", "n") for t in OWNED]
    return reduce(DataFrame.unionByName, parts)


@query("aud0c_ledger_ranges", "select coalesce(import_source, 'all plays') as import_source, count(*) as n, min(played_at) as first_at, max(played_at) as last_at from (select import_source, played_at from connector_plays union all select null, played_at from track_plays) x group by 1")
def _(lib):
    ranges = lambda df: df.agg(number().alias("n"), F.min("played_at").alias("first_at"), F.max("played_at").alias("last_at"))
    return ranges(lib.connector_plays.groupBy("import_source")).unionByName(ranges(lib.track_plays.groupBy(F.lit("all plays").alias("import_source"))))


@query("aud0c_lifecycle", "select count(*) - count(superseded_at) as live, count(superseded_at) as superseded from track_mappings")
def _(lib):
    gone = F.col("superseded_at").isNotNull()
    return lib.track_mappings.agg(F.count_if(~gone).alias("live"), F.count_if(gone).alias("superseded"))


DISCARDED = "with discarded as (select p.id, p.ms_played, p.played_at, c.duration_ms, p.raw_metadata->'service_metadata'->>'reason_end' as reason_end, p.raw_metadata->'service_metadata'->>'reason_start' as reason_start from connector_plays p join connector_tracks c on c.connector = p.connector and c.identifier = regexp_replace(p.identifier, '^spotify:track:', '') where p.resolved_track_id is null and p.ms_played is not null and coalesce(p.raw_metadata->'service_metadata'->>'incognito_mode', 'false') <> 'true' and exists (select 1 from track_mappings m where m.connector_track_id = c.id and m.user_id = p.user_id and m.superseded_at is null))"


def catalogued(lib, how: str = "inner") -> DataFrame:
    """Ledger rows with their service's track: the ledger has whole URIs, the catalogue bare ids."""
    known = lib.connector_tracks.select("connector", F.col("identifier").alias("bare"), F.col("id").alias("catalogue_id"), "duration_ms", "title", "artist")
    return lib.connector_plays.withColumn("bare", F.regexp_replace("identifier", "^spotify:track:", "")).join(known, ["connector", "bare"], how)


def discarded(lib) -> DataFrame:
    """Plays whose track is known and mapped and that were dropped all the same: not long enough."""
    meta = lambda k: json("raw_metadata", f"$.service_metadata.{k}")
    dropped = catalogued(lib).where("resolved_track_id is null and ms_played is not null").where(F.coalesce(meta("incognito_mode"), F.lit("false")) != "true")
    live = lib.track_mappings.where("superseded_at is null").select(F.col("connector_track_id").alias("catalogue_id"), F.col("user_id").cast("long").alias("user_id")).distinct()
    return dropped.join(live, ["catalogue_id", "user_id"], "left_semi").select("id", "ms_played", "played_at", "duration_ms", meta("reason_end").alias("reason_end"), meta("reason_start").alias("reason_start"))


def fraction() -> Column:
    """How much of a track was heard; null where its duration is unknown."""
    return F.when(F.col("duration_ms") > 0, F.col("ms_played") / F.col("duration_ms"))


@query("aud1_discards", f"{DISCARDED} select * from discarded")
def _(lib):
    return discarded(lib)


@query("aud2_by_reason", f"{DISCARDED} select reason_end, count(*) as n, round(avg(ms_played) / 1000.0, 0) as mean_s, round(100 * avg(case when duration_ms > 0 then ms_played::double / duration_ms end), 0) as mean_percent from discarded group by reason_end")
def _(lib):
    return discarded(lib).groupBy("reason_end").agg(number().alias("n"), F.round(F.avg("ms_played") / 1000, 0).alias("mean_s"), F.round(100 * F.avg(fraction()), 0).alias("mean_percent"))


BANDS = (0.05, 0.15, 0.25, 0.35)


@query("aud2_fraction_bands", f"{DISCARDED} select case when coalesce(duration_ms, 0) = 0 then -1 else (select count(*) from (values {', '.join(f'({b}::double)' for b in BANDS)}) e(edge) where ms_played::double / duration_ms >= edge) end::int as band, count(*) as n from discarded group by 1")
def _(lib):
    """-1 where the duration is unknown, else how many of BANDS the heard fraction has reached."""
    band = F.when(fraction().isNull(), F.lit(-1)).otherwise(sum(((fraction() >= b).cast("int") for b in BANDS), F.lit(0)))
    return discarded(lib).groupBy(band.cast("int").alias("band")).agg(number().alias("n"))


@query("aud2_what_if", f"{DISCARDED} select count(*) as discards, count_if(ms_played >= 30000) as half_minute, count_if(duration_ms > 0 and ms_played >= 0.25::double * duration_ms) as quarter, count_if(duration_ms > 0 and ms_played::double / duration_ms >= 0.33::double) as third, count_if(reason_end = 'trackdone') as completed from discarded")
def _(lib):
    return discarded(lib).agg(number().alias("discards"), F.count_if(F.col("ms_played") >= 30_000).alias("half_minute"), F.count_if(fraction() >= 0.25).alias("quarter"), F.count_if(fraction() >= 0.33).alias("third"), F.count_if(F.col("reason_end") == "trackdone").alias("completed"))


@query("aud2_by_year", f"{DISCARDED} select extract(year from played_at)::int as year, count(*) as n from discarded group by 1")
def _(lib):
    return discarded(lib).groupBy(F.year("played_at").alias("year")).agg(number().alias("n"))


@query("aud3_cadence", f"{DISCARDED}, per_day as (select count(*) as n from discarded group by played_at::date), g as (select (epoch_us(played_at) - lag(epoch_us(played_at)) over (order by played_at)) / 1e6 as gap from discarded) select sum(n)::bigint as total, count(*) as active_days, round(avg(n), 1) as mean_n, quantile_cont(n, 0.5) as median_n, round(quantile_cont(n, 0.9), 6) as p90_n, max(n) as most, (select count_if(gap <= {BURST_S}) from g) as in_burst, (select count(gap) from g) as gaps from per_day")
def _(lib):
    found = discarded(lib).select(F.to_date("played_at").alias("day"), micros(F.col("played_at")).alias("us"))
    days = found.groupBy("day").agg(number().alias("n")).agg(F.sum("n").alias("total"), number().alias("active_days"), F.round(F.avg("n"), 1).alias("mean_n"), F.median("n").alias("median_n"), F.round(F.percentile("n", F.lit(0.9)), 6).alias("p90_n"), F.max("n").alias("most"))
    # what came at most BURST_S after another: all but the first of a bin that wide, and the first if the bin before ends near; no window over all rows
    bins = found.groupBy(F.floor(F.col("us") / (BURST_S * 1_000_000)).alias("bin")).agg(number().alias("n"), F.min("us").alias("first"), F.max("us").alias("last"))
    before = bins.select((F.col("bin") + 1).alias("bin"), F.col("last").alias("before"))
    near = bins.join(before, "bin", "left").agg(F.sum(F.col("n") - 1 + F.coalesce((F.col("first") - F.col("before") <= BURST_S * 1_000_000).cast("int"), F.lit(0))).alias("in_burst"), (F.sum("n") - 1).alias("gaps"))
    return days.crossJoin(near)  # one row each


@query("aud4_start_reasons", f"{DISCARDED} select case when coalesce(reason_start, '') = '' then '(none)' else reason_start end as reason_start, count(*) as n, round(avg(ms_played) / 1000.0, 1) as mean_s from discarded group by 1 order by n desc, 1 limit 8")
def _(lib):
    reason = F.coalesce(F.nullif("reason_start", F.lit("")), F.lit("(none)"))
    found = discarded(lib).groupBy(reason.alias("reason_start")).agg(number().alias("n"), F.round(F.avg("ms_played") / 1000, 1).alias("mean_s"))
    return found.orderBy(F.col("n").desc(), "reason_start").limit(8)


@query("aud4_heaviest_days", f"{DISCARDED} select played_at::date as day, count(*) as n, count_if(reason_start = 'clickrow') as clickrow, round(avg(ms_played) / 1000.0, 1) as mean_s, min(strftime(played_at, '%H:%M:%S')) as first_at, max(strftime(played_at, '%H:%M:%S')) as last_at from discarded group by 1 order by n desc, day limit 5")
def _(lib):
    clock = lambda f: F.date_format(f("played_at"), "HH:mm:ss")
    found = discarded(lib).groupBy(F.to_date("played_at").alias("day")).agg(number().alias("n"), F.count_if(F.col("reason_start") == "clickrow").alias("clickrow"), F.round(F.avg("ms_played") / 1000, 1).alias("mean_s"), clock(F.min).alias("first_at"), clock(F.max).alias("last_at"))
    return found.orderBy(F.col("n").desc(), "day").limit(5)


EXPORTED = "coalesce(c.duration_ms > 0 and c.duration_ms <= {floor}, false)".format(floor=FLOOR_MS)
EXPORT_SQL = f"with {KEYED}, exported as (select p.*, c.title, c.artist, c.duration_ms, {EXPORTED} as is_short, epoch_us(p.played_at) - coalesce(p.ms_played, 0) * 1000 as start_us from keyed p left join connector_tracks c on c.connector = p.connector and c.identifier = regexp_replace(p.identifier, '^spotify:track:', '') where p.import_source = 'spotify_export' and p.resolved_track_id is not null)"


def exported(lib) -> DataFrame:
    """Counted plays of the export, with whether their track is shorter than what the other service takes."""
    keys = [F.lower(json("raw_metadata", f"$.{k}_name")).alias(f"{k}_key") for k in ("artist", "track")]
    rows = catalogued(lib, "left").where("import_source = 'spotify_export' and resolved_track_id is not null")
    start = F.timestamp_micros(micros(F.col("played_at")) - F.coalesce("ms_played", F.lit(0)) * 1000).cast("timestamp_ntz")
    return rows.select("id", "user_id", "resolved_track_id", *keys, "played_at", start.alias("start_at"), "ms_played", "duration_ms", "title", "artist", F.coalesce((F.col("duration_ms") > 0) & (F.col("duration_ms") <= FLOOR_MS), F.lit(False)).alias("is_short"))


def with_scrobble(plays: DataFrame, lib, time: str, seconds: int) -> DataFrame:
    """Adds near: whether the same user scrobbled the same track around then."""
    parts = []
    for keys in SAME:
        side = scrobbled(lib).select("lf_at", *keys)
        parts.append(range_join(plays.select("id", time, *keys), side, keys, time, "lf_at", seconds, seconds).select("id"))
    near = parts[0].unionByName(parts[1]).distinct().withColumn("near", F.lit(True))
    return plays.join(near, "id", "left").withColumn("near", F.coalesce("near", F.lit(False)))


@query("aud5_short_tracks", f"{EXPORT_SQL} select count(*) as plays, count(distinct resolved_track_id) as tracks, round(avg(duration_ms) / 1000.0, 1) as mean_s, count_if(ms_played >= duration_ms) as in_full, count_if(exists (select 1 from keyed l where l.import_source = 'lastfm_api' and {SAME_SQL.format(a='e', b='l')} and abs(epoch_us(l.played_at) - epoch_us(e.played_at)) <= {WINDOW_S} * 1000000)) as scrobbled from exported e where is_short")
def _(lib):
    short = with_scrobble(exported(lib).where("is_short"), lib, "played_at", WINDOW_S)
    return short.agg(number().alias("plays"), F.count_distinct("resolved_track_id").alias("tracks"), F.round(F.avg("duration_ms") / 1000, 1).alias("mean_s"), F.count_if(F.col("ms_played") >= F.col("duration_ms")).alias("in_full"), F.count_if("near").alias("scrobbled"))


@query("aud5_exemplars", f"{EXPORT_SQL} select artist, title, round(avg(duration_ms) / 1000.0, 1) as mean_s, count(*) as plays from exported where is_short group by artist, title order by plays desc, mean_s, artist, title limit 5")
def _(lib):
    found = exported(lib).where("is_short").groupBy("artist", "title").agg(F.round(F.avg("duration_ms") / 1000, 1).alias("mean_s"), number().alias("plays"))
    return found.orderBy(F.col("plays").desc(), "mean_s", "artist", "title").limit(5)


@query("aud5b_pairing_rate", f"{EXPORT_SQL} select count(*) as plays, count_if(is_short) as blind, count_if(not is_short and exists (select 1 from keyed l where l.import_source = 'lastfm_api' and {SAME_SQL.format(a='e', b='l')} and abs(epoch_us(l.played_at) - start_us) <= {TOLERANCE_S} * 1000000)) as paired from exported e where played_at::date in (select played_at::date from keyed where import_source = 'lastfm_api')")
def _(lib):
    days = scrobbled(lib).select(F.to_date("lf_at").alias("day")).distinct()
    covered = exported(lib).withColumn("day", F.to_date("played_at")).join(days, "day", "left_semi")
    found = with_scrobble(covered, lib, "start_at", TOLERANCE_S)
    return found.agg(number().alias("plays"), F.count_if("is_short").alias("blind"), F.count_if(~F.col("is_short") & F.col("near")).alias("paired"))


@query("aud6_duplicate_groups", "with g as (select title_normalized as t, artist_normalized as a from canonicals where user_id = 0 and title_normalized is not null and artist_normalized is not null group by all having count(*) > 1) select c.track_id, title_normalized, artist_normalized, title, artist, isrc, spotify_id, mbid, duration_ms, created_at, (select count(*) from track_plays p where p.track_id = c.track_id) as plays from canonicals c join g on t = title_normalized and a = artist_normalized where user_id = 0")
def _(lib):
    """All members of groups of one user's tracks with equal names, each with its plays."""
    own = lib.canonicals.where("user_id = 0 and title_normalized is not null and artist_normalized is not null")
    shared = own.groupBy("title_normalized", "artist_normalized").agg(number().alias("members")).where("members > 1").drop("members")
    plays = lib.track_plays.groupBy("track_id").agg(number().alias("plays"))
    rows = own.join(shared, ["title_normalized", "artist_normalized"], "left_semi").join(plays, "track_id", "left")
    return rows.select("track_id", "title_normalized", "artist_normalized", "title", "artist", "isrc", "spotify_id", "mbid", "duration_ms", "created_at", F.coalesce("plays", F.lit(0)).alias("plays"))


CLASHES = (("isrc",), ("spotify_id",), ("mbid",), ("title_normalized", "artist_normalized"))


@query("aud7_cross_owner_clashes", "with depended as (select track_id from track_plays where user_id = 0 union select resolved_track_id from connector_plays where user_id = 0 and resolved_track_id is not null), f as (select * from canonicals where user_id <> 0 and track_id in (select track_id from depended)), o as (select * from canonicals where user_id = 0), c as (select f.*, (select min(o.track_id) from o where o.isrc = f.isrc) as clash_isrc, (select min(o.track_id) from o where o.spotify_id = f.spotify_id) as clash_spotify_id, (select min(o.track_id) from o where o.mbid = f.mbid) as clash_mbid, (select min(o.track_id) from o where o.title_normalized = f.title_normalized and o.artist_normalized = f.artist_normalized) as clash_title_normalized from f) select c.track_id as foreign_id, c.user_id as foreign_owner, clash_isrc, clash_spotify_id, clash_mbid, clash_title_normalized, o.track_id as owned_id, (select count(*) from track_plays p where p.user_id = 0 and p.track_id = c.track_id) as own_plays, (select count(*) from connector_plays p where p.user_id = 0 and p.resolved_track_id = c.track_id) as own_ledger, (select count(*) from track_plays p where p.track_id = c.track_id) as foreign_plays, (select count(*) from track_plays p where p.track_id = o.track_id) as owned_plays from c join o on o.track_id = coalesce(clash_isrc, clash_spotify_id, clash_mbid, clash_title_normalized)")
def _(lib):
    """Another owner's tracks that one user's plays depend on, with the own track that stands in the way of taking them over."""
    mine, ledger_mine = lib.track_plays.where("user_id = 0"), lib.connector_plays.where("user_id = 0 and resolved_track_id is not null").withColumnRenamed("resolved_track_id", "track_id")
    depended = mine.select("track_id").unionByName(ledger_mine.select("track_id")).distinct()
    out = lib.canonicals.where("user_id <> 0").join(depended, "track_id", "left_semi")
    owned = lib.canonicals.where("user_id = 0")
    for keys in CLASHES:
        first = owned.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min("track_id").alias(f"clash_{keys[0]}"))
        out = out.join(first, list(keys), "left")
    names = [f"clash_{keys[0]}" for keys in CLASHES]
    out = out.select(F.col("track_id").alias("foreign_id"), F.col("user_id").alias("foreign_owner"), *names, F.coalesce(*names).alias("owned_id")).where("owned_id is not null")
    for df, key, name in ((mine, "foreign_id", "own_plays"), (ledger_mine, "foreign_id", "own_ledger"), (lib.track_plays, "foreign_id", "foreign_plays"), (lib.track_plays, "owned_id", "owned_plays")):
        counts = df.groupBy(F.col("track_id").alias(key)).agg(number().alias(name))
        out = out.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
