"""Text functions, scalar functions and record matching."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracklight.functions import scalars, scoring, text
from tracklight.operators import matching
from tracklight.queries import T, query


@query("er1_normalize", r"select distinct p_name as s, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower('The ' || p_name || ' & Ünï-code (feat. X) + p_1')), '\bfeat\.?\b', 'featuring', 'g'), '\s*[&+]\s*', ' and ', 'g'), '^the\s+', ''), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) as n from part")
def _(lib):
    full = F.concat(F.lit("The "), F.col("p_name"), F.lit(" & Ünï-code (feat. X) + p_1"))
    return lib.part.select("p_name").distinct().select(F.col("p_name").alias("s"), text.normalize(full).alias("n"))


@query("er2_strip_diacritics", "select distinct p_brand as s, strip_accents('Çà et là: ' || p_brand) as n from part")
def _(lib):
    return lib.part.select("p_brand").distinct().select(F.col("p_brand").alias("s"), text.strip_diacritics(F.concat(F.lit("Çà et là: "), F.col("p_brand"))).alias("n"))


@query("er3_strip_parentheticals", "select distinct p_name as s, p_name as n from part")
def _(lib):
    titled = F.concat(F.col("p_name"), F.lit(" (Live) [Deluxe] - Remastered 2011"))
    return lib.part.select("p_name").distinct().select(F.col("p_name").alias("s"), text.strip_parentheticals(titled).alias("n"))


# Words with well-known keys, one for each customer in turn.
SPOKEN = ("Björk", "Smith", "Smyth", "Knight", "Philip", "Church", "42")
KEYS = ("BJRK", "SM0", "SM0", "NT", "FLP", "XRX", "")


def spoken(k) -> "F.Column":
    return F.get(F.array(*[F.lit(w) for w in SPOKEN]), (k % len(SPOKEN)).cast("int"))


def in_turn_sql(values, k: str) -> str:
    return "case " + k + f" % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


@query("er4_phonetic_key", f"select c_custkey, {in_turn_sql(SPOKEN, 'c_custkey')} as s, {in_turn_sql(KEYS, 'c_custkey')} as k from customer")
def _(lib):
    return lib.customer.select("c_custkey", spoken(F.col("c_custkey")).alias("s")).withColumn("k", text.phonetic_key("s"))



@query("er5_phonetic_matches", f"with w as (select c_custkey, {in_turn_sql(KEYS, 'c_custkey')} as a, {in_turn_sql(KEYS, '(c_custkey // 7)')} as b from customer) select c_custkey, a = b and a <> '' as same from w")
def _(lib):
    """Two words for each customer: equal keys match, but empty ones."""
    rows = lib.customer.select("c_custkey", spoken(F.col("c_custkey")).alias("a"), spoken(F.floor(F.col("c_custkey") / 7)).alias("b"))
    return rows.withColumn("x", text.phonetic_key("a")).withColumn("y", text.phonetic_key("b")).select("c_custkey", ((F.col("x") == F.col("y")) & (F.col("x") != "")).alias("same"))



@query("er6_title_similarity")
def _(lib):
    own = matching.prepare(lib.tracks.select("track_id", "title", "artist", "duration_ms"))
    raw = matching.prepare(lib.tracks.select("track_id", F.when(F.col("track_id") % 80 == 0, F.concat("title", F.lit(" - Live"))).otherwise(F.reverse("title")).alias("title"), "artist", (F.col("duration_ms") + 2500).alias("duration_ms")))
    pairs = matching.sided(own, "a").join(matching.sided(raw, "b"), F.col("a_track_id") == F.col("b_track_id")).withColumn("method", F.lit("artist_title"))
    return matching.score(pairs).select("a_track_id", "a_title", "b_title", F.round("title_similarity", 6).alias("title_similarity"), "title_level", "artist_level", "duration_level", "confidence", "zone")


@query("er7_best_by_title")
def _(lib):
    # every track, with all tracks of its artist and album as candidates, itself among them
    ref = lib.tracks.select(F.col("track_id").alias("reference_id"), "title", "artist", "album")
    can = lib.tracks.select("artist", "album", F.col("track_id").alias("position"), F.col("track_id").alias("candidate_id"), F.col("title").alias("name"))
    return matching.best_in_catalogue(ref, can, ["artist", "album"], 0.3).withColumn("similarity", F.round("similarity", 6))


@query("er7_best_other_title")
def _(lib):
    # every track's title without its last word, against all tracks of its artist whose number differs in parity
    odd = F.col("track_id") % 2
    ref = lib.tracks.select(F.col("track_id").alias("reference_id"), F.regexp_replace("title", r"\s+\S+$", "").alias("title"), "artist", odd.alias("odd"))
    can = lib.tracks.select("artist", (1 - odd).alias("odd"), F.col("track_id").alias("position"), F.col("track_id").alias("candidate_id"), F.col("title").alias("name"))
    return matching.best_in_catalogue(ref, can, ["artist", "odd"], 0.3).withColumn("similarity", F.round("similarity", 6))


def _ln(m: float, u: float) -> str:
    return repr(math.log(m / u))


DIFF = "case when a.duration_ms <> 0 and b.l_quantity <> 0 then abs(a.duration_ms - cast(b.l_quantity * 10000 as bigint)) end"
LEVEL = "case when d is null then 'missing' when d <= 1000 then 'close' when d <= 3000 then 'near' when d <= 10000 then 'moderate' else 'mismatch' end"
WEIGHT = " + ".join(
    [
        f"case when a.track_id % 2 = 0 then {_ln(*scoring.TITLE['exact'])} else {_ln(*scoring.TITLE['mismatch'])} end",
        f"{_ln(*scoring.ARTIST['exact'])}",
        f"case lev when 'missing' then 0.0 when 'close' then {_ln(*scoring.DURATION['close'])} when 'near' then {_ln(*scoring.DURATION['near'])} when 'moderate' then {_ln(*scoring.DURATION['moderate'])} else {_ln(*scoring.DURATION['mismatch'])} end",
        f"case when method = 'artist_title' then 0.0 when coalesce(d > 10000, false) then {_ln(*scoring.ISRC['suspect'])} else {_ln(*scoring.ISRC['exact'])} end",
    ]
).replace("a.track_id", "track_id")


@query("er8_confidence", f"with p as (select a.track_id, {DIFF} as d, case b.l_returnflag when 'R' then 'isrc' when 'A' then 'mbid' else 'artist_title' end as method from tracks a join lineitem b on b.l_partkey = a.track_id), q as (select *, {LEVEL} as lev from p), r as (select *, cast(round_even(100 / (1 + exp(-({WEIGHT}))), 0) as int) as confidence from q) select confidence, lev, case when confidence >= 85 and not (method <> 'artist_title' and lev = 'missing') then 'accept' when confidence >= 50 then 'review' else 'reject' end as zone, count(*) as n from r group by 1, 2, 3")
def _(lib):
    rows = lib.tracks.join(lib.lineitem, F.col("l_partkey") == F.col("track_id"))
    diff = scoring.duration_difference(F.col("duration_ms"), (F.col("l_quantity") * 10_000).cast("long"))
    method = F.when(F.col("l_returnflag") == "R", "isrc").when(F.col("l_returnflag") == "A", "mbid").otherwise("artist_title")
    out = rows.select("track_id", diff.alias("d"), method.alias("method")).withColumn("lev", scoring.duration_level(F.col("d")))
    title = F.when(F.col("track_id") % 2 == 0, "exact").otherwise("mismatch")
    w = scoring.weight(title, F.lit("exact"), F.col("lev"), scoring.isrc_level(F.col("method") != "artist_title", scoring.isrc_suspect(F.col("d"))))
    out = out.withColumn("confidence", scoring.confidence(w))
    return out.withColumn("zone", scoring.zone(F.col("confidence"), F.col("method"), F.col("lev") == "missing")).groupBy("confidence", "lev", "zone").agg(F.count(F.lit(1)).alias("n"))


@query("er9_levels", "select mapping_id, case when s is null then 'missing' when s >= 1 then 'exact' when mapping_id % 4 = 1 then 'variation' when mapping_id % 4 = 2 then 'phonetic' when s >= 0.9 then 'high' when s >= 0.7 then 'moderate' else 'mismatch' end as title from (select mapping_id, case when confidence % 10 <> 3 then confidence / 100 end as s from track_mappings) z")
def _(lib):
    s = F.when(F.col("confidence") % 10 != 3, F.col("confidence") / 100)
    return lib.track_mappings.select("mapping_id", scoring.title_level(s, F.col("mapping_id") % 4 == 1, F.col("mapping_id") % 4 == 2).alias("title"))



@query("er11_duration_levels", f"select track_id, lev, count(*) as n from (select a.track_id % 10 as track_id, {DIFF} as d, {LEVEL.replace('d is', DIFF + ' is').replace('d <=', DIFF + ' <=')} as lev from tracks a join lineitem b on b.l_partkey = a.track_id) z group by 1, 2")
def _(lib):
    diff = scoring.duration_difference(F.col("duration_ms"), (F.col("l_quantity") * 10_000).cast("long"))
    rows = lib.tracks.join(lib.lineitem, F.col("l_partkey") == F.col("track_id"))
    return rows.select((F.col("track_id") % 10).alias("track_id"), scoring.duration_level(diff).alias("lev")).groupBy("track_id", "lev").agg(F.count(F.lit(1)).alias("n"))


@query("er18_evaluate")
def _(lib):
    matches = lib.tracks.where("track_id % 5 <> 0").select("track_id", F.col("track_id").alias("connector_id"), F.when(F.col("track_id") % 5 == 1, F.reverse("title")).otherwise(F.upper("title")).alias("title"), "artist", "duration_ms", F.when(F.col("track_id") % 5 == 2, "isrc").otherwise("artist_title").alias("method"))
    return matching.evaluate(lib.tracks, matches)


@query("er19_same_recordings", "select a.track_id as a_id, b.track_id as b_id from tracks a join tracks b on lower(a.title) = lower(b.title) and lower(a.artist) = lower(b.artist) and a.track_id < b.track_id and abs(a.duration_ms - b.duration_ms) <= 10000")
def _(lib):
    return matching.same_recordings(lib.tracks.select(F.col("track_id").alias("id"), F.lower("title").alias("title_normalized"), F.lower("artist").alias("artist_normalized"), "duration_ms"))


@query("er20_identity_key", "select lower(artist) || '::' || lower(title) as k, count(*) as n from tracks group by 1")
def _(lib):
    return lib.tracks.groupBy(F.concat_ws("::", F.lower("artist"), F.lower("title")).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("er21_pair_digest", "select track_id, substr(sha256('{\"a\":\"' || title || '\",\"b\":\"' || artist || '\"}'), 1, 16) as digest from tracks")
def _(lib):
    return lib.tracks.select("track_id", scalars.pair_digest(F.col("title").alias("a"), F.col("artist").alias("b")).alias("digest"))


@query("er22_config_digest", "select run_id, substr(sha256('{\"n\":' || workflow_id || ',\"status\":\"' || status || '\"}'), 1, 12) as digest from runs")
def _(lib):
    """Of each run's settings, whatever the order in which they are written."""
    config = F.when(F.col("run_id") % 2 == 0, F.format_string('{"n": %d, "status": "%s"}', "workflow_id", "status")).otherwise(F.format_string('{"status":"%s","n":%d}', "status", "workflow_id"))
    return lib.runs.select("run_id", scalars.config_digests(config).alias("digest"))



@query("er23_normalize_isrc", "select track_id, case when track_id % 2 = 0 then isrc end as isrc from tracks")
def _(lib):
    raw = F.when(F.col("track_id") % 2 == 0, F.lower(F.concat(F.substring("isrc", 1, 5), F.lit("-"), F.substring("isrc", 6, 7)))).otherwise(F.concat("isrc", F.lit("X")))
    return lib.tracks.select("track_id", scalars.normalize_isrc(raw).alias("isrc"))


@query("er24_pair_identifier", "select track_id, lower(trim(artist)) || '::' || lower(trim(title)) as id from tracks")
def _(lib):
    return lib.tracks.select("track_id", scalars.pair_identifier(F.concat(F.lit(" "), F.col("artist")), F.col("title")).alias("id"))


@query("er25_survivors", "select artist as group_id, track_id as id from (select *, case when y <= 40 then 2000 + y else 1900 + y end as year from (select *, try_cast(substr(isrc, 6, 2) as int) as y from tracks) z) q qualify row_number() over (partition by artist order by year desc nulls last, created_at desc nulls last, track_id) = 1")
def _(lib):
    return matching.survivors(lib.tracks.select(F.col("artist").alias("group_id"), F.col("track_id").alias("id"), "isrc", "created_at"))


@query("er26_isrc_year", "select track_id, case when y <= 40 then 2000 + y else 1900 + y end as year from (select track_id, try_cast(substr(code, 6, 2) as int) as y from (select track_id, case track_id % 4 when 0 then 'USAAAXX12345' when 1 then isrc else 'USAAA' || lpad((track_id % 100)::varchar, 2, '0') || '12345' end as code from tracks) a) b")
def _(lib):
    code = F.when(F.col("track_id") % 4 == 0, "USAAAXX12345").when(F.col("track_id") % 4 == 1, F.col("isrc")).otherwise(F.concat(F.lit("USAAA"), F.lpad((F.col("track_id") % 100).cast("string"), 2, "0"), F.lit("12345")))
    return lib.tracks.select("track_id", scalars.isrc_year(code).alias("year"))



@query("er29_same_identity", "with m as (select distinct track_id, connector, connector_track_id from mappings where not is_retired) select distinct a_id, b_id from (select a.track_id as a_id, b.track_id as b_id from tracks a join tracks b on a.isrc = b.isrc and a.track_id < b.track_id union all select a.track_id, b.track_id from m a join m b on a.connector = b.connector and a.connector_track_id = b.connector_track_id and a.track_id < b.track_id) z")
def _(lib):
    ids = lib.mappings.where("not is_retired").select(F.col("track_id").alias("id"), "connector", F.col("connector_track_id").alias("identifier"))
    return matching.same_identity(lib.tracks.select(F.col("track_id").alias("id"), "isrc"), ids)


_D = f"case when coalesce(c.duration_ms, 0) = 0 or coalesce(k.duration_ms, 0) = 0 then {_ln(*scoring.DURATION['missing'])} when abs(c.duration_ms - k.duration_ms) <= {scoring.CLOSE_MS} then {_ln(*scoring.DURATION['close'])} when abs(c.duration_ms - k.duration_ms) <= {scoring.NEAR_MS} then {_ln(*scoring.DURATION['near'])} when abs(c.duration_ms - k.duration_ms) <= {scoring.FAR_MS} then {_ln(*scoring.DURATION['moderate'])} else {_ln(*scoring.DURATION['mismatch'])} end"
_W = f"{_ln(*scoring.TITLE['exact'])} + {_ln(*scoring.ARTIST['exact'])} + {_ln(*scoring.ISRC['absent'])} + {_D}"
INWARD = f"""with asked as (select distinct id from connector_tracks where connector <> 'musicbrainz'), mapped as (select connector_track_id as id, min(track_id) as track_id from track_mappings where superseded_at is null and mapping_id % 3 = 0 group by 1),
  reuse as (select c.id, k.track_id from connector_tracks c join canonicals k on k.track_id = c.id // 4 where c.id % 5 <> 1 and round_even(100 / (1 + exp(-({_W}))), 0) >= 85),
  held as (select distinct connector_track_id as id from negatives where kind = 'no_match' and check_again > {T}),
  done as (select a.id, coalesce(m.track_id, case when a.id % 17 <> 0 then r.track_id end, case when r.id is null and h.id is null and a.id % 11 <> 0 then a.id + 1000000000 end) as track_id,
    case when m.id is not null then 'existing' when r.id is not null then case when a.id % 17 = 0 then 'failed' else 'reused' end when h.id is not null then 'suppressed' when a.id % 11 = 0 then 'failed' else 'created' end as outcome from asked a left join mapped m on m.id = a.id left join reuse r on r.id = a.id left join held h on h.id = a.id)"""


def resolved_inward(lib):
    from tracklight.operators.library import pending_no_match
    from tracklight.queries import NOW

    said = lib.connector_tracks.where("connector <> 'musicbrainz'")
    mapped = lib.track_mappings.where("superseded_at is null and mapping_id % 3 = 0").select(F.col("connector_track_id").alias("id"), "track_id")
    own = matching.sided(matching.prepare(lib.canonicals.select("track_id", "title", "artist", "duration_ms")), "a")
    theirs = matching.sided(matching.prepare(said.select("id", F.when(F.col("id") % 5 == 1, "0000 1111").otherwise(F.col("title")).alias("title"), F.when(F.col("id") % 5 == 1, "2222").otherwise(F.col("artist")).alias("artist"), "duration_ms")), "b")
    pairs = own.join(theirs, F.col("a_track_id") == F.floor(F.col("b_id") / 4)).withColumns({"id": F.col("b_id"), "track_id": F.col("a_track_id"), "method": F.lit("artist_title")})
    held = lib.negatives.where(pending_no_match(NOW)).select(F.col("connector_track_id").alias("id"))
    create = lambda asked: asked.where("id % 11 <> 0").withColumn("track_id", F.col("id") + 1_000_000_000)
    return matching.resolve_inward(said.select("id"), mapped, pairs, said.where("id % 17 = 0").select("id"), held, create)


@query("er30_resolve_inward", f"{INWARD} select id, track_id, outcome from done")
def _(lib):
    return resolved_inward(lib)


@query("er30_outcomes", f"{INWARD} select {', '.join(f"count_if(outcome = '{o}') as {o}" for o in matching.OUTCOMES)}, count(*) as asked from done")
def _(lib):
    return matching.outcome_counts(resolved_inward(lib))



@query("er_ratios", "select track_id, 100.0 as s, round(100.0 * 2 * length(title) / (2 * length(title) + 2), 1) as o from tracks")
def _(lib):
    """Words in another order and one more, a letter long, that sorts last."""
    a, b = F.lower("title"), F.concat(F.array_join(F.reverse(F.split(F.lower("title"), " ")), " "), F.lit(" {"))
    return lib.tracks.select("track_id", F.round(text.token_set_ratio(a, b), 1).alias("s"), F.round(text.token_sort_ratio(a, b), 1).alias("o"))



# Scalar functions


@query("fn1_strings", "select p_partkey, lower(p_name) as l, length(trim('  ' || p_name || ' ')) as n, p_name like '%red%' as a, p_name ilike '%RED%' as b, regexp_matches(p_brand, '#1[0-9]$') as c, regexp_replace(p_brand, '[^0-9]', '', 'g') as d from part")
def _(lib):
    return lib.part.select("p_partkey", F.lower("p_name").alias("l"), F.length(F.trim(F.concat(F.lit("  "), "p_name", F.lit(" ")))).cast("long").alias("n"), F.col("p_name").like("%red%").alias("a"), F.ilike("p_name", F.lit("%RED%")).alias("b"), F.col("p_brand").rlike("#1[0-9]$").alias("c"), F.regexp_replace("p_brand", "[^0-9]", "").alias("d"))


@query("fn2_string_agg", "select p_brand, string_agg(p_partkey, '|' order by p_partkey) as ids from part group by 1")
def _(lib):
    return lib.part.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list("p_partkey")), "|").alias("ids"))


@query("fn3_dates", "select event_id, cast(date_trunc('hour', ts) as timestamp) as h, cast(ts as date) as d, cast(date_part('dow', ts) as int) as w, cast(floor(epoch(ts)) as bigint) as e, ts + interval 90 minute as later from events")
def _(lib):
    return lib.events.select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), F.to_date("ts").alias("d"), (F.dayofweek("ts") - 1).alias("w"), F.floor(scalars.micros(F.col("ts")) / 1_000_000).alias("e"), F.expr("ts + interval 90 minutes").alias("later"))


@query("fn4_numbers", "select p_partkey, greatest(p_size, 25) as g, least(p_size, 25) as l, nullif(p_size, 7) as z, round(p_retailprice / 7, 2) as r, floor(p_retailprice) as f, abs(p_size - 25) as a, p_size // 5 * 5 as i from part")
def _(lib):
    return lib.part.select("p_partkey", F.greatest("p_size", F.lit(25)).alias("g"), F.least("p_size", F.lit(25)).alias("l"), F.nullif("p_size", F.lit(7)).alias("z"), F.round(F.col("p_retailprice") / 7, 2).alias("r"), F.floor("p_retailprice").cast("double").alias("f"), F.abs(F.col("p_size") - 25).alias("a"), (F.floor(F.col("p_size") / 5) * 5).cast("int").alias("i"))


@query("fn5_aggregates", "select p_brand, quantile_cont(p_size, 0.9) as p90, count(distinct (p_type, p_size)) as kinds, bool_or(p_size = 50) as any50, count(*) filter (where p_size > 25) as big, round(avg(p_size), 4) as mean from part group by 1")
def _(lib):
    return lib.part.groupBy("p_brand").agg(F.expr("percentile(p_size, 0.9)").alias("p90"), F.count_distinct("p_type", "p_size").alias("kinds"), F.bool_or(F.col("p_size") == 50).alias("any50"), F.count_if(F.col("p_size") > 25).alias("big"), F.round(F.avg("p_size"), 4).alias("mean"))


@query("fn6_json", "select k, count(*) as n from (select unnest(json_keys(props)) as k from events) z group by 1")
def _(lib):
    return lib.events.select(F.explode(F.json_object_keys("props")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("fn7_arrays", "select track_id, list_contains(artists, 'ECONOMY') as has, a.x as first, a.y as second from (select track_id, artists, {'x': artists[1], 'y': artists[2]} as a from tracks) z")
def _(lib):
    return lib.tracks.select("track_id", F.array_contains("artists", "ECONOMY").alias("has"), F.get("artists", F.lit(0)).alias("first"), F.get("artists", F.lit(1)).alias("second"))


@query("fn8_null_safe", "select count(*) filter (where duration_ms is distinct from release_year) as differs, count(*) filter (where (coalesce(duration_ms, 0), track_id) < (100000, 50)) as below from tracks")
def _(lib):
    below = F.struct(F.coalesce("duration_ms", F.lit(0)).alias("a"), F.col("track_id").alias("b")) < F.struct(F.lit(100_000).cast("long").alias("a"), F.lit(50).cast("long").alias("b"))
    return lib.tracks.agg(F.count_if(~F.col("duration_ms").eqNullSafe(F.col("release_year"))).alias("differs"), F.count_if(below).alias("below"))


@query("fn10_digests", "select track_id, sha256(title) as h, base64(encode(title)) as b from tracks")
def _(lib):
    return lib.tracks.select("track_id", F.sha2(F.col("title").cast("binary"), 256).alias("h"), F.base64(F.col("title").cast("binary")).alias("b"))


@query("fn11_normalize_tag", "select track_id, tag as was, case (track_id + length(tag)) % 5 when 0 then regexp_replace(tag, ':', ': ') when 1 then tag || '_b-9' end as tag from tags")
def _(lib):
    """Tags with spaces and capitals, and tags that are none: a colon at an end, letters with marks, nothing."""
    kind = (F.col("track_id") + F.length("tag")) % 5
    raw = F.when(kind == 0, F.concat(F.lit("  "), F.initcap(F.replace("tag", F.lit(":"), F.lit(":   "))), F.lit(" "))).when(kind == 1, F.concat(F.upper("tag"), F.lit("_B-9"))).when(kind == 2, F.concat("tag", F.lit(":"))).when(kind == 3, F.concat(F.lit("é"), "tag")).otherwise("")
    return lib.tags.select("track_id", F.col("tag").alias("was"), scalars.normalize_tag(raw).alias("tag"))



@query("fn12_parse_tag", "select distinct tag, case when tag like '%:%' then split_part(tag, ':', 1) end as namespace, case when tag like '%:%' then substr(tag, strpos(tag, ':') + 1) else tag end as value from tags")
def _(lib):
    return lib.tags.select("tag").distinct().select("tag", scalars.tag_namespace(F.col("tag")).alias("namespace"), scalars.tag_value(F.col("tag")).alias("value"))


@query("fn13_release_date", "select o_orderkey, case o_orderkey % 4 when 0 then date_trunc('year', o_orderdate) when 1 then date_trunc('month', o_orderdate) when 2 then date_trunc('day', o_orderdate) end::timestamp as moment from orders")
def _(lib):
    kind = F.col("o_orderkey") % 4
    text_of = F.when(kind == 0, F.date_format("o_orderdate", "yyyy")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM")).when(kind == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("x")
    return lib.orders.select("o_orderkey", scalars.release_date(text_of).cast("timestamp_ntz").alias("moment"))



@query("fn14_track_id_from_uri", "select c_custkey, case when c_custkey % 3 = 0 then lpad(c_custkey::varchar, 22, 'a') end as id from customer")
def _(lib):
    """Of three URIs one is a track's; one is an album's, one too short."""
    kind, code = F.col("c_custkey") % 3, F.lpad(F.col("c_custkey").cast("string"), 22, "a")
    uri = F.when(kind == 0, F.concat(F.lit("spotify:track:"), code)).when(kind == 1, F.concat(F.lit("spotify:album:"), code)).otherwise(F.concat(F.lit("spotify:track:"), "c_custkey"))
    return lib.customer.select("c_custkey", scalars.track_id_from_uri(uri).alias("id"))


