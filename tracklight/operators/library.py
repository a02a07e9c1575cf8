"""Reads of the library: listing with keyset pages, facets, event lists, lookups, aggregates, histograms and integrity checks."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.functions.scalars import Cursor, decode_cursor, encode_cursor, micros, seconds_between, tag_namespace
from tracklight.sources.scratch import Scope

# Listing


@dataclass(frozen=True)
class Filters:
    """What a listing is narrowed to; None is no filter."""

    query: str | None = None
    liked: bool | None = None
    connector: str | None = None
    preference: str | None = None
    tags: tuple[str, ...] = ()
    tag_mode: str = "and"
    namespace: str | None = None
    min_plays: int | None = None
    never_played: bool = False
    played_within_days: int | None = None
    not_played_within_days: int | None = None


#: Sort names: column and direction. Nulls are last in either, ids break ties in the same direction.
SORTS = {f"{n}_{d}": (c, d == "desc") for n, c in {"title": "title", "artist": "artist", "added": "created_at", "duration": "duration_ms", "last_played": "last_played_at"}.items() for d in ("asc", "desc")}


def live(mappings: DataFrame) -> DataFrame:
    return mappings.where(~F.col("is_retired"))


def with_totals(tracks: DataFrame, plays: DataFrame) -> DataFrame:
    """Adds play_count, first_played_at and last_played_at."""
    totals = plays.groupBy("track_id").agg(F.count(F.lit(1)).alias("play_count"), F.min("played_at").alias("first_played_at"), F.max("played_at").alias("last_played_at"))
    return tracks.join(totals, "track_id", "left").withColumn("play_count", F.coalesce("play_count", F.lit(0)))


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def matching(tracks: DataFrame, f: Filters, library, as_of: dt.datetime, compat: bool = False) -> DataFrame:
    """Rows of tracks (with_totals) that pass all filters. compat: % and _ in the query match anything."""
    out = tracks
    if f.query:
        pattern = f"%{f.query if compat else escape_like(f.query)}%"
        out = out.where(F.ilike("title", F.lit(pattern)) | F.ilike("album", F.lit(pattern)) | F.ilike(F.array_join("artists", " "), F.lit(pattern)))
    if f.liked is not None:
        liked = library.likes.where("is_liked").select("track_id").distinct()
        out = out.join(liked, "track_id", "left_semi" if f.liked else "left_anti")
    if f.connector:
        out = out.join(live(library.mappings).where(F.col("connector") == f.connector).select("track_id").distinct(), "track_id", "left_semi")
    if f.preference == "unrated":
        out = out.join(library.preferences, "track_id", "left_anti")
    elif f.preference:
        out = out.join(library.preferences.where(F.col("state") == f.preference), "track_id", "left_semi")
    if f.tags:
        wanted = list(dict.fromkeys(f.tags))
        found = library.tags.where(F.col("tag").isin(wanted)).groupBy("track_id").agg(F.count_distinct("tag").alias("n"))
        out = out.join(found.where(F.col("n") >= (len(wanted) if f.tag_mode == "and" else 1)), "track_id", "left_semi")
    if f.namespace:
        out = out.join(library.tags.where(tag_namespace(F.col("tag")) == f.namespace), "track_id", "left_semi")
    if f.min_plays is not None:
        out = out.where(F.col("play_count") >= f.min_plays)
    if f.never_played:
        out = out.where("play_count = 0")
    days = lambda n: F.lit(as_of - dt.timedelta(days=n)).cast("timestamp_ntz")
    if f.played_within_days is not None:
        out = out.where(F.col("last_played_at") >= days(f.played_within_days))
    if f.not_played_within_days is not None:
        out = out.where(F.col("last_played_at") < days(f.not_played_within_days))
    return out


def page(rows: DataFrame, sort_by: str = "last_played_desc", limit: int = 50, offset: int = 0, after: Cursor | None = None, id_column: str = "track_id") -> DataFrame:
    """One page. With a cursor only rows after it in the order: a null value's page is in the tail of nulls."""
    column, down = SORTS.get(sort_by, SORTS["last_played_desc"])
    value, id = F.col(column), F.col(id_column)
    if after is not None:
        if after.value is None:
            rows = rows.where(value.isNull() & (id < after.id if down else id > after.id))
        else:
            at = F.lit(after.value).cast(rows.schema[column].dataType)
            beyond = (value < at) | (value == at) & (id < after.id) if down else (value > at) | (value == at) & (id > after.id)
            rows = rows.where(beyond | value.isNull())
    order = [value.desc_nulls_last(), id.desc()] if down else [value.asc_nulls_last(), id.asc()]
    out = rows.orderBy(*order)
    return (out.offset(offset) if offset and after is None else out).limit(limit)


@dataclass
class Listing:
    rows: DataFrame
    total: int | None
    next_cursor: str | None
    facets: DataFrame | None = None


def list_tracks(library, as_of: dt.datetime, f: Filters = Filters(), sort_by: str = "last_played_desc", limit: int = 50, offset: int = 0, cursor: str | None = None, with_facets: bool = False, with_total: bool = True) -> Listing:
    """A page with likes, preference and tags, the total (not counted on cursor pages, nor without with_total, as that reads the whole library) and the next cursor of a full page. A cursor that is malformed or of another order falls back to the offset.

    The page's rows are collected once, which its limit bounds; so are the facets' values.
    """
    column = SORTS.get(sort_by, SORTS["last_played_desc"])[0]
    after = None
    if cursor:
        try:
            after = decode_cursor(cursor)
        except ValueError:
            after = None
        after = after if after and after.column == column else None
    found, counted, scope = matching(with_totals(library.tracks, library.plays), f, library, as_of), with_total and not after, None
    if counted or with_facets:
        # what the total, the page and the facets are read from, so that plays are read once
        scope = Scope(library.spark)
        found = scope.written(found)
    total = found.count() if counted else None
    if total == 0:
        scope.drop()
        return Listing(library.spark.createDataFrame([], found.schema), 0, None)
    order = [F.col(column).desc_nulls_last(), F.col("track_id").desc()] if SORTS.get(sort_by, SORTS["last_played_desc"])[1] else [F.col(column).asc_nulls_last(), "track_id"]
    own = attach(page(found, sort_by, limit, offset, after), library).orderBy(*order)
    tail = own.collect()
    rows = own.sparkSession.createDataFrame(tail, own.schema)
    following = None
    if len(tail) == limit:
        value = tail[-1][column]
        following = encode_cursor(Cursor(column, value.isoformat(" ") if isinstance(value, dt.datetime) else value, tail[-1].track_id))
    shown = None
    if with_facets:
        shown = facets(found, library)
        shown = own.sparkSession.createDataFrame(shown.collect(), shown.schema)  # a row for each value
    if scope:
        scope.drop()
    return Listing(rows, total, following, shown)


def attach(rows: DataFrame, library) -> DataFrame:
    """Adds liked, preference and tags of a page's rows, whose number is bounded by the page."""
    ids = F.broadcast(rows.select("track_id"))
    liked = library.likes.where("is_liked").join(ids, "track_id", "left_semi").select("track_id").distinct().withColumn("liked", F.lit(True))
    states = library.preferences.join(ids, "track_id", "left_semi").select("track_id", F.col("state").alias("preference"))
    tags = library.tags.join(ids, "track_id", "left_semi").groupBy("track_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    out = rows.join(liked, "track_id", "left").join(states, "track_id", "left").join(tags, "track_id", "left")
    return out.withColumn("liked", F.coalesce("liked", F.lit(False)))


def facets(found: DataFrame, library) -> DataFrame:
    """facet, value and n over the tracks found: preference (unrated among them), liked by any service, and connectors. The tracks are read once: each gives a row for each of its values."""
    states = library.preferences.groupBy("track_id").agg(F.collect_list("state").alias("_states"))
    liked = library.likes.where("is_liked").select("track_id").distinct().withColumn("_liked", F.lit(True))
    mapped = live(library.mappings).groupBy("track_id").agg(F.collect_set("connector").alias("_connectors"))
    rows = found.select("track_id").join(states, "track_id", "left").join(liked, "track_id", "left").join(mapped, "track_id", "left")
    of = lambda facet, values: F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))
    none = F.array().cast("array<string>")
    said = F.concat(of("preference", F.coalesce("_states", F.array(F.lit("unrated")))), of("liked", F.array(F.when(F.col("_liked"), "true").otherwise("false"))), of("connector", F.coalesce("_connectors", none)))
    return rows.select(F.inline(said)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


# Event lists


def newest(rows: DataFrame, time: str, id: str, limit: int, before: tuple | None = None) -> DataFrame:
    """The newest limit + 1 rows, so that a caller sees whether there are more; before: the (time, id) of the last row seen."""
    if before is not None:
        rows = rows.where(F.struct(time, id) < F.struct(F.lit(before[0]).cast("timestamp_ntz").alias(time), F.lit(before[1]).cast(rows.schema[id].dataType).alias(id)))
    return rows.orderBy(F.col(time).desc(), F.col(id).desc()).limit(limit + 1)


def event_filter(plays: DataFrame, since=None, until=None, service: str | None = None, track_id=None) -> DataFrame:
    """since is included, until is not."""
    for value, test in ((since, lambda v: F.col("played_at") >= F.lit(v).cast("timestamp_ntz")), (until, lambda v: F.col("played_at") < F.lit(v).cast("timestamp_ntz")), (service, lambda v: F.col("service") == v), (track_id, lambda v: F.col("track_id") == v)):
        if value is not None:
            plays = plays.where(test(value))
    return plays


def play_events(plays: DataFrame, limit: int = 50, before: tuple | None = None, **narrow) -> DataFrame:
    return newest(event_filter(plays, **narrow), "played_at", "play_id", limit, before)


def tag_counts(tags: DataFrame, query: str | None = None, limit: int = 100) -> DataFrame:
    own = tags.where(F.ilike("tag", F.lit(f"%{escape_like(query)}%"))) if query else tags
    return own.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.max("tagged_at").alias("last_tagged_at")).orderBy(F.col("n").desc(), "tag").limit(limit)


REVIEW_SORTS = {"confidence_desc": ("confidence", True), "confidence_asc": ("confidence", False), "created_desc": ("created_at", True), "created_asc": ("created_at", False)}


def pending_reviews(reviews: DataFrame, sort_by: str = "confidence_desc", limit: int = 50, offset: int = 0) -> DataFrame:
    column, down = REVIEW_SORTS.get(sort_by, REVIEW_SORTS["confidence_desc"])
    order = [F.col(column).desc(), F.col("review_id").desc()] if down else [F.col(column), F.col("review_id")]
    return reviews.where("status = 'pending'").orderBy(*order).offset(offset).limit(limit)


def operation_runs(runs: DataFrame, limit: int = 20, before: tuple | None = None, types: list[str] | None = None, status: str | None = None) -> DataFrame:
    own = runs.where(F.col("operation_type").isin(types)) if types else runs
    return newest(own.where(F.col("status") == status) if status else own, "started_at", "run_id", limit, before)


def active_rejection() -> Column:
    return (F.col("kind") == "rejected_pair") & F.col("unrejected_at").isNull()


def pending_no_match(as_of: dt.datetime) -> Column:
    return (F.col("kind") == "no_match") & (F.col("check_again") > F.lit(as_of).cast("timestamp_ntz"))


def looks_dead(least: int = 3, days: int = 9) -> Column:
    """Enough misses over long enough."""
    return (F.col("kind") == "no_match") & (F.col("misses") >= least) & (seconds_between(F.col("last_checked_at"), F.col("created_at")) >= days * 86_400)


def suppressing(as_of: dt.datetime) -> Column:
    return active_rejection() | pending_no_match(as_of)


def list_negatives(negatives: DataFrame, mappings: DataFrame, tracks: DataFrame, kind: str) -> DataFrame:
    """Active rejections, or dead no-matches, with the track of the pair, or else the one that is mapped now."""
    own = negatives.where(active_rejection() if kind == "rejected" else looks_dead())
    mapped = live(mappings).groupBy("connector_track_id").agg(F.min("track_id").alias("mapped_track_id"))
    out = own.join(mapped, "connector_track_id", "left").withColumn("track_id", F.coalesce("candidate_track_id", "mapped_track_id"))
    return out.join(tracks.select("track_id", "title"), "track_id", "left").select("negative_id", "connector_track_id", "track_id", "title", "misses")


# Lookups


def probe_by_names(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tracks whose artist and title, or title without brackets, equal a wanted pair in normal form; each track once.

    wanted has title and artist in normal form, tracks title_normalized, artist_normalized and title_stripped. The two ways
    are two equi-joins, not one join with OR.
    """
    pairs = wanted.select("title", "artist").distinct()
    by = lambda c: tracks.join(pairs, (F.col("artist_normalized") == F.col("artist")) & (F.col(c) == F.col("title")), "left_semi")
    return by("title_normalized").unionByName(by("title_stripped")).dropDuplicates(["track_id"])


def first_by_names(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """title, artist and the oldest track id of each wanted pair that is there."""
    pairs = wanted.select("title", "artist").distinct()
    by = lambda c: pairs.join(tracks, (F.col("artist_normalized") == F.col("artist")) & (F.col(c) == F.col("title"))).select(pairs["title"], pairs["artist"], "track_id")
    named = tracks.select("track_id", "artist_normalized", "title_normalized", "title_stripped")
    tracks = named
    return by("title_normalized").unionByName(by("title_stripped")).groupBy("title", "artist").agg(F.min("track_id").alias("track_id"))


def by_unique_column(tracks: DataFrame, column: str, values: DataFrame) -> DataFrame:
    return tracks.join(values.select(column).distinct(), column, "left_semi")


def tracks_by_connector(mappings: DataFrame, tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(connector, connector_track_id) to the track that is mapped now."""
    own = live(mappings).join(wanted.select("connector", "connector_track_id").distinct(), ["connector", "connector_track_id"])
    return own.join(tracks.select("track_id", "title"), "track_id").select("connector", "connector_track_id", "track_id", "title")


def unsynced_likes(likes: DataFrame, source: str, target: str, is_liked: bool = True, since=None) -> DataFrame:
    """Likes of one service that the other doesn't have, or has otherwise."""
    own = likes.where((F.col("service") == source) & (F.col("is_liked") == is_liked))
    own = own.where(F.col("liked_at") >= F.lit(since).cast("timestamp_ntz")) if since is not None else own
    there = likes.where(F.col("service") == target).select("track_id", F.col("is_liked").alias("_there"))
    return own.join(there, "track_id", "left").where(F.col("_there").isNull() | (F.col("_there") != is_liked)).drop("_there")


def supersession_chains(edges: DataFrame, depth: int = 32, scope: Scope | None = None) -> DataFrame:
    """Each mapping's chain of successors: mapping_id, hop (from 1) and successor. A chain has depth mappings at most, its own included, and names each once: a cycle ends before its first repeat.

    Paths double: in each round every path goes on with that of its last mapping, so a chain takes as many rounds as its length has bits.
    """
    scope = scope or Scope(edges.sparkSession)
    step = edges.where("superseded_by is not null and superseded_by <> mapping_id").select("mapping_id", "superseded_by")
    paths, reach = scope.written(step.select("mapping_id", F.array("superseded_by").alias("path"))), 1
    while reach < depth - 1 and not paths.where(F.size("path") == reach).isEmpty():
        further = paths.select(F.col("mapping_id").alias("_last"), F.col("path").alias("_more"))
        both = paths.withColumn("_last", F.element_at("path", -1)).join(further, "_last", "left")
        whole = F.concat(F.array("mapping_id"), "path", F.coalesce("_more", F.array().cast(paths.schema["path"].dataType)))
        seen = both.withColumn("_whole", whole)
        again = F.filter(F.sequence(F.lit(1), F.size("_whole")), lambda i: F.array_position("_whole", F.element_at("_whole", i)) < i)
        end = F.least(F.coalesce(F.get(again, F.lit(0)) - 1, F.size("_whole")), F.lit(depth))
        paths, reach = scope.written(seen.select("mapping_id", F.slice("_whole", F.lit(2), (end - 1).cast("int")).alias("path"))), 2 * reach
    return paths.select("mapping_id", F.posexplode("path").alias("hop", "successor")).withColumn("hop", F.col("hop") + 1)


def desired_preferences(items: DataFrame, assignments: DataFrame) -> DataFrame:
    """The strongest state that a track's playlists assign: items (playlist_id, track_id), assignments (playlist_id, state)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ("nah", "hmm", "yah", "star")]), F.col("state"))
    return items.where("track_id is not null").join(assignments, "playlist_id").groupBy("track_id").agg(F.max_by("state", rank).alias("state"))


LIKE_STATES = {"spotify": "yah", "lastfm": "star"}


def preferences_from_likes(likes: DataFrame) -> DataFrame:
    """The strongest state that a track's likes stand for."""
    state = reduce(lambda c, x: F.when(F.col("service") == x[0], x[1]).otherwise(c), LIKE_STATES.items(), F.lit(None).cast("string"))
    return likes.where("is_liked").withColumn("state", state).where("state is not null").groupBy("track_id").agg(F.max_by("state", F.when(F.col("state") == "star", 3).otherwise(2)).alias("state"))


# Aggregates


def play_histogram(plays: DataFrame, bucket: str, tz: str = "UTC", **narrow) -> DataFrame:
    """Plays for each day, week or month of a time zone that has any."""
    local = F.from_utc_timestamp(F.col("played_at").cast("timestamp"), tz) if tz != "UTC" else F.col("played_at")
    return event_filter(plays, **narrow).groupBy(F.date_trunc(bucket, local).cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("plays"))


def histogram_bucket(since: dt.datetime | None, until: dt.datetime | None) -> str:
    """day up to 90 days, week up to 730, else month; month for an open range."""
    if since is None or until is None:
        return "month"
    days = (until - since).days
    return "day" if days <= 90 else "week" if days <= 730 else "month"


def histogram_buckets(since: Column, until: Column) -> Column:
    """histogram_bucket of ranges in columns."""
    days = F.floor((micros(until) - micros(since)) / (86_400 * 1_000_000))
    return F.when(days <= 90, "day").when(days <= 730, "week").otherwise("month")


def adaptive_histogram(plays: DataFrame, since=None, until=None, **narrow) -> DataFrame:
    """A histogram whose buckets suit its range; an open range takes the plays' own."""
    if since is None or until is None:
        ends = event_filter(plays, since, until, **narrow).agg(F.min("played_at").alias("a"), F.max("played_at").alias("b")).first()
        since, until = since or ends.a, until or ends.b
    return play_histogram(plays, histogram_bucket(since, until), since=since, until=until + dt.timedelta(microseconds=1) if until else None, **narrow)


def dashboard(library) -> DataFrame:
    """name and n of the library's totals and of its services, connectors and states."""
    one = lambda df, name, agg=F.count(F.lit(1)): df.agg(agg.alias("n")).select(F.lit(name).alias("name"), "n")
    each = lambda df, prefix, column, agg=F.count(F.lit(1)): df.groupBy(column).agg(agg.alias("n")).select(F.concat(F.lit(f"{prefix}:"), column).alias("name"), "n")
    parts = [
        one(library.tracks, "tracks"),
        one(library.plays, "plays"),
        one(library.entries, "playlists", F.count_distinct("playlist_id")),
        one(library.likes.where("is_liked"), "liked", F.count_distinct("track_id")),
        each(library.plays, "plays", "service"),
        each(live(library.mappings), "mapped", "connector", F.count_distinct("track_id")),
        each(library.likes.where("is_liked"), "liked", "service"),
        each(library.preferences, "preference", "state"),
    ]
    return reduce(DataFrame.unionByName, parts)


def match_methods(mappings: DataFrame, as_of: dt.datetime, recent_days: int = 30) -> DataFrame:
    since = F.lit(as_of - dt.timedelta(days=recent_days)).cast("timestamp_ntz")
    c = F.col("confidence")
    return live(mappings).groupBy("method", "connector").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("created_at") >= since).alias("recent"),
        F.round(F.avg(c), 1).alias("mean"),
        F.min(c).alias("least"),
        F.max(c).alias("most"),
        F.count_if(c < 50).alias("below_50"),
        F.count_if(c.between(50, 84)).alias("from_50"),
        F.count_if(c.between(85, 99)).alias("from_85"),
        F.count_if(c == 100).alias("full"),
    )


def duplicate_fingerprints(tracks: DataFrame) -> DataFrame:
    """Title, first artist and album that several tracks share, with their ids."""
    return tracks.groupBy("title", F.get("artists", F.lit(0)).alias("artist"), "album").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("track_id")).cast("array<string>"), ",").alias("ids")).where("n > 1")


def several_primaries(mappings: DataFrame) -> DataFrame:
    return live(mappings).groupBy("track_id", "connector").agg(F.sum(F.col("is_primary").cast("int")).alias("primaries")).where("primaries > 1")


def missing_primaries(mappings: DataFrame) -> DataFrame:
    own = live(mappings)
    return own.join(own.where("is_primary").select("track_id", "connector"), ["track_id", "connector"], "left_anti").groupBy("track_id", "connector").agg(F.count(F.lit(1)).alias("n"))


def orphaned_connector_tracks(connector_tracks: DataFrame, mappings: DataFrame, negatives: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Without a live mapping and without a negative that suppresses them."""
    own = connector_tracks.join(live(mappings), "connector_track_id", "left_anti")
    return own.join(negatives.where(suppressing(as_of)), "connector_track_id", "left_anti")


def stale_identifiers(tracks: DataFrame, mappings: DataFrame) -> DataFrame:
    """How many tracks' own identifier column differs from the live primary mapping, for two connectors. tracks has spotify_id and mbid."""
    primary = live(mappings).where("is_primary")
    by = lambda c, name: primary.where(F.col("connector") == c).groupBy("track_id").agg(F.min("connector_track_id").alias(name))
    both = tracks.join(by("spotify", "_spotify"), "track_id", "left").join(by("musicbrainz", "_mbid"), "track_id", "left")
    return both.agg(F.count_if(~F.col("spotify_id").eqNullSafe(F.col("_spotify"))).alias("stale_spotify"), F.count_if(~F.col("mbid").eqNullSafe(F.col("_mbid"))).alias("stale_mbid"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each workflow's newest run, and how many of its runs were completed."""
    w = Window.partitionBy("workflow_id")
    ranked = runs.withColumn("_n", F.row_number().over(w.orderBy(F.col("started_at").desc(), F.col("run_id").desc()))).withColumn("completed", F.count(F.when(F.col("status") == "completed", 1)).over(w)).withColumn("runs", F.count(F.lit(1)).over(w))
    return ranked.where("_n = 1").drop("_n")


@dataclass(frozen=True)
class Check:
    name: str
    rows: DataFrame
    warn_only: bool = False


def integrity(checks: list[Check]) -> DataFrame:
    """check, n and status of each: pass without rows, else warn or fail; and the worst as `overall`."""
    parts = [c.rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(c.name).alias("check"), "n", F.when(F.col("n") == 0, "pass").otherwise("warn" if c.warn_only else "fail").alias("status")) for c in checks]
    all_checks = reduce(DataFrame.unionByName, parts)
    worst = F.max(F.array_position(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.col("status")))
    overall = all_checks.agg(F.sum("n").alias("n"), F.get(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), worst.cast("int") - 1).alias("status"))
    return all_checks.unionByName(overall.select(F.lit("overall").alias("check"), "n", "status"))


def lags(rows: DataFrame, keys: list[str], time: str, id: str) -> DataFrame:
    """Adds gap, the seconds since the key's row before."""
    w = Window.partitionBy(*keys).orderBy(time, id)
    return rows.withColumn("gap", seconds_between(F.col(time), F.lag(time).over(w)))


@dataclass
class Stand:
    """Tables for a listing that isn't a whole library."""

    tables: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        return self.tables[name]
