"""What a play keeps of an observation: a JSON object, built by the observation's channel.

A builder names the keys that its channel observes, in the form that plays have them; every other key of the metadata passes
through as it is, nested values and types included. Known keys that weren't observed are null, so that what a channel never
reports stays apart from what it reported as empty. Objects are maps of variants, so no value is taken for text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.functions.scalars import track_id_from_uri


@dataclass(frozen=True)
class Builder:
    """known: (key of the play, key of the metadata); consumed: further keys of the metadata that don't pass through; absent: values of keys that the metadata lacks."""

    method: str
    known: tuple[tuple[str, str], ...] = ()
    consumed: tuple[str, ...] = ()
    absent: tuple[tuple[str, str], ...] = ()
    track_id: str | None = None


# Names of keys, and what plays say of how they came to be.
ARCHITECTURE = "connector_plays_deferred_resolution"


def _same(*names: str) -> tuple[tuple[str, str], ...]:
    return tuple((n, n) for n in names)


EXPORT = Builder(
    "spotify_connector_play_resolver",
    (*_same("platform", "country", "reason_start", "reason_end", "shuffle", "skipped", "offline", "incognito_mode"), ("spotify_track_uri", "track_uri")),
    absent=(("incognito_mode", "false"),),
    track_id="uri or identifier",
)
RECENT = Builder("spotify_connector_play_resolver", (("spotify_track_uri", "track_uri"), *_same("context_type", "context_uri", "duration_ms")), ("start_shift_ms",), track_id="uri")
SCROBBLE = Builder("lastfm_connector_play_resolver", _same("lastfm_track_url", "lastfm_artist_url", "lastfm_album_url", "mbid", "artist_mbid", "album_mbid", "streamable", "loved"))
PLAIN = Builder("play_projection")
#: By service and import source; None stands for every other source of the service.
BUILDERS = {("spotify", "spotify_export"): EXPORT, ("spotify", "spotify_api"): RECENT, ("own", "manual"): PLAIN, ("lastfm", "lastfm_api"): SCROBBLE, ("spotify", None): EXPORT, ("lastfm", None): SCROBBLE}

OBJECT = "map<string,variant>"


def as_object(text: Column) -> Column:
    """JSON text as a map of variants; empty where it is null, broken or no object."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", OBJECT), F.create_map().cast(OBJECT))


def merged(under: Column, over: Column, keys: Column | None = None) -> Column:
    """Both maps; of equal keys the second's value counts. keys are the first's, where they are known."""
    # the second map is made again for each key of the first that is looked at, so none is where no key is in both
    apart = ~F.arrays_overlap(F.map_keys(over), F.map_keys(under) if keys is None else keys)
    return F.when(apart, F.map_concat(under, over)).otherwise(F.map_concat(F.map_filter(under, lambda k, _: ~F.map_contains_key(over, k)), over))


def _built(b: Builder, album: Column) -> Column:
    metadata = F.col("_metadata")
    text = lambda c: c.cast("variant")
    fields: dict[str, Column] = {"track_name": text(F.col("track_name")), "artist_name": text(F.col("artist_name")), "album_name": text(album)}
    absent = dict(b.absent)
    for key, source in b.known:
        value = F.try_element_at(metadata, F.lit(source))
        fields[key] = F.when(F.map_contains_key(metadata, F.lit(source)), value).otherwise(F.parse_json(F.lit(absent[source]))) if source in absent else value
    if b.track_id:
        uri = F.try_element_at(metadata, F.lit("track_uri"))
        found = track_id_from_uri(F.when(F.schema_of_variant(uri) == "STRING", F.try_variant_get(uri, "$", "string")))
        if b.track_id != "uri":
            found = F.coalesce(found, track_id_from_uri(F.col("track_identifier")))
        fields["spotify_track_id"] = text(found)
    fields |= {"resolution_method": text(F.lit(b.method)), "architecture_version": text(F.lit(ARCHITECTURE))}
    pairs = [x for k, v in fields.items() for x in (F.lit(k), v)]
    taken = [*dict.fromkeys([s for _, s in b.known] + list(b.consumed))]
    rest = F.map_filter(metadata, lambda k, _: ~k.isin(taken)) if taken else metadata
    return merged(F.create_map(*pairs), rest, F.array(*pairs[::2]))


def with_context(observations: DataFrame) -> DataFrame:
    """Adds context, the JSON object of the observation's channel; of a channel that nobody knows, of its service; else of none. An album_name is taken where there is such a column."""
    album = F.col("album_name") if "album_name" in observations.columns else F.lit(None).cast("string")
    own = observations.withColumn("_metadata", as_object(F.col("metadata")))
    # each builder once, as their code is long
    builders = list(dict.fromkeys((PLAIN, *BUILDERS.values())))
    kind = F.lit(builders.index(PLAIN))
    for (service, source), b in sorted(BUILDERS.items(), key=lambda x: x[0][1] is not None):
        here = F.col("service") == service
        kind = F.when(here if source is None else here & (F.col("import_source") == source), builders.index(b)).otherwise(kind)
    own, out = own.withColumn("_kind", kind), F.to_json(_built(PLAIN, album))
    for k, b in enumerate(builders):
        if b != PLAIN:
            out = F.when(F.col("_kind") == k, F.to_json(_built(b, album))).otherwise(out)
    return own.withColumn("context", out).drop("_metadata", "_kind")


def nested(own: Column, others: Column) -> Column:
    """A context with others, an array of (key, value) of JSON texts, under their keys."""
    entries = F.map_from_entries(F.transform(others, lambda x: F.struct(x.key.alias("key"), F.parse_json(x.value).alias("value"))))
    return F.when(F.size(others) == 0, own).otherwise(F.to_json(merged(as_object(own), entries)))


def canonical(context: Column) -> Column:
    """Equal for objects with equal keys and values in whatever order; null for empty ones."""
    text = F.to_json(F.parse_json(context))
    return F.when(text != "{}", text)
