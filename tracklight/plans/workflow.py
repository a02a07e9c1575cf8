"""Pipelines in JSON, compiled to one lazy plan.

A pipeline is a list of tasks, {id, type, config, upstream, result_key}. Compiling visits them in an order in which each
follows its upstream ones and gives each an ordered list; nothing runs before a destination writes. A task with two
consumers or more is built once, and Spark may be asked to keep it (`cache`).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.operators import combiners, enrichers, filters, selectors, sorters
from tracklight.plans.ordered import TrackList
from tracklight.sources import lists


@dataclass(frozen=True)
class Task:
    id: str
    type: str
    config: dict = field(default_factory=dict)
    upstream: tuple[str, ...] = ()
    result_key: str | None = None


@dataclass(frozen=True)
class Workflow:
    id: str
    name: str
    tasks: tuple[Task, ...]
    description: str = ""
    version: str = "1.0"


def parse(raw: dict | str) -> Workflow:
    raw = json.loads(raw) if isinstance(raw, str) else raw
    tasks = tuple(Task(t["id"], t["type"], t.get("config") or {}, tuple(t.get("upstream") or ()), t.get("result_key")) for t in raw.get("tasks", ()))
    return Workflow(raw.get("id", ""), raw.get("name", ""), tasks, raw.get("description", ""), str(raw.get("version", "1.0")))


def load(path: str | Path) -> Workflow:
    return parse(Path(path).read_text())


# Configuration. A value of a wrong type counts as absent.


def _as(kind: type, value):
    """The value as int, float, bool, str or list of str; None where it isn't one. Truth values are no numbers, empty texts are absent."""
    if kind is list:
        parts = value.split(",") if isinstance(value, str) else value if isinstance(value, list) else []
        return [p.strip() for p in parts if isinstance(p, str) and p.strip()]
    if kind in (int, float):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return kind(round(value) if kind is int else value) if number else None
    return value if isinstance(value, kind) and value != "" else None


def read(kind: type, config: dict, key: str, default=None):
    """One declared field of a node's configuration."""
    value = _as(kind, config.get(key))
    return default if value is None else value


def reader(kind: type, absent=None) -> Callable:
    return lambda config, key, default=absent: read(kind, config, key, default)


integer, number, flag, string, strings = reader(int), reader(float), reader(bool, False), reader(str), reader(list)


def dates(config: dict) -> dict:
    return {k: read(kind, config, k) for k, kind in (("start_date", str), ("end_date", str), ("not_played_in_days", int), ("played_within_days", int))}


# Nodes


@dataclass
class Env:
    """What nodes read: the library's tables, the clock, the seed, the playlists' store."""

    library: object
    as_of: dt.datetime
    seed: int = 0
    store: object = None
    dry_run: bool = False
    written: dict[str, dict] = field(default_factory=dict)


Node = Callable[[Env, dict, list[TrackList], dict[str, TrackList]], TrackList]
NODES: dict[str, Node] = {}
#: Configuration that a type can't do without, and keys of which it needs one.
REQUIRED: dict[str, tuple[str, ...]] = {}
ONE_OF: dict[str, tuple[str, ...]] = {}


def node(type: str, required: tuple[str, ...] = (), one_of: tuple[str, ...] = ()):
    """Registers a node type; a library's users can add their own."""

    def add(f: Node) -> Node:
        NODES[type], REQUIRED[type], ONE_OF[type] = f, required, one_of
        return f

    return add


def category(type: str) -> str:
    return type.split(".")[0]


def transform(type: str, required: tuple[str, ...] = (), one_of: tuple[str, ...] = ()):
    """Registers a node with one input, from a function of the list, the configuration and the environment."""

    def add(f):
        node(type, required, one_of)(lambda env, config, inputs, results: f(inputs[0], config, env))
        return f

    return add


PLAY_KEYS = ("min_plays", "max_plays", "start_date", "end_date", "not_played_in_days", "played_within_days")

node("source.playlist", ("playlist_id",))(lambda e, c, i, r: lists.playlist(e.library.entries, e.library.tracks, c["playlist_id"]))
node("source.liked_tracks")(lambda e, c, i, r: lists.liked_tracks(e.library.likes, e.library.tracks, string(c, "connector_filter"), string(c, "sort_by", "liked_at_desc"), integer(c, "limit"), e.seed))
node("source.played_tracks")(lambda e, c, i, r: lists.played_tracks(e.library.plays, e.library.tracks, e.as_of, integer(c, "limit"), integer(c, "days_back"), string(c, "connector_filter"), string(c, "sort_by", "played_at_desc")))
node("source.preferred_tracks", ("state",))(lambda e, c, i, r: lists.preferred_tracks(e.library.preferences, e.library.tracks, e.library.plays, c["state"], integer(c, "limit")))

transform("enricher.lastfm")(lambda t, c, e: enrichers.external_metrics(t, e.library.metrics, ["lastfm_user_playcount", "lastfm_global_playcount"], e.as_of, e.library))
transform("enricher.spotify")(lambda t, c, e: enrichers.external_metrics(t, e.library.metrics, ["explicit_flag"], e.as_of, e.library))
transform("enricher.play_history")(lambda t, c, e: enrichers.play_history(t, e.library.plays, e.as_of, tuple(strings(c, "metrics")) or ("total_plays", "last_played_dates"), integer(c, "period_days")))
transform("enricher.preferences")(lambda t, c, e: enrichers.preferences(t, e.library.preferences))
transform("enricher.tags")(lambda t, c, e: enrichers.tags(t, e.library.tags))
transform("enricher.spotify_liked_status")(lambda t, c, e: enrichers.liked_status(t, e.library.likes, ["spotify"]))

transform("filter.deduplicate")(lambda t, c, e: filters.deduplicate(t))
transform("filter.by_release_date")(lambda t, c, e: filters.by_release_date(t, e.as_of, integer(c, "min_age_days"), integer(c, "max_age_days")))
transform("filter.by_release_year", one_of=("min_year", "max_year"))(lambda t, c, e: filters.by_release_year(t, integer(c, "min_year"), integer(c, "max_year"), flag(c, "include_missing")))
node("filter.by_tracks", ("exclusion_source",))(lambda e, c, i, r: filters.by_tracks(i[0], r[c["exclusion_source"]].df))
node("filter.by_artists", ("exclusion_source",))(lambda e, c, i, r: filters.by_artists(i[0], r[c["exclusion_source"]].df, flag(c, "exclude_all_artists")))
transform("filter.by_metric", ("metric_name",))(lambda t, c, e: filters.by_metric(t, c["metric_name"], number(c, "min_value"), number(c, "max_value"), flag(c, "include_missing")))
transform("filter.by_duration")(lambda t, c, e: filters.by_duration(t, integer(c, "min_ms"), integer(c, "max_ms"), flag(c, "include_missing")))
transform("filter.by_liked_status", ("service",))(lambda t, c, e: filters.by_liked_status(t if "x_liked" in t.df.columns else enrichers.liked_status(t, e.library.likes), c["service"], flag(c, "is_liked", True)))
transform("filter.by_explicit")(lambda t, c, e: filters.by_explicit(t, string(c, "keep", "all")))
for _name, _source in (("by_play_history", "last_played"), ("by_first_played_date", "first_played")):
    transform(f"filter.{_name}", one_of=PLAY_KEYS)(lambda t, c, e, s=_source: filters.by_play_history(t, e.as_of, integer(c, "min_plays"), integer(c, "max_plays"), flag(c, "include_missing"), s, **dates(c)))
transform("filter.by_preference", one_of=("include", "exclude"))(lambda t, c, e: filters.by_preference(t, strings(c, "include"), strings(c, "exclude")))
transform("filter.by_tag", ("tags",))(lambda t, c, e: filters.by_tag(t, strings(c, "tags"), string(c, "match_mode", "any")))
transform("filter.by_tag_namespace", ("namespace",))(lambda t, c, e: filters.by_tag_namespace(t, c["namespace"], strings(c, "values")))

transform("sorter.by_metric", ("metric_name",))(lambda t, c, e: sorters.by_metric(t, c["metric_name"], flag(c, "reverse", True)))
transform("sorter.by_release_date")(lambda t, c, e: sorters.by_release_date(t, flag(c, "reverse")))
transform("sorter.by_play_history")(lambda t, c, e: sorters.by_play_history(t, e.as_of, flag(c, "reverse", True), **dates(c)))
transform("sorter.by_preference")(lambda t, c, e: sorters.by_preference(t, flag(c, "reverse", True)))
for _name in ("added_at", "first_played", "last_played"):
    transform(f"sorter.by_{_name}")(lambda t, c, e, s=_name: sorters.by_date(t, s, flag(c, "ascending", True)))
transform("sorter.reverse")(lambda t, c, e: sorters.reverse(t))
transform("sorter.weighted_shuffle")(lambda t, c, e: sorters.weighted_shuffle(t, number(c, "shuffle_strength", 0.5), e.seed))

transform("selector.limit_tracks")(lambda t, c, e: selectors.by_method(t, integer(c, "count", 10), string(c, "method", "first"), e.seed))
transform("selector.percentage")(lambda t, c, e: selectors.by_percentage(t, number(c, "percentage", 0.0), string(c, "method", "first"), e.seed))

for _name, _combine in (("merge_playlists", combiners.concatenate), ("concatenate_playlists", combiners.concatenate), ("interleave_playlists", combiners.interleave), ("intersect_playlists", combiners.intersect)):
    node(f"combiner.{_name}")(lambda e, c, i, r, f=_combine: f(i, flag(c, "deduplicate")))


@node("destination.create_playlist", ("name",))
def _create(env: Env, config: dict, inputs: list[TrackList], results: dict[str, TrackList]) -> TrackList:
    if env.store:
        env.written["create"] = env.store.create(inputs[0], config["name"], env.as_of, string(config, "description", ""), env.dry_run)
    return inputs[0]


@node("destination.update_playlist", ("playlist_id",))
def _update(env: Env, config: dict, inputs: list[TrackList], results: dict[str, TrackList]) -> TrackList:
    if env.store:
        env.written["update"] = env.store.update(config["playlist_id"], inputs[0], env.as_of, flag(config, "append"), env.dry_run)
    return inputs[0]


# Validation


def levels(w: Workflow) -> list[list[str]]:
    """Tasks by the length of the longest way to them; an error for a cycle."""
    left = {t.id: {u for u in t.upstream if any(u == x.id for x in w.tasks)} for t in w.tasks}
    out: list[list[str]] = []
    while left:
        ready = [k for k, up in left.items() if not up]
        if not ready:
            raise ValueError(f"cycle among {sorted(left)}")
        out.append(ready)
        for k in ready:
            del left[k]
        for up in left.values():
            up.difference_update(ready)
    return out


def problems(w: Workflow) -> list[str]:
    """What keeps a pipeline from being compiled."""
    out, ids = [], [t.id for t in w.tasks]
    if not w.tasks:
        out.append("no tasks")
    out += [f"{k}: id is taken" for k in sorted({k for k in ids if ids.count(k) > 1})]
    keys = [t.result_key for t in w.tasks if t.result_key]
    out += [f"{k}: result key is taken" for k in sorted({k for k in keys if keys.count(k) > 1 or k in ids})]
    for t in w.tasks:
        out += [f"{t.id}: no upstream task {u}" for u in t.upstream if u not in ids]
        if t.type not in NODES:
            out.append(f"{t.id}: no node type {t.type}")
            continue
        out += [f"{t.id}: needs {k}" for k in REQUIRED[t.type] if t.config.get(k) in (None, "", [])]
        if ONE_OF[t.type] and all(t.config.get(k) in (None, "", []) for k in ONE_OF[t.type]):
            out.append(f"{t.id}: needs one of {', '.join(ONE_OF[t.type])}")
        primary = t.config.get("primary_input")
        if primary and primary not in t.upstream:
            out.append(f"{t.id}: primary input {primary} is not upstream")
        is_source = category(t.type) == "source"
        if is_source and t.upstream:
            out.append(f"{t.id}: a source has no upstream")
        if not is_source and not t.upstream:
            out.append(f"{t.id}: needs an upstream task")
        if (x := t.config.get("exclusion_source")) and x not in ids and x not in keys:
            out.append(f"{t.id}: no task {x} to exclude")
    if not any(category(t.type) == "destination" for t in w.tasks):
        out.append("no destination")
    try:
        levels(w)
    except ValueError as e:
        out.append(str(e))
    return out


#: What a consumer needs from an enricher upstream; combiners drop it.
NEEDS = {"filter.by_play_history": "play_history", "filter.by_first_played_date": "play_history", "sorter.by_play_history": "play_history", "sorter.by_first_played": "play_history", "sorter.by_last_played": "play_history", "filter.by_preference": "preferences", "sorter.by_preference": "preferences", "filter.by_tag": "tags", "filter.by_tag_namespace": "tags", "sorter.by_added_at": "added_at"}
GIVES = {"enricher.play_history": {"play_history"}, "source.played_tracks": {"play_history"}, "enricher.preferences": {"preferences"}, "enricher.tags": {"tags"}, "source.liked_tracks": {"added_at"}, "source.playlist": {"added_at"}, "enricher.lastfm": {"lastfm_user_playcount", "lastfm_global_playcount"}, "enricher.spotify": {"explicit_flag"}}


def warnings(w: Workflow) -> list[str]:
    """Consumers of columns that no enricher upstream adds, or that a combiner between drops."""
    have: dict[str, set[str]] = {}
    tasks, out = {t.id: t for t in w.tasks}, []
    for k in (k for level in levels(w) for k in level):
        t = tasks[k]
        up = [have[u] for u in t.upstream if u in have]
        own = set() if category(t.type) == "combiner" else set(have.get(t.config.get("primary_input") or (t.upstream or ("",))[0], set()))
        need = NEEDS.get(t.type)
        if t.type in ("filter.by_metric", "sorter.by_metric") and sorters.metric_kind(t.config.get("metric_name", "")) == "external":
            need = t.config.get("metric_name")
        if need and need not in own:
            out.append(f"{k}: nothing upstream adds {need}" + (" that lasts" if any(need in u for u in up) else ""))
        have[k] = own | GIVES.get(t.type, set())
    return out


# Compilation


@dataclass
class Compiled:
    results: dict[str, TrackList]
    final: TrackList
    written: dict[str, dict]


def compile(w: Workflow, env: Env, cache: bool = False) -> Compiled:
    """The ordered list of each task; the last destination's is the result."""
    if found := problems(w):
        raise ValueError("; ".join(found))
    tasks, results, final = {t.id: t for t in w.tasks}, {}, None
    consumers = {k: sum(k in t.upstream for t in w.tasks) for k in tasks}
    waits = {t.id: t.config["exclusion_source"] for t in w.tasks if t.config.get("exclusion_source")}
    order = [k for level in levels(w) for k in level]
    order.sort(key=lambda k: category(tasks[k].type) == "destination")
    done: set[str] = set()
    names = {t.result_key: t.id for t in w.tasks if t.result_key}

    def build(k: str) -> None:
        if k in done:
            return
        t = tasks[k]
        for u in (*t.upstream, *([names.get(waits[k], waits[k])] if k in waits else [])):
            build(u)
        primary = t.config.get("primary_input")
        upstream = sorted(t.upstream, key=lambda u: u != primary)
        out = NODES[t.type](env, t.config, [results[u] for u in upstream], results)
        if cache and consumers[k] > 1:
            out = out.with_df(out.df.cache())
        results[k] = out
        if t.result_key:
            results[t.result_key] = out
        done.add(k)

    for k in order:
        build(k)
        if category(tasks[k].type) == "destination":
            final = results[k]
    return Compiled(results, final, env.written)


def metrics_of(compiled: Compiled) -> DataFrame:
    """metric, track_id and value (as text) of everything that nodes added, each metric of a track once: the value of the last node that has the track."""
    parts = []
    for k, t in enumerate(compiled.results.values()):
        names = [c for c in t.df.columns if c.startswith("m_")]
        if names:
            pairs = F.array(*[F.struct(F.lit(c[2:]).alias("metric"), F.col(c).cast("string").alias("value")) for c in names])
            parts.append(t.df.select("track_id", F.inline(pairs)).withColumn("at", F.lit(k)))
    if not parts:
        raise ValueError("no node added a metric")
    return reduce(DataFrame.unionByName, parts).groupBy("metric", "track_id").agg(F.max_by("value", F.struct("at", "value")).alias("value"))


def run_template(name: str, env: Env) -> TrackList:
    """The result list of a bundled pipeline."""
    from tracklight.plans.templates import TEMPLATES

    return compile(parse(TEMPLATES[name]), env).final


def lint(definition: Column | str) -> Column:
    """The warnings of definitions (JSON) in a column, an array each; what can't be parsed is one warning."""
    from pyspark.sql.functions import pandas_udf

    def each(texts):
        def one(text):
            if text is None:
                return []
            try:
                return warnings(parse(json.loads(text)))
            except ValueError as e:
                return [str(e)]

        return texts.map(one)

    return pandas_udf(each, "array<string>")(definition)
