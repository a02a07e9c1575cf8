"""Ordered lists against a plain Python model, pipelines, validation and sinks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tracklight.operators import combiners, filters, selectors, sorters
from tracklight.plans import workflow as W
from tracklight.plans.ordered import Key, TrackList
from tracklight.plans.templates import TEMPLATES, chain
from tracklight.sources import lists, sinks
from tracklight.sources.standin import Library

NOW = dt.datetime(2024, 1, 31)
SCHEMA = "track_id long, version int, title string, artist string, artists array<string>, album string, duration_ms long, release_date timestamp_ntz, m_total_plays long, at long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(r.randrange(40), 1, r.choice("abc"), r.choice("XY"), [r.choice("XYZ")], r.choice("pq"), r.choice([None, 1, 2, 3]), r.choice([None, NOW - dt.timedelta(days=r.randrange(900))]), r.choice([None, 0, 5, 9]), k) for k in range(60)]


@pytest.fixture
def tracks(spark, rows):
    return TrackList.source(spark.createDataFrame(rows, SCHEMA), Key("at"))


def at(t):
    return [r.at for r in t.result("at").orderBy("position").collect()]


def test_sorts_are_stable_and_flip(tracks, rows):
    want = sorted(sorted(rows, key=lambda r: r[2]), key=lambda r: r[5], reverse=True)
    got = sorters.by_metric(sorters.by_metric(tracks, "title", False), "album", True)
    assert at(got) == [r[9] for r in want]
    assert at(got.reverse()) == [r[9] for r in want[::-1]]
    missing_last = sorted(rows, key=lambda r: (r[8] is None, -(r[8] or 0)))
    assert at(sorters.by_metric(tracks, "total_plays")) == [r[9] for r in missing_last]


def test_selectors(tracks, rows):
    assert at(selectors.first(tracks, 7)) == list(range(7)) and at(selectors.first(tracks, -50)) == list(range(10))
    assert at(selectors.last(tracks, 3)) == [57, 58, 59] and at(selectors.last(tracks, 0)) == [] and len(at(selectors.last(tracks, 0, compat=True))) == 60
    assert sorted(at(selectors.sample(tracks, 60, 1))) == list(range(60)) and at(selectors.sample(tracks, 5, 1)) == at(selectors.sample(tracks, 5, 1))
    assert len(at(selectors.by_percentage(tracks, 12.5))) == 8 and len(at(selectors.by_percentage(tracks, 0))) == 1 and len(at(selectors.by_percentage(tracks, 7.5, "last"))) == 4
    assert len(at(selectors.by_percentage(tracks, 50, "random"))) == 30
    with pytest.raises(ValueError):
        selectors.by_method(tracks, 3, "middle")


def test_shuffle(tracks):
    assert at(sorters.weighted_shuffle(tracks, 0)) == list(range(60))
    full = at(sorters.weighted_shuffle(tracks, 1, 4))
    assert sorted(full) == list(range(60)) and full != list(range(60))
    with pytest.raises(ValueError):
        sorters.weighted_shuffle(tracks, 1.5)


def test_combiners(tracks):
    a, b = tracks.head(5), tracks.where(F.col("at") >= 50).head(3)
    assert at(combiners.concatenate([a, b])) == [0, 1, 2, 3, 4, 50, 51, 52]
    assert at(combiners.interleave([a, b])) == [0, 50, 1, 51, 2, 52, 3, 4]
    assert at(combiners.interleave([a, b], stop_on_empty=True)) == [0, 50, 1, 51, 2, 52]
    assert "m_total_plays" not in combiners.concatenate([a, b]).df.columns
    both = combiners.intersect([tracks, a])
    assert set(at(both)) >= set(range(5))


def test_deduplicate_keeps_first(tracks, rows):
    seen, want = set(), []
    for r in sorted(rows, key=lambda r: (r[2], r[9])):
        if r[0] not in seen:
            seen.add(r[0])
            want.append(r[9])
    assert at(filters.deduplicate(sorters.by_metric(tracks, "title", False))) == want


def test_sources_are_whole(spark, monkeypatch):
    from tracklight.plans import ordered

    monkeypatch.setattr(ordered, "MAX_LIST", 5)
    df = spark.range(9).withColumnRenamed("id", "track_id")
    own = ordered.TrackList.source(df, ordered.Key("track_id", True))
    assert [tuple(r) for r in own.result("track_id").orderBy("position").collect()] == [(k, 8 - k) for k in range(9)]
    assert ordered.TrackList.source(df, ordered.Key("track_id"), limit=3).df.count() == 3


def test_liked_tracks_without_a_limit_are_all(spark, monkeypatch):
    """The default limit once cut them, and what pipelines made of them."""
    monkeypatch.setattr(lists, "DEFAULT_LIMIT", 5)
    monkeypatch.setattr(lists, "MAX_LIST", 7)
    tracks = spark.range(9).withColumnRenamed("id", "track_id").withColumn("title", F.lit("t"))
    likes = tracks.select("track_id", F.lit("spotify").alias("service"), F.lit(True).alias("is_liked"), F.lit(NOW).cast("timestamp_ntz").alias("liked_at"))
    for limit, n in ((None, 9), (0, 9), (4, 4), (8, 7)):
        assert lists.liked_tracks(likes, tracks, "spotify", limit=limit).result("track_id").count() == n
        assert lists.liked_tracks(likes, tracks, "spotify", "random", limit=limit).df.count() == n
    assert lists.liked_tracks(likes, tracks, "spotify", compat=True).df.count() == 5


def test_only_columns_asked_for_are_sorted(spark):
    """A sort, and a window before it, carried every column of the list."""
    df = spark.createDataFrame([(k, k % 3) for k in range(9)], "at long, track_id long").withColumn("wide", F.raise_error(F.concat(F.lit("was carried, "), "at")).cast("string"))
    own = filters.deduplicate(TrackList.source(df, Key("at", True)))
    assert [tuple(r) for r in own.result("track_id").orderBy("position").collect()] == [(0, 2), (1, 1), (2, 0)]


def test_filters_refuse_what_they_cannot_do(tracks):
    for call in (lambda: filters.by_release_year(tracks), lambda: filters.by_play_history(tracks, NOW), lambda: filters.by_preference(tracks), lambda: filters.by_preference(tracks, ["nah"], ["yah"]), lambda: filters.by_tag(tracks, [":x"])):
        with pytest.raises(ValueError):
            call()


def test_all_templates_are_valid():
    for name, raw in TEMPLATES.items():
        w = W.parse(raw)
        assert W.problems(w) == [], name
        assert all("nothing upstream" not in x or name in ("sort_by_global_playcount",) for x in W.warnings(w)), (name, W.warnings(w))


def test_validation_finds_what_is_wrong():
    bad = {"id": "x", "name": "x", "tasks": [{"id": "a", "type": "source.playlist", "config": {}, "upstream": ["b"]}, {"id": "b", "type": "filter.by_tag", "config": {"tags": ["x"]}, "upstream": ["a", "zz"]}, {"id": "b", "type": "no.such", "config": {}, "upstream": []}]}
    found = " | ".join(W.problems(W.parse(bad)))
    for part in ("needs playlist_id", "a source has no upstream", "no upstream task zz", "id is taken", "no node type", "no destination"):
        assert part in found
    with pytest.raises(ValueError):
        W.levels(W.parse({"tasks": [{"id": "a", "type": "t", "upstream": ["b"]}, {"id": "b", "type": "t", "upstream": ["a"]}]}))
    lint = W.warnings(W.parse(chain("x", ("source.liked_tracks", {}), ("filter.by_play_history", {"min_plays": 1}), ("destination.create_playlist", {"name": "n"}))))
    assert lint == ["t1: nothing upstream adds play_history"]


def test_values_of_wrong_types_are_absent():
    c = {"i": True, "f": 2.5, "b": "yes", "s": "a, b,,", "l": ["x", 3]}
    assert (W.integer(c, "i", 7), W.integer(c, "f"), W.flag(c, "b", True), W.strings(c, "s"), W.strings(c, "l"), W.number(c, "i")) == (7, 2, True, ["a", "b"], ["x"], None)


def test_pipeline_writes_and_updates_a_playlist(spark, tmp_path):
    lib = Library(spark, "/root/testdata/sf0.001")
    store = sinks.PlaylistStore(spark, str(tmp_path))
    env = W.Env(lib, NOW, store=store)
    done = W.compile(W.parse(TEMPLATES["no_nah_mix"]), env)
    made = done.written["create"]
    assert made["track_count"] == done.final.df.count() and str(made["track_count"]) in made["name"]
    entries = store.entries(made["playlist_id"])
    assert [r.position for r in entries.orderBy("position").collect()] == list(range(made["track_count"]))
    half = done.final.head(3)
    assert store.update(made["playlist_id"], half, NOW, append=True)["track_count"] == made["track_count"]
    assert store.update(made["playlist_id"], half, NOW)["track_count"] == 3
    with pytest.raises(sinks.EmptyOverwriteError):
        store.update(made["playlist_id"], half.head(0), NOW)
    assert store.create(half, "x", NOW, dry_run=True)["dry_run"]


def test_long_lists_are_numbered_over_all_tasks(spark, tmp_path):
    """Nothing is cut, and no window holds the list."""
    n = 1_200_000
    df = spark.range(n).select(F.col("id").alias("track_id"), (F.col("id") * 7919 % n).alias("at"))
    out = TrackList.source(df, Key("at", True)).result("track_id", "at")
    assert "Window" not in out._jdf.queryExecution().toString()
    assert out.where(F.col("position") == n - 1 - F.col("at")).count() == n
    last = selectors.by_percentage(TrackList.source(df, Key("at")), 50, "last").result("at")
    assert last.agg(F.min("at"), F.max("at"), F.count(F.lit(1))).first() == (n // 2, n - 1, n // 2)


def test_combiners_keep_orders_of_any_keys(spark):
    of = lambda rows, key: TrackList.source(spark.createDataFrame(rows, "track_id long, x_added_at long, note string"), key)
    a = of([(1, 5, "p"), (2, None, "q"), (3, 9, "r")], Key("x_added_at", True))
    b = of([(4, 1, "s"), (1, 2, "t")], Key("track_id", True))
    both = combiners.concatenate([a, b])
    assert [r.track_id for r in both.result("track_id").orderBy("position").collect()] == [3, 1, 2, 4, 1] and "x_added_at" not in both.df.columns
    again = combiners.concatenate([both, a.reverse(), both], dedup=True)
    assert [r.track_id for r in again.result("track_id").orderBy("position").collect()] == [3, 1, 2, 4]
    assert [r.track_id for r in combiners.interleave([both, b]).result("track_id").orderBy("position").collect()] == [3, 4, 1, 1, 2, 4, 1]
    assert [r.track_id for r in combiners.intersect([a, b]).result("track_id").orderBy("position").collect()] == [1]


def test_playlist_versions(spark, tmp_path):
    """A write that breaks off leaves the version before it in force."""
    store = sinks.PlaylistStore(spark, str(tmp_path))
    of = lambda ids: TrackList.source(spark.createDataFrame([(k,) for k in ids], "track_id long"), Key("track_id"))
    made = store.create(of([1, 2]), "p", NOW)["playlist_id"]
    (tmp_path / f"playlist_id={made}" / "v2").mkdir()
    assert sorted(r.track_id for r in store.entries(made).collect()) == [1, 2]
    for k in range(3):
        store.update(made, of([5 + k]), NOW)
    assert [r.track_id for r in store.entries(made).collect()] == [7] and len(store._versions(made)) == 2


def test_insert_ignore_keeps_the_same_row_whatever_the_order(spark):
    rows = [(1, "b", 2), (1, "a", 9), (None, "x", 1), (None, None, 1), (2, "c", 3)]
    old = spark.createDataFrame([(2, "old", 0)], "k long, name string, v long")
    out = [sorted(sinks.insert_ignore(old, spark.createDataFrame(r, "k long, name string, v long").repartition(3), ["k"]).collect(), key=str) for r in (rows, rows[::-1])]
    assert out[0] == out[1] and len(out[0]) == 2


def test_first_of_key_deals_rows_without_their_text(spark):
    rows = [(k % 7, f"n{k % 3}", None if k % 5 else k) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, name string, v long")
    out = sinks.first_of_key(df, ["k"])
    below = out._jdf.queryExecution().executedPlan().toString().split("Exchange")[1:]
    assert len(below) == 1 and not any(x in below[0].lower() for x in ("json", "aggregate"))
    text = lambda r: json.dumps({"name": r[1], "v": r[2]}, separators=(",", ":"))
    assert sorted(map(tuple, out.collect())) == [min((r for r in rows if r[0] == k), key=text) for k in range(7)]
