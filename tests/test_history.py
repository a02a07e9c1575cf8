"""The projection's laws on random observations, its increments, streams, imports, list differences and matching."""

import datetime as dt
import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracklight.functions import text
from tracklight.operators import diff as D
from tracklight.operators import matching
from tracklight.operators import projection as P
from tracklight.sources import imports, scratch
from tracklight.streaming import polling
from tracklight.streaming import projection as S

NOW = dt.datetime(2024, 5, 6, 12)
SCHEMA = "id long, user_id long, service string, import_source string, track_identifier string, artist_name string, track_name string, played_at timestamp_ntz, ms_played long, metadata string, resolved_track_id long"
CHANNELS = (("spotify", "spotify_export", True), ("spotify", "spotify_api", True), ("lastfm", "lastfm_api", False))


def generated(seed: int):
    """Events 480 s apart, each seen by some channels with jitter, twins of equal time listened and interrupted listens."""
    r, out = random.Random(seed), []

    def add(user, channel, track, start, ms, reason="trackdone"):
        service, source, ends = channel
        at = start + dt.timedelta(milliseconds=ms) if ends else start
        known = ms if ends else None
        out.append((len(out) + 1, user, service, source, f"t{track}", "An Ärtist", f"Song {track}", at, known, json.dumps({"reason_end": reason}), track))

    events = 0
    for user in range(3):
        for k in range(r.randint(1, 6)):
            events += 1
            start, ms, track = NOW + dt.timedelta(seconds=480 * k), r.randint(30_000, 300_000), r.randrange(4)
            for c in r.sample(CHANNELS, r.randint(1, 3)):
                shifted = start + dt.timedelta(seconds=r.randint(-5, 5))
                if c[1] == "spotify_export" and r.random() < 0.3:
                    part = ms // 2
                    add(user, c, track, shifted, part, "endplay")
                    add(user, c, track, shifted + dt.timedelta(milliseconds=part), ms - part)
                    continue
                add(user, c, track, shifted, ms)
                if r.random() < 0.3 and c[2]:
                    add(user, c, track, shifted + dt.timedelta(seconds=r.randint(0, 3)), ms)
    return out, events


def test_projection_laws(spark):
    rows, expected = [], 0
    for seed in range(8):
        part, n = generated(seed)
        expected += n
        rows += [(len(rows) + 1 + k, x[1] + 10 * seed, *x[2:]) for k, x in enumerate(part)]
    df = spark.createDataFrame(rows, SCHEMA)
    grouped = P.group(df).collect()
    assert Counter(g.id for g in grouped) == Counter(r[0] for r in rows)  # every observation in exactly one group
    source = {r[0]: (r[2], r[3]) for r in rows}
    heads = [g for g in grouped if g.role == "unit"]
    assert max(Counter((g.play, source[g.id]) for g in heads).values()) == 1  # one observation of a channel in a play
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    again = P.group(spark.createDataFrame(shuffled, SCHEMA).repartition(7)).collect()
    assert {(g.id, g.play, g.role) for g in grouped} == {(g.id, g.play, g.role) for g in again}
    plays = P.project(df).collect()
    assert len(plays) == expected  # one play for each event
    for p in plays:
        assert p.track_id is not None and list(p.members) == sorted(g.id for g in grouped if g.play == p.play)


def plain_units(rows):
    """One user's, channel's and track's rows as listens: id -> (unit, role), and the listens (head, its members in order)."""
    rows = sorted(rows, key=lambda r: (r.at_us, r.id))
    group = {r.id: {r.id} for r in rows}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            delta = b.at_us - a.at_us
            if delta == 0 or a.ms_played and a.ms_played == b.ms_played and delta <= min(3_000_000, a.ms_played * 1000):
                both = group[a.id] | group[b.id]
                for k in both:
                    group[k] = both
    out, listens = {}, []
    best = {k: min((r for r in rows if r.id in g), key=lambda r: (-(r.ms_played or 0), r.at_us, r.id)).id for k, g in group.items()}
    for r in (r for r in rows if best[r.id] == r.id):
        last = listens[-1][-1] if listens else None
        if last and last.finished is False and last.ms_played is not None and r.ms_played is not None and abs(r.start_us - last.end_us) <= 30_000_000 and r.end_us - listens[-1][0].start_us <= 3_600_000_000:
            listens[-1].append(r)
        else:
            listens.append([r])
    for listen in listens:
        for r in listen:
            out[r.id] = (listen[0].id, "unit" if r is listen[0] else "segment")
    for k, b in best.items():
        if k != b:
            out[k] = (out[b][0], "duplicate")
    return out


def plain_plays(rows):
    """Of one user's with_start rows: id -> (unit, role, play), by a walk over all pairs, nearest first."""
    out = {}
    for key in {(r.channel, r.track_identifier) for r in rows}:
        out |= plain_units([r for r in rows if (r.channel, r.track_identifier) == key])
    heads = sorted((r for r in rows if out[r.id][1] == "unit"), key=lambda r: (r.priority, r.id))
    pairs = []
    for i, a in enumerate(heads):
        for b in heads[i + 1 :]:
            alike = a.resolved_track_id is not None and a.resolved_track_id == b.resolved_track_id or a.bridge == b.bridge
            delta = abs(a.start_us - b.start_us)
            if a.channel != b.channel and alike and delta <= (30 if a.normalizable and b.normalizable else 180) * 1_000_000:
                pairs.append((delta, a.priority, b.priority, a.id, b.id))
    group, channels = {r.id: {r.id} for r in heads}, {r.id: {r.channel} for r in heads}
    rank = {r.id: (r.priority, r.id) for r in heads}
    for *_, a, b in sorted(pairs):
        if not channels[a] & channels[b]:
            both, used = group[a] | group[b], channels[a] | channels[b]
            for k in both:
                group[k], channels[k] = both, used
    return {k: (u, role, min(group[u], key=rank.get)) for k, (u, role) in out.items()}


def crowded(seed: int, user: int, first: int):
    """A few minutes of a user whose observations crowd: any channels, equal and near stamps, known, zero and unknown times, broken listens, two names of a track."""
    r, out = random.Random(seed), []
    channels = (("spotify", "spotify_export"), ("spotify", "spotify_api"), ("own", "manual"), ("lastfm", "lastfm_api"))
    for k in range(r.randint(1, 14)):
        track, ms = r.randrange(2), r.choice([None, 0, 1000, 40_000, 40_000, 90_000, 1_500_000])
        at = NOW + dt.timedelta(seconds=r.choice([0, 1, 2, 3, 4, 20, 40, 60, 90, 120, 200, 1500, 3000]) + r.choice([0, 0, 0, 1, 30]))
        meta = r.choice([{}, {"reason_end": "trackdone"}, {"reason_end": "endplay"}, {"start_shift_ms": 30_000}])
        named = r.choice([track, track, 7])
        out.append((first + k, user, *r.choice(channels), f"t{track}", "An Artist", f"Song {named}", at, ms, json.dumps(meta), r.choice([track, track, None])))
    return out


def test_a_thousand_crowded_users_equal_a_plain_version(spark):
    rows = [x for u in range(1000) for x in crowded(u, u, 100 * u)]
    df = spark.createDataFrame(rows, SCHEMA)
    full = P.with_start(P.with_channel(df)).withColumn("bridge", P.bridge_key(F.col("artist_name"), F.col("track_name"))).collect()
    by_user = {}
    for r in full:
        by_user.setdefault(r.user_id, []).append(r)
    # pairing is by the unit's start, which is its head's
    want = {k: v for own in by_user.values() for k, v in plain_plays(own).items()}
    got = {r.id: (r.unit, r.role, r.play) for r in P.group(df).collect()}
    assert got == want
    assert len({p for _, _, p in got.values()}) < len({u for u, _, _ in got.values()}) < len(got)


def test_repeated_events_are_writes_of_one_play(spark):
    """Tables repeated with shifted keys: users of one number hear the same at the same time, besides what the queries' observations repeat."""
    from types import SimpleNamespace

    from tracklight.queries.history import observations

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    copies = events.crossJoin(spark.range(6).withColumnRenamed("id", "copy")).withColumns({"event_id": F.col("event_id") + F.col("copy") * 1000, "user_id": F.col("user_id") + F.col("copy") * 1500}).drop("copy")
    obs = observations(SimpleNamespace(events=copies))
    by_key = {}
    for r in P.with_start(P.with_channel(obs)).collect():
        by_key.setdefault((r.user_id, r.channel, r.track_identifier), []).append(r)
    want = {k: v for own in by_key.values() for k, v in plain_units(own).items()}
    got = {r.id: (r.unit, r.role) for r in P.islands(obs).collect()}
    assert got == want
    assert Counter(role for _, role in got.values())["duplicate"] > sum(k % 10 == 2 for k in got)


def test_twins_are_found_in_one_pass():
    """Each row is looked at a few times, however many are writes of one play."""
    looked = Counter()

    class Row:
        def __init__(self, id):
            self.id, self.ms = id, 60_000

        @property
        def at_us(self):
            looked["rows"] += 1
            return 0

    assert {kept for _, kept in P._twins([Row(k) for k in range(500)])} == {0}
    assert looked["rows"] < 500 * 20


def test_no_run_is_held_whole(spark):
    """A user without any gap: pairs and chains are the largest groups."""
    rows = [(2 * k + s, 1, *c, f"t{k % 50}", "A", f"S{k % 50}", NOW + dt.timedelta(seconds=20 * k + s), None if s else 20_000, "{}", k % 50) for k in range(3000) for s, c in enumerate((("own", "manual"), ("lastfm", "lastfm_api")))]
    df = spark.createDataFrame(rows, SCHEMA)
    held = []
    def spy(df, keys, *rest):
        held.extend(r["count"] for r in df.groupBy(*keys).count().collect())
        return own(df, keys, *rest)
    own, P.per_group = P.per_group, spy
    try:
        got = P.group(df).collect()
    finally:
        P.per_group = own
    assert max(held, default=0) <= 2 and Counter(Counter(r.play for r in got).values()) == {2: 3000}


def test_every_event_is_observed(spark):
    """In the queries' stand-in observations."""
    import json
    from types import SimpleNamespace

    from tracklight.queries.history import observations

    start = dt.datetime(2024, 1, 1)
    rows = [(k, k % 7, start + dt.timedelta(minutes=k), json.dumps({"k": k % 5})) for k in range(1, 31)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, props string")
    got = observations(SimpleNamespace(events=events)).select("id", "import_source").collect()
    assert {r.id // 10 for r in got} == set(range(1, 31))
    assert Counter(r.import_source for r in got if r.id % 10 == 0) == {"spotify_export": 7, "spotify_api": 8, "manual": 8, "lastfm_api": 7}


def test_edges_of_the_rules(spark):
    def obs(id, at, ms, reason=None, source="spotify_export", track=1):
        service = {"spotify_export": "spotify", "lastfm_api": "lastfm"}[source]
        return (id, 1, service, source, f"t{track}", "A", f"Song {track}", NOW + dt.timedelta(seconds=at), ms, json.dumps({"reason_end": reason} if reason else {}), track)

    rows = [
        obs(1, 0, 200_000, "endplay"), obs(2, 100, 70_000),  # ends 30 s before the next starts: one listen
        obs(11, 10_000, 100_000, "trackdone"), obs(12, 10_100, 100_000, "trackdone"),  # repeat-one: two plays
        obs(21, 20_000, 50_000), obs(22, 20_003, 50_000),  # 3 s apart and equal: one
        obs(31, 30_000, 50_000), obs(32, 30_004, 50_000),  # 4 s apart: two
        obs(41, 40_000, 0), obs(42, 40_000, 9),  # the same instant: one
        obs(51, 50_000, 100_000), obs(52, 49_930, None, source="lastfm_api"),  # starts 30 s apart: one play
        obs(61, 60_000, 100_000), obs(62, 59_931, None, source="lastfm_api"),  # 31 s: two
        obs(71, 70_000, None), obs(72, 70_180, None, source="lastfm_api"),  # an end that can't be normalised: 180 s
    ]
    g = {r.id: r for r in P.group(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert g[1].play == g[2].play and g[2].role == "segment" and g[1].unit_ms == 270_000
    assert g[11].play != g[12].play
    assert g[21].play == g[22].play and g[22].role == "duplicate" and g[31].play != g[32].play and g[41].play == g[42].play == 42
    assert g[51].play == g[52].play == 51 and g[61].play != g[62].play and g[71].play == g[72].play
    with pytest.raises(Exception, match="unknown channel"):
        P.group(spark.createDataFrame([(*rows[0][:3], "nowhere", *rows[0][4:])], SCHEMA)).collect()
    assert P.islands(spark.createDataFrame([(*rows[0][:3], "nowhere", *rows[0][4:])], SCHEMA)).count() == 1


def test_stream_equals_rebuild(spark, tmp_path):
    rows, _ = generated(5)
    rows += [(1000 + r[0], *r[1:7], r[7] - dt.timedelta(days=400), *r[8:]) for r in rows[:5]]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        df.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        S.start(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/ledger", f"{tmp_path}/plays", f"{tmp_path}/cp").awaitTermination(60)
    S.rebuild(df, f"{tmp_path}/whole")
    columns = ["play", "track_id", "played_at", "ms_played"]
    got, want = ({tuple(r) for r in S.read_plays(spark, f"{tmp_path}/{n}").select(*columns).collect()} for n in ("plays", "whole"))
    assert got == want


PLAN_NEW = "play long, user_id long, track_id long, service string, import_source string, played_at timestamp_ntz, ms_played long, source_services array<string>, context string, members array<long>, start_us long"
PLAN_STORED = "play_id long, user_id long, track_id long, service string, import_source string, played_at timestamp_ntz, ms_played long, source_services array<string>, context string"


def plain_plan(new, stored, edges):
    """A walk over the projected plays in order of their start."""
    identity = lambda p, at=None: (p["track_id"], p["service"], at or p["played_at"], p["ms_played"])
    held_by, by_id, moved = dict(edges), {p["play_id"]: p for p in stored}, {}
    used = {q for o, q in edges}
    loose = {}
    for p in sorted(stored, key=lambda p: -p["play_id"]):
        if p["play_id"] not in used:
            loose[identity(p)] = p["play_id"]
    taken, first, out, doubtful = set(), {}, {}, set()
    for g in sorted(new, key=lambda g: (g["start_us"], g["play"])):
        links = {held_by[m] for m in g["members"] if m in held_by} - taken
        same = lambda q: all(by_id[q][c] == g[c] for c in ("track_id", "service", "played_at", "ms_played", "source_services", "import_source")) and json.loads(by_id[q]["context"]) == json.loads(g["context"])
        if links:
            target = min(links)
            action = "merge" if len(links) > 1 else "keep" if same(target) else "update"
            doubtful |= links - {target}
        elif identity(g) in first:
            target, action = first[identity(g)], "claim"
        else:
            target = loose.pop(identity(g), None)
            if target is None and g["ms_played"]:
                target = loose.pop(identity(g, g["played_at"] + dt.timedelta(milliseconds=min(g["ms_played"], 21_600_000))), None)
            target, action = (g["play"] + 10_000, "insert") if target is None else (target, "adopt" if same(target) else "heal")
        taken.add(target)
        first.setdefault(identity(g), target)
        out[g["play"]] = (target, action)
        moved |= dict.fromkeys(g["members"], target)
    after = {o: moved.get(o, q) for o, q in edges} | moved
    return out, {q for q in doubtful if q not in after.values()}, after


def random_plan(seed):
    r, base = random.Random(seed), seed * 100_000
    at = lambda: NOW + dt.timedelta(minutes=r.randrange(4))
    fields = lambda: {"user_id": seed, "track_id": base + r.randrange(3), "service": "own", "import_source": r.choice(["manual", "manual", "m2"]), "played_at": at(), "ms_played": r.choice([None, 60_000, 60_000, 120_000]), "source_services": ["own"], "context": r.choice(['{"a": 1, "b": 2}', '{"b":2,"a":1}'])}
    n = r.randint(1, 9)
    observed = [base + 50 + k for k in range(2 * n)]
    r.shuffle(observed)
    new = []
    for k in range(n):
        own = fields()
        new.append({"play": base + k, **own, "members": [observed.pop() for _ in range(r.randint(1, 2))], "start_us": int(own["played_at"].timestamp()) * 1_000_000 + r.randrange(2)})
    stored = [{"play_id": base + 500 + k, **fields()} for k in range(r.randint(0, 8))]
    some = [p["play_id"] for p in stored if r.random() < 0.6]
    edges = [(o, r.choice(some)) for o in range(base + 50, base + 50 + 2 * n + 2) if some and r.random() < 0.6]
    return new, stored, edges


def test_plans_equal_a_walk(spark):
    from tracklight.operators import apply
    from tracklight.sources.scratch import Scope

    parts = [random_plan(k) for k in range(1, 250)]
    new, stored, edges = ([x for p in parts for x in p[i]] for i in range(3))
    frames = spark.createDataFrame([tuple(x.values()) for x in new], PLAN_NEW), spark.createDataFrame([tuple(x.values()) for x in stored], PLAN_STORED), spark.createDataFrame(edges, "observation_id long, play_id long")
    scope = scratch.Scope(spark)
    steps = apply.plan(*frames, scope, F.col("play") + 10_000)
    plays, moved = map(scope.written, apply.execute(steps, *frames))
    got = steps.collect()
    walks = [plain_plan(*p) for p in parts]
    assert {r.play: (r.play_id, r.action) for r in got if r.play is not None} == {k: v for w in walks for k, v in w[0].items()}
    assert {r.play_id for r in got if r.action == "delete"} == {q for w in walks for q in w[1]}
    assert {r.action for r in got} == set(apply.ACTIONS)
    assert {r.observation_id: r.play_id for r in moved.collect()} == {o: q for w in walks for o, q in w[2].items()}
    again = apply.plan(frames[0], plays, moved, scope, F.col("play") + 10_000)
    assert {r.action for r in again.collect()} <= {"keep", "claim"}
    counted = {r.track_id: r.play_count for r in apply.affected_aggregates(steps, frames[0], frames[1], plays).collect()}
    want = Counter(r.track_id for r in plays.collect())
    assert counted == {t: want.get(t, 0) for t in counted} and {x["track_id"] for x in new} <= set(counted)
    scope.drop()


def test_contexts_keep_types_and_unknown_keys(spark):
    from tracklight.operators.contexts import canonical, nested, with_context

    uri = "spotify:track:" + "a" * 22
    rows = [
        (1, "spotify", "spotify_export", uri, '{"shuffle": false, "skipped": null, "odd": {"x": [1, 2.5]}, "start_shift_ms": 3}'),
        (2, "spotify", "spotify_api", uri, '{"context_type": "album", "duration_ms": 7, "start_shift_ms": 3, "shuffle": true, "track_name": "own"}'),
        (3, "own", "manual", "t", "[1]"), (4, "lastfm", None, "t", '{"mbid": "m", "loved": true, "odd": "x"}'), (5, "elsewhere", None, "t", None), (6, "spotify", None, "t", "broken"),
    ]
    df = spark.createDataFrame([(*r, "Song", "Artist") for r in rows], "id long, service string, import_source string, track_identifier string, metadata string, track_name string, artist_name string")
    got = {r.id: json.loads(r.context) for r in with_context(df).collect()}
    common = {"track_name": "Song", "artist_name": "Artist", "album_name": None, "architecture_version": "connector_plays_deferred_resolution"}
    behaviour = dict.fromkeys(["platform", "country", "reason_start", "reason_end", "shuffle", "skipped", "offline", "spotify_track_uri"])
    export = common | behaviour | {"incognito_mode": False, "resolution_method": "spotify_connector_play_resolver"}
    assert got[1] == export | {"shuffle": False, "spotify_track_id": "a" * 22, "odd": {"x": [1, 2.5]}, "start_shift_ms": 3}
    assert got[2] == common | {"track_name": "own", "spotify_track_uri": None, "spotify_track_id": None, "context_type": "album", "context_uri": None, "duration_ms": 7, "resolution_method": "spotify_connector_play_resolver", "shuffle": True}
    assert got[3] == got[5] == common | {"resolution_method": "play_projection"}
    assert got[4]["mbid"] == "m" and got[4]["loved"] is True and got[4]["lastfm_track_url"] is None and got[4]["odd"] == "x"
    assert got[6] == export | {"spotify_track_id": None}
    one = spark.createDataFrame([('{"b": 1, "a": {"y": 1, "x": null}}', "m", '{"c": [2]}')], "own string, key string, value string")
    r = one.select(nested(F.col("own"), F.array(F.struct("key", "value"))).alias("n"), canonical(F.col("own")).alias("c"), canonical(F.lit('{"a":{"x":null,"y":1},"b":1}')).alias("d"), canonical(F.lit("{}")).alias("e")).first()
    assert json.loads(r.n) == {"b": 1, "a": {"y": 1, "x": None}, "m": {"c": [2]}} and r.c == r.d and r.e is None


def test_export_import(spark, tmp_path):
    good = {"ts": "2024-01-02T03:04:05Z", "spotify_track_uri": "spotify:track:" + "a" * 22, "master_metadata_track_name": "S", "master_metadata_album_artist_name": "A", "master_metadata_album_album_name": "B", "ms_played": 1000, "reason_end": "trackdone"}
    bad = [good | {"spotify_track_uri": None}, good | {"master_metadata_track_name": None}, good | {"ts": "x"}, good | {"ms_played": None}]
    (tmp_path / "a.json").write_text(json.dumps([good, *bad, good]))
    records = imports.export_records(spark, str(tmp_path / "a.json"))
    ledger = imports.export_observations(records, 1, "b1", NOW)
    assert ledger.count() == 2 and ledger.first().played_at == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert imports.new_rows(ledger.limit(0), ledger).count() == 1 and imports.new_rows(ledger, ledger).count() == 0
    seen = []
    n = imports.import_windows(lambda a, b: imports.export_observations(records, 1, str(a), NOW), f"{tmp_path}/ledger", spark, NOW - dt.timedelta(days=10), NOW, seen.append)
    assert n == 2 and seen[-1] == NOW and spark.read.parquet(f"{tmp_path}/ledger").count() == 1


def apply_operations(current: list, ops: list) -> list:
    out = list(current)
    for o in [o for o in ops if o.operation == "remove"]:
        out.pop(o.old_position)
    return out


def test_differences_rebuild_the_target(spark):
    r = random.Random(2)
    lists = {k: ([r.randrange(8) for _ in range(r.randint(0, 12))], [r.randrange(8) for _ in range(r.randint(0, 12))]) for k in range(25)}
    frame = lambda side: spark.createDataFrame([(k, p, t) for k, x in lists.items() for p, t in enumerate(x[side])], "playlist_id long, position long, track_id long")
    current, target = frame(0), frame(1)
    ops = D.operations(current, target).collect()
    plan = {p.playlist_id: p for p in D.sync_plan(current, target).collect()}
    for k, (a, b) in lists.items():
        own = [o for o in ops if o.playlist_id == k]
        added, removed = Counter(o.track_id for o in own if o.operation == "add"), Counter(o.track_id for o in own if o.operation == "remove")
        assert added == Counter(b) - Counter(a) and removed == Counter(a) - Counter(b)
        if k in plan:
            assert (plan[k].to_add, plan[k].to_remove, plan[k].is_noop) == (added.total(), removed.total(), a == b)
        for o in own:
            assert o.operation == "add" and b[o.position] == o.track_id or o.operation != "add" and a[o.old_position] == o.track_id
    abcd, bacd = ([(1, p, t) for p, t in enumerate(x)] for x in ([1, 2, 3, 4], [2, 1, 3, 4]))
    x, y = (spark.createDataFrame(v, "playlist_id long, position long, track_id long") for v in (abcd, bacd))
    assert D.moves(x, y).count() == 1 and D.moves(x, y, compat=True).count() == 2 and D.operations(x, x).count() == 0
    assert [(o.operation, o.position, o.old_position) for o in D.executable(D.operations(x, y)).collect()] in ([("move", 0, 1)], [("move", 1, 0)])


def test_every_list_is_compared(spark):
    from types import SimpleNamespace

    from tracklight.queries.history import pair_of_lists

    rows = [(p, k, 10 * p + k) for p in (1, 2, 3, 4) for k in range(9)]
    lib = SimpleNamespace(entries=spark.createDataFrame(rows, "playlist_id long, position long, track_id long"))
    for side in pair_of_lists(lib):
        assert {r.playlist_id for r in side.collect()} == {1, 2, 3, 4}


def test_longest_increasing():
    r = random.Random(4)
    for _ in range(100):
        v = [r.randrange(30) for _ in range(r.randint(0, 9))]
        got = [v[k] for k in D.longest_increasing(v)]
        best = max((sum(1 for _ in c) for c in ([v[k] for k in range(len(v)) if m >> k & 1] for m in range(1 << len(v))) if all(a < b for a, b in zip(c, c[1:]))), default=0)
        assert len(got) == best and all(a < b for a, b in zip(got, got[1:]))


def test_text_functions(spark):
    rows = spark.createDataFrame([("The Beatles",), ("AC/DC",), ("feat. Kanye West",), ("Motörhead",), ("A & B + C",), (None,)], "s string")
    assert [r.n for r in rows.select(text.normalize(F.col("s")).alias("n")).collect()] == ["beatles", "acdc", "featuring kanye west", "motorhead", "a and b and c", None]
    assert (text.metaphone("bjork"), text.metaphone("smith"), text.metaphone("smyth"), text.metaphone("")) == ("BJRK", "SM0", "SM0", "")
    assert text.set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100 and text.sort_ratio("b a", "a b") == 100 and text.indel("abcd", "abce") == 75


def test_matching_zones(spark):
    tracks = spark.createDataFrame([(1, "Paranoid Android", "Radiohead", 380_000), (2, "Song", "Singer", 200_000), (3, "Other", "Band", None), (4, "Alone", "X", 1)], "track_id long, title string, artist string, duration_ms long")
    raw = spark.createDataFrame([(1, 10, "Paranoid Android", "Radiohead", 380_500, "artist_title"), (2, 20, "Quite different", "Nobody", 500_000, "artist_title"), (3, 30, "Other", "Band", 100_000, "isrc")], "track_id long, connector_id long, title string, artist string, duration_ms long, method string")
    zones = {r.track_id: r.zone for r in matching.evaluate(tracks, raw).collect()}
    assert zones == {1: "accept", 2: "reject", 3: "review", 4: "none"}


def test_matching_queries_cover_every_track(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    tracks = {r.p_partkey for r in spark.read.parquet(f"{folder}/part.parquet").select("p_partkey").collect()}
    for name, column in (("er6_title_similarity", "a_track_id"), ("er7_best_by_title", "reference_id"), ("er18_evaluate", "track_id")):
        rows = entry.queries()[name](spark, folder).select(column).collect()
        assert {r[0] for r in rows} == tracks and len(rows) == len(tracks), name


def test_polling():
    s = polling.State()
    assert polling.backoff(3, key="u1") == polling.backoff(3, key="u1") != polling.backoff(3, key="u2")
    full = polling.after_poll(s, "schedule", True, 50, 50, 50, polling.SOLE_CAP)
    assert full.gap and full.interval == polling.LEAST and not polling.after_poll(s, "schedule", True, 50, 50, 50, polling.SOLE_CAP, resumed=False).gap
    assert polling.after_poll(full, "schedule", True, 3, 1, 50, polling.SOLE_CAP).gap is False
    spring = polling.next_run(dt.datetime(2024, 3, 9, 23, tzinfo=dt.UTC), 30, 7, timezone="America/New_York")
    assert spring == dt.datetime(2024, 3, 10, 11, 30, tzinfo=dt.UTC)


def stream(spark, tmp_path, batches):
    """The plays after these batches, and those of a projection of everything."""
    everything = []
    for k, rows in enumerate(batches):
        everything += rows
        S.apply_batch(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/ledger", f"{tmp_path}/plays", k)
    columns = ["play", "track_id", "played_at", "ms_played", "anchor_us"]
    got = S.read_plays(spark, f"{tmp_path}/plays").select(*columns, F.col("day").cast("string"))
    want = P.project(spark.createDataFrame(everything, SCHEMA)).select(*columns, F.to_date(F.timestamp_micros("anchor_us")).cast("string"))
    return sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))


def seen(id, day, clock, track, channel=("lastfm", "lastfm_api"), ms=None):
    return (id, 1, *channel, f"t{track}", "A", f"S{track}", dt.datetime.fromisoformat(f"2024-01-{day:02d}T{clock}"), ms, '{"reason_end": "trackdone"}', track)


EXPORT = ("spotify", "spotify_export")


def test_late_data_of_one_day_leave_the_next_alone(spark, tmp_path):
    first = [seen(1, 1, "23:50:00", 1), seen(2, 2, "00:02:00", 1, EXPORT, 700_000), seen(3, 2, "12:00:00", 2), seen(4, 2, "15:00:00", 3)]
    got, want = stream(spark, tmp_path, [first, [seen(5, 1, "10:00:00", 4)], [seen(6, 1, "23:59:50", 5)]])
    assert got == want and len(got) == 5


def test_a_day_whose_plays_move_away_is_emptied(spark, tmp_path):
    first = [seen(1, 3, "00:00:10", 7), seen(2, 2, "09:00:00", 8)]
    got, want = stream(spark, tmp_path, [first, [seen(3, 3, "00:03:00", 7, EXPORT, 190_000)]])
    assert got == want and len(got) == 2 and {r[-1] for r in got} == {"2024-01-02"}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = [seen(1, 1, "23:50:00", 1), seen(2, 2, "12:00:00", 2)]
    got, want = stream(spark, tmp_path, [rows, [seen(3, 2, "13:00:00", 3)]])
    S.apply_batch(spark.createDataFrame([seen(3, 2, "13:00:00", 3)], SCHEMA), f"{tmp_path}/ledger", f"{tmp_path}/plays", 1)
    assert got == want and S.read_plays(spark, f"{tmp_path}/plays").count() == 3 and spark.read.parquet(f"{tmp_path}/ledger").count() == 3


def test_unresolved_tracks_are_no_common_track(spark):
    rows = [seen(1, 1, "10:00:00", 1)[:-1] + (None,), seen(2, 1, "10:00:05", 2, EXPORT, 0)[:-1] + (None,)]
    assert P.project(spark.createDataFrame(rows, SCHEMA)).count() == 2


def test_readers_see_a_batch_whole_or_not(spark, tmp_path, monkeypatch):
    """A batch that breaks off before its commit changes nothing, and leaves no tables of its own; running it again does."""
    plays, ledger = f"{tmp_path}/plays", f"{tmp_path}/ledger"
    df = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    assert S.read_plays(spark, plays).count() == 0
    S.apply_batch(df(seen(1, 1, "10:00:00", 1), seen(2, 2, "10:00:00", 2)), ledger, plays, 0)
    before, second = S.read_plays(spark, plays).cache(), df(seen(3, 2, "11:00:00", 3))
    own, folders = S._commit, lambda: {p.name for p in Path(scratch.shared_folder(spark)).glob("tracklight-*")}
    there = folders()
    monkeypatch.setattr(S, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        S.apply_batch(second, ledger, plays, 1)
    assert S.read_plays(spark, plays).count() == before.count() == 2 and folders() == there
    monkeypatch.setattr(S, "_commit", own)
    S.apply_batch(second, ledger, plays, 1)
    assert {r.play for r in S.read_plays(spark, plays).collect()} == {1, 2, 3} and folders() == there
    S.apply_batch(df(seen(4, 1, "12:00:00", 4)), ledger, plays, 2)
    versions = {p.name for p in (tmp_path / "plays" / "data").glob("version=*/day=*")}
    assert S.read_plays(spark, plays).count() == 4 and versions == {"day=2024-01-01", "day=2024-01-02"}


def test_an_import_goes_on_where_it_broke_off(spark, tmp_path):
    rows = [seen(k, 1 + k % 3, f"{10 + k % 9}:00:00", k) for k in range(1, 25)]
    obs = spark.createDataFrame(rows, SCHEMA).withColumn("connector", F.col("service"))
    asked = []

    def resolver(most, known):
        def resolve(ids):
            if most is not None and len(asked) >= most:
                raise OSError("the service is gone")
            asked.append({r.track_identifier for r in ids.collect()})
            return ids.where(F.substring("track_identifier", 2, 9).cast("int") <= known).withColumn("resolved_track_id", F.substring("track_identifier", 2, 9).cast("long"))

        return resolve

    ledger, plays = f"{tmp_path}/ledger", f"{tmp_path}/plays"
    with pytest.raises(OSError):
        imports.two_phase(obs, resolver(2, 20), ledger, plays, 0, chunk=5)
    assert S.read_plays(spark, plays).count() == 0 and len(asked) == 2
    first = imports.two_phase(obs, resolver(None, 20), ledger, plays, 0, chunk=5)
    assert first == {"observations": 24, "resolved": 20, "unresolved": 4} and sum(map(len, asked)) == 24 == len(set().union(*asked))
    assert imports.two_phase(obs, resolver(None, 20), ledger, plays, 0, chunk=5) == first and S.read_plays(spark, plays).count() == 20
    asked.clear()
    more = spark.createDataFrame([seen(99, 2, "23:00:00", 99)], SCHEMA).withColumn("connector", F.col("service"))
    second = imports.two_phase(more, resolver(None, 23), ledger, plays, 1, chunk=5)
    assert second == {"observations": 1, "resolved": 3, "unresolved": 2} and set().union(*asked) == {"t21", "t22", "t23", "t24", "t99"}
    assert {r.track_id for r in S.read_plays(spark, plays).collect()} == set(range(1, 24))


def test_writes_of_one_stamp_are_joined_by_windows_alone(spark, monkeypatch):
    """Only stamps a moment apart go through Arrow, however often a play was written."""
    sent, per_group = [], P.per_group
    monkeypatch.setattr(P, "per_group", lambda df, *more: sent.append(df.count()) or per_group(df, *more))
    at = dt.datetime(2024, 1, 1, 12)
    rows = [(k, 1, "spotify", "spotify_api", "a", "A", "T", at, 1000 * (k % 3), "{}", 1) for k in range(20)]
    rows += [(100 + k, 1, "spotify", "spotify_api", "b", "A", "U", at + dt.timedelta(seconds=k), 90_000, "{}", 2) for k in range(2)]
    got = {r.id: (r.unit, r.role) for r in P.islands(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: (2, "unit" if k == 2 else "duplicate") for k in range(20)} | {100: (100, "unit"), 101: (100, "duplicate")}
    assert sent == [2, 0]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_resolve_inward_joins_little_by_id(spark):
    """What is known of an identifier comes by one aggregate, not by a join for each kind of it."""
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "id long")
    columns = ["track_id", "title", "artist", "duration_ms", "title_normalized", "title_key", "artist_normalized", "artist_key"]
    row = [9, "Song", "Artist", 200_000, "song", "SNK", "artist", "ARTST"]
    kinds = ["long", "string", "string", "long", *["string"] * 4]
    schema = ", ".join(f"{side}_{c} {k}" for side in "ab" for c, k in zip(columns, kinds, strict=True))
    candidates = spark.createDataFrame([(*row, *row, k, 9, "artist_title") for k in (2, 3)], f"{schema}, id long, track_id long, method string")
    mapped = spark.createDataFrame([(1, 7), (1, 5), (8, 1), (6, None)], "id long, track_id long")
    out = matching.resolve_inward(ids(1, 1, 2, 3, 4, 5, 6, None), mapped, candidates, ids(3, 3, 5), ids(4, 4, 2), lambda asked: asked.withColumn("track_id", asked.id + 100))
    want = [(1, 5, "existing"), (2, 9, "reused"), (3, None, "failed"), (4, None, "suppressed"), (5, 105, "created"), (6, None, "existing")]
    assert sorted(map(tuple, out.collect())) == want
    assert _plan(out).count("Join ") <= 1


def test_copies_of_a_write_are_kept_as_ids(spark):
    """Of five writes of one stamp four are written with nothing but whose copies they are."""
    rows = [(k, 1, "spotify", "spotify_export", "t", "a", "n", dt.datetime(2024, 1, 1), 60_000, "{}", 7) for k in range(5)]
    obs = spark.createDataFrame(rows, SCHEMA)
    scope = scratch.Scope(spark)
    units = P.same_channel(P.with_start(P.with_channel(obs)), scope).select("id", "unit", "role")
    assert sorted(map(tuple, units.collect())) == [(0, 0, "unit"), *[(k, 0, "duplicate") for k in range(1, 5)]]
    assert [r.id for r in spark.read.parquet(f"{scope.root}/1").where("of is not null").collect()] == [0]
    scope.drop()


def _dealt(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_counts_of_list_differences_deal_rows_once(spark):
    r = random.Random(5)
    rows = [[(p, k, r.choice([1, 2, 3, None, *range(4, 9)])) for p in range(40) for k in range(r.randrange(0, 14))] for _ in range(2)]
    current, target = (spark.createDataFrame(x, "playlist_id long, position long, track_id long") for x in rows)
    plan, sure = D.sync_plan(current, target), D.confidence(current, target)
    assert len(_dealt(plan)) == 1 and "REPARTITION_BY_NUM" in _dealt(plan)[0]
    assert sum("REPARTITION_BY_NUM" in x for x in _dealt(sure)) <= 2
    lists = [{p: [t for q, _, t in x if q == p] for p in range(40)} for x in rows]
    said = {x.playlist_id: x for x in plan.collect()}
    for p, x in said.items():
        a, b = Counter(lists[0][p]), Counter(lists[1][p])
        assert (x.to_add, x.to_remove, x.unchanged, x.is_noop) == ((b - a).total(), (a - b).total(), (a & b).total(), lists[0][p] == lists[1][p])
    assert set(said) == {p for x in lists for p, own in x.items() if own}
    for compat in (False, True):
        ops = Counter(x.playlist_id for x in D.operations(current, target, compat).collect())
        found = {x.playlist_id: (x.matched, x.operations) for x in D.confidence(current, target, compat).collect()}
        known = [{p: Counter(t for t in own if t is not None) for p, own in x.items()} for x in lists]
        assert found == {p: ((known[0][p] & known[1][p]).total(), ops[p]) for p in said}


def test_newest_metrics_are_dealt_before_they_are_sorted(spark):
    from tracklight.operators import mutations as M

    rows = [(k % 5, "c", "m", float(k % 7), dt.datetime(2024, 1, 1 + k % 3)) for k in range(60)]
    metrics = spark.createDataFrame(rows, "track_id long, connector string, metric_type string, value double, collected_at timestamp_ntz")
    out = M.merge_metrics(metrics, spark.createDataFrame([(0, 4)], "winner_id long, loser_id long"))
    below = out._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(track_id")[1]
    assert "REPARTITION_BY_NUM" in below and "WindowGroupLimit" not in below
    best: dict = {}
    for t, _, _, v, at in rows:
        best[t % 4] = max(best.get(t % 4, (at, v)), (at, v))
    assert {x.track_id: (x.collected_at, x.value) for x in out.collect()} == best


def test_only_kept_and_adopted_plays_are_compared(spark):
    """An identity is dealt as its fields, and turns and choices that a table holds aren't written again."""
    from tracklight.operators import apply as A
    from tracklight.queries.history import FAR, planned
    from tracklight.sources.standin import Library

    scope = scratch.Scope(spark)
    steps = A.plan(*planned(Library(spark, "/root/testdata/sf0.001")), scope, F.col("play") + 5 * FAR)
    written = [spark.read.parquet(f"{scope.root}/{k}").columns for k in range(1, scope.n + 1)]
    assert not any("_identity" in c for c in written) and written.count(["taker", "turn", "choice", "target"]) <= 4
    assert {r.action for r in steps.select("action").distinct().collect()} == set(A.ACTIONS)
    scope.drop()


def test_rows_of_one_stamp_come_together_before_they_are_dealt(spark):
    """Whatever their time listened, they are one row by channel and track; of rows a moment apart each is looked at."""
    at = dt.datetime(2024, 1, 1)
    rows = [(k, 1, "spotify", "spotify_api", "t", "a", "n", at, 60_000 + k % 2, "{}", 7) for k in range(6)]
    rows += [(10 + k, 1, "own", "manual", "t", "a", "n", at + dt.timedelta(seconds=k // 2), 60_000 + k % 2, "{}", 7) for k in range(4)]
    scope = scratch.Scope(spark)
    units = P.same_channel(P.with_start(P.with_channel(spark.createDataFrame(rows, SCHEMA))), scope).select("id", "unit", "role")
    assert {r.id: (r.unit, r.role) for r in units.collect()} == {k: (1, "unit" if k == 1 else "duplicate") for k in range(6)} | {10 + k: (11, "unit" if k == 1 else "duplicate") for k in range(4)}
    assert spark.read.parquet(f"{scope.root}/1").count() == 3
    scope.drop()


def test_contexts_are_built_only_if_asked_for(spark):
    rows, _ = generated(3)
    plays = P.project(spark.createDataFrame(rows, SCHEMA))
    assert "context" in _plan(plays) and "context" not in _plan(plays.select("play", "track_id", "played_at", "ms_played", "anchor_us", "source_services"))


def test_a_batch_brings_each_id_once_and_only_new_ones(spark, tmp_path):
    ledger, plays = f"{tmp_path}/ledger", f"{tmp_path}/plays"
    df = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    S.apply_batch(df(seen(1, 1, "10:00:00", 1), seen(2, 1, "11:00:00", 2)), ledger, plays, 0)
    S.apply_batch(df(seen(1, 1, "12:00:00", 3), seen(3, 1, "13:00:00", 5), seen(3, 1, "13:00:00", 4), seen(2, 9, "11:00:00", 2), seen(4, 1, "14:00:00", 6)), ledger, plays, 1)
    got = sorted((r.id, r.played_at.day, r.resolved_track_id) for r in spark.read.parquet(ledger).collect())
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 4), (4, 1, 6)]
