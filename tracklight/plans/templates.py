"""Pipelines that come with the library, each a chain or small graph of (type, configuration).

Names, node types, the order of steps and settings are fixed values. For the small test data some are smaller than a user
would set them: days since a play (1 for 180 and more), numbers of plays, ids of playlists, ages of releases.
"""

from __future__ import annotations


def chain(name: str, *steps: tuple[str, dict]) -> dict:
    """A pipeline in which each task feeds the next."""
    tasks = [{"id": f"t{k}", "type": t, "config": c, "upstream": [f"t{k - 1}"] if k else []} for k, (t, c) in enumerate(steps)]
    return {"id": name, "name": name.replace("_", " ").title(), "version": "1.0", "tasks": tasks}


LIKED = ("source.liked_tracks", {"connector_filter": "spotify"})
HISTORY = ("enricher.play_history", {"metrics": ["total_plays", "last_played_dates"]})
FULL_HISTORY = ("enricher.play_history", {"metrics": ["total_plays", "last_played_dates", "first_played_dates"]})


def create(name: str) -> tuple[str, dict]:
    return ("destination.create_playlist", {"name": name + " ({track_count})"})


def first(n: int, method: str = "first") -> tuple[str, dict]:
    return ("selector.limit_tracks", {"count": n, "method": method})


def plays(**config) -> tuple[str, dict]:
    return ("filter.by_play_history", config)


def graph(name: str, **tasks) -> dict:
    return {"id": name, "name": name.replace("_", " ").title(), "version": "1.0", "tasks": [{"id": k, "type": t, "config": c, "upstream": u} for k, (t, c, u) in tasks.items()]}


def discovery(name: str, playlists: range, excluded: range, max_age_days: int, each: int) -> dict:
    """Recent tracks of several playlists, without the tracks of others and the artists of the last of them."""
    t: dict = {}
    for p in playlists:
        t[f"in{p}"] = ("source.playlist", {"playlist_id": p}, [])
        t[f"new{p}"] = ("filter.by_release_date", {"max_age_days": max_age_days}, [f"in{p}"])
        t[f"top{p}"] = ("selector.limit_tracks", {"count": each}, [f"new{p}"])
    t["merged"] = ("combiner.merge_playlists", {}, [f"top{p}" for p in playlists][: len(playlists) // 2])
    t["all"] = ("combiner.concatenate_playlists", {}, ["merged", *[f"top{p}" for p in playlists][len(playlists) // 2 :]])
    t["once"] = ("filter.deduplicate", {}, ["all"])
    last = "once"
    for p in excluded:
        t[f"known{p}"] = ("source.playlist", {"playlist_id": p}, [])
        t[f"without{p}"] = ("filter.by_tracks", {"exclusion_source": f"known{p}"}, [last])
        last = f"without{p}"
    t["strangers"] = ("filter.by_artists", {"exclusion_source": f"known{excluded[-1]}", "exclude_all_artists": True}, [last])
    t["counts"] = ("enricher.lastfm", {}, ["strangers"])
    t["sorted"] = ("sorter.by_metric", {"metric_name": "lastfm_global_playcount", "reverse": True}, ["counts"])
    t["out"] = ("destination.create_playlist", {"name": name}, ["sorted"])
    return graph(name, **t)


TEMPLATES: dict[str, dict] = {
    "common_ground": graph(
        "common_ground",
        a=("source.playlist", {"playlist_id": 1}, []),
        b=("source.playlist", {"playlist_id": 2}, []),
        both=("combiner.intersect_playlists", {}, ["a", "b"]),
        fits=("filter.by_duration", {"min_ms": 60_000, "max_ms": 600_000}, ["both"]),
        turned=("sorter.reverse", {}, ["fits"]),
        out=("destination.create_playlist", {"name": "Common Ground"}, ["turned"]),
    ),
    "current_obsessions": chain("current_obsessions", LIKED, HISTORY, plays(min_plays=8, played_within_days=30), ("sorter.by_play_history", {"played_within_days": 30}), first(20), create("Obsessions")),
    "decade_deep_cuts": chain("decade_deep_cuts", LIKED, ("enricher.play_history", {"metrics": ["total_plays"]}), ("filter.by_release_year", {"min_year": 2010, "max_year": 2019, "include_missing": False}), plays(max_plays=4, include_missing=True), ("sorter.by_play_history", {"reverse": False}), first(30), create("Deep Cuts")),
    "latest_discovery_mix": discovery("latest_discovery_mix", range(10, 19), range(20, 24), 600, 5),
    "recent_discovery_mix": discovery("recent_discovery_mix", range(30, 39), range(40, 44), 400, 4),
    "sort_by_release_date": chain("sort_by_release_date", ("source.playlist", {"playlist_id": 3}), ("sorter.by_release_date", {}), create("By Release")),
    "sort_lingering_by_playcount": chain("sort_lingering_by_playcount", ("source.playlist", {"playlist_id": 4}), ("enricher.lastfm", {}), ("filter.by_metric", {"metric_name": "lastfm_user_playcount", "min_value": 1}), ("sorter.by_metric", {"metric_name": "lastfm_user_playcount"}), create("Lingering")),
    "discovery_mix_composition": graph(
        "discovery_mix_composition",
        liked=("source.liked_tracks", {"limit": 2000, "connector_filter": "spotify"}, []),
        counted=("enricher.play_history", {"metrics": ["total_plays", "last_played_dates"]}, ["liked"]),
        played=("source.played_tracks", {"limit": 3000, "days_back": 90}, []),
        old=("filter.by_play_history", {"min_plays": 2, "max_plays": 110, "not_played_in_days": 1, "include_missing": True}, ["counted"]),
        new=("filter.by_play_history", {"min_plays": 1, "max_plays": 115, "played_within_days": 90}, ["played"]),
        mixed=("combiner.interleave_playlists", {}, ["old", "new"]),
        once=("filter.deduplicate", {}, ["mixed"]),
        again=("enricher.play_history", {"metrics": ["total_plays", "last_played_dates"]}, ["once"]),
        sorted=("sorter.by_play_history", {"played_within_days": 90, "reverse": False}, ["again"]),
        top=("selector.limit_tracks", {"count": 40}, ["sorted"]),
        out=("destination.create_playlist", {"name": "Discovery"}, ["top"]),
    ),
    "forgotten_favorites": chain("forgotten_favorites", LIKED, FULL_HISTORY, plays(min_plays=5), plays(not_played_in_days=1), ("sorter.by_first_played", {}), first(30), create("Forgotten")),
    "hidden_gems": chain("hidden_gems", LIKED, HISTORY, plays(min_plays=3, not_played_in_days=1), ("sorter.by_play_history", {}), first(25), create("Hidden Gems")),
    "hidden_gems_starred": chain("hidden_gems_starred", ("source.preferred_tracks", {"state": "star", "limit": 2000}), HISTORY, plays(min_plays=3, not_played_in_days=1), ("sorter.by_play_history", {}), first(25), create("Starred Gems")),
    "liked_tracks_hidden_gems": chain("liked_tracks_hidden_gems", LIKED, ("enricher.play_history", {}), plays(min_plays=3, not_played_in_days=1), ("sorter.by_play_history", {"reverse": False}), first(25), create("Liked Gems")),
    "mood_playlist": chain("mood_playlist", ("source.preferred_tracks", {"state": "yah", "limit": 1000}), ("enricher.tags", {}), ("filter.by_tag", {"tags": ["mood:chill"], "match_mode": "any"}), ("sorter.weighted_shuffle", {"shuffle_strength": 0.8}), first(60), create("Chill")),
    "no_nah_mix": chain("no_nah_mix", LIKED, ("enricher.preferences", {}), ("filter.by_preference", {"exclude": ["nah"]}), first(100), create("No Nah")),
    "likely_suspects": chain("likely_suspects", ("source.playlist", {"playlist_id": 5}), ("enricher.spotify_liked_status", {}), ("filter.by_liked_status", {"service": "spotify", "is_liked": False}), ("enricher.lastfm", {}), ("sorter.by_metric", {"metric_name": "lastfm_global_playcount"}), ("destination.update_playlist", {"playlist_id": "suspects"})),
    "sort_by_global_playcount": chain("sort_by_global_playcount", ("source.playlist", {"playlist_id": 6}), ("enricher.lastfm", {}), ("sorter.by_metric", {"metric_name": "lastfm_global_playcount"}), create("Glowy")),
    "sort_by_user_playcount": chain("sort_by_user_playcount", ("source.playlist", {"playlist_id": 7}), ("enricher.lastfm", {}), ("filter.by_metric", {"metric_name": "lastfm_user_playcount", "min_value": 1}), ("sorter.by_metric", {"metric_name": "lastfm_user_playcount"}), create("Suspects")),
    "play_history_obsessions": chain("play_history_obsessions", ("source.played_tracks", {"limit": 10_000, "days_back": 60}), plays(min_plays=8, played_within_days=30), ("sorter.by_play_history", {"played_within_days": 30}), ("filter.deduplicate", {}), first(30), create("Obsessions")),
    "recent_additions_unplayed": chain("recent_additions_unplayed", LIKED, ("enricher.play_history", {"metrics": ["total_plays"]}), ("filter.by_liked_status", {"service": "spotify", "is_liked": True}), plays(max_plays=2, include_missing=True), ("sorter.by_added_at", {"ascending": False}), ("selector.percentage", {"percentage": 20}), create("Fresh Likes")),
    "rediscovery_candidates": chain("rediscovery_candidates", LIKED, HISTORY, plays(min_plays=1, max_plays=102), ("sorter.by_metric", {"metric_name": "release_date", "reverse": False}), first(50, "random"), create("Rediscovery")),
    "starred_forgotten": chain("starred_forgotten", ("source.preferred_tracks", {"state": "star", "limit": 2000}), HISTORY, plays(not_played_in_days=1, include_missing=True), ("sorter.by_play_history", {"reverse": False}), first(40), create("Starred")),
}
