"""When to poll a source of recent plays: an adaptive interval for each user, for one user's state and for tables of states."""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import dataclass, replace
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.functions.scalars import seconds_between

#: Fixed values in seconds, but for the share and the factor.
BASE, LEAST, SOLE_CAP, REDUNDANT_CAP, DEMAND_AGE = 1800, 900, 7200, 86_400, 600
REDUNDANCY = dt.timedelta(days=7)
NEAR_FULL, SLACK = 0.6, 2


@dataclass(frozen=True)
class State:
    empty: int = 0
    interval: int = 0
    trigger: str | None = None
    gap: bool = False

    def live(self, cap: int) -> int:
        """The interval in force."""
        return max(LEAST, min(self.interval or BASE, cap))


def jitter(key: str) -> float:
    """From -1 to 1, the same for a key at all times."""
    if not key:
        return 0.0
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=4).digest(), "big") / (1 << 32) * 2 - 1


def backoff(misses: int, base: int = BASE, cap: int = REDUNDANT_CAP, ratio: float = 0.1, key: str = "") -> int:
    """base doubled for each miss up to the cap, and moved by up to `ratio` of it."""
    if misses < 0 or base <= 0 or cap < base or not 0 <= ratio < 1:
        raise ValueError("backoff needs misses >= 0, 0 < base <= cap and a ratio from 0 to 1")
    grown = base
    for _ in range(misses):
        if grown >= cap:
            break
        grown *= 2
    return max(1, round(min(grown, cap) * (1 + ratio * jitter(key))))


def redundant(other_seen: dt.datetime | None, now: dt.datetime) -> bool:
    """Another source has seen plays lately."""
    return other_seen is not None and now - other_seen <= REDUNDANCY


def cap_of(other_seen: dt.datetime | None, now: dt.datetime) -> int:
    return REDUNDANT_CAP if redundant(other_seen, now) else SOLE_CAP


def decide(state: State, trigger: str, now: dt.datetime, last_polled: dt.datetime | None, has_scope: bool = True, other_seen: dt.datetime | None = None) -> tuple[bool, str | None]:
    """(poll now, reason against it). Demand looks only at whether a poll has just been."""
    if not has_scope:
        return False, "scope_missing"
    age = None if last_polled is None else (now - last_polled).total_seconds()
    least, reason = (DEMAND_AGE, "recently_polled") if trigger == "demand" else (state.live(cap_of(other_seen, now)), "not_due")
    return (False, reason) if age is not None and age < least else (True, None)


def after_poll(state: State, trigger: str, ok: bool, seen: int, new: int, window: int, cap: int, resumed: bool = True, key: str = "") -> State:
    """The state after a poll that saw `seen` plays, `new` of them new, of a window that holds `window`."""
    live = state.live(cap)
    clamp = lambda s: max(LEAST, min(s, cap))
    state = replace(state, trigger=trigger)
    if not ok:
        return replace(state, interval=clamp(live))
    if seen >= window:
        return replace(state, empty=0, interval=clamp(LEAST), gap=state.gap or resumed)
    if seen >= max(1, round(window * NEAR_FULL)):
        return replace(state, empty=0, interval=clamp(live // 2))
    if new:
        return replace(state, empty=0, interval=clamp(BASE), gap=False)
    return replace(state, empty=state.empty + 1, interval=clamp(min(backoff(state.empty + 1, key=key), cap)), gap=False)


def health(now: dt.datetime, last_polled: dt.datetime | None, interval: int) -> str | None:
    if last_polled is None:
        return None
    return "healthy" if (now - last_polled).total_seconds() <= interval * SLACK else "overdue"


def next_run(now: dt.datetime, minute: int = 0, hour: int = 0, day_of_week: int | None = None, interval_minutes: int | None = None, timezone: str = "UTC") -> dt.datetime:
    """The next time after now (with a zone), in UTC and whole minutes: every so many minutes, daily, or on a weekday (0 is Sunday). A local time that a clock change skips moves to the first one after it."""
    if now.tzinfo is None:
        raise ValueError("now needs a time zone")
    whole = lambda t: t.astimezone(dt.UTC).replace(second=0, microsecond=0)
    if interval_minutes is not None:
        return whole(now.astimezone(dt.UTC) + dt.timedelta(minutes=interval_minutes))
    zone = ZoneInfo(timezone)
    day = now.astimezone(zone).date()
    for k in range(9):
        date = day + dt.timedelta(days=k)
        if day_of_week is not None and date.isoweekday() % 7 != day_of_week % 7:
            continue
        local = dt.datetime.combine(date, dt.time(hour, minute), zone)
        at = whole(local)
        if at.astimezone(zone).replace(tzinfo=None) != local.replace(tzinfo=None):
            at = whole(dt.datetime.combine(date, dt.time(hour, minute), dt.UTC) - zone.utcoffset(dt.datetime.combine(date, dt.time(0))))
        if at > now:
            return at
    raise AssertionError("a week has every day")


# Tables of states: user_id, empty, interval_s, gap, trigger, last_polled, other_seen and has_scope, a row for each user.


def backoffs(misses: Column, base: int = BASE, cap: int = REDUNDANT_CAP) -> Column:
    """backoff of numbers of misses, without jitter."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), F.least(misses, F.lit(40)))).cast("long")


def _age(at: str, now: dt.datetime) -> Column:
    return seconds_between(F.lit(now).cast("timestamp_ntz"), F.col(at))


def with_caps(states: DataFrame, now: dt.datetime) -> DataFrame:
    """Adds redundant, cap_s and live_s, the interval in force."""
    seen = F.coalesce(_age("other_seen", now) <= REDUNDANCY.total_seconds(), F.lit(False))
    capped = states.withColumn("redundant", seen).withColumn("cap_s", F.when(F.col("redundant"), REDUNDANT_CAP).otherwise(SOLE_CAP))
    return capped.withColumn("live_s", F.greatest(F.lit(LEAST), F.least(F.when(F.col("interval_s") == 0, BASE).otherwise(F.col("interval_s")), F.col("cap_s"))))


def decisions(states: DataFrame, now: dt.datetime) -> DataFrame:
    """Adds polls and reason: who is polled now, and why not."""
    age, demand = _age("last_polled", now), F.col("trigger") == "demand"
    reason = F.when(~F.col("has_scope"), "scope_missing").when(demand & (age < DEMAND_AGE), "recently_polled").when(~demand & (age < F.col("live_s")), "not_due")
    return with_caps(states, now).withColumn("reason", reason).withColumn("polls", F.col("reason").isNull())


def after_polls(polls: DataFrame, window: int, now: dt.datetime) -> DataFrame:
    """The states after a poll each (ok, seen, new and resumed beside the state)."""
    full, near = F.col("seen") >= window, F.col("seen") >= max(1, round(window * NEAR_FULL))
    nothing = F.col("ok") & ~near & (F.col("new") == 0)
    next_s = F.when(~F.col("ok"), F.col("live_s")).when(full, LEAST).when(near, F.floor(F.col("live_s") / 2)).when(F.col("new") > 0, BASE).otherwise(backoffs(F.col("empty") + 1))
    gap = F.when(~F.col("ok") | near & ~full, F.col("gap")).when(full, F.col("gap") | F.col("resumed")).otherwise(False)
    empty = F.when(nothing, F.col("empty") + 1).when(F.col("ok"), 0).otherwise(F.col("empty"))
    return with_caps(polls, now).withColumns({"interval_s": F.greatest(F.lit(LEAST), F.least(next_s, F.col("cap_s"))).cast("long"), "gap": gap, "empty": empty.cast("long")})


def healths(states: DataFrame, now: dt.datetime) -> DataFrame:
    """Adds health: healthy, overdue, or null for who was never polled."""
    age = _age("last_polled", now)
    return with_caps(states, now).withColumn("health", F.when(age <= F.col("live_s") * SLACK, "healthy").when(age.isNotNull(), "overdue"))


def next_runs(plans: DataFrame) -> DataFrame:
    """Adds next_run, in UTC, to schedules: since (UTC), minute, hour, day_of_week (0 is Sunday, or null), interval_minutes (or null) and timezone."""
    minute = lambda t: F.date_trunc("minute", t.cast("timestamp_ntz"))
    local = F.from_utc_timestamp(F.col("since").cast("timestamp"), F.col("timezone"))
    day = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.date_add(F.to_date(local), k))
    fits = F.filter(day, lambda d: F.col("day_of_week").isNull() | (F.dayofweek(d) - 1 == F.col("day_of_week") % 7))
    at = F.transform(fits, lambda d: F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(d.cast("timestamp")) + F.col("hour") * 3600 + F.col("minute") * 60), F.col("timezone")))
    clock = F.array_min(F.filter(at, lambda t: t > F.col("since").cast("timestamp")))
    every = F.timestamp_seconds(F.unix_seconds(F.col("since").cast("timestamp")) + F.col("interval_minutes") * 60)
    return plans.withColumn("next_run", minute(F.when(F.col("interval_minutes").isNotNull(), every).otherwise(clock)).cast("timestamp_ntz"))
