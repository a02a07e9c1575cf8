"""Tags, identifiers, dates, windows of time and cursors."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86_400


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a time (without a zone: of its session's zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    """a - b in seconds."""
    return (micros(a) - micros(b)) / 1_000_000


def draw(seed: int, *columns: Column | str) -> Column:
    """A number from 0 to below 1 that depends on the seed and the columns alone: 48 bits of a digest of their texts, which other engines can form as well."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


# Tags


def normalize_tag(tag: Column) -> Column:
    """Trimmed, lower case, single spaces; null unless 1-64 of a-z 0-9 space _ - : without a colon at either end."""
    out = F.regexp_replace(F.trim(F.lower(tag)), r"\s+", " ")
    return F.when(out.rlike(r"^(?!:)[a-z0-9 _\-:]{1,64}(?<!:)$"), out)


def tag_text(tag: str) -> str:
    """The same for one input, where a tag that isn't valid is an error."""
    import re

    out = re.sub(r"\s+", " ", tag.strip().lower())
    if not re.fullmatch(r"(?!:)[a-z0-9 _\-:]{1,64}(?<!:)", out):
        raise ValueError(f"not a tag: {tag!r}")
    return out


def tag_namespace(tag: Column) -> Column:
    return F.when(F.contains(tag, F.lit(":")), F.substring_index(tag, ":", 1))


def tag_value(tag: Column) -> Column:
    return F.when(F.contains(tag, F.lit(":")), F.regexp_replace(tag, r"^[^:]*:", "")).otherwise(tag)


# Identifiers


def normalize_isrc(isrc: Column) -> Column:
    out = F.upper(F.replace(isrc, F.lit("-"), F.lit("")))
    return F.when(out.rlike("^[A-Z0-9]{12}$"), out)


def isrc_year(isrc: Column, pivot: int = 40) -> Column:
    """Characters 6 and 7 as a year: up to the pivot in this century, else the last."""
    two = F.substring(isrc, 6, 2).try_cast("int")
    return F.when(two <= pivot, 2000 + two).when(two.isNotNull(), 1900 + two)


def pair_identifier(artist: Column, title: Column) -> Column:
    return F.concat_ws("::", F.lower(F.trim(artist)), F.lower(F.trim(title)))


def track_id_from_uri(uri: Column) -> Column:
    found = F.regexp_extract(uri, r"^spotify:track:([A-Za-z0-9]{22})$", 1)
    return F.when(found != "", found)


def pair_digest(*sides: Column) -> Column:
    """16 hex digits of the sha256 of a canonical pair."""
    return F.substring(F.sha2(F.to_json(F.struct(*sides)).cast("binary"), 256), 1, 16)


def config_digest(config: dict) -> str:
    """12 hex digits that change with any setting."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


# Dates


def release_date(value: Column) -> Column:
    """The first instant of a year, month or day."""
    return F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), F.try_to_timestamp(value, F.lit("yyyy-MM")), F.try_to_timestamp(value, F.lit("yyyy")))


def lenient_time(value: Column) -> Column:
    """A time from ISO text or text of epoch seconds, else null."""
    number = value.try_cast("double")  # first: the JVM would read four digits as a year
    return F.when(number.isNotNull(), F.timestamp_seconds(number)).otherwise(F.try_to_timestamp(value))


def moment(value: str | dt.datetime | None) -> dt.datetime | None:
    """A naive UTC time from ISO text; wrong text is an error."""
    if value is None or value == "":
        return None
    out = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)
    return out.astimezone(dt.UTC).replace(tzinfo=None) if out.tzinfo else out


def time_window(as_of: dt.datetime, start_date=None, end_date=None, not_played_in_days=None, played_within_days=None) -> tuple[dt.datetime | None, dt.datetime | None]:
    """(after, before), half open. played_within_days sets after and outranks start_date; end_date outranks not_played_in_days."""
    after, before = moment(start_date), moment(end_date)
    if played_within_days is not None:
        after = as_of - dt.timedelta(days=played_within_days)
    if not_played_in_days is not None and before is None:
        before = as_of - dt.timedelta(days=not_played_in_days)
    return after, before


def in_window(value: Column, after: dt.datetime | None, before: dt.datetime | None) -> Column:
    out = F.lit(True)
    if after is not None:
        out = out & (value >= F.lit(after).cast("timestamp_ntz"))
    if before is not None:
        out = out & (value < F.lit(before).cast("timestamp_ntz"))
    return out


# Cursors


@dataclass(frozen=True)
class Cursor:
    """The sort column, value and id of the last row of a page."""

    column: str
    value: str | float | int | None
    id: int | str


def encode_cursor(c: Cursor) -> str:
    return base64.urlsafe_b64encode(json.dumps({"c": c.column, "v": c.value, "id": c.id}).encode()).decode()


def decode_cursor(text: str) -> Cursor:
    """Anything malformed, wrong types included, is a ValueError."""
    try:
        raw = json.loads(base64.urlsafe_b64decode(text.encode()))
        column, value, id = raw["c"], raw["v"], raw["id"]
    except (binascii.Error, UnicodeError, ValueError, KeyError, TypeError) as e:
        raise ValueError(f"not a cursor: {text!r}") from e
    if not isinstance(column, str) or isinstance(value, (dict, list)) or not isinstance(id, (int, str)):
        raise ValueError(f"not a cursor: {text!r}")
    return Cursor(column, value, id)


def encode_cursors(column: str, value: Column, id: Column) -> Column:
    """The cursor of each row, as encode_cursor writes it."""
    own = lambda x: F.coalesce(F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'^\{"x":(.*)\}$', 1), F.lit(""))
    said = lambda x: F.when(own(x) == "", "null").otherwise(own(x))
    text = F.concat(F.lit(f'{{"c": {json.dumps(column)}, "v": '), said(value), F.lit(', "id": '), said(id), F.lit("}"))
    return F.translate(F.base64(text.cast("binary")), "+/", "-_")


def decode_cursors(text: Column) -> Column:
    """A struct of column, value and id (texts), or null for a malformed cursor, wrong types included."""
    raw = F.try_parse_json(F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64")).cast("string"))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(raw, f"$.{k}", "variant"))
    good = (kind("c") == "STRING") & kind("id").isin("STRING", "BIGINT") & kind("v").isNotNull() & ~kind("v").rlike("^(ARRAY|OBJECT)")
    got = lambda k: F.try_variant_get(raw, f"$.{k}", "string")
    return F.when(F.coalesce(good, F.lit(False)), F.struct(got("c").alias("column"), got("v").alias("value"), got("id").alias("id")))


def config_digests(config: Column) -> Column:
    """12 hex digits that change with any setting of a JSON object and not with its order."""
    return F.substring(F.sha2(F.to_json(F.parse_json(config)).cast("binary"), 256), 1, 12)
