"""Datetimes: strict default formats, custom formats, text forms. All are UTC, to the millisecond."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.types import ColumnParseError

EPOCH = datetime(1970, 1, 1)
#: Fixed values, the default formats: RFC 3339 with an offset, a date, a date and time. A date and time with T but no offset is none of them.
RFC3339 = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
DATE_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"


def to_millis(value: datetime) -> int:
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return (value - EPOCH) // timedelta(milliseconds=1)


def from_millis(millis: int) -> datetime:
    return EPOCH + timedelta(milliseconds=millis)


def parse(text: str) -> int | None:
    """Milliseconds since the epoch by a default format; None if text is in none of them."""
    try:
        if re.fullmatch(RFC3339, text):
            whole, fraction, zone = re.fullmatch(r"(.{19})(\.[0-9]+)?(.+)", text.upper().replace("T", " ")).groups()
            at = datetime.fromisoformat(whole + ("+00:00" if zone == "Z" else zone))
            return to_millis(at) + int(((fraction or ".0")[1:] + "00")[:3])
        if re.fullmatch(DATE, text) or re.fullmatch(DATE_TIME, text):
            return to_millis(datetime.fromisoformat(text))
    except ValueError:
        pass
    return None


def parse_as(text: str, pattern: str | None) -> int:
    """As parse, or by a strftime pattern of a date and time or of a date alone; raises ColumnParseError."""
    if pattern is None:
        millis = parse(text)
        if millis is None:
            raise ColumnParseError(f"Cannot parse '{text}' as datetime. Supported formats: ISO 8601, YYYY-MM-DD, YYYY-MM-DD HH:MM:SS")
        return millis
    try:
        return to_millis(datetime.strptime(text, pattern).replace(tzinfo=None))
    except ValueError:
        raise ColumnParseError(f"Cannot parse '{text}' with format '{pattern}'") from None


def show(value: datetime) -> str:
    return f"{value:%Y-%m-%d %H:%M:%S} UTC"


def literal(millis: int) -> Column:
    """A constant timestamp without zone."""
    return F.expr(f"timestamp_ntz'{from_millis(millis).isoformat(' ', 'milliseconds')}'")


def parse_column(text: Column) -> Column:
    """Timestamps without zone of texts in the default formats, to the millisecond; null for others. For tables too large for parse."""
    whole = lambda pattern: text.rlike(f"^(?:{pattern})$")
    # the wall clock and the offset apart, so that the session's time zone has no say
    wall = F.try_to_timestamp(F.concat(F.translate(F.substring(text, 1, 19), "Tt", "  "), F.lit("Z")))
    digits = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]+)", 1), 1, 3), 3, "0").cast("int")
    sign = F.when(text.rlike("-[0-9]{2}:[0-9]{2}$"), -1).otherwise(1)
    hours, minutes = (F.regexp_extract(text, r"[+-]([0-9]{2}):([0-9]{2})$", i) for i in (1, 2))
    shift = F.when(text.rlike(r"[+-][0-9]{2}:[0-9]{2}$"), sign * (hours.cast("int") * 60 + minutes.cast("int"))).otherwise(0)
    zoned = F.timestamp_millis(F.unix_millis(wall) - shift * 60000 + F.when(text.contains("."), digits).otherwise(0))
    plain = F.try_to_timestamp(F.concat(F.rpad(text, 19, " 00:00:00"), F.lit("Z")))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.when(whole(RFC3339), zoned).when(whole(DATE) | whole(DATE_TIME), plain).cast("timestamp_ntz"))
