"""Numbers, times, durations and ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Milliseconds of the units of durations.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "M": 2_592_000_000, "q": 7_862_400_000, "y": 31_536_000_000}
#: Names of the fields that hold an event's time, and the forms they may have.
TIME_FIELDS = ("timestamp", "time", "ts")
_PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?$"
_RFC = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def is_number(s: str) -> bool:
    return bool(re.match(_NUMBER, s)) and abs(float(s)) != float("inf")


def number(c: Column) -> Column:
    """The finite number that a token spells, else null."""
    x = F.when(c.rlike(_NUMBER), c.try_cast("double"))
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def duration_ms(s: str) -> int:
    """Milliseconds of ``10s``, ``5m``, ``1M`` (30 days) and the like."""
    m = re.fullmatch(r"(-?[0-9]+)([a-zA-Z]+)", s)
    if not m or m[2] not in UNITS:
        raise ValueError(f'cannot parse duration "{s}"')
    return int(m[1]) * UNITS[m[2]]


def mid_of_ntz(c: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), c) * 1000).cast("long")


def mid_of(c: Column) -> Column:
    """Milliseconds since 1970 of a timestamp."""
    return F.floor(F.unix_micros(c) / 1000).cast("long")


def floor_to(mid: Column, interval_ms: int) -> Column:
    return mid - mid % F.lit(interval_ms)


def parsed_time(c: Column) -> Column:
    """The instant of a time string: ``2024-04-19 18:04:25.999`` (UTC) or RFC 3339; else null."""
    plain = F.when(c.rlike(_PLAIN), F.concat(F.regexp_replace(F.regexp_replace(c, ",", "."), r"(\.[0-9]{6})[0-9]*$", "$1"), F.lit("Z")))
    rfc = F.when(c.rlike(_RFC), F.regexp_replace(F.regexp_replace(c, ",", "."), r"(\.[0-9]{6})[0-9]*", "$1"))
    return F.coalesce(F.try_to_timestamp(plain), F.try_to_timestamp(rfc))


def clamped(event: Column, arrival: Column, drift_ms: int = 86_400_000, future_ms: int = 300_000) -> Column:
    """Event time in ms, or the arrival if the event is too old, too far ahead, or unknown."""
    off = event.isNull() | (event < arrival - drift_ms) | (event > arrival + future_ms)
    return F.when(off, arrival).otherwise(event)


def _little(c: Column) -> Column:
    """16 hex digits of a long, lowest byte first."""
    digits = F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])


def id_text(mid: Column, rid: Column) -> Column:
    """The 33 characters that stand for (mid, rid)."""
    return F.concat(_little(mid), F.lit("-"), _little(rid))


def id_parts(s: str) -> tuple[int, int]:
    """(mid, rid) of an id's text."""
    if len(s) != 33 or s[16] != "-":
        raise ValueError(f'wrong id "{s}"')
    mid, rid = (int.from_bytes(bytes.fromhex(x), "little", signed=True) for x in (s[:16], s[17:]))
    return mid, rid


def id_string(mid: int, rid: int) -> str:
    return "-".join(x.to_bytes(8, "little", signed=True).hex() for x in (mid, rid))
