"""Human-readable sizes, ages and uptimes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MINUTE, _HOUR, _DAY = 60, 3600, 86_400


def _whole(n: Column, unit: int) -> Column:
    return F.floor(n / unit).cast("bigint")


def format_bytes(n: Column) -> Column:
    """1023 B, 1.5 KB, 2.0 MB, 3.1 GB: one decimal above bytes, half up; gigabytes are the largest unit."""
    out = F.when(n < 1024, F.format_string("%d B", n.cast("bigint")))
    scaled = lambda power, unit: F.format_string(f"%.1f {unit}", F.round(n / float(1024**power), 1))
    return out.when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def _two(n: Column, big: int, first: str, small: int, second: str) -> Column:
    """'1h 15m', or '1h' where the second part is zero."""
    rest = _whole(n % big, small)
    return F.when(rest == 0, F.format_string(f"%d{first}", _whole(n, big))).otherwise(F.format_string(f"%d{first} %d{second}", _whole(n, big), rest))


def format_time_ago(seconds: Column) -> Column:
    """5s ago, 5m ago, 2h ago, 1h 15m ago, 3d ago; a negative age is 'in future'."""
    return (
        F.when(seconds < 0, "in future")
        .when(seconds < _MINUTE, F.format_string("%ds ago", seconds.cast("bigint")))
        .when(seconds < _HOUR, F.format_string("%dm ago", _whole(seconds, _MINUTE)))
        .when(seconds < _DAY, F.concat(_two(seconds, _HOUR, "h", _MINUTE, "m"), F.lit(" ago")))
        .otherwise(F.format_string("%dd ago", _whole(seconds, _DAY)))
    )


def format_uptime(seconds: Column) -> Column:
    """45s, 3m 20s, 2h 5m, 1d 4h; a second part of zero is left out."""
    return (
        F.when(seconds < _MINUTE, F.format_string("%ds", seconds.cast("bigint")))
        .when(seconds < _HOUR, _two(seconds, _MINUTE, "m", 1, "s"))
        .when(seconds < _DAY, _two(seconds, _HOUR, "h", _MINUTE, "m"))
        .otherwise(_two(seconds, _DAY, "d", _HOUR, "h"))
    )
