"""Time expressions.

All arithmetic runs on microsecond bigints; the session time zone is pinned to UTC so that
``cast(timestamp_ntz as timestamp)`` is the identity on the wall clock.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide.config import DAY_US, SECOND_US

# The four periods of the cyclic time features, in seconds
# (day, week, month = 365/12 days, year = 365 days).
PERIOD_SECONDS = {
    "day": 24 * 60 * 60,
    "week": 7 * 24 * 60 * 60,
    "month": 365 * 24 * 60 * 60 / 12,
    "year": 365 * 24 * 60 * 60,
}

TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(t) -> Column:
    """A zone-less timestamp literal built from text (no local-zone conversion in Python)."""
    if isinstance(t, Column):
        return t
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp (UTC session)."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def from_epoch_us(us: Column | str) -> Column:
    return F.timestamp_micros(_c(us)).cast("timestamp_ntz")


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since the epoch, floored."""
    return F.floor(epoch_us(ts) / SECOND_US).cast("bigint")


def add_us(ts: Column | str, us: Column | int) -> Column:
    """Timestamp plus a microsecond offset, kept zone-less."""
    off = us if isinstance(us, Column) else F.lit(int(us))
    return from_epoch_us(epoch_us(ts) + off)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Fractional days from ``earlier`` to ``later``."""
    return (epoch_us(later) - epoch_us(earlier)) / float(DAY_US)


def ts_text(ts: Column | str) -> Column:
    """Fixed text form with microseconds (exports and oracle comparison)."""
    return F.date_format(_c(ts), TS_TEXT_FORMAT)


def parse_event_time(text: Column | str) -> Column:
    """Event time from text with or without a fractional second."""
    t = _c(text)
    return F.coalesce(
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")),
    ).cast("timestamp_ntz")


def phase(seconds: Column, period: str) -> Column:
    """Position inside a period, in [0, P)."""
    return F.pmod(seconds.cast("double"), F.lit(float(PERIOD_SECONDS[period])))


def phase_sin_cos(seconds: Column, period: str) -> tuple[Column, Column]:
    """Angle pi*(phase - P/2)/P, i.e. a half circle in [-pi/2, pi/2)."""
    p = float(PERIOD_SECONDS[period])
    ang = (phase(seconds, period) - p / 2.0) / (p / math.pi)
    return F.sin(ang), F.cos(ang)


def time_features(seconds: Column, mean: Column, std: Column) -> list[tuple[str, Column]]:
    """The nine features of one event time: (sin, cos) per period, then the z-score."""
    out: list[tuple[str, Column]] = []
    for name in PERIOD_SECONDS:
        s, c = phase_sin_cos(seconds, name)
        out.append((f"{name}_sin", s))
        out.append((f"{name}_cos", c))
    out.append(("z", (seconds.cast("double") - mean) / F.nullif(std, F.lit(0.0))))
    return out


def sample_key(person: Column | str, t0: Column | str) -> Column:
    """C14: text key ``{PersonId}_{t0}`` for exports (samples stay keyed by the two columns)."""
    return F.concat(_c(person).cast("string"), F.lit("_"),
                    F.date_format(_c(t0), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
