from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from eventide.session import build_session

    s = build_session("local[4]", app_name="eventide-tests", shuffle_partitions=4,
                      extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def make_events(spark, rows):
    """rows: (PersonId, OccurredTime text, DefinitionId[, AccountId, ApplicationId, EventKey])."""
    from eventide.schema import EVENT_SCHEMA

    out = []
    for i, r in enumerate(rows):
        pid, t, d = r[0], ts(r[1]), r[2]
        acc = r[3] if len(r) > 3 else 12345
        app = r[4] if len(r) > 4 else None
        key = r[5] if len(r) > 5 else i
        ticks = int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        out.append((acc, app, "m1", d, t, ticks, pid, key))
    return spark.createDataFrame(out, EVENT_SCHEMA)


# visits of three persons over March 2031, not in time order; person 30 comes once
VISITS = [
    (20, "2031-03-09 08:15:00.000500", "open"),
    (10, "2031-03-02 22:40:10.250000", "open"),
    (20, "2031-03-21 06:00:00", "pay"),
    (10, "2031-03-17 07:05:59.999999", "close"),
    (20, "2031-03-04 12:30:00", "open"),
    (30, "2031-03-25 19:00:00.125000", "pay"),
    (20, "2031-03-15 23:59:59.500000", "close"),
]
