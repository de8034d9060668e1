"""Shared SQL fragments for the DuckDB oracle queries (the driver's correctness check).

The oracle side is deliberately naive (plain windows, correlated counts): it is the reference
answer the Spark plans are checked against at small scale.
"""

from __future__ import annotations

from eventide.config import BUCKET_EDGES_DAYS, DAY_US

EV_EVENTS = """ev AS (
  SELECT CAST(user_id % 5 AS BIGINT) AS AccountId,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 1 THEN 'app1'
              WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 2 THEN 'app2'
         END AS ApplicationId,
         'churn-' || CAST(user_id % 2 AS VARCHAR) AS ModelId,
         event_type AS DefinitionId,
         ts AS OccurredTime,
         epoch_us(ts) AS OccurredTimeTicks,
         user_id AS PersonId,
         event_id AS EventKey
  FROM events)"""

EV_ORDERS = """ev AS (
  SELECT CAST(o_custkey % 5 AS BIGINT) AS AccountId,
         o_orderstatus AS ApplicationId,
         'churn-' || CAST(o_custkey % 2 AS VARCHAR) AS ModelId,
         o_orderpriority AS DefinitionId,
         o_orderdate AS OccurredTime,
         epoch_us(o_orderdate) AS OccurredTimeTicks,
         o_custkey AS PersonId,
         o_orderkey AS EventKey
  FROM orders)"""

EV = {"events": EV_EVENTS, "orders": EV_ORDERS}

ORDER_ASC = "OccurredTime, OccurredTimeTicks, DefinitionId, EventKey"
ORDER_DESC = "OccurredTime DESC, OccurredTimeTicks DESC, DefinitionId DESC, EventKey DESC"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def day_bucket(delta_us: str, edges=BUCKET_EDGES_DAYS) -> str:
    arms = " ".join(f"WHEN {delta_us} < {int(e) * DAY_US} THEN {i}" for i, e in enumerate(edges))
    return f"CAST(CASE {arms} ELSE {len(edges)} END AS INTEGER)"


def label(next_time: str, ref_time: str, edges=BUCKET_EDGES_DAYS) -> str:
    return (f"CAST(CASE WHEN {next_time} IS NULL THEN {len(edges)} ELSE "
            f"{day_bucket(f'(epoch_us({next_time}) - epoch_us({ref_time}))', edges)} END "
            f"AS INTEGER)")


def hex8_uniform(text: str) -> str:
    return f"(CAST(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


def hex8_int(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)
