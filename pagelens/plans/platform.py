"""Plain relational queries over the other tables: one text each, for Spark and for the oracle alike.

They have no counterpart among the page operators; they show that joins, aggregates, windows, set operations and
recursion over ordinary tables run beside them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

#: Tables stand in braces.
SQL = {
    "platform_pricing_summary": """
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_price, count(*) AS n
FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "platform_top_customers": """
SELECT c_custkey, c_name, n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, count(*) AS n_orders
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {nation} ON c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, n_name ORDER BY spent DESC, c_custkey LIMIT 20""",
    "platform_region_revenue": """
SELECT r_name, n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM {region} JOIN {nation} ON r_regionkey = n_regionkey JOIN {customer} ON n_nationkey = c_nationkey JOIN {orders} ON c_custkey = o_custkey
GROUP BY ROLLUP (r_name, n_name)""",
    "platform_latest_order": """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM {orders}) t WHERE k = 1""",
    "platform_running_events": """
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_type FROM {events}""",
    "platform_without_orders": """
SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)
EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal < 0""",
    "platform_large_orders": """
SELECT o_orderkey, o_custkey, t.n_lines FROM {orders} JOIN (
  SELECT l_orderkey, count(*) AS n_lines FROM {lineitem} GROUP BY l_orderkey HAVING count(*) >= 6) t ON l_orderkey = o_orderkey""",
    "platform_segments": """
SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, grouping(c_mktsegment) + grouping(o_orderpriority) AS level
FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)""",
    "platform_sessions": """
WITH e AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM {events}),
s AS (SELECT user_id, event_id, ts, sum(CASE WHEN last IS NULL OR ts > last + INTERVAL '30' MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, session""",
}


def _run(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return lambda spark, sf_dir: spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(sql) for name, sql in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: re.sub(r"\{(\w+)\}", r"\1", sql) for name, sql in SQL.items()}
