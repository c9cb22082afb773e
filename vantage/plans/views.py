"""Derived views over the driver's tables, as SQL that Spark and DuckDB read alike; ``{name}`` stands for a base table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LON0, LAT0, GROUND, EYE = -103.8827973, 30.2751108, 1500.0, 1.6

VIEWS = {
    "targets": "SELECT o_orderkey AS target_id, -10393e-2 - (o_orderkey % 997) * 2e-4 AS lon, 3025e-2 - (o_orderkey % 613) * 3e-4 AS lat, o_orderkey * 6e1 AS chain, "
    "CASE o_orderkey % 3 WHEN 0 THEN 'US-67' WHEN 1 THEN 'FM-2810' ELSE 'RM-169' END AS route FROM {orders}",
    "series": "SELECT user_id, event_id, event_type, ts, value AS v, value > 3e1 AS in_view, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, "
    "sum(1 + CAST(floor(value) AS BIGINT) % 97) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 1e0 AS chain FROM {events}",
    "lines": "SELECT c_nationkey AS line_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS seq, 15e1 + (c_custkey % 1400) * 1e-1 AS az, "
    "-1e0 + (c_custkey % 173) * 2e-2 AS el, 1e1 + (c_custkey % 311) * 1e-1 AS km, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 1e4 END AS rate FROM {customer}",
    "sources": "SELECT s_suppkey AS source_id, s_nationkey AS nation, 15e1 + (s_suppkey * 37 % 1493) * 1e-1 AS az, -5e-1 + (s_suppkey % 97) * 2e-2 AS el, 5e0 + (s_suppkey % 71) AS km, "
    "(s_suppkey % 29) * 5e-2 AS kc, CASE s_suppkey % 4 WHEN 0 THEN 'tower' WHEN 1 THEN 'town' WHEN 2 THEN 'cell' ELSE 'field' END AS kind FROM {supplier}",
    "raster": "SELECT p_partkey % 60 AS r, p_partkey // 60 AS c, CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE p_retailprice END AS z FROM {part}",
}


def _filled(sql: str, spark_side: bool) -> str:
    return sql.replace("p_partkey // 60", "p_partkey DIV 60") if spark_side else sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _filled(VIEWS[name], True)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", sql)})


def with_views(sql: str) -> str:
    """``sql`` with the views that it names (v_<name>) as common table expressions, for DuckDB."""
    used = [n for n in VIEWS if re.search(rf"\bv_{n}\b", sql)]
    heads = ", ".join(f"v_{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in used)
    sql = sql.strip()
    if not heads:
        return sql
    if re.match(r"WITH RECURSIVE\b", sql):
        return f"WITH RECURSIVE {heads}, {sql[14:].strip()}"
    return f"WITH {heads}, {sql[4:].strip()}" if re.match(r"WITH\b", sql) else f"WITH {heads} {sql}"
