"""Telemetry inputs derived from the given tables, in SQL that both engines read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A day at a fraction of a second of its own.
_MOMENT = "{from_micros}({micros}(day) + 1000 * ((137 * day(day)) % 1000))"
#: {name} stands for a table. Counters restart each year.
COUNTERS = f"""
  SELECT host, device, {_MOMENT} AS ts,
         sum(q) OVER w AS reads, sum(n) OVER w AS reads_merged, sum(2 * q) OVER w AS sectors_read, sum(3 * n) OVER w AS ms_reading,
         sum(p) OVER w AS writes, sum(n) OVER w AS writes_merged, sum(4 * p) OVER w AS sectors_written, sum(5 * n) OVER w AS ms_writing,
         sum(7 * n) OVER w AS ms_io, sum(9 * n) OVER w AS weighted_ms_io
  FROM (SELECT concat('h', l_suppkey % 7) AS host, concat('d', l_suppkey) AS device, cast(l_shipdate AS timestamp) AS day, year(l_shipdate) AS y,
               cast(sum(l_quantity) AS double) AS q, cast(count(*) AS double) AS n, cast(sum(l_linenumber) AS double) AS p
        FROM {{lineitem}} GROUP BY 1, 2, 3, 4) t
  WINDOW w AS (PARTITION BY host, device, y ORDER BY day ROWS UNBOUNDED PRECEDING)"""
CPU_TIMES = f"""
  SELECT host, {_MOMENT} AS ts, cores, sum(q) OVER w AS user, sum(n) OVER w AS nice, sum(p) OVER w AS system, sum(90 * n) OVER w AS idle, sum(2 * n) OVER w AS iowait,
         sum(n) OVER w AS irq, sum(p) OVER w AS softirq, sum(n) OVER w AS steal, sum(n) OVER w AS guest
  FROM (SELECT concat('h', l_suppkey % 7) AS host, cast(l_shipdate AS timestamp) AS day,
               cast(sum(l_quantity) AS double) AS q, cast(count(*) AS double) AS n, cast(sum(l_linenumber) AS double) AS p, max(l_linenumber) AS cores
        FROM {{lineitem}} GROUP BY 1, 2) t
  WINDOW w AS (PARTITION BY host ORDER BY day ROWS UNBOUNDED PRECEDING)"""
SAMPLES = """
  SELECT concat('h', user_id % 5) AS host, cast(ts AS timestamp) AS ts, event_id AS seq, event_type AS name,
         CASE event_id % 4 WHEN 0 THEN 'gauge' WHEN 1 THEN 'counter' WHEN 2 THEN 'histogram' ELSE 'set' END AS type,
         value, cast(user_id AS {string}) AS member,
         CASE WHEN event_id % 2 = 0 THEN {array}'env:prod', concat('device:d', user_id % 3)] ELSE {array}concat('device:d', user_id % 3), 'env:prod'] END AS tags,
         1.0e0 / pow(2, event_id % 3) AS sample_rate
  FROM {events}"""
PROCS = f"""
  SELECT host, {_MOMENT} AS snap_ts, pid, create_time, name, user_time, system_time, read_count, write_count, read_bytes, write_bytes, memory FROM (
  SELECT concat('h', user_id % 5) AS host, cast(date_trunc('day', ts) AS timestamp) AS day, cast(user_id AS int) AS pid,
         cast(1700000000000 + 5000 * month(min(ts)) + min(event_id) % 40 AS bigint) AS create_time,
         concat('p', user_id % 9) AS name, cast(sum(event_id % 50) AS double) AS user_time, cast(sum(event_id % 20) AS double) AS system_time,
         cast(count(*) AS double) AS read_count, cast(sum(event_id % 7) AS double) AS write_count, cast(sum(event_id % 1000) AS double) AS read_bytes,
         cast(sum(event_id % 77) AS double) AS write_bytes, cast(sum(user_id + event_id % 100) AS bigint) AS memory
  FROM {{events}} GROUP BY 1, 2, 3, user_id) t"""
SERIES = """
  SELECT concat('part.', l_partkey % 50) AS metric, CASE WHEN l_partkey % 2 = 0 THEN 'gauge' ELSE 'rate' END AS type, cast(10 AS bigint) AS {q}interval{q},
         {array}concat('flag:', l_returnflag)] AS tags, 'h' AS host, '' AS device, cast(l_orderkey * 10 + l_linenumber AS bigint) AS ts, cast(l_quantity AS double) AS value, l_linenumber AS n
  FROM {lineitem}"""
LINES = """
  SELECT doc_id, concat('s', doc_id) AS source_id, pos AS offset, cast(null AS timestamp) AS ts, line FROM {lines}"""
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dialect(sql: str, duck: bool) -> str:
    for k, (a, b) in {"{array}": ("array(", "["), "{string}": ("string", "varchar"), "{q}": ("`", '"'), "{micros}": ("unix_micros", "epoch_us"), "{from_micros}": ("timestamp_micros", "make_timestamp")}.items():
        sql = sql.replace(k, b if duck else a)
    return sql if duck else re.sub(r"\]", ")", sql)


def in_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(_dialect(sql, False), **{t: table(spark, sf_dir, t) for t in names})


def in_duck(sql: str) -> str:
    sql = _dialect(sql, True)
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in `spark.checkpoint.dir`; a temporary one only in a local session."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="scratch-")
    return f"{top.rstrip('/')}/scratch-{uuid.uuid4().hex}"
