"""Queries over counter snapshots and processes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counters, hosts, sinks
from .recipes import COUNTERS, CPU_TIMES, PROCS, in_duck, in_spark

def _ts(c: str = "ts"):
    return F.unix_micros(c).alias("ts")


def cpu_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counters.cpu_pct(in_spark(spark, sf_dir, CPU_TIMES))
    return rows.select("host", _ts(), *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


def net_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = in_spark(spark, sf_dir, COUNTERS).withColumnsRenamed(dict(zip(["reads", "reads_merged", "sectors_read", "ms_reading", "writes", "writes_merged", "sectors_written", "ms_writing"], counters.NET)))
    return counters.net_rates(c).select("host", "device", _ts(), "counter", F.round("rate", 9).alias("rate"))


def disk_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.disk_io_rates(in_spark(spark, sf_dir, COUNTERS)).select("host", "device", _ts(), "metric", F.round("value", 6).alias("value"))


def disk_io_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = in_spark(spark, sf_dir, COUNTERS).selectExpr("host", "device", "ts", "reads AS read_ops", "writes AS write_ops", "sectors_read AS read_bytes", "sectors_written AS write_bytes", "ms_io AS busy_s")
    return counters.disk_io_rates(c, "busy").select("host", "device", _ts(), "metric", F.round("value", 9).alias("value"))


def cpu_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.cpu_gauges(in_spark(spark, sf_dir, CPU_TIMES)).select("host", _ts(), "metric", F.round("value", 6).alias("value"))


_AS_BYTES = "host, device, ts, reads AS read_ops, writes AS write_ops, 512 * (sectors_read - ms_io) AS read_bytes, 512 * sectors_written AS write_bytes, (ms_reading - writes) / 1000 AS read_dur_s, ms_writing / 1000 AS write_dur_s, ms_io / 1000 AS busy_s"


def disk_io_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = in_spark(spark, sf_dir, f"SELECT {_AS_BYTES} FROM ({COUNTERS})")
    return counters.disk_io_rates(c, "durations").select("host", "device", _ts(), "metric", F.round("value", 9).alias("value"))


def disk_io_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = in_spark(spark, sf_dir, f"SELECT {_AS_BYTES} FROM ({COUNTERS})")
    return counters.disk_io_rates(c, "basic").select("host", "device", _ts(), "metric", F.round("value", 9).alias("value"))


def clamped_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that go back each year and, merged minus read, at other times."""
    c = in_spark(spark, sf_dir, f"SELECT host, device, ts, reads, reads_merged * 30 - writes AS odd FROM ({COUNTERS})")
    return counters.counter_rate(c, "host", ["device"], "ts", ["reads", "odd"], "clamp").select("host", "device", _ts(), "counter", F.round("rate", 9).alias("rate"))


def reads_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.counter_rate(in_spark(spark, sf_dir, COUNTERS), "host", ["device"], "ts", ["reads", "writes"]).select("host", "device", _ts(), "counter", F.round("rate", 9).alias("rate"))


def running_totals(procs: DataFrame) -> DataFrame:
    """Processes with cumulative counters out of each snapshot's own."""
    return procs.withColumns({c: F.sum(c).over(_running()) for c in ("user_time", "system_time", "read_count", "write_count", "read_bytes", "write_bytes")})


def proc_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counters.proc_rates(running_totals(in_spark(spark, sf_dir, PROCS)))
    return rows.select("host", "pid", _ts("snap_ts"), "pinned", *[F.round(c, 9).alias(c) for c in ("user_pct", "system_pct", "total_pct", "read_count_s", "write_bytes_s")])


def _running():
    from pyspark.sql.window import Window

    return Window.partitionBy("host", "pid").orderBy("snap_ts").rowsBetween(Window.unboundedPreceding, 0)


def pin_create_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.pin_create_time(in_spark(spark, sf_dir, PROCS)).select("host", "pid", _ts("snap_ts"), "create_time", "pinned")


def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.top_n_memory(in_spark(spark, sf_dir, PROCS), ["host", "snap_ts"], 5).select("host", _ts("snap_ts"), "name", "memory", "rank")


def chunk_procs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.chunk_procs(in_spark(spark, sf_dir, PROCS), 50).groupBy("host", _ts("snap_ts"), "chunk", "group_size").agg(F.count("*").alias("n"), F.min("pid").alias("first_pid"))


QUERIES = {f.__name__: f for f in (cpu_pct, cpu_gauges, net_rates, reads_writes, clamped_rates, disk_io, disk_io_durations, disk_io_busy, disk_io_basic, proc_rates, pin_create_time, top_n, chunk_procs)}


def _back(sql: str, entity: str, cols: list[str]) -> str:
    keys = f"host{', ' + entity if entity else ''}"
    lags = ", ".join(f"{c} - lag({c}) OVER w AS d_{c}" for c in cols)
    return f"""SELECT * FROM (SELECT {keys}, ts, snap - lag(snap) OVER w AS ds, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS dt, {lags}
      FROM (SELECT *, dense_rank() OVER (PARTITION BY host ORDER BY ts) AS snap FROM ({in_duck(sql)})) WINDOW w AS (PARTITION BY {keys} ORDER BY ts)) WHERE ds = 1"""


_DISK = ["reads", "reads_merged", "sectors_read", "ms_reading", "writes", "writes_merged", "sectors_written", "ms_writing", "ms_io", "weighted_ms_io"]
_LONG = "SELECT host, device, epoch_us(ts) AS ts, x.m AS metric, round(x.v, {r}) AS value FROM (SELECT *, unnest([{items}]) AS x FROM b WHERE d_reads >= 0 AND d_writes >= 0) WHERE x.v IS NOT NULL"


def _items(d: dict[str, str]) -> str:
    return ", ".join(f"{{'m': '{k}', 'v': CAST({v} AS DOUBLE)}}" for k, v in d.items())


_PINNED = f"""
    WITH RECURSIVE p AS (SELECT *, dense_rank() OVER (PARTITION BY host ORDER BY snap_ts) AS snap, row_number() OVER (PARTITION BY host, pid ORDER BY snap_ts) AS n FROM ({in_duck(PROCS)})),
    f AS (SELECT *, create_time AS pinned FROM p WHERE n = 1
          UNION ALL SELECT p.*, CASE WHEN p.snap = f.snap + 1 AND abs(f.pinned - p.create_time) < 2000 THEN f.pinned ELSE p.create_time END FROM f JOIN p ON p.host = f.host AND p.pid = f.pid AND p.n = f.n + 1)"""
_BYTES = f"SELECT {_AS_BYTES} FROM ({COUNTERS})"
_OPS = ["read_ops", "write_ops", "read_bytes", "write_bytes", "read_dur_s", "write_dur_s", "busy_s"]
_LONG_OPS = _LONG.replace("d_reads", "d_read_ops").replace("d_writes", "d_write_ops")
_PLAIN = {"r_s": "d_read_ops / dt", "w_s": "d_write_ops / dt", "rkb_s": "greatest(d_read_bytes, 0) / 1024 / dt", "wkb_s": "greatest(d_write_bytes, 0) / 1024 / dt"}
ORACLES = {
    "cpu_gauges": "WITH b AS (" + _back(CPU_TIMES, "", counters.CPU) + """), t AS (SELECT *, d_user + d_nice + d_system + d_idle + d_iowait + d_irq + d_softirq + d_steal AS t FROM b)
        SELECT host, epoch_us(ts) AS ts, x.m AS metric, round(x.v, 6) AS value FROM (SELECT *, unnest([{'m': 'user_pct', 'v': 100 * (d_user + d_nice) / t}, {'m': 'system_pct', 'v': 100 * (d_system + d_irq + d_softirq) / t}, {'m': 'iowait_pct', 'v': 100 * d_iowait / t},
               {'m': 'idle_pct', 'v': 100 * d_idle / t}, {'m': 'stolen_pct', 'v': 100 * d_steal / t}, {'m': 'guest_pct', 'v': 100 * d_guest / t}]) AS x FROM t WHERE t > 0)
        UNION ALL SELECT host, epoch_us(ts), 'num_cores', CAST(cores AS DOUBLE) FROM (""" + in_duck(CPU_TIMES) + ")",
    "disk_io_durations": "WITH b AS (" + _back(_BYTES, "device", _OPS) + ") " + _LONG_OPS.format(r=9, items=_items(_PLAIN | {
        "util": "least(100.0, 100 * greatest(d_busy_s, 0) / dt)", "await": "CASE WHEN d_read_ops + d_write_ops > 0 THEN 1000 * (greatest(d_read_dur_s, 0) + greatest(d_write_dur_s, 0)) / (d_read_ops + d_write_ops) END",
        "r_await": "CASE WHEN d_read_ops > 0 THEN 1000 * greatest(d_read_dur_s, 0) / d_read_ops END", "w_await": "CASE WHEN d_write_ops > 0 THEN 1000 * greatest(d_write_dur_s, 0) / d_write_ops END"})),
    "disk_io_basic": "WITH b AS (" + _back(_BYTES, "device", _OPS) + ") " + _LONG_OPS.format(r=9, items=_items(_PLAIN)),
    "reads_writes": "WITH b AS (" + _back(COUNTERS, "device", _DISK) + ") SELECT host, device, epoch_us(ts) AS ts, x.c AS counter, round(x.d / dt, 9) AS rate FROM (SELECT *, unnest([{'c': 'reads', 'd': d_reads}, {'c': 'writes', 'd': d_writes}]) AS x FROM b) WHERE x.d >= 0",
    "clamped_rates": "WITH b AS (" + _back(f"SELECT host, device, ts, reads, reads_merged * 30 - writes AS odd FROM ({COUNTERS})", "device", ["reads", "odd"]) + ") SELECT host, device, epoch_us(ts) AS ts, x.c AS counter, round(greatest(x.d, 0) / dt, 9) AS rate FROM (SELECT *, unnest([{'c': 'reads', 'd': d_reads}, {'c': 'odd', 'd': d_odd}]) AS x FROM b)",
    "cpu_pct": "WITH b AS (" + _back(CPU_TIMES, "", counters.CPU) + """), t AS (SELECT *, d_user + d_nice + d_system + d_idle + d_iowait + d_irq + d_softirq + d_steal AS t FROM b)
        SELECT host, epoch_us(ts) AS ts, round(100 * (d_user + d_nice) / t, 6) AS user_pct, round(100 * (d_system + d_irq + d_softirq) / t, 6) AS system_pct, round(100 * d_iowait / t, 6) AS iowait_pct,
               round(100 * d_idle / t, 6) AS idle_pct, round(100 * d_steal / t, 6) AS stolen_pct, round(100 * d_guest / t, 6) AS guest_pct FROM t WHERE t > 0""",
    "net_rates": "WITH b AS (" + _back(COUNTERS, "device", _DISK) + ") SELECT host, device, epoch_us(ts) AS ts, x.c AS counter, round(x.d / dt, 9) AS rate FROM (SELECT *, unnest([" + ", ".join(f"{{'c': '{n}', 'd': d_{c}}}" for n, c in zip(counters.NET, _DISK)) + "]) AS x FROM b) WHERE x.d >= 0",
    "disk_io": "WITH b AS (" + _back(COUNTERS, "device", _DISK) + ") " + _LONG.format(r=6, items=_items({
        "r_s": "d_reads / dt", "w_s": "d_writes / dt", "rkb_s": "d_sectors_read / 2 / dt", "wkb_s": "d_sectors_written / 2 / dt", "util": "least(100.0, 100 * greatest(d_ms_io, 0) / (dt * 1000))",
        "rrqm_s": "greatest(d_reads_merged, 0) / dt", "wrqm_s": "greatest(d_writes_merged, 0) / dt", "avg_q_sz": "greatest(d_weighted_ms_io, 0) / (dt * 1000)",
        "await": "CASE WHEN d_reads + d_writes > 0 THEN (greatest(d_ms_reading, 0) + greatest(d_ms_writing, 0)) / (d_reads + d_writes) END", "r_await": "CASE WHEN d_reads > 0 THEN greatest(d_ms_reading, 0) / d_reads END",
        "w_await": "CASE WHEN d_writes > 0 THEN greatest(d_ms_writing, 0) / d_writes END", "avg_rq_sz": "CASE WHEN d_reads + d_writes > 0 THEN (d_sectors_read + d_sectors_written) / (d_reads + d_writes) END"})),
    "disk_io_busy": "WITH b AS (" + _back(COUNTERS, "device", _DISK) + ") " + _LONG.format(r=9, items=_items({"r_s": "d_reads / dt", "w_s": "d_writes / dt", "rkb_s": "greatest(d_sectors_read, 0) / 1024 / dt", "wkb_s": "greatest(d_sectors_written, 0) / 1024 / dt", "util": "least(100.0, 100 * greatest(d_ms_io, 0) / dt)"})),
    "pin_create_time": _PINNED + " SELECT host, pid, epoch_us(snap_ts) AS ts, create_time, pinned FROM f",
    "proc_rates": _PINNED + """, r AS (SELECT host, pid, snap_ts, pinned, sum(user_time) OVER w AS u, sum(system_time) OVER w AS s, sum(read_count) OVER w AS rc, sum(write_bytes) OVER w AS wb, snap FROM f WINDOW w AS (PARTITION BY pid ORDER BY snap_ts ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT *, CASE WHEN snap - lag(snap) OVER w = 1 AND pinned = lag(pinned) OVER w THEN (epoch_us(snap_ts) - epoch_us(lag(snap_ts) OVER w)) / 1e6 END AS dt,
                     u - lag(u) OVER w AS du, s - lag(s) OVER w AS ds, rc - lag(rc) OVER w AS dr, wb - lag(wb) OVER w AS dw FROM r WINDOW w AS (PARTITION BY pid ORDER BY snap_ts))
        SELECT host, pid, epoch_us(snap_ts) AS ts, pinned, round(coalesce(100 * du / dt, 0), 9) AS user_pct, round(coalesce(100 * ds / dt, 0), 9) AS system_pct,
               round(coalesce(100 * du / dt, 0) + coalesce(100 * ds / dt, 0), 9) AS total_pct, round(coalesce(dr / dt, 0), 9) AS read_count_s, round(coalesce(dw / dt, 0), 9) AS write_bytes_s FROM l""",
    "top_n": f"""SELECT host, epoch_us(snap_ts) AS ts, name, memory, CAST(r AS INTEGER) AS rank FROM (SELECT host, snap_ts, name, CAST(sum(memory) AS BIGINT) AS memory, row_number() OVER (PARTITION BY host, snap_ts ORDER BY sum(memory) DESC, name) AS r
        FROM ({in_duck(PROCS)}) GROUP BY host, snap_ts, name) WHERE r <= 5""",
    "chunk_procs": f"""SELECT host, epoch_us(snap_ts) AS ts, CAST((n - 1) // 50 AS BIGINT) AS chunk, CAST(ceil(c / 50.0) AS BIGINT) AS group_size, count(*) AS n, min(pid) AS first_pid
        FROM (SELECT *, row_number() OVER (PARTITION BY host, snap_ts ORDER BY pid) AS n, count(*) OVER (PARTITION BY host, snap_ts) AS c FROM ({in_duck(PROCS)})) GROUP BY ALL""",
}
