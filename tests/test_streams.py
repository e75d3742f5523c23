"""State of streams: it shrinks when hosts and processes are gone, and timers close idle messages."""

import time
from datetime import datetime, timedelta

from pulsegrid.streaming import jobs

ZERO = datetime(2024, 1, 1)


def started(stream, folder, name):
    conf = stream.sparkSession.conf
    was = conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    try:
        return stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(processingTime="1 second").start()
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", was)


def fed(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def waits(query, ok, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not ok():
        assert query.exception() is None
        time.sleep(0.5)
    return ok()


def test_state_shrinks_when_processes_and_hosts_are_gone(spark, tmp_path):
    schema = "host string, pid int, snap_ts timestamp, create_time long, user_time double, system_time double, read_count double, write_count double, read_bytes double, write_bytes double"
    row = lambda h, p, t: (h, p, ZERO + timedelta(seconds=t), 10**12, float(t), 0.0, 2.0 * t, 0.0, 0.0, 0.0)
    fed(spark, [row(h, p, 0) for h in ("a", "b") for p in range(50)], schema, tmp_path)
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = started(jobs.stream_proc_rates(stream, gone_ms=30_000), tmp_path, "procs_gone")
    try:
        held = lambda: (query.lastProgress or {"stateOperators": [{"numRowsTotal": 0}]})["stateOperators"][0]["numRowsTotal"]
        count = lambda where="true": spark.sql(f"SELECT count(*) FROM procs_gone WHERE {where}").first()[0]
        assert waits(query, lambda: count() == 100)
        first = held()
        for t in (10, 20, 30):  # host b and all but one process of a are gone
            fed(spark, [row("a", 0, t)], schema, tmp_path)
            assert waits(query, lambda: count("host = 'a' AND pid = 0") == t // 10 + 1)
        assert {(r.user_pct, r.read_count_s) for r in spark.sql("SELECT * FROM procs_gone WHERE snap_ts > '2024-01-01'").collect()} == {(100.0, 2.0)}
        assert waits(query, lambda: held() < first, 120), (first, held())
        fed(spark, [row("b", 1, 40)], schema, tmp_path)  # a host that has expired begins anew
        assert waits(query, lambda: count("host = 'b' AND user_pct = 0 AND snap_ts > '2024-01-01'") == 1)
    finally:
        query.stop()


def test_an_idle_source_s_message_is_closed_by_the_clock(spark, tmp_path):
    schema = "source_id string, offset long, ts timestamp, line string"
    fed(spark, [("s", 1, None, "A one"), ("s", 2, None, "two"), ("s", 3, None, "A three"), ("t", 1, None, None)], schema, tmp_path)
    query = started(jobs.stream_multiline(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "A", 3000), tmp_path, "idle")
    try:
        got = lambda: {(r.source_id, r.offset, r.message) for r in spark.sql("SELECT * FROM idle").collect()}
        assert waits(query, lambda: ("s", 2, "A one\ntwo") in got())
        assert waits(query, lambda: got() == {("s", 2, "A one\ntwo"), ("s", 3, "A three"), ("t", 1, "")})
    finally:
        query.stop()


def test_counter_rates_of_a_snapshot_in_parts(spark, tmp_path):
    schema = "host string, dev string, ts timestamp, n double"
    at = lambda t: ZERO + timedelta(seconds=t)
    batches = [[("h", "a", at(0), 1.0), ("h", "b", at(0), 5.0)], [("h", "a", at(10), 21.0)], [("h", "b", at(10), 4.0), ("h", "c", at(10), 9.0), ("h", "a", at(5), 99.0)], [("h", "a", at(30), 61.0), ("h", "c", at(20), 10.0), ("h", "b", at(30), None), ("g", "a", at(0), 1.0)]]
    for b in batches:
        fed(spark, b, schema, tmp_path)
        time.sleep(1.1)  # files are read in the order of their times
    for policy, want in (("skip", {("a", 10, 2.0), ("c", 20, 0.1)}), ("clamp", {("a", 10, 2.0), ("b", 10, 0.0), ("c", 20, 0.1)})):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = jobs.drain(jobs.stream_counter_rate(stream, "dev", "ts", ["n"], policy), f"{tmp_path}/{policy}")
        assert {(r.dev, (r.ts - ZERO).seconds, r.rate) for r in out.collect()} == want


def test_bounded_state_keeps_its_error_bounds(spark, tmp_path):
    """One hot context with 40,000 distinct values and members: quantiles within 1 %, members within five standard errors, few state rows."""
    from pyspark.sql import functions as F

    from pulsegrid.operators import flush

    n = 40_000
    base = spark.range(n).selectExpr("'h' AS host", "timestamp_seconds(1704067200 + id % 15) AS ts", "id AS seq", "array('env:x') AS tags", "cast(1.0 / (1 + id % 3) AS double) AS sample_rate")
    v = F.pow(F.lit(1.0003), "seq") * F.when(F.col("seq") % 2 == 0, -1.0).otherwise(1.0)
    s = base.select("host", "ts", "seq", F.lit("lat").alias("name"), F.lit("histogram").alias("type"), v.alias("value"), F.lit(None).cast("string").alias("member"), "tags", "sample_rate")
    s = s.unionByName(s.withColumns({"name": F.lit("users"), "type": F.lit("set"), "member": F.concat(F.lit("u"), F.col("seq") % 30_000)}))
    end = s.limit(1).withColumns({"ts": F.to_timestamp(F.lit("2100-01-01")), "name": F.lit("end"), "type": F.lit("gauge")})
    s.coalesce(1).write.parquet(f"{tmp_path}/in")
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    time.sleep(1)
    end.withColumn("ts", F.to_timestamp(F.lit("2100-02-01"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = jobs.run_all(jobs.stream_series(stream, 15, "0 seconds", "h", ["team:x"], relative_error=0.01), str(tmp_path))
    rows = max(p["stateOperators"][k]["numRowsTotal"] for p in query.recentProgress for k in range(len(p["stateOperators"])))
    assert rows < 3_000  # the exact form holds 70,000
    got = {r.metric: r for r in spark.read.parquet(f"{tmp_path}/out").filter("metric <> 'end'").collect()}
    exact = {r.metric: r.value for r in flush.flush_metrics(s, 15).collect()}
    assert got.keys() == exact.keys() and got["lat.avg"].tags == ["env:x", "team:x"] and got["users"].interval == 15
    for k in ("lat.median", "lat.95percentile"):
        assert abs(got[k].value - exact[k]) <= 0.01 * abs(exact[k])
    for k in ("lat.count", "lat.avg", "lat.max"):
        assert abs(got[k].value - exact[k]) <= 1e-9 * (1 + abs(exact[k]))
    assert abs(got["users"].value - 30_000) <= 30_000 * 5 * 1.04 / 2**6
