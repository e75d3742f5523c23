import datetime as dt

from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions.patterns import replacement, to_java
from pulsegrid.operators import counters, flush, hosts, logs, recon, sinks
from pulsegrid.sources import snapshots, statsd
from pulsegrid.sources.journal import parse_journal


def lines(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "line string")


def test_metric_lines(spark):
    got = statsd.parse_samples(lines(spark, "page.views:42|g", "hits:1|c|#env:prod,team:x", "hits:7|c|@0.5", "users:a:b|s", "m:1|g|#a|c:abc123|T1700000000", "m:1:2:3|h|@0.5|#a")).collect()
    assert [(r.name, r.type, r.value, r.member, r.tags, r.sample_rate) for r in got] == [
        ("page.views", "gauge", 42, None, [], 1), ("hits", "counter", 1, None, ["env:prod", "team:x"], 1), ("hits", "counter", 7, None, [], 0.5), ("users", "set", None, "a:b", [], 1), ("m", "gauge", 1, None, ["a"], 1),
        *[("m", "histogram", v, None, ["a"], 0.5) for v in (1, 2, 3)]]


def test_malformed_lines_never_fail(spark):
    bad = ["m:1", "m|g", ":1|g", "m:abc|g", "m:1:x:3|h", "m:1|x", "", "m:1e400|g", "m:1d|g", "m: 1|g", "_sc|c|9", "_sc|c", "_e{x,5}:a|b", "_e{50,5}:hi|there", "_e{0,3}:|abc"]
    assert all(r.malformed for r in statsd.quarantine(lines(spark, *bad)).collect())


def test_checks_and_events(spark):
    c = lines(spark, "_sc|app.up|2|d:100|h:web1|#env:prod,role:api|m:it is down", "_sc|c|1|m:a|b").select(statsd.parse_check(F.col("line")).alias("c")).select("c.*").collect()
    assert (c[0].status, c[0].timestamp, c[0].host_name, c[0].message, c[1].message) == (2, 100, "web1", "it is down", "a|b")
    e = lines(spark, "_e{3,4}:dep|done|d:200|h:h1|p:low|t:success|s:my|k:agg|#a:b", "_e{1,6}:t|a\\nb c", "_e{1,3}:t|a|b").select(statsd.parse_event(F.col("line")).alias("e")).select("e.*").collect()
    assert (e[0].msg_title, e[0].msg_text, e[0].timestamp, e[0].host, e[0].priority, e[0].alert_type, e[0].source_type_name, e[0].aggregation_key, e[0].tags) == ("dep", "done", 200, "h1", "low", "success", "my", "agg", ["a:b"])
    assert (e[1].msg_text, e[2].msg_text) == ("a\nb c", "a|b")


def samples(spark, *rows):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("h", t, k, "m", kind, float(v) if kind != "set" else None, str(v), tags, rate) for k, (kind, v, tags, rate) in enumerate(rows)], "host string, ts timestamp, seq long, name string, type string, value double, member string, tags array<string>, sample_rate double")


def flushed(spark, *rows):
    return {r.metric: r.value for r in flush.flush_metrics(samples(spark, *rows)).collect()}


def test_flush(spark):
    assert flushed(spark, ("gauge", 1, ["a:1", "b:2"], 1.0), ("gauge", 7, ["b:2", "a:1"], 1.0)) == {"m": 7}
    assert flushed(spark, ("counter", 30, [], 1.0), ("counter", 30, [], 1.0)) == {"m": 4}
    h = flushed(spark, *[("histogram", v, [], 1.0) for v in range(1, 11)])
    assert (h["m.count"] * 15, h["m.avg"], h["m.median"], h["m.max"], h["m.95percentile"]) == (10, 5.5, 5, 10, 10)
    h = flushed(spark, ("histogram", 1, [], 0.5), ("histogram", 4, [], 1.0))
    assert (h["m.count"] * 15, h["m.avg"], h["m.median"], h["m.95percentile"]) == (3, 2, 1, 4)
    assert flushed(spark, *[("set", v, [], 1.0) for v in ("alice", "bob", "alice", "carol")]) == {"m": 3}
    assert flushed(spark, ("gauge", float("nan"), [], 1.0), ("gauge", float("inf"), [], 1.0), ("counter", float("-inf"), [], 1.0), ("histogram", 1, [], 1e-323), ("distribution", 1, [], 1.0)) == {}


def test_cpu_and_disk(spark):
    t = [dt.datetime(2024, 1, 1, 0, 0, s) for s in (0, 10)]
    cpu = spark.createDataFrame([("h", t[0], *[0.0] * 9), ("h", t[1], 100.0, 0.0, 50.0, 800.0, 20.0, 0.0, 10.0, 20.0, 0.0)], "host string, ts timestamp, " + ", ".join(f"{c} double" for c in counters.CPU))
    r = counters.cpu_pct(cpu).first()
    assert (r.user_pct, r.system_pct, r.iowait_pct, r.idle_pct, r.stolen_pct) == (10, 6, 2, 80, 2)
    cols = ["reads", "reads_merged", "sectors_read", "ms_reading", "writes", "writes_merged", "sectors_written", "ms_writing", "skip", "ms_io", "weighted_ms_io"]
    rows = ["1000 0 4000 100 2000 0 8000 200 0 500 700", "1100 0 4400 140 2200 0 9000 260 0 1500 1700"]
    disk = spark.createDataFrame([("h", "vda", w, *map(float, x.split())) for w, x in zip(t, rows)], "host string, device string, ts timestamp, " + ", ".join(f"{c} double" for c in cols))
    got = {r.metric: round(r.value, 9) for r in counters.disk_io_rates(disk).collect()}
    want = {"r_s": 10, "w_s": 20, "rkb_s": 20, "wkb_s": 50, "util": 10, "avg_q_sz": 0.1, "await": 1 / 3, "r_await": 0.4, "w_await": 0.3, "avg_rq_sz": 14 / 3}
    assert {k: got[k] for k in want} == {k: round(v, 9) for k, v in want.items()}


def test_rules_keep_their_order(spark):
    df = spark.createDataFrame([("password=x DEBUG",), ("fine",)], "message string")
    mask, drop = logs.Rule("mask_sequences", r"DEBUG", "***"), logs.Rule("exclude_at_match", "DEBUG")
    assert logs.apply_rules(df, [mask, drop]).count() == 2
    assert logs.apply_rules(df, [drop, mask, logs.Rule("exclude_at_match", "(")]).count() == 1
    assert to_java(r"a(?=b)") is None and to_java("c$").endswith(r"\z")
    assert replacement("<$name>\\", r"(?P<name>x)") == "<${name}>\\\\"


def test_multiline(spark):
    rows = [("s", 10, None, "2024 a"), ("s", 20, None, " b"), ("s", 30, None, " c 2024"), ("s", 40, None, "2024 d")]
    df = spark.createDataFrame(rows, "source_id string, offset long, ts timestamp, line string")
    got = sorted((r.offset, r.message) for r in logs.assemble_multiline(df, r"\d{4}").collect())
    assert got == [(30, "2024 a\n b\n c 2024"), (40, "2024 d")]
    got = sorted((r.offset, r.message) for r in logs.assemble_multiline(df, r"\d{4}", cap=8).collect())
    assert got == [(20, "2024 a\n b"), (30, " c 2024"), (40, "2024 d")]


def test_journal(spark):
    e = parse_journal(lines(spark, '{"MESSAGE":[104,105],"__CURSOR":"c1","PRIORITY":"3","_COMM":"x"}', "bad")).collect()
    assert len(e) == 1 and e[0].fields["MESSAGE"] == "hi" and e[0].cursor == "c1"
    got = logs.process_journal(lines(spark, '{"MESSAGE":"m","PRIORITY":"3","_COMM":"x"}')).first()
    assert (got.status, got.service, got.message) == ("error", "x", '{"journald":{"PRIORITY":"3","_COMM":"x"},"message":"m"}')


def test_resume_and_advance(spark):
    ls = spark.createDataFrame([("a", 0, 6, "1"), ("a", 0, 12, "2"), ("b", 0, 5, "x"), ("c", 1, 4, "n")], "source_id string, generation int, offset long, line string")
    reg = spark.createDataFrame([("a", 0, 6), ("c", 0, 90)], "source_id string, generation int, offset long")
    assert sorted(r.line for r in logs.resume(ls, reg).collect()) == ["2", "n"]
    moved = {r.source_id: (r.generation, r.offset) for r in logs.advance(reg, ls).collect()}
    assert moved == {"a": (0, 12), "b": (0, 5), "c": (1, 4)}


def test_hosts(spark):
    kv = snapshots.kv_snapshot(spark.createDataFrame([("h", "MemTotal: 2048 kB\nMemFree: 512 kB\nMemAvailable: 1024 kB\ntcr: 0x00072400\neeprom: 8086 0100\n")], "host string, content string")).withColumn("ts", F.lit(0))
    got = {r.metric: r.value for r in hosts.mem_gauges(kv).collect()}
    assert (got["total"], got["free"], got["used"], got["usable"], got["pct_usable"], "swap_pct_free" in got) == (2, 0.5, 1.5, 1, 0.5, False)
    assert kv.count() == 3
    m = spark.createDataFrame([("h", 0, "sda", 4096, 1000, 400, 300, 100, 60)], "host string, ts int, device string, bsize long, blocks long, bfree long, bavail long, files long, ffree long")
    got = {r.metric: r.value for r in hosts.fs_gauges(m).collect()}
    assert (got["total"], got["used"], got["free"], round(got["in_use"], 9), got["inodes.used"], got["inodes.in_use"]) == (4000, 2400, 1200, round(2 / 3, 9), 40, 0.4)
    p = spark.createDataFrame([("a", 100), ("b", 50), ("a", 25), ("c", 200)], "name string, memory long").withColumn("host", F.lit("h"))
    assert [(r.name, r.memory) for r in hosts.top_n_memory(p, ["host"], 2).orderBy("rank").collect()] == [("c", 200), ("a", 125)]


def test_columns(spark):
    df = lines(spark, "My\\040Disk").select(C.unescape_octal(F.col("line")).alias("a"), C.unescape_octal(F.lit("trailing\\04")).alias("b"), C.unescape_octal(F.lit("\\134040")).alias("c"), C.same_tags(F.lit("b,a,a"), F.lit("a,b")).alias("d"))
    assert tuple(df.first()) == ("My Disk", "trailing\\04", "\\040", True)


def test_pack_and_compare(spark):
    ls = spark.createDataFrame([("s", k, "x" * n, "info", 0, "h", "", "", "") for k, n in enumerate([4, 4, 20, 1, 1, 1])], "source_id string, offset long, message string, status string, timestamp long, hostname string, service string, ddsource string, ddtags string")
    assert [r.rows for r in sinks.pack_logs(ls, max_rows=2, max_bytes=10).orderBy("batch").collect()] == [2, 1, 2, 1]
    s = spark.createDataFrame([("a", "gauge", 1, ["t"], "h", "", 1, 1.0), ("r", "rate", 15, [], "h", "", 1, 1.0), ("r", "rate", 15, [], "h", "", 2, 1.0)], "metric string, type string, interval long, tags array<string>, host string, device string, ts long, value double")
    assert {r.key: r.total for r in flush.run_total(s).collect()} == {"a{t}": 1, "r{}": 30}
    assert {r.verdict for r in recon.compare_series(s, s).collect()} == {"ok"}
    assert {r.key: r.verdict for r in recon.compare_series(s, s.filter("metric = 'a'")).collect()} == {"a{t}": "ok", "rate r{}": "fail"}
    assert [r.there for r in recon.presence(s, {"has a": F.col("metric") == "a", "has z": F.col("metric") == "z"}).collect()] == [True, False]


def test_stream_equals_batch(spark, tmp_path):
    from pulsegrid.streaming.jobs import stream_metrics

    t0 = dt.datetime(2024, 1, 1)
    rows = [("h", t0 + dt.timedelta(seconds=k), k, f"m.{kind}", kind, float(k % 7), str(k % 5), ["a"], 0.5) for k in range(60) for kind in ("gauge", "counter", "histogram", "set")]
    late = [("h", t0 + dt.timedelta(hours=1), 999, "end", "gauge", 1.0, "x", [], 1.0)]
    schema = "host string, ts timestamp, seq long, name string, type string, value double, member string, tags array<string>, sample_rate double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(late, schema).write.mode("append").parquet(str(tmp_path / "in"))
    out = stream_metrics(spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in")), 15, "1 second")
    q = out.writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: {(r.metric, r.ts): round(r.value, 9) for r in d.collect()}
    got = key(spark.table("flushed").withColumn("ts", F.col("window_end")).filter("metric <> 'end'"))
    assert got == key(flush.flush_metrics(spark.createDataFrame(rows, schema)))


def test_cuts_inside_a_character(spark):
    """Byte lengths and cuts that split a character, and byte arrays that aren't text, never fail a job."""
    e = lines(spark, "_e{1,3}:\u00e9|a", "_e{1,1}:t|\u00e9", "_e{2,2}:\u00e9|\u00e9").select(statsd.parse_event(F.col("line")).alias("e")).select("e.*").collect()
    assert [(r.msg_title, r.msg_text) for r in e] == [(None, None), ("t", "\ufffd"), ("\u00e9", "\u00e9")]
    assert lines(spark, "x" * 44 + "\u00e9" * 5).select(C.truncate_text(F.col("line"))).first()[0] == "x" * 44 + "\ufffd..."
    assert parse_journal(lines(spark, '{"MESSAGE":[255,104]}')).first().fields["MESSAGE"] == "\ufffdh"
