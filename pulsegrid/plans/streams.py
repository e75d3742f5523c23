"""Streaming queries: files of the given tables read as streams until all is taken in, in several small batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flush, sinks
from ..operators.logs import Rule
from ..sources import statsd
from ..streaming import jobs
from .logs import MAIL
from .logs import ORACLES as LOG_SQL
from .metrics import ORACLES as METRIC_SQL
from .rates import ORACLES as RATE_SQL
from .rates import running_totals
from .recipes import COUNTERS, PROCS, SAMPLES, in_spark, scratch, table

DAY, HELD = 86400, 3


def _as_stream(df: DataFrame, folder: str, *order: str, last: Sequence[DataFrame] = ()) -> Iterator[DataFrame]:
    """Write a table as files, HELD ranges of `order`, one after the other, then those of `last`, and give a stream of them after
    each: what is run on it then takes one range as a batch. Each range is written by many tasks."""
    spark = df.sparkSession
    each = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // HELD)
    part = F.least(F.floor(F.spark_partition_id() / each), F.lit(HELD - 1))
    df.repartitionByRange(HELD * each, *order).withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/parts")
    parts = spark.read.schema(df.withColumn("part", F.lit(0)).schema).parquet(f"{folder}/parts")
    for rows in (*(parts.filter(F.col("part") == k).drop("part") for k in range(HELD)), *last):
        rows.select(df.columns).write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(df.schema).parquet(f"{folder}/in")


def _drained(job: Callable[[DataFrame], DataFrame], df: DataFrame, folder: str, *order: str, last: Sequence[DataFrame] = ()) -> DataFrame:
    """What `job` writes for the ranges of `df`, run on one after the other with one checkpoint."""
    for stream in _as_stream(df, folder, *order, last=last):
        made = jobs.drain(job(stream), folder)
    return made


def stream_metrics_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flush on a stream; later samples, left out of the result, close the last windows."""
    out = scratch(spark)
    s = in_spark(spark, sf_dir, SAMPLES)
    late = lambda days: s.filter("seq = 1").limit(1).withColumns({"ts": F.to_timestamp(F.lit(f"2100-01-{days}")), "name": F.lit("end"), "type": F.lit("gauge")})
    rows = _drained(lambda x: jobs.stream_metrics(x, DAY, "0 seconds"), s, out, "ts", "seq", last=[late(10), late(20), late(30)]).filter("metric <> 'end'")
    return rows.select("host", F.col("window_end").alias("ts"), "metric", "type", F.round("value", 9).alias("value"), F.array_join(F.array_sort("tags"), ",").alias("tags"))


def _closing(s: DataFrame) -> list[DataFrame]:
    """Samples, named `end`, so late that they close all windows."""
    return [s.filter("seq = 1").limit(1).withColumns({"ts": F.to_timestamp(F.lit(f"2100-01-{days}")), "name": F.lit("end"), "type": F.lit("gauge")}) for days in (10, 20, 30)]


def stream_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flush on a stream with global tags, intervals and devices."""
    out, s = scratch(spark), in_spark(spark, sf_dir, SAMPLES)
    rows = _drained(lambda x: jobs.stream_series(x, DAY, "0 seconds", global_tags=["team:x"]), s, out, "ts", "seq", last=_closing(s)).filter("metric <> 'end'")
    return rows.select("metric", "type", "interval", F.array_join("tags", ",").alias("tags"), "host", "device", "ts", F.round("value", 9).alias("value"))


def stream_metrics_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flush with bounded state beside the exact one: are quantiles within 1 %, distinct counts within five standard errors,
    all others equal?"""
    out, s = scratch(spark), in_spark(spark, sf_dir, SAMPLES)
    s = s.withColumn("name", F.when(F.col("type") == "set", F.concat("name", F.lit("_members"))).otherwise(F.col("name")))
    near = _drained(lambda x: jobs.stream_series(x, DAY, "0 seconds", relative_error=0.01), s, out, "ts", "seq", last=_closing(s)).filter("metric <> 'end'")
    keys = ["host", "ts", "metric", "type", "device"]
    exact = flush.flush_metrics(s, DAY).select(*keys, F.col("value").alias("exact"))
    off = F.abs(F.col("value") - F.col("exact"))
    bound = F.when(F.col("metric").rlike("median|95percentile"), 0.01 * F.abs("exact") + 1e-9).when(F.col("metric").endswith("_members"), F.abs("exact") * 5 * 1.04 / 2 ** (jobs.REGISTERS / 2)).otherwise(1e-9 * (1 + F.abs("exact")))
    return exact.join(near.select(*keys, "value"), keys, "full_outer").select(*keys, F.coalesce(off <= bound, F.lit(False)).alias("close"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a stream, of which some are malformed and the last ones are too late: what its batches counted."""
    out, e = scratch(spark), table(spark, sf_dir, "events")
    k = F.col("event_id")
    line = F.when(k % 7 == 0, F.concat(F.lit("odd line "), k)).when(k % 7 == 1, F.concat(F.lit("_sc|x|"), k + 9)).otherwise(F.concat(F.lit("m."), F.col("event_type"), F.lit(":"), k, F.lit("|c")))
    rows = e.select(F.concat(F.lit("h"), F.col("user_id") % 5).alias("host"), F.col("ts").cast("timestamp").alias("ts"), k.alias("seq"), line.alias("line"))
    end = rows.limit(1).withColumns({"ts": F.to_timestamp(F.lit("2100-01-10")), "line": F.lit("end:1|g")})
    late = table(spark, sf_dir, "nation").select(F.lit("h0").alias("host"), F.to_timestamp(F.lit("1999-01-01")).alias("ts"), F.col("n_nationkey").cast("long").alias("seq"), F.concat(F.lit("late"), "n_nationkey", F.lit(":1|c")).alias("line"))
    kinds = {kind: (F.col("kind") == kind) & F.col("malformed") for kind in ("metric", "check", "event")}
    counts = jobs.BatchCounts()
    spark.streams.addListener(counts)
    try:
        runs = []
        for stream in _as_stream(rows, out, "ts", "seq", last=[end, late]):
            lines = jobs.counted(statsd.quarantine(stream), "lines", **kinds).filter("not malformed and kind = 'metric'").drop("kind", "malformed")
            runs.append(str(jobs.run_all(jobs.stream_metrics(statsd.parse_samples(lines), DAY, "0 seconds"), out).runId))
        until = time.time() + 60
        while not counts.ended.issuperset(runs) and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counts)
    got = counts.table(spark).filter(F.col("run").isin(runs))
    of = lambda name: F.sum(F.coalesce(F.try_element_at("counts", F.lit(f"lines.{name}")), F.lit(0))).alias(name)
    return got.agg(F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"), of("rows"), of("metric"), of("check"), of("event"))


def stream_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows delivered by a query that stops once between sending and noting a batch, and once between noting and committing
    one: none is lost or doubled, and the ledger has the furthest place of each source."""
    out = scratch(spark)
    rules = [Rule("mask_sequences", MAIL, "[mail]"), Rule("exclude_at_match", "^[A-C]")]
    faults = {(0, "sent"), (1, "noted")}
    replace = sinks.replace_batch(f"{out}/sent")

    def stop(batch_id: int, when: str) -> None:
        if (batch_id, when) in faults:
            faults.remove((batch_id, when))
            raise RuntimeError(f"stopped when batch {batch_id} was {when}")

    def send(batch: DataFrame, batch_id: int) -> None:
        replace(batch, batch_id)
        stop(batch_id, "sent")

    once = sinks.deliver_once(f"{out}/ledger", send)

    def whole(batch: DataFrame, batch_id: int) -> None:
        once(batch, batch_id)
        stop(batch_id, "noted")

    for stream in _as_stream(_lines(spark, sf_dir), out, "offset", "source_id"):
        logs = jobs.stream_logs(stream, rules, "web", "app", host="h1", tags=["env:prod"], global_tags=["team:x"])
        for _ in range(3):
            try:
                jobs.deliver(logs, out, whole)
                break
            except StreamingQueryException:
                continue
    far = sinks.registry_of(spark, f"{out}/ledger").select(F.col("source_id").cast("long").alias("source_id"), F.col("offset").alias("far"))
    rows = spark.read.parquet(f"{out}/sent").select("source_id", "offset", "message", "status", "hostname", "service", "ddsource", "ddtags")
    return rows.join(far, "source_id", "left")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return d.select("source_id", F.col("pos").cast("long").alias("offset"), F.lit(None).cast("timestamp").alias("ts"), "line")


def stream_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of documents' lines by batches of offsets, and a last start line for each source that closes them."""
    out = scratch(spark)
    lines = _lines(spark, sf_dir)
    ends = lines.groupBy("source_id").agg(F.lit(10**9).cast("long").alias("offset"), F.lit(None).cast("timestamp").alias("ts"), F.lit("A").alias("line"))
    made = _drained(lambda x: jobs.stream_multiline(x, "[A-M]", 3_600_000), lines.unionByName(ends), out, "offset", "source_id")
    return made.select("source_id", "offset", "message")


def stream_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on a stream, with assembly."""
    out = scratch(spark)
    lines = _lines(spark, sf_dir)
    ends = lines.groupBy("source_id").agg(F.lit(10**9).cast("long").alias("offset"), F.lit(None).cast("timestamp").alias("ts"), F.lit("A").alias("line"))
    rules = [Rule("multi_line", "[A-M]"), Rule("mask_sequences", MAIL, "[mail]"), Rule("exclude_at_match", "^[A-C]")]
    made = _drained(lambda x: jobs.stream_logs(x, rules, "web", "app", 3_600_000), lines.unionByName(ends), out, "offset", "source_id")
    return made.select("source_id", "offset", "message", "status", "service", "ddsource")


def stream_counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disk counters on a stream whose batches end inside a snapshot."""
    out = scratch(spark)
    c = in_spark(spark, sf_dir, COUNTERS).select("host", "device", "ts", "reads", "writes")
    made = _drained(lambda x: jobs.stream_counter_rate(x, "device", "ts", ["reads", "writes"]), c, out, "ts", "device")
    return made.select("host", "device", F.unix_micros("ts").alias("ts"), "counter", F.round("rate", 9).alias("rate"))


def stream_proc_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark)
    made = _drained(jobs.stream_proc_rates, running_totals(in_spark(spark, sf_dir, PROCS)), out, "snap_ts", "pid")
    return made.select("host", "pid", F.unix_micros("snap_ts").alias("ts"), "pinned", *[F.round(c, 9).alias(c) for c in ("user_pct", "system_pct", "total_pct", "read_count_s", "write_bytes_s")])


QUERIES = {f.__name__: f for f in (stream_metrics_eq, stream_series, stream_metrics_sketch, stream_counts, stream_delivery, stream_multiline, stream_logs, stream_counter_rates, stream_proc_rates)}

ORACLES = {
    "stream_metrics_eq": METRIC_SQL["flush_series"],
    "stream_series": METRIC_SQL["flush_all"].split("UNION ALL SELECT DISTINCT 'agent.running'")[0],
    "stream_metrics_sketch": "SELECT host, ts, metric, type, device, true AS close FROM (" + METRIC_SQL["flush_all"].split("UNION ALL SELECT DISTINCT 'agent.running'")[0].replace("tk, name, 'gauge', count", "tk, name || '_members', 'gauge', count") + ")",
    "stream_counts": "SELECT (count(*) + 26)::BIGINT AS input_rows, 25::BIGINT AS late_rows, (count(*) + 26)::BIGINT AS rows, count(*) FILTER (event_id % 7 = 0) AS metric, count(*) FILTER (event_id % 7 = 1) AS \"check\", 0::BIGINT AS event FROM events",
    "stream_delivery": f"""
        WITH l AS (SELECT doc_id AS source_id, CAST(unnest(range(len(ls))) AS BIGINT) AS "offset", unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
        m AS (SELECT source_id, "offset", regexp_replace(line, '{MAIL}', '[mail]', 'g') AS message FROM l)
        SELECT source_id, "offset", message, 'info' AS status, 'h1' AS hostname, 'web' AS service, 'app' AS ddsource, 'env:prod,team:x' AS ddtags, max("offset") OVER (PARTITION BY source_id) AS far FROM m WHERE NOT regexp_matches(message, '^[A-C]')""",
    "stream_multiline": LOG_SQL["multiline_docs"],
    "stream_logs": "SELECT source_id, \"offset\", message, status, service, ddsource FROM (" + LOG_SQL["process_logs"] + ")",
    "stream_counter_rates": RATE_SQL["reads_writes"],
    "stream_proc_rates": "SELECT * REPLACE (CAST(pid AS BIGINT) AS pid) FROM (" + RATE_SQL["proc_rates"] + ")",
}
