"""Queries over metric, check and event lines and over flushes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flush
from ..sources import statsd
from .recipes import SAMPLES, SERIES, in_duck, in_spark, table

HOUR, DAY = 3600, 86400


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "event_type", "value")
    head = F.concat("event_type", F.lit(":"), F.col("value").cast("string"))
    return e.withColumn("payload", F.concat(head, F.lit("|g\r\n"), head, F.lit("|c|#src:events\n"))).select("host", "ts", "seq", "payload")


def _shape(series: DataFrame, *more: str) -> DataFrame:
    return series.select("host", F.col("window_end").cast("long").alias("ts"), "metric", "type", F.round("value", 9).alias("value"), *more)


def flush_gauge_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = statsd.parse_samples(statsd.split_datagrams(_lines(spark, sf_dir)))
    return _shape(flush.flush_simple(flush.prepare(samples, HOUR), HOUR))


def statsd_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("q"), F.max("l_returnflag").alias("f"))
    values = F.array_join(F.transform("q", lambda x: x["l_quantity"].cast("string")), ":")
    lines = rows.select("l_orderkey", F.concat(F.lit("o:"), values, F.lit("|h|@0.5|#flag:"), "f").alias("line"))
    s = statsd.parse_samples(lines)
    return s.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("sample_rate").alias("rate"), F.max(F.array_join("tags", ",")).alias("tag"))


def statsd_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat("text", F.lit("\nok:1|g\nbad|g\n_sc|c|1\n_sc|c|9\n_e{1,1}:t|x\n_e{0,1}:|x")).alias("payload"))
    marked = statsd.quarantine(statsd.split_datagrams(docs))
    return marked.groupBy("kind", "malformed").agg(F.count("*").alias("n"))


def service_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "0").when(F.col("o_orderstatus") == "O", "1").otherwise("2")
    line = F.concat(F.lit("_sc|"), "o_orderpriority", F.lit("|"), status, F.lit("|d:"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string"), F.lit("|h:h"), (F.col("o_custkey") % 9).cast("string"), F.lit("|#s:"), "o_orderstatus", F.lit("|m:a|b"))
    c = table(spark, sf_dir, "orders").select(statsd.parse_check(line).alias("c")).select("c.*")
    return c.groupBy("check", "host_name", "status", "message").agg(F.count("*").alias("n"), F.max("timestamp").alias("latest"))


def event_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.replace("text", F.lit("\n"), F.lit("\\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.substring(flat, 1, 20).alias("a"), F.substring(flat, 21, 1 << 30).alias("b"))
    line = F.concat(F.lit("_e{"), F.octet_length("a").cast("string"), F.lit(","), F.octet_length("b").cast("string"), F.lit("}:"), "a", F.lit("|"), "b", F.lit("|p:low|#lang:"), "lang")
    return d.select("doc_id", statsd.parse_event(line).alias("e")).select("doc_id", "e.msg_title", "e.msg_text", "e.priority", F.array_join("e.tags", ",").alias("tags"))


STAMPS = ["|d:100|d:x", "|d: 7 ", "|d:+5", "|d:9223372036854775808|k:z", "|d:-3|d:4|d:", "", "|d:1_0|p:low", "|d:100|d:200"]


def event_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with several times, and ones that are no whole numbers: the last that is one counts."""
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, STAMPS)), (F.col("event_id") % len(STAMPS) + 1).cast("int")).alias("rest"))
    return e.select("event_id", statsd.parse_event(F.concat(F.lit("_e{1,2}:t|xx"), "rest")).alias("e")).select("event_id", "e.timestamp", "e.aggregation_key", "e.priority")


def hist_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = in_spark(spark, sf_dir, SAMPLES).withColumn("type", F.lit("histogram"))
    return _shape(flush.flush_histogram(flush.prepare(s, DAY), DAY), F.array_join(F.array_sort("tags"), ",").alias("tags"))


def set_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = in_spark(spark, sf_dir, SAMPLES).withColumn("type", F.lit("set"))
    return _shape(flush.flush_set(flush.prepare(s, DAY)))


def flush_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = in_spark(spark, sf_dir, SAMPLES)
    beat = flush.finish(flush.heartbeat(s, DAY), DAY)
    rows = flush.union_sources(flush.flush_metrics(s, DAY, global_tags=["team:x"]), beat)
    return rows.select("metric", "type", "interval", F.array_join("tags", ",").alias("tags"), "host", "device", "ts", F.round("value", 9).alias("value"))


def flush_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families of a flush without the fields that are added last."""
    rows = flush.flush_metrics(in_spark(spark, sf_dir, SAMPLES), DAY)
    tags = F.when(F.col("device") == "", F.col("tags")).otherwise(F.array_append("tags", F.concat(F.lit("device:"), "device")))
    return rows.select("host", "ts", "metric", "type", F.round("value", 9).alias("value"), F.array_join(F.array_sort(tags), ",").alias("tags"))


def non_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = in_spark(spark, sf_dir, SAMPLES)
    odd = F.when(F.col("seq") % 5 == 0, F.lit(float("nan"))).when(F.col("seq") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    p = flush.prepare(s.withColumn("value", odd), DAY)
    return p.groupBy("type").agg(F.count("*").alias("n"))


def run_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flush.run_total(in_spark(spark, sf_dir, SERIES)).select("key", F.round("total", 6).alias("total"))


QUERIES = {f.__name__: f for f in (flush_gauge_counter, statsd_packed, statsd_routing, service_checks, event_bytes, event_stamps, hist_expand, set_distinct, flush_all, flush_series, non_finite, run_total)}

_S = in_duck(SAMPLES)
_P = f"SELECT *, CAST((floor(epoch(ts) / {DAY}) + 1) * {DAY} AS BIGINT) AS we, array_to_string(list_sort(tags), ',') AS tk FROM ({_S})"
_HIST = """
  {p}, v AS (SELECT host, we, name, type, tk, value, sum(1 / sample_rate) AS w FROM p GROUP BY ALL),
  c AS (SELECT *, sum(w) OVER (k ORDER BY value ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER k AS ww FROM v WINDOW k AS (PARTITION BY host, we, name, type, tk)),
  q AS (SELECT host, we, name, type, tk, max(ww) AS ww, sum(value * w) AS vw, max(value) AS mx, coalesce(min(value) FILTER (c > (ww - 1) / 2), max(value)) AS md, coalesce(min(value) FILTER (c > (95 * ww - 1) / 100), max(value)) AS p95 FROM c GROUP BY ALL),
  h AS (SELECT host, we, tk, name || x.s AS metric, x.k AS type, x.v AS value FROM (SELECT *, unnest([
    {{'s': '.count', 'k': 'rate', 'v': ww / {day}}}, {{'s': '.avg', 'k': 'gauge', 'v': vw / ww}}, {{'s': '.median', 'k': 'gauge', 'v': md}}, {{'s': '.max', 'k': 'gauge', 'v': mx}}, {{'s': '.95percentile', 'k': 'gauge', 'v': p95}}]) AS x FROM q))"""

ORACLES = {
    "flush_gauge_counter": f"""
        WITH e AS (SELECT 'h' || (user_id % 5) AS host, CAST((floor(epoch(ts) / {HOUR}) + 1) * {HOUR} AS BIGINT) AS w, * FROM events)
        SELECT host, w AS ts, event_type AS metric, 'gauge' AS type, round(arg_max(value, row(ts, event_id)), 9) AS value FROM e GROUP BY host, w, event_type
        UNION ALL SELECT host, w, event_type, 'rate', round(sum(value::DECIMAL(18, 2))::DOUBLE / {HOUR}, 9) FROM e GROUP BY host, w, event_type""",
    "statsd_packed": "SELECT l_orderkey, count(*) AS n, round(sum(l_quantity)::DOUBLE, 6) AS total, 0.5::DOUBLE AS rate, 'flag:' || max(l_returnflag) AS tag FROM lineitem GROUP BY 1",
    "statsd_routing": """
        WITH l AS (SELECT unnest(string_split(text, chr(10))) AS x FROM documents), n AS (SELECT count(*) AS n FROM documents)
        SELECT 'metric' AS kind, true AS malformed, (SELECT count(*) FROM l WHERE regexp_replace(x, '\\r+$', '') <> '') + n AS n FROM n
        UNION ALL SELECT k, m, n FROM n, (VALUES ('metric', false), ('check', false), ('check', true), ('event', false), ('event', true)) v(k, m)""",
    "service_checks": """
        SELECT o_orderpriority AS "check", 'h' || (o_custkey % 9) AS host_name, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INTEGER) AS status, 'a|b' AS message,
               count(*) AS n, CAST(max(epoch(o_orderdate)) AS BIGINT) AS latest FROM orders GROUP BY ALL""",
    "event_bytes": """
        SELECT doc_id, replace(substr(t, 1, 20), '\\n', chr(10)) AS msg_title, replace(substr(t, 21), '\\n', chr(10)) AS msg_text, 'low' AS priority, 'lang:' || lang AS tags
        FROM (SELECT *, replace(text, chr(10), '\\n') AS t FROM documents)""",
    "event_stamps": "SELECT event_id, CAST([100, 0, 5, 0, 4, 0, 0, 200][event_id % 8 + 1] AS BIGINT) AS timestamp, CASE WHEN event_id % 8 = 3 THEN 'z' ELSE '' END AS aggregation_key, CASE WHEN event_id % 8 = 6 THEN 'low' ELSE '' END AS priority FROM events",
    "hist_expand": "WITH p AS (SELECT * REPLACE ('histogram' AS type) FROM (" + _P + "))" + _HIST.format(p="", day=DAY) + " SELECT host, we AS ts, metric, type, round(value, 9) AS value, tk AS tags FROM h",
    "set_distinct": f"SELECT host, we AS ts, name AS metric, 'gauge' AS type, round(count(DISTINCT member)::DOUBLE, 6) AS value FROM ({_P}) GROUP BY host, we, name, tk",
    "flush_series": "WITH a AS (" + _P + "), p AS (SELECT * FROM a WHERE type = 'histogram')" + _HIST.format(p="", day=DAY) + f""",
        u AS (SELECT host, we, tk, metric, type, value FROM h
          UNION ALL SELECT host, we, tk, name, 'gauge', arg_max(value, row(ts, seq)) FROM a WHERE type = 'gauge' GROUP BY ALL
          UNION ALL SELECT host, we, tk, name, 'rate', sum(value / sample_rate) / {DAY} FROM a WHERE type = 'counter' GROUP BY ALL
          UNION ALL SELECT host, we, tk, name, 'gauge', count(DISTINCT member)::DOUBLE FROM a WHERE type = 'set' GROUP BY ALL)
        SELECT host, we AS ts, metric, type, round(value, 9) AS value, tk AS tags FROM u""",
    "flush_all": "WITH a AS (" + _P + "), p AS (SELECT * FROM a WHERE type = 'histogram')" + _HIST.format(p="", day=DAY) + f""",
        u AS (SELECT host, we, tk, metric, type, value FROM h
          UNION ALL SELECT host, we, tk, name, 'gauge', arg_max(value, row(ts, seq)) FROM a WHERE type = 'gauge' GROUP BY ALL
          UNION ALL SELECT host, we, tk, name, 'rate', sum(value / sample_rate) / {DAY} FROM a WHERE type = 'counter' GROUP BY ALL
          UNION ALL SELECT host, we, tk, name, 'gauge', count(DISTINCT member)::DOUBLE FROM a WHERE type = 'set' GROUP BY ALL)
        SELECT metric, type, CAST({DAY} AS BIGINT) AS "interval", 'env:prod,team:x' AS tags, host, regexp_extract(tk, 'device:([^,]*)', 1) AS device, we AS ts, round(value, 9) AS value FROM u
        UNION ALL SELECT DISTINCT 'agent.running', 'gauge', {DAY}, 'version:1', host, '', we, 1.0::DOUBLE FROM a""",
    "non_finite": "SELECT type, count(*) AS n FROM (" + _S + ") WHERE type = 'set' OR seq % 5 > 1 GROUP BY type",
    "run_total": "WITH s AS (" + in_duck(SERIES) + """) SELECT metric || '{' || tags[1] || '}' AS key, round(CASE WHEN bool_or(type = 'rate') THEN sum(value * "interval") ELSE arg_max(value, ts) END, 6) AS total FROM s GROUP BY metric, tags""",
}
