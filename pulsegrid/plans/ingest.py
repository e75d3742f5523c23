"""Queries over files that Spark writes out of the given tables and reads back: log lines, recordings, payloads, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sinks
from ..sources import files
from .recipes import PROCS, in_duck, in_spark, scratch, table

CAP = 500


def _written_lines(spark: SparkSession, sf_dir: str) -> str:
    """One log file for each source of the documents, lines by document and place."""
    out = scratch(spark) + "/lines"
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines.repartition("source").sortWithinPartitions("source", "doc_id", "pos").select("source", F.concat("line", F.when(F.col("pos") % 3 == 1, "\r").otherwise("")).alias("line")).write.partitionBy("source").text(out)
    return out


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.read_log_lines(spark, _written_lines(spark, sf_dir) + "/*/*")
    return rows.select(F.regexp_extract("source_id", "source=([^/]*)/", 1).alias("source"), "offset", "line")


def log_lines_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that end in the middle of a line: it is held back, but given for files that were rotated away."""
    out = scratch(spark) + "/open"
    table(spark, sf_dir, "documents").filter("text is not null").repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").option("lineSep", "|").text(out)
    rows = lambda rotated: files.read_log_lines(spark, out + "/*/*", keep_blank=True, rotated=rotated).select(F.lit(rotated).alias("rotated"), F.regexp_extract("source_id", "source=([^/]*)/", 1).alias("source"), "offset", "line")
    return rows(False).unionByName(rows(True))


def capped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts cut to pieces: they join to the text, by its digest, none is too long, and there are as many as the cuts. The
    text itself does not travel with its pieces."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), F.col("text").alias("line"))
    pieces = files.cap_lines(d, CAP).groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("piece", "line"))).alias("ps"), F.max(F.octet_length("line")).alias("longest"), F.count("*").alias("n"))
    return pieces.select("doc_id", (F.sha2(F.array_join(F.transform("ps", lambda p: p["line"]), ""), 256) == F.col("digest")).alias("whole"), (F.col("longest") <= CAP).alias("fits"), "n")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording of process and upload records, written as JSON lines and read back."""
    out = scratch(spark) + "/records"
    o = table(spark, sf_dir, "orders")
    odd = F.col("o_orderkey") % 2 == 0
    o.select(F.when(odd, "process").otherwise("profile").alias("kind"), F.col("o_orderkey").alias("pos"), F.when(odd, F.col("o_custkey") % 3).cast("int").alias("proc_encoding"), F.when(odd, F.array("o_orderpriority", "o_orderstatus")).alias("proc_names"), F.when(~odd, F.col("o_orderstatus")).alias("prof_family"), F.when(~odd, F.col("o_custkey") > 50).alias("prof_api_key"), F.lit("x").alias("unknown")).write.json(out)
    return files.read_records(spark, out).select("kind", "pos", F.col("proc_encoding").cast("string").alias("proc_encoding"), F.array_join("proc_names", ",").alias("proc_names"), "prof_family", F.col("prof_api_key").cast("string").alias("prof_api_key"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of all kinds made out of tables, and broken ones, to record rows."""
    path = lambda d, p, *body: d.select(F.lit(p).alias("path"), F.lit("k1").alias("api_key"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in body]).alias("body"))
    n, r, s = (table(spark, sf_dir, x) for x in ("nation", "region", "supplier"))
    k, c = F.col("n_nationkey"), F.col("s_suppkey")
    part = table(spark, sf_dir, "part")
    series = path(part, "/api/series", '{"series":[{"metric":"m', F.col("p_partkey"), '","type":"gauge","interval":15,"tags":["a:1"],"host":"h","points":[[1,2],[2,', F.col("p_size"), ']]},{"metric":"none","points":[]},{"metric":"odd","points":[[7]]}]}')
    logs = path(n, "/api/logs", '[{"message":"at ', k, '","status":"info","ddsource":"app","hostname":"h"},{"message":"two"}]')
    checks = path(n, "/api/check_run", '[{"check":"c', k, '","status":', k % 4, ',"host_name":"h"}]')
    events = path(n, "/intake/", '{"apiKey":"', F.when(k % 2 == 0, "k2").otherwise(""), '","events":{"api":[{"msg_title":"t', k, '"},{"msg_title":"u"}],"x":[{"msg_title":"v"}]}}')
    meta = path(s, "/intake/", '{"apiKey":"k2","os":"linux","systemStats":{"platform":"', F.when(c % 3 > 0, "linux").otherwise(""), '","cpuCores":2},"meta":{"hostname":"h', c, '"},"host-tags":{"system":["a:1"]},"gohai":"', F.when(c % 2 == 0, F.concat(F.lit('{\\"cpu\\":{\\"cpu_cores\\":'), c % 4, F.lit('},\\"memory\\":{\\"total\\":'), c, F.lit("}}"))).otherwise(""), '"}')
    inventory = path(s, "/api/metadata", '{"host_metadata":{"os":"o', c, '","cpu_cores":4,"memory_total_kb":', c, '},"agent_metadata":{"agent_version":"7","flavor":"f"}}')
    out = series
    for d in (logs, checks, events, meta, inventory, path(r, "/api/series", "{broken"), path(r, "/elsewhere", "{}")):
        out = out.unionByName(d)
    rows = files.normalize_payloads(out)
    name = F.coalesce("metric", "message", "check", "title", F.try_element_at("attrs", F.lit("hostname")), F.try_element_at("attrs", F.lit("os")), F.try_element_at("attrs", F.lit("flavor")))
    number = F.coalesce("value", F.col("check_status").cast("double"), F.try_element_at("nums", F.lit("mem_total")), F.try_element_at("nums", F.lit("memory_total_kb")), F.try_element_at("nums", F.lit("cpu_cores")))
    return rows.select("kind", "api_key", name.alias("name"), number.alias("number"), F.try_element_at("nums", F.lit("cpu_cores")).alias("cores"), "host", F.array_join("tags", ",").alias("tags"))


def uploads_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    event = F.concat(F.lit('{"family":"'), "o_orderstatus", F.lit('","version":"4","attachments":["cpu.pprof","'), F.col("o_custkey") % 7, F.lit('.pprof"],"tags_profiler":"host:h,pri:'), "o_orderpriority", F.lit('"}'))
    return files.profile_uploads(o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 1, "{broken").otherwise(event).alias("event"))).withColumn("tags", F.array_join("tags", "|"))


def proc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.proc_stat_projection(in_spark(spark, sf_dir, PROCS)).drop("snap_ts")


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of orders by priority, delivered to three destinations of which one fails: rows at each, and the audit."""
    out = scratch(spark) + "/"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")

    def write(name: str):
        return lambda batch, k: batch.write.mode("append").parquet(f"{out}{name}")

    def refuse(batch: DataFrame, k: int) -> None:
        raise RuntimeError(f"refused {k}")

    deliver = sinks.fan_out(write("main"), {"second": write("second"), "third": refuse}, lambda a: a.write.mode("append").parquet(f"{out}audit"))
    for k in range(1, 6):
        deliver(orders.filter(F.col("o_orderpriority").startswith(str(k))), k)
    rows = lambda name: spark.read.parquet(f"{out}{name}").groupBy(F.lit(name).alias("destination"), F.col("o_orderpriority").alias("what")).agg(F.count("*").alias("n"))
    audit = spark.read.parquet(f"{out}audit").select("destination", F.col("error").alias("what"), F.col("batch_id").alias("n"))
    return rows("main").unionByName(rows("second")).unionByName(audit)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named sources of series: two usable ones of different columns, one without a value and one that can't be planned."""
    registry = sinks.Sources()
    registry.register("nations", lambda s: table(s, sf_dir, "nation").select(F.col("n_name").alias("metric"), F.col("n_nationkey").cast("double").alias("value")))
    registry.register("parts", lambda s: table(s, sf_dir, "part").select(F.col("p_partkey").cast("double").alias("value"), F.lit("part").alias("metric"), F.lit("h").alias("host")))
    registry.register("bare", lambda s: table(s, sf_dir, "region").select(F.lit("x").alias("metric")))
    registry.register("none", lambda s: table(s, sf_dir, "no such table"))
    rows, failed = registry.collect(spark)
    told = spark.createDataFrame([(n,) for n in failed], "metric string").withColumns({"value": F.lit(None).cast("double"), "host": F.lit("failed")})
    return rows.unionByName(told)


def _pull(target: dict):
    """A source for the query below: nations whose key is divisible by five fail, after their first row."""
    yield "nation.key", target["n_nationkey"], [f"name:{target['n_name']}"]
    if target["n_nationkey"] % 5 == 0:
        raise RuntimeError(f"refused {target['n_nationkey']}")
    yield "nation.region", target["n_regionkey"], []


def sources_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that SQL reads from a table of targets."""
    sinks.register_source(spark, "pull_nations", _pull, ["n_nationkey", "n_name"])
    rows = spark.sql("SELECT * FROM pull_nations(TABLE(SELECT * FROM {targets}))", targets=table(spark, sf_dir, "nation"))
    return rows.select("source", "metric", "value", F.array_join("tags", ",").alias("tags"), "error")


QUERIES = {f.__name__: f for f in (log_lines, log_lines_open, capped_lines, records, payloads, uploads_read, proc_stats, fan_out, sources, sources_sql)}

ORACLES = {
    "sources_sql": """SELECT 'pull_nations' AS source, 'nation.key' AS metric, n_nationkey::DOUBLE AS value, 'name:' || n_name AS tags, NULL AS error FROM nation
        UNION ALL SELECT 'pull_nations', 'nation.region', n_regionkey, '', NULL FROM nation WHERE n_nationkey % 5 > 0 UNION ALL SELECT 'pull_nations', NULL, NULL, NULL, 'RuntimeError: refused ' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0""",
    "log_lines": r"""
        WITH l AS (SELECT source, doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
        o AS (SELECT source, line, CAST(sum(strlen(line) + 1 + CASE WHEN pos % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "offset" FROM l)
        SELECT source, "offset", regexp_replace(line, '\r+$', '') AS line FROM o WHERE regexp_replace(line, '\r+$', '') <> ''""",
    "log_lines_open": r"""
        WITH f AS (SELECT source, string_agg(text, '|' ORDER BY doc_id) || '|' AS t FROM documents WHERE text IS NOT NULL GROUP BY source),
        l AS (SELECT source, strlen(t) AS whole, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT *, string_split(t, chr(10)) AS ls FROM f)),
        o AS (SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY source ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM l)
        SELECT rotated, source, CAST(least(e, whole) AS BIGINT) AS "offset", CASE WHEN e > whole THEN line ELSE regexp_replace(line, '\r+$', '') END AS line FROM o, (VALUES (false), (true)) r(rotated) WHERE rotated OR e <= whole OR strlen(line) > 262144""",
    "capped_lines": f"SELECT doc_id, true AS whole, true AS fits, CAST(CASE WHEN strlen(text) > {CAP} THEN ceil(strlen(text) / {CAP - 3}.0) ELSE 1 END AS BIGINT) AS n FROM documents WHERE text IS NOT NULL",
    "records": """SELECT CASE WHEN e THEN 'process' ELSE 'profile' END AS kind, o_orderkey AS pos, CASE WHEN e THEN CAST(o_custkey % 3 AS VARCHAR) END AS proc_encoding, CASE WHEN e THEN o_orderpriority || ',' || o_orderstatus END AS proc_names,
        CASE WHEN NOT e THEN o_orderstatus END AS prof_family, CASE WHEN NOT e THEN CASE WHEN o_custkey > 50 THEN 'true' ELSE 'false' END END AS prof_api_key FROM (SELECT *, o_orderkey % 2 = 0 AS e FROM orders)""",
    "payloads": """
        SELECT 'series' AS kind, 'k1' AS api_key, 'm' || p_partkey AS name, p_size::DOUBLE AS number, NULL::DOUBLE AS cores, 'h' AS host, 'a:1' AS tags FROM part
        UNION ALL SELECT 'series', 'k1', m, 0, NULL, NULL, NULL FROM part, (VALUES ('none'), ('odd')) v(m)
        UNION ALL SELECT 'log', 'k1', 'at ' || n_nationkey, NULL, NULL, 'h', NULL FROM nation UNION ALL SELECT 'log', 'k1', 'two', NULL, NULL, NULL, NULL FROM nation
        UNION ALL SELECT 'check', 'k1', 'c' || n_nationkey, n_nationkey % 4, NULL, 'h', NULL FROM nation
        UNION ALL SELECT 'event', CASE WHEN n_nationkey % 2 = 0 THEN 'k2' ELSE 'k1' END, unnest(['t' || n_nationkey, 'u', 'v']), NULL, NULL, NULL, NULL FROM nation
        UNION ALL SELECT 'meta', 'k2', 'h' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 2 END, CASE WHEN s_suppkey % 4 = 2 THEN 2 ELSE 2 END, NULL, 'a:1' FROM supplier WHERE s_suppkey % 3 > 0 OR s_suppkey % 2 = 0
        UNION ALL SELECT 'inv_host', 'k1', 'o' || s_suppkey, s_suppkey, 4, NULL, NULL FROM supplier UNION ALL SELECT 'inv_agent', 'k1', 'f', NULL, NULL, NULL, NULL FROM supplier""",
    "uploads_read": """SELECT o_orderkey, CASE WHEN ok THEN o_orderstatus END AS family, CASE WHEN ok THEN '4' END AS version, attachment, CASE WHEN ok THEN 'host:h|pri:' || o_orderpriority END AS tags
        FROM (SELECT *, o_orderkey % 10 <> 1 AS ok, unnest(CASE WHEN o_orderkey % 10 <> 1 THEN ['cpu.pprof', (o_custkey % 7) || '.pprof'] ELSE [NULL] END) AS attachment FROM orders)""",
    "fan_out": """SELECT d AS destination, o_orderpriority AS what, count(*) AS n FROM orders, (VALUES ('main'), ('second')) v(d) GROUP BY ALL
        UNION ALL SELECT 'third', 'refused ' || k, k FROM range(1, 6) t(k)""",
    "sources": """SELECT n_name AS metric, n_nationkey::DOUBLE AS value, NULL::VARCHAR AS host FROM nation UNION ALL SELECT 'part', p_partkey::DOUBLE, 'h' FROM part UNION ALL SELECT m, NULL, 'failed' FROM (VALUES ('bare'), ('none')) v(m)""",
    "proc_stats": f"SELECT host, pid, create_time, user_time, system_time, read_count, write_count, read_bytes, write_bytes FROM ({in_duck(PROCS)})",
}
