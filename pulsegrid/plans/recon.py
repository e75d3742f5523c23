"""Queries that reconcile two recordings, and packing of payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import recon, sinks
from .recipes import SERIES, in_duck, in_spark, table

MAX_ROWS, MAX_BYTES = 7, 6000
#: Metric to (relative, absolute) tolerance; part.77 is not there.
TOLERANCES = {"part.1": (0.5, 0.0), "part.2": (0.05, 0.0), "part.3": (0.0, 10.0), "part.4": (0.0, 0.5), "part.8": (0.0, 0.0), "part.77": (0.0, 1.0)}
LOGS = """
  SELECT concat('order ', CASE WHEN o_custkey % 60 = {gap} THEN 1000 + {gap} ELSE o_custkey % 60 END) AS message, o_orderkey AS pos, 'app' AS source, concat('s', o_custkey % 3) AS service, CASE WHEN o_orderkey % {k} = 0 THEN 'warn' ELSE 'info' END AS status,
         CASE WHEN o_orderkey % 2 = 0 THEN 'a:1,b:2' ELSE 'b:2,a:1,a:1' END AS ddtags
  FROM {orders}"""
OURS, OTHERS = LOGS.replace("{k}", "5").replace("{gap}", "7"), LOGS.replace("{k}", "1000003").replace("{gap}", "8")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One side as it is; the other with part.4 shifted, part.5 of another type and part.9 under another name."""
    s = in_spark(spark, sf_dir, SERIES)
    shifted = F.when(F.col("metric") == "part.4", F.col("value") + 1).otherwise(F.col("value"))
    kind = F.when(F.col("metric") == "part.5", "gauge").otherwise(F.col("type"))
    name = F.when(F.col("metric") == "part.9", "part.99").otherwise(F.col("metric"))
    return s, s.withColumns({"value": shifted, "type": kind, "metric": name})


def compare_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, other = _sides(spark, sf_dir)
    return recon.compare_series(ours, other, "part.").select("key", "verdict")


def compare_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.compare_logs(in_spark(spark, sf_dir, OURS), in_spark(spark, sf_dir, OTHERS)).select("key", "verdict")


def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, other = _sides(spark, sf_dir)
    return recon.subset_check(ours, other)


def tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, other = _sides(spark, sf_dir)
    return recon.tolerance_check(ours, other, TOLERANCES).select("key", "verdict")


def _facts(spark: SparkSession, sf_dir: str, other: bool) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    attrs = F.create_map(F.lit("os"), F.when((k % 6 == 0) & F.lit(other), "x").otherwise(F.col("c_mktsegment")), F.lit("name"), F.col("c_name"))
    nums = F.create_map(F.lit("memory"), k * F.when(k % 2 == 0, 1.02).otherwise(1.2 if other else 1.0))
    tags = F.when((k % 7 == 0) & F.lit(other), F.array(F.lit("b:2"))).otherwise(F.array(F.lit("a:1"), F.lit("b:2")))
    return c.select(F.concat(F.when(k % 10 == (3 if other else 4), f"only{other:d}").otherwise("h"), k).alias("host"), attrs.alias("attrs"), nums.alias("nums"), tags.alias("tags"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.compare_facts(_facts(spark, sf_dir, False), _facts(spark, sf_dir, True), ["os"], {"memory": 0.05, "none": 0.05}, "a:1", ["name"]).select("key", "verdict")


#: Process and upload records: lists of the priorities that a customer's orders show; one host sends none on the other
#: side, another's can't be read there, a third's are all empty here.
PROCESSES = """
  SELECT 'process' AS kind, o_custkey AS pos, concat(CASE WHEN {other} AND o_custkey % 40 = 7 THEN 'g' ELSE 'h' END, o_custkey % 40) AS host,
         CASE WHEN o_custkey % 3 = 0 OR {other} AND o_custkey % 40 = 5 THEN 2 ELSE 0 END AS proc_encoding,
         CASE WHEN NOT {other} AND o_custkey % 40 = 9 THEN 0 ELSE count(DISTINCT CASE WHEN {other} AND o_custkey % 40 > 20 AND o_orderpriority > '4' THEN '1' ELSE o_orderpriority END) END AS proc_count, min(o_orderpriority) AS one
  FROM {orders} GROUP BY o_custkey"""
UPLOADS = """
  SELECT 'profile' AS kind, CASE WHEN {other} THEN -o_orderkey ELSE o_orderkey END AS pos, concat(CASE WHEN {other} AND o_custkey % 50 = 7 THEN 'g' ELSE 'h' END, o_custkey % 50) AS host,
         CASE WHEN {other} AND o_custkey % 50 % 11 = 1 THEN 'proxy' ELSE 'trace-agent 7' END AS prof_via, NOT ({other} AND o_custkey % 50 % 13 = 2) AS prof_api_key,
         CASE WHEN o_custkey % 50 % 9 = 3 THEN 'env:p' WHEN {other} AND o_custkey % 50 % 17 = 4 THEN 'env:p,host:x' ELSE 'host:y,env:p' END AS prof_add_tags, o_orderstatus AS prof_family, {array}o_orderpriority, o_orderstatus] AS prof_attach
  FROM {orders}"""


def _side(sql: str, other: bool) -> str:
    return sql.replace("{other}", str(other).lower())


def _processes(spark: SparkSession, sf_dir: str, other: bool) -> DataFrame:
    return in_spark(spark, sf_dir, _side(PROCESSES, other)).withColumn("proc_names", F.array("one"))


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recon.compare_processes(_processes(spark, sf_dir, False), _processes(spark, sf_dir, True), by="host").withColumn("platform", F.lit(""))
    bare = _processes(spark, sf_dir, True).filter("host = 'none'")
    for platform in ("", "darwin"):
        rows = rows.unionByName(recon.compare_processes(_processes(spark, sf_dir, False), bare, platform=platform).withColumn("platform", F.lit(platform)))
    return rows.select("platform", "key", "verdict")


def process_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names, and the first two by host."""
    p = _processes(spark, sf_dir, False)
    few = p.groupBy("host").agg(recon.sample_names(F.collect_set("one"), 2).alias("two"))
    return recon.process_names(p).select(F.lit("").alias("host"), "name").unionByName(few.select("host", F.explode("two").alias("name")))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.compare_uploads(*(in_spark(spark, sf_dir, _side(UPLOADS, x)) for x in (False, True)), by="host").select("key", "verdict")


def _recording(spark: SparkSession, sf_dir: str, other: bool) -> DataFrame:
    """A recording of all kinds: its series and logs as in the other queries, checks by status, events, hosts, lists, uploads."""
    series = _sides(spark, sf_dir)[other].select(F.lit("series").alias("kind"), F.col("ts").alias("pos"), "metric", "type", "value", "interval", "tags", "host", "device")
    logs = in_spark(spark, sf_dir, OTHERS if other else OURS).withColumn("kind", F.lit("log"))
    checks = table(spark, sf_dir, "orders").select(F.lit("check").alias("kind"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("order."), "o_orderstatus").alias("check"))
    events = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("pos"), F.col("event_type").alias("title"))
    c = table(spark, sf_dir, "customer")
    mem = F.create_map(F.lit("cpu_cores"), F.lit(4.0), F.lit("memory_total_kb"), F.col("c_custkey") * (100.0 + other))
    host = c.select(F.explode(F.array(F.lit("meta"), F.lit("inv_host"))).alias("kind"), F.col("c_custkey").alias("pos"), F.create_map(F.lit("platform"), "c_mktsegment", F.lit("hostname"), "c_name", F.lit("os"), F.lit(f"os{other:d}")).alias("attrs"), mem.alias("nums"), F.array(F.lit("test:a")).alias("tags"))
    out = series
    for d in (logs, checks, events, host, _processes(spark, sf_dir, other).drop("one", "host"), in_spark(spark, sf_dir, _side(UPLOADS, other)).drop("host")):
        out = out.unionByName(d, allowMissingColumns=True)
    return out.withColumn("api_key", F.when(F.col("kind") == "event", F.lit(None)).when(F.col("kind") == "meta", "k2").otherwise("k1"))


def parity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys of each section agree, and whether all do."""
    rows = recon.parity_report(_recording(spark, sf_dir, False), _recording(spark, sf_dir, True), "part.", "order.F", "", "part.", "", TOLERANCES, "test:a")
    count = rows.groupBy("section", "verdict").agg(F.count("*").alias("n"))
    return count.unionByName(recon.passes(rows).select(F.lit("all").alias("section"), F.when(F.col("pass"), "ok").otherwise("fail").alias("verdict"), F.lit(1).cast("long").alias("n")))


def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _recording(spark, sf_dir, False)
    sets = {
        "met": {"series": ["part.1", "part.2"], "meta": True, "min_procs": 3, "proc_name": "1-URGENT", "log": "order 5", "host": "h", "profile": True, "profile_attach": "nothing", "check": "order.F", "event": "click"},
        "not met": {"series": ["part.1", "none"], "platform": "none", "min_procs": 99, "proc_name": "none", "log": "disorder", "host": "none", "api_key": "k1", "profile_family": "none", "check": "order.X", "event": "nothing"},
        "key": {"api_key": "k1"}, "none": {},
    }
    out = None
    for name, asked in sets.items():
        part = recon.verify(r.filter("kind <> 'meta' AND kind <> 'event'") if name == "key" else r, **asked).select(F.lit(name).alias("asked"), "key", "verdict")
        out = part if out is None else out.unionByName(part)
    return out


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders")
    return recon.presence(r, {"has F": F.col("o_orderstatus") == "F", "has X": F.col("o_orderstatus") == "X", "dear": F.col("o_totalprice") > 1000, "urgent": F.col("o_orderpriority").contains("URGENT"), "before 1970": F.col("o_orderdate") < "1970-01-01"})


def first_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("pos"), "o_custkey")
    return recon.first_of_kind(o, "F").unionByName(recon.first_of_kind(o, "O")).unionByName(recon.first_of_kind(o, "none"))


def pack_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = in_spark(spark, sf_dir, SERIES).withColumns({"source_type_name": F.lit(""), "ts": F.col("ts") % 20})
    p = sinks.pack_series(s.withColumn("value", F.when(F.col("n") == 2, F.lit(float("nan"))).otherwise(F.col("value"))), 100)
    back = F.from_json("body", "series array<struct<metric string, points array<array<double>>, tags array<string>, host string, type string, `interval` bigint, device string>>")["series"]
    total = F.aggregate(back, F.lit(0.0), lambda a, x: a + F.get(F.get(x["points"], F.lit(0)), F.lit(1)))
    first = F.get(back, F.lit(0))
    return p.select("ts", "payload", "rows", F.size(back).alias("series"), F.round(F.sum(total).over(Window.partitionBy("ts")), 6).alias("total"), F.concat_ws("|", first["metric"], first["type"], first["host"], F.coalesce(first["device"], F.lit("none"))).alias("first"))


def pack_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null").select((F.col("doc_id") % 50).alias("source_id"), F.col("doc_id").alias("offset"), F.col("text").alias("message"), *[F.lit(c).alias(c) for c in ("status", "timestamp", "hostname", "service", "ddsource", "ddtags")])
    return sinks.pack_logs(d, max_rows=MAX_ROWS, max_bytes=MAX_BYTES).select("source_id", "batch", "rows", "bytes", F.json_array_length("body").cast("long").alias("items"), F.md5(F.get_json_object("body", "$[0].message")).alias("first"))


def pack_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("check"), (F.col("o_custkey") % 50).cast("string").alias("host_name"), F.col("o_orderkey").alias("timestamp"), F.lit(0).alias("status"), F.lit("m").alias("message"), F.array().cast("array<string>").alias("tags"))
    return sinks.pack_checks(c, max_rows=200).select("host_name", "payload", "rows", F.get_json_object("body", "$[0].check").alias("first"))


def pack_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("host"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("source_type_name"), F.col("event_id").alias("timestamp"), F.col("event_type").alias("msg_title"), *[F.lit("x").alias(c) for c in ("msg_text", "priority", "alert_type", "aggregation_key")], F.array(F.lit("a:b")).alias("tags"))
    where = table(spark, sf_dir, "region").select(F.concat(F.lit("https://"), F.col("r_regionkey") % 3).alias("url"), F.when(F.col("r_regionkey") == 4, " ").otherwise(F.concat(F.lit("k"), F.col("r_regionkey") % 2)).alias("key"))
    to = sinks.destinations(where.filter("url = 'https://1' and key = 'k1'"), where)
    out = sinks.pack_events(e, to.select("url", "key", "pos"), 300)
    n = F.json_array_length(F.get_json_object("body", "$.events.api"))
    return out.select("host", "payload", "url", F.get_json_object("body", "$.apiKey").alias("key"), F.coalesce(n, F.lit(0)).cast("long").alias("n_api"), F.get_json_object("body", "$.internalHostname").alias("name"))


def pack_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole payloads of checks and events, empty fields left out."""
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(F.when(k % 9 > 0, F.col("o_orderpriority")).otherwise("").alias("check"), (F.col("o_custkey") % 7).cast("string").alias("host_name"), (k * 100).alias("timestamp"), (k % 4).cast("int").alias("status"), F.when(k % 3 == 0, F.concat(F.lit('say "'), k, F.lit('"'))).when(k % 3 == 1, "").alias("message"), F.when(k % 2 == 0, F.array(F.lit("a:b"), F.lit("c"))).alias("tags"))
    checks = sinks.pack_checks(c, max_rows=3).select(F.concat(F.lit("checks "), "host_name").alias("of"), "payload", "body")
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("host"), F.when(e % 4 > 0, F.col("event_type")).otherwise("").alias("source_type_name"), (e * 50 - 50).alias("timestamp"), F.col("event_type").alias("msg_title"), F.lit("x").alias("msg_text"), F.when(e % 3 == 0, "low").otherwise("").alias("priority"), F.lit("").alias("alert_type"), F.when(e % 5 == 0, F.concat(F.lit("g"), e)).alias("aggregation_key"), F.when(e % 2 == 0, F.array(F.lit("a:b"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    to = table(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.concat(F.lit("u"), "r_regionkey").alias("url"), F.concat(F.lit("k"), "r_regionkey").alias("key"))
    return checks.unionByName(sinks.pack_events(rows, to, 4).select(F.concat_ws(" ", F.lit("events"), "host", "url").alias("of"), "payload", "body"))


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("u"), "n_regionkey").alias("url"), F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.concat(F.lit("k"), F.col("n_nationkey") % 2)).alias("key"))
    return sinks.destinations(n.filter("url = 'u3' and key = 'k1'"), n)


def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), "o_totalprice")
    codes = F.array(*[F.lit(c) for c in (200, 202, 400, 403, 413, 429, 500)])
    done, dead, again = sinks.dead_letter(o, o.select("batch_id", F.get(codes, (F.col("batch_id") % 7).cast("int")).alias("http_status")))
    tag = lambda d, n: d.groupBy("http_status").agg(F.count("*").alias("n")).withColumn("fate", F.lit(n))
    return tag(done, "delivered").unionByName(tag(dead, "dead")).unionByName(tag(again, "retry"))


QUERIES = {f.__name__: f for f in (compare_series, compare_logs, subset, tolerance, facts, processes, process_names, uploads, parity_report, verify, presence, first_of_kind, pack_series, pack_logs, pack_checks, pack_events, pack_bodies, destinations, dead_letter)}

_A = in_duck(SERIES)
_B = "SELECT * REPLACE (CASE metric WHEN 'part.4' THEN value + 1 ELSE value END AS value, CASE metric WHEN 'part.5' THEN 'gauge' ELSE type END AS type, CASE metric WHEN 'part.9' THEN 'part.99' ELSE metric END AS metric) FROM (" + _A + ")"
_TOTAL = "SELECT metric || '{{' || tags[1] || '}}' AS key, type = 'rate' AS is_sum, CASE WHEN type = 'rate' THEN sum(value * \"interval\") ELSE arg_max(value, ts) END AS total FROM ({}) GROUP BY metric, tags, type"
_SERIES_SQL = f"""SELECT CASE WHEN is_sum THEN 'rate ' ELSE '' END || key AS key, CASE WHEN a.total IS NULL OR b.total IS NULL THEN 'fail' WHEN is_sum OR abs(a.total - b.total) <= 1e-6 * greatest(1, abs(b.total)) THEN 'ok' ELSE 'fail' END AS verdict FROM ({_TOTAL.format(_A)}) a FULL JOIN ({_TOTAL.format(_B)}) b USING (key, is_sum)"""
_LAST = "SELECT message, arg_max({{'source': source, 'service': service, 'status': status}}, pos) AS r FROM ({}) GROUP BY message"
_LOGS_SQL = f"SELECT message AS key, CASE WHEN a.r IS NULL OR b.r IS NULL OR a.r <> b.r THEN 'fail' ELSE 'ok' END AS verdict FROM ({_LAST.format(in_duck(OURS))}) a FULL JOIN ({_LAST.format(in_duck(OTHERS))}) b USING (message)"
_TYPES = "SELECT metric, arg_max(type, ts) AS t FROM ({}) GROUP BY metric"


def _subset(ours: str) -> str:
    return f"SELECT 'subset' AS section, metric AS key, CASE WHEN a.t IS NULL THEN 'note' WHEN a.t = b.t THEN 'ok' ELSE 'fail' END AS verdict, a.t AS ours, b.t AS other FROM ({_TYPES.format(ours)}) a FULL JOIN ({_TYPES.format(_B)}) b USING (metric)"


_NAMES = ", ".join(f"('{k}', {r}::DOUBLE, {a}::DOUBLE)" for k, (r, a) in TOLERANCES.items())
_NEAR = f"""SELECT metric AS key, CASE WHEN x IS NULL OR y IS NULL THEN 'note' WHEN abs(x - y) <= CASE WHEN r > 0 THEN r * abs(y) ELSE t END THEN 'ok' ELSE 'fail' END AS verdict
  FROM (VALUES {_NAMES}) v(metric, r, t) LEFT JOIN (SELECT metric, arg_max(value, ts) AS x FROM ({_A}) GROUP BY metric) USING (metric) LEFT JOIN (SELECT metric, arg_max(value, ts) AS y FROM ({_B}) GROUP BY metric) USING (metric)"""
_LISTS = "SELECT host, true AS sent, bool_or(proc_encoding = 0) AS decoded, coalesce(max(proc_count) FILTER (proc_encoding = 0), 0) AS n FROM ({}) GROUP BY host"
_P, _Q = (in_duck(_side(PROCESSES, x)) for x in (False, True))
_U, _V = (f"SELECT host, arg_min({{'via': prof_via, 'key': prof_api_key, 'tags': prof_add_tags, 'att': prof_attach}}, pos) AS r FROM ({in_duck(_side(UPLOADS, x))}) GROUP BY host" for x in (False, True))
_ONE = "SELECT true AS sent, bool_or(proc_encoding = 0) AS decoded, coalesce(max(proc_count) FILTER (proc_encoding = 0), 0) AS n FROM ({})"
_UP = "SELECT arg_min({{'via': prof_via, 'key': prof_api_key, 'tags': prof_add_tags, 'att': prof_attach}}, pos) AS r FROM ({})"
_HOST = "CASE WHEN r IS NULL THEN NULL ELSE coalesce(list_extract(list_filter(string_split(r.tags, ','), lambda t: starts_with(t, 'host:')), 1), '') END"
_UPLOAD_ROWS = f"""SELECT host, unnest([{{'n': 'forwarded by both', 'v': CASE WHEN x AND y THEN 'ok' ELSE 'fail' END}},
           {{'n': 'via', 'v': CASE WHEN x AND y THEN CASE WHEN starts_with(a.via, 'trace-agent ') AND starts_with(b.via, 'trace-agent ') THEN 'ok' ELSE 'fail' END END}},
           {{'n': 'api key', 'v': CASE WHEN x AND y THEN CASE WHEN a.key AND b.key THEN 'ok' ELSE 'fail' END END}},
           {{'n': 'host tag', 'v': CASE WHEN x AND y THEN CASE WHEN ha <> '' AND ha = hb THEN 'ok' ELSE 'fail' END END}},
           {{'n': 'attachments', 'v': CASE WHEN x AND y THEN CASE WHEN list_has_any(a.att, b.att) THEN 'ok' ELSE 'fail' END END}},
           {{'n': 'family', 'v': CASE WHEN x AND y THEN 'note' END}}]) AS z FROM (SELECT host, p.r AS a, q.r AS b, p.r IS NOT NULL AS x, q.r IS NOT NULL AS y, p.h AS ha, q.h AS hb FROM p FULL JOIN q USING (host))"""
ORACLES = {
    "compare_series": _SERIES_SQL,
    "compare_logs": _LOGS_SQL,
    "subset": _subset(_A),
    "tolerance": _NEAR,
    "facts": """WITH c AS (SELECT *, c_custkey % 10 IN (3, 4) AS alone FROM customer)
        SELECT 'h' || c_custkey || '/' || f AS key, CASE WHEN f = 'name' THEN 'note' WHEN f = 'os' AND c_custkey % 6 = 0 THEN 'fail' WHEN f = 'memory' AND c_custkey % 2 = 1 THEN 'fail' WHEN f = 'tag a:1' AND c_custkey % 7 = 0 THEN 'fail' ELSE 'ok' END AS verdict
        FROM c, (VALUES ('os'), ('memory'), ('none'), ('name'), ('tag a:1'), ('sent by both')) v(f) WHERE NOT alone
        UNION ALL SELECT s || c_custkey || '/sent by both', 'fail' FROM c, (VALUES ('h', 3, 4), ('h', 4, 3), ('only1', 3, 3), ('only0', 4, 4)) v(s, m, _) WHERE alone AND c_custkey % 10 = m""",
    "processes": f"""WITH a AS ({_LISTS.format(_P)}), b AS ({_LISTS.format(_Q)}), j AS (SELECT host, coalesce(a.sent, false) AS x, coalesce(b.sent, false) AS y, coalesce(a.decoded, false) AS dx, coalesce(b.decoded, false) AS dy, a.n AS n, b.n AS m FROM a FULL JOIN b USING (host)),
        r AS (SELECT host, unnest([{{'n': 'sent by both', 'v': CASE WHEN x AND y THEN 'ok' ELSE 'fail' END}}, {{'n': 'list decodes', 'v': CASE WHEN x AND y AND dx THEN CASE WHEN n > 0 THEN 'ok' ELSE 'fail' END END}},
               {{'n': 'count', 'v': CASE WHEN x AND y THEN CASE WHEN NOT dy THEN 'note' WHEN dx THEN CASE WHEN abs(n - m) <= 0.25 * greatest(1, m) THEN 'ok' ELSE 'fail' END END END}}]) AS z FROM j)
        SELECT '' AS platform, host || '/' || z.n AS key, z.v AS verdict FROM r WHERE z.v IS NOT NULL
        UNION ALL SELECT '', 'sent by both', 'fail' UNION ALL SELECT 'darwin', 'sent by both', 'note' UNION ALL SELECT 'darwin', 'list decodes', 'ok'""",
    "process_names": f"""SELECT DISTINCT '' AS host, one AS name FROM ({_P}) WHERE proc_encoding = 0
        UNION ALL SELECT host, one FROM (SELECT DISTINCT host, one FROM ({_P})) QUALIFY row_number() OVER (PARTITION BY host ORDER BY one) <= 2""",
    "uploads": f"WITH p AS (SELECT *, {_HOST} AS h FROM ({_U})), q AS (SELECT *, {_HOST} AS h FROM ({_V})), z AS ({_UPLOAD_ROWS}) SELECT host || '/' || z.n AS key, z.v AS verdict FROM z WHERE z.v IS NOT NULL",
    "parity_report": f"""WITH p AS (SELECT '' AS host, *, {_HOST} AS h FROM ({_UP.format(in_duck(_side(UPLOADS, False)))})), q AS (SELECT '' AS host, *, {_HOST} AS h FROM ({_UP.format(in_duck(_side(UPLOADS, True)))})), z AS ({_UPLOAD_ROWS}),
        l AS (SELECT a.n AS n, a.decoded AS dx, b.n AS m, b.decoded AS dy FROM ({_ONE.format(_P)}) a, ({_ONE.format(_Q)}) b),
        v AS (SELECT 'series' AS section, verdict FROM ({_SERIES_SQL}) UNION ALL SELECT section, verdict FROM ({_subset(_A)}) UNION ALL SELECT 'logs', verdict FROM ({_LOGS_SQL}) UNION ALL SELECT 'tolerance', verdict FROM ({_NEAR})
          UNION ALL SELECT 'presence', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'fail' END FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'presence', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'fail' END FROM events UNION ALL SELECT 'presence', 'fail'
          UNION ALL SELECT 'facts', x FROM (VALUES ('ok'), ('ok'), ('ok'), ('note'), ('ok'), ('ok'), ('fail'), ('ok'), ('ok'), ('ok'), ('ok')) t(x)
          UNION ALL SELECT 'processes', 'ok' UNION ALL SELECT 'processes', CASE WHEN n > 0 THEN 'ok' ELSE 'fail' END FROM l WHERE dx UNION ALL SELECT 'processes', CASE WHEN NOT dy THEN 'note' WHEN abs(n - m) <= 0.25 * greatest(1, m) THEN 'ok' ELSE 'fail' END FROM l WHERE dx OR NOT dy
          UNION ALL SELECT 'uploads', z.v FROM z WHERE z.v IS NOT NULL)
        SELECT section, verdict, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'all', CASE WHEN bool_and(verdict <> 'fail') THEN 'ok' ELSE 'fail' END, 1::BIGINT FROM v""",
    "verify": f"""WITH l AS ({_ONE.format(_P)}), u AS ({_UP.format(in_duck(_side(UPLOADS, False)))}), n AS (SELECT bool_or(one = '1-URGENT') AS named FROM ({_P}) WHERE proc_encoding = 0), w AS (SELECT bool_or(contains(message, 'order 5')) AS logged FROM ({in_duck(OURS)})), e AS (SELECT bool_or(contains(event_type, 'click')) AS clicked FROM events)
        SELECT asked, x.k AS key, CASE WHEN x.v THEN 'ok' ELSE 'fail' END AS verdict FROM (
          SELECT 'met' AS asked, unnest([{{'k': 'series part.1', 'v': true}}, {{'k': 'series part.2', 'v': true}}, {{'k': 'host facts', 'v': true}}, {{'k': '3 processes', 'v': l.n >= 3}}, {{'k': 'process 1-URGENT', 'v': n.named}}, {{'k': 'log', 'v': w.logged}}, {{'k': 'host h', 'v': true}},
               {{'k': 'upload', 'v': starts_with(u.r.via, 'trace-agent ') AND u.r.key AND contains(u.r.tags, 'host:')}}, {{'k': 'upload attachment nothing', 'v': false}}, {{'k': 'check order.F', 'v': true}}, {{'k': 'event', 'v': e.clicked}}]) AS x FROM l, u, n, w, e
          UNION ALL SELECT 'not met', unnest([{{'k': 'series part.1', 'v': true}}, {{'k': 'series none', 'v': false}}, {{'k': 'platform', 'v': false}}, {{'k': '99 processes', 'v': false}}, {{'k': 'process none', 'v': false}}, {{'k': 'log', 'v': false}}, {{'k': 'host none', 'v': false}}, {{'k': 'api key', 'v': false}},
               {{'k': 'upload', 'v': starts_with(u.r.via, 'trace-agent ') AND u.r.key AND contains(u.r.tags, 'host:')}}, {{'k': 'upload family none', 'v': false}}, {{'k': 'check order.X', 'v': false}}, {{'k': 'event', 'v': false}}]) AS x FROM u
          UNION ALL SELECT 'key', {{'k': 'api key', 'v': true}} UNION ALL SELECT 'none', {{'k': 'assertions', 'v': false}})""",
    "presence": """SELECT x.k AS key, x.v AS there FROM (SELECT unnest([{'k': 'has F', 'v': bool_or(o_orderstatus = 'F')}, {'k': 'has X', 'v': bool_or(o_orderstatus = 'X')}, {'k': 'dear', 'v': bool_or(o_totalprice > 1000)}, {'k': 'urgent', 'v': bool_or(o_orderpriority LIKE '%URGENT%')}, {'k': 'before 1970', 'v': bool_or(o_orderdate < '1970-01-01')}]) AS x FROM orders)""",
    "first_of_kind": "SELECT o_orderstatus AS kind, o_orderkey AS pos, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O') QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) = 1",
    "pack_series": f"SELECT ts, payload, rows, series, round(sum(t) OVER (PARTITION BY ts), 6) AS total, first FROM (SELECT ts, CAST(floor((k - 1) / 100) AS BIGINT) AS payload, count(*) AS rows, CAST(count(*) AS INTEGER) AS series, sum(value) AS t, arg_min(metric || '|' || type || '|h|none', k) AS first FROM (SELECT ts % 20 AS ts, metric, type, tags, value, row_number() OVER (PARTITION BY ts % 20 ORDER BY metric, tags, n) AS k FROM ({_A}) WHERE n <> 2) GROUP BY ALL)",
    "pack_logs": f"""
        WITH RECURSIVE d AS (SELECT doc_id % 50 AS source_id, md5(text) AS h, strlen(text) AS size, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL),
        f AS (SELECT source_id, k, 0::BIGINT AS batch, 1 AS n, size AS s, size, h FROM d WHERE k = 1
          UNION ALL SELECT d.source_id, d.k, CASE WHEN n >= {MAX_ROWS} OR s + d.size > {MAX_BYTES} THEN batch + 1 ELSE batch END, CASE WHEN n >= {MAX_ROWS} OR s + d.size > {MAX_BYTES} THEN 1 ELSE n + 1 END, CASE WHEN n >= {MAX_ROWS} OR s + d.size > {MAX_BYTES} THEN d.size ELSE s + d.size END, d.size, d.h
          FROM f JOIN d ON d.source_id = f.source_id AND d.k = f.k + 1)
        SELECT source_id, batch, count(*) AS rows, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS items, arg_min(h, k) AS first FROM f GROUP BY source_id, batch""",
    "pack_checks": "SELECT host_name, CAST((k - 1) // 200 AS BIGINT) AS payload, count(*) AS rows, min(o_orderpriority) AS first FROM (SELECT (o_custkey % 50)::VARCHAR AS host_name, o_orderpriority, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderpriority, o_orderkey) AS k FROM orders) GROUP BY ALL",
    "pack_events": """WITH r AS (SELECT DISTINCT 'https://' || (r_regionkey % 3) AS url, 'k' || (r_regionkey % 2) AS key FROM region WHERE r_regionkey <> 4)
        SELECT host, CAST((k - 1) // 300 AS BIGINT) AS payload, url, key, count(*) FILTER (event_id % 4 = 0) AS n_api, host::VARCHAR AS name FROM (SELECT *, user_id % 9 AS host, row_number() OVER (PARTITION BY user_id % 9 ORDER BY event_id) AS k FROM events), r GROUP BY ALL""",
    "pack_bodies": """
        WITH c AS (SELECT *, (o_custkey % 7)::VARCHAR AS host, CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority ELSE '' END AS chk FROM orders),
        cn AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY chk, o_orderkey) - 1 AS k FROM c),
        cb AS (SELECT 'checks ' || host AS "of", k // 3 AS payload, '[' || string_agg('{"check":"' || chk || '","host_name":"' || host || '","timestamp":' || o_orderkey * 100 || ',"status":' || o_orderkey % 4 || CASE WHEN o_orderkey % 3 = 0 THEN ',"message":"say \\"' || o_orderkey || '\\""' ELSE '' END || ',"tags":' || CASE WHEN o_orderkey % 2 = 0 THEN '["a:b","c"]' ELSE '[]' END || '}', ',' ORDER BY k) || ']' AS body FROM cn GROUP BY host, k // 3),
        e AS (SELECT *, (user_id % 5)::VARCHAR AS host, CASE WHEN event_id % 4 > 0 THEN event_type ELSE 'api' END AS src, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS k FROM events),
        s AS (SELECT host, k // 4 AS payload, src, '"' || src || '":[' || string_agg('{"msg_title":"' || event_type || '","msg_text":"x"' || CASE WHEN event_id <> 1 THEN ',"timestamp":' || event_id * 50 - 50 ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ',"priority":"low"' ELSE '' END || ',"host":"' || host || '"' || CASE WHEN event_id % 2 = 0 THEN ',"tags":["a:b"]' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN ',"aggregation_key":"g' || event_id || '"' ELSE '' END || CASE WHEN event_id % 4 > 0 THEN ',"source_type_name":"' || event_type || '"' ELSE '' END || '}', ',' ORDER BY k) || ']' AS part FROM e GROUP BY host, k // 4, src),
        eb AS (SELECT host, payload, string_agg(part, ',' ORDER BY src) AS parts FROM s GROUP BY host, payload)
        SELECT "of", CAST(payload AS BIGINT) AS payload, body FROM cb
        UNION ALL SELECT 'events ' || host || ' u' || d, payload, '{"apiKey":"k' || d || '","events":{' || parts || '},"internalHostname":"' || host || '"}' FROM eb, range(2) t(d)""",
    "destinations": """SELECT url, key, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (ORDER BY rank, url, key) AS INTEGER) AS pos FROM (SELECT DISTINCT 'u' || n_regionkey AS url, 'k' || (n_nationkey % 2) AS key, CASE WHEN n_regionkey = 3 AND n_nationkey % 2 = 1 THEN 0 ELSE 1 END AS rank FROM nation WHERE n_nationkey % 5 > 0)""",
    "dead_letter": "SELECT CAST(c AS INTEGER) AS http_status, count(*) AS n, CASE WHEN c < 300 THEN 'delivered' WHEN c IN (400, 403, 413) THEN 'dead' ELSE 'retry' END AS fate FROM (SELECT [200, 202, 400, 403, 413, 429, 500][o_orderkey % 7 + 1] AS c FROM orders) GROUP BY c",
}
