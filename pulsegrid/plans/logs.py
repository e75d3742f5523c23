"""Queries over log lines, journal entries and resume positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import logs
from ..operators.logs import Rule
from ..sources.journal import parse_journal
from .recipes import in_duck, in_spark, table

MAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"
CAP, IDLE = 300, 86400


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("offset", "line"))
    return d.select(F.col("doc_id").alias("source_id"), F.col("offset").cast("long").alias("offset"), F.lit(None).cast("timestamp").alias("ts"), "line")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumnRenamed("line", "message").drop("ts")


def mask_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).withColumn("message", logs.mask_sequences(F.col("message"), MAIL, "[mail]"))


def rules_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An e-mail address is masked before lines that still show one are excluded; the broken rule is skipped."""
    rules = [Rule("mask_sequences", MAIL, "[mail]"), Rule("exclude_at_match", "@|^[A-M]"), Rule("include_at_match", "("), Rule("mask_sequences", "[0-9]+", "#"), Rule("include_at_match", "[#.]")]
    return logs.apply_rules(_messages(spark, sf_dir), rules)


#: Patterns in forms that only the rules' dialect has, or that mean something else in Java.
DIALECT = [
    Rule("mask_sequences", r"[[:digit:]]+", "#"), Rule("mask_sequences", r"(?P<1x>\pL+)@\w+", "$1x <${1x}> $1[a$$]"), Rule("mask_sequences", r"[[:^ascii:]&&é]{2}", "~"),
    Rule("mask_sequences", r"(?i)\bla\b|(?U)s+e*", "[$0]"), Rule("mask_sequences", r"\Q...\E|\x{2E}\z|\.$", "!"), Rule("mask_sequences", r"z*?", "_"), Rule("exclude_at_match", r"^[^[:upper:]\PL_]+$"),
    Rule("mask_sequences", r"e|", "E"), Rule("mask_sequences", r"\p{^L}++", "never"), Rule("exclude_at_match", r"(?=x)"),
]


def rules_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.apply_rules(_messages(spark, sf_dir), DIALECT)


def include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.apply_rules(_messages(spark, sf_dir), [Rule("include_at_match", "[a-z]{9}"), Rule("exclude_at_match", "[0-9]$")])


def multiline_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.assemble_multiline(_lines(spark, sf_dir), "[A-M]", None).drop("ts")


def multiline_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.assemble_multiline(_lines(spark, sf_dir), "[A-C]", None, CAP).drop("ts")


TURNS = "SELECT conv_id AS source_id, cast(turn AS bigint) AS offset, cast(null AS timestamp) AS ts, concat(role, ': ', coalesce(text, '')) AS line FROM {conversations}"
STAMPED = "SELECT user_id AS source_id, event_id AS offset, cast(ts AS timestamp) AS ts, event_type AS line FROM {events}"


def multiline_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.assemble_multiline(in_spark(spark, sf_dir, TURNS), "user", None).drop("ts")


def multiline_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.assemble_multiline(in_spark(spark, sf_dir, STAMPED), "c", IDLE)
    return rows.select("source_id", "offset", F.unix_timestamp("ts").alias("ts"), "message")


def process_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("multi_line", "[A-M]"), Rule("mask_sequences", MAIL, "[mail]"), Rule("exclude_at_match", "^[A-C]")]
    rows = logs.process_logs(_lines(spark, sf_dir), rules, "web", "app", ["env:prod"])
    return logs.with_defaults(rows, "h1", ["team:x"]).select("source_id", "offset", "message", "status", "hostname", "service", "ddsource", "ddtags")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    unit = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), F.col("user_id") % 4, F.lit(".service")))
    name = F.when(F.col("event_id") % 5 == 0, F.col("event_type"))
    entry = F.struct(F.lit(None).cast("string").alias("__X"), F.concat(F.lit("c"), "event_id").alias("__CURSOR"), (F.col("event_id") * 1000 + 7).cast("string").alias("__REALTIME_TIMESTAMP"), F.concat(F.lit("event "), "event_id").alias("MESSAGE"), (F.col("event_id") % 9).cast("string").alias("PRIORITY"), name.alias("SYSLOG_IDENTIFIER"), unit.alias("_SYSTEMD_UNIT"), F.lit("init").alias("_COMM"))
    line = F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).otherwise(F.to_json(entry))
    out = logs.process_journal(e.select(line.alias("line")), service="", include={"matches": ["_COMM=init", "_COMM=other"]}, exclude={"units": ["u1.service"], "matches": ["PRIORITY=7"]})
    return out.select("cursor", "message", "status", "timestamp", "service", "ddsource")


#: JSON values of a field, and the texts they are.
VALUES = [
    ('"[104]"', "[104]"), ("[104, 105]", "hi"), ("[1,300]", "[1,300]"), ('"[1,2]"', "[1,2]"), ('{"a":[1,2],"b":"x"}', '{"a":[1,2],"b":"x"}'), ("[]", ""), ("null", "null"), ('["a"]', '["a"]'), ("[195,169]", "é"), ("[72,null,-1]", "[72,null,-1]"),
    ("[65,1.0]", "[65,1.0]"), ("12.5", "12.5"), ("true", "true"), ('"a\\u0041\\"b"', 'aA"b'), ('""', ""), ('"null"', "null"), ("[[104]]", "[[104]]"), ("[66 , 67]", "BC"),
]


def journal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every JSON type, strings that look like other types among them."""
    k = F.col("event_id")
    raw = F.element_at(F.array(*[F.lit(v) for v, _ in VALUES]), (k % len(VALUES) + 1).cast("int"))
    line = F.when(k % 7 == 0, F.lit("[1]")).otherwise(F.concat(F.lit('{"__CURSOR":"c'), k, F.lit('","__REALTIME_TIMESTAMP":"'), k, F.lit('","D": '), raw, F.lit(',"N":'), k, F.lit("}")))
    return parse_journal(table(spark, sf_dir, "events").select(line.alias("line"))).select("cursor", "realtime", F.try_element_at("fields", F.lit("D")).alias("d"), F.try_element_at("fields", F.lit("N")).alias("n"), F.size("fields").alias("fields"))


def journal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of user and system units under all ways to include and exclude them, one after the other."""
    k = F.col("event_id")
    pair = lambda key, value, ok: F.when(ok, F.struct(F.lit(key).alias("key"), value.alias("value")))
    user, unit = F.concat(F.lit("u"), k % 3), F.concat(F.lit("s"), k % 4)
    fields = F.map_from_entries(F.array_compact(F.array(pair("_SYSTEMD_USER_UNIT", user, k % 2 == 0), pair("_SYSTEMD_UNIT", unit, k % 5 > 0), pair("P", (k % 6).cast("string"), k % 7 > 0))))
    e = table(spark, sf_dir, "events").select("event_id", fields.alias("f"))
    f = F.col("f")
    drops = {"d_all_users": {"user_units": ["*"]}, "d_all_units": {"units": ["*"]}, "d_both": {"units": ["s1"], "user_units": ["u1", "u2"]}, "d_match": {"matches": ["P=3", "Q=", "=x", "none"]}, "d_empty": {"matches": ["P="]}}
    keeps = {"i_units": {"units": ["s1", "s2"]}, "i_users": {"user_units": ["u0"]}, "i_both": {"units": ["s1"], "user_units": ["u1"], "matches": ["P=1", "P=2"]}, "i_fields": {"matches": ["P=1", "P=4", "_SYSTEMD_UNIT=s0"]}, "i_all": {}}
    return e.select("event_id", *[columns.journal_drop(f, **x).alias(n) for n, x in drops.items()], *[columns.journal_include(f, **x).alias(n) for n, x in keeps.items()])


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("source_id", F.lit(1).alias("generation"), ((F.col("offset") + 1) * 10).alias("offset"), "line")


def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No registered place, one in the middle, one past the end, an older generation."""
    known = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("source_id"), F.when(F.col("doc_id") % 4 == 3, 0).otherwise(1).alias("generation"), F.when(F.col("doc_id") % 4 == 2, 1_000_000).otherwise(20).cast("long").alias("offset"))
    return logs.resume(_ends(spark, sf_dir), known).select("source_id", "offset", "line")


def advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("source_id"), F.when(F.col("doc_id") % 3 == 1, 2).otherwise(1).alias("generation"), F.lit(15).cast("long").alias("offset"))
    done = _ends(spark, sf_dir).withColumn("source_id", F.when(F.col("source_id") % 2 == 1, F.col("source_id") + 10**9).otherwise(F.col("source_id")))
    return logs.advance(old, done)


def advance_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal cursors: sources known and not, cursors delivered and empty."""
    e = table(spark, sf_dir, "events")
    old = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), F.col("c_custkey") % 90).alias("source_id"), F.lit("old").alias("cursor")).distinct()
    done = e.select(F.concat(F.lit("s"), F.col("user_id") % 70 + 40).alias("source_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("c"), "event_id")).otherwise("").alias("cursor"))
    return logs.advance_cursors(old, done)


QUERIES = {f.__name__: f for f in (mask_emails, rules_order, rules_dialect, include_exclude, multiline_docs, multiline_cap, multiline_turns, multiline_idle, process_logs, journal, journal_fields, journal_units, resume, advance, advance_cursors)}

_L = "SELECT doc_id AS source_id, CAST(unnest(range(len(ls))) AS BIGINT) AS \"offset\", unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)"
_M = f"SELECT source_id, \"offset\", line AS message FROM ({_L})"
_START = "regexp_matches(line, '^[A-M]')"
_MASK = f"regexp_replace(message, '{MAIL}', '[mail]', 'g')"


def _joined(lines: str, start: str, more: str = "") -> str:
    return f"""SELECT source_id, max("offset") AS "offset", string_agg(line, chr(10) ORDER BY "offset") AS message{more} FROM
        (SELECT *, count(*) FILTER ({start}) OVER (PARTITION BY source_id ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS gid FROM ({lines})) GROUP BY source_id, gid"""


ORACLES = {
    "mask_emails": f"SELECT source_id, \"offset\", {_MASK} AS message FROM ({_M})",
    "rules_order": f"""SELECT source_id, "offset", regexp_replace(message, '[0-9]+', '#', 'g') AS message FROM (SELECT source_id, "offset", {_MASK} AS message FROM ({_M}))
        WHERE NOT regexp_matches(message, '@|^[A-M]') AND regexp_matches(message, '[0-9#.]')""",
    "rules_dialect": f"""
        WITH m1 AS (SELECT source_id, "offset", regexp_replace(message, '[[:digit:]]+', '#', 'g') AS m FROM ({_M})),
        m2 AS (SELECT * REPLACE (regexp_replace(m, '(\\pL+)@\\w+', '\\1 <\\1> \\1[a$]', 'g') AS m) FROM m1),
        m3 AS (SELECT * REPLACE (regexp_replace(m, '[[:^ascii:]&&é]{{2}}', '~', 'g') AS m) FROM m2),
        m4 AS (SELECT * REPLACE (regexp_replace(m, '(?i)\\bla\\b|(?U)s+e*', '[\\0]', 'g') AS m) FROM m3),
        m5 AS (SELECT * REPLACE (regexp_replace(m, '\\Q...\\E|\\x{{2E}}\\z|\\.$', '!', 'g') AS m) FROM m4),
        m6 AS (SELECT * REPLACE (regexp_replace(m, 'z*?', '_', 'g') AS m) FROM m5 )
        SELECT source_id, "offset", regexp_replace(m, 'e|', 'E', 'g') AS message FROM m6 WHERE NOT regexp_matches(m, '^[^[:upper:]\\PL_]+$')""",
    "include_exclude": f"SELECT * FROM ({_M}) WHERE regexp_matches(message, '[a-z]{{9}}') AND NOT regexp_matches(message, '[0-9]$')",
    "multiline_docs": _joined(_L, _START),
    "multiline_cap": f"""
        WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY source_id, gid ORDER BY "offset") AS n, strlen(line) + 1 AS size FROM
          (SELECT *, count(*) FILTER (regexp_matches(line, '^[A-C]')) OVER (PARTITION BY source_id ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS gid FROM ({_L}))),
        f AS (SELECT source_id, gid, n, "offset", line, 0 AS part, size AS held FROM g WHERE n = 1
          UNION ALL SELECT g.source_id, g.gid, g.n, g."offset", g.line, CASE WHEN held > {CAP} THEN part + 1 ELSE part END, CASE WHEN held > {CAP} THEN size ELSE held + size END
          FROM f JOIN g ON g.source_id = f.source_id AND g.gid = f.gid AND g.n = f.n + 1)
        SELECT source_id, max("offset") AS "offset", string_agg(line, chr(10) ORDER BY "offset") AS message FROM f GROUP BY source_id, gid, part""",
    "multiline_turns": _joined(in_duck(TURNS), "starts_with(line, 'user')"),
    "multiline_idle": _joined(f"SELECT *, coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY source_id ORDER BY \"offset\") >= {IDLE}, false) AS idle FROM ({in_duck(STAMPED)})", "idle OR starts_with(line, 'c')", ", CAST(floor(epoch(arg_max(ts, \"offset\"))) AS BIGINT) AS ts"),
    "process_logs": f"SELECT source_id, \"offset\", {_MASK} AS message, 'info' AS status, 'h1' AS hostname, 'web' AS service, 'app' AS ddsource, 'env:prod,team:x' AS ddtags FROM ({_joined(_L, _START)}) WHERE NOT regexp_matches({_MASK}, '^[A-C]')",
    "journal": """
        WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'u' || (user_id % 4) || '.service' END AS unit, CASE WHEN event_id % 5 = 0 THEN event_type END AS ident FROM events WHERE event_id % 11 <> 0)
        SELECT 'c' || event_id AS "cursor", '{"journald":{"PRIORITY":"' || (event_id % 9) || '"' || coalesce(',"SYSLOG_IDENTIFIER":"' || ident || '"', '') || ',"_COMM":"init"' || coalesce(',"_SYSTEMD_UNIT":"' || unit || '"', '') || '},"message":"event ' || event_id || '"}' AS message,
               coalesce(['emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'info'][event_id % 9 + 1], 'info') AS status, event_id AS timestamp,
               coalesce(ident, unit, 'init') AS service, coalesce(ident, unit, 'init') AS ddsource
        FROM e WHERE event_id % 9 <> 7 AND unit IS DISTINCT FROM 'u1.service'""",
    "journal_fields": "WITH v AS (SELECT [" + ", ".join("'" + t.replace("'", "''") + "'" for _, t in VALUES) + f"] AS vs) SELECT 'c' || event_id AS \"cursor\", event_id AS realtime, vs[event_id % {len(VALUES)} + 1] AS d, event_id::VARCHAR AS n, CAST(2 AS INTEGER) AS fields FROM events, v WHERE event_id % 7 > 0",
    "journal_units": """
        WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'u' || event_id % 3 END AS u, CASE WHEN event_id % 5 > 0 THEN 's' || event_id % 4 END AS s, CASE WHEN event_id % 7 > 0 THEN (event_id % 6)::VARCHAR END AS p FROM events)
        SELECT event_id, u IS NOT NULL AS d_all_users, u IS NULL AND s IS NOT NULL AS d_all_units, CASE WHEN u IS NOT NULL THEN u IN ('u1', 'u2') ELSE coalesce(s = 's1', false) END AS d_both, true AS d_match, p IS NULL AS d_empty,
               coalesce(s IN ('s1', 's2'), false) AS i_units, coalesce(u = 'u0', false) AS i_users, coalesce(s = 's1' AND p IN ('1', '2'), false) OR coalesce(u = 'u1', false) AS i_both, coalesce(p IN ('1', '4') AND s = 's0', false) AS i_fields, true AS i_all FROM e""",
    "resume": f"""SELECT source_id, ("offset" + 1) * 10 AS "offset", line FROM (SELECT *, max(("offset" + 1) * 10) OVER (PARTITION BY source_id) AS size FROM ({_L}))
        WHERE ("offset" + 1) * 10 > CASE source_id % 4 WHEN 0 THEN size WHEN 1 THEN CASE WHEN size < 20 THEN 0 ELSE 20 END WHEN 2 THEN 0 ELSE 0 END""",
    "advance": f"""
        WITH d AS (SELECT source_id, {{'g': 1, 'o': max(("offset" + 1) * 10)}} AS d FROM (SELECT CASE WHEN source_id % 2 = 1 THEN source_id + 1000000000 ELSE source_id END AS source_id, "offset" FROM ({_L})) GROUP BY source_id),
        r AS (SELECT CASE WHEN doc_id % 3 = 0 THEN -1 - doc_id ELSE doc_id END AS source_id, {{'g': CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END, 'o': 15::BIGINT}} AS r FROM documents)
        SELECT source_id, CAST(x.g AS INTEGER) AS generation, x.o AS "offset" FROM (SELECT source_id, CASE WHEN r IS NULL OR d > r THEN d ELSE r END AS x FROM d FULL JOIN r USING (source_id))""",
    "advance_cursors": """
        WITH d AS (SELECT 's' || (user_id % 70 + 40) AS source_id, 'c' || max(event_id) AS c FROM events WHERE event_id % 3 > 0 GROUP BY 1), r AS (SELECT DISTINCT 's' || (c_custkey % 90) AS source_id FROM customer)
        SELECT source_id, coalesce(c, 'old') AS "cursor" FROM d FULL JOIN r USING (source_id)""",
}
