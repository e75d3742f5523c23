"""Metric, check and event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import to_double, utf8_text

_NONE = "array<string>"


def split_datagrams(df: DataFrame) -> DataFrame:
    """Payloads to lines, with `sub`, the line's place; carriage returns at the end and empty lines go."""
    lines = df.select(*[c for c in df.columns if c != "payload"], F.posexplode(F.split("payload", "\n", -1)).alias("sub", "raw"))
    return lines.withColumn("line", F.rtrim("raw", F.lit("\r"))).drop("raw").filter("line <> ''")


def route(line: Column) -> Column:
    """Check, event or metric."""
    return F.when(line.startswith("_sc|"), "check").when(line.startswith("_e{"), "event").otherwise("metric")


def _last(fields: Column, prefix: str) -> Column:
    found = F.filter(fields, lambda f: f.startswith(prefix))
    return F.substring(F.get(found, F.size(found) - 1), len(prefix) + 1, 1 << 30)


def _whole_numbers(fields: Column, prefix: str) -> Column:
    """The numbers behind `prefix`; what isn't wholly one, or beyond 64 bits, is left out."""
    rest = lambda x: F.substring(x, len(prefix) + 1, 1 << 30)
    return F.filter(F.transform(F.filter(fields, lambda x: x.startswith(prefix)), lambda x: F.when(rest(x).rlike(r"\A[+-]?[0-9]+\z"), rest(x).try_cast("long"))), lambda v: v.isNotNull())


def _tags(fields: Column) -> Column:
    t = _last(fields, "#")
    return F.when(t.isNull() | (t == ""), F.array().cast(_NONE)).otherwise(F.split(t, ","))


#: Type codes of metric lines.
KINDS = {"g": "gauge", "c": "counter", "h": "histogram", "ms": "timing", "d": "distribution", "s": "set"}


def with_fields(df: DataFrame, line: str = "line") -> DataFrame:
    """Add the parts of metric lines: _name, _type, _values (one for each sample; null for a malformed line; of a set a
    null), _member, _tags, _rate.

    Each stage is a projection over the one before and is evaluated once; the forms that most lines don't have (options,
    several values) are behind conditions, and plain ones stay in generated code.
    """
    text = F.col(line)
    df = df.withColumn("_f", F.split(text, r"\|", -1))
    df = df.withColumns({"_head": F.get("_f", F.lit(0)), "_code": F.get("_f", F.lit(1)), "_opts": F.when(F.size("_f") > 2, F.slice("_f", F.lit(3), F.greatest(F.size("_f") - 2, F.lit(0))))})
    at = F.locate(":", F.col("_head"))
    rates = F.filter(F.transform(F.filter("_opts", lambda x: x.startswith("@")), lambda x: to_double(F.substring(x, 2, 1 << 30))), lambda r: r.isNotNull() & ~F.isnan(r) & (r > 0))
    df = df.withColumns({
        "_name": F.substring("_head", F.lit(1), at - 1), "_value": F.when(at > 1, F.substring("_head", at + 1, F.lit(1 << 30))), "_type": F.coalesce(*[F.when(F.col("_code") == k, F.lit(v)) for k, v in KINDS.items()]),
        "_rates": F.when(F.contains(text, F.lit("|@")), rates), "_tags": F.when(F.contains(text, F.lit("|#")), _tags(F.col("_opts"))).otherwise(F.array().cast(_NONE))})
    one = to_double(F.col("_value"))
    numbers = F.when(F.contains("_value", F.lit(":")), F.transform(F.split("_value", ":", -1), to_double)).when(one.isNotNull(), F.array(one))
    df = df.withColumns({"_rate": F.coalesce(F.get("_rates", F.size("_rates") - 1), F.lit(1.0)), "_numbers": F.when(F.col("_type") != "set", numbers)})
    none = F.when(F.size("_numbers") > 1, F.size(F.array_compact("_numbers")) < F.size("_numbers")).otherwise(F.lit(False))
    values = F.when((F.col("_type") == "set") & F.col("_value").isNotNull(), F.array(F.lit(None).cast("double"))).when(~none, F.col("_numbers"))
    return df.withColumns({"_values": values, "_member": F.when(F.col("_type") == "set", F.col("_value"))}).drop("_f", "_head", "_code", "_opts", "_value", "_rates", "_numbers")


def parse_samples(df: DataFrame, line: str = "line") -> DataFrame:
    """S3: metric lines to samples; a malformed line gives none."""
    made = {"name": "_name", "type": "_type", "value": "value", "member": "_member", "tags": "_tags", "sample_rate": "_rate"}
    kept = [c for c in df.columns if c != line]
    # an outer explode, whose condition can't be inferred and so isn't evaluated twice
    each = with_fields(df, line).select(*kept, *[c for c in made.values() if c[0] == "_"], F.posexplode_outer("_values").alias("_pos", "value")).filter("_pos is not null")
    return each.select(*kept, *[F.col(c).alias(n) for n, c in made.items()])


def parse_check(line: Column) -> Column:
    """Struct of a check line, null if malformed; the message takes the rest of the line, pipes included."""
    f = F.split(line, r"\|", -1)
    status = F.get(f, F.lit(2))
    opts = F.slice(f, F.lit(4), F.greatest(F.size(f) - 3, F.lit(0)))
    at = F.array_position(F.transform(opts, lambda x: x.startswith("m:")), F.lit(True))
    before = F.when(at > 0, F.slice(opts, F.lit(1), (at - 1).cast("int"))).otherwise(opts)
    message = F.when(at > 0, F.substring(F.array_join(F.slice(opts, F.greatest(at, F.lit(1)).cast("int"), F.greatest(F.size(opts), F.lit(1))), "|"), 3, 1 << 30)).otherwise("")
    stamps = _whole_numbers(before, "d:")
    ok = line.startswith("_sc|") & (F.size(f) > 2) & (F.get(f, F.lit(1)) != "") & status.rlike(r"^[+-]?0*[0-3]$") & ~status.rlike("^-0*[1-3]")
    return F.when(ok, F.struct(F.get(f, F.lit(1)).alias("check"), F.coalesce(_last(before, "h:"), F.lit("")).alias("host_name"), F.coalesce(F.get(stamps, F.size(stamps) - 1), F.lit(0)).alias("timestamp"), status.try_cast("int").alias("status"), message.alias("message"), _tags(before).alias("tags")))


def parse_event(line: Column) -> Column:
    """Struct of an event line, null if malformed; the lengths in its head count bytes."""
    head = r"^_e\{([+-]?\d+),([+-]?\d+)\}:"
    size = F.length(F.regexp_extract(line, head, 0))
    tl, el = (F.regexp_extract(line, head, k).try_cast("int") for k in (1, 2))
    body = F.substring(F.encode(line, "UTF-8"), size + 1, F.lit(1 << 30))
    title, bar = F.substring(body, F.lit(1), tl), F.substring(body, tl + 1, F.lit(1))
    text = F.substring(body, tl + 2, el)
    opts = F.split(utf8_text(F.substring(body, tl + el + 2, F.lit(1 << 30))), r"\|", -1)
    plain = lambda b: F.replace(utf8_text(b), F.lit("\\n"), F.lit("\n"))
    ok = (size > 0) & (tl > 0) & (el >= 0) & (F.octet_length(title) == tl) & (bar == F.encode(F.lit("|"), "UTF-8")) & (F.octet_length(text) == el)
    get = lambda p: F.coalesce(_last(opts, p), F.lit(""))
    stamps = _whole_numbers(opts, "d:")
    return F.when(ok, F.struct(plain(title).alias("msg_title"), plain(text).alias("msg_text"), F.coalesce(F.get(stamps, F.size(stamps) - 1), F.lit(0)).alias("timestamp"), get("p:").alias("priority"), get("t:").alias("alert_type"), get("h:").alias("host"), _tags(opts).alias("tags"), get("k:").alias("aggregation_key"), get("s:").alias("source_type_name")))


def quarantine(df: DataFrame, line: str = "line") -> DataFrame:
    """Malformed lines with their kind; they never fail a job."""
    kind = route(F.col(line))
    parsed = with_fields(df, line).withColumn("kind", kind)
    bad = F.when(kind == "check", parse_check(F.col(line)).isNull()).when(kind == "event", parse_event(F.col(line)).isNull()).otherwise(F.col("_values").isNull())
    return parsed.withColumn("malformed", bad).select(*df.columns, "kind", "malformed")
