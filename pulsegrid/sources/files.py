"""Log files, recordings and payload tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECORD = (
    "kind string, api_key string, metric string, type string, value double, `interval` bigint, tags array<string>, host string, device string, "
    "message string, service string, source string, status string, ddtags string, check string, check_status int, title string, attrs map<string,string>, nums map<string,double>, "
    "proc_encoding int, proc_count int, proc_names array<string>, prof_family string, prof_version string, prof_attach array<string>, prof_tags string, prof_via string, prof_add_tags string, prof_api_key boolean, pos bigint"
)


def read_log_lines(spark: SparkSession, path: str, keep_blank: bool = False, rotated: bool = False, cap: int = 262_144) -> DataFrame:
    """`(source_id, offset, line)`, offset being the byte just past the line's newline.

    A last line without a newline is held back until it has one, so that an offset never lies in the middle of a line. Only one
    of over `cap` bytes, and that of a file that was `rotated` away, is given as it is; its offset is the file's size.

    The running size is taken in two steps, per read block and then inside it, so that a large file is spread.
    """
    raw = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("whole"), F.monotonically_increasing_id().alias("seq"))
    sized = raw.withColumn("size", F.octet_length("value") + 1)
    blocks = sized.groupBy("source_id", "block").agg(F.sum("size").alias("total"))
    before = blocks.select("source_id", "block", (F.sum("total").over(Window.partitionBy("source_id").orderBy("block")) - F.col("total")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("source_id", "block").orderBy("seq"))
    placed = sized.withColumn("inside", inside).join(before, ["source_id", "block"]).withColumn("end", F.col("before") + F.col("inside"))
    given = placed.filter((F.col("end") <= F.col("whole")) | F.lit(rotated) | (F.col("size") - 1 > cap))
    open_end = F.col("end") > F.col("whole")
    lines = given.select("source_id", F.least("end", "whole").alias("offset"), F.when(open_end, F.col("value")).otherwise(F.regexp_replace("value", r"\r+\z", "")).alias("line"))
    return lines if keep_blank else lines.filter("line <> ''")


def cap_lines(df: DataFrame, cap: int = 262_144, col: str = "line") -> DataFrame:
    """A line over `cap` bytes becomes pieces of at most that many, numbered by `piece`; others pass untouched.

    Cuts are three bytes closer than `cap` and move back to where a character begins, so that every piece is text of its
    own and none depends on another.
    """
    step = cap - 3
    begins = F.sequence(F.lit(0), F.greatest((F.octet_length(col) - 1), F.lit(0)), F.lit(step))
    bound = lambda value, use: F.flatten(F.transform(F.array(value), use))  # noqa: E731 - `value` is worked out once

    def back(raw: Column, at: Column) -> Column:
        inner = lambda x: F.conv(F.hex(F.substring(raw, x + 1, F.lit(1))), 16, 10).cast("int").between(0x80, 0xBF)
        return F.when(~inner(at), at).when(~inner(at - 1), at - 1).when(~inner(at - 2), at - 2).otherwise(at - 3)

    cuts = lambda raw: F.transform(begins, lambda at: F.when(at == 0, at).otherwise(back(raw, at)))
    piece = lambda raw, cuts: F.transform(cuts, lambda at, k: F.substring(raw, at + 1, F.coalesce(F.get(cuts, k + 1), F.octet_length(raw)) - at).cast("string"))
    pieces = bound(F.encode(F.col(col), "UTF-8"), lambda raw: bound(cuts(raw), lambda c: piece(raw, c)))
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(F.when(F.octet_length(col) > cap, pieces).otherwise(F.array(col))).alias("piece", col))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines recording; `pos`, if it isn't there, is the place of the line."""
    return spark.read.schema(RECORD).json(path).withColumn("pos", F.coalesce("pos", F.monotonically_increasing_id()))


def normalize_payloads(df: DataFrame) -> DataFrame:
    """Payload rows `(path, api_key, body)` to record rows; a body that can't be read gives none.

    Series have their last point's value (0 without one). An intake body is an envelope of events if it has any, else
    host facts if it names a platform or hardware; its own key goes before the request's. Inventory bodies give a row
    for the host's and one for the agent's part.
    """
    to = lambda name: df.filter(F.col("path").contains(name))
    text = lambda c: F.coalesce(c, F.lit(""))
    series = to("/series").select("api_key", F.explode(F.from_json("body", "series array<struct<metric string, type string, `interval` bigint, tags array<string>, host string, device string, points array<array<double>>>>")["series"]).alias("s"))
    last = F.get("s.points", F.size("s.points") - 1)
    a = series.select(F.lit("series").alias("kind"), "api_key", "s.metric", "s.type", "s.interval", "s.tags", "s.host", "s.device", F.when(F.size(last) == 2, F.get(last, F.lit(1))).otherwise(0.0).alias("value"))
    logs = to("/logs").select("api_key", F.explode(F.from_json("body", "array<struct<message string, status string, hostname string, service string, ddsource string, ddtags string>>")).alias("l"))
    b = logs.select(F.lit("log").alias("kind"), "api_key", "l.message", "l.status", F.col("l.hostname").alias("host"), "l.service", F.col("l.ddsource").alias("source"), "l.ddtags")
    checks = to("/check_run").select("api_key", F.explode(F.from_json("body", "array<struct<check string, host_name string, status int>>")).alias("c"))
    c = checks.select(F.lit("check").alias("kind"), "api_key", "c.check", F.col("c.host_name").alias("host"), F.col("c.status").alias("check_status"))
    body = "apiKey string, events map<string, array<struct<msg_title string>>>, os string, systemStats struct<platform string, cpuCores int>, meta struct<hostname string>, `host-tags` struct<system array<string>>, gohai string"
    intake = to("/intake").select(F.from_json("body", body).alias("e"), "api_key").withColumn("api_key", F.coalesce(F.nullif("e.apiKey", F.lit("")), "api_key"))
    d = intake.filter("e.events is not null").select("api_key", F.explode(F.flatten(F.map_values("e.events"))).alias("x")).select(F.lit("event").alias("kind"), "api_key", F.col("x.msg_title").alias("title"))
    facts = intake.filter("e.events is null").filter((text(F.col("e.systemStats.platform")) != "") | (text(F.col("e.gohai")) != "")).withColumn("g", F.from_json("e.gohai", "cpu struct<cpu_cores bigint>, memory struct<total bigint>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    read = F.col("g").isNotNull() & F.col("g._corrupt").isNull()
    cores = F.when(read & (F.col("g.cpu.cpu_cores") > 0), F.col("g.cpu.cpu_cores")).otherwise(F.coalesce(F.col("e.systemStats.cpuCores"), F.lit(0))).cast("double")
    nums = F.when(read, F.create_map(F.lit("cpu_cores"), cores, F.lit("mem_total"), F.coalesce(F.col("g.memory.total"), F.lit(0)).cast("double"))).otherwise(F.create_map(F.lit("cpu_cores"), cores))
    e = facts.select(F.lit("meta").alias("kind"), "api_key", F.create_map(F.lit("os"), text(F.col("e.os")), F.lit("platform"), text(F.col("e.systemStats.platform")), F.lit("hostname"), text(F.col("e.meta.hostname"))).alias("attrs"), nums.alias("nums"), F.col("e.host-tags.system").alias("tags"))
    inventory = to("/metadata").select("api_key", F.from_json("body", "host_metadata struct<os string, kernel_name string, cpu_architecture string, cpu_cores bigint, cpu_logical_processors bigint, memory_total_kb bigint, agent_version string>, agent_metadata map<string,string>").alias("m"))
    h = lambda n: F.col(f"m.host_metadata.{n}")
    number = lambda n: F.coalesce(h(n), F.lit(0)).cast("double")
    attrs = F.create_map(*[x for n in ("os", "kernel_name", "cpu_architecture", "agent_version") for x in (F.lit(n), text(h(n)))])
    f = inventory.filter("m.host_metadata is not null").select(F.lit("inv_host").alias("kind"), "api_key", attrs.alias("attrs"), F.create_map(F.lit("cpu_cores"), number("cpu_cores"), F.lit("cpu_logical"), number("cpu_logical_processors"), F.lit("memory_total_kb"), number("memory_total_kb")).alias("nums"))
    agent = F.create_map(*[x for n in ("agent_version", "flavor") for x in (F.lit(n), text(F.try_element_at("m.agent_metadata", F.lit(n))))])
    g = inventory.filter("m.agent_metadata is not null").select(F.lit("inv_agent").alias("kind"), "api_key", agent.alias("attrs"))
    out = a
    for x in (b, c, d, e, f, g):
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def profile_uploads(df: DataFrame, col: str = "event") -> DataFrame:
    """Facts of upload events, a row for each attachment."""
    e = df.withColumn("_e", F.from_json(col, "family string, version string, attachments array<string>, tags_profiler string"))
    return e.select(*[c for c in df.columns if c != col], "_e.family", "_e.version", F.explode_outer("_e.attachments").alias("attachment"), F.split("_e.tags_profiler", ",").alias("tags"))
