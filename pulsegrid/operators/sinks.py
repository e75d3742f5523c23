"""Payloads, batches, destinations and delivery."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from ..functions.columns import finite, is_permanent


def pack_series(series: DataFrame, max_rows: int = 1000, keys: Sequence[str] = ("host", "ts")) -> DataFrame:
    """K1: series of a host and flush in JSON payloads of at most `max_rows`; non-finite points are left out."""
    w = Window.partitionBy(*keys).orderBy("metric", "tags", "device")
    numbered = series.filter(finite(F.col("value"))).withColumn("payload", F.floor((F.row_number().over(w) - 1) / max_rows))
    item = F.struct("metric", F.array(F.array(F.col("ts").cast("double"), F.col("value"))).alias("points"), "tags", "host", "type", "interval", F.nullif("device", F.lit("")).alias("device"), F.nullif("source_type_name", F.lit("")).alias("source_type_name"))
    return numbered.groupBy(*keys, "payload").agg(F.count("*").alias("rows"), F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("series"))).alias("body"))


def greedy_batches(df: DataFrame, keys: Sequence[str], order: str, size: str, max_rows: int, max_bytes: int) -> DataFrame:
    """Add `batch`: a batch closes before it would pass `max_bytes`, and at `max_rows`; one oversize row stands alone.

    Where a batch closes depends on all before it in its group, so the sorted rows of a group are run through once,
    holding two counters. A group is one task's: `keys` should name groups of the size of a write partition.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, order)
    spots, at = [df.columns.index(k) for k in keys], df.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, batch, rows, held = None, 0, 0, 0
        for b in batches:
            out = []
            for *key, n in zip(*(b.column(k).to_pylist() for k in spots), b.column(at).to_pylist()):
                n = n or 0
                if key != group:
                    group, batch, rows, held = key, 0, 0, 0
                elif rows >= max_rows or held + n > max_bytes:
                    batch, rows, held = batch + 1, 0, 0
                rows, held = rows + 1, held + n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "batch"])

    return dealt.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())]))


def pack_logs(logs: DataFrame, keys: Sequence[str] = ("source_id",), order: str = "offset", max_rows: int = 1000, max_bytes: int = 5_000_000) -> DataFrame:
    """K2: log rows in JSON arrays, bounded by count and bytes."""
    rows = greedy_batches(logs.withColumn("_size", F.octet_length("message")), keys, order, "_size", max_rows, max_bytes)
    item = F.struct("message", "status", "timestamp", "hostname", "service", "ddsource", "ddtags")
    return rows.groupBy(*keys, "batch").agg(F.count("*").alias("rows"), F.sum("_size").alias("bytes"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, item.alias("x")))), lambda z: z["x"])).alias("body"))


def numbered(df: DataFrame, keys: Sequence[str], blocks: dict[str, Column], order: Sequence[str], out: str) -> DataFrame:
    """Add `out`, the place of each row among those of its `keys` in `order`, from 0, without a task that sorts all of a key.

    `blocks` are coarse values, never null, that come in the order of `order`, such as its first column or an hour of its time:
    rows are numbered in their block, blocks by how many rows stand before them.
    """
    names = [f"_{n}" for n in blocks]
    cut = df.withColumns(dict(zip(names, blocks.values())))
    sizes = cut.groupBy(*keys, *names).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_n", F.sum("_n").over(Window.partitionBy(*keys).orderBy(*names)) - F.col("_n"))
    ranked = cut.withColumn(out, F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order)) - 1)
    same = [ranked[c].eqNullSafe(before[c]) for c in [*keys, *names]]
    return ranked.join(before, same).select(*[ranked[c] for c in df.columns], (F.col("_n") + F.col(out)).alias(out))


def pack_checks(checks: DataFrame, keys: Sequence[str] = ("host_name",), max_rows: int = 1000) -> DataFrame:
    """K3: a host's checks in JSON arrays of at most `max_rows`, by name and time; an empty message is left out, tags never.
    Checks are numbered by name and hour."""
    blocks = {"check": F.coalesce("check", F.lit("")), "hour": F.floor(F.coalesce("timestamp", F.lit(0)) / 3600)}
    rows = numbered(checks, keys, blocks, ["check", "timestamp", "status", "message"], "_at").withColumn("payload", F.floor(F.col("_at") / max_rows))
    item = F.struct("check", "host_name", "timestamp", "status", F.nullif("message", F.lit("")).alias("message"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    return rows.groupBy(*keys, "payload").agg(F.count("*").alias("rows"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_at", item.alias("x")))), lambda z: z["x"])).alias("body"))


def events_by_source(events: DataFrame, keys: Sequence[str] = ("host",)) -> DataFrame:
    """Events by source type; without one they are `api`'s. Empty fields are null."""
    name = F.when(F.coalesce("source_type_name", F.lit("")) == "", "api").otherwise(F.col("source_type_name"))
    text = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    host = [F.nullif(F.col("host").cast("string"), F.lit("")).alias("host")] if "host" in events.columns else []
    item = F.struct("msg_title", "msg_text", F.nullif("timestamp", F.lit(0)).alias("timestamp"), text("priority"), text("alert_type"), *host, F.when(F.size("tags") > 0, F.col("tags")).alias("tags"), text("aggregation_key"), text("source_type_name"))
    listed = F.array_sort(F.collect_list(F.struct("timestamp", "msg_title", "msg_text", item.alias("x"))))
    return events.groupBy(*keys, name.alias("source")).agg(F.transform(listed, lambda z: z["x"]).alias("events"))


def pack_events(events: DataFrame, destinations: DataFrame, max_rows: int = 1000) -> DataFrame:
    """K4: envelopes of at most `max_rows` events of a host, in order of time, by source, stamped with each destination's
    key and the host's name. Events are numbered by hour."""
    at = numbered(events, ["host"], {"hour": F.floor(F.coalesce("timestamp", F.lit(0)) / 3600)}, ["timestamp", "msg_title", "msg_text"], "_at")
    rows = at.withColumn("payload", F.floor(F.col("_at") / max_rows)).drop("_at")
    by_host = events_by_source(rows, ["host", "payload"]).groupBy("host", "payload").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "events")))).alias("events"))
    keys = destinations.select("url", "key").agg(F.collect_list(F.struct("url", "key")).alias("ds"))
    body = F.to_json(F.struct(F.col("d.key").alias("apiKey"), "events", F.col("host").cast("string").alias("internalHostname")))
    return by_host.join(F.broadcast(keys), F.lit(True)).select("host", "payload", F.explode("ds").alias("d"), "events").select("host", "payload", "d.url", body.alias("body"))


def chunk_procs(procs: DataFrame, n: int = 100, keys: Sequence[str] = ("host", "snap_ts")) -> DataFrame:
    """K5: processes in chunks of `n`, with the number of chunks of their snapshot."""
    w = Window.partitionBy(*keys)
    return procs.withColumn("chunk", F.floor((F.row_number().over(w.orderBy("pid")) - 1) / n)).withColumn("group_size", F.ceil(F.count("*").over(w) / n))


def proc_stat_projection(procs: DataFrame) -> DataFrame:
    """the realtime columns of process rows."""
    wanted = ["host", "snap_ts", "pid", "create_time", "rss", "vms", "user_time", "system_time", "threads", "open_fd", "state", "read_count", "write_count", "read_bytes", "write_bytes", "vol_ctx", "invol_ctx"]
    return procs.select(*[c for c in wanted if c in procs.columns])


def destinations(primary: DataFrame, additional: DataFrame) -> DataFrame:
    """Distinct (url, key) pairs without blank keys, the primary one first, then by url and key.

    Both sides are configuration: a few rows.
    """
    both = primary.select("url", "key", F.lit(0).alias("rank")).unionByName(additional.select("url", "key", F.lit(1).alias("rank"))).filter(F.trim("key") != "")
    once = both.groupBy("url", "key").agg(F.min("rank").alias("rank"))
    return once.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("rank", "url", "key")))


def fan_out(primary: Callable[[DataFrame, int], None], others: dict[str, Callable[[DataFrame, int], None]], audit: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """K6: a foreachBatch function: the primary's failure fails the batch (and Spark retries it); the others' failures
    are only written to the audit."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        primary(batch, batch_id)
        for name, send in others.items():
            try:
                send(batch, batch_id)
            except Exception as e:  # noqa: BLE001 - best effort by contract
                audit(batch.sparkSession.createDataFrame([(batch_id, name, str(e)[:500])], "batch_id long, destination string, error string"))

    return deliver


def deliver_once(ledger: str, send: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """ST6, L5: a foreachBatch function that sends a batch and then notes its number, with the furthest place of each source it
    holds (where it has `source_id` and `offset`), in the ledger, a folder of JSON.

    A batch that is run again because the query stopped between the two is sent again under the same number: `send` must
    replace what it has sent under it, as `replace_batch` does. One that is in the ledger is not sent again.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema("batch_id long, source_id string, `offset` long").json(f"{ledger}/*")
            if not known.filter(F.col("batch_id") == batch_id).isEmpty():
                return
        except AnalysisException:  # there is no ledger yet
            pass
        send(batch, batch_id)
        note = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"))
        if {"source_id", "offset"} <= set(batch.columns):
            far = batch.groupBy(F.col("source_id").cast("string").alias("source_id")).agg(F.max("offset").cast("long").alias("offset"))
            note = note.unionByName(far.withColumn("batch_id", F.lit(batch_id).cast("long")), allowMissingColumns=True)
        note.write.mode("overwrite").json(f"{ledger}/batch={batch_id}")

    return deliver


def replace_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """A `send` that writes a batch as Parquet under its number, in place of an earlier try."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def registry_of(spark: SparkSession, ledger: str) -> DataFrame:
    """The places that a ledger tells were delivered: `(source_id, offset)`."""
    rows = spark.read.schema("batch_id long, source_id string, `offset` long").json(f"{ledger}/*")
    return rows.filter("source_id is not null").groupBy("source_id").agg(F.max("offset").alias("offset"))


def register_source(spark: SparkSession, name: str, fn: Callable[[dict], Iterable[tuple]], required: Sequence[str] = ()) -> None:
    """A source that SQL reads: `SELECT * FROM name(TABLE(targets))` calls `fn` on executors for each row of `targets`, as a dict,
    and gives `(source, metric, value, tags, error)` for each `(metric, value, tags)` it yields. What it yielded before it failed
    stays, and one more row tells the error; other targets go on. A metric that isn't text or a value that is no number is an error."""

    @udtf(returnType="source string, metric string, value double, tags array<string>, error string")
    class Source:
        def eval(self, row):
            try:
                target = row.asDict()
                if missing := [c for c in required if c not in target]:
                    raise ValueError(f"missing columns {missing}")
                for metric, value, tags in fn(target):
                    if not isinstance(metric, str):
                        raise TypeError(f"no metric name: {metric!r}")
                    yield name, metric, float(value), list(tags), None
            except Exception as e:  # noqa: BLE001 - sources fail alone
                yield name, None, None, None, f"{type(e).__name__}: {e}"[:500]

    spark.udtf.register(name, Source)


def dead_letter(batches: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K7: (delivered, dead, retry): permanently refused batches are dead, other failures are to be tried again."""
    j = batches.join(outcomes, "batch_id")
    ok = F.col("http_status") < 300
    return j.filter(ok), j.filter(~ok & is_permanent(F.col("http_status"))), j.filter(~ok & ~is_permanent(F.col("http_status")))


class Sources:
    """Named functions of the session that return series rows."""

    def __init__(self) -> None:
        self.named: dict[str, Callable] = {}

    def register(self, name: str, fn: Callable) -> None:
        self.named[name] = fn

    def collect(self, spark, required: Sequence[str] = ("metric", "value")) -> tuple[DataFrame | None, dict[str, str]]:
        """The union of all sources that can be planned, columns that one lacks being null, and why others can't."""
        out, failed = None, {}
        for name, fn in self.named.items():
            try:
                df = fn(spark)
                if missing := [c for c in required if c not in df.columns]:
                    raise ValueError(f"missing columns {missing}")
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
            except Exception as e:  # noqa: BLE001 - sources fail alone
                failed[name] = str(e)
        return out, failed
