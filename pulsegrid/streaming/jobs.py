"""Streaming forms of the flush, of log assembly and of counter rates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.columns import canonical_tags, effective_value, finite
from ..functions.patterns import to_java
from ..operators.flush import finish
from ..operators.logs import CAP, Rule, apply_rules, with_defaults


#: The state store that ST4 and ST5 need: `spark.sql.streaming.stateStore.providerClass` of the session that starts them.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Binary logarithm of the registers of a distinct count; its standard error is 1.04 / sqrt(registers), 1.6 %.
REGISTERS = 12


def bucket_value(v: Column, relative_error: float) -> Column:
    """The value that stands for all in v's bucket. Buckets grow by the factor (1 + e) / (1 - e), so that it is within the relative
    error e of each of them; 0 stands for itself. Sums over buckets merge, and a range of values has few."""
    growth = (1 + relative_error) / (1 - relative_error)
    at = F.ceil(F.log(F.abs(v)) / F.lit(math.log(growth)))
    return F.when(v == 0, v).otherwise(F.signum(v) * F.pow(F.lit(growth), at) * F.lit(2 / (growth + 1)))


def stream_metrics(samples: DataFrame, interval: int = 15, watermark: str = "1 minute", relative_error: float | None = None) -> DataFrame:
    """ST1: the flush of gauges, counters, histograms and sets over event time, in append mode.

    A context's samples are pre-summed by value, then by context; late rows beyond the watermark are dropped by Spark
    and counted in the query's progress (ST2). Closed windows only; the last open ones need a closing event (ST3).

    The exact form holds each distinct value and member of a context. With a `relative_error` its state is bounded: medians
    and 95th percentiles are taken over buckets and are within that error, distinct members are counted by a sketch of
    2**REGISTERS registers. Counts, averages, maxima, gauges and rates stay exact.
    """
    sketch = relative_error is not None
    ev = effective_value(F.col("type"), F.col("value"), F.col("sample_rate"))
    p = samples.filter("type <> 'distribution'").withColumn("_e", ev).withColumns({"v": F.col("_e.value"), "w": F.col("_e.weight"), "tag_key": canonical_tags(F.col("tags"))}).filter((F.col("type") == "set") | (finite(F.col("v")) & finite(F.col("w"))))
    keys = ["host", "name", "type", "tag_key"]
    held = bucket_value(F.col("v"), relative_error) if sketch else F.col("v")
    cell = F.when(F.col("type").isin("histogram", "timing"), held)
    is_set = F.col("type") == "set"
    item = F.lit(None).cast("string") if sketch else F.when(is_set, F.col("member"))
    extra = [F.sum(F.col("v") * F.col("w")).alias("vw"), F.max("v").alias("top"), F.hll_sketch_agg(F.when(is_set, F.col("member")), REGISTERS).alias("hll")] if sketch else []
    one = p.withWatermark("ts", watermark).groupBy(F.window("ts", f"{max(interval, 1)} seconds").alias("win"), *keys, cell.alias("cell"), item.alias("item")).agg(
        F.sum("w").alias("w"), F.sum("v").alias("sum"), F.max(F.struct("ts", "seq", "v")).alias("last"), F.min(F.struct("ts", "seq", "tags")).alias("first"), *extra)
    merged = [F.sum("vw").alias("vw"), F.max("top").alias("top"), F.hll_union_agg("hll").alias("hll")] if sketch else []
    two = one.groupBy(F.window(F.window_time("win"), f"{max(interval, 1)} seconds").alias("w2"), *keys).agg(F.sum("sum").alias("sum"), F.max("last").alias("last"), F.min("first").alias("first"), F.count("item").alias("members"), F.array_sort(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "w")))).alias("cells"), *merged)
    total = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["w"])

    def rank(target):
        seen = F.aggregate("cells", F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("v")), lambda a, x: F.struct((a["c"] + x["w"]).alias("c"), F.when(a["v"].isNull() & (a["c"] + x["w"] > target), x["cell"]).otherwise(a["v"]).alias("v")), lambda a: a["v"])
        return F.coalesce(seen, F.element_at("cells", -1)["cell"])

    item = lambda suffix, kind, v: F.struct(F.lit(suffix).alias("suffix"), F.lit(kind).alias("kind"), v.cast("double").alias("value"))
    weighted = F.col("vw") if sketch else F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["cell"] * x["w"])
    top = F.col("top") if sketch else F.try_element_at("cells", F.lit(-1))["cell"]
    members = F.hll_sketch_estimate("hll") if sketch else F.col("members")
    hist = F.array(item(".count", "rate", total / max(interval, 1)), item(".avg", "gauge", weighted / total), item(".median", "gauge", rank((total - 1) / 2)), item(".max", "gauge", top), item(".95percentile", "gauge", rank((95 * total - 1) / 100)))
    rows = F.when(F.col("type") == "gauge", F.array(item("", "gauge", F.col("last.v")))).when(F.col("type") == "counter", F.array(item("", "rate", F.col("sum") / max(interval, 1)))).when(F.col("type") == "set", F.array(item("", "gauge", members))).otherwise(hist)
    return two.select("host", F.unix_timestamp("w2.end").alias("window_end"), "name", F.col("first.tags").alias("tags"), F.inline(rows)).select("host", "window_end", F.concat("name", "suffix").alias("metric"), F.col("kind").alias("type"), "tags", "value")


#: Groups that the sources of a stream are dealt into; a group's batch is one call, and its state one list.
DEALT = 1024


class _Messages(StatefulProcessor):
    """The open messages of a group of sources, as a list, and a timer that closes those whose time is up first."""

    def __init__(self, place: str, timeout_ms: int, cap: int):
        self.place, self.timeout_ms, self.cap = place, timeout_ms, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", f"source_id string, offset {self.place}, us long, message string, size long, until long")

    def _keep(self, held: list[tuple]) -> None:
        if held:
            self.open.put(held)
            self.handle.registerTimer(min(x[-1] for x in held))
        else:
            self.open.clear()

    def _made(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["source_id", "offset", "us", "message"]).astype({"us": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("offset", kind="stable")
        until = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
        # of each source: last offset and time, lines, bytes, and until when it waits
        held = {x[0]: [x[1], x[2], [x[3]], x[4], x[5]] for x in map(tuple, self.open.get())}
        done = []
        us = [None if x is None or x != x else int(x) for x in new["us"].tolist()]
        for source, at, when, line, size, start in zip(new["source_id"].tolist(), new["offset"].tolist(), us, new["line"].tolist(), new["size"].tolist(), new["start"].tolist()):
            group = held.get(source)
            if group and start:
                done.append((source, group[0], group[1], "\n".join(group[2])))
                group = None
            if not group:
                group = held[source] = [at, when, [], 0, until]
            group[0], group[1], group[4] = int(at), when, until
            group[2].append(line)
            group[3] += size
            if group[3] > self.cap:
                done.append((source, group[0], group[1], "\n".join(group[2])))
                del held[source]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._keep([(source, x[0], x[1], "\n".join(x[2]), int(x[3]), x[4]) for source, x in held.items()])
        if done:
            yield self._made(done)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = [tuple(x) for x in self.open.get()], timerValues.getCurrentProcessingTimeInMs()
        self._keep([x for x in held if x[-1] > now])
        if done := [x[:4] for x in held if x[-1] <= now]:
            yield self._made(done)

    def close(self) -> None:
        pass


def stream_multiline(lines: DataFrame, pattern: str, timeout_ms: int = 1000, cap: int = CAP, dealt: int = DEALT) -> DataFrame:
    """ST4: multi-line assembly with a state by source: its open message, gone as soon as it is closed.

    A start line, the size cap or an idle time without lines closes a group; the idle time runs on the clock, for each source
    by itself. Which lines are starts is told in SQL, by the same pattern as in the batch form. Null lines are empty.

    Sources are `dealt` into groups, each of which is called once a batch: a call for each source would cost more than its
    lines. A stream that is started again must have the same number.
    """
    start = F.coalesce(F.col("line").rlike(r"\A(?:" + (to_java(pattern) or "") + ")"), F.lit(False))
    line = F.coalesce("line", F.lit(""))
    marked = lines.select(F.pmod(F.xxhash64("source_id"), F.lit(dealt)).cast("int").alias("dealt"), F.col("source_id").cast("string").alias("source_id"), "offset", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), line.alias("line"), (F.octet_length(line) + 1).alias("size"), start.alias("start"))
    kinds = {c: lines.schema[c].dataType.simpleString() for c in ("source_id", "offset")}
    out = f"source_id string, offset {kinds['offset']}, us long, message string"
    made = marked.groupBy("dealt").transformWithStateInPandas(_Messages(kinds["offset"], timeout_ms, cap), out, "Append", "ProcessingTime")
    return made.select(F.col("source_id").cast(kinds["source_id"]).alias("source_id"), "offset", F.timestamp_micros("us").alias("ts"), "message")


#: Milliseconds after which the state of a host without news is dropped.
GONE_MS = 3_600_000


#: Parts that the entities of a host are dealt into, each with a state of its own.
PARTS = 64


class _Snapshots(StatefulProcessor):
    """Rows of the last two snapshots of a part of a host, so that rows of the last one that come in a later batch still find the
    one before. Entities that are in neither are dropped at once, hosts without news when their rows expire. A row with `mark`
    stands for the time of a snapshot, which may have no other row in this part."""

    def __init__(self, cols: Sequence[str], rates: Callable[[pd.DataFrame], pd.DataFrame], gone_ms: int, pin: Callable[[pd.DataFrame], pd.DataFrame] = lambda rows: rows):
        self.cols, self.rates, self.gone_ms, self.pin = list(cols), rates, gone_ms, pin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "us long, entity string, mark boolean, " + ", ".join(f"`{c}` double" for c in self.cols), ttlDurationMs=self.gone_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        names = ["us", "entity", "mark", *self.cols]
        held = pd.DataFrame([tuple(x) for x in self.rows.get()], columns=names)
        new = pd.concat(list(rows))[names]
        if len(held):
            new = new[new["us"] >= held["us"].max()]
        if not len(new):
            return
        both = pd.concat([x.assign(new=k) for k, x in enumerate((held, new)) if len(x)], ignore_index=True)
        both = both.astype({"mark": bool}).drop_duplicates(["us", "entity", "mark"], keep="last").sort_values("us", kind="stable")
        times = both["us"].drop_duplicates()
        last = both["us"].isin(times.tolist()[-2:]) & both["mark"]
        marks = both.loc[last, names]
        both = both[~both["mark"]].assign(at=lambda x: x["us"].map(dict(zip(times.tolist(), range(len(times))))))
        both = self.pin(both)
        now = both[both["new"] == 1]
        pairs = now.merge(both.drop(columns=["new", "mark"]).assign(at=both["at"] + 1), how="left", on=["entity", "at"], suffixes=("", "_old"))
        pairs["seconds"] = (pairs["us"] - pairs["us_old"]) / 1e6
        kept = pd.concat([marks, both.loc[both["at"] >= len(times) - 2, names]]).astype({"us": "int64"})
        self.rows.put([(*x[:2], bool(x[2]), *x[3:]) for x in kept.itertuples(index=False, name=None)])
        made = self.rates(pairs) if len(pairs) else pairs
        if len(made):
            made.insert(0, "host", key[0])
            yield made

    def close(self) -> None:
        pass


def _with_marks(rows: DataFrame, parts: int) -> DataFrame:
    """`rows` with `part`, that of the entity, and a marked row in each part of a host for each of its times. A task holds the times
    that it has met."""
    dealt = rows.filter("us is not null").select("host", F.pmod(F.xxhash64("entity"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("mark"), *[c for c in rows.columns if c != "host"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple] = set()
        for b in batches:
            yield b
            pairs = pa.table({"host": b.column("host"), "us": b.column("us")}).group_by(["host", "us"]).aggregate([]).to_pylist()
            news = [x for x in map(tuple, map(dict.values, pairs)) if x not in met]
            met.update(news)
            for at in range(0, len(news), 100):
                some = [(*x, True) for x in news[at : at + 100]]
                cols = {n: pa.array(c, b.schema.field(n).type).take(pa.array(np.repeat(np.arange(len(some)), parts))) for n, c in zip(("host", "us", "mark"), zip(*some))}
                cols["part"] = pa.array(np.tile(np.arange(parts, dtype=np.int32), len(some)))
                yield pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(parts * len(some), f.type)) for f in b.schema], schema=b.schema)

    return dealt.mapInArrow(run, dealt.schema)


def stream_counter_rate(snapshots: DataFrame, entity: str, ts: str, cols: Sequence[str], policy: str = "skip", gone_ms: int = GONE_MS, parts: int = PARTS) -> DataFrame:
    """ST5: rates of a stream of counter snapshots; the state of a host is its last two snapshots, so a snapshot may come in
    parts; it expires `gone_ms` after the host's last news. Rows of a snapshot older than the last one are late and give
    nothing, as rows without a time; of equal entities in a snapshot the last counts.

    The entities of a host are dealt into `parts`, so that neither its state nor its batch is one task's; the times of its
    snapshots go to all of them. A stream that is started again must have the same number."""
    rows = snapshots.select("host", F.col(entity).cast("string").alias("entity"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), *[F.col(c).cast("double").alias(c) for c in cols])

    def rates(pairs: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for c in cols:
            delta = pairs[c] - pairs[f"{c}_old"]
            made = pd.DataFrame({"entity": pairs["entity"], "us": pairs["us"], "counter": c, "rate": delta.clip(lower=0.0) / pairs["seconds"]})
            parts.append(made[(delta >= 0) | (delta.notna() & (policy == "clamp"))])
        return pd.concat(parts)

    made = _with_marks(rows, parts).groupBy("host", "part").transformWithStateInPandas(_Snapshots(cols, rates, gone_ms), "host string, entity string, us long, counter string, rate double", "Append", "ProcessingTime")
    return made.select("host", F.col("entity").alias(entity), F.timestamp_micros("us").alias("ts"), "counter", "rate")


def stream_proc_rates(procs: DataFrame, ts: str = "snap_ts", slack_ms: int = 2000, counters: Sequence[str] = ("read_count", "write_count", "read_bytes", "write_bytes"), gone_ms: int = GONE_MS, parts: int = PARTS) -> DataFrame:
    """ST5, W11, W12 on a stream: the create time that each process keeps, CPU percentages and I/O rates, 0 where it is new
    or a counter went back. State and parts are as in `stream_counter_rate`; processes that have ended leave it."""
    cols = ["create_time", "user_time", "system_time", *counters]
    names = {"user_time": "user_pct", "system_time": "system_pct"} | {c: f"{c}_s" for c in counters}
    rows = procs.select("host", F.col("pid").cast("string").alias("entity"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), *[F.col(c).cast("double").alias(c) for c in cols])

    def pin(both: pd.DataFrame) -> pd.DataFrame:
        """The kept create times, snapshot by snapshot; rows of the state have theirs already, and keep them."""
        last: dict[str, tuple[int, float]] = {}
        kept = []
        for at, entity, made in zip(both["at"].tolist(), both["entity"].tolist(), both["create_time"].tolist()):
            before, was = last.get(entity, (-2, made))
            made = was if before == at - 1 and abs(was - made) < slack_ms else made
            last[entity] = (at, made)
            kept.append(made)
        return both.assign(create_time=kept)

    def rates(pairs: pd.DataFrame) -> pd.DataFrame:
        same = pairs["create_time_old"] == pairs["create_time"]
        out = pd.DataFrame({"pid": pairs["entity"].astype("int64"), "us": pairs["us"], "pinned": pairs["create_time"].astype("int64")})
        for c, name in names.items():
            rate = (pairs[c] - pairs[f"{c}_old"]).clip(lower=0.0) / pairs["seconds"]
            out[name] = (100 * rate if name.endswith("_pct") else rate).where(same & rate.notna(), 0.0)
        return out

    made = _with_marks(rows, parts).groupBy("host", "part").transformWithStateInPandas(_Snapshots(cols, rates, gone_ms, pin), "host string, pid long, us long, pinned long, " + ", ".join(f"{n} double" for n in names.values()), "Append", "ProcessingTime")
    return made.withColumn("total_pct", F.col("user_pct") + F.col("system_pct")).withColumn(ts, F.timestamp_micros("us")).drop("us")


def stream_series(samples: DataFrame, interval: int = 15, watermark: str = "1 minute", host: str = "", global_tags: Sequence[str] = (), relative_error: float | None = None) -> DataFrame:
    """ST1 with F5-F7: the flush on a stream as series rows, with default fields, global tags and devices."""
    return finish(stream_metrics(samples, interval, watermark, relative_error), interval, host, global_tags)


def stream_logs(lines: DataFrame, rules: Sequence[Rule], service: str = "", source: str = "", timeout_ms: int = 1000, host: str = "", tags: Sequence[str] = (), global_tags: Sequence[str] = ()) -> DataFrame:
    """ST6: L2 on a line stream: the last multi_line rule assembles, the others apply in order; host, tags and global tags as
    F5 and F6 have them. The query's checkpoint is the registry of read positions; sinks.deliver_once keeps one of what was
    delivered."""
    multi = [r for r in rules if r.type == "multi_line" and to_java(r.pattern)]
    rows = stream_multiline(lines, multi[-1].pattern, timeout_ms) if multi else lines.select("source_id", "offset", "ts", F.col("line").alias("message"))
    kept = apply_rules(rows, [r for r in rules if r.type != "multi_line"])
    rows = kept.select("message", F.lit("info").alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.lit("").alias("hostname"), F.lit(service).alias("service"), F.lit(source).alias("ddsource"), F.lit(",".join(tags)).alias("ddtags"), "source_id", "offset")
    return with_defaults(rows, host, global_tags)


class BatchCounts(StreamingQueryListener):
    """ST2, ST7: a row for each batch of the streams of a session: what came in, what was too late for a watermark, and what
    `counted` observed. Add it with `spark.streams.addListener`."""

    def __init__(self) -> None:
        self.rows: dict[tuple[str, int], tuple[int, int, dict[str, int]]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        seen = {f"{name}.{k}": int(v or 0) for name, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        self.rows[str(p.runId), p.batchId] = (p.numInputRows, sum(s.numRowsDroppedByWatermark for s in p.stateOperators), seen)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.ended.add(str(event.runId))

    def table(self, spark: SparkSession) -> DataFrame:
        """`(run, batch_id, input_rows, late_rows, counts)`. Late rows are counted behind a partial aggregation, where a batch's late
        samples of one context and window are one."""
        rows = [(run, batch, *values) for (run, batch), values in sorted(self.rows.items())]
        return spark.createDataFrame(rows, "run string, batch_id long, input_rows long, late_rows long, counts map<string,long>")


def counted(df: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """`df`, of which each batch tells its rows and those that meet each condition."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def deliver(stream: DataFrame, folder: str, send: Callable[[DataFrame, int], None]) -> None:
    """ST6: give all that a stream has now to `send`, batch by batch, with the checkpoint in `folder`. A failure of `send` ends it;
    the next call goes on with the batch that failed, which has the same number and the same rows."""
    run_all(stream, folder, lambda writer: writer.foreachBatch(send))

def drain(stream: DataFrame, folder: str) -> DataFrame:
    """ST3: run a stream over all that is there now, with its checkpoint in `folder`, and return what it has written.

    Batches without data, which a state with a clock asks for without end, are switched off for it; windows that only a
    later sample closes stay open. State is kept where timers and expiry are possible.
    """
    run_all(stream, folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_all(stream: DataFrame, folder: str, sink: Callable[[DataStreamWriter], DataStreamWriter] | None = None) -> StreamingQuery:
    """Run a stream over all that is there now, into `sink`, by default Parquet in `folder`, and return the ended query."""
    sink = sink or (lambda writer: writer.format("parquet").option("path", f"{folder}/out"))
    conf = stream.sparkSession.conf
    wanted = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    was = {k: conf.get(k) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        query = sink(stream.writeStream).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        for k, v in was.items():
            conf.set(k, v)
    query.awaitTermination()
    return query
