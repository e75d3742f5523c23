"""Log rules, multi-line assembly, log and journal pipelines, resume positions."""

from __future__ import annotations

import logging
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.columns import append_global_tags, empty, journal_body, journal_drop, journal_include, journal_service, journal_status
from ..functions.patterns import compiled, replacement, to_java
from ..sources.journal import parse_journal

CAP = 262_144
#: Offsets of a source that one task puts in order.
SPAN = 1 << 20


@dataclass(frozen=True)
class Rule:
    """type: mask_sequences, exclude_at_match, include_at_match or multi_line."""

    type: str
    pattern: str
    placeholder: str = ""


def mask_sequences(content: Column, pattern: str, placeholder: str) -> Column:
    """F8: every match replaced; `content` should be a column, as it may be looked at before it is searched."""
    p = compiled(pattern)
    masked = F.regexp_replace(content, p.replacing, replacement(placeholder, pattern))
    return F.when(F.contains(content, F.lit(p.needs)), masked).otherwise(content) if p.needs else masked


def apply_rules(df: DataFrame, rules: Sequence[Rule], col: str = "message") -> DataFrame:
    """The rules in their order; ones the dialect doesn't compile, or of unknown types, are skipped. Null messages go
    where a rule filters.

    Each rule works on the column as the one before left it, so that no text is masked twice: an excluded message is null
    from then on. The filter at the end stands behind an explode, through which it isn't pushed.
    """
    filters = False
    for r in rules:
        java = to_java(r.pattern)
        if java is None or r.type not in ("mask_sequences", "exclude_at_match", "include_at_match", "multi_line"):
            logging.getLogger(__name__).warning("skipped rule %s %r", r.type, r.pattern)
        elif r.type == "mask_sequences":
            df = df.withColumn(col, mask_sequences(F.col(col), r.pattern, r.placeholder))
        elif r.type != "multi_line":
            hit = F.col(col).rlike(java)
            df, filters = df.withColumn(col, F.when(hit if r.type == "include_at_match" else ~hit, F.col(col))), True
    if not filters:
        return df
    kept = df.select(*[c for c in df.columns if c != col], F.explode_outer(F.array(col)).alias(col)).filter(F.col(col).isNotNull())
    return kept.select(*df.columns)


def _blocks(lines: DataFrame, pattern: str, timeout: float | None, span: int) -> DataFrame:
    """Add `_block`, the stretch of `span` offsets a line lies in, and `_r`, how many groups were opened in it so far. The first
    line of a block isn't compared with the one before it."""
    w = Window.partitionBy("source_id", "_block").orderBy("offset")
    start = F.coalesce(F.col("line").rlike(r"\A(?:" + (to_java(pattern) or "") + ")"), F.lit(False))
    dealt = lines.withColumns({"_block": F.floor(F.col("offset") / span), "_start": start})
    if timeout is not None:
        dealt = dealt.withColumn("_start", F.col("_start") | F.coalesce(F.col("ts").cast("double") - F.lag("ts").over(w).cast("double") >= timeout, F.lit(False)))
    return dealt.withColumn("_r", F.sum(F.col("_start").cast("long")).over(w)).drop("_start")


def _group_parts(lines: DataFrame, pattern: str, timeout: float | None, span: int) -> DataFrame:
    """`(source_id, _block, _r, _before, gid, bytes)`: one row for each part of a group in a block, without its text, numbered
    through its source. Blocks, not lines, of a source are put in order: _before groups were open when a block begins."""
    part = _blocks(lines, pattern, timeout, span).groupBy("source_id", "_block", "_r").agg(F.sum(F.octet_length(F.coalesce("line", F.lit(""))) + 1).alias("bytes"), F.min_by("ts", "offset").alias("first"), F.max_by("ts", "offset").alias("last"))
    # parts of a block stand in order; the first of them may be opened by the time since the block before
    w = Window.partitionBy("source_id", "_block").orderBy("_r")
    part = part.withColumns({"_n": F.row_number().over(w), "_top": F.max("_r").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_end": F.last("last").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    block = part.filter("_n = 1")
    source = Window.partitionBy("source_id").orderBy("_block")
    idle = F.lit(0) if timeout is None else F.coalesce((F.col("first").cast("double") - F.lag("_end").over(source).cast("double") >= timeout) & (F.col("_r") == 0), F.lit(False)).cast("int")
    block = block.withColumn("_idle", idle).withColumn("_before", F.sum(F.col("_top") + F.col("_idle")).over(source) - F.col("_top"))
    return part.select("source_id", "_block", "_r", "bytes").join(block.select("source_id", "_block", "_before"), ["source_id", "_block"]).withColumn("gid", F.col("_before") + F.col("_r"))


def line_groups(lines: DataFrame, pattern: str, timeout: float | None = 1.0, span: int = SPAN) -> DataFrame:
    """Add `gid`: a line that matches at its start, or comes `timeout` seconds after the last one, opens a group.

    A source is spread over tasks: its lines are numbered in blocks of `span` offsets each, the blocks' counts and last
    times are carried from block to block, and go back to the lines. Offsets of a source must differ.
    """
    before = _group_parts(lines, pattern, timeout, span).select("source_id", "_block", "_before").distinct()
    return _blocks(lines, pattern, timeout, span).join(before, ["source_id", "_block"]).withColumn("gid", F.col("_before") + F.col("_r")).select(*lines.columns, "gid")


def assemble_multiline(lines: DataFrame, pattern: str, timeout: float | None = 1.0, cap: int = CAP, span: int = SPAN) -> DataFrame:
    """L1: `(source_id, offset, ts, message)`; offset and ts are the last line's.

    A group whose lines with their newlines pass `cap` bytes closes right after the line that does so, and a new one goes
    on. Groups of up to `cap` bytes are gathered as they are. Longer ones are first cut in `_cut_long`, block by block,
    so that neither a source nor a group is one task's.
    """
    parts = _group_parts(lines, pattern, timeout, span).withColumn("all", F.sum("bytes").over(Window.partitionBy("source_id", "gid")))
    # a block has few long parts: each but the first and last is longer than `cap`
    known = parts.groupBy("source_id", "_block").agg(F.first("_before").alias("_before"), F.collect_list(F.when(F.col("all") > cap, F.col("_r"))).alias("_long"))
    rows = _blocks(lines, pattern, timeout, span).select("source_id", "_block", "_r", "offset", "ts", "line")
    long = F.array_contains("_long", F.col("_r"))
    short = rows.join(known, ["source_id", "_block"]).filter(~long).select("source_id", (F.col("_before") + F.col("_r")).alias("piece"), "offset", "ts", "line")
    over = rows.join(known.filter(F.size("_long") > 0), ["source_id", "_block"]).filter(long).select("source_id", (F.col("_before") + F.col("_r")).alias("gid"), "_block", "offset", "ts", "line")

    def joined(x: DataFrame) -> DataFrame:
        in_order = F.array_sort(F.collect_list(F.struct("offset", F.coalesce("line", F.lit("")).alias("line"))))
        made = x.groupBy("source_id", "piece").agg(F.max("offset").alias("offset"), F.max_by("ts", "offset").alias("ts"), in_order.alias("lines"))
        return made.select("source_id", "offset", "ts", F.array_join(F.transform("lines", lambda y: y["line"]), "\n").alias("message"))

    return joined(short).unionByName(joined(_cut_long(over, cap)))


def _cut_long(rows: DataFrame, cap: int) -> DataFrame:
    """`(source_id, piece, offset, ts, line)`: lines of long groups with the offset at which their piece begins.

    Where a block's first cut falls depends on the bytes that are open when it begins, all later ones on the first. So each
    block lists its possible first cuts (those in its first `cap` bytes) with what is open at its end after each. That
    list is all that is run through in order of blocks, to find what is open at the beginning of each; then every block
    cuts its lines by itself. A task holds one block's sizes at a time.
    """
    size = F.octet_length(F.coalesce("line", F.lit(""))) + 1
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    group = f"source_id {kinds['source_id']}, gid long"
    place = kinds["offset"]

    def same(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list]]:
        """Rows of neighbouring equal keys, the first `width` columns."""
        key, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:width] != key:
                    if held:
                        yield key, held
                    key, held = row[:width], []
                held.append(row[width:])
        if held:
            yield key, held

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in same(batches, 3):
            at, sizes = zip(*held)
            sums = [0, *accumulate(sizes)]
            n = len(sizes)
            after: list[tuple[int, int | None]] = [(0, None)] * (n + 1)  # open at the end if a piece begins at line i
            for i in range(n - 1, -1, -1):
                j = bisect_right(sums, sums[i] + cap)
                after[i] = after[j] if j <= n else (sums[n] - sums[i], at[i])
            cuts = [j for j in range(1, n + 1) if sums[j - 1] <= cap]
            cols = [[key[0]], [key[1]], [key[2]], [at[0]], [sums[n]], [[sums[j] for j in cuts]], [[after[j][0] for j in cuts]], [[after[j][1] for j in cuts]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["source_id", "gid", "_block", "first", "bytes", "sums", "open", "begun"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, begun = None, 0, None
        for b in batches:
            out = []
            for source, gid, block, first, size, sums, opened, begins in zip(*(c.to_pylist() for c in b.columns)):
                if (source, gid) != key:
                    key, held, begun = (source, gid), 0, None
                out.append((source, gid, block, held, begun))
                j = bisect_right(sums, cap - held)
                begun = first if not held else begun
                held, begun = (opened[j], begins[j]) if j < len(sums) else (held + size, begun)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*types[:3], pa.int64(), types[3]])], names=["source_id", "gid", "_block", "open", "begun"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, piece = None, 0, None
        for b in batches:
            pieces = []
            for *now, offset, size, opened, begun in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5, 6))):
                if now != key:
                    key, held, piece = now, opened, begun
                piece = offset if not held else piece
                held += size
                pieces.append(piece)
                held = 0 if held > cap else held
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces, b.schema.field(3).type), b.column(3), b.column(7), b.column(8)], names=["source_id", "piece", "offset", "ts", "line"])

    types = [to_arrow_type(rows.schema["source_id"].dataType), pa.int64(), pa.int64(), to_arrow_type(rows.schema["offset"].dataType), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(to_arrow_type(rows.schema["offset"].dataType))]
    order = ["source_id", "gid", "_block"]
    sized = rows.select(*order, "offset", size.cast("long").alias("size")).repartition(*order).sortWithinPartitions(*order, "offset")
    tables = sized.mapInArrow(table, f"{group}, _block long, first {place}, bytes long, sums array<long>, open array<long>, begun array<{place}>")
    opened = tables.repartition("source_id", "gid").sortWithinPartitions(*order).mapInArrow(carry, f"{group}, _block long, open long, begun {place}")
    full = rows.withColumn("size", size.cast("long")).join(opened, order).repartition(*order).sortWithinPartitions(*order, "offset")
    return full.select(*order, "offset", "size", "open", "begun", "ts", "line").mapInArrow(cut, f"source_id {kinds['source_id']}, piece {place}, offset {place}, ts {kinds['ts']}, line string")


def process_logs(lines: DataFrame, rules: Sequence[Rule] = (), service: str = "", source: str = "", tags: Sequence[str] = (), host: str = "") -> DataFrame:
    """L2: lines to log rows; the last multi_line rule assembles, the others apply in order."""
    multi = [r for r in rules if r.type == "multi_line" and to_java(r.pattern)]
    rows = assemble_multiline(lines, multi[-1].pattern) if multi else lines.select("source_id", "offset", "ts", F.col("line").alias("message"))
    kept = apply_rules(rows, [r for r in rules if r.type != "multi_line"])
    return kept.select("message", F.lit("info").alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.lit(host).alias("hostname"), F.lit(service).alias("service"), F.lit(source).alias("ddsource"), F.lit(",".join(tags)).alias("ddtags"), "source_id", "offset")


def process_journal(lines: DataFrame, rules: Sequence[Rule] = (), service: str = "", source: str = "", tags: Sequence[str] = (), host: str = "", include: dict | None = None, exclude: dict | None = None) -> DataFrame:
    """L3: journal lines to log rows."""
    e = parse_journal(lines)
    f = F.col("fields")
    rows = e.filter(journal_include(f, **(include or {})) & ~journal_drop(f, **(exclude or {})))
    rows = apply_rules(rows.withColumn("message", journal_body(f)), [r for r in rules if r.type != "multi_line"])
    name = journal_service(f, service)
    return rows.select("message", journal_status(F.try_element_at(f, F.lit("PRIORITY"))).alias("status"), F.when(F.col("realtime") > 0, F.floor(F.col("realtime") / 1000)).otherwise(0).alias("timestamp"), F.lit(host).alias("hostname"), name.alias("service"), (F.lit(source) if source else name).alias("ddsource"), F.lit(",".join(tags)).alias("ddtags"), "cursor")


def resume(lines: DataFrame, registry: DataFrame, start_position: str = "end") -> DataFrame:
    """L4: lines past the registered offset. An unknown source starts at its end (or at 0); an offset beyond the file's
    size, or a newer generation, starts at 0."""
    size = lines.groupBy("source_id", "generation").agg(F.max("offset").alias("_size"))
    reg = registry.select("source_id", F.col("generation").alias("_g"), F.col("offset").alias("_o"))
    first = F.col("_size") if start_position == "end" else F.lit(0)
    start = F.when(F.col("_o").isNull(), first).when((F.col("_g") < F.col("generation")) | (F.col("_o") > F.col("_size")), 0).otherwise(F.col("_o"))
    starts = size.join(reg, "source_id", "left").withColumn("_start", start).select("source_id", "generation", "_start")
    return lines.join(starts, ["source_id", "generation"]).filter(F.col("offset") > F.col("_start")).drop("_start")


def advance(registry: DataFrame, delivered: DataFrame) -> DataFrame:
    """The registry moved to the furthest delivered place of each source; a new generation may rewind it."""
    far = delivered.groupBy("source_id").agg(F.max(F.struct("generation", "offset")).alias("d"))
    r = registry.select("source_id", F.struct("generation", "offset").alias("r"))
    best = F.greatest("r", "d")
    return r.join(far, "source_id", "full_outer").select("source_id", best["generation"].alias("generation"), best["offset"].alias("offset"))


def advance_cursors(registry: DataFrame, delivered: DataFrame) -> DataFrame:
    """L5 for journals: the cursor delivered last (by `seq`) of each source replaces the registered one; cursors can't be
    compared, and empty ones move nothing."""
    last = delivered.filter("cursor <> ''").groupBy("source_id").agg(F.max_by("cursor", "seq").alias("_new"))
    return registry.join(last, "source_id", "full_outer").select("source_id", F.coalesce("_new", "cursor").alias("cursor"))


def with_defaults(logs: DataFrame, host: str, global_tags: Sequence[str] = ()) -> DataFrame:
    """F5, F6 for log rows."""
    tags = F.array_join(append_global_tags(F.filter(F.split(F.coalesce("ddtags", F.lit("")), ","), lambda t: t != ""), global_tags), ",")
    return logs.withColumns({"status": empty(F.col("status"), F.lit("info")), "hostname": empty(F.col("hostname"), F.lit(host)), "ddtags": tags})
