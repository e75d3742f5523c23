"""Tumbling metric flushes: last values, rates, weighted quantiles, distinct members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import append_global_tags, canonical_tags, device_of, effective_value, empty, finite, metric_key, tags_without_device

KEY = ["host", "window_end", "name", "type", "tag_key"]


def prepare(samples: DataFrame, interval: int = 15) -> DataFrame:
    """Effective values and weights, no distributions, no non-finite numbers, window and identity columns."""
    step = max(int(interval), 1)
    ev = effective_value(F.col("type"), F.col("value"), F.col("sample_rate"))
    return (
        samples.filter("type <> 'distribution'")
        .withColumn("_e", ev).withColumns({"v": F.col("_e.value"), "w": F.col("_e.weight")}).drop("_e")
        .filter((F.col("type") == "set") | (finite(F.col("v")) & finite(F.col("w"))))
        .withColumn("window_end", (F.floor(F.unix_timestamp("ts") / step) + 1) * step)
        .withColumn("tag_key", canonical_tags(F.col("tags")))
    )


def weighted_quantile(df: DataFrame, keys: Sequence[str], value: str, weight: str, ranks: dict[str, Column]) -> DataFrame:
    """For each key the first value, ascending, whose running weight exceeds each rank; the largest one failing that.

    Equal values are summed before the sort, so that a hot key sorts its distinct values only. `ranks` are columns
    over W, the key's whole weight.
    """
    summed = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    by = Window.partitionBy(*keys)
    run = summed.withColumn("_c", F.sum("_w").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("W", F.sum("_w").over(by))
    return run.groupBy(*keys).agg(*[F.coalesce(F.min(F.when(F.col("_c") > r, F.col(value))), F.max(value)).alias(n) for n, r in ranks.items()], F.max(value).alias("max"), F.sum("_w").alias("weight"), F.sum(F.col(value) * F.col("_w")).alias("weighted"))


def first_tags(prepared: DataFrame) -> Column:
    return F.min_by("tags", F.struct("ts", "seq")).alias("tags")


def flush_simple(prepared: DataFrame, interval: int = 15) -> DataFrame:
    """A1, A2: gauges (last value) and counters (sum of scaled values per second) in one aggregation."""
    p = prepared.filter(F.col("type").isin("gauge", "counter"))
    out = p.groupBy(*KEY).agg(F.max_by("v", F.struct("ts", "seq")).alias("last"), F.sum("v").alias("sum"), first_tags(p))
    return out.select("host", "window_end", F.col("name").alias("metric"), F.when(F.col("type") == "gauge", "gauge").otherwise("rate").alias("type"), "tags", F.when(F.col("type") == "gauge", F.col("last")).otherwise(F.col("sum") / max(interval, 1)).alias("value"))


def flush_histogram(prepared: DataFrame, interval: int = 15) -> DataFrame:
    """A3: count, avg, median, max and 95percentile of histograms and timings, each family its own context."""
    p = prepared.filter(F.col("type").isin("histogram", "timing"))
    q = weighted_quantile(p, KEY, "v", "w", {"median": (F.col("W") - 1) / 2, "p95": (95 * F.col("W") - 1) / 100})
    tags = p.groupBy(*KEY).agg(first_tags(p))
    wide = q.join(tags, KEY)
    part = lambda suffix, kind, value: F.struct(F.lit(suffix).alias("suffix"), F.lit(kind).alias("kind"), value.alias("value"))
    parts = F.array(part(".count", "rate", F.col("weight") / max(interval, 1)), part(".avg", "gauge", F.try_divide(F.col("weighted"), F.col("weight"))), part(".median", "gauge", F.col("median")), part(".max", "gauge", F.col("max")), part(".95percentile", "gauge", F.col("p95")))
    return wide.select("host", "window_end", "name", "tags", F.inline(parts)).select("host", "window_end", F.concat("name", "suffix").alias("metric"), F.col("kind").alias("type"), "tags", "value")


def flush_set(prepared: DataFrame, approx: bool = False) -> DataFrame:
    """A4: distinct members of each context."""
    p = prepared.filter("type = 'set'")
    count = F.approx_count_distinct("member") if approx else F.count_distinct("member")
    return p.groupBy(*KEY).agg(count.cast("double").alias("value"), first_tags(p)).select("host", "window_end", F.col("name").alias("metric"), F.lit("gauge").alias("type"), "tags", "value")


def heartbeat(samples: DataFrame, interval: int = 15, version: str = "1", name: str = "agent.running") -> DataFrame:
    """One gauge of 1 for each host and window."""
    step = max(int(interval), 1)
    seen = samples.select("host", ((F.floor(F.unix_timestamp("ts") / step) + 1) * step).alias("window_end")).distinct()
    return seen.select("host", "window_end", F.lit(name).alias("metric"), F.lit("gauge").alias("type"), F.array(F.lit(f"version:{version}")).alias("tags"), F.lit(1.0).alias("value"))


def finish(series: DataFrame, interval: int = 15, host: str = "", global_tags: Sequence[str] = (), source_type: str = "") -> DataFrame:
    """Default fields, global tags, device lifted out of the tags."""
    tags = append_global_tags(F.col("tags"), global_tags)
    none = F.lit("")
    return series.select("metric", "type", F.lit(max(int(interval), 1)).cast("long").alias("interval"), tags_without_device(tags, none).alias("tags"), empty(F.col("host"), F.lit(host)).alias("host"), device_of(tags, none).alias("device"), F.lit(source_type).alias("source_type_name"), F.col("window_end").cast("long").alias("ts"), "value")


def flush_metrics(samples: DataFrame, interval: int = 15, host: str = "", global_tags: Sequence[str] = (), approx_sets: bool = False) -> DataFrame:
    """A5: all families of a tumbling flush as series rows; idle contexts give none. ts is the window's end.

    The samples are read once. They are pre-aggregated by context and by value (histograms) or member (sets), then one
    deal by context does the running weights and the last aggregation.
    """
    p, step = prepare(samples, interval), max(int(interval), 1)
    if approx_sets:
        return finish(flush_simple(p, interval).unionByName(flush_histogram(p, interval)).unionByName(flush_set(p, True)), interval, host, global_tags)
    cell = F.when(F.col("type").isin("histogram", "timing"), F.col("v"))
    one = p.groupBy(*KEY, cell.alias("cell"), F.when(F.col("type") == "set", F.col("member")).alias("item")).agg(F.sum("w").alias("w"), F.sum("v").alias("sum"), F.max(F.struct("ts", "seq", "v")).alias("last"), F.min(F.struct("ts", "seq", "tags")).alias("first"))
    by = Window.partitionBy(*KEY)
    run = one.withColumns({"c": F.sum("w").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("w").over(by)})
    rank = lambda target: F.coalesce(F.min(F.when(F.col("c") > target, F.col("cell"))), F.max("cell"))
    two = run.groupBy(*KEY).agg(
        F.sum("sum").alias("sum"), F.max("last").alias("last"), F.min("first").alias("first"), F.count("item").alias("members"), F.max("total").alias("total"), F.sum(F.col("cell") * F.col("w")).alias("weighted"),
        rank((F.col("total") - 1) / 2).alias("median"), rank((95 * F.col("total") - 1) / 100).alias("p95"), F.max("cell").alias("top"))
    item = lambda suffix, kind, v: F.struct(F.lit(suffix).alias("suffix"), F.lit(kind).alias("kind"), v.cast("double").alias("value"))
    hist = F.array(item(".count", "rate", F.col("total") / step), item(".avg", "gauge", F.try_divide(F.col("weighted"), F.col("total"))), item(".median", "gauge", F.col("median")), item(".max", "gauge", F.col("top")), item(".95percentile", "gauge", F.col("p95")))
    rows = F.when(F.col("type") == "gauge", F.array(item("", "gauge", F.col("last.v")))).when(F.col("type") == "counter", F.array(item("", "rate", F.col("sum") / step))).when(F.col("type") == "set", F.array(item("", "gauge", F.col("members")))).when(F.col("type").isin("histogram", "timing"), hist)
    parts = two.select("host", "window_end", "name", F.col("first.tags").alias("tags"), F.inline(rows)).select("host", "window_end", F.concat("name", "suffix").alias("metric"), F.col("kind").alias("type"), "tags", "value")
    return finish(parts, interval, host, global_tags)


def union_sources(*series: DataFrame) -> DataFrame:
    """Pushed, pulled and heartbeat series in one table."""
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def run_total(series: DataFrame, ignore: str = "") -> DataFrame:
    """`(key, is_sum, total)`: for each metric key the total of value * interval of its rates and counts, and the
    last value of its gauges, a key that is both having both rows."""
    key = metric_key(F.col("metric"), F.col("tags"), F.col("device"), ignore)
    is_sum = F.coalesce(F.col("type").isin("rate", "count"), F.lit(False))
    both = series.groupBy(key.alias("key"), is_sum.alias("is_sum")).agg(F.sum(F.col("value") * F.greatest("interval", F.lit(1))).alias("sum"), F.max_by("value", "ts").alias("last"))
    return both.select("key", "is_sum", F.when(F.col("is_sum"), F.col("sum")).otherwise(F.col("last")).alias("total"))
