"""Counters to rates: consecutive snapshots of an entity, diffed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut


def look_back(df: DataFrame, host: str, entity: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Add `prev`, the entity's `cols` in the host's immediately previous snapshot, and `dt`, seconds since then, fractions
    included; both null where it wasn't there.

    The rows are dealt by entity for the look back. Which snapshot comes before which is found on the distinct (host,
    ts) pairs, a far smaller table, that Spark broadcasts if it is small.
    """
    back = Window.partitionBy(host, *entity).orderBy(ts)
    seen = df.withColumn("prev", F.lag(F.struct(F.col(ts).alias("_ts"), *cols)).over(back))
    order = df.select(host, ts).distinct().withColumn("_before", F.lag(ts).over(Window.partitionBy(host).orderBy(ts)))
    near = seen.join(order, [host, ts], "left").withColumn("prev", F.when(F.col("prev._ts") == F.col("_before"), F.col("prev"))).drop("_before")
    return near.withColumn("dt", (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("prev._ts").cast("timestamp"))) / 1e6)


def with_previous(df: DataFrame, host: str, entity: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """`look_back` without the rows that have no previous one: first seen, or missing last time."""
    return look_back(df, host, entity, ts, cols).filter("dt > 0")


def counter_rate(df: DataFrame, host: str, entity: Sequence[str], ts: str, cols: Sequence[str], policy: str = "skip") -> DataFrame:
    """Per-second rates of all counters, long form (counter, rate). On a reset `skip` leaves the counter out,
    `clamp` gives 0."""
    seen = with_previous(df, host, entity, ts, cols)
    delta = lambda c: F.col(c) - F.col(f"prev.{c}")
    rate = {"skip": lambda c: F.when(delta(c) >= 0, delta(c) / F.col("dt")), "clamp": lambda c: F.when(delta(c) > 0, delta(c) / F.col("dt")).otherwise(0.0)}[policy]
    rows = F.filter(F.array(*[F.struct(F.lit(c).alias("counter"), rate(c).alias("rate")) for c in cols]), lambda x: x["rate"].isNotNull())
    return seen.select(host, *entity, ts, F.inline(rows))


CPU = ["user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal", "guest"]


def cpu_pct(df: DataFrame, host: str = "host", ts: str = "ts") -> DataFrame:
    """Shares of the CPU time between snapshots, in percent; guest time is part of user time and not of the total."""
    seen = with_previous(df, host, [], ts, CPU)
    d = {c: F.col(c) - F.col(f"prev.{c}") for c in CPU}
    total = sum((d[c] for c in CPU[1:-1]), d["user"])
    pct = lambda x: 100 * x / F.col("_t")
    return seen.withColumn("_t", total).filter("_t > 0").select(host, ts, *[pct(x).alias(n) for n, x in {"user_pct": d["user"] + d["nice"], "system_pct": d["system"] + d["irq"] + d["softirq"], "iowait_pct": d["iowait"], "idle_pct": d["idle"], "stolen_pct": d["steal"], "guest_pct": d["guest"]}.items()])


def cpu_gauges(df: DataFrame, cores: str = "cores", host: str = "host", ts: str = "ts") -> DataFrame:
    """W3, long form (metric, value): the number of cores of every snapshot, and the shares where there is a previous one."""
    shares = cpu_pct(df, host, ts)
    count = df.select(host, ts, F.lit("num_cores").alias("metric"), F.col(cores).cast("double").alias("value"))
    return count.unionByName(shares.unpivot([host, ts], shares.columns[2:], "metric", "value"))


def cpu_pct_states(df: DataFrame, states: str, host: str = "host", ts: str = "ts") -> DataFrame:
    """The same from an array of states: user, nice, system ..., idle."""
    seen = with_previous(df, host, [], ts, [states])
    d = F.zip_with(F.col(states), F.col(f"prev.{states}"), lambda a, b: (a - b).cast("double"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return seen.withColumn("_d", d).withColumn("_t", add(F.col("_d"))).filter("_t > 0").select(host, ts, (100 * (F.get("_d", F.lit(0)) + F.get("_d", F.lit(1))) / F.col("_t")).alias("user_pct"), (100 * add(F.slice("_d", F.lit(3), F.size("_d") - 3)) / F.col("_t")).alias("system_pct"), (100 * F.get("_d", F.size("_d") - 1) / F.col("_t")).alias("idle_pct"))


def cpu_pct_kernel_user(df: DataFrame, host: str = "host", ts: str = "ts") -> DataFrame:
    """From idle, kernel (which includes idle) and user times."""
    seen = with_previous(df, host, [], ts, ["idle", "kernel", "user"])
    i, k, u = (F.col(c) - F.col(f"prev.{c}") for c in ("idle", "kernel", "user"))
    return seen.withColumn("_t", k + u).filter("_t > 0").select(host, ts, *[(100 * x / F.col("_t")).alias(n) for n, x in {"user_pct": u, "system_pct": k - i, "idle_pct": i}.items()])


NET = ["rx_bytes", "rx_packets", "rx_errs", "rx_drop", "tx_bytes", "tx_packets", "tx_errs", "tx_drop"]


def net_rates(df: DataFrame, host: str = "host", device: str = "device", ts: str = "ts") -> DataFrame:
    """Rates of the eight interface counters, loopback skipped."""
    return counter_rate(df.filter(F.col(device) != "lo"), host, [device], ts, NET)


def disk_io_rates(df: DataFrame, mode: str = "jiffies", host: str = "host", device: str = "device", ts: str = "ts") -> DataFrame:
    """Block device rates, long form (metric, value).

    Modes: jiffies (kernel counters in sectors and ms), durations (bytes and seconds), busy (rates and utilisation),
    basic (throughput). A device whose reads or writes went back is skipped; times, merges and bytes never count below
    0, sectors of the kernel's counters are taken as they are.
    """
    ms = mode == "jiffies"
    cols = ["reads", "reads_merged", "sectors_read", "ms_reading", "writes", "writes_merged", "sectors_written", "ms_writing", "ms_io", "weighted_ms_io"] if ms else ["read_ops", "write_ops", "read_bytes", "write_bytes", *(["read_dur_s", "write_dur_s"] if mode == "durations" else []), *(["busy_s"] if mode != "basic" else [])]
    seen = with_previous(df, host, [device], ts, cols)
    raw = {c: F.col(c) - F.col(f"prev.{c}") for c in cols}
    d = {c: F.greatest(x, F.lit(0.0)) for c, x in raw.items()}
    dt, sec = F.col("dt"), F.lit(1000.0) if ms else F.lit(1.0)
    r, w = ("reads", "writes") if ms else ("read_ops", "write_ops")
    rk, wk = (raw["sectors_read"] / 2, raw["sectors_written"] / 2) if ms else (d["read_bytes"] / 1024, d["write_bytes"] / 1024)
    ops = d[r] + d[w]
    out: dict[str, Column] = {"r_s": d[r] / dt, "w_s": d[w] / dt, "rkb_s": rk / dt, "wkb_s": wk / dt}
    if mode != "basic":
        out["util"] = F.least(F.lit(100.0), 100 * d["ms_io" if ms else "busy_s"] / (dt * sec))
    if ms:
        out |= {"rrqm_s": d["reads_merged"] / dt, "wrqm_s": d["writes_merged"] / dt, "avg_q_sz": d["weighted_ms_io"] / (dt * 1000)}
    if mode in ("jiffies", "durations"):
        tr, tw = (d["ms_reading"], d["ms_writing"]) if ms else (1000 * d["read_dur_s"], 1000 * d["write_dur_s"])
        out |= {"await": F.when(ops > 0, F.try_divide(tr + tw, ops)), "r_await": F.when(d[r] > 0, F.try_divide(tr, d[r])), "w_await": F.when(d[w] > 0, F.try_divide(tw, d[w]))}
    if ms:
        out["avg_rq_sz"] = F.when(ops > 0, F.try_divide(raw["sectors_read"] + raw["sectors_written"], ops))
    rows = F.filter(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in out.items()]), lambda x: x["value"].isNotNull())
    return seen.filter((raw[r] >= 0) & (raw[w] >= 0)).select(host, device, ts, F.inline(rows))


def pin_create_time(procs: DataFrame, slack_ms: int = 2000, host: str = "host", ts: str = "snap_ts") -> DataFrame:
    """Add `pinned`, the create time a process keeps while readings stay within the slack of it.

    Only the snapshot before counts: a process that was missing in it begins anew. So does one whose reading moved by twice
    the slack or more, as no value within the slack of the old reading is within that of the new one. Between such places most
    processes vary by less than the slack and keep their first reading. Readings of the others each point to the first later
    one that a value pinned there would not survive; from the first reading on, these pointers are followed by doubling
    (`_identities`). Nothing is gathered, rows of a process only pass through windows.
    """
    c, old = F.col("create_time").cast("long"), F.col("prev.create_time").cast("long")
    seen = look_back(procs.withColumn(ts, F.col(ts).cast("timestamp")), host, ["pid"], ts, ["create_time"])
    anew = ~F.coalesce(F.abs(c - old) < 2 * slack_ms, F.lit(False))
    runs = seen.withColumn("_run", F.sum(anew.cast("long")).over(Window.partitionBy(host, "pid").orderBy(ts))).drop("prev", "dt")
    w = Window.partitionBy(host, "pid", "_run")
    whole = w.orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = runs.withColumns({"_first": F.first("create_time").over(whole), "_drift": F.coalesce(F.max(c).over(whole) - F.min(c).over(whole) >= slack_ms, F.lit(False))})
    steady = marked.filter(~F.col("_drift")).withColumn("pinned", F.col("_first"))
    drifting = marked.filter("_drift")
    begins = _identities(drifting.select(F.col(host).alias("h"), "pid", "_run", F.col(ts).alias("t"), c.alias("c")), slack_ms)
    key = [host, "pid", "_run", ts]
    new = drifting.join(begins.select(F.col("h").alias(host), "pid", "_run", F.col("t").alias(ts), F.lit(True).alias("_new")), key, "left")
    moved = new.withColumn("pinned", F.last(F.when(F.col("_new"), F.col("create_time")), ignorenulls=True).over(w.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)))
    cols = [*procs.columns, "pinned"]
    return steady.select(*cols).unionByName(moved.select(*cols))


def _identities(rows: DataFrame, slack: int) -> DataFrame:
    """Of `(h, pid, _run, t, c)` the rows at which a new value is pinned.

    Only readings that differ from the one before matter. Each gets, level by level, the least and greatest of the next
    2**k of them; by those the first later one outside its slack is found from the largest step down, then the pointers are
    doubled from the first reading. Every level is a join by number; there are as many as the longest run of changes has bits.
    """
    key = ["h", "pid", "_run"]
    w = Window.partitionBy(*key).orderBy("t")
    changes = rows.withColumn("_was", F.lag("c").over(w)).filter("_was is null or _was <> c").drop("_was")
    n = cut(changes.withColumn("i", F.row_number().over(w).cast("long")))
    most = n.agg(F.max("i")).first()[0]
    if most is None:
        return rows.select(*key, "t").limit(0)
    levels = [cut(n.select(*key, (F.col("i") - 1).alias("i"), F.col("c").alias("lo"), F.col("c").alias("hi")).filter("i > 0"))]
    while 2 ** len(levels) < most:
        last = levels[-1]
        ahead = last.select(*key, (F.col("i") - 2 ** (len(levels) - 1)).alias("i"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        levels.append(cut(last.join(ahead, [*key, "i"]).select(*key, "i", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"))))
    at = n.select(*key, F.col("i").alias("own"), "i", "c")
    for k in range(len(levels) - 1, -1, -1):  # all of the next 2**k are within the slack: go past them
        inside = F.coalesce((F.col("c") - F.col("lo") < slack) & (F.col("hi") - F.col("c") < slack), F.lit(False))
        at = at.join(levels[k], [*key, "i"], "left").withColumn("i", F.when(inside, F.col("i") + 2**k).otherwise(F.col("i"))).drop("lo", "hi")
    step = cut(at.select(*key, F.col("own").alias("i"), (F.col("i") + 1).alias("to")).join(n.select(*key, F.col("i").alias("to")), [*key, "to"], "left_semi"))
    met = cut(n.filter("i = 1").select(*key, "i"))
    reach = 1
    while reach < most:
        met = cut(met.unionByName(met.join(step, [*key, "i"]).select(*key, F.col("to").alias("i"))).distinct())
        step = cut(step.join(step.select(*key, F.col("i").alias("to"), F.col("to").alias("on")), [*key, "to"]).select(*key, "i", F.col("on").alias("to")))
        reach *= 2
        if step.isEmpty():
            break
    return n.join(met, [*key, "i"], "left_semi").select(*key, "t")


def proc_rates(procs: DataFrame, slack_ms: int = 2000, host: str = "host", ts: str = "snap_ts", counters: Sequence[str] = ("read_count", "write_count", "read_bytes", "write_bytes")) -> DataFrame:
    """CPU percentages and I/O rates of every process, 0 where it is new or a counter went back."""
    cols = ["user_time", "system_time", *counters]
    seen = look_back(pin_create_time(procs, slack_ms, host, ts), host, ["pid"], ts, ["pinned", *cols])
    same = F.col("prev.pinned") == F.col("pinned")

    def rate(c: str, scale: float = 1.0) -> Column:
        delta = F.col(c) - F.col(f"prev.{c}")
        return F.coalesce(F.when(same & (F.col("dt") > 0) & (delta > 0), scale * F.try_divide(delta.cast("double"), F.col("dt"))), F.lit(0.0))

    out = seen.select(host, "pid", ts, "pinned", rate("user_time", 100).alias("user_pct"), rate("system_time", 100).alias("system_pct"), *[rate(c).alias(f"{c}_s") for c in counters])
    return out.withColumn("total_pct", F.col("user_pct") + F.col("system_pct"))


def latest_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], required: Sequence[str]) -> DataFrame:
    """The last complete row of each key."""
    full = df.filter(" and ".join(f"{c} is not null" for c in required))
    return full.groupBy(*keys).agg(F.max_by(F.struct(*required), F.struct(*order)).alias("x")).select(*keys, "x.*")


def first_per_device(mounts: DataFrame, pseudo: Sequence[str], host: str = "host", ts: str = "ts") -> DataFrame:
    """The first mount of each device, without pseudo file systems and empty ones."""
    real = mounts.filter(~F.col("fstype").isin(*pseudo) & (F.col("blocks") > 0))
    return real.withColumn("_n", F.row_number().over(Window.partitionBy(host, ts, "device").orderBy("pos"))).filter("_n = 1").drop("_n")


def max_of_sampled(df: DataFrame, keys: Sequence[str], value: str = "max", count: str = "nsamp") -> DataFrame:
    """The largest value of bins that were sampled; keys without one are absent."""
    return df.filter(F.col(count) > 0).groupBy(*keys).agg(F.max(value).alias("value"))
