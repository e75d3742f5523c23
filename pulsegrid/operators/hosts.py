"""Host gauges, inventory and fleet summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import base_name, bytes_to_kb, bytes_to_mb, host_uuid, kb_to_mb, nonneg, os_version, ratio


def _long(df: DataFrame, keys: Sequence[str], values: dict[str, Column], tags: Sequence[str] = ()) -> DataFrame:
    rows = F.filter(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()]), lambda x: x["value"].isNotNull())
    return df.select(*keys, *tags, F.inline(rows))


def mem_gauges(counters: DataFrame, keys: Sequence[str] = ("host", "ts")) -> DataFrame:
    """G1: memory gauges in MB from `(label, value)` counters in kB."""
    labels = ["MemTotal", "MemFree", "MemAvailable", "Cached", "SReclaimable", "Buffers", "Shmem", "Slab", "SwapTotal", "SwapFree"]  # fixed values
    w = counters.groupBy(*keys).pivot("label", labels).agg(F.first("value"))
    m = {k: kb_to_mb(F.coalesce(F.col(k), F.lit(0.0))) for k in labels}
    out = {"total": m["MemTotal"], "free": m["MemFree"], "used": m["MemTotal"] - m["MemFree"], "usable": m["MemAvailable"], "cached": m["Cached"] + m["SReclaimable"], "buffered": m["Buffers"], "shared": m["Shmem"], "slab": m["Slab"], "swap_total": m["SwapTotal"], "swap_free": m["SwapFree"], "swap_used": m["SwapTotal"] - m["SwapFree"], "pct_usable": ratio(m["MemAvailable"], m["MemTotal"]), "swap_pct_free": F.when(m["SwapTotal"] > 0, ratio(m["SwapFree"], m["SwapTotal"]))}
    return _long(w, keys, out)


def mem_gauges_pages(df: DataFrame, keys: Sequence[str] = ("host", "ts"), page: int = 4096) -> DataFrame:
    """From `memory` bytes, used and total pages, `swap_used` pages and the bytes of swap there are (`swap_capacity`,
    which comes separately); kernel pools (`malloc_*`, `draw_*`, bytes) only where they have a size. Values in MB."""
    mb = 1024.0 * 1024.0
    free = F.least(nonneg((F.col("pages_total") - F.col("pages_used")) * page), F.col("memory"))
    capacity, used = F.col("swap_capacity"), F.least(F.col("swap_used") * page, F.col("swap_capacity"))
    out = {"total": F.col("memory") / mb, "free": free / mb, "used": (F.col("memory") - free) / mb, "pct_usable": F.try_divide(free, F.col("memory")), "swap_total": capacity / mb, "swap_used": used / mb, "swap_free": (capacity - used) / mb, "swap_pct_free": F.when(capacity > 0, F.try_divide(capacity - used, capacity))}
    for pool in ("malloc", "draw"):
        if f"{pool}_total" in df.columns:
            some = F.col(f"{pool}_total") > 0
            out |= {f"kernel_{pool}": F.when(some, F.col(f"{pool}_used") / mb), f"kernel_{pool}_max": F.when(some, F.col(f"{pool}_total") / mb)}
    return _long(df, keys, out)


def mem_gauges_simple(df: DataFrame, keys: Sequence[str] = ("host", "ts")) -> DataFrame:
    """From decoded `total`, `free` and `usable` bytes."""
    mb = bytes_to_mb
    return _long(df, keys, {"total": mb(F.col("total")), "free": mb(F.col("free")), "used": mb(F.col("total") - F.col("free")), "usable": mb(F.col("usable")), "pct_usable": ratio(F.col("usable"), F.col("total"))})


def load_gauges(load: DataFrame, keys: Sequence[str] = ("host", "ts")) -> DataFrame:
    """Load averages, plain and by core (0 cores count as 1)."""
    cores = F.greatest(F.coalesce(F.col("cores"), F.lit(1)), F.lit(1))
    loads = {k: F.col(f"load{k}") for k in (1, 5, 15)}
    return _long(load, keys, {f"load.{k}": v for k, v in loads.items()} | {f"load.norm.{k}": v / cores for k, v in loads.items()})


def fs_gauges(mounts: DataFrame, keys: Sequence[str] = ("host", "ts"), in_use: str = "reserve_excluded") -> DataFrame:
    """File system gauges in kB (W15 applied before), with the tags device and device_name, its last element; inodes only
    where there are any."""
    kb = lambda blocks: blocks * F.col("bsize") / 1024
    total, free, used = kb(F.col("blocks")), kb(F.col("bavail")), kb(F.col("blocks") - F.col("bfree"))
    some = F.col("files") > 0
    out = {"total": total, "used": used, "free": free, "in_use": ratio(used, used + free) if in_use == "reserve_excluded" else ratio(used, total)}
    out |= {f"inodes.{k}": F.when(some, v) for k, v in {"total": F.col("files"), "free": F.col("ffree"), "used": F.col("files") - F.col("ffree"), "in_use": ratio(F.col("files") - F.col("ffree"), F.col("files"))}.items()}
    return _long(mounts.withColumn("device_name", base_name(F.col("device"))), keys, out, ["device", "device_name"])


def link_gauges(df: DataFrame, keys: Sequence[str] = ("host", "device", "ts"), errors: Sequence[str] = ()) -> DataFrame:
    """Link state gauges where there is one (a maximum size only if positive) and the sum of the error counters."""
    return _long(df, keys, {"link": F.col("link"), "speed": F.col("speed"), "mtu": F.when(F.col("mtu") > 0, F.col("mtu")), "signal": F.col("signal"), "errors": sum((F.coalesce(F.col(c), F.lit(0)) for c in errors), F.lit(0))})


def storage_gauges(storage: DataFrame, expected: DataFrame, device: str = "store") -> DataFrame:
    """`(host, ts, metric, value, tags)` of storage servers. Disk gauges (kB, tagged with the device) and counts of
    arenas, clumps and data bytes where a size is known, a compression ratio where there is compressed data; `up` tells
    for every expected (host, ts) whether it was seen."""
    counts = ["arenas_total", "arenas_active", "clumps_total", "clumps_compressed", "uncompressed_bytes", "compressed_bytes"]
    cols = ["total", "used", *(c for c in counts if c in storage.columns)]
    rows = expected.join(storage.select("host", "ts", *cols, F.lit(True).alias("seen")), ["host", "ts"], "left")
    some = F.col("total") > 0
    disk = {"total": bytes_to_kb(F.col("total")), "used": bytes_to_kb(F.col("used")), "free": bytes_to_kb(nonneg(F.col("total") - F.col("used"))), "in_use": F.try_divide(F.col("used"), F.col("total"))}
    rest = {c: F.when(some, F.col(c)) for c in cols[2:]}
    if "compressed_bytes" in cols:
        rest["compression_ratio"] = F.when(some & (F.col("compressed_bytes") > 0), F.try_divide(F.col("uncompressed_bytes"), F.col("compressed_bytes")))
    tagged = _long(rows, ["host", "ts"], {k: F.when(some, v) for k, v in disk.items()}).withColumn("tags", F.array(F.lit(f"device:{device}")))
    plain = _long(rows, ["host", "ts"], {"up": F.when(F.col("seen"), 1.0).otherwise(0.0)} | rest).withColumn("tags", F.array().cast("array<string>"))
    return tagged.unionByName(plain)


#: Facts of an inventory row, where they come from, and their types.
INVENTORY = {
    "cpu_cores": ("cpu.cores", "long"), "cpu_logical_processors": ("cpu.logical", "long"), "cpu_vendor": ("cpu.vendor", "string"), "cpu_model": ("cpu.model", "string"), "cpu_frequency": ("cpu.mhz", "double"),
    "kernel_name": ("platform.kernel_name", "string"), "kernel_release": ("platform.kernel_release", "string"), "kernel_version": ("platform.kernel_version", "string"), "os": ("platform.os", "string"),
    "cpu_architecture": ("platform.machine", "string"), "memory_total_kb": ("memory.total", "long"), "memory_swap_total_kb": ("memory.swap_total", "long"),
    "ip_address": ("network.ipv4", "string"), "ipv6_address": ("network.ipv6", "string"), "mac_address": ("network.mac", "string"),
}


def host_inventory(facts: DataFrame, version: str = "") -> DataFrame:
    """The latest facts of each host as a flat row; memory comes in bytes, swap in kB. Facts that are missing, or that the
    table doesn't have, are empty or 0. Of equal times any row counts, as a whole."""
    held = {f.name: {g.name for g in f.dataType.fields} if hasattr(f.dataType, "fields") else set() for f in facts.schema.fields}
    latest = facts.groupBy("host").agg(F.max_by(F.struct(*[c for c in facts.columns if c != "host"]), "ts").alias("f"))

    def fact(path: str, kind: str) -> Column:
        top, name = path.split(".")
        value = F.col(f"f.{path}") if name in held.get(top, set()) else F.lit(None)
        value = F.floor(value / 1024) if path == "memory.total" else value
        return F.coalesce(value.cast(kind), F.lit("" if kind == "string" else 0).cast(kind))

    versions = [F.col(f"f.platform.{k}") for k in ("nix", "mac", "win")]
    return latest.select("host", F.col("f.ts").alias("ts"), host_uuid(F.col("f.machine_id"), F.col("host")).alias("uuid"), *[fact(*x).alias(n) for n, x in INVENTORY.items()], F.lit(version).alias("agent_version"), os_version(*versions).alias("os_version"))


def agent_inventory(facts: DataFrame, version: str, flavor: str, mode: str = "full") -> DataFrame:
    """One agent row for each host."""
    latest = facts.groupBy("host").agg(F.max_by("machine_id", "ts").alias("machine_id"))
    return latest.select("host", host_uuid(F.col("machine_id"), F.col("host")).alias("uuid"), F.lit(version).alias("agent_version"), F.lit(flavor).alias("flavor"), F.lit(mode).alias("infrastructure_mode"))


def count_by_state(df: DataFrame, keys: Sequence[str], state: str, buckets: Sequence[str]) -> DataFrame:
    """Rows by state with zeros for all listed buckets; other states are left out."""
    sums = df.groupBy(*keys).agg(*[F.count_if(F.col(state) == b).alias(b) for b in buckets])
    return sums.select(*keys, F.inline(F.array(*[F.struct(F.lit(b).alias("state"), F.col(f"`{b}`").alias("n")) for b in buckets])))


def sum_over_cpus(cpus: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("host", "ts")) -> DataFrame:
    """Per-CPU rows and their host total, tagged."""
    total = cpus.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols]).withColumn("tag", F.lit("total"))
    return cpus.select(*keys, *cols, F.concat(F.lit("cpu:"), F.col("cpu").cast("string")).alias("tag")).unionByName(total)


def shared_memory_share(procs: DataFrame, segments: DataFrame) -> DataFrame:
    """A10: process memory over the most references of its Data and Bss segments."""
    refs = segments.filter(F.col("segment").isin("Data", "Bss")).groupBy("host", "ts", "pid").agg(F.max("ref").alias("refs"))
    return procs.join(refs, ["host", "ts", "pid"], "left").withColumn("memory", F.col("memory") / F.greatest(F.coalesce("refs", F.lit(1)), F.lit(1))).drop("refs")


def shared_segment_bytes(segments: DataFrame) -> DataFrame:
    """Bytes in segments with more than one reference; addresses are hexadecimal."""
    size = F.conv("top", 16, 10).cast("decimal(20,0)") - F.conv("base", 16, 10).cast("decimal(20,0)")
    return segments.groupBy("host", "ts", "pid").agg(F.coalesce(F.sum(F.when(F.col("ref") > 1, size)), F.lit(0)).cast("long").alias("shared"))


def threads_per_pid(lines: DataFrame) -> DataFrame:
    """Thread lines after each process line."""
    w = Window.partitionBy("host", "ts").orderBy("line_no")
    return lines.withColumn("owner", F.last("pid", ignorenulls=True).over(w)).filter("owner is not null").groupBy("host", "ts", "owner").agg(F.count("*").alias("threads"))


def cpu_topology(rows: DataFrame) -> DataFrame:
    """Cores (distinct physical and core ids, else processors), processors, first known vendor, model, family and MHz. Of
    rows with the same `pos` the one that is read first is the first."""
    known = F.when(F.col("core_id").isNotNull(), F.struct("physical_id", "core_id"))
    first = lambda c, ok: F.min_by(c, F.when(ok, F.struct("pos", "_read")))
    out = rows.withColumn("_read", F.monotonically_increasing_id()).groupBy("host").agg(F.count_distinct(known).alias("c"), F.count("*").alias("logical"), *[first(c, F.col(c) != "").alias(c) for c in ("vendor", "model", "family")], first("mhz", F.col("mhz") > 0).alias("mhz"))
    return out.withColumn("cores", F.when(F.col("c") > 0, F.col("c")).otherwise(F.col("logical"))).drop("c")


#: Addresses that only hold on a link: IPv4 and IPv6, unicast, then multicast.
LINK_LOCAL = r"^(169\.254\.|(?i:fe[89ab][0-9a-f]:)|224\.0\.0\.|(?i:ff[0-9a-f]2:))"


def _usable(interfaces: DataFrame) -> DataFrame:
    return interfaces.filter(~F.col("loopback")).withColumn("addr", F.when(~F.col("addr").rlike(LINK_LOCAL), F.col("addr")))


def network_summary(interfaces: DataFrame) -> DataFrame:
    """First IPv4 address with its MAC and first IPv6 address of each host, loopback and link-local left out."""
    v6 = F.col("addr").contains(":")
    at = F.struct("pos", "addr")
    ok = _usable(interfaces).filter("addr is not null")
    return ok.groupBy("host").agg(F.min_by("addr", F.when(~v6, at)).alias("ipv4"), F.min_by("mac", F.when(~v6, at)).alias("mac"), F.min_by("addr", F.when(v6, at)).alias("ipv6"), F.array_sort(F.collect_set("addr")).alias("addrs"))


def network_interfaces(interfaces: DataFrame) -> DataFrame:
    """Each interface but loopback with its MAC and its IPv4 and IPv6 addresses in their order."""
    v6 = F.col("addr").contains(":")
    listed = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("pos", "addr")))), lambda x: x["addr"])
    return _usable(interfaces).groupBy("host", "name").agg(F.min_by("mac", "pos").alias("mac"), listed(~v6).alias("ipv4"), listed(v6).alias("ipv6"))


def row_counts(df: DataFrame, content: str = "content") -> DataFrame:
    """Non-blank lines of each snapshot."""
    return df.select(*[c for c in df.columns if c != content], F.size(F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n"))


def top_n_memory(procs: DataFrame, keys: Sequence[str], n: int = 20, name: str = "name", memory: str = "memory") -> DataFrame:
    """Programs by summed memory, ties by name."""
    sums = procs.groupBy(*keys, name).agg(F.sum(memory).alias("memory"))
    w = Window.partitionBy(*keys).orderBy(F.col("memory").desc(), name)
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def lookup_user(procs: DataFrame, users: DataFrame) -> DataFrame:
    """User names by uid, else the uid as text."""
    return procs.join(users.select("uid", F.col("name").alias("_u")), "uid", "left").withColumn("user", F.coalesce("_u", F.col("uid").cast("string"))).drop("_u")


def label_map(counters: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """Labels to (metric, kind) by a fixed dictionary; other labels go."""
    pairs = F.create_map(*[x for k, (m, kind) in mapping.items() for x in (F.lit(k), F.struct(F.lit(m).alias("metric"), F.lit(kind).alias("kind")))])
    return counters.withColumn("_m", F.try_element_at(pairs, F.col("label"))).filter("_m is not null").select("*", "_m.*").drop("_m", "label")


def enrich_host(df: DataFrame, hosts: DataFrame) -> DataFrame:
    """A host's global tags behind its rows' own."""
    return df.join(hosts.select("host", "global_tags"), "host", "left").withColumn("tags", F.concat("tags", F.coalesce("global_tags", F.array().cast("array<string>")))).drop("global_tags")
