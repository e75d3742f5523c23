"""Queries over host gauges, snapshots and fleet summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import counters, hosts
from ..sources import snapshots
from .recipes import PROCS, in_duck, in_spark, table

WORDS = ["Running", "New", "QueueingR", "Stopped", "Dead", "Broken", "Pageout", "Fault", "Scheding"]
STATES = ["F", "O", "P", "X"]
MOUNTS = """
  SELECT concat('h', p_partkey % 5) AS host, cast('2024-01-01' AS timestamp) AS ts, p_partkey AS pos, concat('d', p_partkey % 37) AS device,
         CASE WHEN p_partkey % 4 = 0 THEN 'proc' ELSE 'ext4' END AS fstype, cast(4096 AS bigint) AS bsize, cast(p_size % 3 * (1000 + p_partkey) AS bigint) AS blocks,
         cast(p_size % 3 * 400 AS bigint) AS bfree, cast(p_size % 3 * 300 AS bigint) AS bavail, cast(p_size % 2 * 100 AS bigint) AS files, cast(p_size % 2 * 60 AS bigint) AS ffree
  FROM {part}"""
FACTS = """
  SELECT concat('h', c_custkey % 40) AS host, cast(c_custkey AS bigint) AS ts, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE concat(' m', c_custkey, ' ') END AS machine_id,
         cast(c_custkey % 16 AS int) AS cores, cast(c_custkey * 1048576 AS bigint) AS total, cast(c_custkey * 2048 AS bigint) AS swap_total, c_mktsegment AS version
  FROM {customer}"""
SEGMENTS = """
  SELECT concat('h', l_suppkey % 3) AS host, cast(l_shipdate AS timestamp) AS ts, cast(l_partkey % 20 AS int) AS pid,
         CASE l_linenumber % 3 WHEN 0 THEN 'Data' WHEN 1 THEN 'Bss' ELSE 'Text' END AS segment, cast(l_partkey * 4096 AS bigint) AS low, cast((l_partkey + l_quantity) * 4096 AS bigint) AS high, cast(l_linenumber % 4 AS int) AS ref
  FROM {lineitem}"""
MEMORY = "SELECT DISTINCT host, ts, pid, cast(1000 + pid AS double) AS memory FROM (" + SEGMENTS + ") s"
NICS = """
  SELECT concat('h', s_suppkey % 9) AS host, s_suppkey AS pos, s_suppkey % 8 = 0 AS loopback, concat('mac', s_suppkey) AS mac,
         CASE s_suppkey % 4 WHEN 0 THEN concat('10.0.0.', s_suppkey) WHEN 1 THEN concat('169.254.0.', s_suppkey) WHEN 2 THEN concat('2001:db8::', s_suppkey) ELSE concat('fe80::', s_suppkey) END AS addr
  FROM {supplier}"""
PACKAGES = """
  SELECT concat('h', l_suppkey % 9) AS host, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_suppkey % 9 > 2 THEN l_linenumber % 2 END AS physical_id, CASE WHEN l_suppkey % 9 > 2 THEN cast(l_quantity AS int) % 6 END AS core_id,
         CASE WHEN l_linenumber = 1 THEN '' ELSE concat('v', l_partkey) END AS vendor, CASE WHEN l_linenumber = 2 THEN '' ELSE concat('m', l_partkey) END AS model, CASE WHEN l_linenumber < 3 THEN '' ELSE concat('f', l_partkey) END AS family, cast(CASE WHEN l_linenumber < 4 THEN 0 ELSE l_partkey END AS double) AS mhz
  FROM {lineitem}"""
STATE_TIMES = """
  SELECT host, day AS ts, sum(q) OVER w AS a, sum(n) OVER w AS b, sum(p) OVER w AS c, sum(2 * n) OVER w AS d, sum(90 * n) OVER w AS e
  FROM (SELECT concat('h', l_suppkey % 7) AS host, cast(l_shipdate AS timestamp) AS day, cast(sum(l_quantity) AS double) AS q, cast(count(*) AS double) AS n, cast(sum(l_linenumber) AS double) AS p
        FROM {lineitem} GROUP BY 1, 2) t WINDOW w AS (PARTITION BY host ORDER BY day ROWS UNBOUNDED PRECEDING)"""
BINS = "SELECT concat('h', user_id % 50) AS host, cast(event_id % 3 AS bigint) AS nsamp, value AS {q}max{q}, CASE WHEN event_id % 2 = 0 THEN value END AS a, CASE WHEN event_id % 5 > 0 THEN value END AS b, event_id AS pos FROM {events}"
CPUS = "SELECT concat('h', l_suppkey % 9) AS host, cast(l_shipdate AS timestamp) AS ts, l_linenumber AS cpu, cast(sum(l_quantity) AS double) AS user, cast(count(*) AS double) AS idle FROM {lineitem} GROUP BY 1, 2, 3"


def _ts():
    return F.unix_timestamp("ts").alias("ts")


def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 9).alias("host"), F.col("o_orderstatus").alias("state"))
    return hosts.count_by_state(o, ["host"], "state", STATES)


def state_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes by scheduler bucket, zeros included; the words go round with the event ids."""
    word = F.get(F.array(*map(F.lit, WORDS)), (F.col("event_id") % 10).cast("int"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), columns.state_bucket(word).alias("state"))
    return hosts.count_by_state(e, ["host"], "state", list(columns.STATE_BUCKETS))


def fs_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = counters.first_per_device(in_spark(spark, sf_dir, MOUNTS), ["proc", "tmpfs"])
    return hosts.fs_gauges(m).select("host", "device", "metric", F.round("value", 9).alias("value"))


def mem_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory text of hosts, parsed and turned into gauges; a repeated label's last value counts."""
    k = F.col("c_custkey")
    text = F.concat_ws("\n", F.lit("MemTotal: 1 kB"), F.concat(F.lit("MemTotal:   "), k * 1024 + 9000, F.lit(" kB")), F.concat(F.lit("MemFree: "), k * 256, F.lit(" kB")), F.concat(F.lit("MemAvailable: "), k * 512, F.lit(" kB")), F.concat(F.lit("Cached: "), k, F.lit(" kB")), F.lit("SReclaimable: 64 kB"), F.lit("Odd: 0x00ff"), F.lit("eeprom: 8086 0100"), F.lit("no label"), F.concat(F.lit("SwapTotal: "), k % 2 * 2048, F.lit(" kB")), F.concat(F.lit("SwapFree: "), k % 2 * 512, F.lit(" kB")))
    c = snapshots.kv_snapshot(table(spark, sf_dir, "customer").select(k.alias("host"), text.alias("content")))
    return hosts.mem_gauges(c, ["host"]).select("host", "metric", F.round("value", 9).alias("value"))


def load_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load average text of hosts by core; no known cores count as one."""
    k = F.col("c_custkey")
    text = F.concat(k, F.lit(".25 "), k + 1, F.lit(".5 "), k + 2, F.lit(".75 1/200 4711"))
    load = snapshots.column_snapshot(table(spark, sf_dir, "customer").select(k.alias("host"), (k % 5).alias("cores"), text.alias("content")), "loadavg")
    return hosts.load_gauges(load, ["host"]).select("host", "metric", F.round("value", 9).alias("value"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = in_spark(spark, sf_dir, FACTS)
    none = F.array().cast("array<string>")
    platform = F.struct(F.array(F.lit("linux"), F.when(F.col("ts") % 2 == 0, F.col("version")).otherwise("")).alias("nix"), none.alias("mac"), F.array(F.lit("w"), F.lit("10")).alias("win"))
    rows = hosts.host_inventory(f.select("host", "ts", "machine_id", F.struct("cores").alias("cpu"), F.struct("total", "swap_total").alias("memory"), platform.alias("platform")))
    return rows.select("host", "uuid", F.col("cpu_cores").cast("int").alias("cpu_cores"), F.col("memory_total_kb").alias("memory_kb"), F.col("memory_swap_total_kb").alias("swap_kb"), "os_version")


def inventory_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact of an inventory row; a third of the hosts have none of a network, and the OS by the name that icons have."""
    f, k = in_spark(spark, sf_dir, FACTS), F.col("ts")
    text = lambda x: F.concat(F.lit(x), k)
    cpu = F.struct("cores", (F.col("cores") * 2).alias("logical"), text("v").alias("vendor"), F.when(k % 4 > 0, text("m")).alias("model"), (k * 10.5).alias("mhz"))
    os = columns.os_field(F.when(k % 2 == 0, "windows").otherwise("linux"))
    platform = F.struct(F.lit("kn").alias("kernel_name"), text("kr").alias("kernel_release"), text("kv").alias("kernel_version"), os.alias("os"), F.lit("amd64").alias("machine"), F.array(F.lit(""), F.lit("")).alias("nix"), F.array(F.when(k % 3 == 0, F.col("version")).otherwise("")).alias("mac"), F.array(F.lit("w"), F.lit("10")).alias("win"))
    network = F.when(k % 3 > 0, F.struct(text("10.0.0.").alias("ipv4"), text("2001:db8::").alias("ipv6"), text("mac").alias("mac")))
    return hosts.host_inventory(f.select("host", "ts", "machine_id", cpu.alias("cpu"), F.struct("total", "swap_total").alias("memory"), platform.alias("platform"), network.alias("network")), "7.2")


def interface_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status lines of interfaces: keys in any order, twice, without a number, after the first line, and no device at all."""
    k = F.col("s_suppkey")
    text = F.concat(F.when(k % 5 > 0, F.concat(F.lit("device  /net/ether"), k)).otherwise("unbound"), F.lit(" maxtu 1500 sendra 0 pktin 7 pktin "), k, F.lit(" errin x\terrout "), k % 3, F.lit(" other device\npktout 99 maxtu 1"))
    return snapshots.interface_status(table(spark, sf_dir, "supplier").select(k.alias("host"), text.alias("content")))


def fs_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File system gauges with the device's last element: paths with slashes behind, with none, and of nothing else."""
    n = F.col("pos") % 4
    device = F.when(n == 0, F.concat(F.lit("/dev/disk/"), "device", F.lit("//"))).when(n == 1, F.col("device")).when(n == 2, "//").otherwise(F.concat(F.lit("//srv/"), "device"))
    m = in_spark(spark, sf_dir, MOUNTS).withColumn("device", F.concat(device, F.when(n == 2, "").otherwise(F.col("pos").cast("string"))))
    return hosts.fs_gauges(m.filter("blocks > 0")).select("host", "device", "device_name", "metric", F.round("value", 9).alias("value"))


def mounts_octal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes of all kinds, in devices too: a byte of two that make a letter, one beyond 255, cut ones, an escaped backslash."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("//srv\\057share"), k, F.lit(" /mnt/caf\\303\\251\\134040\\04\\8 ext4 rw\n\\501 /a\\ b\n/x\\011y /\\07 nfs 0\n"))
    return snapshots.mount_snapshot(table(spark, sf_dir, "supplier").select(k.alias("host"), text.alias("content"))).select("host", "pos", "device", "mount", "fstype")


def odd_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are no numbers: 0 for CPUs and interfaces, and the end of a disk's line."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    rows = lambda layout, *text: snapshots.column_snapshot(s.select(k.alias("host"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in text]).alias("content")), layout)
    cpu = rows("cpu", "cpu  1 x ", k, " 4 5 6 7 8").select("host", F.lit("cpu").alias("kind"), (F.col("nice") * 1000 + F.col("system")).alias("value"))
    net = rows("netdev", "eth0: ", k, " 0x1 3 4 5 6 7 8 9 10 11 12 13 14 15 16").select("host", F.lit("net").alias("kind"), (F.col("rx_packets") * 1000 + F.col("rx_bytes")).alias("value"))
    disk = rows("diskstats", "8 0 sda 1 2 3 4 5 6 7 8 - 10 ", F.when(k % 2 == 0, "x").otherwise("11"), "\n8 1 sdb ", k, " 2 3 4 5 6 7 8 x 10 11").select("host", F.col("entity").alias("kind"), F.col("reads").alias("value"))
    return cpu.unionByName(net).unionByName(disk)


def state_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state of each of the three families of systems, and ones that none knows."""
    states = ["R", "S", "I", "D", "T", "t", "Z", "X", "x", "W", "U", "r", "?", "", "Ss+", "Running", "Ready", "Scheding", "New", "Stopped", "Moribund", "Dead", "Broken", "Wakeme"]
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, ["linux", "ps", "words"])), (F.col("event_id") % 3 + 1).cast("int")).alias("os"), F.element_at(F.array(*map(F.lit, states)), (F.floor(F.col("event_id") / 3) % len(states) + 1).cast("int")).alias("state"))
    return e.withColumn("code", columns.state_code(F.col("os"), F.col("state")))


def host_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = in_spark(spark, sf_dir, FACTS)
    name = columns.resolve_hostname(F.when(F.col("ts") % 5 == 0, F.col("host")), F.lit(" "), F.lit(None).cast("string"), F.when(F.col("ts") % 3 == 0, F.lit("ip-10-0-0-1")).when(F.col("ts") % 3 == 1, F.concat(F.lit("os"), "ts")), F.when(F.col("ts") % 2 == 0, F.lit("i-1")))
    return f.select("ts", name.alias("name"), columns.host_uuid(F.col("machine_id"), F.col("host")).alias("uuid"))


def network_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.network_summary(in_spark(spark, sf_dir, NICS)).withColumn("addrs", F.array_join("addrs", ","))


def share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory by program after shared segments are divided by their references."""
    p = hosts.shared_memory_share(in_spark(spark, sf_dir, MEMORY), in_spark(spark, sf_dir, SEGMENTS))
    return p.groupBy("host", "pid").agg(F.round(F.sum("memory"), 6).alias("memory"), F.count("*").alias("n"))


def shared_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = in_spark(spark, sf_dir, SEGMENTS).withColumns({"base": F.hex("low"), "top": F.lower(F.hex("high"))})
    return hosts.shared_segment_bytes(s).select("host", _ts(), "pid", "shared")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a process table; one in six opens a process."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("host"), F.to_date("ts").alias("ts"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 6 == 0, F.col("event_id")).alias("pid"))
    return hosts.threads_per_pid(e).select("host", "owner", "threads")


def cpu_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.cpu_topology(in_spark(spark, sf_dir, PACKAGES))


def cpu_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counters.cpu_pct_states(in_spark(spark, sf_dir, STATE_TIMES).withColumn("s", F.array("a", "b", "c", "d", "e")), "s")
    return rows.select("host", _ts(), *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


def cpu_kernel_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counters.cpu_pct_kernel_user(in_spark(spark, sf_dir, STATE_TIMES).selectExpr("host", "ts", "e AS idle", "e + d AS kernel", "a AS user"))
    return rows.select("host", _ts(), *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = in_spark(spark, sf_dir, BINS)
    return counters.max_of_sampled(b, ["host"]).join(counters.latest_sample(b, ["host"], ["pos"], ["a", "b"]), "host")


def sum_over_cpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.sum_over_cpus(in_spark(spark, sf_dir, CPUS), ["user", "idle"]).select("host", _ts(), "tag", "user", "idle")


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n \n\nlast")).alias("content"))
    return hosts.row_counts(d)


def snapshots_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disk statistics text by supplier, parsed back; loop devices are left out."""
    n = lambda k: F.sum((F.col("l_linenumber") * k).cast("long"))
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.concat_ws(" ", F.lit("   8"), F.lit("0"), F.concat(F.when(F.col("l_linenumber") == 3, "loop").otherwise("sd"), "l_linenumber"), *[n(k) for k in range(1, 12)]).alias("t"))
    text = li.groupBy(F.col("l_suppkey").alias("host")).agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("content"))
    return snapshots.column_snapshot(text, "diskstats").select("host", F.col("entity").alias("device"), "reads", "ms_reading", "writes", "ms_io", "weighted_ms_io")


def snapshots_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage text with grouped digits, a compressed token and a negative 32-bit counter."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("total=1,073,741,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" used="), k, F.lit(" junk clumps=7 compressed clumps="), k * 2, F.lit(" wrapped=-"), k + 1, F.lit(" bad=x"))
    return snapshots.token_snapshot(table(spark, sf_dir, "supplier").select(k.alias("host"), text.alias("content")))


def snapshots_ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a process listing, parsed back."""
    p = in_spark(spark, sf_dir, PROCS)
    line = F.concat_ws(" ", F.lit(" "), "pid", F.lit("1 501 20 Ss"), F.col("memory"), F.lit("77"), F.concat(F.col("pid") % 50, F.lit(":07.5")), F.lit("2-01:00:05 root /bin/x -a  b"))
    out = snapshots.ps_table(p.select("host", F.col("snap_ts").alias("ts"), line.alias("line")))
    return out.select(_ts(), "pid", "rss", "user_time", "create_time", "command")


def pid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process status lines whose names hold blanks and parentheses."""
    k = F.col("event_id")
    line = F.concat(k, F.lit(" (a) (b "), k % 7, F.lit(") R "), F.concat_ws(" ", *[k + n for n in range(4, 25)]))
    s = table(spark, sf_dir, "events").select(snapshots.pid_stat(line).alias("s")).select("s.*")
    return s.withColumn("code", columns.state_code(F.lit("linux"), F.col("state")))


def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric suffixes, base names, escapes and tag values of made-up labels of parts."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k, columns.metric_suffix(F.when(k % 10 == 0, F.lit("--Free ")).when(k % 10 == 1, F.lit("%")).otherwise(F.concat(F.lit("("), "p_type", F.lit(")")))).alias("suffix"), columns.device_basename(F.when(k % 3 == 0, F.lit("/")).otherwise(F.concat(F.lit("/dev/#d"), k))).alias("base"), columns.unescape_octal(F.concat(F.lit("/m\\040"), k, F.lit("\\134040\\04"))).alias("path"), columns.tag_value(F.concat(F.lit("a:1,size:"), "p_size", F.lit(":x,size:2")), "size").alias("size"), columns.truncate_text(F.repeat(F.lit("é"), F.col("p_size"))).alias("short"), columns.wrap32(F.lit(5) - k).alias("wrapped"))


def users_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows as counters: labels mapped to metrics, customers' names looked up, tags of their hosts added."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("uid"), F.concat(F.lit("n"), F.col("o_custkey") % 25).alias("host"), F.col("o_orderstatus").alias("label"), F.array(F.lit("a:b")).alias("tags"))
    users = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, -1 - F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("uid"), F.col("c_name").alias("name"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "n").otherwise("x"), "n_nationkey").alias("host"), F.array(F.concat(F.lit("nation:"), "n_name")).alias("global_tags"))
    rows = hosts.label_map(o, {"F": ("orders.done", "counter"), "O": ("orders.open", "gauge")})
    return hosts.enrich_host(hosts.lookup_user(rows, users), nations).select("o_orderkey", "metric", "kind", "user", F.array_join("tags", ",").alias("tags"))


def storage_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = lambda c: c.cast("double")
    s = table(spark, sf_dir, "supplier").select(F.concat(F.when(k % 4 == 0, "other").otherwise("s"), k).alias("host"), k.alias("k"), F.lit(1).alias("ts"), n((k % 5 > 0).cast("int") * k * 10240).alias("total"), n(F.col("s_nationkey") * 20480).alias("used"), n(k).alias("arenas_total"), n(k % 3).alias("arenas_active"), n(k * 7).alias("uncompressed_bytes"), n(k % 6).alias("compressed_bytes"))
    out = hosts.storage_gauges(s, s.select(F.concat(F.lit("s"), "k").alias("host"), "ts"))
    return out.select("host", "metric", F.round("value", 9).alias("value"), F.array_join("tags", ",").alias("tags"))


def network_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = in_spark(spark, sf_dir, NICS).withColumn("name", F.concat(F.lit("e"), F.col("pos") % 3))
    return hosts.network_interfaces(n).select("host", "name", "mac", F.array_join("ipv4", ",").alias("ipv4"), F.array_join("ipv6", ",").alias("ipv6"))


def agent_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.agent_inventory(in_spark(spark, sf_dir, FACTS), "7.1", "small")


def mem_gauges_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("double")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("host"), (k * 4096 * 10).alias("memory"), (k * 3).alias("pages_used"), (k * (F.col("c_custkey") % 20)).alias("pages_total"), (k * 2).alias("swap_used"), (k * 4096 * (F.col("c_custkey") % 4)).alias("swap_capacity"), k.alias("malloc_used"), (k * (F.col("c_custkey") % 2)).alias("malloc_total"))
    return hosts.mem_gauges_pages(c, ["host"]).select("host", "metric", F.round("value", 9).alias("value"))


def mem_gauges_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("double")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("host"), (k * 1048576 * (F.col("c_custkey") % 5)).alias("total"), (k * 262144).alias("free"), (k * 524288).alias("usable"))
    return hosts.mem_gauges_simple(c, ["host"]).select("host", "metric", F.round("value", 9).alias("value"))


def link_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of parts: text of a radio's signal, a state and a speed for some, two error counters."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("Signal: -"), k % 90, F.lit("\nnoise 1"))).when(k % 3 == 1, F.lit("Signal: x")).otherwise("\nSignal: -1")
    p = table(spark, sf_dir, "part").select(k.alias("device"), F.when(k % 4 > 0, k % 2).alias("link"), F.when(k % 5 > 0, k).alias("speed"), (k % 3 * 500).alias("mtu"), columns.signal_level(text).alias("signal"), F.col("p_size").alias("crc"), F.when(k % 2 == 0, k).alias("overflow"))
    return hosts.link_gauges(p, ["device"], ["crc", "overflow"])


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of temperature and battery text."""
    k = F.col("p_partkey")
    heat = F.when(k % 7 == 0, F.lit("")).when(k % 7 == 1, F.lit("hot 20")).otherwise(F.concat(F.lit("  "), k % 200 - 20, F.lit(".5 degrees")))
    charge = F.when(k % 5 == 0, F.lit("high -1 -1")).when(k % 5 == 1, F.lit("unknown\n50")).when(k % 5 == 2, (k % 101).cast("string")).otherwise(F.concat(F.lit("charging "), k % 101, F.lit(" 73")))
    return table(spark, sf_dir, "part").select(k, columns.plausible_range(heat, 0, 150).alias("heat"), columns.battery_percent(charge).alias("charge"))


def graph_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters out of bins text: the largest max of sampled bins, 32-bit values unwrapped."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    line = F.concat(k, F.lit(": nsamp="), k % 3, F.lit(" min=0 max="), F.when(k % 50 == 1, -k).otherwise(k * 3), F.lit(" avg=1"))
    text = e.groupBy(F.col("user_id").alias("host")).agg(F.concat(F.lit("stats\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("content"))
    return counters.max_of_sampled(snapshots.graph_bins(text), ["host"])


def clock_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last complete clock sample of each host's log."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    line = F.when(k % 4 == 0, F.concat(k + 10_000_000, F.lit(" no sample"))).otherwise(F.concat(k + 10_000_000, F.lit(" sys δ "), k % 1000, F.lit(" avgδ -"), k % 77, F.when(k % 4 == 1, F.lit(" hz")).otherwise(F.concat(F.lit(" hz "), k, F.lit(".5")))))
    text = e.groupBy(F.col("user_id").alias("host")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))
    return counters.latest_sample(snapshots.clock_samples(text), ["host"], ["pos"], ["offset", "avg_offset", "freq"])


def cpu_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPU time text: the total line with and without guest time, a line that is too short, and the cores."""
    k = F.col("c_custkey")
    numbers = F.concat_ws(" ", *[k + n for n in range(7)])
    text = F.concat(F.lit("cpu  "), numbers, F.when(k % 3 > 0, F.concat(F.lit(" "), k + 7)).otherwise(""), F.when(k % 3 == 2, " 9").otherwise(""), F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.concat(F.lit("cpu"), i, F.lit(" 1 2"))), "\n"), F.lit("\nctxt 5"))
    c = table(spark, sf_dir, "customer").select(k.alias("host"), text.alias("content"))
    rows = snapshots.column_snapshot(c, "cpu").filter("entity = 'cpu'").select("host", "user", "steal", "guest")
    return snapshots.cpu_cores(c).join(rows, "host", "left")


def unit_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("double")
    made = {"kb_to_mb": columns.kb_to_mb(k), "bytes_to_kb": columns.bytes_to_kb(k), "bytes_to_mb": columns.bytes_to_mb(k), "pages_to_mb": columns.pages_to_mb(k), "ticks_to_s": columns.ticks_to_s(k), "ratio": columns.ratio(k, k % 3), "nonneg": columns.nonneg(50 - k)}
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(c, 9).alias(n) for n, c in made.items()])


def netdev_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface counters of suppliers' hosts, with and without a blank behind the colon; headings, loopback and short lines go."""
    k = F.col("s_suppkey")
    numbers = F.concat_ws(" ", *[k + n for n in range(16)])
    text = F.concat(F.lit("Inter-|   Receive  | Transmit\n face |bytes packets|bytes\n    lo: "), numbers, F.lit("\n  eth"), k % 3, F.when(k % 2 == 0, ":").otherwise(": "), numbers, F.lit("\nwlan0: 1 2 3"))
    rows = snapshots.column_snapshot(table(spark, sf_dir, "supplier").select(k.alias("host"), text.alias("content")), "netdev")
    return rows.select("host", F.col("entity").alias("device"), *counters.NET)


def sysstat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten numbers for each CPU; lines with fewer go."""
    k = F.col("s_suppkey")
    text = F.concat(F.concat_ws("   ", *[k + n for n in range(10)]), F.lit("\n  "), F.concat_ws(" ", *[k * n for n in range(10)]), F.lit("\n1 2 3\n"))
    rows = snapshots.column_snapshot(table(spark, sf_dir, "supplier").select(k.alias("host"), text.alias("content")), "sysstat")
    return rows.select("host", "pos", "c0", "c1", "c9")


def uptime_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return snapshots.column_snapshot(table(spark, sf_dir, "supplier").select(k.alias("host"), F.concat(k, F.lit(".25 1.5\n")).alias("content")), "uptime").select("host", "uptime")


def mounts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mount tables with escapes; short lines go."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("/dev/d"), k, F.lit(" /mnt/my\\040disk"), k, F.lit(" ext4 rw 0 0\nproc /proc proc rw\nbad line\n"))
    return snapshots.mount_snapshot(table(spark, sf_dir, "supplier").select(k.alias("host"), text.alias("content"))).select("host", "pos", "device", "mount", "fstype")


def fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process status of fixed widths, in bytes; rows with few numbers are left out."""
    k = F.col("s_suppkey")
    line = F.concat(F.rpad(F.concat(F.lit("prog"), k), 28, " "), F.rpad(F.lit("u"), 28, " "), F.rpad(F.lit("Ready"), 12, " "), F.concat_ws(" ", *[k + n for n in range(8)], F.when(k % 4 > 0, "9")))
    return snapshots.fixed_width_snapshot(table(spark, sf_dir, "supplier").select(k.alias("host"), line.alias("line"))).drop("numbers")


QUERIES = {f.__name__: f for f in (state_counts, state_buckets, fs_gauges, mem_gauges, load_gauges, inventory, host_uuid, network_summary, share, shared_bytes, threads, cpu_topology, cpu_states, cpu_kernel_user, bins, sum_over_cpus, row_counts, snapshots_cols, snapshots_tokens, snapshots_ps, pid_stats, label_names, users_and_labels, storage_gauges, network_interfaces, agent_inventory, mem_gauges_pages, mem_gauges_simple, link_gauges, sensors, graph_bins, clock_samples, cpu_text, fixed_width, unit_helpers, netdev_text, sysstat_text, uptime_text, mounts_text, inventory_facts, interface_status, fs_tags, mounts_octal, odd_numbers, state_codes)}


def _long(keys: str, items: dict[str, str], rows: str) -> str:
    xs = ", ".join(f"{{'m': '{k}', 'v': CAST({v} AS DOUBLE)}}" for k, v in items.items())
    return f"SELECT {keys}, x.m AS metric, round(x.v, 9) AS value FROM (SELECT {keys}, unnest([{xs}]) AS x FROM {rows}) WHERE x.v IS NOT NULL"


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
_HASH = "sha256(CASE WHEN trim(machine_id) <> '' THEN trim(machine_id) || '/' || host ELSE host END)"
_BACK = "SELECT host, ts, {} FROM (" + in_duck(STATE_TIMES) + ") WINDOW w AS (PARTITION BY host ORDER BY ts)"
_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT) AS ts"
ORACLES = {
    "state_counts": f"SELECT host, state, count(*) FILTER (o_orderstatus = state) AS n FROM (SELECT o_custkey % 9 AS host, o_orderstatus, unnest({STATES!r}) AS state FROM orders) GROUP BY ALL",
    "state_buckets": """SELECT host, state, count(*) FILTER (b = state) AS n FROM (SELECT user_id AS host, ['running', 'ready', 'blocked', 'stopped', 'zombie', 'broken', 'sleeping', 'sleeping', 'running', 'sleeping'][event_id % 10 + 1] AS b,
        unnest(['running', 'ready', 'sleeping', 'blocked', 'stopped', 'zombie', 'broken']) AS state FROM events) GROUP BY ALL""",
    "fs_gauges": _long("host, device", {"total": "blocks * 4", "used": "(blocks - bfree) * 4", "free": "bavail * 4", "in_use": "(blocks - bfree)::DOUBLE / (blocks - bfree + bavail)", "inodes.total": "CASE WHEN files > 0 THEN files END", "inodes.free": "CASE WHEN files > 0 THEN ffree END", "inodes.used": "CASE WHEN files > 0 THEN files - ffree END", "inodes.in_use": "CASE WHEN files > 0 THEN (files - ffree)::DOUBLE / files END"}, f"(SELECT * FROM ({in_duck(MOUNTS)}) WHERE fstype <> 'proc' AND blocks > 0 QUALIFY row_number() OVER (PARTITION BY host, device ORDER BY pos) = 1)"),
    "mem_gauges": _long("host", {"total": "t / 1024", "free": "k / 4", "used": "t / 1024 - k / 4", "usable": "k / 2", "cached": "(k + 64) / 1024", "buffered": "0", "shared": "0", "slab": "0", "swap_total": "s * 2", "swap_free": "s / 2", "swap_used": "s * 1.5", "pct_usable": "k * 512 / t", "swap_pct_free": "CASE WHEN s > 0 THEN 0.25 END"}, "(SELECT c_custkey AS host, c_custkey::DOUBLE AS k, c_custkey::DOUBLE * 1024 + 9000 AS t, (c_custkey % 2)::DOUBLE AS s FROM customer)"),
    "load_gauges": _long("host", {"load.1": "host + 0.25", "load.5": "host + 1.5", "load.15": "host + 2.75", "load.norm.1": "(host + 0.25)::DOUBLE / n", "load.norm.5": "(host + 1.5)::DOUBLE / n", "load.norm.15": "(host + 2.75)::DOUBLE / n"}, "(SELECT c_custkey AS host, greatest(c_custkey % 5, 1) AS n FROM customer)"),
    "inventory": f"""SELECT host, {_UUID} AS uuid, cores AS cpu_cores, total // 1024 AS memory_kb, swap_total AS swap_kb, CASE WHEN ts % 2 = 0 THEN version ELSE '10' END AS os_version
        FROM (SELECT *, {_HASH} AS h FROM ({in_duck(FACTS)}) QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC) = 1)""",
    "host_uuid": f"""SELECT ts, CASE WHEN ts % 5 = 0 THEN host WHEN ts % 3 = 1 THEN 'os' || ts WHEN ts % 2 = 0 THEN 'i-1' WHEN ts % 3 = 0 THEN 'ip-10-0-0-1' ELSE 'unknown' END AS name, {_UUID} AS uuid FROM (SELECT *, {_HASH} AS h FROM ({in_duck(FACTS)}))""",
    "network_summary": f"""SELECT host, arg_min(addr, pos) FILTER (NOT six) AS ipv4, arg_min(mac, pos) FILTER (NOT six) AS mac, arg_min(addr, pos) FILTER (six) AS ipv6, string_agg(DISTINCT addr, ',' ORDER BY addr) AS addrs
        FROM (SELECT *, contains(addr, ':') AS six FROM ({in_duck(NICS)}) WHERE NOT loopback AND NOT starts_with(addr, '169.254.') AND NOT starts_with(addr, 'fe80:')) GROUP BY host""",
    "share": f"""SELECT host, pid, round(sum(memory / greatest(coalesce(r, 1), 1)), 6) AS memory, count(*) AS n FROM ({in_duck(MEMORY)})
        LEFT JOIN (SELECT host, ts, pid, max(ref) AS r FROM ({in_duck(SEGMENTS)}) WHERE segment <> 'Text' GROUP BY ALL) USING (host, ts, pid) GROUP BY host, pid""",
    "shared_bytes": f"SELECT host, {_SECONDS}, pid, CAST(coalesce(sum(high - low) FILTER (ref > 1), 0) AS BIGINT) AS shared FROM ({in_duck(SEGMENTS)}) GROUP BY host, ts, pid",
    "threads": """SELECT host, owner, count(*) AS threads FROM (SELECT user_id % 10 AS host, ts::DATE AS d, max(CASE WHEN event_id % 6 = 0 THEN event_id END) OVER (PARTITION BY user_id % 10, ts::DATE ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS owner FROM events)
        WHERE owner IS NOT NULL GROUP BY host, d, owner""",
    "cpu_topology": f"""SELECT host, count(*) AS logical, arg_min(vendor, pos) FILTER (vendor <> '') AS vendor, arg_min(model, pos) FILTER (model <> '') AS model, arg_min(family, pos) FILTER (family <> '') AS family, arg_min(mhz, pos) FILTER (mhz > 0) AS mhz,
        CASE WHEN count(core_id) > 0 THEN count(DISTINCT (physical_id, core_id)) FILTER (core_id IS NOT NULL) ELSE count(*) END AS cores FROM ({in_duck(PACKAGES)}) GROUP BY host""",
    "cpu_states": f"SELECT host, {_SECONDS}, round(100 * (a + b) / t, 6) AS user_pct, round(100 * (c + d) / t, 6) AS system_pct, round(100 * e / t, 6) AS idle_pct FROM (SELECT *, a + b + c + d + e AS t FROM ({_BACK.format(', '.join(f'{x} - lag({x}) OVER w AS {x}' for x in 'abcde'))})) WHERE t > 0",
    "cpu_kernel_user": f"SELECT host, {_SECONDS}, round(100 * a / t, 6) AS user_pct, round(100 * d / t, 6) AS system_pct, round(100 * e / t, 6) AS idle_pct FROM (SELECT *, a + d + e AS t FROM ({_BACK.format(', '.join(f'{x} - lag({x}) OVER w AS {x}' for x in 'ade'))})) WHERE t > 0",
    "bins": f"SELECT host, max(\"max\") FILTER (nsamp > 0) AS value, arg_max(a, pos) FILTER (a IS NOT NULL AND b IS NOT NULL) AS a, arg_max(b, pos) FILTER (a IS NOT NULL AND b IS NOT NULL) AS b FROM ({in_duck(BINS)}) GROUP BY host HAVING value IS NOT NULL AND a IS NOT NULL",
    "sum_over_cpus": f"SELECT host, {_SECONDS}, 'cpu:' || cpu AS tag, user, idle FROM ({in_duck(CPUS)}) c UNION ALL SELECT host, {_SECONDS}, 'total', sum(user), sum(idle) FROM ({in_duck(CPUS)}) c GROUP BY host, c.ts",
    "row_counts": "SELECT doc_id, 1 + len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS n FROM documents",
    "snapshots_cols": "SELECT l_suppkey AS host, 'sd' || l_linenumber AS device, sum(l_linenumber)::DOUBLE AS reads, sum(l_linenumber * 4)::DOUBLE AS ms_reading, sum(l_linenumber * 5)::DOUBLE AS writes, sum(l_linenumber * 10)::DOUBLE AS ms_io, sum(l_linenumber * 11)::DOUBLE AS weighted_ms_io FROM lineitem WHERE l_linenumber <> 3 GROUP BY l_suppkey, l_linenumber",
    "snapshots_tokens": "SELECT s_suppkey AS host, x.k AS key, x.v AS value FROM (SELECT s_suppkey, unnest([{'k': 'total', 'v': (1073741000 + s_suppkey % 1000)::DOUBLE}, {'k': 'used', 'v': s_suppkey::DOUBLE}, {'k': 'clumps', 'v': 7.0::DOUBLE}, {'k': 'compressed_clumps', 'v': (s_suppkey * 2)::DOUBLE}, {'k': 'wrapped', 'v': (4294967295 - s_suppkey)::DOUBLE}]) AS x FROM supplier)",
    "snapshots_ps": f"SELECT CAST(floor(epoch(snap_ts)) AS BIGINT) AS ts, CAST(pid AS BIGINT) AS pid, memory * 1024 AS rss, (pid % 50) * 60 + 7.5::DOUBLE AS user_time, CAST((floor(epoch(snap_ts)) - 176405) * 1000 AS BIGINT) AS create_time, '/bin/x -a  b' AS command FROM ({in_duck(PROCS)})",
    "pid_stats": "SELECT CAST(event_id AS INTEGER) AS pid, 'a) (b ' || (event_id % 7) AS name, 'R' AS state, event_id + 4 AS ppid, event_id + 14 AS utime, event_id + 15 AS stime, event_id + 20 AS threads, event_id + 22 AS start, 2 AS code FROM events",
    "label_names": r"""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'free_stat' WHEN 1 THEN 'unknown' ELSE trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') END AS suffix, CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE 'd' || p_partkey END AS base,
        '/m ' || p_partkey || '\040\04' AS path, p_size || ':x' AS size, CASE WHEN p_size > 24 THEN repeat('é', 22) || chr(65533) || '...' ELSE repeat('é', p_size) END AS short, CASE WHEN p_partkey > 5 THEN 4294967301 - p_partkey ELSE 5 - p_partkey END AS wrapped FROM part""",
    "users_and_labels": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'orders.done' ELSE 'orders.open' END AS metric, CASE o_orderstatus WHEN 'F' THEN 'counter' ELSE 'gauge' END AS kind, coalesce(c_name, o_custkey::VARCHAR) AS user,
        'a:b' || coalesce(',nation:' || n_name, '') AS tags FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0 LEFT JOIN nation ON n_nationkey = o_custkey % 25 AND n_nationkey % 2 = 0 WHERE o_orderstatus IN ('F', 'O')""",
    "storage_gauges": """WITH s AS (SELECT 's' || s_suppkey AS host, s_suppkey % 4 > 0 AS seen, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * 10240::DOUBLE ELSE 0 END AS t, s_nationkey * 20480::DOUBLE AS u, s_suppkey AS k FROM supplier)
        SELECT host, x.m AS metric, round(x.v, 9) AS value, x.t AS tags FROM (SELECT host, unnest([{'m': 'total', 'v': t / 1024, 't': 'device:store'}, {'m': 'used', 'v': u / 1024, 't': 'device:store'}, {'m': 'free', 'v': greatest(t - u, 0) / 1024, 't': 'device:store'}, {'m': 'in_use', 'v': u / t, 't': 'device:store'},
          {'m': 'arenas_total', 'v': k::DOUBLE, 't': ''}, {'m': 'arenas_active', 'v': (k % 3)::DOUBLE, 't': ''}, {'m': 'uncompressed_bytes', 'v': k * 7::DOUBLE, 't': ''}, {'m': 'compressed_bytes', 'v': (k % 6)::DOUBLE, 't': ''}, {'m': 'compression_ratio', 'v': CASE WHEN k % 6 > 0 THEN k * 7::DOUBLE / (k % 6) END, 't': ''}]) AS x FROM s WHERE seen AND t > 0) WHERE x.v IS NOT NULL
        UNION ALL SELECT host, 'up', CASE WHEN seen THEN 1.0::DOUBLE ELSE 0 END, '' FROM s""",
    "network_interfaces": f"""SELECT host, 'e' || (pos % 3) AS name, arg_min(mac, pos) AS mac, coalesce(string_agg(addr, ',' ORDER BY pos) FILTER (ok AND NOT contains(addr, ':')), '') AS ipv4, coalesce(string_agg(addr, ',' ORDER BY pos) FILTER (ok AND contains(addr, ':')), '') AS ipv6
        FROM (SELECT *, NOT starts_with(addr, '169.254.') AND NOT starts_with(addr, 'fe80:') AS ok FROM ({in_duck(NICS)}) WHERE NOT loopback) GROUP BY host, pos % 3""",
    "agent_inventory": f"SELECT host, {_UUID} AS uuid, '7.1' AS agent_version, 'small' AS flavor, 'full' AS infrastructure_mode FROM (SELECT *, {_HASH} AS h FROM ({in_duck(FACTS)}) QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC) = 1)",
    "mem_gauges_pages": _long("host", {"total": "m / 1048576", "free": "f / 1048576", "used": "(m - f) / 1048576", "pct_usable": "f / nullif(m, 0)", "swap_total": "c / 1048576", "swap_used": "least(s, c) / 1048576", "swap_free": "(c - least(s, c)) / 1048576", "swap_pct_free": "CASE WHEN c > 0 THEN (c - least(s, c)) / c END", "kernel_malloc": "CASE WHEN host % 2 > 0 THEN k / 1048576 END", "kernel_malloc_max": "CASE WHEN host % 2 > 0 THEN k / 1048576 END"},
        "(SELECT *, least(greatest((k * (host % 20) - k * 3) * 4096, 0), m) AS f FROM (SELECT c_custkey AS host, c_custkey::DOUBLE AS k, c_custkey * 40960::DOUBLE AS m, c_custkey * 4096::DOUBLE * (c_custkey % 4) AS c, c_custkey * 8192::DOUBLE AS s FROM customer))"),
    "mem_gauges_simple": _long("host", {"total": "k * (host % 5)", "free": "k / 4", "used": "k * (host % 5) - k / 4", "usable": "k / 2", "pct_usable": "CASE WHEN host % 5 = 0 THEN 0 ELSE 0.5 / (host % 5) END"}, "(SELECT c_custkey AS host, c_custkey::DOUBLE AS k FROM customer)"),
    "link_gauges": """SELECT device, x.m AS metric, x.v AS value FROM (SELECT p_partkey AS device, unnest([{'m': 'link', 'v': CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 2)::DOUBLE END}, {'m': 'speed', 'v': CASE WHEN p_partkey % 5 > 0 THEN p_partkey::DOUBLE END}, {'m': 'mtu', 'v': CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 * 500::DOUBLE END},
        {'m': 'signal', 'v': CASE WHEN p_partkey % 3 = 0 THEN -(p_partkey % 90)::DOUBLE END}, {'m': 'errors', 'v': (p_size + CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE 0 END)::DOUBLE}]) AS x FROM part) WHERE x.v IS NOT NULL""",
    "sensors": """SELECT p_partkey, CASE WHEN p_partkey % 7 > 1 AND p_partkey % 200 >= 20 AND p_partkey % 200 - 20 < 150 THEN p_partkey % 200 - 20 + 0.5::DOUBLE END AS heat, CASE WHEN p_partkey % 5 > 1 THEN (p_partkey % 101)::DOUBLE END AS charge FROM part""",
    "graph_bins": "SELECT user_id AS host, max(CASE WHEN event_id % 50 = 1 THEN 4294967296 - event_id ELSE event_id * 3 END)::DOUBLE AS value FROM events WHERE event_id % 3 > 0 GROUP BY user_id",
    "clock_samples": "SELECT user_id AS host, (arg_max(event_id, event_id) % 1000)::DOUBLE AS \"offset\", -(max(event_id) % 77)::DOUBLE AS avg_offset, max(event_id) + 0.5::DOUBLE AS freq FROM events WHERE event_id % 4 > 1 GROUP BY user_id",
    "cpu_text": "SELECT c_custkey AS host, CAST(c_custkey % 4 + 1 AS INTEGER) AS cores, CASE WHEN c_custkey % 3 > 0 THEN c_custkey::DOUBLE END AS user, CASE WHEN c_custkey % 3 > 0 THEN c_custkey + 7::DOUBLE END AS steal, CASE WHEN c_custkey % 3 = 2 THEN 9::DOUBLE END AS guest FROM customer",
    "fixed_width": "SELECT s_suppkey AS host, 'prog' || s_suppkey AS name, 'u' AS user, 'Ready' AS state, s_suppkey + 6 AS memory_kb FROM supplier WHERE s_suppkey % 4 > 0",
    "unit_helpers": "SELECT p_partkey, round(k / 1024, 9) AS kb_to_mb, round(k / 1024, 9) AS bytes_to_kb, round(k / 1048576, 9) AS bytes_to_mb, round(k / 256, 9) AS pages_to_mb, round(k / 100, 9) AS ticks_to_s, round(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE k / (p_partkey % 3) END, 9) AS ratio, greatest(50 - k, 0) AS nonneg FROM (SELECT *, p_partkey::DOUBLE AS k FROM part)",
    "netdev_text": "SELECT s_suppkey AS host, 'eth' || (s_suppkey % 3) AS device, " + ", ".join(f"(s_suppkey + {n})::DOUBLE AS {c}" for c, n in zip(counters.NET, (0, 1, 2, 3, 8, 9, 10, 11))) + " FROM supplier",
    "sysstat_text": "SELECT s_suppkey AS host, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN s_suppkey ELSE 0 END::DOUBLE AS c0, CASE pos WHEN 0 THEN s_suppkey + 1 ELSE s_suppkey END::DOUBLE AS c1, CASE pos WHEN 0 THEN s_suppkey + 9 ELSE s_suppkey * 9 END::DOUBLE AS c9 FROM supplier, range(2) t(pos)",
    "uptime_text": "SELECT s_suppkey AS host, s_suppkey + 0.25::DOUBLE AS uptime FROM supplier",
    "inventory_facts": f"""
        SELECT host, ts, {_UUID} AS uuid, cores::BIGINT AS cpu_cores, (cores * 2)::BIGINT AS cpu_logical_processors, 'v' || ts AS cpu_vendor, CASE WHEN ts % 4 > 0 THEN 'm' || ts ELSE '' END AS cpu_model, (ts * 10.5)::DOUBLE AS cpu_frequency,
               'kn' AS kernel_name, 'kr' || ts AS kernel_release, 'kv' || ts AS kernel_version, CASE WHEN ts % 2 = 0 THEN 'win32' ELSE 'linux' END AS os, 'amd64' AS cpu_architecture, total // 1024 AS memory_total_kb, swap_total AS memory_swap_total_kb,
               CASE WHEN ts % 3 > 0 THEN '10.0.0.' || ts ELSE '' END AS ip_address, CASE WHEN ts % 3 > 0 THEN '2001:db8::' || ts ELSE '' END AS ipv6_address, CASE WHEN ts % 3 > 0 THEN 'mac' || ts ELSE '' END AS mac_address, '7.2' AS agent_version, CASE WHEN ts % 3 = 0 THEN version ELSE '10' END AS os_version
        FROM (SELECT *, {_HASH} AS h FROM ({in_duck(FACTS)}) QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC) = 1)""",
    "interface_status": "SELECT s_suppkey AS host, '/net/ether' || s_suppkey AS device, 1500.0::DOUBLE AS mtu, s_suppkey::DOUBLE AS pktin, 0.0::DOUBLE AS pktout, 0.0::DOUBLE AS errin, (s_suppkey % 3)::DOUBLE AS errout FROM supplier WHERE s_suppkey % 5 > 0",
    "fs_tags": _long("host, device, device_name", {"total": "blocks * 4", "used": "(blocks - bfree) * 4", "free": "bavail * 4", "in_use": "(blocks - bfree)::DOUBLE / (blocks - bfree + bavail)", "inodes.total": "CASE WHEN files > 0 THEN files END", "inodes.free": "CASE WHEN files > 0 THEN ffree END", "inodes.used": "CASE WHEN files > 0 THEN files - ffree END", "inodes.in_use": "CASE WHEN files > 0 THEN (files - ffree)::DOUBLE / files END"}, f"(SELECT * REPLACE (CASE pos % 4 WHEN 0 THEN '/dev/disk/' || device || '//' || pos WHEN 1 THEN device || pos WHEN 2 THEN '//' ELSE '//srv/' || device || pos END AS device), CASE pos % 4 WHEN 0 THEN pos::VARCHAR WHEN 2 THEN '/' ELSE device || pos END AS device_name FROM ({in_duck(MOUNTS)}) WHERE blocks > 0)"),
    "mounts_octal": """SELECT s_suppkey AS host, CAST(0 AS INTEGER) AS pos, '//srv/share' || s_suppkey AS device, '/mnt/café' || chr(92) || '040' || chr(92) || '04' || chr(92) || '8' AS mount, 'ext4' AS fstype FROM supplier
        UNION ALL SELECT s_suppkey, 1, 'A', '/a' || chr(92), 'b' FROM supplier UNION ALL SELECT s_suppkey, 2, '/x' || chr(9) || 'y', '/' || chr(92) || '07', 'nfs' FROM supplier""",
    "odd_numbers": """SELECT s_suppkey AS host, 'cpu' AS kind, s_suppkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'net', s_suppkey FROM supplier
        UNION ALL SELECT s_suppkey, 'sdb', s_suppkey FROM supplier UNION ALL SELECT s_suppkey, 'sda', 1 FROM supplier WHERE s_suppkey % 2 > 0""",
    "state_codes": """
        WITH v(os, codes) AS (VALUES ('linux', [2, 3, 3, 1, 4, 4, 7, 6, 6, 5, 0, 0, 0, 0, 3, 2, 2, 3, 0, 3, 0, 1, 0, 5]), ('ps', [2, 3, 3, 3, 4, 3, 7, 3, 3, 3, 1, 3, 3, 0, 3, 2, 2, 3, 3, 3, 3, 3, 3, 3]), ('words', [3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 2, 2, 2, 2, 4, 7, 7, 6, 3])),
        s AS (SELECT ['R', 'S', 'I', 'D', 'T', 't', 'Z', 'X', 'x', 'W', 'U', 'r', '?', '', 'Ss+', 'Running', 'Ready', 'Scheding', 'New', 'Stopped', 'Moribund', 'Dead', 'Broken', 'Wakeme'] AS names)
        SELECT event_id, os, names[event_id // 3 % 24 + 1] AS state, CAST(codes[event_id // 3 % 24 + 1] AS INTEGER) AS code FROM events JOIN v ON os = ['linux', 'ps', 'words'][event_id % 3 + 1], s""",
    "mounts_text": "SELECT s_suppkey AS host, CAST(0 AS INTEGER) AS pos, '/dev/d' || s_suppkey AS device, '/mnt/my disk' || s_suppkey AS mount, 'ext4' AS fstype FROM supplier UNION ALL SELECT s_suppkey, 1, 'proc', '/proc', 'proc' FROM supplier",
}
