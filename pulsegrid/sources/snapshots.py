"""Snapshot text of hosts, to counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import to_double, unescape_octal, utf8_text, wrap32

#: Fixed layouts of white-space separated lines: fewest columns, names of columns (from 0) and lines to skip.
LAYOUTS = {
    "cpu": (9, {"user": 1, "nice": 2, "system": 3, "idle": 4, "iowait": 5, "irq": 6, "softirq": 7, "steal": 8, "guest": 9}, r"^(?!cpu[0-9 ])"),
    "netdev": (17, {"rx_bytes": 1, "rx_packets": 2, "rx_errs": 3, "rx_drop": 4, "tx_bytes": 9, "tx_packets": 10, "tx_errs": 11, "tx_drop": 12}, r"^\s*lo\b|\|"),
    "diskstats": (14, {"reads": 3, "reads_merged": 4, "sectors_read": 5, "ms_reading": 6, "writes": 7, "writes_merged": 8, "sectors_written": 9, "ms_writing": 10, "ms_io": 12, "weighted_ms_io": 13}, r"^\s*\d+\s+\d+\s+(loop|ram)"),
    "loadavg": (3, {"load1": 0, "load5": 1, "load15": 2}, r"^$"),
    "uptime": (1, {"uptime": 0}, r"^$"),
    "sysstat": (10, {f"c{k}": k for k in range(10)}, r"^$"),
}


def _lines(df: DataFrame, content: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != content], F.posexplode(F.split(content, "\n", -1)).alias("pos", "text"))


def kv_snapshot(df: DataFrame, content: str = "content") -> DataFrame:
    """`Label: value [unit]` lines to `(label, value)`; lines that aren't numeric go, the last of equal labels wins."""
    keys = [c for c in df.columns if c != content]
    parts = _lines(df, content).withColumn("p", F.split("text", ":", 2)).filter("size(p) = 2")
    value = to_double(F.get(F.split(F.trim(F.get("p", F.lit(1))), r"\s+"), F.lit(0)))
    alone = F.trim(F.get("p", F.lit(1))).rlike(r"^\S+(\s+[A-Za-z/%]+)?$")
    rows = parts.filter(alone).select(*keys, "pos", F.trim(F.get("p", F.lit(0))).alias("label"), value.alias("value")).filter("value is not null")
    return rows.groupBy(*keys, "label").agg(F.max_by("value", "pos").alias("value"))


def column_snapshot(df: DataFrame, layout: str, content: str = "content") -> DataFrame:
    """Lines of a fixed layout to wide counters; the entity is the first word (third for disks), without a colon.

    A word that is no number counts as 0 for CPUs, interfaces and loads; a disk's line with one goes."""
    least, names, skip = LAYOUTS[layout]
    keys = [c for c in df.columns if c != content]
    rows = _lines(df, content).filter(~F.col("text").rlike(skip)).withColumn("f", F.split(F.trim(F.regexp_replace("text", r"^(\s*\S+?):\s*", "$1 ")), r"\s+")).filter(F.size("f") >= least)
    word = {n: F.get("f", F.lit(k)) for n, k in names.items()}
    value = {n: F.when(w.isNotNull(), F.coalesce(to_double(w), F.lit(0.0))) if layout in ("cpu", "netdev", "loadavg") else to_double(w) for n, w in word.items()}
    out = rows.select(*keys, "pos", F.get("f", F.lit(2 if layout == "diskstats" else 0)).alias("entity"), *[v.alias(n) for n, v in value.items()])
    return out.dropna(subset=list(names)) if layout == "diskstats" else out


def mount_snapshot(df: DataFrame, content: str = "content") -> DataFrame:
    """Mount table lines; devices and mounts may hold escapes."""
    keys = [c for c in df.columns if c != content]
    rows = _lines(df, content).withColumn("f", F.split(F.trim("text"), r"\s+")).filter(F.size("f") >= 3)
    return rows.select(*keys, "pos", unescape_octal(F.get("f", F.lit(0))).alias("device"), unescape_octal(F.get("f", F.lit(1))).alias("mount"), F.get("f", F.lit(2)).alias("fstype"))


def pid_stat(line: Column) -> Column:
    """A process status line; the name lies between the first '(' and the last ')'."""
    rest = F.split(F.trim(F.regexp_extract(line, r"(?s)^[^(]*\(.*\)\s*(.*)$", 1)), r"\s+")
    n = lambda k: F.get(rest, F.lit(k - 3)).try_cast("long")
    return F.struct(F.regexp_extract(line, r"^(\d+)", 1).try_cast("int").alias("pid"), F.regexp_extract(line, r"(?s)^[^(]*\((.*)\)", 1).alias("name"), F.get(rest, F.lit(0)).alias("state"), n(4).alias("ppid"), n(14).alias("utime"), n(15).alias("stime"), n(20).alias("threads"), n(22).alias("start"))


def token_snapshot(df: DataFrame, content: str = "content") -> DataFrame:
    """`key=value` tokens; commas in numbers go, and a token `compressed` before one is put in front of its key."""
    keys = [c for c in df.columns if c != content]
    tokens = F.split(F.trim(content), r"\s+")
    pairs = F.transform(tokens, lambda t, i: F.struct(F.concat(F.when(F.get(tokens, i - 1) == "compressed", "compressed_").otherwise(""), F.substring_index(t, "=", 1)).alias("key"), wrap32(to_double(F.replace(F.substring_index(t, "=", -1), F.lit(",")))).alias("value"), t.contains("=").alias("ok"), i.alias("pos")))
    rows = df.select(*keys, F.inline(F.filter(pairs, lambda p: p["ok"] & p["value"].isNotNull())))
    return rows.groupBy(*keys, "key").agg(F.max_by("value", "pos").alias("value"))


#: What follows each of these words on the first line of an interface's status.
INTERFACE_STATUS = {"device": "device", "maxtu": "mtu", "pktin": "pktin", "pktout": "pktout", "errin": "errin", "errout": "errout"}


def interface_status(df: DataFrame, content: str = "content") -> DataFrame:
    """`key value` words of a status' first line to columns: each known key takes the word behind it, wherever it stands; of
    equal keys the last counts. Missing numbers, and words that are none, are 0; a status without a device goes."""
    keys = [c for c in df.columns if c != content]
    words = df.select(*keys, F.split(F.trim(F.regexp_replace(F.substring_index(content, "\n", 1), r"\s+", " ")), " ").alias("f"))

    def after(token: str) -> Column:
        found = F.filter(F.transform("f", lambda x, i: F.when(x == token, F.get("f", i + 1))), lambda v: v.isNotNull())
        return F.get(found, F.size(found) - 1)

    out = words.select(*keys, *[(after(k) if k == "device" else F.coalesce(to_double(after(k)), F.lit(0.0))).alias(n) for k, n in INTERFACE_STATUS.items()])
    return out.filter("device <> ''")


def graph_bins(df: DataFrame, content: str = "content") -> DataFrame:
    """Lines of `nsamp=.. max=..` tokens to `(pos, nsamp, max)`, 32-bit values unwrapped; lines without a max go. A13
    takes a counter's present value from them."""
    keys = [c for c in df.columns if c != content]
    get = lambda k: F.regexp_extract("text", rf"(?:^|\s){k}=([+-]?[0-9]+)(?=\s|\z)", 1).try_cast("long")
    return _lines(df, content).select(*keys, "pos", F.coalesce(get("nsamp"), F.lit(-1)).alias("nsamp"), wrap32(get("max")).cast("double").alias("max")).filter("max is not null")


def clock_samples(df: DataFrame, content: str = "content") -> DataFrame:
    """Lines with a number behind each of the tokens δ, avgδ and hz to `(pos, offset, avg_offset, freq)`, null where a
    line lacks one. W14 takes the last complete sample from them."""
    keys = [c for c in df.columns if c != content]
    words = _lines(df, content).withColumn("f", F.split(F.trim("text"), r"\s+"))

    def after(token: str) -> Column:
        found = F.filter(F.transform("f", lambda x, i: F.when(x == token, to_double(F.get("f", i + 1)))), lambda v: v.isNotNull())
        return F.get(found, F.size(found) - 1)

    return words.select(*keys, "pos", after("δ").alias("offset"), after("avgδ").alias("avg_offset"), after("hz").alias("freq"))


def cpu_cores(df: DataFrame, content: str = "content") -> DataFrame:
    """S14, for W3: the number of single CPUs' lines of each snapshot."""
    keys = [c for c in df.columns if c != content]
    return df.select(*keys, F.size(F.filter(F.split(content, "\n"), lambda x: x.rlike(r"^cpu\S"))).alias("cores"))


def fixed_width_snapshot(df: DataFrame, line: str = "line") -> DataFrame:
    """Process status of fixed widths: name 28 bytes, user 28, state 12, then numbers (memory is the 7th)."""
    raw = F.encode(F.col(line), "UTF-8")
    part = lambda a, n: F.trim(utf8_text(F.substring(raw, a, n)))
    numbers = F.transform(F.split(part(69, 1 << 30), r"\s+"), lambda x: x.try_cast("long"))
    return df.select(*[c for c in df.columns if c != line], part(1, 28).alias("name"), part(29, 28).alias("user"), part(57, 12).alias("state"), numbers.alias("numbers")).filter(F.size("numbers") >= 9).withColumn("memory_kb", F.get("numbers", F.lit(6)))


def clock_seconds(t: Column) -> Column:
    """[[DD-]HH:]MM:SS to seconds."""
    days = F.when(t.contains("-"), F.substring_index(t, "-", 1).try_cast("double")).otherwise(0.0)
    return days * 86400 + F.aggregate(F.split(F.substring_index(t, "-", -1), ":"), F.lit(0.0), lambda a, x: a * 60 + F.coalesce(x.try_cast("double"), F.lit(0.0)))


def ps_table(df: DataFrame, line: str = "line", now: str = "ts") -> DataFrame:
    """Rows of `ps` (pid ppid uid gid state rss vsz time elapsed user command) to processes; sizes in bytes."""
    f = F.split(F.trim(line), r"\s+", 11)
    n = lambda k, t="long": F.get(f, F.lit(k)).try_cast(t)
    rows = df.filter(F.size(f) >= 11)
    return rows.select(*[c for c in df.columns if c != line], n(0).alias("pid"), n(1).alias("ppid"), n(2).alias("uid"), n(3).alias("gid"), F.get(f, F.lit(4)).alias("state"), (n(5) * 1024).alias("rss"), (n(6) * 1024).alias("vms"), clock_seconds(F.get(f, F.lit(7))).alias("user_time"), ((F.unix_timestamp(now) - clock_seconds(F.get(f, F.lit(8)))) * 1000).cast("long").alias("create_time"), F.get(f, F.lit(9)).alias("user"), F.get(f, F.lit(10)).alias("command"))
