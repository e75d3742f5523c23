"""Reconciliation of two recordings, and assertions on one.

Recordings are tables of records (`sources.files.RECORD`) with `pos`, the place in the recording; where the last or first
record of a kind counts, `pos` decides. Verdict rows are `(section, key, verdict, ours, other)` with the verdicts ok,
note and fail.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import approx_equal, same_tags, tag_value, truncate_text, within
from .flush import run_total

VERDICT = ["section", "key", "verdict", "ours", "other"]
#: Fixed value: what the header that a forwarding agent sets begins with.
VIA = "trace-agent "


def _rows(df: DataFrame, section: str, key: Column, verdict: Column, ours: Column, other: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), key.alias("key"), verdict.alias("verdict"), truncate_text(ours.cast("string")).alias("ours"), truncate_text(other.cast("string")).alias("other"))


def _if(ok: Column) -> Column:
    return F.when(ok, "ok").otherwise("fail")


def _item(name: str, verdict: Column, ours: Column | None = None, other: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return F.struct(F.lit(name).alias("name"), verdict.alias("verdict"), text(ours).alias("a"), text(other).alias("b"))


def _unfold(df: DataFrame, section: str, items: Sequence[Column]) -> DataFrame:
    """Verdict rows of the items that have a verdict; their keys are `key`/name, or the name alone where key is ''."""
    flat = df.select("key", F.inline(F.filter(F.array(*items), lambda x: x["verdict"].isNotNull())))
    return _rows(flat, section, F.when(F.col("key") == "", F.col("name")).otherwise(F.concat_ws("/", "key", "name")), F.col("verdict"), F.col("a"), F.col("b"))


def _pair(ours: DataFrame, other: DataFrame) -> DataFrame:
    """`(key, x, y)` of two tables with a row for each key, full outer."""
    side = lambda d, n: d.select("key", F.struct(*[c for c in d.columns if c != "key"]).alias(n))
    return side(ours, "x").join(side(other, "y"), "key", "full_outer")


def compare_series(ours: DataFrame, other: DataFrame, prefix: str = "", ignore: str = "") -> DataFrame:
    """Metrics side by side. Gauges and rate-type metrics are two lists: gauges must agree in value, rate-type keys only
    be on both sides, so a key that is a gauge here and a rate there fails in both."""
    a, b = (run_total(s.filter(F.col("metric").startswith(prefix)), ignore) for s in (ours, other))
    j = a.select("key", "is_sum", F.col("total").alias("x")).join(b.select("key", "is_sum", F.col("total").alias("y")), ["key", "is_sum"], "full_outer")
    here = F.col("x").isNotNull() & F.col("y").isNotNull()
    verdict = _if(here & (F.col("is_sum") | approx_equal(F.col("x"), F.col("y"))))
    return _rows(j, "series", F.when(F.col("is_sum"), F.concat(F.lit("rate "), "key")).otherwise(F.col("key")), verdict, F.col("x"), F.col("y"))


def compare_logs(ours: DataFrame, other: DataFrame, service: str = "") -> DataFrame:
    """The last row of each message side by side; differing tags are only a note."""
    cols = ["source", "service", "status", "ddtags"]
    last = lambda d, n: (d.filter(F.col("service") == service) if service else d).groupBy("message").agg(F.max_by(F.struct(*cols), "pos").alias(n))
    j = last(ours, "x").join(last(other, "y"), "message", "full_outer")
    differ = F.lit(False)
    for c in cols[:3]:
        differ = differ | ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    verdict = F.when(F.col("x").isNull() | F.col("y").isNull() | differ, "fail").when(same_tags(F.col("x.ddtags"), F.col("y.ddtags")), "ok").otherwise("note")
    return _rows(j, "logs", truncate_text(F.col("message")), verdict, F.to_json("x"), F.to_json("y"))


def subset_check(ours: DataFrame, other: DataFrame, prefix: str = "") -> DataFrame:
    """Each of our metrics must be on the other side with the same type."""
    names = lambda d, n: d.filter(F.col("metric").startswith(prefix)).groupBy("metric").agg(F.max_by("type", "ts").alias(n))
    j = names(ours, "x").join(names(other, "y"), "metric", "full_outer")
    verdict = F.when(F.col("x").isNull(), "note").when(F.col("x") == F.col("y"), "ok").otherwise("fail")
    return _rows(j, "subset", F.col("metric"), F.coalesce(verdict, F.lit("fail")), F.col("x"), F.col("y"))


def tolerance_check(ours: DataFrame, other: DataFrame, tolerances: dict[str, tuple[float, float]]) -> DataFrame:
    """The latest values of named metrics (no device, one tag at most) agree within a relative tolerance, a share of the
    other side's value, or where that is 0 an absolute one. A metric that a side lacks can't be compared: a note."""
    last = lambda d, n: d.filter(F.col("metric").isin(*tolerances) & (F.coalesce("device", F.lit("")) == "") & (F.coalesce(F.size("tags"), F.lit(0)) <= 1)).groupBy("metric").agg(F.max_by("value", "ts").alias(n))
    named = ours.sparkSession.createDataFrame([(m, float(r), float(a)) for m, (r, a) in tolerances.items()], "metric string, rel double, abs double")
    j = named.join(last(ours, "x"), "metric", "left").join(last(other, "y"), "metric", "left")
    limit = F.when(F.col("rel") > 0, F.col("rel") * F.abs("y")).otherwise(F.col("abs"))
    verdict = F.when(F.col("x").isNull() | F.col("y").isNull(), "note").otherwise(_if(F.abs(F.col("x") - F.col("y")) <= limit))
    return _rows(j, "tolerance", F.col("metric"), verdict, F.col("x"), F.col("y"))


def compare_facts(ours: DataFrame, other: DataFrame, attrs: Sequence[str], nums: dict[str, float], tag: str = "", notes: Sequence[str] = (), key: str = "host") -> DataFrame:
    """For each key one row of facts (attrs, nums, tags) on both sides; attributes are equal, numbers within a share of
    the other side's, `tag` is among the tags of both; `notes` are attributes that are only shown. A missing attribute
    is '', a missing number 0. A key that a side lacks is one failure."""
    cols = ["attrs", "nums", *(["tags"] if tag else [])]
    j = _pair(*(d.select(F.col(key).cast("string").alias("key"), *cols) for d in (ours, other)))
    get = lambda s, m, k, none: F.coalesce(F.try_element_at(F.col(f"{s}.{m}"), F.lit(k)), F.lit(none))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    items = [_item("sent by both", _if(both))]
    for a in [*attrs, *notes]:
        x, y = (get(s, "attrs", a, "") for s in "xy")
        items.append(_item(a, F.when(both, F.lit("note") if a in notes else _if(x == y)), x, y))
    for n, rel in nums.items():
        x, y = (get(s, "nums", n, 0.0) for s in "xy")
        items.append(_item(n, F.when(both, _if(F.abs(x - y) <= rel * F.abs(y))), x, y))
    if tag:
        x, y = (F.coalesce(F.array_contains(f"{s}.tags", tag), F.lit(False)) for s in "xy")
        items.append(_item(f"tag {tag}", F.when(both, _if(x & y)), x, y))
    return _unfold(j, "facts", items)


def process_summary(records: DataFrame, kind: str = "process", by: str | None = None) -> DataFrame:
    """For each key (or one row): sent, whether any list can be decoded (its encoding is 0), the last encoding, and
    the largest decoded count with its names (the first of equals)."""
    r = records.filter(F.col("kind") == kind).select(F.lit("").alias("key") if by is None else F.col(by).cast("string").alias("key"), "pos", "proc_encoding", "proc_count", "proc_names")
    plain = F.col("proc_encoding") == 0
    big = F.max_by("proc_names", F.when(plain & (F.col("proc_count") > 0), F.struct("proc_count", -F.col("pos"))))
    return r.groupBy("key").agg(F.lit(True).alias("sent"), F.bool_or(plain).alias("decoded"), F.max_by("proc_encoding", "pos").alias("encoding"), F.coalesce(F.max(F.when(plain, F.col("proc_count"))), F.lit(0)).alias("count"), big.alias("names"))


def process_names(records: DataFrame, kind: str = "process") -> DataFrame:
    """The distinct names in all decoded lists, as rows."""
    return records.filter((F.col("kind") == kind) & (F.col("proc_encoding") == 0)).select(F.explode("proc_names").alias("name")).distinct()


def compare_processes(ours: DataFrame, other: DataFrame, tolerance: float = 0.25, platform: str = "", by: str | None = None) -> DataFrame:
    """Both sides sent process lists, ours can be decoded and isn't empty, and the counts are within a tolerance. The
    other side's opaque encoding is a note, as is, on `darwin`, that it sent none."""
    j = _pair(process_summary(ours, by=by), process_summary(other, by=by))
    if by is None:  # one row, also where neither sent any
        j = ours.sparkSession.createDataFrame([("",)], "key string").join(j, "key", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    both, alone = yes("x.sent") & yes("y.sent"), F.lit(platform == "darwin") & ~yes("y.sent")
    shown = F.to_json(F.struct("x.count", sample_names(F.col("x.names"), 5).alias("e_g")))
    close = within(F.col("x.count").cast("double"), F.col("y.count").cast("double"), tolerance)
    return _unfold(j, "processes", [
        _item("sent by both", F.when(alone, "note").otherwise(_if(both)), yes("x.sent"), yes("y.sent")),
        _item("list decodes", F.when(alone, F.when(yes("x.decoded") & (F.col("x.count") > 0), "ok")).when(both & yes("x.decoded"), _if(F.col("x.count") > 0)), shown),
        _item("count", F.when(both & ~alone, F.when(~yes("y.decoded"), "note").when(yes("x.decoded"), _if(close))), F.col("x.count"), F.coalesce(F.col("y.count"), F.col("y.encoding"))),
    ])


def first_upload(records: DataFrame, by: str | None = None) -> DataFrame:
    """The first profile record of each key (or of all)."""
    cols = ["prof_via", "prof_api_key", "prof_add_tags", "prof_family", "prof_attach"]
    r = records.filter(F.col("kind") == "profile").withColumn("key", F.lit("") if by is None else F.col(by).cast("string"))
    return r.groupBy("key").agg(F.min_by(F.struct(*cols), "pos").alias("r")).select("key", "r.*")


def compare_uploads(ours: DataFrame, other: DataFrame, by: str | None = None) -> DataFrame:
    """The first upload of both sides: the forwarding header, the key and the same host tag are there, the attachments
    overlap; families are only shown. That neither side sent one is a note."""
    j = _pair(first_upload(ours, by), first_upload(other, by))
    if by is None:
        j = ours.sparkSession.createDataFrame([("",)], "key string").join(j, "key", "left")
    x, y = F.col("x").isNotNull(), F.col("y").isNotNull()
    true = lambda c: F.coalesce(c, F.lit(False))
    host = [tag_value(F.coalesce(F.col(f"{s}.prof_add_tags"), F.lit("")), "host") for s in "xy"]
    each = {
        "via": (true(F.col("x.prof_via").startswith(VIA)) & true(F.col("y.prof_via").startswith(VIA)), F.col("x.prof_via"), F.col("y.prof_via")),
        "api key": (true(F.col("x.prof_api_key")) & true(F.col("y.prof_api_key")), F.col("x.prof_api_key"), F.col("y.prof_api_key")),
        "host tag": ((host[0] != "") & (host[0] == host[1]), F.col("x.prof_add_tags"), F.col("y.prof_add_tags")),
        "attachments": (true(F.arrays_overlap("x.prof_attach", "y.prof_attach")), F.array_join("x.prof_attach", ","), F.array_join("y.prof_attach", ",")),
    }
    items = [_item("forwarded by both", F.when(~x & ~y, "note").otherwise(_if(x & y)), x, y)]
    items += [_item(n, F.when(x & y, _if(ok)), a, b) for n, (ok, a, b) in each.items()]
    return _unfold(j, "uploads", [*items, _item("family", F.when(x & y, "note"), F.col("x.prof_family"), F.col("y.prof_family"))])


def presence(records: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(key, there): whether any record meets each condition, all in one aggregation."""
    got = records.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"a{k}") for k, c in enumerate(conditions.values())])
    return got.select(F.inline(F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"a{k}").alias("there")) for k, n in enumerate(conditions)])))


def compare_presence(ours: DataFrame, other: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Conditions that a record of each side must meet."""
    j = presence(ours, conditions).withColumnRenamed("there", "x").join(presence(other, conditions).withColumnRenamed("there", "y"), "key")
    return _rows(j, "presence", F.col("key"), _if(F.col("x") & F.col("y")), F.col("x"), F.col("y"))


def _first(records: DataFrame, kind: str) -> DataFrame:
    return first_of_kind(records, kind).select(F.lit(kind).alias("key"), "attrs", "nums", "tags")


def parity_report(ours: DataFrame, other: DataFrame, prefix: str, check: str, service: str, host_prefix: str = "system.", ignore: str = "", tolerances: dict[str, tuple[float, float]] | None = None, tag: str = "", platform: str = "") -> DataFrame:
    """The verdicts of J2-J8 over two recordings in one table; `passes` tells whether any failed. On `darwin` the other
    side's process list isn't asked for."""
    a, b = (d.filter("kind = 'series'").withColumn("ts", F.col("pos")) for d in (ours, other))
    series = compare_series(a, b, prefix, ignore)
    there = compare_presence(ours, other, {f"check {check}": (F.col("kind") == "check") & (F.col("check") == check), "event": F.col("kind") == "event", "inv_agent": F.col("kind") == "inv_agent"})
    logs = compare_logs(ours.filter("kind = 'log'"), other.filter("kind = 'log'"), service)
    subset, near = subset_check(a, b, host_prefix), tolerance_check(a.filter(F.col("metric").startswith(host_prefix)), b.filter(F.col("metric").startswith(host_prefix)), tolerances or {}) if tolerances else None
    meta = compare_facts(_first(ours, "meta"), _first(other, "meta"), ["platform", "hostname"], {}, tag, ["os"], key="key")
    inventory = compare_facts(_first(ours, "inv_host"), _first(other, "inv_host"), ["os", "kernel_name", "cpu_architecture"], {"cpu_cores": 0.0, "memory_total_kb": 0.02}, key="key")
    missing = presence(ours, {k: F.col("kind") == k for k in ("meta", "inv_host")}).filter("not there").join(presence(other, {k: F.col("kind") == k for k in ("meta", "inv_host")}).filter("not there").select("key"), "key")
    neither = _rows(missing, "facts", F.concat("key", F.lit("/sent by both")), F.lit("fail"), F.lit("false"), F.lit("false"))
    return union_verdicts(*[x for x in (series, there, logs, subset, near, meta, inventory, neither, compare_processes(ours, other, platform=platform), compare_uploads(ours, other)) if x is not None])


def union_verdicts(*sections: DataFrame) -> DataFrame:
    """Verdict rows of several sections in one table."""
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def passes(report: DataFrame) -> DataFrame:
    """One row: does no verdict fail?"""
    return report.agg(F.coalesce(F.bool_and(F.col("verdict") != "fail"), F.lit(True)).alias("pass"))


def verify(records: DataFrame, series: Sequence[str] = (), platform: str = "", meta: bool = False, min_procs: int = 0, proc_name: str = "", log: str = "", host: str = "", api_key: str = "", profile: bool = False, profile_family: str = "", profile_attach: str = "", check: str = "", event: str = "") -> DataFrame:
    """`(key, verdict, seen)` for each assertion that is asked for, all in one aggregation; asking for none fails.

    Metrics are present; the platform is the first host record's, else the first inventory's; process lists were sent,
    can be decoded, are large enough and name a process; a log message or an event title holds a text; a host is on
    a record or in host facts; every record carries the key and none lacks it; the first upload has the forwarded
    headers, the family and the attachment; a check was sent.
    """
    kind = F.col("kind")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    attr = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit(""))
    first = lambda what, k: F.min_by(what, F.when(kind == k, F.col("pos")))
    true = lambda c: F.coalesce(c, F.lit(False))
    plain = (kind == "process") & (F.col("proc_encoding") == 0)
    key = F.coalesce("api_key", F.lit(""))
    aggs: dict[str, Column] = {f"s{k}": some((kind == "series") & (F.col("metric") == m)) for k, m in enumerate(series)}
    aggs |= {
        "meta": first(attr("platform"), "meta"), "os": first(attr("os"), "inv_host"), "facts": some(kind.isin("meta", "inv_host")),
        "sent": some(kind == "process"), "decoded": some(plain), "procs": F.coalesce(F.max(F.when(plain, F.col("proc_count"))), F.lit(0)), "named": some(plain & F.array_contains("proc_names", proc_name)),
        "log": some((kind == "log") & F.contains("message", F.lit(log))), "host": some((F.col("host") == host) | ((kind == "meta") & (attr("hostname") == host))),
        "keyed": F.count_if(key != ""), "wrong": F.count_if((key != "") & (key != api_key)), "bare": F.count_if(key == ""),
        "up": first(F.struct("prof_via", "prof_api_key", "prof_add_tags", "prof_family", "prof_attach"), "profile"),
        "check": some((kind == "check") & (F.col("check") == check)), "event": some((kind == "event") & F.contains("title", F.lit(event))),
    }
    got = records.agg(*[c.alias(f"_{n}") for n, c in aggs.items()])
    g = {n: F.col(f"_{n}") for n in aggs}
    items = [_item(f"series {m}", _if(g[f"s{k}"])) for k, m in enumerate(series)]
    if platform:
        found = F.coalesce(F.nullif(g["meta"], F.lit("")), g["os"], F.lit(""))
        items.append(_item("platform", _if(found == platform), found))
    if meta:
        items.append(_item("host facts", _if(g["facts"])))
    if min_procs > 0 or proc_name:
        usable = g["sent"] & g["decoded"]
        items.append(_item("process lists", F.when(~usable, "fail"), F.when(g["sent"], "opaque").otherwise("not sent")))
        if min_procs > 0:
            items.append(_item(f"{min_procs} processes", F.when(usable, _if(g["procs"] >= min_procs)), g["procs"]))
        if proc_name:
            items.append(_item(f"process {proc_name}", F.when(usable, _if(g["named"]))))
    if log:
        items.append(_item("log", _if(g["log"])))
    if host:
        items.append(_item(f"host {host}", _if(g["host"])))
    if api_key:
        items.append(_item("api key", _if((g["keyed"] > 0) & (g["wrong"] == 0) & (g["bare"] == 0)), F.concat_ws(",", g["keyed"].cast("string"), g["wrong"].cast("string"), g["bare"].cast("string"))))
    if profile or profile_family or profile_attach:
        up, there = g["up"], g["up"].isNotNull()
        items.append(_item("upload", _if(there & true(up["prof_via"].startswith(VIA)) & true(up["prof_api_key"]) & true(F.contains(up["prof_add_tags"], F.lit("host:"))))))
        if profile_family:
            items.append(_item(f"upload family {profile_family}", F.when(there, _if(true(up["prof_family"] == profile_family))), up["prof_family"]))
        if profile_attach:
            items.append(_item(f"upload attachment {profile_attach}", F.when(there, _if(true(F.array_contains(up["prof_attach"], profile_attach))))))
    if check:
        items.append(_item(f"check {check}", _if(g["check"])))
    if event:
        items.append(_item("event", _if(g["event"])))
    if not items:
        items = [_item("assertions", F.lit("fail"))]
    flat = got.select(F.inline(F.filter(F.array(*items), lambda x: x["verdict"].isNotNull())))
    return flat.select(F.col("name").alias("key"), "verdict", F.col("a").alias("seen"))


def first_of_kind(records: DataFrame, kind: str) -> DataFrame:
    """The first record of a kind."""
    cols = records.columns
    return records.filter(F.col("kind") == kind).agg(F.min_by(F.struct(*cols), "pos").alias("r")).filter("r is not null").select("r.*")


def sample_names(names: Column, n: int) -> Column:
    """The first `n` names in their order by bytes."""
    return F.slice(F.array_sort(names), 1, n)
