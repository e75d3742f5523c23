"""Column expressions of the telemetry model. All of them are built-in functions and stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of plain numbers, and the other forms that a number on a metric line may have.
PLAIN, ODD_NUMBER = "0123456789+-.eE", r"^([+-]?(?i:inf|infinity)|(?i:nan))$"


def utf8_text(b: Column) -> Column:
    """Bytes as text; what isn't UTF-8, as where a cut splits a character, becomes the replacement character."""
    return F.make_valid_utf8(b.cast("string"))


def empty(c: Column, other: Column) -> Column:
    """`other` where c is null or ''."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def to_double(s: Column) -> Column:
    """A strict number: null for anything but plain, exponent, inf and nan forms, and for numbers out of range."""
    v = s.try_cast("double")
    plain = (F.translate(s, PLAIN, "") == "") & (s != "")
    return F.when(plain, F.when(F.abs(v) < float("inf"), v)).when(s.rlike(ODD_NUMBER), v)


def effective_value(type_: Column, value: Column, rate: Column) -> Column:
    """struct<value, weight>: counters are scaled up by the sample rate, histogram samples weigh 1 / rate."""
    r = F.when(rate > 0, rate).otherwise(F.lit(1.0))
    return F.struct(F.when(type_ == "counter", value / r).otherwise(value).alias("value"), F.when(type_.isin("histogram", "timing"), F.try_divide(F.lit(1.0), r)).otherwise(F.lit(1.0)).alias("weight"))


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def canonical_tags(tags: Column) -> Column:
    """Tags as identity: sorted bytewise, null as none."""
    return F.array_sort(F.coalesce(tags, F.array().cast("array<string>")))


def append_global_tags(tags: Column, extra: Iterable[str]) -> Column:
    return F.concat(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, extra)).cast("array<string>"))


def device_of(tags: Column, device: Column) -> Column:
    """An explicit device, else the first non-empty `device:` tag, else ''."""
    found = F.filter(tags, lambda t: t.startswith("device:") & (t != "device:"))
    return empty(device, F.coalesce(F.substring(F.get(found, F.lit(0)), 8, 1 << 30), F.lit("")))


def tags_without_device(tags: Column, device: Column) -> Column:
    """Tags without `device:` ones, unless the device was given explicitly."""
    return F.when(empty(device, F.lit("")) != "", tags).otherwise(F.filter(tags, lambda t: ~t.startswith("device:")))


def journal_status(priority: Column) -> Column:
    """Syslog priorities 0 to 7; info for anything else."""
    names = ["emergency", "alert", "critical", "error", "warning", "notice", "info", "debug"]
    return F.coalesce(*[F.when(priority == str(k), F.lit(n)) for k, n in enumerate(names)], F.lit("info"))


def journal_service(fields: Column, override: str = "") -> Column:
    if override:
        return F.lit(override)
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(k)), F.lit("")) for k in ("SYSLOG_IDENTIFIER", "_SYSTEMD_USER_UNIT", "_SYSTEMD_UNIT", "_COMM")], F.lit(""))


def _is(fields: Column, key: str, values: Iterable[str]) -> Column:
    """Is the field there with one of the values?"""
    return F.coalesce(F.try_element_at(fields, F.lit(key)).isin(*values), F.lit(False))


def _pairs(matches: Iterable[str]) -> list[tuple[str, str]]:
    return [(m[: m.index("=")], m[m.index("=") + 1 :]) for m in matches if m.find("=") > 0]


def journal_drop(fields: Column, units: Iterable[str] = (), user_units: Iterable[str] = (), matches: Iterable[str] = ()) -> Column:
    """True for entries that are excluded. An entry with a user unit is of the user's level, else one with a unit is of the
    system's; '*' excludes all of its level. An entry without either is excluded by matches alone, for which a field
    that isn't there is empty."""
    out = F.lit(False)
    for k, v in _pairs(matches):
        out = out | (F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit("")) == v)

    def hit(key: str, names: list[str]) -> Column:
        return F.lit("*" in names) | _is(fields, key, names)

    level = F.when(F.map_contains_key(fields, "_SYSTEMD_USER_UNIT"), hit("_SYSTEMD_USER_UNIT", list(user_units))).when(F.map_contains_key(fields, "_SYSTEMD_UNIT"), hit("_SYSTEMD_UNIT", list(units)))
    return out | F.coalesce(level, F.lit(False))


def journal_include(fields: Column, units: Iterable[str] = (), user_units: Iterable[str] = (), matches: Iterable[str] = ()) -> Column:
    """OR inside a field, AND across fields. Matches and units make one term; user units are a second one beside it where
    there are units, else they belong to the first."""
    by: dict[str, list[str]] = {}
    for k, v in [*_pairs(matches), *(("_SYSTEMD_UNIT", u) for u in units), *(("_SYSTEMD_USER_UNIT", u) for u in user_units if not units)]:
        by.setdefault(k, []).append(v)
    system = F.lit(True)
    for k, vs in by.items():
        system = system & _is(fields, k, vs)
    return system | _is(fields, "_SYSTEMD_USER_UNIT", list(user_units)) if units and user_units else system


def journal_body(fields: Column) -> Column:
    """JSON text of the fields but MESSAGE, keys sorted, and the message if there is one."""
    rest = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(fields, lambda k, _: k != "MESSAGE"))))
    return F.to_json(F.struct(rest.alias("journald"), F.try_element_at(fields, F.lit("MESSAGE")).alias("message")))


#: The enum's letters are U 0, D 1, R 2, S 3, T 4, W 5, X 6, Z 7; states of each family, and what others are.
STATES = {
    "linux": ({"R": "R", "S": "S", "I": "S", "D": "D", "T": "T", "t": "T", "Z": "Z", "X": "X", "x": "X", "W": "W"}, "U"),
    "ps": ({"": "U", "R": "R", "S": "S", "I": "S", "T": "T", "U": "D", "Z": "Z"}, "S"),
    "words": ({"Running": "R", "Ready": "R", "Scheding": "R", "New": "R", "Stopped": "T", "Moribund": "Z", "Dead": "Z", "Broken": "X"}, "S"),
}


def state_code(os: Column, state: Column) -> Column:
    """Process state enum of the first letter (Linux, ps) or word (the third family). Letters count as they are written; an
    empty state is unknown on Linux and in ps."""
    number = {c: k for k, c in enumerate("UDRSTWXZ")}
    first = F.substring(F.coalesce(state, F.lit("")), 1, 1)

    def code(known: dict[str, str], other: str, word: Column) -> Column:
        return F.coalesce(*[F.when(word == k, F.lit(number[v])) for k, v in known.items()], F.lit(number[other]))

    kinds = {k: code(known, other, state if k == "words" else first) for k, (known, other) in STATES.items()}
    return F.when(os == "linux", kinds["linux"]).when(os == "words", kinds["words"]).otherwise(kinds["ps"]).cast("int")


#: Scheduler words of each state bucket; any other word is `sleeping`.
STATE_BUCKETS = {"running": ["Running", "Scheding"], "ready": ["Ready", "New"], "sleeping": [], "blocked": ["Queueing", "QueueingR", "QueueingW"], "stopped": ["Stopped"], "zombie": ["Moribund", "Dead"], "broken": ["Broken"]}


def state_bucket(state: Column) -> Column:
    """the bucket of a scheduler word; null counts as an unknown word."""
    return F.coalesce(*[F.when(state.isin(*words), F.lit(b)) for b, words in STATE_BUCKETS.items() if words], F.lit("sleeping"))


def metric_suffix(label: Column, reserved: Iterable[str] = ("total", "used", "free")) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    s = F.when(s == "", F.lit("unknown")).otherwise(s)
    return F.when(s.isin(*reserved), F.concat(s, F.lit("_stat"))).otherwise(s)


def device_basename(path: Column) -> Column:
    return empty(F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*\z", 1), "^#", ""), F.lit("unknown"))


def unescape_octal(path: Column) -> Column:
    r"""Escapes of three octal digits, like \040 in mount tables, to the bytes they stand for (mod 256), in one pass from the
    left; anything else stays."""
    parts = F.regexp_extract_all(path, F.lit(r"(\\[0-7]{3}|\\|[^\\]+)"), F.lit(1))
    byte = lambda p: F.lpad(F.hex(F.conv(F.substring(p, 2, 3), 8, 10).cast("int") % 256), 2, "0")
    raw = F.transform(parts, lambda p: F.when(p.rlike(r"\A\\[0-7]{3}\z"), byte(p)).otherwise(F.hex(F.encode(p, "UTF-8"))))
    return F.when(F.contains(path, F.lit("\\")), utf8_text(F.unhex(F.array_join(raw, "")))).otherwise(path)


def base_name(path: Column) -> Column:
    """The last element of a path, without slashes behind it; '.' for none, '/' for nothing but slashes."""
    bare = F.regexp_replace(path, r"/+\z", "")
    return F.when(path == "", ".").when(bare == "", "/").otherwise(F.regexp_extract(bare, r"([^/]*)\z", 1))


def os_field(os: Column) -> Column:
    """the name that an OS goes by where icons are chosen."""
    return F.when(os == "windows", "win32").otherwise(os)


def wrap32(value: Column) -> Column:
    return F.when(value < 0, value + 4294967296).otherwise(value)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def nonneg(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def kb_to_mb(c: Column) -> Column:
    return c / 1024


def bytes_to_kb(c: Column) -> Column:
    return c / 1024


def bytes_to_mb(c: Column) -> Column:
    return c / 1048576


def pages_to_mb(c: Column, page: int = 4096) -> Column:
    return c * page / 1048576


def ticks_to_s(c: Column, hz: int = 100) -> Column:
    return c / hz


def host_uuid(machine_id: Column, hostname: Column) -> Column:
    seed = F.when(F.trim(F.coalesce(machine_id, F.lit(""))) != "", F.concat(F.trim(machine_id), F.lit("/"), hostname)).otherwise(hostname)
    h = F.sha2(seed, 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def resolve_hostname(configured: Column, file: Column, cloud_a: Column, os: Column, cloud_b: Column) -> Column:
    """First usable name; a platform's default name only as the last resort."""
    usual = F.when(~F.lower(os).rlike(r"^(localhost(\..*)?$|ip-|domu|ec2amaz-)"), os)
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (configured, F.trim(file), cloud_a, usual, cloud_b, os)], F.lit("unknown"))


def os_version(nix: Column, mac: Column, win: Column) -> Column:
    return F.coalesce(*[F.nullif(F.get(a, F.lit(k)), F.lit("")) for a, k in ((nix, 1), (mac, 0), (win, 1))], F.lit(""))


def tag_value(tags: Column, key: str) -> Column:
    """The value of `key` in 'k:v,k:v', '' if absent."""
    found = F.filter(F.split(tags, ","), lambda t: t.startswith(f"{key}:"))
    return F.coalesce(F.substring(F.get(found, F.lit(0)), len(key) + 2, 1 << 30), F.lit(""))


def tag_set(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), F.trim), lambda t: t != "")))


def same_tags(a: Column, b: Column) -> Column:
    return tag_set(a) == tag_set(b)


def within(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(b))


def approx_equal(a: Column, b: Column) -> Column:
    return within(a, b, 1e-6)


def metric_key(metric: Column, tags: Column, device: Column, ignore: str = "") -> Column:
    """name{sorted distinct tags but ignored ones}[device]"""
    kept = F.filter(tags, lambda t: ~t.startswith(f"{ignore}:")) if ignore else tags
    return F.concat(metric, F.lit("{"), F.array_join(F.array_sort(F.array_distinct(kept)), ","), F.lit("}"), F.when(F.coalesce(device, F.lit("")) != "", F.concat(F.lit("["), device, F.lit("]"))).otherwise(""))


def is_permanent(status: Column) -> Column:
    """HTTP codes that no retry mends."""
    return status.isin(400, 401, 403, 413)


def truncate_text(s: Column) -> Column:
    return F.when(F.octet_length(s) > 48, F.concat(utf8_text(F.substring(F.encode(s, "UTF-8"), 1, 45)), F.lit("..."))).otherwise(s)


def plausible_range(text: Column, low: float, high: float) -> Column:
    """the number that a line begins with, null out of range: a sensor's reading."""
    v = to_double(F.get(F.split(F.trim(text), r"\s+"), F.lit(0)))
    return F.when((v >= low) & (v <= high), v)


def battery_percent(text: Column) -> Column:
    """the first number on the first line; a negative one means unknown, null."""
    found = F.filter(F.transform(F.split(F.trim(F.substring_index(text, "\n", 1)), r"\s+"), to_double), lambda v: v.isNotNull())
    v = F.get(found, F.lit(0))
    return F.when(v >= 0, v)


def signal_level(text: Column) -> Column:
    """the number behind `Signal: ` where the first line begins so."""
    line = F.substring_index(text, "\n", 1)
    return F.when(line.startswith("Signal: "), to_double(F.trim(F.substring(line, 9, 1 << 30))))
