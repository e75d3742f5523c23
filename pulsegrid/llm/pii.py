"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_per_key

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_HEX = re.compile(r"[0-9a-f]{32,64}")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Of so many secrets one is no seed, but left to the contexts to find, by the checksum of its text.
HELD_OUT = 10
_EDGE = ".,;:!?()[]{}<>\"'"


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text: each is looked for around an @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, sorted; a match that fails its check is dropped."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def seeds(text: str) -> list[tuple[int, int, int]]:
    """`base_spans` and, as seeds of a kind of their own, secrets: words of 32, 40 or 64 hexadecimal digits of both sorts."""
    spans = base_spans(text)
    for m in _HEX.finditer(text):
        s, e = m.span()
        alone = not (text[s - 1 : s].isalnum() or text[e : e + 1].isalnum())
        if alone and e - s in (32, 40, 64) and not m[0].isdigit() and not m[0].isalpha():
            spans.append((s, 4, e))
    return sorted(spans)


class Context:
    """The lexical patterns around spans of one text: the two whole words before the words that the span touches, the two
    after, and one on each side. Words count whole, however long; one of over 100 characters is named by its digest."""

    def __init__(self, text: str):
        self.text, self.words = text, [m.span() for m in _TOKEN.finditer(text)]
        self.begins = [s for s, _ in self.words]
        self.names: dict[int, str] = {}

    def name(self, k: int) -> str:
        if k not in self.names:
            word = self.text[slice(*self.words[k])].lower()
            self.names[k] = word if len(word) <= 100 else hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()
        return self.names[k]

    def patterns(self, start: int, end: int) -> list[str]:
        first, last = bisect_right(self.begins, start) - 1, bisect_right(self.begins, end - 1) - 1
        before = [self.name(k) for k in range(max(first - 2, 0), first)]
        after = [self.name(k).strip(_EDGE) for k in range(last + 1, min(last + 3, len(self.words)))]
        out = []
        if len(before) == 2:
            out.append("L " + " ".join(before))
        if len(after) == 2:
            out.append("R " + " ".join(after))
        if before and after:
            out.append(f"B {before[-1]} {after[0]}")
        return out


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens that look like identifiers (four or more digits, or an @) outside all spans."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    taken: list[list[int]] = []
    for s, _, e in sorted(spans):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out, k = [], 0
    for m in _TOKEN.finditer(text):
        token = m[0]
        if "@" in token or len(_DIGIT.findall(token)) >= 4:
            core = token.strip(_EDGE)
            s = m.start() + token.find(core)
            e = s + len(core)
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if core and not (k < len(taken) and taken[k][0] < e):
                out.append((s, e))
    return out


def _found(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    kind = df.schema[doc_id].dataType.simpleString()
    seen = "array<struct<start: bigint, end: bigint, kind: int, instance: string, patterns: array<string>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
        for b in batches:
            counts, sha, base, spots = [], [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                spans = seeds(text)
                counts.append([sum(k == i for _, k, _ in spans) for i in range(len(KINDS))])
                base.append(as_text(spans))
                sha.append(hashlib.sha256(as_text([x for x in spans if x[1] < 4]).encode()).hexdigest())
                both = [(s, e, -2 if k == 4 and zlib.crc32(text[s:e].encode()) % HELD_OUT == 0 else k) for s, k, e in spans] + [(s, e, -1) for s, e in candidates(text, spans)]
                around = Context(text) if both else None
                spots.append([{"start": s, "end": e, "kind": k, "instance": text[s:e].lower(), "patterns": around.patterns(s, e)} for s, e, k in both])
            numbers = [pa.array(c, pa.int64()) for c in zip(*counts)] if counts else [pa.array([], pa.int64())] * len(KINDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array(sha, pa.string()), pa.array(base, pa.string()), pa.array(spots, item)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "spots"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, base string, spots {seen}")


def extract(df: DataFrame, rounds: int = 3, min_seeds: int = 3, min_confidence: float = 0.75, min_score: float = 0.75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data of every text: doc_id, n_email, n_ip, n_card, n_phone, n_secret, base_sha256, spans, n_found, n_spans, n_held_out, n_confirmed.

    The fixed patterns' matches are kept as they are and seed the method, as do secrets (words of 32, 40 or 64
    hexadecimal digits), which are spans too but not part of base_sha256. Their contexts are lexical patterns; in
    each round Spark scores every (pattern, kind) by the share of its distinct instances that are known to be of that
    kind, seeds / (instances + 1), with at least `min_seeds` of them, and every instance by 1 - product(1 - score)
    over its patterns of at least `min_confidence`; instances of at least `min_score` become known. The tokens of
    known instances are added to `spans` under the kind of their best score (n_found counts them, n_spans all).

    One secret in HELD_OUT is no seed, nor an instance by which patterns are scored. It stays a span, as its shape is enough for that; n_held_out counts these, and
    n_confirmed those that the contexts find by themselves, so that every run tells the method's recall on its own data.

    Positions are code points, ends exclusive. Null text is empty; repeated rows give equal rows, and copies of a
    passage are one instance; ties between kinds go to the first listed. Null doc_ids are carried, other columns are
    not read. An empty table gives an empty table. Patterns and instances stay distributed tables throughout.
    """
    rows = cut(_found(df, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    spots = rows.select("row", F.explode("spots").alias("x")).select("row", "x.*")
    edges = cut(spots.select("instance", "kind", F.explode("patterns").alias("pattern")).distinct())
    known = edges.filter("kind >= 0").select("instance", "kind").distinct()
    size = edges.filter("kind <> -2").groupBy("pattern").agg(F.countDistinct("instance").alias("instances"))
    unknown = edges.filter("kind < 0").select("instance", "pattern")
    won = None
    pairs = edges.filter("kind <> -2").select("instance", "pattern").distinct()
    for _ in range(rounds):
        scored = (
            join_per_key(pairs, known, "instance", F.col("pattern")).groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= min_seeds)
            .join(size, "pattern").withColumn("confidence", F.col("seeds") / (F.col("instances") + 1)).filter(F.col("confidence") >= min_confidence)
        )
        by_kind = join_per_key(unknown, scored, "pattern", F.col("instance")).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        best = by_kind.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).filter(F.col("b.score") >= min_score)
        won = cut(best.select("instance", (-F.col("b.k")).cast("int").alias("kind")))
        known = edges.filter("kind >= 0").select("instance", "kind").distinct().unionByName(won)
    names = F.array(*map(F.lit, KINDS))
    met = join_per_key(spots.filter("kind < 0").select("row", "start", "end", "instance", F.col("kind").alias("was")), won, "instance", F.col("row"))
    beyond = F.sort_array(F.collect_list(F.when(F.col("was") == -1, F.struct("start", "kind", "end"))))
    added = met.groupBy("row").agg(F.nullif(beyond, F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")).alias("added"), F.count_if((F.col("was") == -2) & (F.col("kind") == 4)).alias("confirmed"))

    def item(x):
        return F.struct(x["start"].alias("start"), F.when(x["kind"] == -2, 4).otherwise(x["kind"]).cast("int").alias("kind"), x["end"].alias("end"))

    both = F.sort_array(F.concat(F.transform(F.filter("spots", lambda x: x["kind"] != -1), item), F.transform("added", item)))
    joined = F.array_join(F.transform(both, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.join(added, "row", "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256",
        F.when(F.col("added").isNull(), F.col("base")).otherwise(joined).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_found"),
        (sum(F.col(f"n_{k}") for k in KINDS) + F.coalesce(F.size("added"), F.lit(0))).cast("long").alias("n_spans"),
        F.size(F.filter("spots", lambda x: x["kind"] == -2)).cast("long").alias("n_held_out"), F.coalesce("confirmed", F.lit(0)).alias("n_confirmed"),
    )
