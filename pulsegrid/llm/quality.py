"""Quality rules: counts within each document and line frequency across a host's documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, full_key, join_per_key, numbered, row_key

_LINES = "array<struct<a: bigint, b: bigint, words: bigint>>"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def measure(text: str) -> tuple[int, int, int, int, int, dict[bytes, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words of each normalised line (its words
    in lower case A-Z, joined by a space)."""
    words = text.encode("utf-8", "surrogatepass").split()
    space = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    grams = list(zip(words, words[1:], words[2:]))
    count = Counter(grams)
    repeat = 0
    if len(count) < len(grams):
        upto = 0  # words before this one are counted
        for i, g in enumerate(grams):
            if count[g] > 1:
                repeat += i + 3 - max(i, upto)
                upto = i + 3
    lines: dict[bytes, int] = {}
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        parts = line.encode("utf-8", "surrogatepass").lower().split()
        if parts:
            dup += line in seen
            seen.add(line)
            key = b" ".join(parts)
            lines[key] = lines.get(key, 0) + len(parts)
    return len(words), len(text) - space, symbols, dup, repeat, lines


def features(df: DataFrame, doc_id: str, host: str, text: str) -> DataFrame:
    """A row for each row: the counts of `measure`, the row's key (k1, k2), the text's 128-bit digest (t1, t2) and those
    of its distinct lines."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seeds = [xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42) for k in (17, 71)]  # as row_key has them

        def key(x: bytes) -> list[int]:
            return [(d := xxhash.xxh64_intdigest(x, seed)) - (d >> 63 << 64) for seed in seeds]

        line = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("words", pa.int64())]))
        for b in batches:
            counts, lines = [], []
            for t in b.column(2):
                text = t.as_py() or ""
                *numbers, found = measure(text)
                counts.append(numbers)
                lines.append([{"a": k[0], "b": k[1], "words": n} for x, n in found.items() for k in (key(x),)])
            cols = [pa.array(c, pa.int64()) for c in zip(*counts)] if counts else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 3, 4, 5, 6)), *cols, pa.array(lines, line)], names=["doc_id", "host", *KEYS, *NUMBERS, "lines"])

    keys = [k.alias(n) for n, k in zip(KEYS, (*full_key([doc_id, host, text]), *row_key(F.coalesce(F.col(text), F.lit("")))))]
    return df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text"), *keys).mapInArrow(
        run, f"doc_id {kind}, host string, {', '.join(f'{n} long' for n in [*KEYS, *NUMBERS])}, lines {_LINES}")


NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
KEYS = ["k1", "k2", "t1", "t2"]


def judge(df: DataFrame, max_ratio: float = 0.1, min_docs: int = 3, min_left: float = 0.8, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Judge every document; returns doc_id, the counts, n_common_words, base_failed and kept, a row for each row, with
    the row's key (k1, k2), `full_key` of doc_id, host and text, and the keys of its common lines (hit).

    base_failed: fewer than 50 words, or over half of the words in 3-word windows that occur twice or more.
    Lines are normalised (lower case A-Z, one space between words) and hashed; for each host the distinct documents
    (exact copies of a text are one document) with a line are counted. Lines in more than `max_ratio` of the
    host's documents, and at least `min_docs` of them (fewer say nothing about a host), are common; a document left with
    less than `min_left` of its words without them is depleted. kept: neither base_failed nor depleted.

    Null text has no words and fails; a null host is ''. Lines without a word are not counted. Repeated rows
    are judged alike; null doc_ids are carried; other columns are not read. An empty table gives an empty table.
    A host with L lines a document has at most L / max_ratio common lines.
    """
    rows = cut(features(df, doc_id, host, text))
    texts = rows.select("host", "t1", "t2", F.explode(F.array_append(F.transform("lines", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))), F.lit(None))).alias("k")).distinct()
    counts = texts.groupBy("host", "k").agg(F.count("*").alias("n"))  # the null key counts the host's documents
    docs = counts.filter("k is null").select("host", F.col("n").alias("docs"))
    common = (
        counts.filter(F.col("k").isNotNull() & (F.col("n") >= min_docs)).join(docs, "host").filter(F.col("n") > F.lit(max_ratio) * F.col("docs"))
        .groupBy("host").agg(F.collect_list("k").alias("common"))
    )
    hit = F.filter("lines", lambda x: F.array_contains("common", F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    n_common = F.when(F.col("common").isNull(), F.lit(0)).otherwise(F.aggregate(hit, F.lit(0).cast("long"), lambda s, x: s + x["words"])).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = join_per_key(rows, common, "host", F.col("k1"), "left").withColumn("n_common_words", n_common).withColumn("base_failed", failed)
    judged = judged.withColumn("hit", F.when(F.col("common").isNull(), F.array().cast("array<struct<a: bigint, b: bigint>>")).otherwise(F.transform(hit, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))))
    left = F.col("n_words") - F.col("n_common_words")
    return judged.select("doc_id", *NUMBERS, "n_common_words", "base_failed", (~F.col("base_failed") & (left >= F.lit(min_left) * F.col("n_words"))).alias("kept"), "k1", "k2", "hit")


def line_key(line: Column) -> Column:
    """The key of a line as `features` has it: the digest of its words in lower case A-Z, joined by a space; null for a line
    without a word."""
    words = F.regexp_extract_all(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    a, b = row_key(F.array_join(words, " "))
    return F.when(F.size(words) > 0, F.struct(a.alias("a"), b.alias("b")))


def keep_good(df: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of `df` that `judge` keeps, with all columns, whatever their names, and their texts without the lines that
    are common on their host. Rows are told apart by doc_id, host and text, so that rows without a doc_id, or with
    another row's, go by their own verdict; repeated rows stay or go together. Null texts go; an empty table gives an
    empty table."""
    out = df.columns
    plain, names = numbered(df)
    d, h, t = names[doc_id], names[host], names[text]
    good = judge(plain, doc_id=d, host=h, text=t, **options).filter("kept").select("k1", "k2", "hit").dropDuplicates(["k1", "k2"])
    k1, k2 = full_key([d, h, t])
    lines = F.split(F.col(t), "\n", -1)
    rest = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("hit", line_key(x)), F.lit(False)))
    kept = plain.withColumns({"k1": k1, "k2": k2}).join(good, ["k1", "k2"])
    less = F.when(F.size("hit") > 0, F.array_join(rest, "\n")).otherwise(F.col(t))
    return kept.select(*[(less if names[c] == t else F.col(names[c])).alias(c) for c in out])
