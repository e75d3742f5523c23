"""Document fingerprints by winnowing. DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, partitions

#: Words in a gram and grams in a window, powers of two: a shared run of GRAM + WINDOW - 1 words shares a fingerprint.
GRAM, WINDOW = 4, 16
#: Buckets of neighbouring ids for each shuffle partition, and sampled keys for each bucket.
BUCKETS, SAMPLE = 4, 20


def _turned(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def _joined(n: int):
    return lambda a, b: _turned(a, n).bitwiseXOR(b)


def _pairs(col: Column, gap: int, f) -> Column:
    n = F.size(col) - gap
    return F.zip_with(F.slice(col, F.lit(1), n), F.slice(col, F.lit(gap + 1), n), f)


def marks(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`: the chosen grams of `text`, as structs of a hash of 64 bits and the word where the gram begins.

    Grams of GRAM words have rolling hashes (cyclic polynomials: word hashes turned by their distance from the gram's end
    and joined by exclusive or; SQL has no running state over an array, so they are made by doubling). The least of each
    WINDOW consecutive hashes is chosen, the rightmost of equals. Fewer words than a gram make one gram of all of them,
    fewer grams than a window one window; no word (or null): no mark. `df` must not have columns _w, _g, _m.
    """
    words = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    df = df.withColumn("_w", words).withColumn("_g", F.col("_w"))
    gap = 1
    while gap < GRAM:
        df = df.withColumn("_g", F.when(F.size("_w") >= GRAM, _pairs(F.col("_g"), gap, _joined(gap))).otherwise(F.col("_g")))
        gap *= 2
    whole = F.array(F.aggregate("_w", F.lit(0).cast("long"), lambda s, x: _turned(s, 1).bitwiseXOR(x)))
    df = df.withColumn("_g", F.when(F.size("_w") >= GRAM, F.col("_g")).when(F.size("_w") > 0, whole).otherwise(F.array().cast("array<bigint>")))
    # a later position is the lesser of two equal hashes
    df = df.withColumn("_m", F.transform("_g", lambda h, i: F.struct(F.xxhash64(h).alias("h"), (-i).alias("back"))))
    gap = 1
    while gap < WINDOW:
        df = df.withColumn("_m", F.when(F.size("_g") >= WINDOW, _pairs(F.col("_m"), gap, lambda a, b: F.least(a, b))).otherwise(F.col("_m")))
        gap *= 2
    df = df.withColumn("_m", F.when((F.size("_g") >= WINDOW) | (F.size("_g") == 0), F.col("_m")).otherwise(F.array(F.array_min("_m"))))
    new = F.filter("_m", lambda x, i: (i == 0) | (x["back"] != F.get("_m", i - 1)["back"]))
    return df.withColumn(out, F.transform(new, lambda x: F.struct(x["h"].alias("h"), (-x["back"]).alias("at")))).drop("_w", "_g", "_m")


def as_text(col: str) -> Column:
    """Marks as `hash@position` in order of position."""
    return F.array_join(F.transform(F.col(col), lambda x: F.concat_ws("@", F.hex(x["h"]), x["at"].cast("string"))), ",")


def hashes(col: str) -> Column:
    return F.array_distinct(F.transform(F.col(col), lambda x: x["h"]))


def likeness(a: str, b: str) -> Column:
    """Shared hashes by all hashes of two sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(F.col(a), F.col(b)))
    union = F.size(F.col(a)) + F.size(F.col(b)) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.greatest(union, F.lit(1)))


def _key(doc_id: str, text: str) -> Column:
    """What rows are ordered by: nulls before all ids, equal ids by a hash of their texts."""
    return F.struct(F.col(doc_id).isNotNull().alias("has"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("tie"))


def _bucket(key: Column, bounds: list[str], kind: str) -> Column:
    """How many of the sorted `bounds`, keys as JSON, are at most `key`, by binary search. They are one constant of the plan,
    however many they are."""
    if not bounds:
        return F.lit(0)
    held = F.from_json(F.lit(f"[{','.join(bounds)}]"), f"array<struct<has: boolean, id: {kind}, tie: bigint>>")

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.element_at(held, F.least(mid, F.lit(len(bounds) - 1)) + 1) <= key
        return F.when(s["lo"] >= s["hi"], s).when(above, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step)["lo"]


def with_next(df: DataFrame, doc_id: str, text: str, add) -> DataFrame:
    """`add(df)` with `next`, a struct of all columns of the following row by descending `doc_id` (after the last: the
    first). Equal ids go by a hash of their text, null ids come last.

    Rows are dealt to buckets of neighbouring keys, BUCKETS for each shuffle partition, between splitters of a sample
    of the keys (SAMPLE distinct ones for each bucket, on the driver); so neither outlying ids nor many equal ones fill
    a bucket, only rows equal in id and text share one. The first row of each bucket is also laid, as a guest, behind
    the next higher bucket, so that no order over all rows is ever taken in one place.
    """
    buckets = BUCKETS * partitions(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()
    keyed = df.withColumn("_key", _key(doc_id, text))
    keys = keyed.select("_key")
    every = max(1, keys.count() // (SAMPLE * buckets))
    sample = keys.filter(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0).distinct()
    sample = [r[0] for r in sample.orderBy("_key").select(F.to_json("_key")).collect()]
    bounds = sample[SAMPLE // 2 :: max(1, -(-len(sample) // buckets))]
    keyed = keyed.withColumn("_bucket", _bucket(F.col("_key"), bounds, kind))
    firsts = sorted(tuple(r) for r in keyed.groupBy("_bucket").agg(F.max("_key").alias("k")).select("_bucket", "k.has", "k.id", "k.tie").collect())
    steps = [(to, *first) for (_, *first), (to, *_) in zip(firsts, firsts[1:] + firsts[:1])]  # the lowest bucket is followed by the highest
    steps = df.sparkSession.createDataFrame(steps, f"_bucket int, has boolean, id {kind}, tie long").select("_bucket", F.struct("has", "id", "tie").alias("_key"))
    guests = keyed.drop("_bucket").join(F.broadcast(steps), "_key").withColumn("_guest", F.lit(True))
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col("_key").desc())
    both = add(keyed.withColumn("_guest", F.lit(False)).unionByName(guests).repartition("_bucket"))  # what `add` makes is not shuffled
    cols = [c for c in both.columns if c[0] != "_"]
    return both.withColumn("next", F.lead(F.struct(*cols)).over(order)).filter("not _guest").drop("_bucket", "_guest", "_key")


def fingerprint_with_edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document's.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are
    empty; equal ids stand next to each other in order of a hash of their text, so repeated rows are each other's next;
    rows without an id come last; ids may be of any type that has an order; other columns are not read. A single
    document is its own next one; an empty table gives an empty table.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pairs = with_next(docs, "doc_id", "text", lambda x: marks(x, "text", "marks"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = pairs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next.text"), F.lit(1), half)))
    both = marks(edited.select("doc_id", "n_chars", "marks", "edited", F.col("next.marks").alias("next_marks")), "edited", "edited_marks")
    sets = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "marks", "edited_marks", *(hashes(c).alias(f"{c}_h") for c in ("marks", "edited_marks", "next_marks")))
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", as_text("marks").alias("fingerprint"), as_text("edited_marks").alias("edited_fingerprint"),
        likeness("marks_h", "edited_marks_h").alias("near_edited"), likeness("marks_h", "next_marks_h").alias("near_next"),
    )
