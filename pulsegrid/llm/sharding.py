"""Sharding by a permutation-filled lookup table. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _h(text: str, salt: str) -> str:
    return f"conv(substring(md5(concat('{salt}', {text})), 1, 8), 16, 10)"


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: int, size: int) -> DataFrame:
    """`(slot, shard)`: shards take turns; each claims the first free slot of its own permutation of the slots.

    Shard i prefers the slots offset + j * skip mod size, j = 0, 1, ...; a prime `size` makes that a permutation.
    The table depends on the two parameters alone and has `size` rows.
    """
    if not _prime(size) or not 1 <= shards <= size:
        raise ValueError("size must be prime and at least as large as the number of shards")
    name = "concat('shard-', cast(i as string))"
    return spark.sql(f"""
        with prefs as (
          select transform(sequence(0, {shards - 1}), i ->
            transform(sequence(0, {size - 1}), j -> cast(
              (cast({_h(name, 'offset:')} as bigint) % {size}
               + j * (cast({_h(name, 'skip:')} as bigint) % {size - 1} + 1)) % {size} as int))) as p)
        select posexplode(aggregate(sequence(0, {size - 1}), array_repeat(-1, {size}),
            (t, n) -> element_at(transform(slice(filter(p[n % {shards}], c -> t[c] = -1), 1, 1),
              won -> transform(t, (s, k) -> if(k = won, n % {shards}, s))), 1))) as (slot, shard)
        from prefs""")


def slot_of(key: Column, size: int) -> Column:
    """The key's slot: 32 bits of its MD5, mod the table's size. A null key counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size).cast("int")


def shard(df: DataFrame, key: str = "doc_id", shards: int = 16, size: int = 2039) -> DataFrame:
    """Add `slot` and `shard` to every row by a look-up in the broadcast table (`size` rows, a parameter).

    Equal keys go to one shard. Null keys are placed like ''. Texts, ties and repeated rows don't matter; columns
    `slot` and `shard` of the input are replaced, all others kept. An empty table gives an empty table.
    """
    table = F.broadcast(lookup_table(df.sparkSession, shards, size))
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    return df.select(*kept, slot_of(F.col(key), size).alias("slot")).join(table, "slot").select(*kept, "slot", "shard")
