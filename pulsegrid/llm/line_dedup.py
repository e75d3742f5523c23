"""Line dedup by site-relative frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_per_key, numbered, row_key


def _key(line: Column) -> Column:
    """A line's identity: 128 bits of its text without outer ASCII white space, as one string-free struct."""
    t = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(t != "", F.struct(F.xxhash64(F.lit(1), t).alias("a"), F.xxhash64(F.lit(2), t).alias("b")))


def boilerplate_lines(df: DataFrame, host: str, text: str, max_ratio: float, min_pages: int, distinct: bool = False) -> DataFrame:
    """`(host, bad)`: for each host the keys of its lines that stand on more than `max_ratio` of its pages and on
    at least `min_pages` of them; `distinct`: pages with equal texts are one page. A host with L distinct lines a page
    has at most L / max_ratio of them."""
    t1, t2 = row_key(text)
    page = [t1.alias("_t1"), t2.alias("_t2")] if distinct else []
    pages = df.select(*page, F.coalesce(F.col(host), F.lit("")).alias("_host"), F.array_distinct(F.transform(F.split(F.col(text), "\n", -1), _key)).alias("_keys"))
    keys = F.array_append(F.filter(F.coalesce(F.col("_keys"), F.array()), lambda k: k.isNotNull()), F.lit(None))
    each = pages.select(*[c for c in pages.columns if c != "_keys"], F.explode(keys).alias("_k"))
    # the null key, once a page, counts the host's pages in the same shuffle
    counts = (each.distinct() if distinct else each).groupBy("_host", "_k").agg(F.count("*").alias("_n"))
    counts = cut(counts.filter(F.col("_k").isNull() | (F.col("_n") >= min_pages)))
    hosts = counts.filter(F.col("_k").isNull()).select("_host", F.col("_n").alias("_pages"))
    lines = counts.filter(F.col("_k").isNotNull() & (F.col("_n") >= min_pages))
    return (
        join_per_key(lines, hosts, "_host", F.col("_k")).filter(F.col("_n") > F.lit(max_ratio) * F.col("_pages"))
        .groupBy("_host").agg(F.collect_list("_k").alias("_bad"))
    )


def dedup_lines(df: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 3, distinct: bool = False) -> DataFrame:
    """Remove boilerplate lines from every page, site by site.

    A page is a row; with `distinct`, a host's rows of one text are one page, so that copies of a document don't make
    its lines boilerplate. Pages are grouped by `host` (null: the host ''); for each line, compared without outer
    white space, the share of the host's pages that contain it is taken, once a page however often it stands
    there. Lines whose share exceeds `max_ratio`, on at least `min_pages` pages, go; the others stay in order.
    Adds `n_lines`, `n_dropped` and replaces `text`.

    Null text stays null with 0 lines. White-space lines neither count nor go. Repeated rows count as pages (not with `distinct`).
    Ties don't matter: the rule is a threshold. All other columns pass through, whatever their names, but for
    `n_lines` and `n_dropped`, which are replaced. An empty table gives an empty table.
    """
    (df, names), out = numbered(df), [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    host, text = names[host], names[text]
    bad = boilerplate_lines(df, host, text, max_ratio, min_pages, distinct)
    joined = join_per_key(df.withColumn("_host", F.coalesce(F.col(host), F.lit(""))), bad, "_host", F.xxhash64(*names.values()), "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.when(F.col("_bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_bad"), _key(x)), F.lit(False))))
    joined = joined.withColumn("_kept", kept).withColumn("_all", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    text_out = F.when(F.col(text).isNotNull(), F.array_join("_kept", "\n"))
    all_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.col("_all")).cast("long")
    kept_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("_kept")).cast("long")
    return joined.select(*[(text_out if names[c] == text else F.col(names[c])).alias(c) for c in out], all_lines.alias("n_lines"), (all_lines - kept_lines).alias("n_dropped"))
