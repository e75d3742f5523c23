"""Temperature mixing of sources to target weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, hot_keys, join_per_key, numbered, words_in

#: Exponents tried at once in a round of the bisection, rounds, and rows that one block of a permutation holds.
GRID, ROUNDS, BLOCK = 32, 8, 5000


def _tried(totals: DataFrame, alphas: list[float], budget: float | None) -> list[tuple[float, float]]:
    """For each exponent, the weights' entropy and the most epochs of any source; one job, one row to the driver."""
    p = F.col("share")
    cols = []
    for a in alphas:
        x = F.pow(p, F.lit(a))
        cols += [F.sum(x), F.sum(x * F.log(p)), F.max(F.pow(p, F.lit(a - 1.0))), F.max(F.pow(p, F.lit(1.0 - a)))]
    got = totals.filter("share > 0").agg(*cols).first()
    out = []
    for k, a in enumerate(alphas):
        z, e, most, least = got[4 * k : 4 * k + 4]
        if z is None:
            return [(0.0, 0.0)] * len(alphas)
        out.append((math.log(z) - a * e / z, (budget / z if budget else least) * most))
    return out


def exponent(totals: DataFrame, max_epochs: float | None, entropy: float | None, budget: float | None) -> float:
    """The exponent in [0, 1] that meets the target: the smallest whose most repeated source has at most `max_epochs`,
    or the largest whose weights have at least `entropy` nats. Narrowed by a factor of GRID a round."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        tried = _tried(totals, grid, budget)
        if entropy is None:
            ok = next((k for k, (_, n) in enumerate(tried) if n <= max_epochs * (1 + 1e-12)), GRID)
            if ok == 0:
                return grid[0]
            low, high = grid[ok - 1], grid[ok]
        else:
            ok = next((k for k in range(GRID, -1, -1) if tried[k][0] >= entropy), 0)
            if ok == GRID:
                return grid[GRID]
            low, high = grid[ok], grid[ok + 1]
    return high if entropy is None else low


def plan(df: DataFrame, max_epochs: float | None = 2.0, entropy: float | None = None, budget: float | None = None, seed: int = 0, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """All rows and columns of `df` with n_tokens (words), weight, epochs and copies.

    Token shares of the sources are raised to an exponent and normalised; the exponent is bisected until the most
    repeated source has `max_epochs` epochs, or the weights have `entropy` nats. `budget` is in corpus sizes; by
    default it is the least that leaves no source under one epoch, so that no document is lost. Each source
    gets `epochs` = budget * weight / share (rounded to 9 places): whole permutations of its documents, then the
    first documents of one more permutation, as long as their tokens fit what is left. `copies` counts a row's
    places in them, and `place`, from 1, is its place in its source's permutation.

    A null source is a source of its own (''). Null and empty texts have no tokens and take no budget; a source
    without tokens has weight 0 and one copy of each row. Repeated rows are rows. Rows without a doc_id are permuted by their
    texts. Ties in the permutation go by tokens, then text; a block that is hot, as very many rows have one doc_id, is
    first cut by a hash of the whole row, so that its rows stand in order of that. Input columns n_tokens, weight, epochs, copies, place are replaced, all others pass, whatever their names. An empty table
    gives an empty table. Hot sources are cut into blocks of the permutation, summed before any order is taken.
    """
    out = [c for c in df.columns if c not in ("n_tokens", "weight", "epochs", "copies", "place")]
    df, names = numbered(df)
    cols = [names[c] for c in out]
    row = F.xxhash64(F.lit(5), *names.values())
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(names[doc_id]).cast("string"), F.concat(F.lit("text "), F.xxhash64(names[text]).cast("string")))))
    rows = df.select(*cols, words_in(names[text]).alias("n_tokens"), F.coalesce(F.col(names[source]), F.lit("")).alias("s"), order.alias("o"), F.xxhash64(names[text]).alias("t"), row.alias("u"))
    totals = cut(rows.groupBy("s").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("rows")))
    whole = totals.agg(F.sum("total")).first()[0] or 0
    hot = hot_keys(totals, "s", "rows")
    totals = totals.withColumn("share", F.col("total") / F.lit(float(max(whole, 1))))
    alpha = exponent(totals, max_epochs, entropy, budget)
    z, least = totals.filter("share > 0").agg(F.sum(F.pow("share", F.lit(alpha))), F.max(F.pow("share", F.lit(1 - alpha)))).first()
    scale = (budget / z if budget else least) if z else 1.0
    weights = totals.select(
        "s", "total",
        F.when(F.col("share") > 0, F.pow("share", F.lit(alpha)) / F.lit(z or 1.0)).otherwise(F.lit(0.0)).alias("weight"),
        F.when(F.col("share") > 0, F.round(F.lit(scale) * F.pow("share", F.lit(alpha - 1.0)), 9)).otherwise(F.lit(1.0)).alias("epochs"),
        F.ceil(F.col("rows") / F.lit(BLOCK)).alias("blocks"),
    )
    part = F.floor(F.conv(F.substring("o", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * F.col("blocks")).alias("b")
    light = join_per_key(rows.select("s", "o", "u", "n_tokens"), weights.select("s", "blocks"), "s", F.col("u"), hot=hot).select("s", "u", "n_tokens", part)
    sizes = light.groupBy("s", "b").agg(F.count("*").alias("n")).withColumn("sb", F.struct("s", "b"))
    tied = cut(hot_keys(cut(sizes), "sb").join(sizes.filter(F.col("n") > 2 * BLOCK).select("sb"), "sb"))  # blocks have BLOCK rows where ids differ

    def cut_tied(x: DataFrame) -> DataFrame:
        ways = F.coalesce(F.col("ways"), F.lit(1))
        return x.join(F.broadcast(tied.select("sb.s", "sb.b", "ways")), ["s", "b"], "left").withColumn("c", F.pmod("u", ways).cast("int")).drop("ways", "u")

    dealt = cut_tied(join_per_key(rows, weights, "s", F.col("u"), hot=hot).select("*", part))
    sums = cut_tied(light).groupBy("s", "b", "c").agg(F.sum("n_tokens").alias("sum"), F.count("*").alias("n"))
    earlier = Window.partitionBy("s").orderBy("b", "c")
    before = sums.select("s", "b", "c", (F.sum("sum").over(earlier) - F.col("sum")).alias("tokens_before"), (F.sum("n").over(earlier) - F.col("n")).alias("rows_before"))
    inside = Window.partitionBy("s", "b", "c").orderBy("o", "n_tokens", "t")
    ranked = dealt.withColumns({"upto": F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "rank": F.row_number().over(inside)})
    full = F.floor("epochs")
    rest = F.floor(F.round((F.col("epochs") - full) * F.col("total"), 6))
    one_more = (F.col("epochs") > full) & (F.col("tokens_before") + F.col("upto") <= rest)
    return ranked.join(before, ["s", "b", "c"]).select(
        *(F.col(names[c]).alias(c) for c in out), "n_tokens", "weight", "epochs",
        (full + F.when(one_more, 1).otherwise(0)).cast("long").alias("copies"), (F.col("rows_before") + F.col("rank")).alias("place"))


def realise(planned: DataFrame) -> DataFrame:
    """Each row of `plan` as often as its `copies` says, with `block`, the permutation that this copy stands in (from 1);
    `place` is its place in there. Rows without copies go, a column `block` is replaced, all others pass; an empty
    table gives an empty table."""
    return planned.filter("copies > 0").withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
