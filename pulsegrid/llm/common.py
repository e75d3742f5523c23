"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the folder the cluster names in `spark.checkpoint.dir`. Only a local session, as in tests, gets
    a folder of its own where that is unset; on a cluster such a folder would be lost with its machine."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns called c0, c1, ..., which no helper column is called, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str | Column) -> tuple[Column, Column]:
    """128 bits that name a row by its content; equal rows get equal keys."""
    return F.xxhash64(F.lit(17), *cols), F.xxhash64(F.lit(71), *cols)


def full_key(cols: list[str]) -> tuple[Column, Column]:
    """`row_key` of `cols` in which a null is a value of its own, wherever it stands."""
    return row_key(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def words_in(col: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


#: A key with over 1 / HOT of all rows is hot. So there are at most HOT hot keys, whatever the data.
HOT = 1000


def hot_keys(sizes: DataFrame, key: str, n: str = "n") -> DataFrame:
    """`(key, ways)`, at most HOT rows: the hot keys of a table with the number of rows of each key, and the parts that a
    hot key's rows are to be spread over."""
    total = max(sizes.agg(F.sum(n)).first()[0] or 0, 1)
    return sizes.filter(F.col(n) * HOT > total).select(key, F.ceil(F.col(n) * HOT / total).cast("int").alias("ways"))


def join_per_key(rows: DataFrame, small: DataFrame, key: str, by: Column, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Join `small`, a few bounded rows for each key, to `rows`, whose keys may be very hot. Keys are counted (or given as
    `hot`); the rows of hot ones are spread by `by`, and, as rows may be equal in it, by the partition they come from, over
    parts, and each part gets a copy of the key's rows in `small`. `rows` must be cheap to count by key."""
    hot = hot_keys(cut(rows.groupBy(key).agg(F.count("*").alias("n"))), key) if hot is None else hot
    ways = F.coalesce(F.col("ways"), F.lit(1))
    spread = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(by, F.spark_partition_id()), ways).cast("int")).drop("ways")
    copies = small.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("ways")
    return spread.join(copies, [key, "salt"], how).drop("salt")
