"""Cutting the lineage of a table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the folder that the cluster names in `spark.checkpoint.dir` and read it from there. A local session, as in
    tests, gets a temporary folder where that is unset; a cluster gets an error, as such a folder is lost with its machine."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)
