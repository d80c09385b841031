"""Cuts a growing lineage between the rounds of an iteration."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df by a reliable checkpoint in the shared folder that the session names in spark.checkpoint.dir; a folder of its own only in local mode without one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is not set: iterations need a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        sc.setCheckpointDir(base)
    return df.checkpoint(eager=True)
