"""Lineage cuts and size checks shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which a side may be broadcast.
BROADCAST_BYTES = 32 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The session's setting is used.  Only where it is unset, as in local tests, a folder of
    this machine takes its place; a cluster without the setting is refused.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="folioscope-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, stored in the shared checkpoint folder: later reads don't compute them again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, column: str) -> DataFrame:
    """Like `cut`, dealt out by a column: later groupings by it move no rows.

    Only the checkpoint of a plan that is fixed beforehand keeps its partitioning, so adaptive
    execution is off while it is written.
    """
    spark = df.sparkSession
    before, parts = spark.conf.get("spark.sql.adaptive.enabled"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(parts, column))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
