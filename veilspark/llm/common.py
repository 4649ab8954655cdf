"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``, or the session's own if that is unset. Only a local
    session (tests in one process) gets a scratch folder; elsewhere its absence is an error.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def in_blocks(items, size: int):
    """``items`` in lists of at most ``size``."""
    block: list = []
    for x in items:
        block.append(x)
        if len(block) >= size:
            yield block
            block = []
    if block:
        yield block
