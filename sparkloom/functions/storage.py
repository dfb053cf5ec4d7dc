"""Intermediate results in the shared folder of the session."""

from __future__ import annotations

import logging
import tempfile

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of the session. Only a local master, where all tasks share this machine's disk, may do without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="sparkloom-checkpoint-")
            logging.getLogger(__name__).info("spark.checkpoint.dir is unset: checkpoints go to %s", folder)
        context.setCheckpointDir(folder)


def released(df: DataFrame) -> DataFrame:
    """`df` as a frame whose actions delete their shuffle files when they end, instead of when the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return df.select("*")  # a frame keeps the setting under which it was made
    finally:
        conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage; nothing reads its shuffle files after that."""
    ensure_checkpoint_dir(df.sparkSession)
    return released(df).checkpoint()


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that `df` doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
