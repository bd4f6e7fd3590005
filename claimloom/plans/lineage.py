"""Cutting lineage in a folder that every executor shares."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterable
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where none is configured, a local session (tests) gets a fresh one; any other master is
    refused, since a folder of this machine is not one that executors can read.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # read at each checkpoint: copies that nothing refers to any more are deleted
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="claimloom-checkpoint-"))
    return context.getCheckpointDir()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system its path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Have the shuffle files and copies deleted that nothing refers to any more.

    Spark deletes them when the driver happens to collect its garbage, which a driver with
    room may not do for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_name(columns: Iterable[str], base: str) -> str:
    """``base``, with as many underscores behind it as it takes to clash with no column (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def cut(frame: DataFrame) -> DataFrame:
    """Compute ``frame`` once into the shared checkpoint folder and continue from there.

    The copy survives the loss of executors (it is never an executor-local block) and
    Spark removes it when nothing refers to it any more (``checkpoint_dir`` switches that on).
    """
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Folders of settled frames.
_HOMES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def settled(frame: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write ``frame`` into the shared checkpoint folder and continue from its files: for the state of loops.

    A checkpoint keeps the size that Spark expected of its plan, and a join multiplies those of
    its sides: over the rounds of a loop the digits of that number multiply, until handling it
    takes the driver's time and memory. Files have their true size. Settled frames that are
    ``spent`` are deleted once the new one is written.
    """
    home = f"{checkpoint_dir(frame.sparkSession)}/settled-{uuid4().hex}"
    frame.write.parquet(home)
    forget(*spent)
    out = frame.sparkSession.read.schema(frame.schema).parquet(home)
    _HOMES[out] = home
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of settled frames that nothing reads any more."""
    for frame in frames:
        home = _HOMES.pop(frame, None)
        if home:
            delete_folder(frame.sparkSession, home)
