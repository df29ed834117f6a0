"""Where intermediate results are kept."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names.

    Only where that is unset and driver and executors are one process, a
    temporary folder is used; on a cluster nobody else could read it, so there
    it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="certus-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def saved(df: DataFrame) -> DataFrame:
    """The frame, computed once and cut from its lineage by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as saved(), in Parquet, which takes a fraction of a checkpoint's disk; kinds of columns that it doesn't know are checkpointed."""
    if any(x in kind for _, kind in df.dtypes for x in ("void", "interval", "variant")):
        return saved(df)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def within(df: DataFrame, seconds: float) -> DataFrame:
    """The frame, computed and kept; if that takes longer, its jobs are cancelled and TimeoutError is raised."""
    sc, tag, late = df.sparkSession.sparkContext, f"within-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return saved(df)
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
