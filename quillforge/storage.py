"""Checkpoints in the folder that the cluster's driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder for checkpoints and for what stages pass on: spark.checkpoint.dir, which all executors share.

    A folder of our own is used only where the session names none and runs in one process (tests, local mode);
    on a cluster a missing setting is an error, as executors would not see a local folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="ckpt-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark, path: str) -> None:
    """Delete a folder in the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Delete what a checkpointed or stored DataFrame stands on; it can't be read any more."""
    if hasattr(df, "stored_at"):
        remove(df.sparkSession, df.stored_at)
        return
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


#: Rows of a few plain columns that may be broadcast, some 10 MB.
FEW = 200_000


def few(df: DataFrame, most: int = FEW) -> bool:
    return df.limit(most + 1).count() <= most


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder: smaller than a checkpoint, and read by the columns that are used."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out
