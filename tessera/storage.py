"""The folder that all machines share, and DataFrames kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where none is set, a local session gets a temporary folder; on a cluster
    that would not be shared, so it is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut.

    The files survive lost executors, and Spark's cleaner removes them with
    the DataFrame (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    Unlike :func:`stored` rows, its columns are read one by one and its size
    is known to the planner. The files stay until the folder is cleared.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else left to a shuffled join; it should be cheap to count."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
