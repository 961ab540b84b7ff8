"""Where tables and files go that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder of this machine;
    on a cluster executors would write where nobody else can read, so there it
    is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = MADE.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="lodestrand-")
        MADE[spark.sparkContext.applicationId] = path
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


MADE: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestrand/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written into the shared folder: its lineage is cut there, and a lost executor takes nothing with it."""
    path = fresh_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
