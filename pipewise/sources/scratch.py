"""Tables written on the way, in the shared folder the cluster names.

The folder is ``spark.checkpoint.dir`` of the session. A table written there
cuts the lineage, survives lost executors, and gives Catalyst its real size,
so that a later join is broadcast only if that size is under
``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; a local session without one gets a fresh folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="pipewise-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses."""
    return f"{scratch_dir(spark)}/pipewise/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write now, return a reader of what was written; texts are smaller by the
    ``codec`` zstd than by the session's own."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write = df.write if codec is None else df.write.option("compression", codec)
    write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
