"""Session helpers shared by the corpus operators: cutting lineage and shipping code."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of its text, that an operator may hold in a broadcast variable.
BROADCAST_BYTES = 64 << 20
#: Most bytes of a batch of rows between Spark and Python; each task holds several, on both sides.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, and bound the
    session's batches to ``BATCH_BYTES``: Spark's own bounds are 10,000 rows and 64 MB.

    A cluster that ships the package itself (``--py-files``) sets PYTHONPATH; that wins.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF)) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (have, root) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or for a local
    session without that setting a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):  # "local-cluster[" has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkvane-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, and a
    lost executor costs no recomputation. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def carried(columns: list[str]) -> list[Column]:
    """Columns that an operator passes through, as one struct that clashes with no name."""
    return [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_carried")] if columns else []
