"""Written intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="reelgrid-")
    return _local[sc.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder in the shared one; it goes when the session ends, with what is written there."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jvm_path)
    files.deleteOnExit(jvm_path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    The files go when the session ends.
    """
    path = f"{new_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_rounds(spark: SparkSession, make: Callable[[int], DataFrame], rounds: int, name: str) -> DataFrame:
    """The rows of make(0), ..., make(rounds - 1), written one after the other; the shuffle files of each go before the next."""
    path = f"{new_folder(spark, name)}/rows"
    for k in range(rounds):
        df = make(k)
        df.write.mode("append").parquet(path)
        schema = df.schema
        if rounds > 1:
            # Spark drops the files of a shuffle once the driver has collected its plan
            del df
            gc.collect()
            spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a materialised table that no later plan reads."""
    spark = df.sparkSession
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
