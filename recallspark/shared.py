"""Cutting lineage through a table in the cluster's shared folder.

``spark.checkpoint.dir`` names the folder all executors can reach. Only on a local master, where the session
may leave it unset, a folder of this process is taken instead.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WRITTEN: list[str] = []
#: Inputs with fewer bytes per core than this are spread over the cores before work that multiplies rows.
SMALL_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="recallspark-"))
    return _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A folder for intermediate data, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later stages start from the stored files, so a lost executor costs a re-read and never a
    rerun of what came before, and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this process wrote; to be called once the results that rest on them are stored. Their number."""
    n = len(_WRITTEN)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over as many partitions as there are cores if it is small.

    Small files give few scan partitions, and joins that multiply rows would then run on one or two cores; large inputs are left as
    they are. The planner's estimate of the size decides, so nothing is run for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if estimate < cores * SMALL_BYTES else df
