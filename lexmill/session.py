"""Session and shared-folder helpers.

Lineage is cut only through the folder the cluster names in ``spark.checkpoint.dir``; a folder of our
own is set only where that is unset, as in local tests.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set a local session gets one under the system's temporary folder,
    removed at its end; on a cluster that is an error, for a folder of one machine is no place for the others' tables."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not named:
            own = tempfile.mkdtemp(prefix="lexmill-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(named or own)
    return named or sc._jsc.sc().getCheckpointDir().get()


def clean(spark: SparkSession) -> int:
    """Removes the tables that ``written`` made so far, once no result is to be read any more; gives their number. Checkpoints
    are removed by ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as a Parquet table into the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than there are cores, as one small file has; a scan of many
    files stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
