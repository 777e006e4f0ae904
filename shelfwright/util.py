"""Small helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Number of partitions for stages whose work is heavy per row (Python, similarity joins)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-distribute rows by high-cardinality keys, so that a small number of input files doesn't bound parallelism.

    By a hash of the keys: a repartition by the keys themselves is dropped after an aggregate on them, and adaptive execution then
    merges its partitions by bytes, which leaves too few tasks for work that is heavy per row.
    """
    return df.repartition(width(df.sparkSession), F.xxhash64(*keys))


def clustered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together, for grouped Python work, in a number of partitions that adaptive execution doesn't merge by bytes."""
    return df.repartition(width(df.sparkSession) + 1, *keys)


def local(spark: SparkSession) -> bool:
    """Whether all tasks run in this machine's one process, so that its folders are seen by every task."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, from spark.checkpoint.dir. Where that is unset, a folder of the session's own in local mode (removed
    at exit) and an error on a cluster, whose machines don't share a folder that this process could choose."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shelfwright-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    sc.setCheckpointDir(base)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame once in reliable shared storage; later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A frame written once as Parquet in the shared folder: narrower on disk than a checkpoint, for frames of many rows.

    What was shuffled for it is of no more use. Spark removes it when the driver collects its garbage, so that is done here."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*frames: DataFrame) -> None:
    """Remove the files of `stored` frames that nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            sc = df.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def blank(col):
    """True where a string is null or holds only white space."""
    return col.isNull() | (F.regexp_replace(col, r"(?U)^\s+|\s+$", "") == "")
