"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode, where driver and executors are one process, and only if no folder is named.
OWN_DIR = "/tmp/checkpoints/evlake"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. In local mode it may be unset, and is then set to OWN_DIR; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", OWN_DIR)
        found = OWN_DIR
    return found.rstrip("/")


#: Paths written within each scratch() that is open, the innermost last.
_open: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what written() and written_at() have written within it.

    Results are lazy and read those tables, so they must be stored or collected before it ends:
    `with scratch(spark): query(spark, folder).write.parquet(out)`.
    """
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            discard(spark, path)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """written(), and where it lies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and a lost executor costs nothing.

    It stays there, as results read it later, until the scratch() around it ends; without one a cluster
    clears the folder as it does checkpoints.
    """
    return written_at(df, name)[0]


#: By how much rows in memory are larger than their Parquet files, at most, where texts are much alike.
GROWS = 20


def sized_as_rows(spark: SparkSession) -> None:
    """Tells Spark for the session to size files by about what their rows take in memory, as it broadcasts and collects rows, not files; a larger factor stays."""
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) < GROWS:
        spark.conf.set(name, str(float(GROWS)))


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, for work on rows that costs far more than their bytes tell: a small file is a single task otherwise."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of written_at(); nothing may read it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
