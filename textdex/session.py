"""Session helpers: tables, shared scratch folder, lineage cuts."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of the folder `sf_dir`."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path for `what` below the folder all executors share.

    The cluster names that folder in spark.checkpoint.dir; only on one machine, where it is unset, a temporary folder takes
    its place. A cluster without a shared folder is refused: what one executor writes there no other could read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "textdex-shared")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Paths of intermediate data by application, for each open scope.
_SCOPES: list[list[str]] = []


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A fresh shared path for intermediate data: removed at the end of the session, or of the innermost open scope. All
    paths of a session lie in one folder, which is made here: only what is there can be marked for removal."""
    base = shared_dir(spark, "").rsplit("/", 1)[0] + f"/textdex-{spark.sparkContext.applicationId}"
    fs, at = _file_system(spark, base)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    path = f"{base}/{what}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what operators wrote inside as intermediate data: results must be written or collected by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            fs, at = _file_system(spark, path)
            fs.delete(at, True)


def written(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """`df` written as a table in the shared folder and read back: cuts the lineage and outlives executors. The table is
    intermediate data (see scratch_dir)."""
    spark = df.sparkSession
    path = scratch_dir(spark, what)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_file(spark: SparkSession, local: str, folder: str) -> str:
    """Copies a file of the driver into the shared `folder`; its path there."""
    source = spark._jvm.org.apache.hadoop.fs.Path("file://" + os.path.abspath(local))
    fs, to = _file_system(spark, folder)
    fs.mkdirs(to)
    fs.copyFromLocalFile(False, True, source, to)
    return f"{folder}/{os.path.basename(local)}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each context: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_textdex_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as d:
        local = os.path.join(d, "textdex.zip")
        with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.join("textdex", os.path.relpath(os.path.join(folder, n), here)))
        sc.addPyFile(put_file(spark, local, scratch_dir(spark, "package")))
    sc._textdex_shipped = True


def tasks_of(spark: SparkSession) -> int:
    """Number of reduce tasks the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def rows_below(df: DataFrame, limit: int) -> bool:
    """Whether `df` has at most `limit` rows; reads no more than limit + 1 of them. The check before a broadcast."""
    return df.limit(limit + 1).count() <= limit
