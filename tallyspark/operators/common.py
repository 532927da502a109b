"""What the operators share: cutting lineage in the folder that a session's executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none and all runs on one
    machine, as in tests, a folder of this machine serves; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tallyspark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
    return at


#: Shuffle files of a write go when it ends; else they stay until the driver has collected all that names them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a Parquet page: a table in order of a column is read page by page.
PAGE = 4_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as compressed columns to the shared folder and read them back.
    They stay there until `drop_kept` or `let_go`."""
    table = Parts(df.sparkSession)
    table.add(df)
    return table.read()


class Parts:
    """A table in the shared folder that is written part by part."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.paths, self.schema = spark, f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}", [], None
        _kept.setdefault(spark.sparkContext.applicationId, set()).add(self.path)

    def add(self, df: DataFrame) -> DataFrame:
        """Write rows as a further part, which is returned."""
        spark, path = self.spark, f"{self.path}/part-{len(self.paths)}"
        self.schema = self.schema or df.schema
        before = spark.conf.get(CLEANUP)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("parquet.page.row.count.limit", PAGE).parquet(path, compression="zstd")
        finally:
            spark.conf.set(CLEANUP, before)
        self.paths.append(path)
        gc.collect()  # plans that nothing refers to any more let Spark drop their shuffle files
        spark.sparkContext._jvm.System.gc()
        return spark.read.schema(self.schema).parquet(path)

    def read(self) -> DataFrame:
        """All parts so far."""
        out = self.spark.read.schema(self.schema).parquet(*self.paths)
        out.kept_path = self.path
        return out


_kept: dict[str, set[str]] = {}


def kept(spark: SparkSession) -> set[str]:
    """Paths of the tables that this application has checkpointed and not deleted."""
    return set(_kept.get(spark.sparkContext.applicationId, ()))


def drop_kept(spark: SparkSession, but: set[str], *tables: DataFrame) -> None:
    """Delete what has been checkpointed but the paths `but` and the tables named, which nothing else may
    read from then on."""
    _delete(spark, kept(spark) - but - {df.kept_path for df in tables})


def let_go(*tables: DataFrame) -> None:
    """Delete these checkpointed tables, which nothing may read from then on."""
    for df in tables:
        _delete(df.sparkSession, {df.kept_path})


def _delete(spark: SparkSession, paths: set[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _kept[spark.sparkContext.applicationId].discard(path)
