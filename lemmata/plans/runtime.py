"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have at most, by proof and not by hope, to be broadcast.
BROADCAST_ROWS = 100_000
#: Spark's setting that ends the shuffle files of a query with the query; else they stay until the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "lemmata", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the operators expect; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEMMATA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark context.

    Spark's file server hands it out, so the workers need neither the repository nor a path to it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lemmata_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="lemmata-ship-")) / "lemmata_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._lemmata_shipped = True


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a directory of Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see.

    Where it is unset a local session makes a folder of its own; on a cluster that is an error, because a folder of
    one machine would be lost to the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can read and write")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lemmata-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that holds the intermediate tables of this Spark application."""
    return f"{shared_folder(spark)}/lemmata-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application: to be called once its results have been written.

    Results are lazy, so materialize() cannot know when its table is done with; at the end of the Python process the
    tables are deleted in any case.
    """
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _release_at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the application has ended already
        pass


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The lineage ends at files that outlive executors, so a lost executor costs a task, not the job.
    Columns come back in the same order; an empty df keeps its schema. See release() for the end of these tables.
    The shuffle files of df are deleted once it is written.
    """
    spark = df.sparkSession
    if not getattr(spark.sparkContext, "_lemmata_release", False):
        atexit.register(_release_at_exit, spark)
        spark.sparkContext._lemmata_release = True
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of df if rows, a proven bound of its row count, is small; else leave it to AQE."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
