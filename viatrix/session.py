"""Session for local work; on a cluster the caller brings its own."""

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path may be any that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; set only where unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = f"file:///tmp/checkpoints/viatrix-{os.getpid()}"
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the shared folder.

    Unlike a checkpoint it carries no constraints on, conditions on columns that rounds of joins would repeat in each other; it is
    compressed, and the planner knows its size, so that what explode() made large is not sent to all executors for the size it had before.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables of written() that no plan reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
