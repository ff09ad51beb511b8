"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parent.parent)


def get_spark(app: str = "lumentab", cpus: str | int | None = None, shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LUMENTAB_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the same path as the driver.

    Where executors have no such path the package is installed or sent with --py-files.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if REPO not in parts:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *parts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: that of spark.checkpoint.dir, or the one set on the context.

    A local session without either gets a folder of its own. On a cluster there is none that all executors share, so that
    this is an error there.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lumentab-checkpoints-")
    _remove_at_end(spark, own)
    sc.setCheckpointDir(own)
    return own


def _remove_at_end(spark: SparkSession, path: str) -> None:
    """The file system removes path when the driver's JVM ends."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder and read back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Like cut, but as a columnar table, which later reads prune by column. It is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, into: str, start: int = 0) -> DataFrame:
    """df with the number of each row in the order of its partitions; never in one task.

    The rows are written once; what reaches the driver is the number of rows of each partition.
    """
    rows = staged(df.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()), "numbered")
    parts = rows.groupBy("_p").agg(F.count("*").alias("n"), F.min("_k").alias("k")).orderBy("_p").collect()
    before, offsets = start, []
    for r in parts:
        offsets.append((r["_p"], before - r["k"]))
        before += r["n"]
    table_of = df.sparkSession.createDataFrame(offsets, "_p int, _before long")
    return rows.join(F.broadcast(table_of), "_p").withColumn(into, F.col("_k") + F.col("_before")).drop("_p", "_k", "_before")  # one row for each partition


def ranked(df: DataFrame, order: list, into: str = "rank") -> DataFrame:
    """df with the place of each row, from 0, in a total order; sorted by ranges."""
    return numbered(df.orderBy(*order), into)
