"""Session settings and shared tables that cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's own setting: a plan's shuffle files are deleted when it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tributary-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get()
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; nothing can be removed through it
        pass


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """The rows as a Parquet table in the shared folder: later plans start from files that outlive executors; its shuffle files go at once."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of an iteration: a round's table goes once the next one, which is made from it, is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.k = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(_remove, spark, self.root)

    def put(self, df: DataFrame) -> DataFrame:
        self.k += 1
        df.write.parquet(f"{self.root}/{self.k}")
        _remove(self.spark, f"{self.root}/{self.k - 1}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.k}")

    def clear(self) -> None:
        """Removes the last round's table too; nothing that is still to be computed may need it."""
        _remove(self.spark, self.root)


def running(df: DataFrame, order: Column, sums: dict[str, str]) -> DataFrame:
    """With sums of columns up to each row in an order of distinct values: {new name: column}.  Ranges of rows are summed apart
    and carry the sums of the ranges before them, one row each, so no task sees all rows."""
    spark = df.sparkSession
    part = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_part", F.spark_partition_id())
    part = stage(part, "ranges")
    down = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = part.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    offset = each.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    rows = part.withColumns({n: F.sum(c).over(down) for n, c in sums.items()}).join(offset, "_part")
    return rows.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *[f"_{n}" for n in sums])
