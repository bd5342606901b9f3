"""Helpers shared by the corpus operators: shared tables, words, row identity."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, and code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's own setting: a plan's shuffle files are deleted when it has run, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tributary-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


class Scratch:
    """Parquet tables of one operator run in the shared folder; they cut lineage and survive lost executors.

    A table goes when ``drop`` names it; what is left goes when the driver ends.
    """

    #: Those whose tables have not been removed.
    live: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.live.append(self)
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """The rows as a table; shuffle files of the plan that made them go as soon as it is written."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Removes all tables; nothing that is still to be computed may need them."""
        if self in Scratch.live:
            Scratch.live.remove(self)
        try:
            self.drop()
        except Exception:  # the session has ended; nothing can be removed through it
            pass


def given_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(run):
    """A function over Arrow batches that gives its memory back when it ends."""
    @wraps(run)
    def lean_run(batches):
        try:
            yield from run(batches)
        finally:
            given_back()

    return lean_run


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain ASCII texts take the built-in function's fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
