"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that are read, and sent to a Python worker, at once, in place of Spark's own numbers: whole texts may be long, and a
#: batch lies in an executor's memory several times.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512")}
#: Bytes of a stored table's row group, which its writer holds.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a local folder if Spark itself is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    made = "file://" + tempfile.mkdtemp(prefix="epochlake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def lean(spark: SparkSession) -> None:
    """Small batches for this session, where the user has set none."""
    for name, (own, few) in BATCHES.items():
        if spark.conf.get(name, own) == own:
            spark.conf.set(name, few)


class Scratch:
    """Named tables of one operator call, written once and reread: a lost executor costs no recomputation of what came before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        lean(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
        """``df`` as a stored table. The shuffle files of its writing go with it: nothing else reads them. ``settings`` of the
        session hold for that writing."""
        path = self.path(name)
        settings = {CLEANUP: "true"} | (settings or {})
        before = {k: self.spark.conf.getAll.get(k) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give back freed memory that Arrow's pool and the C library hold for reuse: a worker lives on beside those of the next
    stage, and shares an executor's memory with the JVM, as the driver's Python does the driver's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that clash with what an operator adds, in any letter case."""
    clash = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in clash])


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
