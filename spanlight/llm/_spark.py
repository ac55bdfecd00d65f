"""Session helpers of the text operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; a local session without it (a test) gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spanlight-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether Spark deletes the shuffle files of a SQL execution at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Executions in this block delete their shuffle files when they end, not when the driver next collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared checkpoint folder; it takes a third of a checkpoint's space."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_by(df: DataFrame, column: str) -> DataFrame:
    """As ``stored``, and dealt out by a hash of ``column``: what is grouped by it later is not shuffled again."""
    spark, name = df.sparkSession, f"table_{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(spark)}/{name}"
    with shuffles_freed(spark):
        df.write.bucketBy(shuffle_partitions(spark), column).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolves the files; the name isn't needed any more
    spark.sql(f"DROP TABLE {name}")
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned and nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Hash buckets for intermediate blobs: several per shuffle partition, and more as the input grows."""
    return max(4 * shuffle_partitions(df.sparkSession), plan_bytes(df) // bytes_each)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def give_back(collect: bool = True) -> None:
    """Return the memory of freed objects to the system, as far as the platform can; ``collect`` first looks for cycles."""
    import pyarrow as pa

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freed(batches_to_batches):
    """The function for ``mapInArrow``, giving memory back at the end of a partition: the worker stays, idle or for other operators."""

    def run(batches):
        yield from batches_to_batches(batches)
        give_back()

    return run


def trimmed(of_groups):
    """The function for a grouped ``applyInArrow``, giving memory back after each group."""

    def one(table):
        out = of_groups(table)
        give_back(False)
        return out

    def two(left, right):
        out = of_groups(left, right)
        give_back(False)
        return out

    return one if of_groups.__code__.co_argcount == 1 else two
