"""Datasets as Parquet folders with a JSON manifest each, named by run, type and lineage hash.

All access goes through Spark's readers and Hadoop's file system, so a root may
lie in any store that Spark reaches.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class DatasetStore:
    root: str
    readonly: bool = False
    overwrite: str = "if_broken"  # never, if_broken, always
    take_only: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    codec: str = "zstd"

    def takes(self, data_type: str) -> bool:
        listed = not self.take_only or any(fnmatch.fnmatch(data_type, p) for p in self.take_only)
        return not self.readonly and listed and not any(fnmatch.fnmatch(data_type, p) for p in self.exclude)

    def path(self, key: tuple[str, str, str]) -> str:
        if "-" in key[0] or "-" in key[1]:
            raise ValueError("no - in the names of runs and data types")
        return f"{self.root}/{'-'.join(key)}"

    def _fs(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where

    def has(self, spark: SparkSession, key: tuple[str, str, str]) -> bool:
        """Whether there is a manifest: it appears by a rename, after the data that it names."""
        fs, where = self._fs(spark, f"{self.path(key)}/manifest")
        return fs.exists(where)

    def keys(self, spark: SparkSession, run_id: str, data_type: str) -> list[tuple[str, str, str]]:
        fs, where = self._fs(spark, f"{self.root}/{run_id}-{data_type}-*")
        found = [tuple(s.getPath().getName().split("-")) for s in fs.globStatus(where) or []]
        return [k for k in found if len(k) == 3 and self.has(spark, k)]

    def manifest(self, spark: SparkSession, key: tuple[str, str, str]) -> dict:
        return json.loads(spark.read.text(f"{self.path(key)}/manifest", wholetext=True).first()[0])

    def manifests(self, spark: SparkSession, run_id: str = "*", data_type: str = "*") -> DataFrame:
        """(run_id, data_type, hash, n, mb, start, end) of all datasets that match, a row each, read in one job; without any, no rows."""
        schema = "run_id string, data_type string, hash string, n long, mb double, start long, end long"
        fs, where = self._fs(spark, f"{self.root}/{run_id}-{data_type}-*/manifest")
        if not fs.globStatus(where):
            return spark.createDataFrame([], schema)
        text = spark.read.text(str(where), wholetext=True).select(F.split(F.element_at(F.split(F.input_file_name(), "/"), -3), "-").alias("k"), F.from_json("value", "n long, bytes long, start long, end long").alias("m"))
        return text.select(F.col("k")[0].alias("run_id"), F.col("k")[1].alias("data_type"), F.col("k")[2].alias("hash"), "m.n", (F.col("m.bytes") / 1e6).alias("mb"), "m.start", "m.end")

    def write(self, df: DataFrame, key: tuple[str, str, str], about: dict, rows_per_file: int = 0) -> None:
        """Data go to a folder of their own; the manifest, which names it, is renamed into place after that, and only then what was there before goes."""
        spark, path = df.sparkSession, self.path(key)
        if self.readonly:
            raise PermissionError(f"{self.root} is read-only")
        if self.has(spark, key) and self.overwrite != "always":
            raise FileExistsError(path)
        name = f"data-{uuid.uuid4().hex}"
        writer = df.write.option("compression", self.codec)
        (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(f"{path}/{name}")
        data = spark.read.parquet(f"{path}/{name}")
        bounds = [F.min("time").alias("start"), F.max("endtime").alias("end")] if {"time", "endtime"} <= set(data.columns) else []
        got = data.agg(F.count(F.lit(1)).alias("n"), *bounds).first().asDict()
        fs, folder = self._fs(spark, path)
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        size = fs.getContentSummary(jpath(f"{path}/{name}")).getLength()
        text = json.dumps({**about, **got, "bytes": size, "data": name, "codec": self.codec, "schema": df.schema.jsonValue()})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/manifest-{name}")
        fs.delete(jpath(f"{path}/manifest"), True)
        if not fs.rename(jpath(f"{path}/manifest-{name}"), jpath(f"{path}/manifest")):
            raise OSError(f"no manifest could be put in {path}")
        for other in fs.listStatus(folder):
            if other.getPath().getName().startswith("data-") and other.getPath().getName() != name:
                fs.delete(other.getPath(), True)

    def read(self, spark: SparkSession, key: tuple[str, str, str], time_range: tuple[int, int] | None = None, check: bool = False) -> DataFrame:
        """The rows; ``time_range`` keeps those that touch it, which Parquet's statistics prune by.

        ``check`` first counts the rows, from the files' footers, and raises where
        the manifest has another number.
        """
        manifest = self.manifest(spark, key)
        df = spark.read.parquet(f"{self.path(key)}/{manifest['data']}")
        if check and (n := df.count()) != manifest["n"]:
            raise ValueError(f"{self.path(key)} has {n} rows, its manifest {manifest['n']}")
        return df if time_range is None else df.where((F.col("endtime") > time_range[0]) & (F.col("time") < time_range[1]))

    def size_mb(self, spark: SparkSession, key: tuple[str, str, str]) -> float:
        return self.manifest(spark, key)["bytes"] / 1e6

    def remove(self, spark: SparkSession, key: tuple[str, str, str]) -> None:
        fs, where = self._fs(spark, self.path(key))
        fs.delete(where, True)


def copy_dataset(spark: SparkSession, source: DatasetStore, target: DatasetStore, key: tuple[str, str, str], rows_per_file: int = 0) -> None:
    """One dataset from store to store, in files of at most so many rows."""
    target.write(source.read(spark, key), key, source.manifest(spark, key), rows_per_file)
