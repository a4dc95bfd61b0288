"""Parquet tables: day-partitioned appends, keyed tables whose batches rewrite only the buckets they touch, cycles appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.tables import insert_absent, upsert


def append_by_day(df: DataFrame, path: str, time: str) -> None:
    """Append partitioned by UTC day of an epoch-millisecond column. Rows of a day are spread
    over tasks by Spark's adaptive rebalance, so a heavy day is many files, not one task."""
    df.withColumn("day", V.utc_day(time)).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def read_window(spark: SparkSession, path: str, time: str, from_ms: int) -> DataFrame:
    """Rows at or after a time; whole days before it are pruned."""
    first_day = F.date_add(F.lit("1970-01-01").cast("date"), F.lit(from_ms // 86_400_000).cast("int"))
    return spark.read.parquet(path).filter((F.col("day") >= first_day) & (F.col(time) >= from_ms)).drop("day")


class _Versions:
    """A folder of numbered versions; a version counts once Spark has marked it as finished, and writing it again replaces it, so a
    repeated micro-batch changes nothing."""

    PREFIX = "v"

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _children(self, *below: str) -> list[str]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *below]))
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self, before: int | None = None) -> list[int]:
        names = [n.removeprefix(self.PREFIX) for n in self._children() if n.startswith(self.PREFIX)]
        found = sorted(int(n) for n in names if n.isdigit() and (before is None or int(n) < before))
        return [v for v in found if "_SUCCESS" in self._children(f"{self.PREFIX}{v}")]


class KeyedTable(_Versions):
    """A keyed table, one row per key, dealt to ``buckets`` by a hash of the key. A batch becomes a version that holds only the buckets it
    touches; readers take each bucket from the newest version that has it. So a batch reads and writes what it touches, readers
    never see half of it, and the files of other buckets stay as they are."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        super().__init__(spark, path, schema)
        self.key, self.buckets = list(key), buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def places(self, before: int | None = None) -> dict[int, str]:
        """The folder that holds each bucket."""
        out = {}
        for v in self.versions(before):
            for name in self._children(f"v{v}"):
                if name.startswith("bucket="):
                    out[int(name[7:])] = f"{self.path}/v{v}/{name}"
        return out

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        found = [p for b, p in sorted(self.places(before).items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, order: str, preserve: list[str], version: int) -> None:
        """Upsert of a batch: the last writer wins by ``order``, columns in ``preserve`` keep the first writer's value."""
        bucketed = self._bucketed(rows)
        touched = [r.bucket for r in bucketed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        merged = upsert(self.read(version, touched), rows, self.key, order, preserve)
        self._bucketed(merged).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")


class CycleTable(_Versions):
    """Rows appended once per key and cycle, partitioned by (batch, cycle). A batch meets only the cycles it brings itself."""

    PREFIX = "batch="

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], cycle: str):
        super().__init__(spark, path, schema)
        self.key, self.cycle = list(key), cycle

    def read(self, before: int | None = None) -> DataFrame:
        found = [f"{self.path}/{self.PREFIX}{v}" for v in self.versions(before)]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        # The cycle is a folder: of other cycles nothing is read.
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*found).drop("batch")

    def append_absent(self, rows: DataFrame, version: int) -> None:
        old = self.read(version)
        met = old.join(rows.select(self.cycle).distinct(), self.cycle, "left_semi")
        new = insert_absent(met, rows.select(*old.columns), self.key)
        new.write.mode("overwrite").partitionBy(self.cycle).parquet(f"{self.path}/{self.PREFIX}{version}")
