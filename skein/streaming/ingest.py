"""Streaming ingest: landed files to deduplicated Parquet, and per-period state that late records correct."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators import late


def read_stream(spark: SparkSession, path: str, schema, form: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(form).load(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str, watermark: str = "1 hour") -> DataFrame:
    """Each key once; the watermark bounds what is remembered."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def append(stream: DataFrame, out: str, checkpoint: str, partition: list[str] = (), available_now: bool = True) -> StreamingQuery:  # type: ignore[assignment]
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    if partition:
        writer = writer.partitionBy(*partition)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="10 seconds").start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], period: str = "5 minutes", lateness: str = "30 minutes") -> DataFrame:
    """Counts per period of event time in update mode: late records correct them until the watermark passes."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, period), *keys).agg(F.count("*").alias("n"))


DAY_MS = 86_400_000
#: Partition column of the state.
DAY = "state_day"


class LateState:
    """Multiset state of ``skein.operators.late`` in one folder per version, split by day of event time.

    Each micro-batch adds its counts to the days that it touches and writes only these as the next version, whose number
    is the batch id; so a repeated batch replaces what it wrote before instead of counting twice. The state is the newest
    folder of each day. A missing version is an error. ``expire`` removes what is final or replaced.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def _path(self, version: int) -> str:
        return f"{self.folder}/version={version:012d}"

    def _exists(self, version: int) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(version) + "/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def fold(self, delta: DataFrame, batch: int) -> None:
        """Adds the counts of a batch: of days that it touches, each is written anew as part of the version ``batch``."""
        if batch and not self._exists(batch - 1):
            raise FileNotFoundError(f"version {batch - 1} of the state is missing: {self._path(batch - 1)}")
        day = F.floor(F.col("period_start_ms") / DAY_MS).cast("int").alias(DAY)
        delta = delta.select("*", day)
        state = delta.drop(DAY)
        if batch:
            touched = [r[DAY] for r in delta.select(DAY).distinct().collect()]  # days of one micro-batch
            before = self.read(batch - 1, touched)
            state = before.unionByName(state) if before is not None else state
        whole = late.merge(state, keys=self.keys).select("*", day)
        whole.write.mode("overwrite").partitionBy(DAY).parquet(self._path(batch))

    def _places(self, version: int) -> dict[int, str]:
        """Folder of the newest state of each day, of the versions up to ``version``; as many entries as days."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found: dict[int, str] = {}
        for v in sorted(s.getPath().getName() for s in system.listStatus(path) if s.getPath().getName().startswith("version=")):
            if int(v.removeprefix("version=")) <= version and self._exists(int(v.removeprefix("version="))):
                for s in system.listStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{v}")):
                    if s.getPath().getName().startswith(f"{DAY}="):
                        found[int(s.getPath().getName().removeprefix(f"{DAY}="))] = f"{self.folder}/{v}/{s.getPath().getName()}"
        return found

    def read(self, version: int, days: list[int] | None = None) -> DataFrame | None:
        """The state as of a version (of some days); None if it holds nothing."""
        paths = [p for d, p in self._places(version).items() if days is None or d in days]
        return self.spark.read.parquet(*paths) if paths else None

    def expire(self, version: int, before_ms: int) -> int:
        """Deletes the folders of days that ended before ``before_ms`` and those that a later version replaced."""
        system = None
        kept, gone = set(self._places(version).values()), 0
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for v in system.listStatus(root):
            for s in system.listStatus(v.getPath()) if v.isDirectory() else []:
                name = s.getPath().getName()
                if name.startswith(f"{DAY}=") and int(v.getPath().getName().removeprefix("version=")) <= version:
                    place = f"{self.folder}/{v.getPath().getName()}/{name}"
                    if place not in kept or (int(name.removeprefix(f"{DAY}=")) + 1) * DAY_MS <= before_ms:
                        gone += system.delete(s.getPath(), True)
        return gone

    def start(self, stream: DataFrame, to_state, checkpoint: str) -> StreamingQuery:
        """``to_state``: function from a batch of records to state rows, such as a call of ``late.multiset``."""
        return stream.writeStream.foreachBatch(lambda df, n: self.fold(to_state(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, source: str, out: str, keys: list[str], version: str, partition: list[str] = (), files: int | None = None) -> None:  # type: ignore[assignment]
    """Rewrites a table with the last write of each key, clustered by the keys."""
    rows = spark.read.parquet(source)
    body = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*body), version).alias("b")).select(*keys, "b.*").select(*rows.columns)
    last = last.repartition(files, *keys) if files else last
    writer = last.sortWithinPartitions(*keys).write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(out)
