"""Record tables on files: scans, one-step publishing, uploads."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .log import Conflict, Folder

TEXT, IMAGES = ("md",), ("png", "jpg", "jpeg", "gif", "svg", "webp")


def spread(scan: DataFrame) -> DataFrame:
    """A scan on all cores where its files have fewer splits than there are cores.

    Large inputs have more splits and stay as they are, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: Rows that a task is dealt where several steps sort them.
ROWS = 1 << 18


def parts_of(scan: DataFrame) -> int:
    """Partitions of some `ROWS` rows of a scan, one for each core at least.

    Partitions that Spark packs by bytes hold narrow rows by the million, and a task's memory grows with them.
    Parquet files count from their footers.
    """
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // ROWS))


#: Tasks for each split of a scan where texts are dealt by key, so that a task sorts half a split.
TASKS_OF_SPLIT = 2


def text_parts_of(scan: DataFrame, tasks: int = TASKS_OF_SPLIT) -> int:
    """Partitions of a scan whose texts are dealt by key, one for each core at least.

    A split has bounded bytes, so what a task sorts doesn't grow with the table.
    """
    return max(scan.sparkSession.sparkContext.defaultParallelism, tasks * scan.rdd.getNumPartitions())


class Store:
    """A table as versioned folders; numbered pointer files name them, so readers see one whole version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = Folder(spark, path)

    def version(self) -> int:
        """The current version; 0 before the first."""
        return max((int(n.split("-")[1]) for n in self._folder.names() if n.startswith("current-")), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        version = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/data-{self._folder.text(f'current-{version:010d}')}") if version else None

    def publish(self, table: DataFrame, *partition: str, after: int | None = None) -> int:
        """Writes a new version, then its pointer; old versions stay readable for running queries.

        after: the version that the table was made from; Conflict if another one followed it.
        """
        name = uuid4().hex
        writer = table.write.partitionBy(*partition) if partition else table.write
        writer.parquet(f"{self.path}/data-{name}")
        number = (self.version() if after is None else after) + 1
        while not self._folder.create(f"current-{number:010d}", name):
            if after is not None:
                raise Conflict(f"version {number} is another writer's")
            number += 1
        return number

    def active(self, doc_id: str) -> DataFrame:
        return self.read().where(F.col("active") & (F.col("doc_id") == doc_id))

    def of_job(self, doc_id: str, job_id: str) -> DataFrame:
        return self.read().where((F.col("doc_id") == doc_id) & (F.col("job_id") == job_id))

    def editions(self, name: str) -> DataFrame:
        return self.read().where(F.col("active") & (F.col("name") == name)).groupBy("doc_id").agg(F.max_by("edition", "chunk_id").alias("edition"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, name, kind (markdown, image, unknown), text, fault of uploaded files; text is strict UTF-8."""
    raw = spark.read.format("binaryFile").load(path)
    ext = tx.extension(F.col("path"))
    kind = F.when(ext.isin(*TEXT), "markdown").when(ext.isin(*IMAGES), "image").otherwise("unknown")
    rows = raw.select("path", tx.base_name(F.col("path")).alias("name"), kind.alias("kind"), "length", "content")
    fine = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when((F.col("kind") == "markdown") & fine, F.col("content").cast("string"))
    fault = F.when(F.col("kind") == "unknown", "unsupported").when((F.col("kind") == "markdown") & ~fine, "not_utf8")
    return rows.select("path", "name", "kind", "length", text.alias("text"), fault.alias("fault"))
