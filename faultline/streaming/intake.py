"""Incremental intake on Structured Streaming.

The source has no event time, so there is no watermark; queries run with ``availableNow``, and what grows with the
number of references seen is held in a table in buckets, to which each batch is anti-joined.
"""

from __future__ import annotations

import hashlib

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def read_files(spark: SparkSession, folder: str, schema: str, k: int, kind: str = "parquet") -> DataFrame:
    """K new files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", k).format(kind).load(folder)


class Seen:
    """References seen so far, over all runs: a table in buckets of the reference, so a batch is compared without moving it.

    A batch's references stand under its number. Those of a batch are compared with the batches before it only, so a batch
    that runs again, after a crash or a lost commit, gives the same rows and adds nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "image_ref", kind: str = "string", buckets: int = 64) -> None:
        self.key, self.name = key, f"seen_{hashlib.md5(path.encode()).hexdigest()[:16]}"
        spark.sql(f"create table if not exists {self.name} (ref {kind}, batch long) using parquet clustered by (ref) into {buckets} buckets location '{path}'")

    def before(self, spark: SparkSession, number: int) -> DataFrame:
        spark.catalog.refreshTable(self.name)
        return spark.table(self.name).where(F.col("batch") < number)

    def fresh(self, batch: DataFrame, number: int) -> DataFrame:
        """One row for each reference of a batch that no earlier batch had; rows without a reference go."""
        rows = batch.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        old = self.before(batch.sparkSession, number).select(F.col("ref").alias(self.key))
        return rows.join(old, self.key, "left_anti")

    def add(self, rows: DataFrame, number: int) -> None:
        """The references of a batch, once; rows are those that ``fresh`` gave, as written."""
        spark = rows.sparkSession
        if self.before(spark, number + 1).where(F.col("batch") == number).isEmpty():
            rows.select(F.col(self.key).alias("ref"), F.lit(number).cast("long").alias("batch")).write.insertInto(self.name)


def once_each(stream: DataFrame, path: str, checkpoint: str, seen: Seen) -> None:
    """Each reference once in ``path``/batch=n, over all runs with this checkpoint. The stream itself keeps no state."""

    def sink(batch: DataFrame, number: int) -> None:
        out = f"{path}/batch={number}"
        seen.fresh(batch, number).write.mode("overwrite").parquet(out)
        seen.add(batch.sparkSession.read.schema(batch.schema).parquet(out), number)

    run(stream, sink, checkpoint)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there, batch by batch."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_both(path: str, failed) -> Callable[[DataFrame, int], None]:
    """Failures and quarantined rows of a batch, in folders by batch id, so a batch that runs again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("failed", failed)
        batch.where("failed").write.mode("overwrite").parquet(f"{path}/failures/batch={number}")
        batch.where(~F.col("failed")).write.mode("overwrite").parquet(f"{path}/rest/batch={number}")

    return sink


class Collected(Exception):
    """Raised in a batch that is not to be taken any more, so that Spark doesn't commit it."""


def collect_until(stream: DataFrame, failed, path: str, checkpoint: str, target: int, most_empty: int) -> int:
    """Whole batches until so many failures, or so many batches in a row without one; the failures found so far.

    Counts of batches are kept beside the output, so a later run goes on where this one ended. The batch after the last
    one is refused before it is written or committed: its files are read again by the next run that still needs some.
    """
    spark = stream.sparkSession

    def so_far(number: int | None = None) -> tuple[int, int]:
        """Failures and trailing empty batches, of the batches before a number."""
        rows = spark.read.schema("batch long, n long").option("ignoreMissingFiles", True).json(f"{path}/progress")
        hits = [r.n for r in rows.orderBy("batch").collect() if number is None or r.batch < number]  # a row for each batch
        return sum(hits), next((k for k, n in enumerate(reversed(hits)) if n), len(hits))

    def over(found: int, empty: int) -> bool:
        return found >= target or empty >= most_empty

    def sink(batch: DataFrame, number: int) -> None:
        if over(*so_far(number)):
            raise Collected
        own = batch.sparkSession
        batch.where(failed).write.mode("overwrite").parquet(f"{path}/batch={number}")
        n = own.read.schema(batch.schema).parquet(f"{path}/batch={number}").count()
        own.createDataFrame([(number, n)], "batch long, n long").coalesce(1).write.mode("overwrite").json(f"{path}/progress/part={number}")

    spark.createDataFrame([], "batch long, n long").write.mode("append").json(f"{path}/progress")
    if over(*so_far()):
        return so_far()[0]
    try:
        run(stream, sink, checkpoint)
    except StreamingQueryException:
        if not over(*so_far()):
            raise
    return so_far()[0]


class Progress(StreamingQueryListener):
    """Rows and batches of each query so far."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
        self.batches[str(p.id)] = p.batchId + 1

    def onQueryTerminated(self, event) -> None:
        pass
