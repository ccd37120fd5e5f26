"""Helpers that several of the corpus operators use."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.sampling import numbered_in

#: Rows of one Arrow batch. Texts can be long, so batches are kept well below Spark's default of 10,000 rows.
ARROW_ROWS = 1000


#: Spark drops a query's shuffle files once the query has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-faultline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts the lineage and survives lost executors.

    The query's shuffle files go once the table is written, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with settings(spark, {DROP_SHUFFLES: "true"}):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark builds a Bloom filter (1 MB for each million of keys, 8 MB at most) of a join's smaller side and drops rows of the
#: larger one before they are shuffled. By default it does so only for scans of 10 GB and keys of 10 MB.
BLOOM = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in {"applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1g", "expectedNumItems": "4000000", "numBits": "33554432"}.items()}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for as long as a table is written."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Named columns alone, so extra columns of the caller's table can't clash with ours."""
    return df.select(*[F.col(f"`{x}`") for x in names])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to clash with no column of a table."""
    taken, out = {c.lower() for c in df.columns}, []
    for x in names:
        while x.lower() in taken:
            x = "_" + x
        out.append(x)
    return out


def placed(df: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Adds the place (from 0) of each row in its group, in an order; a group of any size is spread over tasks."""
    return numbered_in(df, group, order, name).withColumn(name, F.col(name) - 1)


def few(df: DataFrame, most: int) -> DataFrame:
    """The table, marked for broadcasting if it has so many rows at most: the size is counted, not assumed."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def crc32_sql(text: str) -> str:
    """A DuckDB expression for the unsigned crc32 of an ASCII text, bit by bit (null for null)."""
    bit = "lambda a, b: xor(a // 2, case when a % 2 = 1 then 3988292384::bigint else 0::bigint end)"
    byte = f"lambda c, x: list_reduce(list_concat([xor(c, x)], [0::bigint for i in range(8)]), {bit})"
    return f"case when {text} is not null then xor(list_reduce(list_concat([4294967295::bigint], [ord(z)::bigint for z in string_split({text}, '')]), {byte}), 4294967295::bigint) end"
