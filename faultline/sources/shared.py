"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark drops a query's shuffle files once the query has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; a temporary folder where none is set and all run on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-faultline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows of a task that writes files, and tasks at most.
TASK_ROWS, MOST_TASKS = 1000, 2000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key to tasks whose number follows the rows, however few files they come from; few rows stay in place."""
    n = min(MOST_TASKS, -(-rows.select(key).count() // TASK_ROWS))
    return rows.repartition(n, key) if n > 1 else rows


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table and read it again: cuts the lineage and survives lost executors.

    The query's shuffle files go once the table is written, since nothing reads them again.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
