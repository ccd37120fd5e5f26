"""Sinks. Each is one write of a DataFrame; groups are partition folders, so later scans prune them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import safe_name
from faultline.sources.files import write_files
from faultline.sources.json_arrays import write_arrays
from faultline.sources.shared import spread


def results(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """K1."""
    rows.write.json(f"{path}/results")
    summary.coalesce(1).write.json(f"{path}/summary")


def csv(rows: DataFrame, path: str) -> None:
    """K2: nested columns as JSON."""
    nested = ("struct", "array", "map")
    rows.select(*[F.to_json(c).alias(c) if rows.schema[c].dataType.typeName() in nested else F.col(c) for c in rows.columns]).write.option("header", True).csv(path)


def records(rows: DataFrame, path: str, form: str = "lines") -> None:
    """JSON lines, or files that are JSON arrays; memory is that of one batch."""
    if form == "array":
        write_arrays(rows, path)
    else:
        rows.write.json(path)


def by_pipeline(rows: DataFrame, path: str) -> None:
    """One folder for each pipeline; the root is the merged set."""
    rows.withColumn("pipeline_dir", safe_name(F.col("pipeline_name"))).write.partitionBy("pipeline_dir").json(path)


def by_status(rows: DataFrame, path: str) -> None:
    """Accepted, question_error and answer_error rows in one table."""
    rows.write.partitionBy("status").json(path)


def manifest(rows: DataFrame, options: dict[str, str], path: str) -> None:
    """K6: counts by status, and options."""
    counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    pairs = [x for k, v in options.items() for x in (F.lit(k), F.lit(v))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    counts.agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("counts")).withColumns({"options": made, "written_at": F.current_timestamp()}).coalesce(1).write.json(path)


def quarantine(images: DataFrame, path: str) -> None:
    """K7."""
    images.where("skipped").select("image_id", "skip_reason").write.mode("append").json(path)


def export_media(rows: DataFrame, folder: str) -> int:
    """K9: image_%06d.<format> and its conversation beside it; returns the number of files.

    rows: idx, format, image_bytes, conversation (JSON). Files get their names when they are whole, so a task that runs
    again leaves the same files.
    """
    stem = F.format_string("image_%06d", "idx")
    both = F.array(F.struct(F.concat_ws(".", stem, "format").alias("name"), F.col("image_bytes").alias("data")), F.struct(F.concat(stem, F.lit(".json")).alias("name"), F.encode("conversation", "UTF-8").alias("data")))
    return write_files(rows.select(F.explode(both).alias("x")).select("x.*"), folder)


def tar_shards(rows: DataFrame, path: str, most: int = 128) -> None:
    """Tar shards of at most so many samples, beside those that are there. rows: key, media (array<binary>), json."""
    spread(rows, "key").write.format("tar_samples").option("path", path).option("maxcount", str(most)).mode("append").save()


def annotations(rows: DataFrame, path: str) -> None:
    """Annotations, and their sorted distinct factors."""
    rows.write.json(f"{path}/annotations")
    factors(rows).coalesce(1).write.json(f"{path}/factors")


def factors(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("filter_factor_texts").alias("text")).distinct().orderBy("text")


def calls(log: DataFrame, path: str) -> None:
    """K13."""
    log.write.mode("append").partitionBy("stage").json(path)


def intermediate(rows: DataFrame, path: str) -> DataFrame:
    """Written and read again, which also cuts the plan."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def tar_report(spark, path: str, out: str, n: int = 5) -> None:
    """Keys, types and sizes of the first n samples of each shard; no data is read."""
    rows = spark.read.format("tar_samples").option("path", path).option("samples", str(n)).option("headers", "true").load()
    rows.select(F.to_json(F.struct("shard", "key", "name", "size")).alias("value")).write.text(out)
