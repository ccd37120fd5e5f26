"""Scans. Names that differ between files are settled here, once; every scan has a fixed schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.media import decode_base64
from faultline.functions.seeded import u
from faultline.functions.text import clean_text
from faultline.sources.json_arrays import read_array
from faultline.sources.shared import materialize

RESULT = (
    "image_id string, image_path string, total_claims long, failed_claims long, success_rate double, failure_breakdown map<string,long>, failed_claim_ids array<string>, "
    "verifications array<struct<claim_id:string,is_correct:boolean,not_related_judgment_correct:boolean,failure_reason:string,failure_id:string>>"
)


#: Folders of images that one scan of conversations looks into; a folder may have any number of files.
MOST_FOLDERS = 10_000


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, by Hadoop, so any store will do; sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def _small_text(spark: SparkSession, path: str, most: int = 64 << 20) -> str:
    """A file that the driver parses, of ``most`` bytes at most."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > most:
        raise ValueError(f"{path} has {size} bytes; a configuration or manifest has {most} at most")
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """All parquet files of a folder, with file name and row number; an error if there are none."""
    if not _files(spark, f"{folder}/*.parquet"):
        raise FileNotFoundError(f"no parquet files in {folder}")
    return spark.read.parquet(f"{folder}/*.parquet").select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def resolve_payload(df: DataFrame) -> DataFrame:
    """image_bytes (jpg, or one of the base64 columns) and image_ref (the first path); rows with neither go."""
    parts = []
    if "jpg" in df.columns:
        kind = df.schema["jpg"].dataType.typeName()
        parts.append(F.col("jpg") if kind == "binary" else F.col("jpg")["bytes"] if kind == "struct" else F.unhex(F.array_join(F.transform("jpg", lambda b: F.lpad(F.hex(b.cast("int")), 2, "0")), "")))
    parts += [decode_base64(F.col(c)) for c in ("image_base64", "image_b64", "base64") if c in df.columns]
    paths = [F.nullif(clean_text(F.col(c)), F.lit("")) for c in ("image_path", "path", "file_path", "image_url") if c in df.columns]
    out = df.withColumn("image_bytes", F.coalesce(*parts) if parts else F.lit(None).cast("binary")).withColumn("image_ref", F.coalesce(*paths) if paths else F.lit(None).cast("string"))
    return out.where("image_bytes is not null or image_ref is not null")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def image_id(given: Column, path: Column, file: Column, row: Column) -> Column:
    """S3."""
    return F.coalesce(F.nullif(clean_text(given), F.lit("")), F.nullif(stem(path), F.lit("")), F.concat(stem(file), F.lit("_"), row.cast("string")))


def auto_files(n: int) -> int:
    """How many of n files (at most 50) a trial reads."""
    return min(3, max(1, n // 20 + 1))


def sample_files(spark: SparkSession, folder: str, k: int, seed: int = 0) -> DataFrame:
    """K files in seeded order; the others are never opened."""
    files = _files(spark, f"{folder}/*.parquet")
    chosen = spark.createDataFrame([(f, f.rsplit("/", 1)[-1]) for f in files], "path string, name string").orderBy(u(seed, "name"), "name").limit(k)
    return spark.read.parquet(*[r.path for r in chosen.collect()])


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, a JSON array (in splits), or {"data": [...]}, told apart by the file's head; blank lines don't count.

    A head that is a whole object with a list under "data" is the third form, any other whole object is JSON lines.
    """
    wrapped = f"data array<struct<{_fields(schema)}>>"
    piece = spark.read.option("lineSep", "}").text(path).where(F.trim("value") != "").limit(1).collect()  # a line may be the whole file
    if piece and piece[0].value.lstrip("\ufeff \t\r\n").startswith("[") and not path.endswith(".jsonl"):
        return read_array(spark, path, schema)
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    first = head[0].value.strip() if head else "{}"
    try:
        form = json.loads(first)
    except ValueError:
        form = None
    lines = isinstance(form, dict)
    if path.endswith(".jsonl") or (lines and not isinstance(form.get("data"), list)):
        return spark.read.schema(schema).json(path)
    return spark.read.schema(wrapped).option("multiLine", not lines).json(path).select(F.explode("data").alias("d")).select("d.*")


def _fields(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A list of results, or a dict with ``results``."""
    plain = spark.read.schema(RESULT).option("multiLine", True).json(path)
    wrapped = spark.read.schema(f"results array<struct<{_fields(RESULT)}>>").option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")
    return wrapped.unionByName(plain.where("image_id is not null"))


#: Tasks of Spark that look up files given by name: one for each file, up to this setting.
LISTING, MOST_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 64


def _rank_pattern(spark: SparkSession, root: str) -> str:
    pattern = f"{root}/rank*/failures/*.json"
    return pattern if _files(spark, pattern) else f"{root}/failures/*.json"


def _parsed_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """paths: files, or a pattern whose last part is one of names: folders are listed then, as Spark lists each file by itself."""
    reader = spark.read.schema(RESULT + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE")
    if isinstance(paths, str):
        folders, _, names = paths.rpartition("/")
        rows = reader.option("pathGlobFilter", names).json(folders)
    else:
        before = spark.conf.get(LISTING)
        spark.conf.set(LISTING, str(min(int(before), MOST_LISTERS)))
        try:
            rows = reader.json(paths)
        finally:
            spark.conf.set(LISTING, before)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def read_rank_results(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Results of all rank folders (else of the root's failures), and the files that can't be read."""
    rows = materialize(_parsed_results(spark, _rank_pattern(spark, root)), "results")  # parsed once for both parts
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select("file")


SCANNED = "file string, size long, modified timestamp, bad boolean, scan long"


def scan_rank_results(spark: SparkSession, root: str, store: str) -> tuple[DataFrame, DataFrame]:
    """As read_rank_results, but a file is opened once: ``store`` keeps what was read, and of which files.

    A ledger has file, size, time and outcome of each scan; files that it has as they are now aren't opened again. Rows of a
    scan are written before its part of the ledger, so a scan that breaks off is done anew. Files that have gone, or that
    have changed, count as they are now. Names of files pass through the driver, as they do in Spark's own listing.
    """
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "file:///")
    for part, kind in (("files", SCANNED), ("rows", f"{RESULT}, file string, scan long")):
        spark.createDataFrame([], kind).write.mode("append").parquet(f"{store}/{part}/scan=-1")
    ledger = spark.read.schema(SCANNED).parquet(f"{store}/files/scan=*")
    pattern = _rank_pattern(spark, root)
    if not _files(spark, pattern):
        return spark.createDataFrame([], f"{RESULT}, file string"), spark.createDataFrame([], "file string")
    folders, _, names = pattern.rpartition("/")
    now = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folders).select(plain(F.col("path")).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))  # contents aren't read
    now = materialize(now, "listing")
    fresh = materialize(now.join(ledger.select("file", "size", "modified"), ["file", "size", "modified"], "left_anti"), "fresh")
    number = (ledger.agg(F.max("scan")).first()[0] or 0) + 1
    paths = [r.file for r in fresh.select("file").collect()]
    if paths:
        rows = materialize(_parsed_results(spark, pattern if len(paths) == now.count() else paths).withColumn("file", plain(F.col("file"))).withColumn("scan", F.lit(number).cast("long")), "results")
        rows.where("_corrupt_record is null").drop("_corrupt_record").write.mode("overwrite").parquet(f"{store}/rows/scan={number}")
        bad = rows.groupBy("file").agg(F.bool_or(F.col("_corrupt_record").isNotNull()).alias("bad"))
        entry = fresh.join(bad, "file", "left").select("file", "size", "modified", F.coalesce("bad", F.lit(False)).alias("bad"), F.lit(number).cast("long").alias("scan"))
        entry.write.mode("overwrite").parquet(f"{store}/files/scan={number}")
        ledger = spark.read.schema(SCANNED).parquet(f"{store}/files/scan=*")
    last = now.join(ledger, ["file", "size", "modified"]).groupBy("file").agg(F.max_by("bad", "scan").alias("bad"), F.max("scan").alias("scan"))
    last = materialize(last, "ledger")
    rows = spark.read.schema(f"{RESULT}, file string, scan long").parquet(f"{store}/rows/scan=*")
    return rows.join(last.select("file", "scan"), ["file", "scan"]).drop("scan"), last.where("bad").select("file")


def with_sidecar(results: DataFrame, root: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """Results with an image of the same stem (``_result`` removed), by preference of the extension."""
    spark = results.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name = F.regexp_extract("path", r"([^/]+)\.([^./]+)$", 1)
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    images = files.select(name.alias("stem"), "path", rank.alias("rank")).where("rank > 0").groupBy("stem").agg(F.min_by("path", "rank").alias("image_file"))
    return results.withColumn("stem", F.regexp_replace(stem(F.col("file")), "_result$", "")).join(images, "stem")


def read_qa_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Successful rows' files, else all; the group is a row's own name, else its file's without the last part."""
    files = _files(spark, f"{folder}/vqa_dataset_successful_*.json") or [f for f in _files(spark, f"{folder}/*.json") if not f.rsplit("/", 1)[-1].startswith("all_")]
    rows = spark.read.schema(schema).option("multiLine", True).json(files)
    name = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""), "_[^_]*$", "")
    return rows.withColumn("pipeline_name", F.coalesce("pipeline_name", name))


def read_manifest(spark: SparkSession, manifest: str, schema: str) -> DataFrame:
    """The files that a manifest lists, relative to it; files that are missing are left out."""
    folder = manifest.rsplit("/", 1)[0]
    listed = json.loads(_small_text(spark, manifest))["files"]
    there = [f"{folder}/{f}" for f in listed if _files(spark, f"{folder}/{f}")]
    return spark.read.schema(schema).option("multiLine", True).json(there)


def read_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation files with the image that they name, wherever it is, else the one of the same name beside them.

    A file is an object with ``conversations``, or the list of turns itself. A relative name is looked for in the folder.
    A row whose image isn't there has no content, and ``error`` says so; nothing else of it is lost.
    """
    turn = "struct<from:string,value:string>"
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("file"))
    bare = F.ltrim("value").startswith("[")
    found = F.from_json("value", f"image_url string, conversations array<{turn}>")
    rows = files.withColumn("r", found).select("file", "r.image_url", F.when(bare, F.from_json("value", f"array<{turn}>")).otherwise(F.col("r.conversations")).alias("conversations"))
    named = F.nullif(F.trim("image_url"), F.lit(""))
    there = F.when(named.rlike("^([a-z0-9]+:)?/"), named).otherwise(F.concat(F.regexp_replace("file", "[^/]*$", ""), named))
    rows = rows.withColumn("image_file", F.coalesce(there, F.regexp_replace("file", r"\.json$", ".jpg")))
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    wanted = rows.select(F.regexp_replace("image_file", "[^/]*$", "").alias("f")).distinct().limit(MOST_FOLDERS + 1).collect()
    if len(wanted) > MOST_FOLDERS:
        raise ValueError(f"images lie in more than {MOST_FOLDERS} folders")
    folders = [f for f in sorted({folder.rstrip("/") + "/", *(r.f for r in wanted)}) if _files(spark, f)]
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,webp,bmp,gif,JPG,JPEG,PNG}").load(folders).select("path", "content").dropDuplicates(["path"])
    joined = rows.join(images, plain(F.col("image_file")) == plain(F.col("path")), "left").drop("path")
    return joined.withColumn("error", F.when(F.col("content").isNull(), F.concat(F.lit("no image "), "image_file")))


def folder_to_table(spark: SparkSession, folder: str, path: str, extensions: str = "{jpg,jpeg,png,webp}") -> None:
    """An image folder as a parquet table of image_id and jpg."""
    spark.read.format("binaryFile").load(f"{folder}/*.{extensions}").select(stem(F.col("path")).alias("image_id"), F.col("content").alias("jpg")).write.parquet(path)


#: Lists of a claim configuration, and their rank: the first rank that has claims is read.
CLAIM_LISTS = {"claim_schemas": 0, "global_templates": 1, "templates": 2, "global_claims": 3, "claims": 3}


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """The first list of a claim configuration that is not empty.

    A configuration may be a folder of files, each read by one task; together they are one, in order of their names.
    """
    rows = spark.read.schema(", ".join(f"{n} array<variant>" for n in CLAIM_LISTS)).option("multiLine", True).option("mode", "FAILFAST").json(path)
    lists = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(at).alias("at"), F.col(n).alias("list")) for at, (n, rank) in enumerate(CLAIM_LISTS.items())])
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.explode(lists).alias("x")).select("file", "x.*").where(F.size("list") > 0)
    heads = rows.select("file", "rank", "at", F.size("list").alias("n"))  # a few rows for each file
    heads = heads.join(F.broadcast(heads.agg(F.min("rank").alias("rank"))), "rank")
    begins = heads.select("file", "at", (F.sum("n").over(Window.orderBy("file", "at")) - F.col("n")).alias("begin"))
    rows = rows.join(begins, ["file", "at"]).select("begin", F.posexplode("list").alias("k", "v"))
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    bare = F.when(~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), F.try_variant_get("v", "$", "string"))
    template = F.coalesce(*[F.nullif(text(n), F.lit("")) for n in ("claim_template", "template", "claim_text")], text("text"), bare)
    return rows.select(text("claim_id").alias("claim_id"), text("name").alias("name"), template.alias("claim_template"), text("content_type").alias("content_type"), (F.col("begin") + F.col("k")).cast("int").alias("pos"))


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure reasons in order of the file."""
    fields = "failure_id string, failure_category string, failure_name string, description string, suggested_filtering_factors array<string>"
    rows = spark.read.schema(f"failure_reasons array<struct<{_fields(fields)}>>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("failure_reasons").alias("pos", "r")).select("r.*", "pos")


def read_pipelines(spark: SparkSession, path: str) -> DataFrame:
    """The pipeline map; keys failure_id or failure_key."""
    rows = spark.read.schema("pipelines array<struct<failure_id:string,failure_key:string,pipeline_type:string,pipeline_name:string>>").option("multiLine", True).json(path)
    return rows.select(F.explode("pipelines").alias("p")).select(F.coalesce("p.failure_id", "p.failure_key").alias("failure_id"), "p.pipeline_type", "p.pipeline_name")


def read_question_pipelines(spark: SparkSession, path: str) -> DataFrame:
    """Question pipelines by key."""
    fields = "name:string,intent:string,description:string,answer_type:string,required_slots:array<string>,optional_slots:array<string>,question_constraints:array<string>"
    rows = spark.read.schema(f"pipelines map<string,struct<{fields}>>").option("multiLine", True).json(path)
    return rows.select(F.explode("pipelines").alias("key", "p")).select("key", "p.*")


def read_triggers(spark: SparkSession, path: str) -> DataFrame:
    """Failure reason -> trigger types."""
    return spark.read.schema("triggers map<string,array<string>>").option("multiLine", True).json(path).select(F.explode("triggers").alias("failure_id", "t")).select("failure_id", F.explode("t").alias("trigger_type"))


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of factor texts, with positions. Several files, each read by one task, are one list in order of their names."""
    lists = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<string>").alias("l")).where("l is not null")
    begins = lists.select("file", F.size("l").alias("n")).select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("begin"))  # a row for each file
    return lists.join(begins, "file").select("begin", F.posexplode("l").alias("k", "text")).select((F.col("begin") + F.col("k")).cast("int").alias("pos"), "text")


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """Criteria of each question pipeline."""
    rows = spark.read.schema("pipelines map<string,struct<name:string,description:string,question:string,criteria:array<string>>>").option("multiLine", True).json(path)
    return rows.select(F.explode("pipelines").alias("key", "p")).select("key", "p.name", F.posexplode("p.criteria").alias("pos", "criterion"))


def collected_report(rows: DataFrame, bad: DataFrame, images: DataFrame) -> DataFrame:
    """Results and images that were collected, the rank folders seen, and the number of files that can't be read.

    rows and bad are those of read_rank_results; images: path.
    """
    rank = F.regexp_extract("file", r"rank_?(\d+)/", 1)
    found = rows.agg(F.count(F.lit(1)).alias("results"), F.array_sort(F.collect_set(F.nullif(rank, F.lit("")))).alias("ranks"))
    return found.crossJoin(bad.agg(F.count(F.lit(1)).alias("bad_files"))).crossJoin(images.agg(F.count(F.lit(1)).alias("images")))


def ordered_by_file(rows: DataFrame) -> DataFrame:
    """T5: files in order of their paths, rows in order within a file."""
    return rows.orderBy("_file", "_row")
