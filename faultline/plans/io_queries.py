"""Queries over scans and sinks: rows of the given tables are written in a form, and read back by the operator."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from faultline.operators import modelcall as L
from faultline.operators import sampling as G
from faultline.sources import files, sinks, tar
from faultline.sources import tables as S
from faultline.sources.shared import new_path
from faultline.streaming import intake

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def write_text(rows, column, path) -> str:
    """Texts as files of their partitions; returns the path."""
    rows.select(F.col(column).alias("value")).write.text(path)
    return path


def one_object(rows, spark, label) -> str:
    """A file with one JSON object, of a table of one row."""
    path = new_path(spark, label)
    rows.coalesce(1).write.json(path)
    return path


TAR_KEYS = "with p as (select * from part where p_partkey % 7 = 0), t as (select format('s{:08d}', p_partkey) \"key\", k || '_image' \"name\", strlen(p_name) + 1 size from p, range(3) r(k) where k <= p_partkey % 3 union all select format('s{:08d}', p_partkey), 'json', strlen('{\"p_partkey\":' || p_partkey || ',\"p_type\":\"' || p_type || '\"}') from p)"


# --- parquet tables


@query("select o_orderkey, row_number() over (order by o_orderkey) - 1 place from orders")
def t5_ordered_by_file(spark, sf):
    path = new_path(spark, "ordered")
    table(spark, sf, "orders").select("o_orderkey").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    rows = G.numbered(S.read_images(spark, path), ["_file", "_row"], "n")
    return rows.select("o_orderkey", (F.col("n") - 1).alias("place"))


@query("select 3 files, 3 buckets, true whole")
def s4_sample_files(spark, sf):
    """Three of the files of a table, whose number follows the rows, each with all rows of a bucket; whichever they are."""
    path, o = new_path(spark, "sampled"), table(spark, sf, "orders")
    n = max(8, o.count() // 20_000)
    o = o.select(F.pmod(F.xxhash64("o_orderkey"), F.lit(n)).alias("bucket"))
    o.withColumn("b", F.col("bucket")).repartition(n, "bucket").write.partitionBy("b").parquet(path)
    some = S.sample_files(spark, f"{path}/b=*", 3, seed=4).withColumn("file", F.input_file_name())
    found = some.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
    whole = found.join(o.groupBy("bucket").agg(F.count(F.lit(1)).alias("all")), "bucket")
    return whole.agg(F.sum("files").cast("int").alias("files"), F.count(F.lit(1)).cast("int").alias("buckets"), F.bool_and(F.col("n") == F.col("all")).alias("whole"))


# --- JSON files


@query("select f.form, p_partkey, p_name from part, (values ('lines'), ('array'), ('data')) f(form)")
def s8_s16_s17_read_records(spark, sf):
    p, path = table(spark, sf, "part").select("p_partkey", "p_name"), new_path(spark, "records")
    kind = "p_partkey long, p_name string"
    write_text(p.select(F.concat(F.to_json(F.struct("*")), F.when(F.col("p_partkey") % 3 == 0, "\n\n").otherwise("")).alias("x")), "x", f"{path}.jsonl")  # with blank lines
    parts = p.groupBy(F.pmod(F.hash("p_partkey"), F.greatest(F.lit(4), F.lit(p.count() // 1000))).alias("file")).agg(F.collect_list(F.struct("p_partkey", "p_name")).alias("data"))
    write_text(parts.repartition("file").withColumn("x", F.to_json("data")).coalesce(4).mapInPandas(one_array, "x string"), "x", f"{path}-array")
    parts.select("data").write.json(f"{path}-data")
    forms = {"lines": f"{path}.jsonl", "array": f"{path}-array", "data": f"{path}-data"}
    out = [S.read_records(spark, at, kind).withColumn("form", F.lit(form)) for form, at in forms.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def one_array(frames):
    """The arrays of a partition as the text of one array, in pieces of a few lines."""
    import pandas as pd

    begun = False
    for f in frames:
        for x in f["x"]:
            yield pd.DataFrame({"x": [("," if begun else "[") + x[1:-1]]})
            begun = True
    if begun:
        yield pd.DataFrame({"x": ["]"]})


@query("select 'img_' || c_custkey image_id, c_nationkey total_claims, case when c_custkey % 4 = 0 then c_mktsegment end reason from customer")
def s9_read_results(spark, sf):
    """Half of the results in lists, half in objects with ``results``; the number of files follows the rows."""
    c, path = table(spark, sf, "customer"), new_path(spark, "probing")
    breakdown = F.when(F.col("c_custkey") % 4 == 0, F.create_map("c_mktsegment", F.lit(1).cast("long")))
    r = c.select(F.concat(F.lit("img_"), F.col("c_custkey").cast("string")).alias("image_id"), F.col("c_nationkey").cast("long").alias("total_claims"), breakdown.alias("failure_breakdown"), (F.col("c_custkey") % 2).alias("half"), F.pmod(F.hash("c_custkey"), F.lit(max(40, c.count() // 500))).alias("file"))
    lists = r.groupBy("half", "file").agg(F.collect_list(F.struct("image_id", "total_claims", "failure_breakdown")).alias("results"))
    named = lists.select(F.concat_ws("", F.lit("r"), "half", F.lit("_"), "file", F.lit(".json")).alias("name"), F.encode(F.when(F.col("half") == 0, F.to_json("results")).otherwise(F.to_json(F.struct("results"))), "UTF-8").alias("data"))
    files.write_files(named, path)
    return S.read_results(spark, path).select("image_id", "total_claims", F.map_keys("failure_breakdown")[0].alias("reason"))


def rank_files(spark, sf):
    """A file for each supplier in the folders of four ranks, one in five broken, and an image beside one in two."""
    path = new_path(spark, "ranks")
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    where = F.concat(F.lit("rank_"), (k % 4).cast("string"), F.lit("/failures/"), F.lit("s"), k.cast("string"))
    good = F.to_json(F.struct(F.concat(F.lit("s"), k.cast("string")).alias("image_id"), F.col("s_nationkey").cast("long").alias("total_claims")))
    body = F.when(k % 5 == 0, F.lit('{"image_id": "broken')).otherwise(good)
    files.write_files(s.select(F.concat(where, F.lit("_result.json")).alias("name"), F.encode(body, "UTF-8").alias("data")), path)
    for kind, every in (("jpg", 2), ("png", 3)):
        files.write_files(s.where(k % every == 0).select(F.concat(where, F.lit(f".{kind}")).alias("name"), F.encode("s_name", "UTF-8").alias("data")), path)
    return path


@query("select 's' || s_suppkey image_id, s_nationkey total_claims, 0 bad from supplier where s_suppkey % 5 > 0 union all select null, null, count(*) from supplier where s_suppkey % 5 = 0")
def s10_s12_u1_read_rank_results(spark, sf):
    rows, bad = S.read_rank_results(spark, rank_files(spark, sf))
    lost = bad.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(None).cast("string").alias("image_id"), F.lit(None).cast("long").alias("total_claims"), "bad")
    return rows.select("image_id", "total_claims", F.lit(0).cast("long").alias("bad")).unionByName(lost)


@query("select 's' || s_suppkey image_id, s_nationkey + case when s_suppkey % 10 = 1 then 100 else 0 end total_claims from supplier where s_suppkey % 5 > 0 or s_suppkey % 2 = 0")
def s10_s12_scan_ledger(spark, sf):
    """Scanned twice: in between every tenth file is written anew, and half of the broken ones are mended."""
    path, store = rank_files(spark, sf), new_path(spark, "scans")
    S.scan_rank_results(spark, path, store)
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    where = F.concat(F.lit("rank_"), (k % 4).cast("string"), F.lit("/failures/"), F.lit("s"), k.cast("string"), F.lit("_result.json"))
    body = F.to_json(F.struct(F.concat(F.lit("s"), k.cast("string")).alias("image_id"), (F.col("s_nationkey") + F.when(k % 10 == 1, 100).otherwise(0)).cast("long").alias("total_claims")))
    again = s.where((k % 10 == 1) | ((k % 5 == 0) & (k % 2 == 0)))
    files.write_files(again.select(where.alias("name"), F.encode(F.concat(body, F.lit("   ")), "UTF-8").alias("data")), path)
    rows, bad = S.scan_rank_results(spark, path, store)
    return rows.select("image_id", "total_claims")


@query(f"{TAR_KEYS} select * from t")
def s19_tar_keys(spark, sf):
    """Every seventh sample by its key, from shards that lost their index and got another."""
    path = shards(spark, sf)
    for x in files.listed(tar.beside(path), ".tar")[::2]:
        store, at = files.store_of(tar.beside(path))
        store.delete_file(f"{at}/{x}")
    tar.index_shards(spark, path)
    keys = table(spark, sf, "part").where("p_partkey % 7 = 0").select(F.format_string("s%08d", "p_partkey").alias("key"))
    split = spark.read.format("tar_samples").option("path", path).option("splitsize", "100000").load()
    return split.join(keys, "key", "left_semi").select("key", "name", F.octet_length("data").cast("long").alias("size"))


@query("select 's' || s_suppkey image_id, case when s_suppkey % 2 = 0 then 'jpg' else 'png' end kind from supplier where s_suppkey % 5 > 0 and (s_suppkey % 2 = 0 or s_suppkey % 3 = 0)")
def s11_j10_sidecar_images(spark, sf):
    path = rank_files(spark, sf)
    return S.with_sidecar(S.read_rank_results(spark, path)[0], path).select("image_id", F.element_at(F.split("image_file", r"\."), -1).alias("kind"))


@query("select count(*) filter (where s_suppkey % 5 > 0) results, (select string_agg(k, ',' order by k) from (select distinct (s_suppkey % 4)::varchar k from supplier where s_suppkey % 5 > 0)) ranks, count(*) filter (where s_suppkey % 5 = 0) bad_files, count(*) filter (where s_suppkey % 2 = 0) + count(*) filter (where s_suppkey % 3 = 0) images from supplier")
def a23_collected_report(spark, sf):
    path = rank_files(spark, sf)
    rows, bad = S.read_rank_results(spark, path)
    images = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,png}").load(path).select("path")
    return S.collected_report(rows, bad, images).withColumn("ranks", F.array_join("ranks", ","))


def question_files(spark, sf, start, every):
    """Rows of part in files <start><brand>_<number>.json, whose number follows the rows; every so-manieth row without a group of its own."""
    path, p = new_path(spark, "questions"), table(spark, sf, "part")
    n = 2 * max(1, p.count() // 20_000)  # files of a brand
    p = p.select(F.col("p_partkey").alias("id"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("brand"), (F.col("p_partkey") % n).cast("string").alias("part"))
    name = F.when(F.col("id") % every > 0, F.concat(F.lit("own "), F.col("brand")))
    rows = p.groupBy("brand", "part").agg(F.collect_list(F.struct("id", name.alias("pipeline_name"))).alias("rows"))
    named = rows.select(F.concat(F.lit(start), "brand", F.lit("_"), "part", F.lit(".json")).alias("name"), F.encode(F.to_json("rows"), "UTF-8").alias("data"))
    files.write_files(named, path)
    files.write_files(named.select(F.concat(F.lit("all_"), "name").alias("name"), "data"), path)  # these are not read
    return path


@query("select g pipeline_name, count(*) n, sum(id)::bigint ids from (select p_partkey id, case when p_partkey % 3 > 0 then 'own ' else '' end || lower(replace(p_brand, '#', '')) g from part) group by 1")
def s14_u7_read_pipeline_files(spark, sf):
    """The rows of one group meet, from whichever files they come."""
    rows = S.read_qa_files(spark, question_files(spark, sf, "", 3), "id long, pipeline_name string")
    return rows.groupBy("pipeline_name").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("select p_partkey id, case when p_partkey % 2 > 0 then 'own ' else 'vqa_dataset_successful_' end || lower(replace(p_brand, '#', '')) pipeline_name from part")
def s13_read_successful_files(spark, sf):
    path = question_files(spark, sf, "vqa_dataset_successful_", 2)
    files.write_files(spark.range(3).select(F.concat(F.lit("other_"), "id", F.lit(".json")).alias("name"), F.encode(F.lit('[{"id": 0}]'), "UTF-8").alias("data")), path)
    return S.read_qa_files(spark, path, "id long, pipeline_name string")


@query("select p_partkey id from part where p_partkey % 2 = 0")
def s15_read_manifest(spark, sf):
    """The manifest lists the files of even parts, and one that is gone."""
    path = question_files(spark, sf, "", 1)
    listed = [x for x in files.listed(path, ".json") if not x.startswith("all_") and int(x[:-5].rsplit("_", 1)[1]) % 2 == 0]
    body = json.dumps({"files": [*listed, "gone.json"]})
    files.write_files(spark.createDataFrame([("meta.json", body.encode())], "name string, data binary"), path)
    return S.read_manifest(spark, f"{path}/meta.json", "id long")


# --- media


def media_folder(spark, sf):
    """An image and a conversation for each supplier; odd ones also as jpg. Every fourth names another's jpg by its path,
    every twelfth a png by its name alone; every tenth is the list of turns itself."""
    path = new_path(spark, "media")
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    url = F.when(k % 12 == 0, F.concat(F.format_string("image_%06d", k), F.lit(".png"))).when(k % 4 == 0, F.concat(F.lit(f"{path}/"), F.format_string("image_%06d", k + 1), F.lit(".jpg")))
    turns = F.array(F.struct(F.lit("human").alias("from"), F.col("s_name").alias("value")))
    talk = F.when(k % 10 == 0, F.to_json(turns)).otherwise(F.to_json(F.struct(url.alias("image_url"), turns.alias("conversations"))))
    rows = s.select(k.alias("idx"), F.encode("s_name", "UTF-8").alias("image_bytes"), talk.alias("conversation"))
    sinks.export_media(rows.withColumn("format", F.lit("png")), path)
    sinks.export_media(rows.where("idx % 2 = 1").withColumn("format", F.lit("jpg")), path)
    return path


@query("select format('image_{:06d}', s_suppkey) || e.ending \"name\", case when e.ending = '.json' then null else strlen(s_name) end size from supplier, (values ('.png'), ('.jpg'), ('.json')) e(ending) where e.ending <> '.jpg' or s_suppkey % 2 = 1")
def k9_export_media(spark, sf):
    found = spark.read.format("binaryFile").load(media_folder(spark, sf))
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.when(~F.col("path").endswith(".json"), F.octet_length("content")).cast("long").alias("size"))


@query("select s.s_name said, strlen(o.s_name) size, o.s_name is null missing from supplier s left join supplier o on o.s_suppkey = case when s.s_suppkey % 2 = 1 then s.s_suppkey when s.s_suppkey % 10 = 0 then null when s.s_suppkey % 12 = 0 then s.s_suppkey when s.s_suppkey % 4 = 0 then s.s_suppkey + 1 end")
def s18_read_conversations(spark, sf):
    rows = S.read_conversations(spark, media_folder(spark, sf))
    return rows.select(F.col("conversations")[0]["value"].alias("said"), F.octet_length("content").cast("long").alias("size"), F.col("error").isNotNull().alias("missing"))


@query("select format('image_{:06d}', s_suppkey) image_id, count(*) n, max(strlen(s_name)) size from supplier, (values (1), (2)) e(k) where k = 1 or s_suppkey % 2 = 1 group by 1")
def s20_folder_to_table(spark, sf):
    path = new_path(spark, "table")
    S.folder_to_table(spark, media_folder(spark, sf), path)
    return S.read_images(spark, path).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("jpg")).cast("long").alias("size"))


def shards(spark, sf):
    tar.register(spark)
    path = new_path(spark, "shards")
    p = table(spark, sf, "part").select(F.format_string("s%08d", "p_partkey").alias("key"), F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int")), lambda i: F.encode(F.concat("p_name", i.cast("string")), "UTF-8")).alias("media"), F.to_json(F.struct("p_partkey", "p_type")).alias("json"))
    sinks.tar_shards(p, path, 100)
    return path


TAR = "with t as (select format('s{:08d}', p_partkey) \"key\", k || '_image' \"name\", strlen(p_name) + 1 size from part, range(3) r(k) where k <= p_partkey % 3 union all select format('s{:08d}', p_partkey), 'json', strlen('{\"p_partkey\":' || p_partkey || ',\"p_type\":\"' || p_type || '\"}') from part)"


@query(f"{TAR} select * from t")
def s19_k10_tar_shards(spark, sf):
    return spark.read.format("tar_samples").option("path", shards(spark, sf)).load().select("key", "name", "size")


@query(f"{TAR} select * from t")
def k17_tar_report(spark, sf):
    """A report of all samples of each shard."""
    path, out = shards(spark, sf), new_path(spark, "report")
    sinks.tar_report(spark, path, out, n=100)
    return spark.read.text(out).select(F.from_json("value", "key string, name string, size long").alias("r")).select("r.*")


# --- configurations


# Configurations are small by nature: they are made of the nations, and what is read meets all customers.


def configured(spark, sf, config, key="failure_id"):
    """Customers with what a configuration has for their nation, by the key ``f<nation>``."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias(key))
    return c.join(F.broadcast(config), key)  # read_* refuse or parse small files only


def nations(spark, sf):
    n = table(spark, sf, "nation")
    return n.withColumn("f", F.concat(F.lit("f"), F.col("n_nationkey").cast("string")))


NATION = "from customer join nation on n_nationkey = c_nationkey"


def in_files(rows, value, name):
    """Rows of supplier, in order of the key, as lists of a thousand ``value`` in files <name>_<number>.json: number, l."""
    placed = G.numbered(rows, ["s_suppkey"], "n").withColumn("file", F.floor((F.col("n") - 1) / 1000))
    lists = placed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", value.alias("v")))).alias("l"))
    return lists.select(F.format_string(f"{name}_%09d.json", "file").alias("name"), F.transform("l", lambda x: x["v"]).alias("l"))


def dealt(spark, sf, listed):
    """All of a list (pos), each with the customers that it falls to in turn."""
    n = table(spark, sf, "supplier").count()
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % F.lit(n)).alias("pos"))
    return listed.withColumn("pos", F.col("pos").cast("long")).join(c, "pos", "left")


DEALT = "left join customer on c_custkey % (select count(*) from supplier) = pos"


@query(f"with c as (select 'c_' || s_suppkey claim_id, s_name \"name\", 'Is [X] in ' || s_name || '?' claim_template, row_number() over (order by s_suppkey) - 1 pos from supplier) select c_custkey, claim_id, \"name\", claim_template, pos from c {DEALT}")
def s21_read_claims(spark, sf):
    """A claim for each supplier. The first list is empty, the second has all claims, the third is not reached."""
    path, s = new_path(spark, "claims"), table(spark, sf, "supplier")
    one = F.struct(F.concat(F.lit("c_"), F.col("s_suppkey").cast("string")).alias("claim_id"), F.col("s_name").alias("name"), F.concat(F.lit("Is [X] in "), "s_name", F.lit("?")).alias("claim_template"))
    config = F.struct(F.array().cast("array<string>").alias("claim_schemas"), F.col("l").alias("global_templates"), F.array(F.lit("not this")).alias("templates"))
    files.write_files(in_files(s, one, "claims").select("name", F.encode(F.to_json(config), "UTF-8").alias("data")), path)
    return dealt(spark, sf, S.read_claims(spark, path)).select("c_custkey", "claim_id", "name", "claim_template", "pos")


@query(f"select c_custkey, 'type ' || (n_nationkey % 3) pipeline_type, 'pipe ' || n_regionkey pipeline_name {NATION}")
def s23_read_pipelines(spark, sf):
    n, even = nations(spark, sf), F.col("n_nationkey") % 2 == 0
    one = F.struct(F.when(even, F.col("f")).alias("failure_id"), F.when(~even, F.col("f")).alias("failure_key"), F.concat(F.lit("type "), (F.col("n_nationkey") % 3).cast("string")).alias("pipeline_type"), F.concat(F.lit("pipe "), F.col("n_regionkey").cast("string")).alias("pipeline_name"))
    pipelines = S.read_pipelines(spark, one_object(n.agg(F.collect_list(one).alias("pipelines")), spark, "pipelines"))
    return configured(spark, sf, pipelines).select("c_custkey", "pipeline_type", "pipeline_name")


def keyed(spark, sf, value, label):
    """A file {"pipelines": {key: value}} over all nations."""
    rows = nations(spark, sf).agg(F.map_from_entries(F.collect_list(F.struct("f", value))).alias("pipelines"))
    return one_object(rows, spark, label)


@query(f"select c_custkey, 'about ' || n_regionkey \"name\", 'object,region' required, case when n_nationkey % 2 = 0 then 'style' else '' end optional {NATION}")
def s24_read_question_pipelines(spark, sf):
    optional = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("style")))
    value = F.struct(F.concat(F.lit("about "), F.col("n_regionkey").cast("string")).alias("name"), F.array(F.lit("object"), F.lit("region")).alias("required_slots"), optional.alias("optional_slots"))
    rows = configured(spark, sf, S.read_question_pipelines(spark, keyed(spark, sf, value, "question-pipelines")), "key")
    return rows.select("c_custkey", "name", F.array_join("required_slots", ",").alias("required"), F.coalesce(F.array_join("optional_slots", ","), F.lit("")).alias("optional"))


@query(f"select c_custkey, 'trigger ' || k trigger_type {NATION}, range(3) r(k) where k <= n_nationkey % 3")
def s25_read_triggers(spark, sf):
    types = F.transform(F.sequence(F.lit(0), (F.col("n_nationkey") % 3).cast("int")), lambda k: F.concat(F.lit("trigger "), k.cast("string")))
    rows = nations(spark, sf).agg(F.map_from_entries(F.collect_list(F.struct("f", types.alias("t")))).alias("triggers"))
    return configured(spark, sf, S.read_triggers(spark, one_object(rows, spark, "triggers"))).select("c_custkey", "trigger_type")


@query(f"with f as (select row_number() over (order by s_suppkey) - 1 pos, s_name \"text\" from supplier) select c_custkey, pos, \"text\" from f {DEALT}")
def s26_read_factors(spark, sf):
    path, rows = new_path(spark, "factors"), table(spark, sf, "supplier")
    files.write_files(in_files(rows, F.col("s_name"), "factors").select("name", F.encode(F.to_json("l"), "UTF-8").alias("data")), path)
    return dealt(spark, sf, S.read_factors(spark, path)).select("c_custkey", "pos", "text")


@query(f"select c_custkey, k pos, case k when 0 then 'seen' else '[optional] ' || n_regionkey end criterion {NATION}, range(2) r(k) where k <= n_nationkey % 2")
def s27_read_criteria(spark, sf):
    extra = F.array(F.concat(F.lit("[optional] "), F.col("n_regionkey").cast("string")))
    criteria = F.concat(F.array(F.lit("seen")), F.when(F.col("n_nationkey") % 2 == 1, extra).otherwise(F.array().cast("array<string>")))
    rows = configured(spark, sf, S.read_criteria(spark, keyed(spark, sf, F.struct(F.lit("n").alias("name"), criteria.alias("criteria")), "criteria")), "key")
    return rows.select("c_custkey", F.col("pos").cast("long").alias("pos"), "criterion")


@query("select o_orderpriority \"name\", count(*) ratio from orders group by 1")
def r3_parse_ratios(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    text = counts.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "o_orderpriority", "n"))), ", ")).first()[0]  # a short text by its nature
    return spark.createDataFrame([(k, int(v)) for k, v in G.parse_ratios(text).items()], "name string, ratio long")


# --- sinks


@query("select o_orderkey, o_orderstatus status, (select count(*) from orders) total from orders")
def k1_results_and_summary(spark, sf):
    o, path = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), new_path(spark, "results")
    sinks.results(o, o.agg(F.count(F.lit(1)).alias("total")), path)
    return spark.read.schema("o_orderkey long, status string").json(f"{path}/results").crossJoin(spark.read.schema("total long").json(f"{path}/summary"))  # one row


@query("select p_partkey, p_name, '{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}' info, '[\"' || p_type || '\",\"a, \\\"b\\\"\"]' tags from part")
def k2_csv(spark, sf):
    p, path = table(spark, sf, "part"), new_path(spark, "csv")
    sinks.csv(p.select("p_partkey", "p_name", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("info"), F.array("p_type", F.lit('a, "b"')).alias("tags")), path)
    return spark.read.schema("p_partkey long, p_name string, info string, tags string").option("header", True).option("escape", "\\").csv(path)


@query("select o_orderkey, o_orderpriority agents, o_custkey from orders")
def k3_k15_records(spark, sf):
    path = new_path(spark, "lines") + ".jsonl"
    sinks.records(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("agents"), "o_custkey"), path)
    return S.read_records(spark, path, "o_orderkey long, agents string, o_custkey long")


@query("select o_orderkey, o_orderpriority || '}\\\"{[' agents, o_custkey nested from orders")
def k3_s8_json_arrays(spark, sf):
    """Written as files that are arrays, whatever the texts hold, and read back in splits of some kilobytes."""
    path = new_path(spark, "arrays")
    o = table(spark, sf, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit('}\\"{[')).alias("agents"), F.struct(F.col("o_custkey").alias("a"), F.array("o_orderpriority")).alias("nested"))
    sinks.records(o, path, "array")
    return S.read_records(spark, path, "o_orderkey long, agents string, nested struct<a:long>").withColumn("nested", F.col("nested.a"))


@query("select o_orderstatus status, count(*) n, 'orders' source from orders group by 1")
def k6_manifest(spark, sf):
    path = new_path(spark, "manifest")
    sinks.manifest(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")), {"source": "orders"}, path)
    rows = spark.read.schema("counts map<string,long>, options map<string,string>").json(path)
    return rows.select(F.explode("counts").alias("status", "n"), F.col("options")["source"].alias("source"))


@query("select o_orderkey, o_orderstatus from orders")
def k14_intermediate(spark, sf):
    return sinks.intermediate(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), new_path(spark, "batches"))


@query("select case o_orderkey % 3 when 0 then 'question_debug' when 1 then 'slot_fallback' else 'accepted' end status, o_orderkey id, case when o_orderkey % 3 < 2 then o_orderpriority end detail from orders")
def k16_debug_records(spark, sf):
    path, m = new_path(spark, "status"), F.col("o_orderkey") % 3
    rows = table(spark, sf, "orders").select(F.when(m == 0, "question_debug").when(m == 1, "slot_fallback").otherwise("accepted").alias("status"), F.col("o_orderkey").alias("id"), F.struct(F.when(m < 2, F.col("o_orderpriority")).alias("detail")).alias("payload"))
    sinks.by_status(rows, path)
    return spark.read.schema("id long, payload struct<detail:string>, status string").json(path).select("status", "id", "payload.detail")


# --- streams


def order_files(spark, sf, n=6):
    path = new_path(spark, "stream")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey").write.json(path)
    return path


@query("select o_orderkey, o_custkey from orders")
def x4_micro_batches(spark, sf):
    """JSON lines, two files a batch; each batch is written under its number."""
    out = new_path(spark, "out")

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = intake.read_files(spark, order_files(spark, sf), "o_orderkey long, o_custkey long", 2, "json")
    intake.run(stream, sink, new_path(spark, "state"))
    return spark.read.schema("o_orderkey long, o_custkey long").parquet(f"{out}/batch=*")


@query("select o_orderkey, o_custkey % 7 = 0 failed from orders")
def x5_side_outputs(spark, sf):
    out = new_path(spark, "sides")
    stream = intake.read_files(spark, order_files(spark, sf), "o_orderkey long, o_custkey long", 2, "json")
    intake.run(stream, intake.write_both(out, F.col("o_custkey") % 7 == 0), new_path(spark, "state"))
    kind = "o_orderkey long, failed boolean"
    return spark.read.schema(kind).parquet(f"{out}/failures/batch=*").unionByName(spark.read.schema(kind).parquet(f"{out}/rest/batch=*"))


@query("select count(*) \"rows\", 3 batches from orders")
def x6_progress(spark, sf):
    import time

    seen, out = intake.Progress(), new_path(spark, "progress")
    spark.streams.addListener(seen)
    try:
        stream = intake.read_files(spark, order_files(spark, sf, 6), "o_orderkey long, o_custkey long", 2, "json")
        intake.run(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), new_path(spark, "state"))
        for _ in range(100):  # events come a little later
            if sum(seen.batches.values()) >= 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    return spark.createDataFrame([(sum(seen.rows.values()), sum(seen.batches.values()))], "rows long, batches int")


@query("select count(*) \"rows\", count(*) filter (where o_custkey % 7 = 0) hits, count(*) filter (where o_custkey % 7 = 0) found from orders")
def x3_collect_stream(spark, sf):
    """Half of the failures in a first run, the others in a second one that goes on; each once."""
    out, state, source = new_path(spark, "collected"), new_path(spark, "state"), order_files(spark, sf)
    total = table(spark, sf, "orders").where("o_custkey % 7 = 0").count()
    for target in (max(1, total // 2), total + 1):
        stream = intake.read_files(spark, source, "o_orderkey long, o_custkey long", 1, "json")
        found = intake.collect_until(stream, F.col("o_custkey") % 7 == 0, out, state, target, most_empty=99)
    hits = spark.read.schema("o_orderkey long, o_custkey long").parquet(f"{out}/batch=*").agg(F.count_distinct("o_orderkey").alias("hits"))
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("rows")).crossJoin(hits).withColumn("found", F.lit(found).cast("long"))  # one row each


# --- embeddings


_BYTE = "((instr('0123456789abcdef', substr(md5(w), {0}, 1)) - 1) * 16 + instr('0123456789abcdef', substr(md5(w), {0} + 1, 1)) - 1)"


@query(f"""with w as (select p_partkey id, unnest(string_split(lower(p_name), ' ')) w from part), k as (select id, {_BYTE.format(1)} % 64 k, case when {_BYTE.format(15)} >= 128 then 1.0 else -1.0 end s from w where w <> ''),
  v as (select id, k, sum(s) x from k group by id, k), n as (select id, sqrt(sum(x * x)) n from v group by id)
  select p.id, p.k, round(coalesce(case when n > 0 then x / n else x end, 0), 6) x from (select p_partkey id, unnest(range(64)) k from part) p left join v on v.id = p.id and v.k = p.k left join n on n.id = p.id""")
def m14_embed(spark, sf):
    """Every value of every vector."""
    texts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    v = L.embed(texts, L.hashed_encoder())
    return v.select("id", F.posexplode("v").alias("k", "x")).select("id", F.col("k").cast("long").alias("k"), F.round(F.col("x") + F.lit(0.0), 6).alias("x"))
