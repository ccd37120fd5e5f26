import json
import os
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.operators import conversation as V
from faultline.operators import factors as O
from faultline.operators import failures as X
from faultline.operators import modelcall as L
from faultline.operators import profile as P
from faultline.operators import qa as Q
from faultline.operators import sampling as S
from faultline.sources import json_arrays, sinks, tables, tar
from faultline.streaming import intake


def one(spark, column, *args):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [('{"answer": "A"}', "A"), ('so {"answer": " b"} end', "b"), ("Answer: 'C'\nx", "C"), ("\n first line\nmore", "first line"), ("```json\n{\"answer\": \"D\"}\n```", "D"), ("", None)],
)
def test_parse_answer(spark, text, want):
    assert one(spark, T.parse_answer(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [('["a","b"]', ["a", "b"]), ("Option 1: x\nOption 2: y", ["x", "y"]), ("A: x\nB. y", ["x", "y"]), ("1. x\n2. y", ["x", "y"]), ("x\n\n y ", ["x", "y"])])
def test_parse_options(spark, text, want):
    assert one(spark, T.parse_options(F.lit(text))) == want


@pytest.mark.parametrize(
    "answerable, related, want",
    [(False, False, (False, True, False)), (False, True, (None, None, True)), (True, False, (False, False, False)), (True, True, (True, None, False))],
)
def test_decide_verification(spark, answerable, related, want):
    df = spark.createDataFrame([(answerable, related, None, None)], "answerable boolean, is_related boolean, judge_correct boolean, judge_reason string")
    assert tuple(X.decide_verification(df).select("is_correct", "not_related_judgment_correct", "skipped").first()) == want


@pytest.mark.parametrize(
    "row, want",
    [
        ((0.9, True, True, 0, False, False), "strict"), ((0.6, True, True, 0, False, False), "a"), ((0.8, False, True, 0, False, False), "b"),
        ((0.2, True, True, 0, True, False), "c"), ((0.8, True, False, 0, False, True), "d"), ((0.95, True, False, 1, False, False), "e"), ((0.1, False, False, 1, False, False), "reject"),
    ],
)
def test_decide(spark, row, want):
    df = spark.createDataFrame([row], "confidence double, is_correct boolean, is_valid boolean, n_issues int, confidence_unparsed boolean, validation_unparsed boolean")
    d = Q.decide(df).first()
    assert (d.rescue_reason or d.decision) == want


def test_quotas_sum_up(spark):
    counts = spark.createDataFrame([("a", 500), ("b", 30), ("c", 900)], "pipeline_name string, available long")
    found = {r.pipeline_name: r.quota for r in S.quotas(counts, {"a": 0.3, "b": 0.2, "c": 0.5}, 1000).collect()}
    assert sum(found.values()) == 1000 and found["c"] > found["a"] > found["b"]


def test_mix_fills_quotas_from_hot_keys(spark):
    hot = spark.range(3000).select(F.lit("a").alias("pipeline_name"), F.when(F.col("id") < 1000, 5).otherwise(F.col("id")).alias("key"), F.col("id").alias("row"))
    for seed in range(3):
        got = S.mix_groups(hot, {"a": 1.0}, 1500, "key", seed=seed)
        order = {r.row: (r.u, r.key) for r in hot.select("row", "key", S.u(seed, "key").alias("u")).collect()}
        rows = [r.row for r in got.collect()]
        assert len(set(rows)) == len(rows) == 1500 and sorted(order[r] for r in rows) == sorted(order.values())[:1500]


def test_ratios():
    assert S.parse_ratios("a:0.5, b:1") == {"a": 0.5, "b": 1.0}
    with pytest.raises(ValueError):
        S.parse_ratios("a:0")


def test_failure_frequency_follows_weights(spark):
    keys = [T.FAILURE_PRIORITY[0], T.FAILURE_PRIORITY[7]]
    images = spark.range(4000).select(F.concat(F.lit("i"), "id").alias("image_id"), F.create_map(F.lit(keys[0]), F.lit(1), F.lit(keys[1]), F.lit(1)).alias("failure_breakdown"), F.array().cast("array<string>").alias("failed_reasons"))
    n = S.sample_failure_keys(images, 1).where(F.col("failure_key") == keys[1]).count()
    assert abs(n / 4000 - 81 / 85) < 0.02


def test_numbering_is_gapless(spark):
    got = S.numbered(spark.range(1000).repartition(7), [F.desc("id")], "n").collect()
    assert all(r.n == 1000 - r.id for r in got)


def test_components_of_a_path(spark):
    ids = spark.range(300)
    edges = spark.range(299).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    assert O.components(ids, edges).where("component <> 0").count() == 0


def test_conversations_that_convert_pass_all_checks(spark):
    qa = spark.createDataFrame([(1, "q?", "q?", "a", None, {"A": "x", "B": "y"}, "aGk="), (2, " ", None, "a", None, None, "aGk=")], "id long, question string, full_question string, answer string, explanation string, options map<string,string>, image_base64 string")
    rows = {r.id: r for r in V.classify(V.qa_conversation(qa)).collect()}
    assert rows[1].reject_reason is None and rows[1].a == "A. x" and rows[2].reject_reason == "empty_question"


def test_model_call_live_then_replay(spark):
    asked = spark.createDataFrame([("k1", "one"), ("k2", "boom"), ("k3", "three")], "request_key string, prompt string")

    def caller(prompts):
        if "boom" in prompts:
            raise RuntimeError("connection reset")
        return [p.upper() for p in prompts]

    rows = {r.request_key: r for r in L.model_call(asked, caller, batch=1).collect()}
    assert rows["k1"].response == "ONE" and rows["k2"].error == "connection reset" and rows["k3"].response == "THREE"
    again = L.model_call(asked, None, spark.createDataFrame([("k1", "x", None, 1, 2)], L.RESPONSES))
    assert {r.request_key: r.tokens_used for r in again.collect()} == {"k1": 3, "k2": 0, "k3": 0}


def test_embedding_and_abstraction(spark):
    texts = spark.createDataFrame([(0, "red car", 0), (1, "car red", 1), (2, "green tree", 2)], "id long, text string, pos long")
    v = L.embed(texts, L.hashed_encoder())
    rows = O.abstract_factors(texts, v, 0.9).orderBy("first").collect()
    assert [r.texts for r in rows] == [["red car", "car red"], ["green tree"]] and [r.factor_id for r in rows] == ["factor_1", "factor_2"]


def test_tar_round_trip(spark, tmp_path):
    tar.register(spark)
    rows = spark.range(300).repartition(1).select(F.format_string("s%04d", "id").alias("key"), F.array(F.encode(F.col("id").cast("string"), "UTF-8")).alias("media"), F.concat(F.lit('{"id": '), "id", F.lit("}")).alias("json"))
    rows.write.format("tar_samples").option("path", str(tmp_path)).option("maxcount", "128").mode("append").save()
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == [f"subtaskdata-{k}.tar" for k in range(3)]
    back = spark.read.format("tar_samples").option("path", str(tmp_path)).load()
    assert back.where("name = 'json'").count() == 300
    rows.limit(5).write.format("tar_samples").option("path", str(tmp_path)).mode("append").save()
    assert spark.read.format("tar_samples").option("path", str(tmp_path)).load().where("name = 'json'").count() == 305
    broken = rows.withColumn("json", F.when(F.col("key") == "s0299", F.raise_error(F.lit("lost"))).otherwise(F.col("json")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("tar_samples").option("path", str(tmp_path)).mode("append").save()
    assert len(list(tmp_path.iterdir())) == 4
    rows.repartition(2).write.format("tar_samples").option("path", str(tmp_path)).option("maxcount", "128").mode("overwrite").save()
    assert len(list(tmp_path.glob("*.tar"))) in (3, 4) and spark.read.format("tar_samples").option("path", str(tmp_path)).load().where("name = 'json'").count() == 300
    back = spark.read.format("tar_samples").option("path", str(tmp_path)).load()
    assert {r.key: bytes(r.data) for r in back.where("name = '0_image'").collect()} == {f"s{i:04d}": str(i).encode() for i in range(300)}


def test_rank_folders(spark, tmp_path):
    f = tmp_path / "rank_0" / "failures"
    f.mkdir(parents=True)
    (f / "x_result.json").write_text(json.dumps({"image_id": "x", "total_claims": 3, "failed_claims": 1, "failure_breakdown": {"a": 1}}))
    (f / "y_result.json").write_text(json.dumps({"image_id": "y"}))
    (f / "bad.json").write_text("{")
    (f / "x.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    rows, bad = tables.read_rank_results(spark, str(tmp_path))
    assert {r.image_id for r in rows.collect()} == {"x", "y"} and bad.count() == 1
    assert [r.image_id for r in tables.with_sidecar(rows, str(tmp_path)).collect()] == ["x"]


def test_record_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": 3}\n')
    (tmp_path / "c.json").write_text('{"data":\n [{"id": 4}]}')
    read = lambda n: sorted(r.id for r in tables.read_records(spark, str(tmp_path / n), "id long").collect())
    (tmp_path / "d.json").write_text('{"data": [{"id": 5}]}\n{"data": [{"id": 6}]}')
    (tmp_path / "e.json").write_text('{"id": 7, "data": "x"}\n{"id": 8}')
    assert read("a.json") == [1, 2] and read("b.jsonl") == [1, 3] and read("c.json") == [4] and read("d.json") == [5, 6] and read("e.json") == [7, 8]


def test_sampled_files_and_images(spark, tmp_path):
    spark.range(40).repartition(8).write.parquet(str(tmp_path / "t"))
    assert tables.read_images(spark, str(tmp_path / "t")).count() == 40
    few = tables.sample_files(spark, str(tmp_path / "t"), 2)
    assert 0 < few.count() < 40 and len(few.inputFiles()) == 2
    with pytest.raises(FileNotFoundError):
        tables.read_images(spark, str(tmp_path / "none"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", "accepted", ["x"]), (2, "c", "answer_error", [])], "id long, pipeline_name string, status string, l array<string>")
    sinks.by_pipeline(rows, str(tmp_path / "p"))
    assert sorted(x for x in os.listdir(tmp_path / "p") if x.startswith("pipe")) == ["pipeline_dir=a_b", "pipeline_dir=c"]
    sinks.by_status(rows, str(tmp_path / "s"))
    sinks.csv(rows, str(tmp_path / "c"))
    sinks.manifest(rows, {"seed": "1"}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().counts.accepted == 1
    media = spark.createDataFrame([(3, "jpg", bytearray(b"x"), "{}")], "idx long, format string, image_bytes binary, conversation string")
    assert sinks.export_media(media, str(tmp_path / "e")) == 2 and sorted(os.listdir(tmp_path / "e")) == ["image_000003.jpg", "image_000003.json"]


def test_stream_stops_like_the_batch_rule(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(6):  # one file a batch
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(src)
    def collect(target, empty=3):
        intake.collect_until(intake.read_files(spark, src, "id long", 1), F.col("id") % 2 == 0, str(tmp_path / "out"), str(tmp_path / "state"), target, empty)
        return sorted(r.id for r in spark.read.schema("id long").parquet(str(tmp_path / "out") + "/batch=*").collect())

    assert len(collect(12)) == 15  # whole batches of five until twelve are reached
    assert len(collect(12)) == 15  # no more when it runs again
    assert len(collect(17)) == 20 and collect(1000) == list(range(0, 60, 2))  # goes on with the files it had left
    spark.range(1, 40, 2).repartition(4).write.mode("append").parquet(src)
    spark.range(200, 300).coalesce(1).write.mode("append").parquet(src)
    assert len(collect(1000)) in (30, 80)  # stops after three empty batches, wherever the full one comes


def test_config_scans(spark, tmp_path):
    def put(name, what):
        (tmp_path / name).write_text(json.dumps(what))
        return str(tmp_path / name)

    claims = put("claims.json", {"claim_schemas": [], "templates": [{"claim_id": "a", "claim_template": "x [Y]"}, "plain"]})
    assert [(r.claim_id, r.claim_template) for r in tables.read_claims(spark, claims).orderBy("pos").collect()] == [("a", "x [Y]"), (None, "plain")]
    reasons = tables.read_failures(spark, put("f.json", {"failure_reasons": [{"failure_id": "A", "suggested_filtering_factors": ["p", "q"]}]}))
    assert {r.factor_id for r in X.all_factors(reasons).collect()} == {"A__0", "A__1"}
    pipes = tables.read_pipelines(spark, put("p.json", {"pipelines": [{"failure_key": "A", "pipeline_type": "t", "pipeline_name": "n"}]}))
    assert tuple(pipes.first()) == ("A", "t", "n")
    q = tables.read_question_pipelines(spark, put("q.json", {"pipelines": {"k": {"name": "n", "required_slots": ["object"]}}}))
    assert q.first().key == "k" and q.first().required_slots == ["object"]
    assert {tuple(r) for r in tables.read_triggers(spark, put("t.json", {"triggers": {"A": ["x", "y"]}})).collect()} == {("A", "x"), ("A", "y")}
    assert [tuple(r) for r in tables.read_factors(spark, put("l.json", ["a", "b"])).collect()] == [(0, "a"), (1, "b")]
    c = tables.read_criteria(spark, put("c.json", {"pipelines": {"k": {"name": "n", "criteria": ["a", "b [optional]"]}}}))
    assert [(r.pos, r.criterion) for r in c.orderBy("pos").collect()] == [(0, "a"), (1, "b [optional]")]


def test_result_and_question_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"image_id": "a"}, {"image_id": "b"}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"image_id": "c"}]))
    assert {r.image_id for f in ("r", "l") for r in tables.read_results(spark, str(tmp_path / f"{f}.json")).collect()} == {"a", "b", "c"}
    qa = tmp_path / "qa"
    qa.mkdir()
    (qa / "object_counting_1.json").write_text(json.dumps([{"id": 1, "pipeline_name": None}, {"id": 2, "pipeline_name": "own"}]))
    (qa / "all_1.json").write_text(json.dumps([{"id": 3}]))
    rows = tables.read_qa_files(spark, str(qa), "id long, pipeline_name string")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "object_counting"), (2, "own")]
    (qa / "meta.json").write_text(json.dumps({"files": ["object_counting_1.json", "gone.json"]}))
    assert tables.read_manifest(spark, str(qa / "meta.json"), "id long").count() == 2


def test_media_files(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"conversations": [{"from": "human", "value": "q"}]}))
    (tmp_path / "x.jpg").write_bytes(b"\xff\xd8\xffdata")
    row = tables.read_conversations(spark, str(tmp_path)).first()
    assert bytes(row.content) == b"\xff\xd8\xffdata" and row.conversations[0].value == "q"
    tables.folder_to_table(spark, str(tmp_path), str(tmp_path / "table"))
    images = tables.read_images(spark, str(tmp_path / "table"))
    assert images.first().image_id == "x" and tables.ordered_by_file(images).count() == 1
    files = spark.createDataFrame([("rank_0/failures/a.json",), ("rank_3/failures/b.json",)], "file string")
    r = tables.collected_report(files, files.limit(1), images).first()
    assert (r.results, r.ranks, r.bad_files, r.images) == (2, ["0", "3"], 1, 1)


def test_stream_outputs_and_progress(spark, tmp_path):
    spark.range(20).repartition(2).write.parquet(str(tmp_path / "in"))
    seen = intake.Progress()
    spark.streams.addListener(seen)
    stream = intake.read_files(spark, str(tmp_path / "in"), "id long", 1)
    intake.run(stream, intake.write_both(str(tmp_path / "out"), F.col("id") < 5), str(tmp_path / "state"))
    spark.streams.removeListener(seen)
    assert spark.read.schema("id long").parquet(str(tmp_path / "out/failures/batch=*")).count() == 5
    assert spark.read.schema("id long").parquet(str(tmp_path / "out/rest/batch=*")).count() == 15


def test_each_reference_once_over_restarts_and_replays(spark, tmp_path):
    def put(name, ids):
        spark.createDataFrame([(i,) for i in ids], "image_ref string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    out, state, table = str(tmp_path / "out"), str(tmp_path / "state"), f"file://{tmp_path}/seen"
    read = lambda: sorted(r.image_ref for r in spark.read.schema("image_ref string").parquet(f"{out}/batch=*").collect())
    stream = lambda: intake.read_files(spark, str(tmp_path / "in"), "image_ref string", 1)
    put("a", ["x", "y", "x", None])
    intake.once_each(stream(), out, state, intake.Seen(spark, table, buckets=4))
    put("b", ["y", "z"])
    intake.once_each(stream(), out, state, intake.Seen(spark, table, buckets=4))
    assert read() == ["x", "y", "z"]

    class Broken(intake.Seen):
        def add(self, rows, number):
            super().add(rows, number)
            raise RuntimeError("lost before the commit")

    put("c", ["z", "w", "x"])
    with pytest.raises(Exception, match="lost before the commit"):
        intake.once_each(stream(), out, state, Broken(spark, table, buckets=4))
    seen = intake.Seen(spark, table, buckets=4)
    spark.sql(f"drop table {seen.name}")  # as a new session, which knows the folder alone
    query = intake.once_each(stream(), out, state, intake.Seen(spark, table, buckets=4))
    assert read() == ["w", "x", "y", "z"] and query is None
    seen = intake.Seen(spark, table, buckets=4)
    assert sorted((r.ref, r.batch) for r in spark.table(seen.name).collect()) == [("w", 2), ("x", 0), ("y", 0), ("z", 1)]
    assert "dedup" not in "".join(os.listdir(state)) and not os.path.exists(f"{state}/state")  # no state of the stream


@pytest.mark.parametrize("size", [64, 300, 1 << 20])
def test_json_arrays_are_read_in_ranges(spark, tmp_path, size):
    rows = [{"id": i, "t": 'a"}{[\\' * (i % 5) + "é日" + "x" * (200 if i % 17 == 0 else i % 9), "n": {"d": [{"e": [i]}, {}]}} for i in range(150)]
    (tmp_path / "one.json").write_text(json.dumps(rows, ensure_ascii=False))
    (tmp_path / "two.json").write_text("\ufeff \n" + json.dumps(rows[:3], indent=1))
    (tmp_path / "none.json").write_text("[ ]\n")
    (tmp_path / "blank.json").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, str(size))
    try:
        found = tables.read_records(spark, str(tmp_path), "id long, t string, n struct<d:array<struct<e:array<long>>>>").collect()
        assert size > 64 or json_arrays.pieces(spark, str(tmp_path / "one.json")).select("start").distinct().count() > 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = sorted((r.id, r.t, tuple(tuple(d.e or ()) for d in r.n.d)) for r in found)
    assert got == sorted((r["id"], r["t"], ((r["id"],), ())) for r in [*rows, *rows[:3]])
    sinks.records(spark.createDataFrame([(1, "a"), (2, None)], "id long, t string").repartition(3), str(tmp_path / "out"), "array")
    files = [json.loads(f.read_text()) for f in (tmp_path / "out").glob("part-*")]
    assert sorted((r["id"], r.get("t")) for f in files for r in f) == [(1, "a"), (2, None)]


def test_tar_index_opens_one_range(spark, tmp_path, monkeypatch):
    tar.register(spark)
    path = str(tmp_path / "t")
    rows = [(f"k{i}", [bytearray(b"%d" % i * 300), bytearray(b"")], json.dumps({"i": i, "ü" * (i % 150): 1})) for i in range(40)]
    spark.createDataFrame(rows, "key string, media array<binary>, json string").coalesce(1).write.format("tar_samples").option("path", path).option("maxcount", "25").mode("append").save()
    assert sorted(x.name for x in (tmp_path / "t.index").iterdir()) == ["subtaskdata-0.tar", "subtaskdata-1.tar"]
    want = sorted((k, n, d) for k, media, text in rows for n, d in (("0_image", bytes(media[0])), ("1_image", b""), ("json", text.encode())))
    got = lambda **o: sorted((r.key, r["name"], bytes(r.data)) for r in spark.read.format("tar_samples").options(path=path, **o).load().collect())
    assert got() == got(splitsize="3000") == want
    assert len(tar.TarReader({"path": path, "splitsize": "3000"}).partitions()) > 10
    assert got(keys="k7,k30") == [x for x in want if x[0] in ("k7", "k30")]
    reads, opened = [], tar.store_of

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def open_input_file(self, name):
            source = self.inner.open_input_file(name)
            if "/t/" in name:
                one = source.read_at
                return type("Source", (), {"read_at": lambda _, n, at: (reads.append(n), one(n, at))[1], "__enter__": lambda me: me, "__exit__": lambda *a: source.close()})()
            return source

        def open_input_stream(self, name):
            assert "/t/" not in name, "a shard is streamed"
            return self.inner.open_input_stream(name)

    monkeypatch.setattr(tar, "store_of", lambda folder: (Counted(opened(folder)[0]), opened(folder)[1]))
    for options, n in (({"keys": "k7"}, 3), ({"headers": "true"}, 0)):
        reads.clear()
        reader = tar.TarReader({"path": path, **options})
        found = [r for p in reader.partitions() for r in reader.read(p)]
        assert len(reads) == n and len(found) == (3 if n else 120)
    monkeypatch.undo()
    (tmp_path / "t.index/subtaskdata-0.tar").unlink()
    (tmp_path / "t.index/subtaskdata-1.tar").write_text("5")  # of another file
    assert got() == want and len(tar.TarReader({"path": path, "splitsize": "3000"}).partitions()) > 1
    assert tar.index_shards(spark, path) == 2 and got(splitsize="3000") == want and tar.index_shards(spark, path) == 0
    spark.createDataFrame(rows[:1], "key string, media array<binary>, json string").write.format("tar_samples").option("path", path).mode("overwrite").save()
    assert len(list((tmp_path / "t").iterdir())) == len(list((tmp_path / "t.index").iterdir())) == 1


def test_a_second_scan_opens_new_and_changed_files_only(spark, tmp_path):
    folder = tmp_path / "in/rank_0/failures"
    folder.mkdir(parents=True)
    put = lambda name, n: (folder / name).write_text(json.dumps({"image_id": name, "total_claims": n}) if n is not None else "{broken")
    root, store = str(tmp_path / "in"), str(tmp_path / "store")
    for i in range(5):
        put(f"f{i}.json", i)
    put("bad.json", None)
    scan = lambda: [sorted(tuple(r)[:: 2 if len(r) == 3 else 1] for r in x.collect()) for x in (lambda rows, bad: (rows.select("image_id", "total_claims"), bad.select(F.regexp_extract("file", "([^/]+)$", 1))))(*tables.scan_rank_results(spark, root, store))]
    assert scan() == [[(f"f{i}.json", i) for i in range(5)], [("bad.json",)]]
    put("g.json", 7)
    put("f1.json", 1000)
    (folder / "f0.json").unlink()
    assert scan() == [[("f1.json", 1000), ("f2.json", 2), ("f3.json", 3), ("f4.json", 4), ("g.json", 7)], [("bad.json",)]]
    opened = spark.read.schema(tables.SCANNED).parquet(f"{store}/files/scan=2")
    assert sorted(r.file.rsplit("/", 1)[1] for r in opened.collect()) == ["f1.json", "g.json"]
    assert scan()[1] == [("bad.json",)] and not os.path.exists(f"{store}/files/scan=3")


def test_ledger_calls_for_what_is_left(spark, tmp_path):
    log, ledger = str(tmp_path / "log"), str(tmp_path / "ledger")
    os.makedirs(log)
    table = spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(60)], "request_key string, prompt string")

    def caller(broken):
        def call(prompts):
            if broken and os.path.exists(f"{log}/many") and "p5" not in prompts:
                raise SystemExit("the executor is lost")
            for p in prompts:
                with open(f"{log}/{p}", "a") as f:
                    f.write("x")
            if len(os.listdir(log)) > 30:
                open(f"{log}/many", "w").close()
            if "p7" in prompts:
                raise ValueError("p7 is refused")
            return [p.upper() for p in prompts]

        return call

    with pytest.raises(Exception):
        L.call_into(table, caller(True), ledger, batch=4, unit=10)
    done = {r.request_key for r in L.ledger_responses(spark, ledger).where("error is null").collect()}
    before = {p: os.path.getsize(f"{log}/{p}") for p in os.listdir(log)}
    assert 0 < len(done) < 59
    found = {r.request_key: r for r in L.call_into(table, caller(False), ledger, batch=4, unit=10).collect()}
    assert len(found) == 60 and found["k7"].error == "p7 is refused" and all(found[f"k{i}"].response == f"P{i}" for i in range(60) if i != 7)
    for key in done:  # no finished call is made again
        assert os.path.getsize(f"{log}/p{key[1:]}") == before[f"p{key[1:]}"]
    out = L.model_call(table.where("prompt <> 'p7'"), caller(True), ledger=ledger)  # nothing is left to call for
    assert out.where("response is null").count() == 0 and out.count() == 59


def test_one_bad_row_of_a_batch_fails_alone(spark):
    def caller(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return prompts

    table = spark.createDataFrame([(str(i), "bad" if i == 3 else f"p{i}") for i in range(8)], "request_key string, prompt string").coalesce(1)
    assert [r.request_key for r in L.model_call(table, caller).where("error is not null").collect()] == ["3"]


def test_more_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, "x", ["f"], "s"), ("b", False, None, ["g", "f"], "s")], "image_id string, skipped boolean, skip_reason string, filter_factor_texts array<string>, stage string")
    sinks.results(rows, rows.agg(F.count("*").alias("n")), str(tmp_path / "r"))
    sinks.quarantine(rows, str(tmp_path / "q"))
    sinks.annotations(rows, str(tmp_path / "a"))
    sinks.calls(rows, str(tmp_path / "c"))
    sinks.records(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "q")).count() == 1 and [r.text for r in spark.read.json(str(tmp_path / "a/factors")).collect()] == ["f", "g"]
    assert sinks.intermediate(rows, str(tmp_path / "i")).count() == 2
    tar.register(spark)
    spark.createDataFrame([("k", [bytearray(b"1")], "{}")], "key string, media array<binary>, json string").write.format("tar_samples").option("path", str(tmp_path / "t")).mode("append").save()
    sinks.tar_report(spark, str(tmp_path / "t"), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 2


@pytest.mark.parametrize("few, most", [(100_000, 2), (0, 4)])
def test_medians_are_exact(spark, monkeypatch, few, most):
    monkeypatch.setattr(P, "FEW_ROWS", few)
    rows = [(float(i * i % 97), 1e9 if i == 3 else float(i % 3), None, 7, i if i % 2 else None, -1.5 ** (i % 300), -0.0 if i % 2 else 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int, `e.e` long, f double, g double").repartition(3)
    readings, one = [], P.F.sum
    monkeypatch.setattr(P.F, "sum", lambda c: (readings.append(c), one(c))[1])
    found = {r["column"]: r["median"] for r in P.numeric_profile(df, ["a", "b", "c", "d", "e.e", "f", "g"]).collect()}
    want = {c: statistics.median([r[i] for r in rows if r[i] is not None]) if any(r[i] is not None for r in rows) else None for i, c in enumerate(["a", "b", "c", "d", "e.e", "f", "g"])}
    assert found == {k: None if v is None else round(v, 6) for k, v in want.items()}
    assert readings.count("n") == 2 * most  # one count and one running sum for each reading, whatever the columns
    assert P.numeric_profile(df.where("false"), ["a"]).first()["median"] is None


@pytest.mark.parametrize("odd", [float("-inf"), float("inf"), float("nan")])
def test_medians_end_with_infinities_and_nan(spark, odd):
    df = spark.range(100_100).select(F.when(F.col("id") == 5, odd).otherwise(F.col("id") % 1000).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, odd).otherwise(1.0).alias("b"), F.lit(odd).alias("c"))
    found = {r["column"]: r["median"] for r in P.numeric_profile(df, ["a", "b", "c"]).collect()}
    values = sorted([odd if i == 5 else i % 1000 for i in range(100_100)], key=lambda x: (x != x, x))
    assert found["a"] == (values[50_049] + values[50_050]) / 2
    assert str(found["b"]) == str((odd + 1.0) / 2) and str(found["c"]) == str(odd)
    values = P.ranked_values(df, {"a": [0, 100_099], "b": [0, 100_099]})
    assert str(odd) in {str(x) for x in values.values()}


def test_labels_are_trained_together_to_the_optimum(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = np.stack([(x @ rng.normal(size=5) + rng.normal(size=400) > 0) for _ in range(3)], axis=1).astype(float)
    rows = [(i, a.tolist(), *b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(400, None, 1.0, 0.0, 1.0), (401, [0.0] * 5, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, l0 double, l1 double, l2 double").repartition(5)
    calls, one = [], O._loss_and_gradient
    monkeypatch.setattr(O, "_loss_and_gradient", lambda *a: (calls.append(1), one(*a))[1])
    model = O.train_labels(df, ["l0", "l1", "l2"], ridge=0.01)
    assert model.passes == len(calls) < 60 and model.gradient.max() < 1e-8  # a reading for all labels
    z = np.concatenate([x, np.ones((400, 1))], axis=1)
    for k in range(3):  # Newton's method on one label after the other
        w = np.zeros(6)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            ridge = 0.01 * np.diag([1, 1, 1, 1, 1, 0])
            w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / 400 + ridge, z.T @ (p - y[:, k]) / 400 + ridge @ w)
        assert np.allclose(w, [*model.weights[k], model.biases[k]], atol=1e-5)
    monkeypatch.setattr(O, "TREE", 2)
    again = O.train_labels(df, ["l0"], ridge=0.01)
    assert np.allclose(again.weights[0], model.weights[0], atol=1e-6)
    assert O.train_labels(df.where("false"), ["l0"]).passes == 0


def test_label_models_separate_and_decode(spark):
    rows = [(i, [float(i % 2) * 2 - 1, float(i // 2 % 2) * 2 - 1], float(i % 2), float(i // 2 % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, x double, y double")
    model = O.train_labels(df, ["x", "y"])
    for r in O.score_labels(df, model).collect():
        assert r.predicted == [n for n, v in (("x", r.x), ("y", r.y)) if v] and all(abs(p - v) < 0.1 for p, v in zip(r.probability, (r.x, r.y), strict=True))


def unit_vectors(n, clusters, spread, rng):
    centres = rng.normal(size=(clusters, 16))
    v = centres[np.arange(n) % clusters] / 4 + spread * rng.normal(size=(n, 16))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_similar_pairs_are_exact_and_blocks_are_ruled_out(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    v = unit_vectors(600, 12, 0.05, rng)
    v[50:90] = v[7]  # equal vectors
    v[90] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(600, None)], "id long, v array<double>").repartition(3)
    want = {(i, j) for i, j in np.argwhere(v @ v.T >= 0.9).tolist() if i < j}
    found = [tuple(r) for r in O.similar_pairs(df, 0.9).collect()]
    assert set(found) == want and len(found) == len(want)
    dealt, pairs = O.blocks(df, 0.9)
    n, compared = dealt.select("block").distinct().count(), {tuple(r) for r in pairs.collect()}
    assert n > 38 and len(compared) < 0.25 * n * (n + 1) / 2  # of the pairs of blocks
    members = dealt.groupBy("block").agg(F.collect_list("id").alias("ids")).collect()
    assert max(len(r.ids) for r in members) < 60
    # no pair is compared that the bound rules out, and none is left out that holds a similar pair
    block = {i: r.block for r in members for i in r.ids}
    assert {tuple(sorted((block[i], block[j]))) for i, j in want} <= {tuple(sorted(x)) for x in compared}
    assert len({tuple(sorted(x)) for x in compared}) == len(compared)
    links = [tuple(r) for r in O.similar_links(df, 0.9).collect()]
    assert len(links) < len(want) / 4
    ids = df.select("id")
    a, b = ({tuple(r) for r in O.components(ids, spark.createDataFrame(list(e), "i long, j long")).collect()} for e in (want, links))
    assert a == b and len({c for _, c in a}) > 5
    everything = O.similar_pairs(df.where("id < 100"), -2.0)  # nothing is ruled out
    assert everything.count() == 100 * 99 / 2
    assert O.similar_pairs(df.where("false")).count() == 0 and O.similar_links(df.where("false")).count() == 0


def test_components_by_rounds_and_in_one_task(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10] + [(70, 60), (60, 65), (None, 3)]
    ids = spark.createDataFrame([(i,) for i in range(80)], "id long")
    df = spark.createDataFrame(edges, "i long, j long").repartition(4)
    once = sorted(tuple(r) for r in O.components(ids, df).collect())
    assert once[70] == (70, 60) and once[9] == (9, 1) and once[0] == (0, 0)
    monkeypatch.setattr(O, "FEW_EDGES", 1)
    assert sorted(tuple(r) for r in O.components(ids, df).collect()) == once


def test_names_of_an_image_with_a_third_of_all_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 700)).alias("image_id"), F.col("id"))
    got = {r.id: r["name"] for r in S.unique_names(rows, "image_id", "id").collect()}
    n = {}
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"i{i % 700}"
        k = n[key] = n.get(key, -1) + 1
        assert got[i] == (f"{key}_{k}" if k else key)


def test_prompts_name_what_they_ask(spark):
    row = spark.createDataFrame([("img", "a claim", ["object", "region"], None)], "image_id string, claim string, slots array<string>, why string")
    asked = L.asked(row, "prefill", "image_id", claim="claim", slots="slots").first()
    assert "a claim" in asked.prompt and "object, region" in asked.prompt and len(asked.request_key) == 64
    again = L.asked(row, "question", "image_id", intent=F.lit("count"), slots="slots", why=F.lit("vague")).first().prompt
    first = L.asked(row, "question", "image_id", intent=F.lit("count"), slots="slots", why="why").first().prompt
    assert again.startswith(first) and again.endswith("vague")
    assert set(L.PROMPTS) == set(L.STAGES)


def test_claims_of_a_configuration_in_several_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"claim_schemas": [], "global_claims": ["not this"], "templates": [{"claim_id": "x", "claim_template": "", "template": "t"}, '{"is": "a text"}']}))
    (tmp_path / "b.json").write_text(json.dumps({"templates": ["two", {"text": "three"}, None], "claims": ["nor this"]}))
    (tmp_path / "c.json").write_text(json.dumps({"claims": ["nor that"]}))
    rows = tables.read_claims(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.claim_id, r.claim_template) for r in rows] == [(0, "x", "t"), (1, None, '{"is": "a text"}'), (2, None, "two"), (3, None, "three"), (4, None, None)]


def test_factors_in_several_files(spark, tmp_path):
    for name, texts in (("a", ["p", "q"]), ("b", []), ("c", ["r", "p"])):
        (tmp_path / f"{name}.json").write_text(json.dumps(texts))
    assert sorted(tuple(r) for r in tables.read_factors(spark, str(tmp_path)).collect()) == [(0, "p"), (1, "q"), (2, "r"), (3, "p")]


def test_tar_shards_are_written_by_tasks_that_follow_the_rows(spark, tmp_path):
    tar.register(spark)
    rows = spark.range(0, 2500, 1, 1).select(F.format_string("s%04d", "id").alias("key"), F.array(F.encode(F.col("id").cast("string"), "UTF-8")).alias("media"), F.lit("{}").alias("json"))
    sinks.tar_shards(rows, str(tmp_path / "t"), 2000)
    assert len(list((tmp_path / "t").glob("*.tar"))) == 3  # a shard of each task; one task made two
    back = spark.read.format("tar_samples").option("path", str(tmp_path / "t")).load().where("name = '0_image'")
    assert sorted((r.key, bytes(r.data)) for r in back.collect()) == [(f"s{i:04d}", str(i).encode()) for i in range(2500)]


def test_small_shards_share_a_task(spark, tmp_path, monkeypatch):
    tar.register(spark)
    path = str(tmp_path / "t")
    rows = [(f"k{i:02d}", [bytearray(b"x" * i)], "{}") for i in range(40)]
    spark.createDataFrame(rows, "key string, media array<binary>, json string").coalesce(1).write.format("tar_samples").option("path", path).option("maxcount", "1").mode("append").save()
    for options, most in (({}, 2), ({"headers": "true"}, 2), ({"splitsize": "1000"}, 200)):
        reader = tar.TarReader({"path": path, **options})
        assert len(reader.partitions()) <= most and len(list(tmp_path.glob("t/*.tar"))) == 40
        assert sorted(r[1] for p in reader.partitions() for r in reader.read(p) if r[2] == "json") == [r[0] for r in rows]
    monkeypatch.setattr(tar, "MOST_PARTITIONS", 7)
    reader = tar.TarReader({"path": path, "splitsize": "1000"})
    assert len(reader.partitions()) <= 7
    assert sorted((r[1], r[4]) for p in reader.partitions() for r in reader.read(p) if r[2] != "json") == [(k, bytes(m[0])) for k, m, _ in rows]


def test_blocks_grow_so_that_copies_of_vectors_do_not(spark, monkeypatch):
    """Where nothing can be ruled out, a vector goes to each block, so there are some tens of them."""
    monkeypatch.setattr(O, "BLOCK_ROWS", 4)
    monkeypatch.setattr(O, "PRODUCTS", 500)
    v = np.random.default_rng(1).normal(size=(1200, 32))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>").repartition(3)
    dealt, _ = O.blocks(df, 0.4)
    assert dealt.schema["v"] == df.schema["v"] and dealt.select("block").distinct().count() <= 3 * O.MANY_BLOCKS
    exact = v.astype(np.float64) @ v.astype(np.float64).T
    assert sorted(tuple(r) for r in O.similar_pairs(df, 0.4).collect()) == sorted((i, j) for i, j in np.argwhere(exact >= 0.4).tolist() if i < j)


def test_files_are_written_in_many_tasks_and_listed_by_folder(spark, tmp_path):
    from faultline.sources import files

    rows = spark.range(0, 2100, 1, 1).select(F.concat(F.lit("rank_0/failures/f"), "id", F.lit(".json")).alias("name"), F.encode(F.concat(F.lit('{"image_id": "'), "id", F.lit('"}')), "UTF-8").alias("data"))
    assert files.spread(rows, "name").rdd.getNumPartitions() == 3 and files.write_files(rows, str(tmp_path)) == 2100
    (tmp_path / "rank_0/failures/f1.png").write_bytes(b"x")
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    good, bad = tables.read_rank_results(spark, str(tmp_path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [seen.getStageInfo(s).numTasks for j in seen.getJobIdsForGroup("listing") for s in seen.getJobInfo(j).stageIds]
    assert good.select("image_id").distinct().count() == 2100 and bad.count() == 0 and max(tasks) < 1500
