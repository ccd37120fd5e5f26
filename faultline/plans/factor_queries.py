"""Queries over factor texts, labels and table profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from faultline.functions import media as M
from faultline.operators import factors as O
from faultline.operators import profile as P
from faultline.plans.fixtures import cte, frame
from faultline.streaming import intake

QUERIES, SQL = {}, {}
THRESHOLD = 0.40


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


EDGES = f"""{cte('texts').replace('with ', 'with recursive ', 1)}, e as (select a.vec_id i, b.vec_id j from embeddings a join embeddings b on a.vec_id < b.vec_id
  where list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::double * x[2]::double)) >= {THRESHOLD})"""
COMP = f"""{EDGES}, s as (select i, j from e union select j, i from e), r(id, x) as (select id, id from texts union select r.id, s.j from r join s on s.i = r.x), c as (select id, min(x) component from r group by 1)"""
FACT = f"{COMP}, f as (select component, min(pos) first, string_agg(text, '|' order by pos) texts from c join texts using (id) group by 1), g as (select component, 'factor_' || row_number() over (order by first) factor_id, first, texts from f)"


@query(f"{EDGES} select i, j from e")
def c1_j14_similar_pairs(spark, sf):
    return O.similar_pairs(vectors(spark, sf), THRESHOLD)


@query(f"{COMP} select id, component from c")
def c2_components(spark, sf):
    return O.components(frame(spark, sf, "texts"), O.similar_pairs(vectors(spark, sf), THRESHOLD))


@query(f"{FACT} select component, factor_id, first, texts from g")
def c3_a17_w3_abstract_factors(spark, sf):
    return O.abstract_factors(frame(spark, sf, "texts"), vectors(spark, sf), THRESHOLD).withColumn("texts", F.array_join("texts", "|"))


def mapping(spark, sf):
    """Texts to ids by id modulo 40: a mapping as the abstraction gives it, without the pairs."""
    return frame(spark, sf, "texts").where("id % 7 > 0").select("text", F.concat(F.lit("factor_"), F.col("id") % 40).alias("factor_id"))


MAP = f"{cte('texts')}, mp as (select text, 'factor_' || (id % 40) factor_id from texts where id % 7 > 0), an as (select 'img_' || (id % 50) image_id, text, row_number() over (partition by id % 50 order by id) - 1 p from texts)"


@query(f"{MAP}, x as (select image_id, factor_id, min(p) p from an join mp using (text) group by 1, 2) select image_id, string_agg(factor_id, ',' order by p) ids, max(case when factor_id = 'factor_3' then 1 else 0 end)::int hot3, max(case when factor_id = 'factor_9' then 1 else 0 end)::int hot9 from x group by 1")
def c4_j13_f29_labels(spark, sf):
    t = frame(spark, sf, "texts").withColumn("image_id", F.concat(F.lit("img_"), F.col("id") % 50))
    a = t.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]).alias("filter_factor_texts"))
    out = O.label_samples(a, mapping(spark, sf)).withColumn("hot", M.multi_hot(F.col("factor_ids"), ["factor_3", "factor_9"]))
    return out.select("image_id", F.array_join("factor_ids", ",").alias("ids"), F.col("hot")[0].alias("hot3"), F.col("hot")[1].alias("hot9"))


@query(f"{cte('texts')} select text, min(pos) pos from (select 'x ' || (id % 90) as text, pos from texts) group by 1")
def u3_distinct_texts(spark, sf):
    return O.distinct_texts(frame(spark, sf, "texts").withColumn("text", F.concat(F.lit("x "), F.col("id") % 90)))


@query(f"{cte('texts')} select id, 'factor_' || (id % 40) factor_id, case when id % 40 < 20 then 'about ' || (id % 40) else 'factor_' || (id % 40) end description from texts")
def j15_describe_factors(spark, sf):
    t = frame(spark, sf, "texts").select("id", F.concat(F.lit("factor_"), F.col("id") % 40).alias("factor_id"))
    d = spark.range(20).select(F.concat(F.lit("factor_"), "id").alias("factor_id"), F.concat(F.lit("about "), "id").alias("description"))
    return O.describe_factors(t, d)


@query("select vec_id pos, label, 'img_' || vec_id image_id from embeddings")
def j18_align(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("pos"), "label")
    return O.align(e, e.select("pos", F.concat(F.lit("img_"), "pos").alias("image_id")))


@query(f"""{cte('multilabel')}, c as (select *, greatest(1e-7, least(1 - 1e-7, p0)) q0, greatest(1e-7, least(1 - 1e-7, p1)) q1, (p0 >= 0.5)::int h0, (p1 >= 0.5)::int h1 from multilabel),
  s as (select sum(t0 * h0) tp0, sum((1 - t0) * h0) fp0, sum(t0 * (1 - h0)) fn0, sum(t1 * h1) tp1, sum((1 - t1) * h1) fp1, sum(t1 * (1 - h1)) fn1, sum(-(t0 * ln(q0) + (1 - t0) * ln(1 - q0)) - (t1 * ln(q1) + (1 - t1) * ln(1 - q1))) / (2 * count(*)) bce, avg(case when t0 = h0 and t1 = h1 then 1 else 0 end) sub from c),
  m as (select *, tp0 + tp1 tp, fp0 + fp1 fp, fn0 + fn1 fn from s), r as (select *, tp / (tp + fp + 1e-8) p, tp / (tp + fn + 1e-8) r from m)
  select round(bce, 6) bce, round(sub, 6) subset_accuracy, round((2 * tp0 / (2 * tp0 + fp0 + fn0 + 1e-8) + 2 * tp1 / (2 * tp1 + fp1 + fn1 + 1e-8)) / 2, 6) f1_macro, round(p, 6) precision_micro, round(r, 6) recall_micro, round(2 * p * r / (p + r + 1e-8), 6) f1_micro from r""")
def a15_multilabel_metrics(spark, sf):
    rows = frame(spark, sf, "multilabel").select(F.array("t0", "t1").alias("truth"), F.array("p0", "p1").alias("probability"))
    return O.multilabel_metrics(rows)


@query(f"{cte('multilabel')}, k as (select (p0 >= 0.6)::int + (p1 >= 0.6)::int n from multilabel) select count(*) samples, count(*) filter (where n > 0) interpretable, round(avg(n), 6) mean_predicted, count(*) filter (where n > 0) >= 0.5 * count(*) passed from k")
def a16_p62_routing_report(spark, sf):
    rows = frame(spark, sf, "multilabel").withColumn("predicted", O.decode(F.array(F.lit("a"), F.lit("b")), F.array("p0", "p1"), 0.6))
    return O.routing_report(rows)


@query("select c_custkey, round(case when c_custkey % 4 = 0 then 1.0 when c_custkey % 4 = 1 then 0.0 when c_custkey % 4 = 2 then 2.0 * 1 / 3 else 2.0 * 2 / 4 end, 6) f1, round(0.5 * case when c_custkey % 4 = 0 then 1.0 when c_custkey % 4 = 1 then 0.0 when c_custkey % 4 = 2 then 2.0 / 3 else 1.0 end + 0.25, 6) reward from customer")
def a20_a21_u4_set_f1(spark, sf):
    k = F.col("c_custkey") % 4
    e = F.array().cast("array<string>")
    x = lambda *v: F.array(*[F.lit(i) for i in v])
    chosen = F.when(k == 0, e).when(k == 1, x("a")).when(k == 2, x("a")).otherwise(x("a", "b"))
    true = F.when(k == 0, e).when(k == 1, e).when(k == 2, x("a", "c")).otherwise(x("b", "a"))
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.round(O.set_f1(chosen, true), 6).alias("f1"), F.round(O.combined_reward(O.set_f1(chosen, true), F.lit(0.5)), 6).alias("reward"))


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount")


@query(" union all ".join(f"select '{c}' \"column\", count(*) n, count(*) filter (where {c} is null) nulls, round(100.0 * avg(case when {c} is null then 1 else 0 end), 6) null_pct, min({c}) min, max({c}) max, round(avg({c}), 6) mean, round(median({c}), 6) median, round(stddev({c}), 6) std from lineitem" for c in NUMERIC))
def a18_numeric_profile(spark, sf):
    return P.numeric_profile(spark.read.parquet(f"{sf}/lineitem.parquet"), list(NUMERIC))


@query("select 'l_returnflag' \"column\", count(distinct l_returnflag) distinct_values from lineitem union all select 'l_suppkey', count(distinct l_suppkey) from lineitem")
def a18_distinct_counts(spark, sf):
    return P.distinct_counts(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_returnflag", "l_suppkey"])


@query("with p as (select 'l_returnflag' \"column\", l_returnflag value from lineitem union all select 'l_partkey', l_partkey::varchar from lineitem), c as (select \"column\", value, count(*) n from p group by 1, 2), r as (select *, (row_number() over (partition by \"column\" order by n desc, value))::int rank, count(*) over (partition by \"column\") t from c) select \"column\", value, n, rank from r where t <= 20 or rank <= 10")
def a18_t2_t4_common_values(spark, sf):
    return P.common_values(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_returnflag", "l_partkey"])


@query("with k as (select l_returnflag, l_linestatus, l_linenumber, count(*) c from lineitem group by 1, 2, 3) select sum(c)::bigint n_rows, 3 n_columns, sum(c - 1)::bigint duplicate_rows, 0::bigint rows_with_null from k")
def a19_table_quality(spark, sf):
    return P.table_quality(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("select r_regionkey, left(r_name, 3) r_name from region")
def t6_preview(spark, sf):
    return P.preview(spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey", "r_name"), 100, ["r_name"], 3)


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) norm, true same from embeddings")
def f30_f31_vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    twice = M.l2_normalize(F.transform("embedding", lambda x: x * 2))
    return e.select("vec_id", F.round(M.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"), (F.round(M.dot(twice, F.col("embedding")), 4) == 1.0).alias("same"))


LABELS = {"even": "label % 2 = 0", "high": "label > 4", "third": "label % 3 = 1"}
RIDGE = 0.05


def labelled(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", "embedding", *[F.expr(f"double({x})").alias(k) for k, x in LABELS.items()])


@query(" union all ".join(f"select '{k}' label, i feature, round(sum(case when {x} then 1.0 else 0.0 end * case when i = 0 then 1.0 else embedding[i]::double end), 4) moment from (select *, unnest(range(65)) i from embeddings) group by i" for k, x in LABELS.items()))
def c5_train_labels(spark, sf):
    """Three labels trained together. At the optimum, and only there, what the model expects equals what the labels have:
    for each label and feature the sum of (probability + ridge) is that of the label; feature 0 is the bias."""
    rows = labelled(spark, sf)
    model = O.train_labels(rows, list(LABELS), ridge=RIDGE, tolerance=1e-10)
    scored = O.score_labels(rows, model)
    x = F.concat(F.array(F.lit(1.0)), F.transform("embedding", lambda v: v.cast("double")))

    def moments(k: int):
        pull = F.array(F.lit(0.0), *[F.lit(RIDGE * v) for v in model.weights[k].tolist()])
        return F.transform(F.arrays_zip(x.alias("x"), pull.alias("r")), lambda z, i: F.struct(F.lit(model.labels[k]).alias("label"), i.cast("long").alias("feature"), (z["x"] * F.col("probability")[k] + z["r"]).alias("m")))

    each = scored.select(F.explode(F.concat(*[moments(k) for k in range(len(model.labels))])).alias("m")).select("m.*")
    return each.groupBy("label", "feature").agg(F.round(F.sum("m") + F.lit(0.0), 4).alias("moment"))


GIVEN = {"a": [((7 * k) % 11 - 5) / 4 for k in range(64)], "b": [((5 * k + 3) % 13 - 6) / 4 for k in range(64)]}


@query(f"""with p as (select vec_id, {', '.join(f"1 / (1 + exp(-({b} + list_sum(list_transform(list_zip(embedding, {GIVEN[k]}), lambda x: x[1]::double * x[2]::double))))) p_{k}" for k, b in (('a', 0.25), ('b', -0.5)))} from embeddings)
  select vec_id, round(p_a, 6) p_a, round(p_b, 6) p_b, concat_ws(',', case when p_a >= 0.6 then 'a' end, case when p_b >= 0.6 then 'b' end) predicted from p""")
def c6_score_labels(spark, sf):
    """Two labels by given weights, and those at or above the threshold."""
    model = O.LabelModel(["a", "b"], np.array([GIVEN["a"], GIVEN["b"]]), np.array([0.25, -0.5]), np.zeros(2), 0)
    p = O.score_labels(spark.read.parquet(f"{sf}/embeddings.parquet"), model, threshold=0.6)
    return p.select("vec_id", F.round(F.col("probability")[0], 6).alias("p_a"), F.round(F.col("probability")[1], 6).alias("p_b"), F.array_join("predicted", ",").alias("predicted"))


@query()
def c5_c6_train_and_score(spark, sf):
    """Labels trained together on the embeddings and scored on all rows."""
    rows = labelled(spark, sf)
    scored = O.score_labels(rows, O.train_labels(rows, list(LABELS), rounds=10))
    return scored.select("vec_id", F.round(F.col("probability")[0], 4).alias("p_even"), F.array_join("predicted", ",").alias("predicted"))


@query("select user_id image_ref, count(*) n from (select distinct user_id from events) group by 1")
def x1_x2_stream_dedupe(spark, sf):
    """The events as a stream of files, each reference once, written batch by batch."""
    import uuid

    from faultline.sources.shared import materialize

    events = materialize(spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("image_ref")), "events")
    folder = events.inputFiles()[0].rsplit("/", 1)[0]
    root = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/stream-{uuid.uuid4().hex}"

    intake.once_each(intake.read_files(spark, folder, "image_ref long", 2), f"{root}/out", f"{root}/state", intake.Seen(spark, f"{root}/seen", kind="long"))
    return spark.read.schema("image_ref long").parquet(f"{root}/out/batch=*").groupBy("image_ref").agg(F.count(F.lit(1)).alias("n"))
