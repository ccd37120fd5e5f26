"""Queries over verdicts: failures, their aggregates, sampling and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions.seeded import u
from faultline.operators import claims as C
from faultline.operators import failures as O
from faultline.operators import routing as R
from faultline.operators import sampling as S
from faultline.plans.fixtures import cte, frame
from faultline.sources import tables
from faultline.sources.shared import new_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def values(rows) -> str:
    return ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


REASON_ROWS = [(a, b, i) for i, (a, b) in enumerate(R.REASON_CATEGORIES)]
REASONS = f"reasons(failure_id, category, pos) as (values {values(REASON_ROWS)})"
CATEGORY = """case when lower(capability) like '%spatial%' then 'spatial_reasoning' when lower(capability) like '%count%' then 'relational_reasoning'
  when lower(capability) like '%absence%' then 'negative_reasoning' end"""
#: Matched failures as SQL.
M = f"""{cte('v')}, {REASONS}, j as (select *, coalesce(not is_correct, false) or coalesce(not not_related_judgment_correct, false) as failed, {CATEGORY} as cat from v where not skipped),
m as (select j.*, case when not failed then null when not_related_judgment_correct = false then (select failure_id from reasons r where r.failure_id = target_failure_id)
  when not_related_judgment_correct then null
  else coalesce((select failure_id from reasons r where r.failure_id = failure_reason), (select failure_id from reasons r where r.failure_id = target_failure_id),
    (select arg_min(failure_id, pos) from reasons r where r.category = cat)) end as failure_id from j),
b as (select image_id, coalesce(failure_id, 'null') k, count(*) n from m where failed group by 1, 2),
a as (select image_id, count(*) total_claims, count(*) filter (where failed) failed_claims, round(1 - count(*) filter (where failed) / count(*), 6) success_rate,
  array_to_string(list(claim_id order by pos) filter (where failed), ',') failed_ids from m group by 1)"""
U = "((('0x' || substr(md5(concat_ws('|', {0})), 1, 8))::bigint + 1) / 4294967297.0)"


def matched(spark, sf) -> DataFrame:
    return O.match_failure(frame(spark, sf, "v"), R.reasons(spark))


def images(spark, sf) -> DataFrame:
    return O.image_failures(matched(spark, sf))


def factor_reasons(spark) -> DataFrame:
    """Reasons with factors made from their ids, one of them shared by all."""
    return R.reasons(spark).withColumn("suggested_filtering_factors", F.array(F.lower("failure_id"), F.lit("shared"), F.concat(F.lit("[optional] "), F.lower("failure_category"))))


FACTORS = "f as (select failure_id, unnest([lower(failure_id), 'shared', '[optional] ' || lower(category)]) factor, unnest([0, 1, 2]) p from reasons)"
BREAKDOWN = "(select image_id, string_agg(k || '=' || n, ';' order by k) breakdown from b group by 1)"


@query(f"{M} select image_id, total_claims, failed_claims, success_rate, coalesce(breakdown, '') breakdown, coalesce(failed_ids, '') failed_ids from a left join {BREAKDOWN} using (image_id)")
def a1_image_failures(spark, sf):
    return images(spark, sf).select("image_id", "total_claims", "failed_claims", "success_rate", O.breakdown_text(F.col("failure_breakdown")).alias("breakdown"), F.array_join("failed_claim_ids", ",").alias("failed_ids"))


@query(f"{M} select (select count(*) from a) total_images, (select sum(total_claims) from a)::bigint total_claims, (select sum(failed_claims) from a)::bigint total_failed, (select string_agg(k || '=' || s, ';' order by k) from (select k, sum(n)::bigint s from b group by 1)) breakdown, round((select sum(failed_claims) / sum(total_claims) from a), 6) failure_rate")
def a2_global_failures(spark, sf):
    return O.global_failures(images(spark, sf)).withColumn("breakdown", O.breakdown_text(F.col("failure_breakdown"))).drop("failure_breakdown")


@query(f"{cte('v')} select content_type, count(*) total, sum(case when is_correct then 0 else 1 end)::bigint errors, round(avg(case when is_correct then 0 else 1 end), 6) error_rate from v where not skipped group by 1")
def a3_error_rates(spark, sf):
    return O.error_rates(frame(spark, sf, "v"))


@query(f"{M}, {FACTORS}, i as (select distinct image_id, factor from m join f using (failure_id) where failed) select factor, count(*) n from i group by 1")
def a4_factor_distribution(spark, sf):
    return O.factor_distribution(O.image_factors(matched(spark, sf), factor_reasons(spark)))


@query(f"{cte('v')} select count(not_related_judgment_correct) judged, count(*) filter (where not not_related_judgment_correct) corrected, round(count(*) filter (where not not_related_judgment_correct) / count(not_related_judgment_correct), 6) correction_rate from v where not skipped")
def a5_corrections(spark, sf):
    return O.not_related_corrections(frame(spark, sf, "v"))


@query(f"{M} select k failure_type, sum(n)::bigint n from b group by 1")
def a6_failure_distribution(spark, sf):
    m = matched(spark, sf)
    return O.failure_distribution(O.image_failures(m), m.where("failed"))


@query(f"{M} select count(*) images, count(*) filter (where failed_claims > 0) failed_images, sum(total_claims)::bigint claims, sum(failed_claims)::bigint failures, round(avg(success_rate), 6) mean_success_rate from a")
def a7_run_summary(spark, sf):
    return O.run_summary(images(spark, sf))


@query(f"{M}, {FACTORS}, i as (select distinct image_id, factor from m join f using (failure_id) where failed) select image_id, string_agg(factor, ',' order by factor) factors from i group by 1")
def a8_image_factors(spark, sf):
    return O.image_factors(matched(spark, sf), factor_reasons(spark)).select("image_id", F.array_join("factors", ",").alias("factors"))


@query(f"{M}, {FACTORS}, n as (select failure_id, count(*) n from m where failed group by 1) select failure_id, failure_id || '__' || p factor_id, factor, coalesce(n, 0) failures from f left join n using (failure_id)")
def a9_s22_all_factors(spark, sf):
    """All factors of a configuration file, each with the failures that suggest it."""
    path = new_path(spark, "reasons")
    reasons = factor_reasons(spark).select("failure_id", "failure_category", "suggested_filtering_factors", "pos")
    reasons.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("failure_id", "failure_category", "suggested_filtering_factors").alias("r")))), lambda x: x["r"]).alias("failure_reasons")).coalesce(1).write.json(path)
    counts = matched(spark, sf).where("failed").groupBy("failure_id").agg(F.count(F.lit(1)).alias("failures"))
    return O.all_factors(tables.read_failures(spark, path)).join(counts, "failure_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))


@query(f"{cte('v')} select image_id, count(*) total, count(*) filter (where pos % 3 > 0) kept, count(*) filter (where pos % 3 = 0) dropped, coalesce(string_agg(pos::varchar, ',' order by pos) filter (where pos % 3 = 0), '') positions from v group by 1")
def a10_prefill_summary(spark, sf):
    rows = O.prefill_summary(frame(spark, sf, "v").withColumn("kept", F.col("pos") % 3 > 0))
    return rows.select("image_id", "total", "kept", "dropped", F.array_join(F.transform("dropped_positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(f"{cte('v')} select image_id, count(*) filter (where pos % 3 = 0) own_claims, 5 global_claims, true has_claims from v group by 1")
def a24_coverage(spark, sf):
    v = frame(spark, sf, "v")
    shared = spark.read.parquet(f"{sf}/region.parquet")
    return C.coverage(v.select("image_id").distinct(), v.where("pos % 3 = 0"), shared).withColumn("global_claims", F.col("global_claims").cast("int"))


@query(f"{cte('v')} select image_id, r_name claim_text from (select distinct image_id from v), region")
def j1_image_claims(spark, sf):
    t = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_name").alias("claim_text"))
    return C.pair_with_images(frame(spark, sf, "v").select("image_id").distinct(), t)


@query(f"{cte('v')}, i as (select distinct image_id from v), own as (select image_id, original_template claim_text from v where pos % 5 = 0), sh as (select r_name claim_text from region where r_name < 'B'), both_ as (select * from own union all select * from i, sh) select * from both_ union all select image_id, n_name from i, nation where image_id not in (select image_id from both_)")
def j2_claims_of_images(spark, sf):
    v = frame(spark, sf, "v")
    own = v.where("pos % 5 = 0").select("image_id", F.col("original_template").alias("claim_text"))
    shared = spark.read.parquet(f"{sf}/region.parquet").where("r_name < 'B'").select(F.col("r_name").alias("claim_text"))
    return C.claims_of_images(v.select("image_id").distinct(), own, shared, spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("claim_text")))


@query(f"{cte('v')} select image_id, claim_id, content_type, capability, is_correct from v")
def j3_zip_claims(spark, sf):
    v = frame(spark, sf, "v")
    return O.zip_claims(v.select("image_id", "claim_id", "content_type"), v.select("image_id", "claim_id", "capability"), v.select("image_id", "claim_id", "is_correct"))


@query(f"{M} select claim_id, failed, failure_id from m")
def j4_p22_match_failure(spark, sf):
    return matched(spark, sf).select("claim_id", "failed", "failure_id")


WEIGHT = f"case k {' '.join(f'when {chr(39)}{x}{chr(39)} then {(i + 2) ** 2}' for i, x in enumerate(T.FAILURE_PRIORITY))} else 1 end"
R1 = f"""{M}, key1 as (select image_id, k from b where k not in ('null', 'model_limitation')),
key2 as (select distinct image_id, failure_reason k from m where failed and failure_reason is not null and failure_reason <> 'model_limitation' and image_id not in (select image_id from key1)),
ks as (select * from key1 union all select * from key2), r1 as (select image_id, arg_min(k, (-ln({U.format("'5', image_id, k")}) / ({WEIGHT}), k)) failure_key from ks group by 1)"""


def sampled(spark, sf, m=None) -> DataFrame:
    i = O.image_failures(matched(spark, sf) if m is None else m)
    return S.sample_failure_keys(i.where("failed_claims > 0"), seed=5)


@query(f"{R1} select image_id, failure_key from r1")
def r1_sample_failure_keys(spark, sf):
    return sampled(spark, sf)


PIPES = f"pipes(failure_key, pipeline_type, pipeline_name) as (values {values(R.PIPELINE_MAP)})"


def flagship(spark, sf) -> DataFrame:
    drawn = S.with_failure_key(images(spark, sf).where("failed_claims > 0"), seed=5)
    out = R.to_pipeline(drawn, R.pipeline_map(spark)).select("image_id", "total_claims", "failed_claims", "success_rate", O.breakdown_text(F.col("failure_breakdown")).alias("breakdown"), "failure_key", "pipeline_type", "pipeline_name")
    return S.running_index(out, "image_id")


@query(f"{R1}, {PIPES} select a.image_id, total_claims, failed_claims, success_rate, breakdown, failure_key, coalesce(pipeline_type, 'unknown') pipeline_type, coalesce(pipeline_name, 'unknown') pipeline_name, row_number() over (order by a.image_id) - 1 sample_index from a join {BREAKDOWN} using (image_id) join r1 using (image_id) left join pipes using (failure_key)")
def flagship_j4_a1_r1_j5_w1(spark, sf):
    return flagship(spark, sf)


@query(f"{R1} select r1.image_id, failure_key, arg_min(claim_id, pos) claim_id, min(pos) pos from r1 join m on m.image_id = r1.image_id and coalesce(m.failure_id, m.failure_reason) = failure_key where failed group by 1, 2")
def j6_first_verification(spark, sf):
    m = matched(spark, sf)
    return O.first_verification(sampled(spark, sf, m), m)


@query(f"{cte('v')}, t as (select claim_id, original_template, concat('val', pos) val from v where pos % 4 = 0) select f.claim_id, coalesce(t.val, x.val) val from v f left join t using (claim_id) left join (select original_template, arg_min(val, claim_id) val from t group by 1) x on x.original_template = f.original_template where f.is_correct = false")
def j7_template_of(spark, sf):
    v = frame(spark, sf, "v")
    t = v.where("pos % 4 = 0").select("claim_id", "original_template", F.concat(F.lit("val"), F.col("pos").cast("string")).alias("filled_values"))
    return O.template_of(v.where("is_correct = false").select("claim_id", "original_template"), t).select("claim_id", F.col("filled_values").alias("val"))


@query(f"{M}, {FACTORS} select claim_id, string_agg(factor, ',' order by p) factors from m join f using (failure_id) where failed group by 1")
def j8_suggested_factors(spark, sf):
    return O.suggested_factors(matched(spark, sf), factor_reasons(spark)).select("claim_id", F.array_join("suggested_filtering_factors", ",").alias("factors"))


@query(f"{cte('v')}, c as (select pos, pos % 2 = 0 ans, pos % 3 > 0 rel, is_correct jc, failure_reason jr from v) select pos, case when not ans and rel then null when not rel then false else coalesce(jc, true) end is_correct, case when not ans and not rel then true when ans and not rel then false end not_related_judgment_correct, not ans and rel skipped, case when ans and not rel then coalesce(jr, 'reasoning_error') when ans and rel and not coalesce(jc, true) then jr end failure_reason from c")
def p23_decide_verification(spark, sf):
    v = frame(spark, sf, "v").select("pos", (F.col("pos") % 2 == 0).alias("answerable"), (F.col("pos") % 3 > 0).alias("is_related"), F.col("is_correct").alias("judge_correct"), F.col("failure_reason").alias("judge_reason"))
    return O.decide_verification(v).select("pos", "is_correct", "not_related_judgment_correct", "skipped", "failure_reason")


@query(f"{cte('responses')} select doc_id, case when error is null then 'ok' when lower(error) like '%connection%' then 'skipped' else 'failed' end status, case when error is null then null when lower(error) like '%connection%' then 'model_connection_error' else 'model_limitation' end failure_reason from responses")
def p24_f35_error_status(spark, sf):
    return O.error_status(frame(spark, sf, "responses")).select("doc_id", "status", "failure_reason")


@query(f"{cte('v')} select pos, case when pos % 3 > 0 then original_template when pos % 2 = 0 then 'NOT_RELATED' else 'not related' end completed_claim from v")
def p25_complete_claim(spark, sf):
    v = frame(spark, sf, "v").select("pos", F.col("original_template").alias("completed_claim"), (F.col("pos") % 3 > 0).alias("is_related"), F.when(F.col("pos") % 2 == 0, F.array(F.lit("yes"), F.lit("NOT_RELATED"))).otherwise(F.array(F.lit("yes"))).alias("expected_outputs"))
    return O.complete_claim(v).select("pos", "completed_claim")


@query("select doc_id, case doc_id % 5 when 0 then 'true' when 1 then 'false' when 2 then 'true' when 3 then 'false' else 'maybe ' || doc_id end prediction from documents")
def p26_normalize_prediction(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    m = F.col("doc_id") % 5
    text = F.when(m == 0, '{"prediction": "Yes"}').when(m == 1, " Incorrect ").when(m == 2, "TRUE").when(m == 3, '{"answer": "no"}').otherwise(F.concat(F.lit(" maybe "), F.col("doc_id").cast("string")))
    return d.select("doc_id", O.normalize_prediction(text).alias("prediction"))


@query(f"{M} select image_id, failed_claims from a where failed_claims > 0")
def p27_failed_images(spark, sf):
    return O.failed_images(images(spark, sf)).select("image_id", "failed_claims")


@query(f"select o_orderkey from (select o_orderkey, {U.format(chr(39) + '3' + chr(39) + ', o_orderkey')} x from orders) order by x, o_orderkey limit 100")
def s5_sample_rows(spark, sf):
    return S.sample_rows(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"), 100, "o_orderkey", seed=3)


@query(f"select o_orderkey from (select o_orderkey, {U.format(chr(39) + '3' + chr(39) + ', o_orderkey')} x from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)) order by x, o_orderkey limit 100")
def s6_j9_u6_sample_new(spark, sf):
    seen = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.sample_new(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"), seen, 100, "o_orderkey", seed=3)


@query("select o_orderkey, (('0x' || md5(o_orderkey::varchar))::uhugeint % 12)::bigint bucket from orders")
def s7_hash_bucket(spark, sf):
    return S.hash_bucket(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"), "o_orderkey", 12)


RATIOS = {"1-URGENT": 0.3, "2-HIGH": 0.2, "5-LOW": 0.5, "9-ABSENT": 0.25}
R2 = f"""{cte('groups')}, rt(pipeline_name, ratio, pos) as (values {values([(k, v, i) for i, (k, v) in enumerate(RATIOS.items())])}),
sh as (select pipeline_name, ratio::double / {sum(RATIOS.values())} share, pos from rt), c as (select pipeline_name, count(*) available from groups group by 1),
q1 as (select *, least(greatest(1, floor(1000 * share)), available)::bigint f1 from sh join c using (pipeline_name)),
q2 as (select *, case when sum(f1) over () = 1000 then f1 else greatest(1, floor(f1 * (1000.0::double / sum(f1) over ())))::bigint end f2 from q1),
q as (select pipeline_name, available, (case when row_number() over (order by f2 desc, pos) = 1 then f2 + 1000 - sum(f2) over () else f2 end)::bigint quota from q2)"""


@query(f"{R2} select * from q")
def r2_quotas(spark, sf):
    return S.quotas(frame(spark, sf, "groups").groupBy("pipeline_name").agg(F.count(F.lit(1)).alias("available")), RATIOS, 1000)


@query(f"{R2}, o as (select pipeline_name, id, quota, row_number() over (partition by pipeline_name order by {U.format(chr(39) + '7' + chr(39) + ', id')}, id) rn from groups join q using (pipeline_name)) select pipeline_name, id from o where rn <= quota")
def r2_mix_groups(spark, sf):
    return S.mix_groups(frame(spark, sf, "groups"), RATIOS, 1000, "id", seed=7).select("pipeline_name", "id")


@query(f"{R2}, o as (select pipeline_name, id, quota, row_number() over (partition by pipeline_name order by {U.format(chr(39) + '7' + chr(39) + ', id')}, id) rn from groups join q using (pipeline_name)), s as (select pipeline_name, count(*) n from o where rn <= quota group by 1) select pipeline_name, n, round(n / sum(n) over (), 6) share from s")
def a12_k4_u2_mixed_shares(spark, sf):
    from pyspark.sql import Window

    mixed = S.mix_groups(frame(spark, sf, "groups"), RATIOS, 1000, "id", seed=7).groupBy("pipeline_name").agg(F.count(F.lit(1)).alias("n"))
    return mixed.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"select o_orderkey, case when {U.format(chr(39) + '1' + chr(39) + ', o_orderkey')} < 0.7 then 'multiple_choice' else 'fill_in_blank' end question_type, case when {U.format(chr(39) + '2' + chr(39) + ', o_orderkey')} < 0.8 then 'train' else 'test' end split, (floor({U.format(chr(39) + '4' + chr(39) + ', o_orderkey')} * 3) + 2)::int n_wrong from orders")
def r4_r6_r8_seeded_choices(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    return S.wrong_option_count(S.train_test(S.question_type(o, "o_orderkey", seed=1), "o_orderkey", seed=2), "o_orderkey", seed=4)


@query(f"select c_custkey, coalesce((select string_agg(s, ',' order by p) from (select unnest(['region', 'style', 'scope']) s, unnest([1, 2, 3]) p) where {U.format(chr(39) + '6' + chr(39) + ', c_custkey, s')} < 0.5), '') slots from customer")
def r5_optional_slots(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.array(F.lit("region"), F.lit("style"), F.lit("scope")).alias("optional_slots"))
    return S.keep_optional_slots(c, "c_custkey", seed=6).select("c_custkey", F.array_join("optional_slots", ",").alias("slots"))


@query(f"select o_orderkey, row_number() over (order by {U.format(chr(39) + '8' + chr(39) + ', o_orderkey')}, o_orderkey) place from orders")
def r7_shuffled_places(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    return S.numbered(o.withColumn("x", u(8, "o_orderkey")), ["x", "o_orderkey"], "place").drop("x")


@query(f"with i as (select unnest(range((select count(*) from customer))) id), n as (select id, floor({U.format(chr(39) + '2' + chr(39) + ', id')} * 5) + 1 n from i), f as (select id, n, 'factor ' || k f, {U.format(chr(39) + '3' + chr(39) + ', id, ' + chr(39) + 'factor ' + chr(39) + ' || k')} x from n, range(12) t(k)), r as (select *, row_number() over (partition by id order by x, f) rk from f) select 'img_' || id image_id, string_agg(f, ',' order by rk) factors from r where rk <= n group by id")
def r9_synthetic_annotations(spark, sf):
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    return S.synthetic_annotations(spark, n, [f"factor {i}" for i in range(12)], seed=2).select("image_id", F.array_join("filter_factor_texts", ",").alias("factors"))


@query(f"with o as (select p_partkey, unnest([p_brand, p_type, p_container, p_name]) t from (select p_partkey, p_brand, p_type, p_size::varchar p_container, p_name from part)), r as (select *, row_number() over (partition by p_partkey order by {U.format(chr(39) + '9' + chr(39) + ', p_partkey, t')}, t) n from o) select p_partkey, string_agg(chr((64 + n)::int) || '=' || t, ';' order by n) options, chr((64 + min(n) filter (where t = (select p_brand from part p where p.p_partkey = r.p_partkey)))::int) answer_letter from r group by 1")
def w4_letter_options(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.array("p_brand", "p_type", F.col("p_size").cast("string"), "p_name").alias("options"), F.col("p_brand").alias("answer_text"))
    return S.letter_options(p, "p_partkey", seed=9).select("p_partkey", F.array_join(F.transform("lettered", lambda x: F.concat_ws("=", x["letter"], x["text"])), ";").alias("options"), "answer_letter")


@query(f"{cte('v')} select claim_id, row_number() over (order by pos) + 9 sample_index from v where is_correct = false")
def w1_kept_index(spark, sf):
    return S.running_index(frame(spark, sf, "v"), "pos", 10, F.coalesce(~F.col("is_correct"), F.lit(False))).select("claim_id", "sample_index")


@query(f"{cte('v')}, n as (select claim_id, is_correct, row_number() over (order by pos) + 9 sample_index from v) select claim_id, sample_index from n where is_correct = false")
def w2_position_index(spark, sf):
    return S.running_index(frame(spark, sf, "v"), "pos", 10).where("is_correct = false").select("claim_id", "sample_index")


@query("select distinct round_even(i * ((select count(*) from orders) - 1) / 10.0, 0)::bigint idx from range(11) t(i)")
def w5_uniform_indices(spark, sf):
    return S.uniform_indices(spark, spark.read.parquet(f"{sf}/orders.parquet").count(), 11)


@query(f"{cte('batches')}, g as (select *, sum(case when hits > 0 then 1 else 0 end) over (order by batch) blk from batches) select batch, hits, sum(case when hits > 0 then 0 else 1 end) over (partition by blk order by batch)::bigint run from g")
def w6_empty_runs(spark, sf):
    return S.empty_runs(frame(spark, sf, "batches"))


@query("with n as (select o_orderkey, row_number() over (order by o_orderkey) n, count(*) over () c from orders) select o_orderkey, ((n - 1) // 64 + 1)::bigint batch, ((n - 1) % 7)::bigint robin, least((n - 1) // greatest(1, c // 6), 5)::bigint part from n")
def w7_w8_w12_splits(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    a = S.batch_number(o, "o_orderkey", 64)
    b = S.round_robin(o, "o_orderkey", 7).withColumnRenamed("part", "robin")
    return a.join(b, "o_orderkey").join(S.contiguous_parts(o, "o_orderkey", 6), "o_orderkey")


@query("select i \"group\", ((select count(*) from orders) // 7 + case when i < (select count(*) from orders) % 7 then 1 else 0 end)::bigint quota from range(7) t(i)")
def w9_quota_split(spark, sf):
    return S.quota_split(spark, spark.read.parquet(f"{sf}/orders.parquet").count(), 7)


@query(f"{cte('v')} select claim_id, image_id || case when row_number() over (partition by image_id order by pos) = 1 then '' else '_' || (row_number() over (partition by image_id order by pos) - 1) end as name from v")
def w10_k12_unique_names(spark, sf):
    return S.unique_names(frame(spark, sf, "v"), "image_id", "pos").select("claim_id", "name")


@query(f"{cte('batches')}, g as (select *, sum(hits) over (order by batch) - hits b4 from batches) select batch, hits from g where b4 < 40")
def w11_x3_until_target(spark, sf):
    return S.until_target(frame(spark, sf, "batches"), 40)


@query(f"{cte('work')} select sample_index, coalesce(case when pipeline_type in ('object_counting', 'question') then pipeline_type end, pipeline_name, case when lower(pipeline_type) like '%object counting%' then 'object_counting' when lower(pipeline_type) like '%caption%' then 'caption' end) pipeline from work")
def p34_resolve_pipeline(spark, sf):
    known = [p for _, p, _ in R.PIPELINE_MAP]
    return frame(spark, sf, "work").select("sample_index", R.resolve_pipeline([F.col("pipeline_type"), F.col("pipeline_name")], F.col("pipeline_type"), known).alias("pipeline"))


@query(f"{cte('work')}, {PIPES}, r as (select sample_index, coalesce(case when pipeline_type in ('object_counting', 'question') then pipeline_type end, pipeline_name, case when lower(pipeline_type) like '%object counting%' then 'object_counting' when lower(pipeline_type) like '%caption%' then 'caption' end) pipeline from work) select * from r where pipeline is not null union all select sample_index, p from r, (select distinct pipeline_type p from pipes) where pipeline is null")
def j11_fan_out(spark, sf):
    known = sorted({p for _, p, _ in R.PIPELINE_MAP})
    rows = frame(spark, sf, "work").select("sample_index", R.resolve_pipeline([F.col("pipeline_type"), F.col("pipeline_name")], F.col("pipeline_type"), known).alias("pipeline"))
    return R.fan_out(rows, spark.createDataFrame([(k,) for k in known], "key string"))


@query(f"{cte('work')} select sample_index, sample_index % 2 = 0 failed, case when sample_index % 3 > 0 then 'question ' || sample_index end question from work")
def j12_error_questions(spark, sf):
    """All records, with whether they failed; one in three has no question."""
    w = frame(spark, sf, "work").select("sample_index", F.concat(F.lit("t"), F.col("sample_index").cast("string")).alias("trace_id"), F.lit("p").alias("pipeline_name"), (F.col("sample_index") % 2 == 0).alias("failed"))
    questions = w.where("sample_index % 3 > 0").withColumn("question", F.concat(F.lit("question "), F.col("sample_index").cast("string")))
    return R.error_questions(w, questions).select("sample_index", "failed", "question")


@query("select o_orderkey, o_orderpriority pipeline_name from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def p63_p66_select_pipelines(spark, sf):
    return R.select_pipelines(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("pipeline_name")), ["1-URGENT", "2-HIGH"])


@query("select c_custkey, case c_custkey % 3 when 0 then c_name when 1 then 'seg/' || c_mktsegment end path, coalesce(case when c_custkey % 4 = 0 then c_custkey end, try_cast(case when c_custkey % 2 = 0 then c_custkey::varchar else c_name end as bigint), 0 - c_custkey) id from customer")
def p53_p54_path_and_id(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    m = F.col("c_custkey") % 3
    c = c.withColumn("image_path", F.when(m == 0, F.col("c_name")).otherwise(" ")).withColumn("metadata", F.when(m == 1, F.create_map(F.lit("file_path"), F.concat(F.lit("seg/"), F.col("c_mktsegment")))).otherwise(F.create_map().cast("map<string,string>")))
    image = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_name"))
    return c.select("c_custkey", R.image_path(c).alias("path"), R.record_id(F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey")), image, -F.col("c_custkey")).alias("id"))


@query("""with f(failure_id, factor_id, kind, pos) as (values ('FR_A', 'a1', 'balance', 0), ('FR_A', 'a2', 'segment', 0), ('FR_B', 'b1', 'balance', 1), ('FR_C', 'c1', 'segment', 2), ('FR_C', 'c2', 'nation', 2)),
  x as (select c_custkey image_id, f.* from customer, f where (kind = 'balance' and c_acctbal > 3000) or (kind = 'segment' and c_mktsegment < 'C')),
  p as (select c_custkey image_id, f.* from customer, f where kind <> 'nation'),
  n as (select image_id, failure_id, pos, count(*) n from x group by 1, 2, 3), t as (select *, row_number() over (partition by image_id order by n desc, pos) rk from n),
  c as (select image_id, failure_id from t where rk <= 2), g as (select image_id, failure_id, string_agg(distinct factor_id, '+' order by factor_id) passed from p join c using (image_id, failure_id) where image_id % 3 > 0 or factor_id <> 'a1' group by 1, 2),
  tr(failure_id, ty) as (values ('FR_A', 'x'), ('FR_B', 'x'), ('FR_B', 'y'))
  select image_id, string_agg(failure_id || ':' || passed, ';' order by failure_id) matched, coalesce((select string_agg(distinct ty, ',' order by ty) from g g2 join tr using (failure_id) where g2.image_id = g.image_id), '') trigger_types from g group by 1""")
def c7_t1_p60_p61_j16_j17_route(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("image_id"), "c_acctbal", "c_mktsegment")
    f = spark.createDataFrame([("FR_A", "a1", "balance", 0), ("FR_A", "a2", "segment", 0), ("FR_B", "b1", "balance", 1), ("FR_C", "c1", "segment", 2), ("FR_C", "c2", "nation", 2)], "failure_id string, factor_id string, kind string, pos int")
    t = spark.createDataFrame([("FR_A", "x"), ("FR_B", "x"), ("FR_B", "y")], "failure_id string, trigger_type string")
    out = R.route(c, f, {"balance": F.col("c_acctbal") > 3000, "segment": F.col("c_mktsegment") < "C"}, (F.col("image_id") % 3 > 0) | (F.col("factor_id") != "a1"), t, 2)
    text = F.array_join(F.transform("matched", lambda x: F.concat_ws(":", x["failure_id"], F.array_join(x["passed_factors"], "+"))), ";")
    return out.select("image_id", text.alias("matched"), F.array_join("trigger_types", ",").alias("trigger_types"))
