"""Queries over texts: claims, conversations, questions and answers, model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import media as M
from faultline.functions import text as T
from faultline.operators import claims as C
from faultline.operators import conversation as V
from faultline.operators import modelcall as L
from faultline.operators import qa as Q
from faultline.operators import routing as R
from faultline.plans.failure_queries import U
from faultline.plans.fixtures import cte, frame
from faultline.sources import sinks
from faultline.sources import tables as S
from faultline.sources.shared import new_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def qa(spark, sf):
    return frame(spark, sf, "qa").withColumn("options", F.create_map(F.lit("A"), "oa", F.lit("B"), "ob", F.lit("C"), "oc"))


def turns(spark, sf):
    """Conversations as arrays: id, turns (from, value) and number of media."""
    rows = frame(spark, sf, "turns").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value")))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("raw"), (1 + F.col("conv_id") % 2).cast("int").alias("media"))


def shown(c):
    """Turns as text."""
    return F.array_join(F.transform(c, lambda t: F.concat_ws(":", t["role"], t["content"])), "|")


T0 = f"{cte('turns')}, n as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 i, case when role in ('user', 'human') then 'user' when role in ('gpt', 'assistant') then 'assistant' else role end r, coalesce(text, '') c, 1 + conv_id % 2 media from turns)"
INJ = f"{T0}, x as (select conv_id, i, r, media, case when i = 0 and r = 'user' and not contains(c, '<image>') then repeat('<image>', media::int) || chr(10) || ltrim(c, chr(10)) else c end c from n)"


@query(f"{T0} select conv_id, string_agg(r || ':' || c, '|' order by i) turns from n where r <> 'system' group by 1")
def p2_p3_normalize_turns(spark, sf):
    return turns(spark, sf).select("conv_id", shown(V.drop_system(V.normalize_turns(F.col("raw")))).alias("turns")).where("turns <> ''")


@query(f"{INJ} select conv_id, string_agg(r || ':' || c, '|' order by i) turns from x group by 1")
def p4_inject_tokens(spark, sf):
    return turns(spark, sf).select("conv_id", shown(V.inject_tokens(V.normalize_turns(F.col("raw")), F.col("media"))).alias("turns"))


@query(f"{INJ}, f as (select conv_id, min(media) media, list(r order by i) rs, list(c order by i) cs, bool_and(r in ('user', 'assistant') and trim(c, ' ' || chr(10) || chr(9)) <> '') ok from x where r <> 'system' group by 1) select conv_id, case when len(rs) < 2 then 'fewer than two turns' when rs[1] <> 'user' then 'first turn is not the user''s' when rs[2] <> 'assistant' then 'second turn is not the assistant''s' end shape, ok turns_ok, (len(cs[1]) - len(replace(cs[1], '<image>', ''))) // 7 = media and contains(cs[1], '<image>') media_ok from f")
def p6_p7_p8_check_turns(spark, sf):
    some = turns(spark, sf).where(F.exists("raw", lambda x: x["from"] != "system"))
    t = some.select("conv_id", V.drop_system(V.inject_tokens(V.normalize_turns(F.col("raw")), F.col("media"))).alias("t"), "media")
    return t.select("conv_id", V.shape_reason(F.col("t")).alias("shape"), V.turns_ok(F.col("t")).alias("turns_ok"), V.media_ok(F.col("t"), F.col("media")).alias("media_ok"))


@query("select item_id, '0_image:' || strlen(text) || ',1_image:1' media from benchmark")
def p9_media_list(spark, sf):
    d = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.array(F.struct(F.encode("text", "UTF-8").alias("bytes")), F.struct(F.encode(F.lit("x"), "UTF-8").alias("bytes"))).alias("m"))
    return V.media_list(d, "m").select("item_id", F.array_join(F.transform("media", lambda x: F.concat_ws(":", x["name"], F.octet_length(x["bytes"]).cast("string"))), ",").alias("media"))


CLEAN = "trim({0}, ' ' || chr(10) || chr(9))"
QA = f"""{cte('qa')}, s as (select *, trim(coalesce(full_question, question)) q0, trim(answer) a0, case upper(trim(answer)) when 'A' then trim(oa) when 'B' then trim(ob) when 'C' then trim(oc) end opt from qa),
c as (select *, q0 q, case when a0 = '' then '' else case when opt is not null and opt <> '' then upper(a0) || '. ' || opt else a0 end || case when explanation is not null then chr(10) || chr(10) || 'Explanation: ' || explanation else '' end end a from s),
k as (select *, case when image_base64 is null then 'no_image' when image_base64 = '***' then 'image_decode_fail' when q = '' then 'empty_question' when a = '' then 'empty_answer' end reject_reason from c)"""


def classified(spark, sf):
    return V.classify(V.qa_conversation(qa(spark, sf)))


@query(f"{QA} select id, q, a, reject_reason from k")
def p5_p10_p11_p12_f21_convert(spark, sf):
    return classified(spark, sf).select("id", "q", "a", "reject_reason")


@query(f"{QA}, n as (select coalesce(reject_reason, 'success') reason, count(*) n from k group by 1) select reason, n, round(100.0 * n / sum(n) over (), 6) percent from n")
def a11_conversion_stats(spark, sf):
    return V.conversion_stats(classified(spark, sf))


@query(f"{QA} select id, reject_reason from k where reject_reason is not null")
def k8_error_log(spark, sf):
    return V.error_log(classified(spark, sf), "id")


@query(f"{cte('qa')}, f as (select * from qa order by id limit 100) select id, array_to_string(list_filter([case when image_base64 is null then 'no_image' end, case when answer = '' then 'empty_answer' end], lambda x: x is not null), ',') issues from f where image_base64 is null or answer = ''")
def p13_diagnose(spark, sf):
    return V.diagnose(qa(spark, sf), "id").select("id", F.array_join("issues", ",").alias("issues"))


@query("select n_nationkey, n_name from nation where n_nationkey in (1, 3, 5) or n_name in ('FRANCE', 'nation_7', 'NATION_7')")
def p14_enabled(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").withColumn("claim_id", F.col("n_nationkey").cast("string")).withColumn("name", F.col("n_name"))
    return C.enabled(n, ["1", "3", "5"], ["FRANCE", "nation_7", "NATION_7"]).select("n_nationkey", "n_name")


TEMPLATES = """select p_partkey, case when p_partkey % 3 = 0 then 'The [OBJECT] is left of {{COLOR}} and [OBJECT]' when p_partkey % 3 = 1 then 'How many [ITEM] are there' else concat('A plain ', p_name) end as t from {part}"""
PLACEHOLDERS = "case when p_partkey % 3 = 0 then 'COLOR,OBJECT' when p_partkey % 3 = 1 then 'ITEM' else '' end"


def templates(spark, sf):
    t = spark.sql(TEMPLATES, part=spark.read.parquet(f"{sf}/part.parquet"))
    none = F.create_map().cast("map<string,string>")
    return t.select(
        "p_partkey", F.lit(None).cast("string").alias("claim_id"), F.concat(F.lit("img_"), F.col("p_partkey") % 9).alias("image_id"), F.col("p_partkey").alias("pos"), F.lit(None).cast("string").alias("claim_template"), F.col("t").alias("text"),
        F.when(F.col("p_partkey") % 2 == 0, "OBJECT").alias("prefill_slots"), F.when(F.col("p_partkey") % 4 < 2, F.create_map(F.lit("OBJECT"), F.lit("noun"), F.lit("SIZE"), F.lit("adj"))).otherwise(none).alias("slots"),
        F.when(F.col("p_partkey") % 5 > 0, F.create_map(F.lit("OBJECT"), F.lit(" red car "), F.lit("COLOR"), F.lit(" "))).otherwise(none).alias("prefilled"), F.create_map(F.lit("SIZE"), F.lit("big")).alias("filled_values"),
    )


@query(f"with t as ({TEMPLATES.format(part='part')}) select p_partkey, 'img_' || (p_partkey % 9) || '_template_' || p_partkey claim_id, t template_text, case when p_partkey % 2 = 0 then 1 else 0 end n_prefill, case when p_partkey % 4 < 2 then case when p_partkey % 3 = 0 then 'OBJECT' else 'OBJECT,SIZE' end else {PLACEHOLDERS} end placeholders from t")
def p15_p16_f1_u5_templates(spark, sf):
    t = C.normalize_schema(C.normalize_templates(templates(spark, sf)))
    return t.select("p_partkey", "claim_id", "template_text", F.size("prefill_slots").alias("n_prefill"), F.array_join("placeholders", ",").alias("placeholders"))


@query(f"with t as ({TEMPLATES.format(part='part')}) select p_partkey, case when p_partkey % 5 > 0 then replace(t, '[OBJECT]', ' red car ') else t end template_text, t original_template, case when p_partkey % 5 > 0 then 'OBJECT= red car ;SIZE=big' else 'SIZE=big' end filled, case when p_partkey % 4 >= 2 then '' when p_partkey % 5 > 0 then 'SIZE' else 'OBJECT,SIZE' end slots from t")
def p18_apply_prefill(spark, sf):
    t = C.apply_prefill(C.normalize_schema(C.normalize_templates(templates(spark, sf))))
    filled = F.array_join(F.transform(F.array_sort(F.map_entries("filled_values")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return t.select("p_partkey", "template_text", "original_template", filled.alias("filled"), F.array_join(F.array_sort(F.map_keys("slots")), ",").alias("slots"))


@query("select 'img_' || c_custkey image_id, 'img_' || c_custkey || '_claim_0' claim_id, 'There are many ' || c_mktsegment claim_text, case when contains(lower(c_mktsegment), 'is') then 'action' else 'object' end content_type from customer union all select 'img_' || c_custkey, 'img_' || c_custkey || '_claim_1', 'how many ' || c_name, 'count' from customer")
def p17_f2_predefined_claims(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("img_"), "c_custkey").alias("image_id"), F.array(F.concat(F.lit("There are many "), "c_mktsegment"), F.concat(F.lit("how many "), "c_name")).alias("claims"))
    return C.predefined_claims(c).select("image_id", "claim_id", "claim_text", "content_type")


@query(f"{cte('work')}, k as (select sample_index, image_id, coalesce(object_value, ' ') ov, case when sample_index % 4 = 0 then null else relevant end rel, c_name from work) select sample_index, coalesce(rel, true) and trim(ov) <> '' kept, case when trim(ov) <> '' then trim(ov) else c_name end target from k")
def p19_p21_prefill_rules(spark, sf):
    w = frame(spark, sf, "work").withColumn("values", F.create_map(F.lit("OBJECT"), F.coalesce("object_value", F.lit(" "))))
    rel = F.when(F.col("sample_index") % 4 != 0, F.col("relevant"))
    both = F.create_map(F.lit("OBJECT"), F.coalesce("object_value", F.lit(" ")), F.lit("zz"), F.col("c_name"))
    return w.select("sample_index", C.keep_prefill(rel, F.col("values")).alias("kept"), C.target_object(both).alias("target"))


@query(f"{cte('v')}, x as (select image_id, substr(image_id, 5)::bigint i, pos from v), y as (select image_id, bool_or(not (pos % 2 > 0 or i % 3 = 0) or (pos % 7 = 0 and i % 2 = 0)) usable from x group by 1) select image_id, not usable skipped, case when not usable then 'prefill_no_object' end skip_reason from y")
def p20_k7_skipped_images(spark, sf):
    i = F.substring("image_id", 5, 20).cast("long")
    v = frame(spark, sf, "v").select("image_id", ((F.col("pos") % 2 != 0) | (i % 3 == 0)).alias("needs_prefill"), ((F.col("pos") % 7 == 0) & (i % 2 == 0)).alias("kept"))
    return C.skipped_images(v)


@query(f"{cte('work')} select sample_index, case when coalesce(trim(claim), '') = '' then null else trim(claim) end claim, coalesce(trim(object_value), '') object, case when coalesce(trim(object_value), '') <> '' then 'object' when coalesce(trim(claim), '') <> '' then 'claim' end source from work")
def p31_p32_resolve_prefill(spark, sf):
    w = frame(spark, sf, "work").withColumn("prefilled_values", F.when(F.col("object_value").isNotNull(), F.create_map(F.lit("OBJECT"), "object_value"))).withColumn("target_object", F.lit(" "))
    return C.resolve_prefill_by_object(C.resolve_prefill(w)).select("sample_index", "claim", "object", "source")


@query(f"{cte('work')} select sample_index, case when trim(claim) <> '' then trim(claim) end claim, case when claim is null or trim(claim) = '' then 'named ' || sample_index end object from work")
def p33_claim_first_prefill(spark, sf):
    w = frame(spark, sf, "work")
    claim = F.nullif(T.clean_text(F.col("claim")), F.lit(""))
    answer = F.concat(F.lit("Name: named "), F.col("sample_index").cast("string"), F.lit("\nCategory: x"))
    return w.select("sample_index", claim.alias("claim"), F.when(claim.isNull(), T.parse_named(answer, "name")).alias("object"))


@query(f"{cte('work')} select sample_index, case when trim(c_name) = '' then 'c_name' when coalesce(trim(claim), '') = '' then 'claim' when coalesce(trim(object_value), '') = '' then 'object_value' end error_stage from work")
def p30_input_error(spark, sf):
    return Q.input_error(frame(spark, sf, "work"), ["c_name", "claim", "object_value"]).select("sample_index", "error_stage")


@query("select item_id, 'data' kind, length(text) > 50 has_payload from benchmark")
def p35_payload(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    b = b.withColumn("p", R.payload(b.withColumn("x", F.lit("short")), (F.concat(F.lit("data:image/png;base64,"), F.when(F.length("text") > 50, F.col("text"))),)))
    return b.select("item_id", F.lit("data").alias("kind"), (F.col("p") == F.col("text")).alias("has_payload")).withColumn("has_payload", F.coalesce("has_payload", F.lit(False)))


@query(f"{cte('work')} select sample_index, case when coalesce(trim(object_value), '') = '' then 'object' else '' end missing from work")
def p36_missing_slots(spark, sf):
    w = frame(spark, sf, "work").withColumn("v", F.create_map(F.lit("object"), "object_value", F.lit("other"), F.lit("x")))
    return w.select("sample_index", F.array_join(Q.missing_slots(F.array(F.lit("object"), F.lit("other")), F.col("v")), ",").alias("missing"))


@query(f"select c_custkey, 'center' region, ['descriptive', 'concise'][(floor({U.format(chr(39) + '3' + chr(39) + ', c_custkey, ' + chr(39) + 'caption_style' + chr(39))} * 2) + 1)::int] style from customer")
def p37_default_slots(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", Q.default_slot(F.lit("region"), F.col("c_custkey"), 3).alias("region"), Q.default_slot(F.lit("caption_style"), F.col("c_custkey"), 3).alias("style"))


@query(f"{cte('qa')} select id, case when contains(lower(question), 'if') then 'hypothetical' else '' end forbidden, true present from qa")
def p28_p29_question_checks(spark, sf):
    q = qa(spark, sf)
    return q.select("id", F.array_join(Q.forbidden_types(F.col("question"), ["hypothetical", "commonsense_only"]), ",").alias("forbidden"), Q.question_present(F.col("question"), F.col("pipeline_name")).alias("present"))


@query(f"{cte('qa')} select id, case when contains(question, '[object]') then 'question' else '' end issues, case when lower(trim(oa)) = lower(trim(ob)) then 'duplicate' else '' end option_issues, concat_ws(',', case when answer = '' then 'empty' end, case when answer <> '' and answer not in ('A', 'B', 'C') then 'no_option' end, case when answer <> correct_option then 'differs' end) answer_issues, question_type = 'fill_in_blank' and answer = '' blank from qa")
def p38_p39_p40_p43_answer_checks(spark, sf):
    q = Q.placeholder_issues(qa(spark, sf))
    return q.select("id", F.array_join("placeholder_issues", ",").alias("issues"), F.array_join(Q.option_issues(F.col("options")), ",").alias("option_issues"), F.array_join(Q.answer_issues(F.col("answer"), F.col("correct_option"), F.col("options")), ",").alias("answer_issues"), Q.fill_in_blank_empty(q).alias("blank"))


@query(f"{cte('qa')} select id, case when answer in ('A', 'C') then answer when correct_option is not null then correct_option else answer end answer, case when answer in ('A', 'C') then answer else correct_option end correct_option, answer in ('A', 'C') or correct_option is not null repaired from qa")
def p41_repair_answer(spark, sf):
    return Q.repair_answer(qa(spark, sf)).select("id", "answer", "correct_option", "repaired")


@query(f"{cte('qa')} select id, case when id % 2 = 0 then 'ans ' || id else answer end answer, coalesce(explanation, case when id % 2 = 0 then 'so' end) explanation from qa")
def p42_unwrap_answer(spark, sf):
    q = qa(spark, sf)
    wrapped = F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"Answer": "ans '), F.col("id").cast("string"), F.lit('", "explanation": "so"}'))).otherwise(F.col("answer"))
    return Q.unwrap_answer(q.withColumn("answer", wrapped)).select("id", "answer", "explanation")


DECIDE = f"""{cte('scores')}, p as (select *, is_correct and confidence >= 0.7 cp, is_valid and n_issues = 0 vp from scores),
d as (select doc_id, case when cp and vp and not confidence_unparsed and not validation_unparsed then 'strict' when not confidence_unparsed and not validation_unparsed and confidence >= 0.5 and confidence < 0.7 and is_correct and is_valid then 'a'
 when not confidence_unparsed and not validation_unparsed and confidence >= 0.5 and is_valid then 'b' when is_valid and confidence_unparsed then 'c' when cp and validation_unparsed then 'd'
 when not confidence_unparsed and confidence >= 0.9 and is_correct and not vp then 'e' else 'reject' end why, cp, vp from p)"""


@query(f"{DECIDE} select doc_id, cp confidence_passed, vp validation_passed, case when why in ('strict', 'reject') then why else 'rescue' end decision, case when why not in ('strict', 'reject') then why end rescue_reason from d")
def p44_p45_decide(spark, sf):
    return Q.decide(frame(spark, sf, "scores")).select("doc_id", "confidence_passed", "validation_passed", "decision", "rescue_reason")


@query(f"{DECIDE} select 'lenient' as mode, count(*) n, count(*) filter (where why <> 'reject') passed from d union all select 'strict', count(*), count(*) from d where why <> 'reject' union all select 'unchecked', count(*), count(*) from d")
def p64_acceptance_modes(spark, sf):
    d = Q.decide(frame(spark, sf, "scores"))
    one = lambda m: Q.accepted(d, m).agg(F.lit(m).alias("mode"), F.count(F.lit(1)).alias("n"), F.count_if("validation_passed").alias("passed"))
    return one("strict").unionByName(one("lenient")).unionByName(one("unchecked"))


@query(f"{DECIDE} select case when why in ('strict', 'reject') then why else 'rescue' end status, count(*) n from d group by 1")
def a14_k5_stage_counters(spark, sf):
    return Q.stage_counters(Q.decide(frame(spark, sf, "scores")), "decision").withColumnRenamed("decision", "status")


@query(f"{cte('scores')} select doc_id, round(0.4 * case when doc_id % 4 > 0 then 1 else 0 end + 0.2 * 0.5 + 0.2 * confidence + 0.2 * case when is_valid then 1 else 0 end, 3) score from scores")
def a22_composite_score(spark, sf):
    s = frame(spark, sf, "scores").withColumn("format_passed", F.col("doc_id") % 4 > 0).withColumn("clarity", F.lit(0.5)).withColumn("validation_passed", F.col("is_valid"))
    return Q.composite_score(s).select("doc_id", "score")


@query(f"{cte('qa')}, s as (select question_type, pipeline_name, id % 3 > 0 ok, (id % 11) / 10e0 score from qa) select question_type, pipeline_name, count(*) n, count(*) filter (where ok) passed, count(*) filter (where not ok) failed, round(avg(score) filter (where score > 0), 3) mean_score from s group by grouping sets ((question_type), (pipeline_name), ())")
def a13_dataset_statistics(spark, sf):
    q = qa(spark, sf).select("question_type", "pipeline_name", (F.col("id") % 3 > 0).alias("validation_passed"), ((F.col("id") % 11) / 10).alias("score"))
    return Q.dataset_statistics(q)


@query(f"{cte('qa')} select id, case when id % 3 = 0 and correct_option is not null and correct_option <> answer then correct_option else answer end answer from qa")
def p46_repair_verdict(spark, sf):
    verdict = F.when(F.col("id") % 3 == 0, "change").otherwise("KEEP")
    return qa(spark, sf).select("id", Q.repair_verdict(verdict, F.col("correct_option"), F.col("answer"), F.col("options")).alias("answer"))


@query(f"{cte('qa')} select id, concat_ws('|', case when not contains(lower(ob), lower(oa)) then trim(ob) end, case when not contains(lower(oa), oc) then oc end) options from qa")
def p47_p48_wrong_options(spark, sf):
    wrong = F.array("oa", "ob", F.col("oc"), F.upper("oa"), F.lit(" "), F.lit("null"))
    return qa(spark, sf).select("id", F.array_join(Q.valid_options(Q.clean_wrong_options(wrong, F.col("oa"))), "|").alias("options"))


@query(f"{cte('qa')} select id, case when id % 2 = 0 then oa else ob end \"text\" from (select id, oa, trim(ob) ob from qa)")
def p49_option_text(spark, sf):
    o = F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"text": "'), "oa", F.lit('"}'))).otherwise(F.col("ob"))
    return qa(spark, sf).select("id", Q.option_text(o).alias("text"))


@query(f"{cte('qa')} select id, question, coalesce(full_question, question) full_question, question_type, answer, coalesce(explanation, '') explanation, pipeline_name, id % 4 > 0 validation_passed, case when id % 4 = 0 then case when id % 8 = 0 then 'bad' else 'validation failed' end end error_reason from qa")
def p50_final_rows(spark, sf):
    q = qa(spark, sf).withColumn("decision", F.when(F.col("id") % 4 == 0, "reject").otherwise("strict")).withColumn("error", F.when(F.col("id") % 8 == 0, "bad"))
    return Q.final_rows(q)


@query("select doc_id, left(text, 500) question, left(text, 200) answer, left(text, 300) explanation, 'a,b,c' issues, 'a; b; c; d; more' reason, left(text, 20) || case when length(text) > 20 then '...' else '' end short from documents")
def p51_p52_t3_f27_details(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    issues = F.array(*[F.lit(x) for x in "abcd"])
    rows = Q.error_detail(d.select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.col("text").alias("answer"), F.col("text").alias("explanation"), issues.alias("issues")))
    return rows.join(d, F.col("id") == F.col("doc_id")).select("doc_id", "question", "answer", "explanation", F.array_join("issues", ",").alias("issues"), Q.regeneration(issues, [F.lit("more")])[1].alias("reason"), T.truncate(F.col("text"), 20).alias("short"))


@query("select p_partkey, case when p_partkey % 2 = 0 then 'NOTE=' || p_name || ';OBJECT=' || p_brand else 'OBJECT=' || p_brand end payload from part")
def p55_prefill_payload(spark, sf):
    v = F.create_map(F.lit("object"), F.concat(F.lit("  "), "p_brand"), F.lit("note"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(" "))
    out = F.array_join(F.transform(F.array_sort(F.map_entries(C.prefill_payload(v))), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", out.alias("payload"))


@query("select p_partkey, p_name || '|' || p_type required, p_brand optional, round(case when p_size % 5 = 0 then 0 when p_size % 3 = 0 then 0.6 else 0.6 + 0.4 * (p_size % 4) / 4 end, 6) score from part")
def p56_p57_factor_scores(spark, sf):
    req, opt = Q.split_required(F.array("p_name", F.concat(F.lit("[optional] "), "p_brand"), "p_type"))
    total = F.when(F.col("p_size") % 3 == 0, 0).otherwise(4)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.array_join(req, "|").alias("required"), F.array_join(opt, "|").alias("optional"), F.round(Q.factor_score(F.col("p_size") % 5 != 0, F.col("p_size") % 4, total), 6).alias("score"))


@query("select c_custkey image_id, case when c_custkey % 4 = 0 or c_custkey % 5 = 0 or c_custkey % 3 > 0 then 0.0 else c_acctbal end score, case when c_custkey % 4 = 0 then 'No failure key' when c_custkey % 3 = 0 and c_custkey % 5 = 0 then 'call failed' end note from customer")
def p58_score_failures(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumnRenamed("c_custkey", "image_id")
    r = c.where("image_id % 3 = 0").select("image_id", F.col("c_acctbal").alias("score"), F.when(F.col("image_id") % 5 == 0, "call failed").alias("error"))
    return Q.score_failures(c.select("image_id", F.when(F.col("image_id") % 4 != 0, "k").alias("failure_key")), r).select("image_id", "score", "note")


@query("select c_custkey, coalesce(case when c_custkey % 3 > 0 then c_acctbal > 0 end, false) passed, coalesce(case when c_custkey % 2 = 0 then 0.25 end, 0.5) confidence, 'no reason given' reason, c_acctbal + case when c_custkey % 5 = 0 then 1.5 else 0.0 end total_score from customer")
def p59_filter_result(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal") > 0).alias("passed"), F.when(F.col("c_custkey") % 2 == 0, 0.25).alias("confidence"), F.lit(None).cast("string").alias("reason"), F.col("c_acctbal").alias("basic_score"), F.when(F.col("c_custkey") % 5 == 0, 1.5).alias("bonus_score"))
    return Q.filter_result(c).select("c_custkey", "passed", "confidence", "reason", "total_score")


@query("select doc_id, 'system:Choose the agents that can examine the reported failure: color, shape|user:' || text prompt from documents")
def p65_prompts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("report"), "lang")
    return R.prompts(d, ["color", "shape"]).select("doc_id", shown(F.col("prompt")).alias("prompt"))


@query("select * from (unpivot (select count(p_brand) p_brand, count(p_type) p_type, count(p_size) p_size, count(p_retailprice) p_retailprice from part) on columns(*) into name \"column\" value n)")
def p1_metadata_columns(spark, sf):
    """The columns that are left, each with its rows that have a value."""
    p = C.metadata(spark.read.parquet(f"{sf}/part.parquet"), "p_partkey", "p_name")
    counts = p.agg(*[F.count(c).alias(c) for c in p.columns])
    return counts.unpivot([], p.columns, "column", "n")


# --- parsers and scalar functions


@query(f"{cte('responses')} select doc_id, doc_id % 6 in (0, 1, 2) has_json, case when doc_id % 6 in (0, 1) then doc_id % 10 / 10e0 when doc_id % 6 = 2 then doc_id % 7 / 10e0 else 0 end confidence, case doc_id % 6 when 0 then true when 1 then true else false end is_correct, case when doc_id % 6 = 3 then doc_id % 4 = 1 end valid, case when doc_id % 6 = 3 then 'text ' || doc_id end reason, case doc_id % 6 when 0 then 'A' when 1 then 'b ' || doc_id when 2 then 'C' when 3 then 'word ' || doc_id when 4 then '{{\"is_correct\": tru' || doc_id end answer from responses".replace("{{", "{"))
def f8_f14_parse_responses(spark, sf):
    r = F.col("response")
    j = T.json_fenced(r)
    verdict = T.verdict_valid(r)
    return frame(spark, sf, "responses").select(
        "doc_id", j.isNotNull().alias("has_json"), T.parse_float(T.json_get(j, "confidence")).alias("confidence"), T.parse_bool(T.json_get(j, "is_correct")).alias("is_correct"),
        verdict.alias("valid"), F.nullif(T.verdict_reason(r), F.lit("")).alias("reason"), T.parse_answer(r).alias("answer"),
    )


@query("select p_partkey, p_brand || '|' || p_type || '|' || p_name options, case p_partkey % 4 when 0 then 3 when 1 then 3 when 2 then 3 else 3 end n, 'What is ' || p_name || '?' question, p_brand value_ from part")
def f15_f16_f17_parse_lists(spark, sf):
    k = F.col("p_partkey") % 4
    a, b, c = F.col("p_brand"), F.col("p_type"), F.col("p_name")
    text = (
        F.when(k == 0, F.concat(F.lit('["'), a, F.lit('", "'), b, F.lit('", "'), c, F.lit('"]'))).when(k == 1, F.concat(F.lit("Option 1: "), a, F.lit("\nOption 2: "), b, F.lit("\nOption 3: "), c))
        .when(k == 2, F.concat(F.lit("A: "), a, F.lit("\nB: "), b, F.lit("\nC. "), c)).otherwise(F.concat(a, F.lit("\n\n"), b, F.lit("\n"), c))
    )
    question = F.when(k == 0, F.concat(F.lit('"Question: What is '), c, F.lit('?"\nmore'))).otherwise(F.concat(F.lit("What is "), c, F.lit("?\nA: x")))
    value = F.when(k == 0, F.concat(F.lit('{"value": "'), a, F.lit('"}'))).when(k == 1, F.concat(F.lit("value: "), a)).otherwise(F.concat(a, F.lit("\nx")))
    o = T.parse_options(text)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.array_join(o, "|").alias("options"), F.size(o).alias("n"), T.clean_question(question).alias("question"), T.slot_value(value).alias("value_"))


@query("select p_partkey, p_name bare, p_name || chr(10) || 'A: ' || p_brand || chr(10) || 'B: ' || p_type full_, 'r_B1_R' || p_partkey || '_S2_Ia_b' trace, 'x' || p_partkey image, 'a_b_c' safe from part")
def f18_f19_f25_f26_f28_texts(spark, sf):
    full = T.render_full_question(F.col("p_name"), F.create_map(F.lit("B"), "p_type", F.lit("A"), "p_brand"))
    trace = T.trace_id("r", F.lit("1"), F.col("p_partkey").cast("string"), F.lit("2"), F.lit("a/b"))
    image = T.image_id_of_claim(F.concat(F.lit("x"), F.col("p_partkey").cast("string"), F.lit("_template_3")))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", T.strip_options(full).alias("bare"), full.alias("full_"), trace.alias("trace"), image.alias("image"), T.safe_name(F.lit("a/b c")).alias("safe"))


@query("""select event_id, case event_id % 4 when 0 then 'spatial' when 1 then 'count' when 2 then null else 'object' end by_capability, case event_id % 4 when 0 then 'spatial_reasoning' when 1 then 'relational_reasoning' when 2 then 'conceptual_grounding' else 'visual_grounding' end category,
  case when event_id % 4 = 3 then 'unknown' else 'visual_accuracy' end factor, case event_id % 4 when 0 then 7 when 1 then 0 else -1 end priority, case event_id % 4 when 0 then 81.0 when 1 then 4.0 else 1.0 end weight from events""")
def f3_f7_lookups(spark, sf):
    k = F.col("event_id") % 4
    cap = F.when(k == 0, "spatial_localization").when(k == 1, "object counting").when(k == 2, "concept grounding").otherwise("object recognition")
    key = F.when(k == 0, T.FAILURE_PRIORITY[7]).when(k == 1, T.FAILURE_PRIORITY[0]).otherwise("other")
    reason = F.when(k == 3, "nothing").otherwise("visual_error")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", T.content_type_from_capability(cap).alias("by_capability"), T.capability_to_category(cap).alias("category"), T.taxonomy_factor(reason).alias("factor"), T.failure_priority(key).cast("int").alias("priority"), T.failure_weight(key).alias("weight"))


@query("select doc_id, doc_id % 3 = 0 many, 'x ' || doc_id name, '0.' || (doc_id % 10) confidence, case when doc_id % 2 = 0 then 'a1,a2' else 'a1' end agents, doc_id % 2 = 0 format_ok, trim(lang) clean from documents")
def f12_f20_f32_f33_f34_parsers(spark, sf):
    d = F.col("doc_id").cast("string")
    named = F.concat(F.lit("Name: x "), d, F.lit("\nConfidence: 0."), (F.col("doc_id") % 10).cast("string"))
    even = F.col("doc_id") % 2 == 0
    sel = F.when(even, F.lit("<reasoning>r</reasoning><agent> a1 </agent><prompt>p</prompt><agent>a2</agent>")).otherwise(F.lit("<agent>a1</agent>"))
    issues = T.parse_issues(F.when(F.col("doc_id") % 3 == 0, '["a", "b"]').when(F.col("doc_id") % 3 == 1, "one"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", (F.size(issues) == 2).alias("many"), T.parse_named(named, "name").alias("name"), T.parse_named(named, "confidence").alias("confidence"), F.array_join(T.selection_part(sel, "agent"), ",").alias("agents"), T.selection_format_ok(sel).alias("format_ok"), T.clean_text(F.concat(F.lit(" "), "lang")).alias("clean"))


@query("select item_id, text, case item_id % 3 when 0 then 'jpg' when 1 then 'png' else 'jpg' end format, case item_id % 4 when 0 then 'url' when 1 then 'data_url' when 2 then 'path' else 'base64' end kind, item_id % 3 < 2 same from benchmark")
def f21_f24_s2_images(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    k = F.col("item_id") % 3
    data = F.concat(F.when(k == 0, F.unhex(F.lit("FFD8FFE0"))).when(k == 1, F.unhex(F.lit("89504E47"))).otherwise(F.unhex(F.lit(""))), F.encode("text", "UTF-8"))
    b = b.withColumn("data", data).withColumn("image_base64", F.when(k == 0, F.concat(F.lit("data:image/jpeg;base64,"), M.encode_base64(F.col("data")))).when(k == 1, M.encode_base64(F.col("data")))).withColumn("image_path", F.concat(F.lit("a/b"), F.col("item_id").cast("string")))
    r = S.resolve_payload(b)
    m = F.col("item_id") % 4
    ref = F.when(m == 0, F.lit("https://x/y.jpg")).when(m == 1, F.lit("data:image/png;base64,AAAA")).when(m == 2, F.lit("a/b.jpg")).otherwise(F.lit("QUJD" * 20))
    return r.select("item_id", "text", M.image_format(F.col("data")).alias("format"), M.image_input_kind(ref).alias("kind"), F.coalesce(F.col("image_bytes") == F.col("data"), F.lit(False)).alias("same"))


@query("select c_custkey, case when c_custkey % 2 = 0 then 'c' || c_custkey when c_custkey % 3 = 0 then 'pic' || c_custkey else 'file_' || c_custkey end id from customer")
def s3_image_ids(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey").cast("string")
    given, path = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("c"), k)), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("a/pic"), k, F.lit(".jpg")))
    return c.select("c_custkey", S.image_id(given, path, F.lit("x/file.parquet"), F.col("c_custkey")).alias("id"))


@query("select count(*) n, sum(p_partkey)::bigint s, count(*) places from part")
def s1_read_images(spark, sf):
    path = new_path(spark, "images")
    spark.read.parquet(f"{sf}/part.parquet").repartition(3).write.parquet(path)
    rows = S.read_images(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("s"), F.count_distinct("_file", "_row").alias("places"))


# --- model calls by replay


def requests(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("judge "), F.col("doc_id").cast("string")).alias("prompt"))
    return d.withColumn("request_key", L.request_key("answer_check", F.col("prompt"), F.col("doc_id")))


def responses(spark, sf):
    r = frame(spark, sf, "responses")
    key = L.request_key("answer_check", F.concat(F.lit("judge "), F.col("doc_id").cast("string")), F.col("doc_id"))
    return r.where("doc_id % 10 > 0").select(key.alias("request_key"), "response", "error", F.col("doc_id").alias("prompt_tokens"), F.lit(2).cast("long").alias("completion_tokens"))


@query(f"{cte('responses')} select doc_id, case when doc_id % 10 > 0 then length(response) end n, case when doc_id % 10 > 0 then error end error, case when doc_id % 10 > 0 then doc_id + 2 else 0 end tokens_used from responses")
def m0_j19_f36_replay(spark, sf):
    return L.replay(requests(spark, sf), responses(spark, sf)).select("doc_id", F.length("response").alias("n"), "error", "tokens_used")


@query(f"{cte('responses')} select doc_id, case when doc_id % 10 > 0 and doc_id % 6 in (0, 1) then true else false end is_correct, case when doc_id % 10 = 0 then 0 when doc_id % 6 in (0, 1) then doc_id % 10 / 10e0 when doc_id % 6 = 2 then doc_id % 7 / 10e0 else 0 end confidence from responses")
def m11_parsed_answer_checks(spark, sf):
    return L.parsed(L.replay(requests(spark, sf), responses(spark, sf)), "answer_check").select("doc_id", "is_correct", "confidence")


@query("select doc_id, case when doc_id % 10 > 0 then 'answer_check' end stage_, 'judge ' || doc_id prompt, length('judge ' || doc_id) prompt_length, left(text, 4000) response, length(text) response_length from documents")
def k13_call_log(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    r = requests(spark, sf).join(d, "doc_id").withColumn("stage", F.when(F.col("doc_id") % 10 > 0, "answer_check")).withColumn("response", F.col("text")).withColumn("error", F.lit(None).cast("string"))
    log = L.call_log(r)
    return r.select("request_key", "doc_id").join(log, "request_key").select("doc_id", F.col("stage").alias("stage_"), "prompt", "prompt_length", "response", "response_length")


@query("select item_id image_id, case when item_id % 10 = 0 then 2 when item_id % 2 = 0 then 0 else 1 end rounds, item_id % 10 > 0 accepted from benchmark")
def m13_regenerate(spark, sf):
    """Rounds of question and check: ids that end in 0 never pass, odd ones pass in the second round."""
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("image_id"))

    def caller(prompts: list[str]) -> list[str]:
        return [f"valid: {'yes' if int(p.split()[1]) % 10 and (int(p.split()[1]) % 2 == 0 or p.startswith('again')) else 'no'}\nreason: x" for p in prompts]

    def prompt(n: int):
        return F.concat(F.lit("again " if n else "first "), F.col("image_id").cast("string"))

    out = L.regenerate(rows, "question_check", prompt, F.col("valid"), caller, retries=2)
    return out.groupBy("image_id").agg(F.max("round").alias("rounds"), F.max("accepted").alias("accepted"))


@query("select distinct p_brand || ' ' || (p_size % 3) \"text\" from part")
def k11_factor_list(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.array(F.concat_ws(" ", "p_brand", (F.col("p_size") % 3).cast("string"))).alias("filter_factor_texts"))
    return sinks.factors(p)
