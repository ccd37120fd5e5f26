"""Queries over the call points of a model: prompts of table rows, responses by replay, what is read from them.

A response stands under the key of its prompt, so a row finds its response only if its prompt is the same again. One in
ten rows has none, and gets what a stage takes for a missing response.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import claims as C
from faultline.operators import failures as O
from faultline.operators import modelcall as L
from faultline.operators import qa as Q
from faultline.plans.fixtures import cte, frame

QUERIES, SQL = {}, {}
W, P = cte("work"), "from part"
K = "sample_index"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def replayed(rows, key, stage, image_id, response, error="cast(null as string)", **columns):
    """rows with the response (SQL of the row) of a stage, by its key, and what the stage reads from it."""
    asked = L.asked(rows, stage, image_id, **columns)
    table = asked.where(f"{key} % 10 > 0").select("request_key", F.expr(response).alias("response"), F.expr(error).alias("error"), F.length("prompt").cast("long").alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"))
    return L.parsed(L.replay(asked, table.dropDuplicates(["request_key"])), stage)


def work(spark, sf):
    return frame(spark, sf, "work").withColumn("text", F.concat(F.lit("claim "), F.col(K).cast("string"))).withColumn("slots", F.array(F.lit("object"), F.lit("region")))


def part(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_type", "p_size").withColumn("question", F.concat(F.lit("What is "), "p_name", F.lit("?")))


@query(f"{W} select {K}, case when {K} % 10 = 0 then null when {K} % 3 = 0 then case when {K} % 2 = 0 then 'NOT_RELATED' else 'not related' end else 'done ' || {K} end completed_claim, {K} % 10 = 0 or {K} % 3 > 0 is_related from work")
def m1_completion(spark, sf):
    response = f"""concat('Sure: {{"completed_claim": "done ', {K}, '", "is_related": ', if({K} % 3 > 0, 'true', '"no"'), '}}')"""
    rows = replayed(work(spark, sf), K, "completion", "image_id", response, template="text", slots="slots")
    rows = rows.withColumn("expected_outputs", F.when(F.col(K) % 2 == 0, F.array(F.lit("NOT_RELATED"))).otherwise(F.array(F.lit("yes"))))
    return O.complete_claim(rows).select(K, "completed_claim", "is_related")


@query(f"{W} select {K}, case when {K} % 10 > 0 then case {K} % 3 when 0 then 'true' when 1 then 'false' else 'maybe ' || {K} end end prediction from work")
def m2_prediction(spark, sf):
    response = f"""case {K} % 3 when 0 then '{{"prediction": "Yes"}}' when 1 then ' Incorrect ' else concat('maybe ', {K}) end"""
    rows = replayed(work(spark, sf), K, "prediction", "image_id", response, claim="text")
    return rows.select(K, O.normalize_prediction(F.col("prediction")).alias("prediction"))


@query(f"{W} select {K}, {K} % 10 > 0 and {K} % 4 > 0 and {K} % 3 > 0 keep, case when {K} % 10 > 0 and {K} % 3 > 0 then 'thing ' || {K} end object from work")
def m3_prefill(spark, sf):
    response = f"""concat('{{"is_relevant": ', if({K} % 4 > 0, 'true', 'false'), ', "values": ', if({K} % 3 > 0, concat('{{"object": "thing ', {K}, '"}}'), '{{}}'), '}}')"""
    rows = replayed(work(spark, sf), K, "prefill", "image_id", response, claim="text", slots="slots")
    return rows.select(K, C.keep_prefill(F.col("is_relevant"), F.col("values")).alias("keep"), F.try_element_at("values", F.lit("object")).alias("object"))


@query(f"{W} select {K}, case when {K} % 10 = 0 or {K} % 5 in (1, 2) then true else {K} % 2 = 0 end answerable, case when {K} % 10 > 0 and {K} % 5 = 1 then 'skipped' when {K} % 10 > 0 and {K} % 5 = 2 then 'failed' else 'ok' end status from work")
def m4_answerable(spark, sf):
    """A failed call counts as answerable; a lost connection skips the row."""
    response = f"""case when {K} % 5 not in (1, 2) then concat('{{"answerable": ', if({K} % 2 = 0, 'true', 'false'), '}}') end"""
    error = f"case {K} % 5 when 1 then 'Connection refused by host' when 2 then 'bad input' end"
    rows = replayed(work(spark, sf), K, "answerable", "image_id", response, error, claim="text")
    return O.error_status(rows).select(K, "answerable", "status")


@query(f"""{W}, x as (select *, case when {K} % 10 > 0 then {K} % 3 > 0 end judged, {K} % 2 = 0 answerable, {K} % 5 > 0 related from work)
select {K}, case when not answerable and related then null when not related then false else coalesce(judged, true) end is_correct,
  case when answerable and not related then coalesce(case when {K} % 10 > 0 then 'reason ' || {K} end, 'reasoning_error') when answerable and related and not coalesce(judged, true) then 'reason ' || {K} end failure_reason from x""")
def m5_verification(spark, sf):
    response = f"""concat('{{"is_correct": ', if({K} % 3 > 0, 'true', 'false'), ', "failure_reason": "reason ', {K}, '"}}')"""
    rows = work(spark, sf).withColumn("answerable", F.col(K) % 2 == 0).withColumn("is_related", F.col(K) % 5 > 0)
    return O.decide_verification(replayed(rows, K, "verification", "image_id", response, claim="text", answer="c_name").drop("is_correct")).select(K, "is_correct", "failure_reason")


@query(f"select p_partkey, round(case when p_partkey % 10 = 0 or p_partkey % 3 = 0 then 0 else 0.6 + 0.4 * (p_partkey % 3) / 2 end, 6) score {P}")
def m6_factor_score(spark, sf):
    criteria = F.array("p_name", F.concat(F.lit("[optional] "), "p_type"), F.lit("[optional] large"))
    required, optional = Q.split_required(criteria)
    response = """concat('{"required_met": ', if(p_partkey % 3 > 0, '"Yes"', 'false'), ', "optional_met": ', p_partkey % 3, '}')"""
    rows = replayed(part(spark, sf), "p_partkey", "factor_score", "p_partkey", response, required=required, optional=optional)
    return rows.select("p_partkey", F.round(Q.factor_score(F.col("required_met"), F.col("optional_met"), F.size(optional)), 6).alias("score"))


@query(f"{W} select {K}, case when {K} % 10 = 0 then null when {K} % 3 = 0 then 'place ' || {K} when {K} % 3 = 1 then 'line ' || {K} else '' end \"value\", case when {K} % 10 = 0 or {K} % 3 = 2 then 'region' else '' end missing from work")
def m7_slot_fill(spark, sf):
    response = f"""case {K} % 3 when 0 then concat('{{"value": "place ', {K}, '"}}') when 1 then concat('Value: line ', {K}) else '{{"value": ""}}' end"""
    rows = replayed(work(spark, sf), K, "slot", "image_id", response, slot=F.lit("region"), about="text")
    values = F.create_map(F.lit("object"), F.lit("x"), F.lit("region"), F.col("value"))
    return rows.select(K, "value", F.array_join(Q.missing_slots(F.col("slots"), values), ",").alias("missing"))


@query(f"{W} select {K}, case when {K} % 10 > 0 then 'What is ' || {K} || '?' end question, {K} % 4 = 0 retried from work")
def m8_question(spark, sf):
    """A quarter of the rows ask again and say why the last question was refused."""
    why = F.when(F.col(K) % 4 == 0, F.concat(F.lit("unclear "), F.col(K).cast("string")))
    response = f"concat('\"Question: What is ', {K}, '?\"\n and more')"
    rows = replayed(work(spark, sf), K, "question", "image_id", response, intent=F.lit("name it"), slots="slots", why=why)
    return rows.select(K, "question", F.contains("prompt", F.concat(F.lit("refused: unclear "), F.col(K).cast("string"))).alias("retried"))


@query(f"select p_partkey, case when p_partkey % 10 > 0 then p_partkey % 3 > 0 end valid, case when p_partkey % 10 > 0 then 'text ' || p_partkey end reason {P}")
def m9_question_check(spark, sf):
    response = "concat('Valid: ', if(p_partkey % 3 > 0, 'yes', 'no'), '\nReason: text ', p_partkey)"
    return replayed(part(spark, sf), "p_partkey", "question_check", "p_partkey", response, question="question").select("p_partkey", "valid", "reason")


@query(f"select p_partkey, case when p_partkey % 10 > 0 then p_type end answer, case when p_partkey % 10 > 0 then 'w ' || p_partkey || '|other' end wrong {P}")
def m10_answer_and_options(spark, sf):
    response = """concat('{"answer": "', p_type, '"} and ["w ', p_partkey, '", " other ", "OTHER", "', lower(p_type), '", ""]')"""
    rows = replayed(part(spark, sf), "p_partkey", "answer", "p_partkey", response, question="question", n_wrong=F.lit(3))
    return rows.select("p_partkey", "answer", F.array_join(Q.clean_wrong_options(F.col("options"), F.col("answer")), "|").alias("wrong"))


def answered(spark, sf):
    """Rows of even keys choose among two options, the others fill in a blank."""
    k = F.col("p_partkey")
    options = F.when(k % 2 == 0, F.create_map(F.lit("B"), "p_type", F.lit("A"), "p_name")).otherwise(F.create_map().cast("map<string,string>"))
    answer = F.when(k % 2 == 1, F.concat(F.lit("size "), "p_size")).otherwise(F.when(k % 4 == 0, "A").otherwise("b"))
    return part(spark, sf).withColumn("options", options).withColumn("answer", answer)


OLD = "case when p_partkey % 2 = 1 then 'size ' || p_size when p_partkey % 4 = 0 then 'A' else 'b' end"


@query(f"select p_partkey, p_partkey % 10 > 0 and p_partkey % 3 > 0 is_correct, case when p_partkey % 10 = 0 or p_partkey % 7 = 0 then 0.5e0 else (p_partkey % 8) / 8e0 end confidence, p_partkey % 10 > 0 and p_partkey % 3 > 0 and p_partkey % 7 > 0 and (p_partkey % 8) / 8e0 >= 0.7 passed, case when p_partkey % 10 > 0 and p_partkey % 2 = 0 then 'B,C' else '' end alternatives, p_partkey % 2 = 0 shows_options {P}")
def m11_confidence(spark, sf):
    """Every seventh response names no number, every tenth row has no response: both are taken for 0.5 and don't pass."""
    response = """concat('{"is_correct": ', if(p_partkey % 3 > 0, 'true', '"no"'), ', "confidence": ', if(p_partkey % 7 = 0, '"high"', cast((p_partkey % 8) / 8e0 as string)), if(p_partkey % 2 = 0, ', "alternative_options": ["B", "C"]', ''), '}')"""
    rows = replayed(answered(spark, sf), "p_partkey", "confidence", "p_partkey", response, question="question", options="options", answer="answer")
    shown = F.contains("prompt", F.concat(F.lit("\nA: "), "p_name", F.lit("\nB: "), "p_type"))
    return rows.select("p_partkey", "is_correct", "confidence", "passed", F.array_join("alternative_options", ",").alias("alternatives"), shown.alias("shows_options"))


@query(f"select p_partkey, p_partkey % 10 > 0 and p_partkey % 3 > 0 is_valid, case when p_partkey % 10 > 0 then 'seen ' || p_partkey else '' end validation_reason, case when p_partkey % 10 = 0 then 0 when p_partkey % 3 = 0 then 2 when p_partkey % 3 = 1 then 1 else 0 end issues, p_partkey % 2 = 0 names_option {P}")
def m11_validation(spark, sf):
    """Issues as a list, as one text, and as null; an answer of an option is named with its text, whatever the letter's case."""
    response = """concat('Result: {"is_valid": ', if(p_partkey % 3 > 0, 'true', 'false'), ', "validation_reason": "seen ', p_partkey, '", "issues": ', case p_partkey % 3 when 0 then '["a", "b"]' when 1 then '"one"' else 'null' end, '}')"""
    rows = replayed(answered(spark, sf), "p_partkey", "validation", "p_partkey", response, question="question", options="options", answer="answer")
    named = F.contains("prompt", F.concat(F.lit("Answer: "), "answer", F.lit(" ("), F.when(F.col("answer") == "A", F.col("p_name")).otherwise(F.col("p_type")), F.lit(")")))
    return rows.select("p_partkey", "is_valid", "validation_reason", F.size("issues").alias("issues"), named.alias("names_option"))


@query(f"""with n as (select p_partkey, p_size, {OLD} old, case p_partkey % 5 when 0 then 'A' when 1 then 'B' when 2 then 'Z' when 3 then '' else {OLD} end new {P})
  select p_partkey, case when p_partkey % 10 = 0 then '' when p_partkey % 3 = 0 then 'KEEP' else 'CHANGE' end action, case when p_partkey % 10 > 0 and p_partkey % 3 > 0 and new <> '' and new <> old and (p_partkey % 2 = 1 or new in ('A', 'B')) then new else old end answer from n""")
def m11_repair(spark, sf):
    """A new answer counts if it differs, and is an option where there are some; without a response the answer stays."""
    response = f"""concat('{{"action": "', if(p_partkey % 3 = 0, 'keep', 'Change'), '", "new_answer": ', case p_partkey % 5 when 0 then '"A"' when 1 then '" B "' when 2 then '"Z"' when 3 then 'null' else concat('"', answer, '"') end, ', "reason": "x"}}')"""
    rows = replayed(answered(spark, sf), "p_partkey", "repair", "p_partkey", response, question="question", options="options", answer="answer")
    return rows.select("p_partkey", "action", Q.repair_verdict(F.col("action"), F.col("new_answer"), F.col("answer"), F.col("options")).alias("answer"))


@query(f"select p_partkey, case when p_partkey % 10 > 0 then (p_partkey % 8) / 8e0 else 0.5e0 end clarity_score, p_partkey % 10 > 0 and p_partkey % 3 > 0 and (p_partkey % 8) / 8e0 >= 0.7 passed, case when p_partkey % 10 = 0 then 'unknown' when p_partkey % 2 = 0 then 'high' else 'medium' end ambiguity_level {P}")
def m11_clarity(spark, sf):
    response = """concat('{"clarity_score": ', (p_partkey % 8) / 8e0, if(p_partkey % 2 = 0, ', "ambiguity_level": "high"', ''), ', "is_clear": ', if(p_partkey % 3 > 0, '"yes"', 'false'), '}')"""
    rows = replayed(answered(spark, sf), "p_partkey", "clarity", "p_partkey", response, question="question", answer="answer", question_type=F.when(F.size("options") > 0, "multiple_choice").otherwise("fill_in_blank"))
    return rows.select("p_partkey", "clarity_score", "passed", "ambiguity_level")


@query(f"select p_partkey, p_partkey % 10 > 0 and p_partkey % 3 > 0 passed, case when p_partkey % 10 > 0 then (p_partkey % 8) / 8e0 else 0.5e0 end confidence, case when p_partkey % 10 > 0 then 'seen ' || p_partkey else 'no reason given' end reason, case when p_partkey % 10 > 0 then p_size + 0.5e0 else 0e0 end total_score {P}")
def m12_image_filter(spark, sf):
    response = """concat('{"passed": ', if(p_partkey % 3 > 0, 'true', 'false'), ', "confidence": ', (p_partkey % 8) / 8e0, ', "basic_score": ', p_size, ', "bonus_score": 0.5, "reason": "seen ', p_partkey, '"}')"""
    rows = replayed(part(spark, sf), "p_partkey", "image_filter", "p_partkey", response, criteria=F.array("p_name", F.lit("sharp")))
    return Q.filter_result(rows).select("p_partkey", "passed", "confidence", "reason", "total_score")
