"""Relations of the engine derived from the driver's tables, in SQL that Spark and DuckDB read alike.

``{events}`` and the like stand for tables. The same text is a DataFrame in Spark and a common table expression in the
SQL that a query is checked against.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from faultline.functions.text import FAILURE_PRIORITY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL_REASONS = (*FAILURE_PRIORITY, "model_limitation", "visual_error")


def case(number: str, values: tuple[str, ...]) -> str:
    return f"case {number} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


FIXTURES = {
    "v": f"""select concat('img_', user_id) as image_id, concat('c_', event_id) as claim_id, event_id as pos, event_type as content_type,
      case when event_id % 10 <= 2 then false when event_id % 10 = 3 then null else true end as is_correct,
      case when event_id % 11 = 0 then false when event_id % 11 = 1 then true else null end as not_related_judgment_correct,
      event_id % 13 = 0 as skipped, case when event_id % 17 = 0 then null else {case('floor(event_id / 10) % 10', ALL_REASONS)} end as failure_reason,
      {case('floor(event_id / 3) % 8', FAILURE_PRIORITY)} as target_failure_id,
      case event_id % 5 when 0 then 'spatial_localization' when 1 then 'object counting' when 2 then 'absence check' when 3 then null else 'misc' end as capability,
      case when event_id % 4 = 0 then concat('text ', event_id % 7) else concat('own ', event_id) end as original_template from {{events}}""",
    "batches": "select cast(floor(event_id / 20) as bigint) as batch, cast(sum(case when event_type = 'error' and value > 150 then 1 else 0 end) as bigint) as hits from {events} group by 1",
    "qa": """select p_partkey as id, concat(case when p_partkey % 23 = 0 then 'Where is [object] in ' else 'What is ' end, p_name, case when p_partkey % 9 = 0 then ' if seen?' else '?' end) as question,
      case when p_partkey % 19 = 0 then null else concat('What is ', p_name, '?') end as full_question,
      p_brand as oa, case when p_partkey % 7 = 0 then concat(' ', upper(p_brand)) else p_type end as ob, cast(p_size as varchar(20)) as oc,
      case p_partkey % 6 when 0 then 'A' when 1 then 'b' when 2 then 'C' when 3 then 'E' when 4 then '' else p_brand end as answer,
      case p_partkey % 4 when 0 then 'A' when 1 then 'B' when 2 then null else 'C' end as correct_option,
      case when p_partkey % 5 = 0 then 'fill_in_blank' else 'multiple_choice' end as question_type,
      case when p_partkey % 3 = 0 then concat('because ', p_type) else null end as explanation, p_type as pipeline_name,
      case when p_partkey % 31 = 0 then null when p_partkey % 29 = 0 then '***' else 'aGVsbG8gd29ybGQ=' end as image_base64 from {part}""",
    "responses": """select doc_id, case doc_id % 6 when 0 then concat('{{"is_correct": true, "confidence": 0.', doc_id % 10, ', "answer": "A"}}')
      when 1 then concat('Here it is: {{"is_correct": "yes", "confidence": "0.', doc_id % 10, '", "answer": "b ', doc_id, '"}} as asked')
      when 2 then concat('```json', chr(10), '{{"is_correct": false, "confidence": 0.', doc_id % 7, ', "answer": "C"}}', chr(10), '```')
      when 3 then concat('valid: ', case when doc_id % 4 = 1 then 'true' else 'no' end, chr(10), 'reason: text ', doc_id, chr(10), 'Answer: "word ', doc_id, '"')
      when 4 then concat('{{"is_correct": tru', doc_id) else null end as response,
      case when doc_id % 12 = 5 then 'Connection refused by host' when doc_id % 6 = 5 then 'bad input' else null end as error from {documents}""",
    "scores": """select doc_id, ((doc_id * 37) % 101) / 100e0 as confidence, quality = 1 as is_correct, toxic = 0 as is_valid, doc_id % 9 = 0 as confidence_unparsed,
      doc_id % 8 = 0 as validation_unparsed, case when doc_id % 5 = 0 then 1 else 0 end as n_issues from {labels}""",
    "groups": "select o_orderpriority as pipeline_name, o_orderkey as id from {orders}",
    "texts": "select vec_id as id, concat('factor ', vec_id) as text, vec_id as pos from {embeddings}",
    "multilabel": "select doc_id, quality as t0, toxic as t1, ((doc_id * 13) % 100) / 99e0 as p0, ((doc_id * 29) % 100) / 99e0 as p1 from {labels}",
    "work": """select c_custkey as sample_index, c_name, case c_custkey % 4 when 0 then 'object_counting' when 1 then 'Object Counting for shops' when 2 then 'about a caption' else 'nothing' end as pipeline_type,
      case when c_custkey % 6 = 0 then 'question' else null end as pipeline_name, case c_custkey % 5 when 0 then '  ' when 1 then null else concat(' claim ', c_custkey, ' ') end as claim,
      case when c_custkey % 3 = 0 then c_mktsegment when c_custkey % 3 = 1 then ' ' else null end as object_value, case when c_custkey % 2 = 0 then cast(c_custkey as varchar(20)) else c_name end as image_id,
      c_custkey % 7 = 0 as relevant from {customer}""",
    "turns": "select conv_id, turn, role, text from {conversations}",
}


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    used = [t for t in TABLES if re.search(rf"(?<!{{)\{{{t}\}}", text)]
    return spark.sql(text, **views(spark, sf_dir, *used))


def cte(*names: str) -> str:
    """The fixtures as common table expressions for DuckDB."""
    return "with " + ", ".join(f"{n} as ({FIXTURES[n].format(**{t: t for t in TABLES})})" for n in names)
