"""Questions and answers: checks, repairs, scores, and the decision to keep a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.seeded import pick, u
from faultline.functions.text import clean_text, json_get, json_text, placeholder_in, valid_token

# Words that mark a type of question which must not be asked.
FORBIDDEN_WORDS = {
    "generic_scene_description": ("describe", "what do you see", "what's in"),
    "opinion_based": ("do you like", "do you think", "prefer", "favorite"),
    "hypothetical": ("what if", "suppose", "imagine", "if"),
    "commonsense_only": ("why", "how come", "what causes"),
    "unanswerable_from_image": ("what happened before", "what will happen"),
}
# Pipelines whose questions are not checked for emptiness.
EXEMPT = ("question", "visual_recognition", "caption", "text_association")
# Slots with one value, and slots with a choice.
SLOT_DEFAULTS = {"region": "center", "spatial_granularity": "coarse", "direction_granularity": "cardinal"}
SLOT_CHOICES = {
    "object_category_granularity": ["basic", "detailed"],
    "caption_style": ["descriptive", "concise"],
    "platform_context": ["twitter", "instagram", "facebook"],
    "expression_format": ["percentage", "fraction", "ratio"],
    "reference_frame": ["absolute", "relative"],
    "region_partition": ["corners", "quadrants"],
    "count_scope": ["all"],
}


def forbidden_types(question: Column, types: list[str]) -> Column:
    """The forbidden types whose words are in a question."""
    q = F.lower(question)
    found = []
    for t in types:
        hit = F.lit(False)
        for w in FORBIDDEN_WORDS[t]:
            hit = hit | F.contains(q, F.lit(w))
        found.append(F.when(hit, t))
    return F.array_compact(F.array(*found))


def question_present(question: Column, pipeline: Column) -> Column:
    """P29."""
    return pipeline.isin(*EXEMPT) | (clean_text(question) != "")


def input_error(df: DataFrame, needed: list[str]) -> DataFrame:
    """The first needed column without text, as error_stage and error."""
    stage = F.lit(None).cast("string")
    for c in reversed(needed):
        stage = F.when(clean_text(F.col(c).cast("string")) == "", c).otherwise(stage)
    return df.withColumn("error_stage", stage).withColumn("error", F.when(stage.isNotNull(), F.concat(F.lit("missing "), stage)))


def missing_slots(required: Column, values: Column) -> Column:
    """Required slots without a value; a row with any is rejected at slot_filling."""
    return F.filter(required, lambda s: clean_text(F.try_element_at(values, s)) == "")


def default_slot(slot: Column, key: Column, seed: int = 0) -> Column:
    """P37."""
    out = F.lit(None).cast("string")
    for name, values in SLOT_CHOICES.items():
        out = F.when(slot == name, pick(values, u(seed, key, slot))).otherwise(out)
    for name, value in SLOT_DEFAULTS.items():
        out = F.when(slot == name, value).otherwise(out)
    return out


def placeholder_issues(df: DataFrame) -> DataFrame:
    """The fields in which something is left to be filled."""
    options = F.exists(F.map_values("options"), placeholder_in) & (F.col("question_type") == "multiple_choice")
    found = [F.when(placeholder_in(F.col(c)), c) for c in ("question", "full_question", "answer") if c in df.columns]
    return df.withColumn("placeholder_issues", F.array_compact(F.array(*found, F.when(options, "options"))))


def option_issues(options: Column) -> Column:
    """P39."""
    values = F.transform(F.map_values(options), lambda v: F.lower(clean_text(v)))
    return F.array_compact(F.array(F.when(F.size(values) < 2, "too_few"), F.when(F.size(F.array_distinct(values)) < F.size(values), "duplicate")))


def answer_issues(answer: Column, correct: Column, options: Column) -> Column:
    """P40."""
    has = lambda c: F.coalesce(F.map_contains_key(options, c), F.lit(False))
    return F.array_compact(F.array(
        F.when(clean_text(answer) == "", "empty"), F.when((clean_text(answer) != "") & ~has(answer), "no_option"),
        F.when(correct.isNotNull() & (answer != correct), "differs"), F.when(correct.isNotNull() & ~has(correct), "correct_no_option"),
    ))


def repair_answer(df: DataFrame) -> DataFrame:
    """An answer that is no option takes a correct_option that is one; then correct_option follows the answer."""
    has = lambda c: F.coalesce(F.map_contains_key("options", F.coalesce(F.col(c), F.lit(""))), F.lit(False))
    fixed = F.when(has("answer"), F.col("answer")).when(has("correct_option"), F.col("correct_option")).otherwise(F.col("answer"))
    out = df.withColumn("answer", fixed)
    out = out.withColumn("correct_option", F.when(has("answer"), F.col("answer")).otherwise(F.col("correct_option")))
    return out.withColumn("answer_issues", answer_issues(F.col("answer"), F.col("correct_option"), F.col("options"))).withColumn("repaired", F.size("answer_issues") == 0)


def unwrap_answer(df: DataFrame) -> DataFrame:
    """An answer that is JSON gives its answer, and its explanation where none is there."""
    j = json_text(F.col("answer"))
    found = F.coalesce(json_get(j, "Answer"), json_get(j, "answer"))
    return df.withColumn("explanation", F.coalesce("explanation", json_get(j, "explanation"), json_get(j, "Explanation"))).withColumn("answer", F.coalesce(found, F.col("answer")))


def fill_in_blank_empty(df: DataFrame) -> Column:
    """P43."""
    return (F.col("question_type") == "fill_in_blank") & (clean_text(F.col("answer")) == "")


def score_passes(df: DataFrame) -> DataFrame:
    """P45."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumns({
        "confidence_passed": yes(F.col("is_correct") & (F.col("confidence") >= 0.7)),
        "validation_passed": yes(F.col("is_valid") & (F.col("n_issues") == 0)),
    })


def clarity_passed(is_clear: Column, score: Column) -> Column:
    return F.coalesce(is_clear & (score >= 0.7), F.lit(False))


def decide(df: DataFrame) -> DataFrame:
    """Strict, one of five rescues in order, or reject."""
    s = score_passes(df)
    c, correct, valid = F.coalesce("confidence", F.lit(0.0)), F.coalesce("is_correct", F.lit(False)), F.coalesce("is_valid", F.lit(False))
    read_c, read_v = ~F.col("confidence_unparsed"), ~F.col("validation_unparsed")
    why = (
        F.when(F.col("confidence_passed") & F.col("validation_passed") & read_c & read_v, "strict")
        .when(read_c & read_v & (c >= 0.5) & (c < 0.7) & correct & valid, "a").when(read_c & read_v & (c >= 0.5) & valid, "b")
        .when(valid & ~read_c, "c").when(F.col("confidence_passed") & ~read_v, "d")
        .when(read_c & (c >= 0.9) & correct & ~F.col("validation_passed"), "e").otherwise("reject")
    )
    return s.withColumn("decision", F.when(why.isin("strict", "reject"), why).otherwise("rescue")).withColumn("rescue_reason", F.when(~why.isin("strict", "reject"), why))


def repair_verdict(verdict: Column, new: Column, old: Column, options: Column) -> Column:
    """The answer after a repair verdict."""
    legal = F.when(F.size(options) > 0, F.coalesce(F.map_contains_key(options, new), F.lit(False))).otherwise(clean_text(new) != "")
    return F.when((F.upper(verdict) == "CHANGE") & legal & (new != old), new).otherwise(old)


def clean_wrong_options(options: Column, answer: Column) -> Column:
    """Trimmed, each once whatever its case (the first stays), none that is, holds or is held by the answer."""
    a = F.lower(clean_text(answer))
    texts = F.filter(F.transform(options, clean_text), lambda o: (o != "") & ~F.contains(F.lower(o), a) & ~F.contains(a, F.lower(o)))
    low = F.transform(texts, F.lower)
    return F.filter(texts, lambda o, i: F.array_position(low, F.lower(o)) == i + 1)


def option_text(option: Column) -> Column:
    """The text in an option that is JSON."""
    j = json_text(option)
    return clean_text(F.coalesce(json_get(j, "text"), json_get(j, "option"), json_get(j, "value"), option))


def valid_options(options: Column) -> Column:
    """P48 on a list."""
    return F.filter(options, valid_token)


def final_rows(df: DataFrame) -> DataFrame:
    """P50: the columns of the data set, with an error reason and defaults."""
    reason = F.when(F.col("decision") == "reject", F.coalesce("error", F.lit("validation failed")))
    return df.select("id", "question", F.coalesce("full_question", "question").alias("full_question"), "question_type", "answer", F.coalesce("explanation", F.lit("")).alias("explanation"), "pipeline_name", F.col("decision").isin("strict", "rescue").alias("validation_passed"), reason.alias("error_reason"))


def error_detail(df: DataFrame) -> DataFrame:
    """Texts cut to 500, 200 and 300 characters, three issues."""
    return df.select("id", F.left("question", F.lit(500)).alias("question"), F.left("answer", F.lit(200)).alias("answer"), F.left("explanation", F.lit(300)).alias("explanation"), F.slice("issues", 1, 3).alias("issues"))


def regeneration(issues: Column, parts: list[Column]) -> tuple[Column, Column]:
    """Whether to generate again, and the joined reasons."""
    return F.size(issues) > 0, F.concat_ws("; ", issues, *parts)


def accepted(df: DataFrame, mode: str = "strict") -> DataFrame:
    """Strict drops rejected rows, lenient keeps them with their report, unchecked marks all as passed."""
    passed = F.col("decision").isin("strict", "rescue")
    if mode == "strict":
        return df.where(passed).withColumn("validation_passed", F.lit(True))
    return df.withColumn("validation_passed", F.lit(True) if mode == "unchecked" else passed)


def composite_score(df: DataFrame) -> DataFrame:
    """0.4 format + 0.2 clarity + 0.2 confidence + 0.2 validation."""
    yes = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    total = 0.4 * yes("format_passed") + 0.2 * F.coalesce("clarity", F.lit(0.0)) + 0.2 * F.coalesce("confidence", F.lit(0.0)) + 0.2 * yes("validation_passed")
    return df.withColumn("score", F.round(total, 3))


def dataset_statistics(df: DataFrame) -> DataFrame:
    """Counts, passed rows and mean positive score by question type, by pipeline and over all, in one pass."""
    mean = F.round(F.avg(F.when(F.col("score") > 0, F.col("score"))), 3)
    sets = df.groupingSets([["question_type"], ["pipeline_name"], []], "question_type", "pipeline_name")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_if("validation_passed").alias("passed"), F.count_if(~F.col("validation_passed")).alias("failed"), mean.alias("mean_score"))


def stage_counters(df: DataFrame, status: str = "status") -> DataFrame:
    """A14."""
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def split_required(criteria: Column) -> tuple[Column, Column]:
    """Criteria without and with the mark [optional], without the mark."""
    optional = lambda c: F.contains(c, F.lit("[optional]"))
    return F.filter(criteria, lambda c: ~optional(c)), F.transform(F.filter(criteria, optional), lambda c: F.trim(F.replace(c, F.lit("[optional]"), F.lit(""))))


def factor_score(required_met: Column, optional_met: Column, optional_total: Column) -> Column:
    """P57."""
    return F.when(~required_met, 0.0).when(optional_total == 0, 0.6).otherwise(0.6 + 0.4 * optional_met / optional_total)


def score_failures(failures: DataFrame, responses: DataFrame) -> DataFrame:
    """0.0 for images without a failure key or with a failed call. responses: image_id, score, error."""
    joined = failures.join(responses, "image_id", "left")
    note = F.when(F.col("failure_key").isNull(), "No failure key").otherwise(F.col("error"))
    return joined.withColumn("score", F.when(note.isNotNull() | F.col("score").isNull(), 0.0).otherwise(F.col("score"))).withColumn("note", note)


def filter_result(df: DataFrame) -> DataFrame:
    """Defaults of an image filter's result; the total is basic plus bonus."""
    return df.withColumns({
        "passed": F.coalesce("passed", F.lit(False)), "confidence": F.coalesce("confidence", F.lit(0.5)), "reason": F.coalesce("reason", F.lit("no reason given")),
        "total_score": F.coalesce("basic_score", F.lit(0.0)) + F.coalesce("bonus_score", F.lit(0.0)),
    })
