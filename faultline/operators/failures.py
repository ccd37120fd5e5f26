"""Failures of model verdicts: which claims fail, why, and what an image's failures add up to.

Verifications are rows (image_id, claim_id, pos, content_type, is_correct, not_related_judgment_correct, skipped,
failure_reason, target_failure_id, capability). The two verdicts are three-valued: null is no failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import capability_to_category, is_connection_error

TASK_APPLICABILITY = "task_applicability"


def is_failure() -> Column:
    """P22."""
    return F.coalesce(~F.col("is_correct"), F.lit(False)) | F.coalesce(~F.col("not_related_judgment_correct"), F.lit(False))


def judged(verifications: DataFrame) -> DataFrame:
    """Rows that were not skipped, with ``failed``."""
    return verifications.where(~F.col("skipped")).withColumn("failed", is_failure())


def decide_verification(df: DataFrame) -> DataFrame:
    """Answerable and is_related decide over the judge's own verdict."""
    answerable, related = F.col("answerable"), F.col("is_related")
    skipped = ~answerable & related
    correct = F.when(skipped, None).when(~related, F.lit(False)).otherwise(F.coalesce("judge_correct", F.lit(True)))
    right = F.when(~answerable & ~related, True).when(answerable & ~related, False)
    reason = F.when(answerable & ~related, F.coalesce("judge_reason", F.lit("reasoning_error"))).when(answerable & related & ~correct, F.col("judge_reason"))
    return df.withColumns({"is_correct": correct, "not_related_judgment_correct": right, "skipped": skipped, "failure_reason": reason})


def error_status(df: DataFrame, error: str = "error") -> DataFrame:
    """A connection error skips the row, any other fails it as a limit of the model."""
    e = F.col(error)
    lost = is_connection_error(e)
    return df.withColumns({
        "status": F.when(e.isNull(), "ok").when(lost, "skipped").otherwise("failed"),
        "failure_reason": F.when(e.isNull(), None).when(lost, "model_connection_error").otherwise("model_limitation"),
    })


def complete_claim(df: DataFrame) -> DataFrame:
    """P25: the text of a claim that doesn't apply to the image."""
    refused = F.when(F.array_contains("expected_outputs", "NOT_RELATED"), "NOT_RELATED").otherwise("not related")
    return df.withColumn("completed_claim", F.when(~F.col("is_related"), refused).otherwise(F.col("completed_claim")))


def normalize_prediction(text: Column) -> Column:
    """True or false where the text says so, else the text itself."""
    t = F.lower(F.trim(F.coalesce(F.get_json_object(text, "$.prediction"), F.get_json_object(text, "$.answer"), text)))
    return F.when(t.isin("true", "yes", "correct"), "true").when(t.isin("false", "no", "incorrect"), "false").otherwise(F.trim(text))


def match_failure(verifications: DataFrame, reasons: DataFrame) -> DataFrame:
    """Adds failure_id. Small tables of reasons by id, and the first reason of each category, are joined in turn.

    reasons: failure_id, failure_category, pos.
    """
    ids = reasons.select(F.col("failure_id").alias("known"))
    first = reasons.groupBy("failure_category").agg(F.min_by("failure_id", "pos").alias("category_first"))
    fallback = F.coalesce(first_of(reasons, TASK_APPLICABILITY), F.lit(None).cast("string"))
    v = judged(verifications).withColumn("category", capability_to_category(F.col("capability")))
    v = v.join(ids.withColumnRenamed("known", "reason_id"), F.col("failure_reason") == F.col("reason_id"), "left")
    v = v.join(ids.withColumnRenamed("known", "target_id"), F.col("target_failure_id") == F.col("target_id"), "left")
    v = v.join(first, F.col("category") == F.col("failure_category"), "left")
    wrong = F.coalesce(~F.col("not_related_judgment_correct"), F.lit(False))
    right = F.coalesce(F.col("not_related_judgment_correct"), F.lit(False))
    found = F.when(~F.col("failed"), None).when(wrong, F.coalesce("target_id", fallback)).when(right, None).otherwise(F.coalesce("reason_id", "target_id", "category_first"))
    return v.withColumn("failure_id", found).drop("reason_id", "target_id", "category_first", "failure_category", "category")


def first_of(reasons: DataFrame, category: str) -> Column:
    """The first reason of a category; the table of reasons is a configuration of a few rows."""
    row = reasons.where(F.col("failure_category") == category).orderBy("pos").select("failure_id").limit(1).collect()
    return F.lit(row[0][0] if row else None).cast("string")


def image_failures(matched: DataFrame) -> DataFrame:
    """A1: per image total_claims, failed_claims, success_rate, failure_breakdown, failed_claim_ids, failed_reasons.

    Counts by (image, reason) come first, so an image's map is built from at most as many rows as there are reasons.
    A failed claim without a reason counts under 'null'.
    """
    key = F.when(F.col("failed"), F.coalesce("failure_id", F.lit("null")))
    parts = matched.groupBy("image_id", key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("failed"), F.struct("pos", "claim_id")))).alias("ids"), F.collect_set(F.when(F.col("failed"), F.col("failure_reason"))).alias("why"))
    out = parts.groupBy("image_id").agg(
        F.sum("n").alias("total_claims"),
        F.sum(F.when(F.col("k").isNotNull(), F.col("n")).otherwise(0)).alias("failed_claims"),
        F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "n")))).alias("failure_breakdown"),
        F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"),
        F.array_distinct(F.flatten(F.collect_list("why"))).alias("failed_reasons"),
    )
    rate = F.round(1 - F.col("failed_claims") / F.col("total_claims"), 6)
    return out.select("image_id", "total_claims", "failed_claims", rate.alias("success_rate"), "failure_breakdown", F.col("ids.claim_id").alias("failed_claim_ids"), "failed_reasons")


def breakdown_text(breakdown: Column) -> Column:
    """A map as sorted key=value text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(breakdown)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")


def failed_images(images: DataFrame) -> DataFrame:
    """P27."""
    return images.where("failed_claims > 0")


def global_failures(images: DataFrame) -> DataFrame:
    """A2: one row over all images."""
    merged = images.select(F.explode("failure_breakdown").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n"))
    total = images.agg(F.count(F.lit(1)).alias("total_images"), F.sum("total_claims").alias("total_claims"), F.sum("failed_claims").alias("total_failed"))
    joined = total.crossJoin(merged.agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("failure_breakdown")))
    return joined.withColumn("failure_rate", F.round(F.try_divide("total_failed", "total_claims"), 6))


def error_rates(verifications: DataFrame) -> DataFrame:
    """A3: by content type; a verdict that is not true counts as an error here, null included."""
    wrong = F.when(F.coalesce("is_correct", F.lit(False)), 0).otherwise(1)
    return verifications.where(~F.col("skipped")).groupBy("content_type").agg(F.count(F.lit(1)).alias("total"), F.sum(wrong).alias("errors"), F.round(F.avg(wrong), 6).alias("error_rate"))


def factor_distribution(rows: DataFrame, factors: str = "factors") -> DataFrame:
    """A4: an array counts each factor once for each row, a map adds its numbers."""
    if rows.schema[factors].dataType.typeName() == "map":
        return rows.select(F.explode(factors).alias("factor", "n")).groupBy("factor").agg(F.sum("n").alias("n"))
    return rows.select(F.explode(factors).alias("factor")).groupBy("factor").agg(F.count(F.lit(1)).alias("n"))


def not_related_corrections(verifications: DataFrame) -> DataFrame:
    """A5."""
    j = F.col("not_related_judgment_correct")
    return verifications.where(~F.col("skipped")).agg(F.count(j).alias("judged"), F.count_if(~j).alias("corrected"), F.round(F.try_divide(F.count_if(~j), F.count(j)), 6).alias("correction_rate"))


def failure_distribution(images: DataFrame, failed: DataFrame) -> DataFrame:
    """From the breakdown, for images without one from their failed rows, for the rest from their failed ids."""
    has = F.size("failure_breakdown") > 0
    first = images.where(has).select(F.explode("failure_breakdown").alias("failure_type", "n"))
    bare = images.where(~has)
    second = bare.select("image_id").join(failed, "image_id").groupBy(F.coalesce("failure_id", F.lit("null")).alias("failure_type")).agg(F.count(F.lit(1)).alias("n"))
    third = bare.join(failed.select("image_id").distinct(), "image_id", "left_anti").select(F.lit("unknown").alias("failure_type"), F.size("failed_claim_ids").cast("long").alias("n"))
    both = first.unionByName(second).unionByName(third.where("n > 0"))
    return ordered_counts(both.groupBy("failure_type").agg(F.sum("n").alias("n")), "failure_type")


def ordered_counts(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """T4."""
    return counts.orderBy(F.desc(n), key)


def run_summary(images: DataFrame) -> DataFrame:
    """A7."""
    return images.agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("failed_claims") > 0).alias("failed_images"), F.sum("total_claims").alias("claims"),
        F.sum("failed_claims").alias("failures"), F.round(F.avg("success_rate"), 6).alias("mean_success_rate"),
    )


def suggested_factors(matched: DataFrame, reasons: DataFrame) -> DataFrame:
    """The factors of each failure's reason. The reasons are a table of a few rows."""
    return matched.where("failed").join(F.broadcast(reasons.select("failure_id", "suggested_filtering_factors")), "failure_id")


def image_factors(matched: DataFrame, reasons: DataFrame) -> DataFrame:
    """Each image's factors, distinct and sorted."""
    rows = suggested_factors(matched, reasons).select("image_id", F.explode("suggested_filtering_factors").alias("f")).distinct()
    return rows.groupBy("image_id").agg(F.array_sort(F.collect_list("f")).alias("factors"))


def all_factors(reasons: DataFrame) -> DataFrame:
    """Every factor with its id <failure_id>__<pos>."""
    rows = reasons.select("failure_id", F.posexplode("suggested_filtering_factors").alias("pos", "factor"))
    return rows.select("failure_id", F.concat_ws("__", "failure_id", F.col("pos").cast("string")).alias("factor_id"), "factor")


def zip_claims(claims: DataFrame, completions: DataFrame, verifications: DataFrame) -> DataFrame:
    """What belongs to one claim of one image, side by side."""
    return claims.join(completions, ["image_id", "claim_id"]).join(verifications, ["image_id", "claim_id"])


def first_verification(sampled: DataFrame, matched: DataFrame) -> DataFrame:
    """Of each image the first failed row of its sampled failure (failure_id, else failure_reason).

    sampled: image_id, failure_key.
    """
    rows = matched.where("failed").withColumn("failure_key", F.coalesce("failure_id", "failure_reason"))
    return sampled.join(rows, ["image_id", "failure_key"]).groupBy("image_id", "failure_key").agg(F.min(F.struct("pos", "claim_id")).alias("f")).select("image_id", "failure_key", "f.claim_id", "f.pos")


def template_of(failures: DataFrame, templates: DataFrame) -> DataFrame:
    """The values of the template behind a failure, by claim id, else by equal original text.

    failures: claim_id, original_template. templates: claim_id, original_template, filled_values.
    """
    by_id = templates.select("claim_id", F.col("filled_values").alias("by_id"))
    by_text = templates.groupBy("original_template").agg(F.min_by("filled_values", "claim_id").alias("by_text"))
    return failures.join(by_id, "claim_id", "left").join(by_text, "original_template", "left").withColumn("filled_values", F.coalesce("by_id", "by_text")).drop("by_id", "by_text")


def prefill_summary(rows: DataFrame) -> DataFrame:
    """A10: kept and dropped prefills with the positions of the dropped ones. rows: image_id, pos, kept."""
    return rows.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"),
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("pos")))).alias("dropped_positions"),
    )
