"""From a failure to the pipeline that asks about it, and from an image to the failure reasons worth verifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import clean_text

# Failure reasons with their question pipelines.
PIPELINE_MAP = (
    ("FR_BASIC_VISUAL_ENTITY_GROUNDING_FAILURE", "visual_recognition", "Main Object Identification Pipeline"),
    ("FR_PLACE_RECOGNITION_ERROR", "place_recognition", "Place Recognition Pipeline"),
    ("FR_MULTI_OBJECT_CONCEPT_ABSTRACTION_FAILURE", "caption", "Caption Pipeline"),
    ("FR_OBJECT_LEVEL_ABSTRACT_CONCEPT_MISSING", "question", "Question Pipeline"),
    ("FR_OBJECT_COUNTING_CONFUSION", "object_counting", "Object Counting Pipeline"),
    ("FR_ABSOLUTE_POSITION_ERROR", "object_position", "Object Position Pipeline"),
    ("FR_RELATIVE_POSITION_ERROR", "object_relative_position", "Object Relative Position Pipeline"),
    ("FR_OBJECT_ORIENTATION_ERROR", "object_orientation", "Object Orientation Pipeline"),
    ("FR_ABSENCE_REASONING_FAILURE", "object_absence", "Object Absence Pipeline"),
    ("FR_BASIC_IMAGE_TEXT_ALIGNMENT", "text_association", "Text Association Pipeline"),
    ("FR_SCALE_PROPORTION_ERROR", "object_proportion", "Object Proportion Pipeline"),
    ("FR_OCCLUSION_SENSITIVITY", "caption", "Caption Pipeline"),
    ("FR_INTRA_CLASS_INSTANCE_POSITIONING_FAILURE", "object_intra_class_instance_positioning", "Object Intra Class Instance Positioning Pipeline"),
)
# Words in a pipeline's type that stand for a pipeline, in order of precedence.
KEYWORDS = (
    ("object counting", "object_counting"),
    ("object recognition", "question"),
    ("question", "question"),
    ("object position", "object_position"),
    ("object relative position", "object_relative_position"),
    ("relative position", "object_relative_position"),
    ("object proportion", "object_proportion"),
    ("object orientation", "object_orientation"),
    ("object absence", "object_absence"),
    ("place recognition", "place_recognition"),
    ("text association", "text_association"),
    ("caption", "caption"),
)
# Failure reasons in order with their categories.
REASON_CATEGORIES = (
    ("FR_BASIC_VISUAL_ENTITY_GROUNDING_FAILURE", "visual_grounding"),
    ("FR_OBJECT_LEVEL_ABSTRACT_CONCEPT_MISSING", "conceptual_abstraction"),
    ("FR_MULTI_OBJECT_CONCEPT_ABSTRACTION_FAILURE", "conceptual_abstraction"),
    ("FR_ABSOLUTE_POSITION_ERROR", "spatial_reasoning"),
    ("FR_RELATIVE_POSITION_ERROR", "spatial_reasoning"),
    ("FR_SCALE_PROPORTION_ERROR", "scale_reasoning"),
    ("FR_OBJECT_COUNTING_CONFUSION", "relational_reasoning"),
    ("FR_ABSENCE_REASONING_FAILURE", "negative_reasoning"),
    ("FR_OCCLUSION_SENSITIVITY", "robustness"),
    ("FR_OBJECT_ORIENTATION_ERROR", "orientation_reasoning"),
    ("FR_PLACE_RECOGNITION_ERROR", "geographic_reasoning"),
    ("FR_INTRA_CLASS_INSTANCE_POSITIONING_FAILURE", "intra_class_instance_grounding_and_relative_positioning"),
    ("FR_BASIC_IMAGE_TEXT_ALIGNMENT", "image_text_reasoning"),
)


def pipeline_map(spark) -> DataFrame:
    """failure_id, pipeline_type, pipeline_name."""
    return spark.createDataFrame(list(PIPELINE_MAP), "failure_id string, pipeline_type string, pipeline_name string")


def reasons(spark) -> DataFrame:
    """failure_id, failure_category, pos."""
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(REASON_CATEGORIES)], "failure_id string, failure_category string, pos int")


def to_pipeline(sampled: DataFrame, mapping: DataFrame, default: str = "unknown") -> DataFrame:
    """Sampled failures with their pipeline; the mapping is a configuration of a few rows."""
    j = sampled.join(F.broadcast(mapping.withColumnRenamed("failure_id", "failure_key")), "failure_key", "left")
    return j.withColumn("pipeline_type", F.coalesce("pipeline_type", F.lit(default))).withColumn("pipeline_name", F.coalesce("pipeline_name", F.lit(default)))


def resolve_pipeline(names: list[Column], fuzzy: Column, known: list[str]) -> Column:
    """The first name that is a known pipeline, else the first keyword in the type, else null."""
    exact = F.coalesce(*[F.when(n.isin(known), n) for n in names])
    out = F.lit(None).cast("string")
    for word, pipeline in reversed([k for k in KEYWORDS if k[1] in known]):
        out = F.when(F.contains(F.lower(fuzzy), F.lit(word)), pipeline).otherwise(out)
    return F.coalesce(exact, out)


def fan_out(records: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Each record with its own pipeline, or with all where it has none. pipelines: key; a few rows."""
    own = records.where(F.col("pipeline").isNotNull())
    every = records.where(F.col("pipeline").isNull()).drop("pipeline").crossJoin(F.broadcast(pipelines.select(F.col("key").alias("pipeline"))))
    return own.unionByName(every.select(*own.columns))


def error_questions(errors: DataFrame, questions: DataFrame) -> DataFrame:
    """An error with its question, by trace id and pipeline (an id alone is ambiguous after a fan-out)."""
    return errors.join(questions.select("trace_id", "pipeline_name", "question"), ["trace_id", "pipeline_name"], "left")


def select_pipelines(df: DataFrame, names: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The options of a subset of pipelines and of a largest number of rows."""
    out = df.where(F.col("pipeline_name").isin(names)) if names else df
    return out.limit(most) if most is not None else out


def image_path(df: DataFrame, keys: tuple[str, ...] = ("image_path", "path", "file_path", "image_url")) -> Column:
    """The first path at the top level, then in metadata."""
    top = [F.nullif(clean_text(F.col(k)), F.lit("")) for k in keys if k in df.columns]
    inner = [F.nullif(clean_text(F.try_element_at("metadata", F.lit(k))), F.lit("")) for k in keys] if "metadata" in df.columns else []
    return F.coalesce(*top, *inner)


def record_id(given: Column, image_id: Column, sample_index: Column) -> Column:
    """P54."""
    return F.coalesce(given.cast("long"), image_id.try_cast("long"), sample_index.cast("long"))


def payload(df: DataFrame, keys: tuple[str, ...]) -> Column:
    """The first payload of more than 50 characters, without the head of a data URL."""
    return F.coalesce(*[F.when(F.length(k) > 50, F.regexp_replace(k, "^data:[^,]*,", "")) for k in keys])


def top_reasons(matches: DataFrame, k: int) -> DataFrame:
    """The k reasons of each image with most matched factors, ties in order of the configuration; k is at least 1.

    matches: image_id, failure_id, pos, n.
    """
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "pos"))
    return matches.withColumn("rank", place).where(F.col("rank") <= max(1, k))


def route(images: DataFrame, factors: DataFrame, cheap: dict[str, Column], verify: Column, triggers: DataFrame, k: int = 3) -> DataFrame:
    """C7 (J1, P60, T1, P61, J16, J17): cheap predicates pick reasons, the costly one checks their factors.

    factors: failure_id, factor_id, kind, pos (a configuration). cheap: predicate on an image by kind of factor; factors
    of another kind have no executor and are dropped. verify: predicate on an image and a factor. triggers: failure_id,
    trigger_type.
    """
    pairs = images.crossJoin(F.broadcast(factors.where(F.col("kind").isin(list(cheap)))))
    hit = F.lit(False)
    for kind, predicate in cheap.items():
        hit = F.when(F.col("kind") == kind, predicate).otherwise(hit)
    counts = pairs.where(hit).groupBy("image_id", "failure_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    chosen = top_reasons(counts, k).select("image_id", "failure_id")
    passed = pairs.join(chosen, ["image_id", "failure_id"], "left_semi").where(verify).groupBy("image_id", "failure_id").agg(F.array_sort(F.collect_set("factor_id")).alias("passed_factors"))
    with_types = passed.join(F.broadcast(triggers.groupBy("failure_id").agg(F.array_sort(F.collect_set("trigger_type")).alias("types"))), "failure_id", "left")
    return with_types.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("failure_id", "passed_factors"))).alias("matched"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("types", F.array().cast("array<string>")))))).alias("trigger_types"),
    )


def prompts(df: DataFrame, agents: list[str], report: str = "report") -> DataFrame:
    """Chat rows with a system turn that lists the agents and the report as the user's turn."""
    system = "Choose the agents that can examine the reported failure: " + ", ".join(agents)
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return df.withColumn("prompt", F.array(turn("system", F.lit(system)), turn("user", F.col(report))))
