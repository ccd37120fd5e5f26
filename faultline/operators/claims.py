"""Claim templates: enabling, normalizing, filling in known values; predefined claims; images without any claim left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import clean_text, extract_placeholders, infer_content_type


def metadata(df: DataFrame, *payload: str) -> DataFrame:
    """All columns but image payloads and ids."""
    return df.drop(*payload)


def enabled(templates: DataFrame, ids: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Templates whose id or name is listed; all if nothing is."""
    if not ids and not names:
        return templates
    return templates.where(F.col("claim_id").isin(ids or []) | F.col("name").isin(names or []))


def normalize_templates(templates: DataFrame, texts: tuple[str, ...] = ("claim_template", "template", "text", "claim_text", "claim")) -> DataFrame:
    """Text by the first column that has one; id <image>_template_<i> where none is given; prefill slots as list."""
    have = [F.col(c) for c in texts if c in templates.columns]
    slots = "prefill_slots"
    listed = F.when(F.col(slots).isNull(), F.array().cast("array<string>")).otherwise(F.array(slots)) if templates.schema[slots].dataType.typeName() == "string" else F.coalesce(slots, F.array().cast("array<string>"))
    ids = F.coalesce("claim_id", F.concat(F.col("image_id"), F.lit("_template_"), F.col("pos").cast("string")))
    return templates.withColumn("template_text", F.coalesce(*have)).withColumn("claim_id", ids).withColumn(slots, listed)


def normalize_schema(templates: DataFrame) -> DataFrame:
    """Placeholders in use: those that have slots, else the slots, else those of the text."""
    found = extract_placeholders(F.col("template_text"))
    slots = F.map_keys("slots")
    both = F.array_intersect(found, slots)
    return templates.withColumn("placeholders", F.when(F.size(both) > 0, both).when(F.size(slots) > 0, F.array_sort(slots)).otherwise(found))


def predefined_claims(df: DataFrame, claims: str = "claims") -> DataFrame:
    """One row for each claim of an image, with id <image>_claim_<i> and a content type."""
    rows = df.select("image_id", F.posexplode(claims).alias("i", "claim_text"))
    return rows.withColumn("claim_id", F.concat(F.col("image_id"), F.lit("_claim_"), F.col("i").cast("string"))).withColumn("content_type", infer_content_type(F.col("claim_text")))


def fill(text: Column, values: Column) -> Column:
    """[SLOT] and {SLOT} replaced by their values."""

    def put(t: Column, e: Column) -> Column:
        once = F.replace(t, F.concat(F.lit("["), e["key"], F.lit("]")), e["value"])
        return F.replace(once, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"])

    return F.aggregate(F.array_sort(F.map_entries(values)), text, put)


def apply_prefill(templates: DataFrame) -> DataFrame:
    """Text, placeholders and slots after known values are put in; the unfilled text and all values are kept."""
    known = F.map_filter("prefilled", lambda k, v: clean_text(v) != "")
    names = F.map_keys(known)
    return (
        templates.withColumn("original_template", F.col("template_text"))
        .withColumn("template_text", fill(F.col("template_text"), known))
        .withColumn("placeholders", F.array_except("placeholders", names))
        .withColumn("slots", F.map_filter("slots", lambda k, v: ~F.array_contains(names, k)))
        .withColumn("filled_values", F.map_concat(known, F.map_filter("filled_values", lambda k, v: ~F.array_contains(names, k))))
    )


def any_value(values: Column) -> Column:
    return F.exists(F.map_values(values), lambda v: clean_text(v) != "")


def keep_prefill(relevant: Column, values: Column) -> Column:
    """Relevant and some value; where relevance is null, some value."""
    return F.coalesce(relevant, F.lit(True)) & F.coalesce(any_value(values), F.lit(False))


def skipped_images(rows: DataFrame) -> DataFrame:
    """P20: image_id, skipped, skip_reason. rows: image_id, needs_prefill, kept."""
    out = rows.groupBy("image_id").agg(F.bool_or(~F.col("needs_prefill") | F.col("kept")).alias("usable"))
    return out.select("image_id", (~F.col("usable")).alias("skipped"), F.when(~F.col("usable"), "prefill_no_object").alias("skip_reason"))


def target_object(values: Column, keys: tuple[str, ...] = ("TARGET_OBJECT", "OBJECT", "OBJECT_A", "TARGET")) -> Column:
    """The value of the first key that has one, else the first value with text."""
    by_key = [F.nullif(clean_text(F.try_element_at(values, F.lit(k))), F.lit("")) for k in keys]
    rest = F.filter(F.transform(F.array_sort(F.map_entries(values)), lambda e: clean_text(e["value"])), lambda v: v != "")
    return F.coalesce(*by_key, F.try_element_at(rest, F.lit(1)))


def pair_with_images(images: DataFrame, templates: DataFrame) -> DataFrame:
    """Every template for every image. The templates are a configuration of a few rows (checked by the caller's limit)."""
    return images.crossJoin(F.broadcast(templates))


def claims_of_images(images: DataFrame, own: DataFrame, shared: DataFrame, plain: DataFrame) -> DataFrame:
    """Own claims and shared ones; plain claims only for images without either. own: image_id, claim_text."""
    mine = images.join(own, "image_id").select("image_id", "claim_text")
    every = images.crossJoin(F.broadcast(shared.select("claim_text"))).select("image_id", "claim_text")
    both = mine.unionByName(every)
    bare = images.join(both.select("image_id").distinct(), "image_id", "left_anti")
    return both.unionByName(bare.crossJoin(F.broadcast(plain.select("claim_text"))).select("image_id", "claim_text"))


def coverage(images: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """Per image the number of own claims and whether it has any claim; shared claims count for all."""
    n = own.groupBy("image_id").agg(F.count(F.lit(1)).alias("own_claims"))
    total = shared.agg(F.count(F.lit(1)).alias("global_claims"))
    joined = images.join(n, "image_id", "left").crossJoin(F.broadcast(total)).withColumn("own_claims", F.coalesce("own_claims", F.lit(0)))
    return joined.withColumn("has_claims", (F.col("own_claims") > 0) | (F.col("global_claims") > 0))


def resolve_prefill(df: DataFrame) -> DataFrame:
    """Claim and values of a record's prefill: blank claims are null, missing values an empty map."""
    return df.withColumn("claim", F.nullif(clean_text(F.col("claim")), F.lit(""))).withColumn("prefilled_values", F.coalesce("prefilled_values", F.create_map().cast("map<string,string>")))


def resolve_prefill_by_object(df: DataFrame) -> DataFrame:
    """A target object first (the claim is kept), else the claim alone; source tells which. OBJECT_A, OBJECT_B follow."""
    v = F.col("prefilled_values")
    target = F.coalesce(target_object(v), F.nullif(clean_text(F.col("target_object")), F.lit("")))
    claim = F.nullif(clean_text(F.col("claim")), F.lit(""))
    return df.withColumns({
        "object": F.coalesce(target, F.lit("")), "source": F.when(target.isNotNull(), "object").when(claim.isNotNull(), "claim"),
        "object_a": F.try_element_at(v, F.lit("OBJECT_A")), "object_b": F.try_element_at(v, F.lit("OBJECT_B")),
    })


def prefill_payload(values: Column) -> Column:
    """Upper-case keys, trimmed values, blanks dropped."""
    clean = F.map_filter(F.transform_values(values, lambda k, v: clean_text(v)), lambda k, v: (v != "") & (clean_text(k) != ""))
    return F.transform_keys(clean, lambda k, v: F.upper(k))
