"""Text functions as Column expressions: placeholders, content types, and parsers of model answers.

Parsers read free text, so they use the ``try_`` functions: what can't be read is null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords by content type, in order of precedence.
CONTENT_KEYWORDS = (
    ("count", ("how many", "count", "number of")),
    ("spatial", ("left", "right", "above", "below", "beside", "near")),
    ("action", ("doing", "action", "performing", "is")),
    ("attribute", ("color", "size", "shape", "attribute")),
    ("object", ("contains", "has", "there is", "there are", "show")),
    ("text", ("text", "says", "reads", "words")),
)
CAPABILITY_CONTENT = (
    ("spatial", ("spatial", "localization")),
    ("count", ("count", "number")),
    ("attribute", ("attribute",)),
    ("action", ("action",)),
    ("text", ("text",)),
    ("object", ("object",)),
)
# Failure categories by parts of a capability's name, in order of precedence.
CAPABILITY_CATEGORY = (
    ("spatial_reasoning", ("spatial", "localization", "position")),
    ("conceptual", ("concept", "abstraction")),
    ("relational_reasoning", ("count", "counting")),
    ("negative_reasoning", ("absence", "negative")),
    ("robustness", ("occlusion", "partial", "robust")),
    ("scale_reasoning", ("scale", "proportion", "size")),
    ("spatial_reasoning", ("orientation", "direction")),
    ("geographic_reasoning", ("place", "geographic", "map")),
    ("text_image_alignment", ("caption", "text", "alignment")),
    ("visual_grounding", ("entity", "visual", "recognition")),
)
# Words that mark an error as one of the connection.
CONNECTION_WORDS = ("connection", "connect", "network", "timeout", "unreachable", "refused", "disconnected", "broken pipe", "reset", "failed to establish")
# Tokens that are no answer and no option.
EMPTY_TOKENS = ("{", "}", "[", "]", "(", ")", ",", ".", ":", ";", "!", "?", "null", "None", "undefined")
# Failure reason -> filtering factor.
TAXONOMY_FACTORS = {
    "visual_error": "visual_accuracy",
    "visual_ambiguity": "visual_clarity",
    "language_misunderstanding": "language_clarity",
    "language_complexity": "reasoning_complexity",
    "reasoning_error": "reasoning_ability",
    "commonsense_error": "commonsense_knowledge",
    "model_limitation": "distribution_coverage",
    "uncertain": "information_sufficiency",
}
# Failures from the lowest to the highest priority.
FAILURE_PRIORITY = (
    "FR_SCALE_PROPORTION_ERROR",
    "FR_OBJECT_ORIENTATION_ERROR",
    "FR_OBJECT_COUNTING_CONFUSION",
    "FR_ABSOLUTE_POSITION_ERROR",
    "FR_RELATIVE_POSITION_ERROR",
    "FR_ABSENCE_REASONING_FAILURE",
    "FR_INTRA_CLASS_INSTANCE_POSITIONING_FAILURE",
    "FR_BASIC_VISUAL_ENTITY_GROUNDING_FAILURE",
)
# What a filled text must not contain.
PLACEHOLDERS = (r"\[.*?\]", r"\{.*?\}", r"<.*?>", r"___+", r"\.\.\.+")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _first(text: Column, table: tuple, default: Column) -> Column:
    out = default
    for value, words in reversed(table):
        out = F.when(has_any(text, words), F.lit(value)).otherwise(out)
    return out


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """trimmed, null as empty."""
    return F.coalesce(strip(text), F.lit(""))


def extract_placeholders(text: Column) -> Column:
    """names in {} first, then in [], each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"\{([^}]+)\}"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1))))


def infer_content_type(text: Column) -> Column:
    """F2."""
    return _first(F.lower(text), CONTENT_KEYWORDS, F.lit("relation"))


def content_type_from_capability(capability: Column) -> Column:
    """F3."""
    return _first(F.lower(capability), CAPABILITY_CONTENT, F.lit(None).cast("string"))


def capability_to_category(capability: Column) -> Column:
    """F4."""
    found = _first(F.lower(capability), CAPABILITY_CATEGORY, F.lit(None).cast("string"))
    grounded = F.when(F.contains(F.lower(capability), F.lit("grounding")), "conceptual_grounding").otherwise("conceptual_abstraction")
    return F.when(found == "conceptual", grounded).otherwise(found)


def failure_priority(key: Column) -> Column:
    """place in the order of priority, -1 if not in it."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in FAILURE_PRIORITY]), key), F.lit(0)) - 1


def failure_weight(key: Column) -> Column:
    """(priority + 2) squared, 1 for unknown keys."""
    return F.pow(failure_priority(key) + 2, F.lit(2.0))


def taxonomy_factor(reason: Column) -> Column:
    """F7."""
    pairs = [x for k, v in TAXONOMY_FACTORS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), reason), F.lit("unknown"))


def json_text(text: Column) -> Column:
    """F8: from the first { to the last }; null if that is no JSON."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def json_fenced(text: Column) -> Column:
    """JSON of a fenced block, else F8."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.coalesce(F.when(F.try_parse_json(fenced).isNotNull(), fenced), json_text(text))


def json_get(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")


def parse_bool(text: Column, default: Column | None = None) -> Column:
    """true, 1 and yes are true, other texts are false; null gives the default."""
    return F.when(text.isNull(), default if default is not None else F.lit(False)).otherwise(F.lower(F.trim(text)).isin("true", "1", "yes"))


def parse_float(text: Column, default: float = 0.0) -> Column:
    """F11."""
    return F.coalesce(text.try_cast("double"), F.lit(default))


def parse_issues(text: Column) -> Column:
    """a JSON list as array, a scalar as array of one, null as empty array."""
    return F.when(text.isNull(), F.array().cast("array<string>")).when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))


def verdict_valid(text: Column) -> Column:
    """the word after ``valid:`` (ASCII or full-width colon) as boolean; null if there is none."""
    word = F.nullif(F.regexp_extract(text, r"(?i)valid\s*[:：]\s*(\w+)", 1), F.lit(""))
    return F.when(word.isNotNull(), F.lower(word).isin("true", "yes", "1", "valid"))


def verdict_reason(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?i)reason\s*[:：]\s*([^\n]*)", 1))


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, r"""^["'`]+|["'`]+$""", "")


def parse_answer(text: Column) -> Column:
    """``answer`` of JSON, else the text after ``Answer:``, else the first line with text."""
    j = json_fenced(text)
    found = F.coalesce(json_get(j, "answer"), json_get(j, "Answer"), F.nullif(F.regexp_extract(text, r"(?i)answer\s*[:：]\s*([^\n]+)", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"([^\s][^\n]*)", 1), F.lit("")))
    return unquote(F.trim(found))


def parse_options(text: Column) -> Column:
    """a JSON list, else ``Option n:``, ``A:`` or ``1.`` lines, else all lines with text."""
    listed = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")), "array<string>")
    out = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    for pattern in (r"(?m)^\s*\d+\.\s*([^\n]+)$", r"(?m)^\s*[A-H]\s*[:.]\s*([^\n]+)$", r"(?mi)^\s*option\s*\d+\s*[:：]\s*([^\n]+)$"):
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        out = F.when(F.size(found) > 0, F.transform(found, lambda x: F.trim(x))).otherwise(out)
    return F.coalesce(listed, out)


def clean_question(text: Column) -> Column:
    """F16: the first line, without quotes and a leading ``Question:``."""
    line = F.element_at(F.split(strip(text), "\n"), 1)
    return strip(unquote(strip(F.regexp_replace(unquote(strip(line)), r"(?i)^(question|q)\s*[:：]\s*", ""))))


def slot_value(text: Column) -> Column:
    """``value`` of JSON, else the text after ``value:``, else the first line."""
    return F.coalesce(json_get(json_text(text), "value"), F.nullif(F.trim(F.regexp_extract(text, r"(?i)value\s*[:：]\s*([^\n]+)", 1)), F.lit("")), F.trim(F.element_at(F.split(text, "\n"), 1)))


def strip_options(question: Column) -> Column:
    """the question before its options."""
    return F.substring_index(F.substring_index(question, "\nA:", 1), "\nA. ", 1)


def render_full_question(question: Column, options: Column) -> Column:
    """the question and its options in order of their keys."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return F.when(F.size(options) > 0, F.concat(question, F.lit("\n"), lines)).otherwise(question)


def parse_named(text: Column, name: str) -> Column:
    """the value after ``name:`` in a line (name, category, confidence)."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?i){name}\s*[:：]\s*([^\n,]+)", 1)), F.lit(""))


def trace_id(run: str | None, batch: Column, row: Column, sample: Column, image: Column) -> Column:
    """F25."""
    text = F.concat(F.lit(f"{run}_" if run else ""), F.lit("B"), batch, F.lit("_R"), row, F.lit("_S"), sample, F.lit("_I"), F.coalesce(image.cast("string"), F.lit("")))
    return F.left(F.translate(text, "/", "_"), F.lit(80))


def image_id_of_claim(claim_id: Column) -> Column:
    """F26."""
    return F.substring_index(claim_id, "_template_", 1)


def truncate(text: Column, n: int) -> Column:
    """F27."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def safe_name(text: Column) -> Column:
    """F28."""
    return F.translate(text, "/\\ ", "___")


def selection_part(text: Column, tag: str) -> Column:
    """F32: the contents of all <tag>...</tag> of a selection."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), lambda x: F.trim(x))


def selection_format_ok(text: Column) -> Column:
    """reasoning, then agents with prompts."""
    return text.rlike(r"(?s)<reasoning>.*?</reasoning>") & text.rlike(r"(?s)<agent>\s*\S.*?</agent>") & text.rlike(r"(?s)<prompt>\s*\S.*?</prompt>")


def is_connection_error(text: Column) -> Column:
    """F35."""
    return has_any(F.lower(text), CONNECTION_WORDS)


def valid_token(text: Column) -> Column:
    """Neither blank nor a mere sign or null word."""
    return (clean_text(text) != "") & ~clean_text(text).isin(*EMPTY_TOKENS)


def placeholder_in(text: Column) -> Column:
    out = F.lit(False)
    for p in PLACEHOLDERS:
        out = out | F.coalesce(text.rlike(p), F.lit(False))
    return out
