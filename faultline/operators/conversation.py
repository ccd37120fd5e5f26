"""Question-answer rows to checked conversations. Turns are ARRAY<STRUCT<role, content>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.media import decode_base64
from faultline.functions.text import clean_text

IMAGE, MEDIA = "<image>", "<media>"


def normalize_turns(turns: Column) -> Column:
    """from/value or role/content turns to role/content."""
    name = lambda t: F.when(t["from"].isin("user", "human"), "user").when(t["from"].isin("gpt", "assistant"), "assistant").otherwise(t["from"])
    return F.transform(turns, lambda t: F.struct(name(t).alias("role"), F.coalesce(t["value"], F.lit("")).alias("content")))


def drop_system(turns: Column) -> Column:
    """P3."""
    return F.filter(turns, lambda t: t["role"] != "system")


def inject_tokens(turns: Column, media: Column) -> Column:
    """Image tokens before the first of the original turns, if it has none; a leading system turn gets none."""

    def add(t: Column, i: Column) -> Column:
        content = F.concat(F.repeat(F.lit(IMAGE), media), F.lit("\n"), F.regexp_replace(t["content"], r"^\n+", ""))
        wanted = (i == 0) & (t["role"] == "user") & ~F.contains(t["content"], F.lit(IMAGE)) & (media > 0)
        return F.struct(t["role"].alias("role"), F.when(wanted, content).otherwise(t["content"]).alias("content"))

    return F.transform(turns, add)


def turns_of(question: Column, answer: Column) -> Column:
    """P5."""
    return F.array(F.struct(F.lit("user").alias("role"), F.trim(question).alias("content")), F.struct(F.lit("assistant").alias("role"), F.trim(answer).alias("content")))


def shape_reason(turns: Column) -> Column:
    """Null if the conversation has its shape."""
    role = lambda n: F.try_element_at(turns, F.lit(n))["role"]
    return F.when(F.size(turns) < 2, "fewer than two turns").when(role(1) != "user", "first turn is not the user's").when(role(2) != "assistant", "second turn is not the assistant's")


def turns_ok(turns: Column) -> Column:
    """P7."""
    return F.forall(turns, lambda t: t["role"].isin("user", "assistant") & (clean_text(t["content"]) != ""))


def media_ok(turns: Column, media: Column, token: str = IMAGE) -> Column:
    """As many tokens in the first turn as media."""
    first = F.try_element_at(turns, F.lit(1))["content"]
    n = F.size(F.regexp_extract_all(first, F.lit(token), F.lit(0)))
    return F.coalesce((n > 0) & (n == media), F.lit(False))


def media_list(df: DataFrame, column: str) -> DataFrame:
    """One medium, a struct with bytes, or a list of either as named media 0_image, 1_image, ..."""
    kind = df.schema[column].dataType
    name = kind.typeName()
    if name == "binary":
        items = F.array(F.col(column))
    elif name == "struct":
        items = F.array(F.col(column)["bytes"])
    elif name == "array" and kind.elementType.typeName() in ("binary", "struct"):
        items = F.col(column) if kind.elementType.typeName() == "binary" else F.transform(column, lambda x: x["bytes"])
    else:
        raise TypeError(f"column {column} of type {kind.simpleString()} holds no media")
    named = F.transform(items, lambda x, i: F.struct(F.concat(i.cast("string"), F.lit("_image")).alias("name"), x.alias("bytes")))
    return df.withColumn("media", named)


def qa_conversation(qa: DataFrame) -> DataFrame:
    """P10: question, answer_text and turns of question-answer rows."""
    question = clean_text(F.coalesce("full_question", "question"))
    answer = clean_text(F.col("answer"))
    letter = F.upper(answer)
    option = clean_text(F.try_element_at("options", letter))
    text = F.when((F.length(letter) == 1) & (option != ""), F.concat(letter, F.lit(". "), option)).otherwise(answer)
    reason = clean_text(F.col("explanation"))
    full = F.when((answer != "") & (reason != ""), F.concat(text, F.lit("\n\nExplanation: "), reason)).otherwise(text)
    return qa.withColumn("q", question).withColumn("a", full).withColumn("turns", turns_of(F.col("q"), F.col("a")))


def conversation_reason(turns: Column) -> Column:
    """The first thing wrong with a conversation, null if nothing."""
    role = lambda n: F.try_element_at(turns, F.lit(n))["role"]
    return (
        F.when(turns.isNull(), "no list").when(F.size(turns) < 2, "fewer than two turns")
        .when(F.exists(turns, lambda t: t["role"].isNull() | t["content"].isNull()), "field missing")
        .when(F.exists(turns, lambda t: ~t["role"].isin("user", "assistant", "system")), "unknown role")
        .when(F.exists(turns, lambda t: clean_text(t["content"]) == ""), "blank turn")
        .when(role(1) != "user", "first turn is not the user's").when(role(2) != "assistant", "second turn is not the assistant's")
    )


def classify(conversations: DataFrame) -> DataFrame:
    """reject_reason of rows with image_base64, q, a and turns; null where the row converts."""
    image = F.col("image_base64")
    reason = (
        F.when(F.coalesce(image, F.lit("")) == "", "no_image").when(decode_base64(image).isNull(), "image_decode_fail")
        .when(F.col("q") == "", "empty_question").when(F.col("a") == "", "empty_answer")
        .when(conversation_reason(F.col("turns")).isNotNull(), "conversation_invalid")
    )
    return conversations.withColumn("reject_reason", reason)


def diagnose(qa: DataFrame, order: str, n: int = 100) -> DataFrame:
    """All issues of the first n rows."""
    blank = lambda c: clean_text(F.col(c)) == ""
    issues = F.array_compact(F.array(F.when(blank("image_base64"), "no_image"), F.when(blank("question") & blank("full_question"), "empty_question"), F.when(blank("answer"), "empty_answer")))
    return qa.orderBy(order).limit(n).withColumn("issues", issues).where(F.size("issues") > 0)


def conversion_stats(classified: DataFrame) -> DataFrame:
    """Rows and percent by reason, 'success' for those that convert."""
    counts = classified.groupBy(F.coalesce("reject_reason", F.lit("success")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def error_log(classified: DataFrame, key: str) -> DataFrame:
    """K8: key and reason of rejected rows."""
    return classified.where("reject_reason is not null").select(key, "reject_reason")
