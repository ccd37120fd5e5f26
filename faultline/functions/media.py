"""Functions on image bytes and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_base64(text: Column) -> Column:
    """the bytes, after the comma of a data URL; null if it can't be read."""
    return F.try_to_binary(F.when(text.startswith("data:"), F.substring_index(text, ",", -1)).otherwise(text), F.lit("base64"))


def image_format(data: Column) -> Column:
    """by the first bytes; jpg if they say nothing."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E47"), "png").when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").otherwise("jpg")
    )


def encode_base64(data: Column) -> Column:
    """F23."""
    return F.base64(data)


def image_input_kind(text: Column) -> Column:
    """F24."""
    return (
        F.when(text.rlike(r"^https?://"), "url").when(text.startswith("data:"), "data_url")
        .when((F.length(text) > 50) & text.rlike(r"^[A-Za-z0-9+/=\s]+$"), "base64").otherwise("path")
    )


def multi_hot(ids: Column, order: list[str]) -> Column:
    """F29."""
    return F.transform(F.array(*[F.lit(x) for x in order]), lambda x: F.array_contains(ids, x).cast("int"))


def dot(a: Column, b: Column) -> Column:
    """cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(a: Column) -> Column:
    """a zero vector stays."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))
