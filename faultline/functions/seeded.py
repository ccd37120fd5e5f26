"""Random choices as hashes, so that every run and every engine makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u(seed: int | str, *keys: Column | str) -> Column:
    """A number in (0, 1) from the first 32 bits of md5(seed|key|...)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)


def md5_bucket(key: Column, n: int) -> Column:
    """The 128-bit md5 of a key modulo n, folded in four 32-bit parts."""
    out = F.lit(0).cast("long")
    for part in range(4):
        word = F.conv(F.substring(F.md5(key.cast("binary")), 8 * part + 1, 8), 16, 10).cast("long")
        out = (out * ((1 << 32) % n) + word) % n
    return out


def pick(values: list[str], share: Column) -> Column:
    """The value at a share in (0, 1) of a list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(share * len(values)) + 1).cast("int"))
