"""Profiles of a table's columns and of its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bits of a value's place in the order of doubles that one reading settles, and rows at which it settles all the others.
DIGIT, FEW_ROWS = 16, 100_000


def _places(x: np.ndarray) -> np.ndarray:
    """Numbers in the order of doubles: -infinity first, then the finite ones, infinity, NaN last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _value(place: int) -> float:
    bits = place & ~(1 << 63) if place >> 63 else ~place & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def ranked_values(df: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The values at some ranks (from 0, nulls left out) of columns of numbers, exactly.

    A double's bits give its place in an order in which infinities and NaN have theirs. Each reading settles 16 of the 64
    bits, for all columns and ranks at once, by counting the next bits of the values that begin like the one sought; once
    few rows begin like any of them, one more reading settles the rest. So there are four readings at most, whatever the
    values are; no task holds a column, and the driver gets a row for each rank.
    """
    # (column, rank) -> first bits, rank among the values that have them, number of these
    found = {(c, k): (0, k, FEW_ROWS + 1) for c, ks in ranks.items() for k in ks}
    columns = list(ranks)
    if not found:
        return {}
    read = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    done = 0
    while done < 64:
        width = 64 - done if max(n for _, _, n in found.values()) <= FEW_ROWS else DIGIT
        sought = sorted({(columns.index(c), first) for (c, _), (first, _, _) in found.items()})  # ranks that agree so far share a count

        def counts(batches: Iterator[pa.RecordBatch], done=done, width=width, sought=sought) -> Iterator[pa.RecordBatch]:
            n = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] for _ in sought]
            for batch in batches:
                for s, (c, first) in enumerate(sought):
                    x = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                    place = _places(x.astype(np.float64))
                    if done:
                        place = place[place >> np.uint64(64 - done) == np.uint64(first)]
                    digit = ((place >> np.uint64(64 - done - width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    n[s].append(_summed([*n[s], (digit, np.ones(len(digit), np.int64))]))  # as many as there are digits, or few rows
                    del n[s][:-1]
            d = [x[0][0] for x in n]
            s = np.repeat(np.arange(len(d)), [len(x) for x in d])
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(np.concatenate(d)), pa.array(np.concatenate([x[0][1] for x in n]))], ["s", "digit", "n"])

        total = read.mapInArrow(counts, "s long, digit long, n long").groupBy("s", "digit").agg(F.sum("n").alias("n"))
        upto = total.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)))
        wanted = [(key, sought.index((columns.index(key[0]), first)), left) for key, (first, left, _) in found.items()]
        at = F.array(*[F.struct(F.lit(i).alias("key"), F.lit(s).alias("s"), F.lit(left).cast("long").alias("left")) for i, (_, s, left) in enumerate(wanted)])
        hit = upto.select("*", F.explode(F.filter(at, lambda w: (w["s"] == F.col("s")) & (w["left"] >= F.col("upto") - F.col("n")) & (w["left"] < F.col("upto")))).alias("w"))
        for r in hit.select("w.key", "digit", F.col("w.left") - F.col("upto") + F.col("n"), "n").collect():  # one row for each rank
            key = wanted[r[0]][0]
            found[key] = (found[key][0] << width | r[1], r[2], r[3])
        done += width
    return {key: _value(place) for key, (place, _, _) in found.items()}


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digits with the sums of their counts."""
    digits, at = np.unique(np.concatenate([d for d, _ in parts]), return_inverse=True)
    return digits, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(digits)).astype(np.int64)


def medians(df: DataFrame, columns: list[str], stats: dict[str, tuple[int, float, float]]) -> dict[str, float | None]:
    """The exact median of each column. stats: rows with a value, smallest and largest value; constant columns aren't read."""
    found = {(c, k): lo for c, (n, lo, hi) in stats.items() if n for k in ((n - 1) // 2, n // 2) if lo == hi}
    found |= ranked_values(df, {c: sorted({(n - 1) // 2, n // 2}) for c, (n, lo, hi) in stats.items() if n and lo != hi})
    return {c: (found[c, (n - 1) // 2] + found[c, n // 2]) / 2 if n else None for c, (n, _, _) in stats.items()}


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each numeric column count, nulls, null_pct, min, max, mean, median (exact) and std.

    NaN counts as a value, the largest of all. Two middle values of opposite infinity have the median NaN.
    """
    out = []
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        out.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.round(100 * F.avg(x.isNull().cast("int")), 6).alias("null_pct"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev(x), 6).alias("std"),
        ))
    rows = df.agg(F.array(*out).alias("p")).select(F.explode("p").alias("p")).select("p.*").collect()  # one row for each column
    middle = medians(df, columns, {r["column"]: (r.n - r.nulls, r.min, r.max) for r in rows})
    kind = "column string, n long, nulls long, null_pct double, min double, max double, mean double, median double, std double"
    half = {c: None if x is None else round(x, 6) for c, x in middle.items()}
    return df.sparkSession.createDataFrame([(r["column"], r.n, r.nulls, r.null_pct, r.min, r.max, r["mean"], half[r["column"]], r["std"]) for r in rows], kind)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each column: distinct first, then counted, so a value meets itself in one place only."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return pairs.where("value is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))


def common_values(df: DataFrame, columns: list[str], few: int = 20, top: int = 10) -> DataFrame:
    """All values of columns with at most ``few``, the ``top`` most frequent of others."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = pairs.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    total = F.count(F.lit(1)).over(Window.partitionBy("column"))
    return counts.withColumns({"rank": rank, "total": total}).where((F.col("total") <= few) | (F.col("rank") <= top)).select("column", "value", "n", "rank")


def table_quality(df: DataFrame) -> DataFrame:
    """Rows, columns, rows that repeat an earlier one, rows with any null."""
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(c).isNull()
    groups = df.withColumn("_null", any_null).groupBy(*df.columns, "_null").agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum("_n").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.sum(F.col("_n") - 1).alias("duplicate_rows"), F.sum(F.when(F.col("_null"), F.col("_n")).otherwise(0)).alias("rows_with_null"))


def preview(df: DataFrame, n: int, texts: list[str], width: int = 80) -> DataFrame:
    """T6."""
    return df.limit(n).select(*[F.left(c, F.lit(width)).alias(c) if c in texts else F.col(c) for c in df.columns])
