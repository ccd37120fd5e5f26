"""JSON arrays of any size, read in splits and written by tasks.

Spark cuts a text file at a separator of our choice into byte ranges, so an array without line breaks is read as pieces
that end in ``}``. Where a range begins, nothing tells whether it is in a text, or how deep in an element. So each range is
summed up twice, as if it began in a text and as if not: whether it ends in one, and how much deeper. These sums, one row
for each range, are composed in order; then each range is read again with the state in which it begins and gives its
elements. Elements that lie over a border come as fragments, which are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECES = "path string, start long, value string"
_ESCAPED = re.compile(r"\\.", re.DOTALL)


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, start (of the byte range), value: texts up to a ``}``, in order within a range."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[str]]]:
    """Pieces of a batch by range."""
    paths, starts, values = (c.to_pylist() for c in batch.columns)
    at = 0
    while at < len(starts):
        end = at + 1
        while end < len(starts) and starts[end] == starts[at] and paths[end] == paths[at]:
            end += 1
        yield paths[at], starts[at], values[at:end]
        at = end


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range and both states in which it may begin: whether it ends in a text, and by how much deeper."""
    ranges: dict[tuple[str, int], list[list[int]]] = {}  # a task has few ranges
    for batch in batches:
        for path, start, values in _runs(batch):
            states = ranges.setdefault((path, start), [[0, 0], [1, 0]])
            parts = _ESCAPED.sub("", "}".join(values) + "}").split('"')
            for s in states:
                outside = "".join(parts[s[0] :: 2])
                s[1] += outside.count("{") + outside.count("[") - outside.count("}") - outside.count("]")
                s[0] = (s[0] + len(parts) - 1) % 2
    rows = [(p, b, first, end, deeper) for (p, b), states in ranges.items() for first, (end, deeper) in enumerate(states)]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["path", "start", "first", "last", "deeper"])


def begins(found: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """In a text or not, and how deep, where each range begins. found: rows of ``summed``, two for each range."""
    rows = {(r.path, r.start, r.first): (r.last, r.deeper) for r in found.collect()}
    out: dict[tuple[str, int], tuple[int, int]] = {}
    for path, start in sorted({k[:2] for k in rows}):
        if not out or last[0] != path:
            last = (path, 0, 0)
        out[path, start] = last[1:]
        state, deeper = rows[path, start, last[1]]
        last = (path, state, last[2] + deeper)
    return out


def elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value: the elements of the arrays in some files, as JSON. Elements are objects; blank files have none."""
    rows = pieces(spark, path)
    states = spark.sparkContext.broadcast(begins(rows.mapInArrow(summed, "path string, start long, first int, last int, deeper long")))  # a row for each range

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, text, depth, held, fresh = None, 0, 0, [], True

        def left() -> list[tuple]:
            """What a range leaves open: the beginning of an element, or the middle of one that began before."""
            rest = "".join(held)
            return [(at[0], at[1], "middle" if not fresh else "begin", rest)] if at and depth > 1 and rest else []

        for batch in batches:
            out: list[tuple] = []
            for path_, start, values in _runs(batch):
                if (path_, start) != at:
                    out += left()
                    at, held = (path_, start), []
                    text, depth = states.value[at]
                    fresh = depth <= 1  # else the first element began before this range
                for value in values:
                    piece = value + "}"
                    held.append(piece)
                    parts = _ESCAPED.sub("", piece).split('"')
                    outside = "".join(parts[text::2])
                    text = (text + len(parts) - 1) % 2
                    depth += outside.count("{") + outside.count("[") - outside.count("}") - outside.count("]")
                    if depth == 1 and not text:
                        out.append((path_, start, "whole" if fresh else "end", "".join(held)))
                        held, fresh = [], True
            yield _rows(out)
        yield _rows(left())

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "start", "kind", "value"])

    found = rows.mapInArrow(cut, "path string, start long, kind string, value string")
    whole = found.where("kind = 'whole'").select("value")
    number = F.sum((F.col("kind") == "begin").cast("int")).over(Window.partitionBy("path").orderBy("start", F.col("kind") == "begin"))
    parts = found.where("kind <> 'whole'").withColumn("n", number)  # two fragments for each range at most
    order = F.array_sort(F.collect_list(F.struct("start", (F.col("kind") == "begin").alias("b"), "value")))
    joined = parts.groupBy("path", "n").agg(F.array_join(F.transform(order, lambda x: x["value"]), "").alias("value"))
    return whole.unionByName(joined.select("value")).select(F.regexp_replace("value", r"^[\s,\x{FEFF}]*\[?[\s,]*", "").alias("value"))


def read_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The elements of JSON arrays by a schema; an element that doesn't fit it has nulls."""
    return elements(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")


def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of JSON as the lines of one array; a row is held back, so that the last one is known."""
    last, opened = None, False
    for batch in batches:
        lines = []
        for value in batch.column(0).to_pylist():
            if last is not None:
                lines.append(("," if opened else "[") + last)
                opened = True
            last = value
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    end = "[]" if last is None else ("," if opened else "[") + last + "]"
    yield pa.RecordBatch.from_arrays([pa.array([end], pa.string())], ["value"])


def write_arrays(rows: DataFrame, path: str) -> None:
    """K3: each file is a JSON array; memory is that of a batch, and files appear when the whole job commits."""
    rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(framed, "value string").write.text(path)
