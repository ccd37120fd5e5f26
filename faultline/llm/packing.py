"""Bounded-space online packing of token ids into windows.

Each input partition keeps ``open_windows`` windows. A document's full windows go out at once; its rest goes to the
open window with the least room that still takes it. When none takes it and no further window may be opened, the
fullest is completed with the head of the rest (``min_piece`` ids at least, else it is left padded) and goes out. What
is open at the end of a partition is small, whatever the partition's size; the leftovers of ``merge_span`` partitions
meet in one group and are merged there in the same way. So nothing is shuffled but the leftovers, a lost task repeats
one partition, and padding is a few ids in windows that were closed early and one short window for each merge group.

Defined results: a null or empty text is the end id alone; a null id is kept; repeated rows are packed as documents of
their own; an empty table gives no pieces; other columns are not read; a long text fills as many windows as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import materialize, only, raw_texts, small_batches
from faultline.llm.tokens import VOCABULARY, encoder

CAPACITY = 1024
END = 0
#: Sequence ids of merged leftovers start here; those of partition p start at p << 32.
MERGED = 1 << 60

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Pieces are (doc_id, start, ids as bytes, doc_tokens). A closed window's pieces are given to ``emit``."""

    def __init__(self, emit: Callable[[int, list], None], first_id: int, capacity: int, open_windows: int, min_piece: int) -> None:
        self.emit, self.next_id, self.capacity, self.most, self.min_piece = emit, first_id, capacity, open_windows, min_piece
        self.room: list[int] = []
        self.held: list[list] = []

    def _close(self, pieces: list) -> None:
        self.emit(self.next_id, pieces)
        self.next_id += 1

    def add(self, doc_id: int | None, start: int, ids: bytes, total: int) -> None:
        size = 4 * self.capacity
        at = 0
        while len(ids) - at >= size:
            self._close([(doc_id, start + at // 4, ids[at : at + size], total)])
            at += size
        while at < len(ids):
            n = (len(ids) - at) // 4
            fit = min((r, w) for w, r in enumerate(self.room) if r >= n)[1] if max(self.room, default=0) >= n else -1
            if fit < 0 and len(self.room) < self.most:
                self.room.append(self.capacity)
                self.held.append([])
                fit = len(self.room) - 1
            if fit < 0:
                fit = self.room.index(min(self.room))
                n = self.room[fit]
                if n < self.min_piece:  # a piece of so few ids is of no use: these stay padding
                    self._close(self.held[fit])
                    self.room[fit], self.held[fit] = self.capacity, []
                    continue
            self.held[fit].append((doc_id, start + at // 4, ids[at : at + 4 * n], total))
            self.room[fit] -= n
            at += 4 * n
            if not self.room[fit]:
                self._close(self.held.pop(fit))
                self.room.pop(fit)


class Rows:
    """Gathers rows of PIECES and gives them as batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def closed(self, sequence_id: int, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence_id, offset, None))
            offset += len(ids) // 4

    def left(self, window: int, pieces: list) -> None:
        for k, (doc_id, start, ids, total) in enumerate(pieces):
            self.rows.append((doc_id, start, len(ids) // 4, None, total, window, k, ids))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary()]
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * 8
        out = pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names)
        self.rows = []
        return out


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, capacity: int = CAPACITY, open_windows: int = 16, min_piece: int = 8, merge_span: int = 16) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    tail = end.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, model, rows = TaskContext.get().partitionId(), encoder(vocabulary), Rows()
        packer = Packer(rows.closed, part << 32, capacity, open_windows, min_piece)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                ids = model.encode(text.decode("utf-8", "replace")) + tail
                packer.add(doc_id, 0, ids, len(ids) // 4)
            yield rows.batch()
        for w, pieces in enumerate(packer.held):
            rows.left((part << 32) + w, pieces)
        yield rows.batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of a partition come sorted by group, window and place in it: one open packer at a time.
        rows, packer, now = Rows(), None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["unit"] != now:
                    if packer:
                        for pieces in packer.held:
                            packer._close(pieces)
                    now = r["unit"]
                    packer = Packer(rows.closed, MERGED + (now << 32), capacity, 1, 1)
                packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
            yield rows.batch()
        if packer:
            for pieces in packer.held:
                packer._close(pieces)
        yield rows.batch()

    done = materialize(only(docs, "doc_id", "text").mapInArrow(first, PIECES), "packed")
    out = [x.split()[0] for x in PIECES.split(", ")][:-1]
    left = done.where("ids is not null").withColumn("unit", F.expr(f"shiftright(sequence_id, 32) div {merge_span}"))
    merged = left.repartition("unit").sortWithinPartitions("unit", "sequence_id", "offset").mapInArrow(merge, PIECES)
    return done.where("ids is null").select(*out).unionByName(merged.select(*out))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
