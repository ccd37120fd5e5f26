"""Token ids in wavelet matrices, one per shard.

A shard holds the ids of consecutive documents as bit-planes from the highest bit down, each plane stably ordered by the
plane above. Counts of ones before every 512th bit, stored with the plane, make rank a lookup and a popcount, select a
binary search. A plane is compressed in parts of ``PART`` bytes. So one file image gives token access, counting of an id
in any range and lookup of its k-th occurrence, and reads one or two parts of each plane for it, not the shard.

Shards are rows of a table (first place, image) that Spark writes: a task that is lost or run twice leaves no half
files, and any store that Spark writes to will do. Shards end at document borders after ``shard_tokens`` ids.

Defined results: a null or empty text is the end id alone; null ids come first; rows with one id are ordered by text;
equal rows are documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import few, materialize, n_shuffle, only, raw_texts, small_batches
from faultline.llm.tokens import VOCABULARY, encoder

END = 2
SHARD_TOKENS = 1 << 19
#: Shards whose places are broadcast; with more of them, images are shuffled to their places.
FEW_SHARDS = 100_000
#: Pieces of texts that a worker remembers; images leave room for more of them than other operators do.
PIECES = 700_000
MAGIC = b"WVM2"
BLOCK = 512
#: Bytes of a plane that are compressed together.
PART = 1 << 13
#: Decompressed parts that a reader keeps.
MOST_PARTS = 256
#: magic, bits, documents, ids
HEAD = struct.Struct("<4sIQQ")

_pack = zstandard.ZstdCompressor(level=1).compress


def ranks_of(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of BLOCK bits, and all ones at the end."""
    ones = np.bitwise_count(plane)
    each = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 8), dtype=np.int64) if len(ones) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(each)]).astype("<u4")


def build(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file image of a shard: ids (uint32) of consecutive documents with the given lengths.

    Head; size and bytes of the compressed ends of documents; then for each plane its rank counts, the ends of its
    compressed parts, and the parts.
    """
    bits = max(1, int(ids.max(initial=0)).bit_length())
    ends = _pack(np.cumsum(lengths, dtype="<u8").tobytes())
    out = [HEAD.pack(MAGIC, bits, len(lengths), len(ids)), struct.pack("<Q", len(ends)), ends]
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for level in range(bits - 1, -1, -1):
        plane = (now & now.dtype.type(1 << level)).astype(bool)
        packed = np.packbits(plane, bitorder="little")
        parts = [_pack(packed[at : at + PART].tobytes()) for at in range(0, len(packed), PART)]
        out += [ranks_of(packed).tobytes(), np.cumsum([len(x) for x in parts], dtype="<u4").tobytes(), *parts]
        if level:
            up, zeros = np.empty_like(now), len(now) - int(np.count_nonzero(plane))
            np.compress(~plane, now, out=up[:zeros])
            np.compress(plane, now, out=up[zeros:])
            now = up
    return b"".join(out)


class Wavelet:
    """Reads a file image, part by part as it needs them."""

    def __init__(self, image: bytes) -> None:
        magic, self.bits, self.n_docs, self.n = HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self.image, self._z, self._kept = image, zstandard.ZstdDecompressor(), {}
        (size,) = struct.unpack_from("<Q", image, HEAD.size)
        at = HEAD.size + 8
        self.ends = np.frombuffer(self._z.decompress(image[at : at + size], max_output_size=8 * self.n_docs), "<u8").astype(np.int64)
        at += size
        n_bytes = -(-self.n // 8)
        n_ranks, n_parts = -(-8 * n_bytes // BLOCK) + 1, -(-n_bytes // PART)
        self.n_bytes, self.ranks, self.places = n_bytes, [], []
        for _ in range(self.bits):
            self.ranks.append(np.frombuffer(image, "<u4", n_ranks, at))
            ends = np.frombuffer(image, "<u4", n_parts, at + 4 * n_ranks).astype(np.int64)
            at += 4 * (n_ranks + n_parts)
            self.places.append(np.concatenate([[at], at + ends]))
            at = int(self.places[-1][-1])

    def _part(self, k: int, part: int) -> np.ndarray:
        """Bytes of a part of plane k."""
        found = self._kept.get((k, part))
        if found is None:
            a, b = self.places[k][part : part + 2].tolist()
            found = np.frombuffer(self._z.decompress(self.image[a:b], max_output_size=PART), np.uint8)
            if len(self._kept) >= MOST_PARTS:
                self._kept.clear()
            self._kept[k, part] = found
        return found

    def _plane(self, k: int) -> np.ndarray:
        """All bits of plane k."""
        places = self.places[k].tolist()
        parts = [self._z.decompress(self.image[a:b], max_output_size=PART) for a, b in zip(places, places[1:], strict=False)]
        return np.unpackbits(np.frombuffer(b"".join(parts), np.uint8), count=self.n, bitorder="little").view(bool)

    def rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block, n = i // BLOCK, int(self.ranks[k][i // BLOCK])
        if i % BLOCK:
            at = block * BLOCK // 8 % PART  # a block lies in one part
            inner = self._part(k, block * BLOCK // 8 // PART)[at : at + BLOCK // 8]
            whole = i % BLOCK // 8
            n += int(np.bitwise_count(inner[:whole]).sum())
            n += (int(inner[whole]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0
        return n

    def bit(self, k: int, i: int) -> int:
        return int(self._part(k, i // 8 // PART)[i // 8 % PART]) >> i % 8 & 1

    def zeros(self, k: int) -> int:
        return self.n - int(self.ranks[k][-1])

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for k in range(self.bits):
            bit, ones = self.bit(k, i), self.rank1(k, i)
            out = out << 1 | bit
            i = self.zeros(k) + ones if bit else i - ones
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self.rank1(k, lo), self.rank1(k, hi)
            lo, hi = (self.zeros(k) + a, self.zeros(k) + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Times that a token stands at places lo to hi, the end excluded."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, k: int, bit: int, nth: int) -> int:
        """Place of the nth bit of a kind (from 0) in plane k."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self.rank1(k, mid + 1)
            lo, hi = (lo, mid) if (ones if bit else mid + 1 - ones) > nth else (mid + 1, hi)
        return lo

    def find(self, token: int, nth: int) -> int:
        """Place of the nth occurrence (from 0) of a token; -1 if there are fewer."""
        if nth < 0 or nth >= self.count(token):
            return -1
        at = self._range(token, 0, self.n)[0] + nth
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros(k) if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            plane, zeros = self._plane(k), self.zeros(k)
            up = np.empty_like(now)
            up[np.flatnonzero(~plane)] = now[:zeros]  # faster than by the mask itself
            up[np.flatnonzero(plane)] = now[zeros:] | kind(1 << (self.bits - 1 - k))
            now = up
        return now.astype(np.uint32)


SHARDS = "part long, shard long, n_tokens long, doc_ids binary, no_id binary, image binary"


def write_shards(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes documents in ascending order of doc_id and writes the shards; the table of them, read again."""
    spark = docs.sparkSession
    small_batches(spark)
    tail = end.to_bytes(4, "little")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, shard = encoder(vocabulary, PIECES), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, held
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            image = build(np.frombuffer(b"".join(ids), "<u4"), lengths)
            row = [part, shard, int(lengths.sum()), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids), image]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 3
            shard, held = shard + 1, 0
            ids.clear()
            doc_ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [x.split()[0] for x in SHARDS.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                ids.append(model.encode(text.decode("utf-8", "replace")) + tail)
                doc_ids.append(doc_id)
                held += len(ids[-1]) // 4
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")  # different texts of one id may lie in different ranges
    ordered = only(docs, "doc_id", "text").repartitionByRange(n_shuffle(spark), *order).sortWithinPartitions(*order, "text")
    return materialize(ordered.mapInArrow(shards, SHARDS), "wavelet")


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = shards.sparkSession
    # Ids before each range of documents: one number for each partition of the writer, summed up on the driver.
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    starts = spark.createDataFrame(rows, "part long, before long")
    sizes = shards.select("part", "shard", "n_tokens")
    own = sizes.withColumn("prior", F.expr("sum(n_tokens) over (partition by part order by shard) - n_tokens"))
    own = own.join(F.broadcast(starts), "part").select("part", "shard", (F.col("before") + F.col("prior")).alias("first"))
    placed = shards.drop("n_tokens").join(few(own, FEW_SHARDS), ["part", "shard"]).select("first", "doc_ids", "no_id", "image")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, no_id, image in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard = Wavelet(image)
                ids, begins = shard.decode().tobytes(), np.concatenate([[0], shard.ends[:-1]])
                crc = [zlib.crc32(memoryview(ids)[4 * a : 4 * b]) for a, b in zip(begins.tolist(), shard.ends.tolist(), strict=True)]
                names = pa.array(np.frombuffer(doc_ids, "<i8"), pa.int64(), mask=np.frombuffer(no_id, np.uint8) == 1)
                yield pa.RecordBatch.from_arrays([names, pa.array(first + begins), pa.array(shard.ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(rows_of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_wavelet(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
