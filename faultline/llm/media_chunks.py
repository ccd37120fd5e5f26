"""Media payloads as content-defined chunks in a deduplicated chunk store.

A rolling gear hash over the last 32 bytes decides where a payload is cut, so equal stretches give equal chunks wherever
they stand. The stored form of a medium is its recipe: the ordered list of chunk digests and lengths. Chunk bytes are
stored once for each digest.

Most media share no chunk with another one. Two steps spare those the shuffles: ``shared_chunks`` counts the digests
alone and folds those found twice into a bit field of fixed size (``FIELD_BITS``, whatever the input; bits of other
digests only send more media the longer way). A medium without a marked chunk is written in place and read back in
place. Of the others, each task writes a chunk once, Spark keeps one copy of each digest, and a join of the recipes with
the store brings the bytes back to their media. All media are then rebuilt from stored bytes, and each chunk's digest is
verified.

Defined results: a null or empty text is one unit of 64 zero bytes; equal payloads have equal results; null or repeated
ids are kept, each row for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import materialize, only, raw_texts, small_batches

UNIT = 64
LEAST, MOST, MASK_BITS = 512, 8192, 11
FIELD_BITS = 1 << 22
WINDOW = 32

MAGIC = b"CDC1"
HEAD = struct.Struct("<4sQQI")
ENTRY = struct.Struct("<32sI")


def gear(seed: int = 20240607) -> np.ndarray:
    """256 fixed random numbers, one for each byte value."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = gear()


def cuts(payload: bytes, least: int = LEAST, most: int = MOST, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks. A cut stands after a byte where the top bits of the rolling hash are zero."""
    n = len(payload)
    if n <= least:
        return [n]
    h = GEAR[np.frombuffer(payload, np.uint8)]
    step = 1
    while step < WINDOW:  # sum over the last 32 bytes of gear << age, by doubling
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h, step = longer, 2 * step
    at = np.flatnonzero(h >> np.uint32(32 - mask_bits) == 0) + 1
    out, begin = [], 0
    while n - begin > least:
        k = int(np.searchsorted(at, begin + least))
        end = min(int(at[k]) if k < len(at) else n, begin + most, n)
        out.append(end)
        begin = end
    if begin < n:
        out.append(n)
    return out


def padded(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def chunks_of(text: bytes) -> list[bytes]:
    payload, out, begin = padded(text), [], 0
    for end in cuts(payload):
        out.append(payload[begin:end])
        begin = end
    return out


def recipe(n_bytes: int, digests: list[bytes], sizes: list[int]) -> bytes:
    """The stored form of a medium."""
    return HEAD.pack(MAGIC, n_bytes, sum(sizes), len(sizes)) + b"".join(ENTRY.pack(d, n) for d, n in zip(digests, sizes, strict=True))


def feature(payload: bytes) -> str:
    """Samples, mean, deviation, zero share and entropy of the 8-bit samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = len(payload), np.arange(256)
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    share = counts[counts > 0] / n
    entropy = -math.fsum((share * np.log2(share)).tolist())
    return f"n={n};mean={total / n:.4f};dev={math.sqrt(max(0.0, squares / n - (total / n) ** 2)):.4f};zeros={int(counts[0]) / n:.4f};bits={entropy:.4f}"


def field_place(digest: bytes) -> int:
    return int.from_bytes(digest[:7], "little") % FIELD_BITS


def shared_chunks(docs: DataFrame) -> bytes:
    """A bit field of FIELD_BITS in which the places of all digests that occur twice are set."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[bytes, int] = {}
            for text in raw_texts(batch.column(0)):
                for c in chunks_of(text):
                    d = hashlib.sha256(c).digest()
                    own[d] = own.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([d[:16] for d in own], pa.binary()), pa.array([field_place(d) for d in own], pa.int64()), pa.array(own.values(), pa.int64())], ["digest", "place", "n"])

    found = only(docs, "text").mapInArrow(digests, "digest binary, place long, n long")
    twice = found.groupBy("digest", "place").agg(F.sum("n").alias("n")).where("n > 1")
    marks = twice.groupBy((F.col("place") / 64).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
    field = np.zeros(FIELD_BITS // 64, np.int64)
    for r in marks.collect():  # FIELD_BITS / 64 rows at most
        field[r.w] = r.bits
    return field.tobytes()


STORED = "medium long, doc_id long, place int, n_bytes long, digests array<binary>, sizes array<int>, chunks array<binary>"


def store(docs: DataFrame) -> DataFrame:
    """Writes the media: one row for those without a marked chunk (place null), one for each chunk of the others."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    marked = spark.sparkContext.broadcast(shared_chunks(docs))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, written, z = np.frombuffer(marked.value, np.uint8), set(), zstandard.ZstdCompressor(level=1)
        medium = TaskContext.get().partitionId() << 32
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary())]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                parts = chunks_of(text)
                digests = [hashlib.sha256(c).digest() for c in parts]
                places = [field_place(d) for d in digests]
                if not any(field[p >> 3] >> (p & 7) & 1 for p in places):
                    out.append((medium, doc_id, None, len(text), digests, [len(c) for c in parts], [z.compress(c) for c in parts]))
                else:
                    for k, (d, c) in enumerate(zip(digests, parts, strict=True)):
                        out.append((medium, doc_id, k, len(text), [d], [len(c)], [None if d in written else z.compress(c)]))
                        if len(written) < 500_000:  # else a chunk may be written twice, and Spark keeps one
                            written.add(d)
                medium += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in STORED.split(", ")])

    return materialize(only(docs, "doc_id", "text").mapInArrow(rows, STORED), "media")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, digests, sizes and compressed chunks of whole media -> features of the payload read back."""
    z = zstandard.ZstdDecompressor()
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        out = []
        for doc_id, n_bytes, digests, sizes, chunks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            parts = [z.decompress(c, max_output_size=max(1, n)) for c, n in zip(chunks, sizes, strict=True)]
            for d, c in zip(digests, parts, strict=True):
                if hashlib.sha256(c).digest() != d:
                    raise ValueError(f"a chunk of medium {doc_id} is damaged")
            payload, form = b"".join(parts), recipe(n_bytes, digests, sizes)
            out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def chunk_store(media: DataFrame) -> DataFrame:
    """One row for each digest of the media that share chunks: digest and compressed bytes."""
    parts = media.where("place is not null and chunks[0] is not null").select(F.expr("digests[0]").alias("digest"), F.expr("chunks[0]").alias("chunk"))
    return materialize(parts.groupBy("digest").agg(F.first("chunk").alias("chunk")), "chunks")


def read_back(media: DataFrame) -> DataFrame:
    """Features of all media, rebuilt from stored bytes."""
    small_batches(media.sparkSession, 500)
    need = ["doc_id", "n_bytes", "digests", "sizes", "chunks"]
    alone = media.where("place is null").select(*need)
    refs = media.where("place is not null").select("medium", "doc_id", "n_bytes", "place", F.expr("digests[0]").alias("digest"), F.expr("sizes[0]").alias("size"))
    joined = refs.join(chunk_store(media), "digest", "left")
    lists = joined.groupBy("medium", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "size", "chunk"))).alias("l"))
    shared = lists.select("doc_id", "n_bytes", F.col("l.digest").alias("digests"), F.col("l.size").alias("sizes"), F.col("l.chunk").alias("chunks"))
    return alone.unionByName(shared).mapInArrow(rebuild, FEATURES)


def op10_media_chunks(spark, sf_dir: str) -> DataFrame:
    return read_back(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
