"""Exact n-gram Jaccard join with PartEnum signatures, and the components of its links.

A document's set has a 64-bit hash for each distinct word shingle. Texts with equal sets form one node. Two nodes link
at Jaccard similarity 0.75 or more, so their sets differ in at most (a + b) / 7 elements and each lacks at most a fourth
of the other's.

1. ``sets``: one row per document with its node and set size.
2. ``survivors``: of a fixed two fifths of the feature domain, count the elements of each set that another set has
   too. A node that lacks more than a fourth of its set cannot link, and most nodes end here. Elements that a batch of
   texts holds twice are counted in place and leave it once, so a passage of many texts doesn't gather in one task. The
   same is then counted over the whole sets of the nodes that are left (``sharing_most``).
3. ``signatures``: PartEnum. Bands of set sizes grow by 4/3, so linked sets lie in one band or in neighbouring ones, and
   each set signs for its own band and the next. Nodes that meet in a band that is none's own meet in their own as well,
   so such a meeting is passed over. For a band, the domain is split into first-level parts of three cells.
   If k elements differ, some part has at most one differing element, so two of its cells agree: each pair of cells of
   each part is a signature. Empty pairs don't sign; a set that has too few parts with two filled cells for the bound to
   hold without them signs with its ``n // 4 + 1`` first elements in hash order as well. If both sets of a linked pair are
   such sets, these share an element; if one isn't, the parts do.
4. ``families``: the first member of a signature is the one that lacks the least by step 2, ties by hash. A node's
   families are the distinct first members of its signatures: nodes that share a signature share a family, and copies
   of one text have it as their first member in nearly all signatures, so there are few families for each node.
5. ``links``: a family's sets meet in one task, or, above ``BLOCK`` members or ``BLOCK_BYTES``, in one task for each
   pair of its blocks, always with the first member. There all pairs of different components are compared, the first
   member's first: by parity sketches, whose distance is at most that of the sets, then exactly. Only links that join
   components leave the task, fewer than it has members.
6. ``components``: smallest labels along the links, with shortcuts.

Rows go through tasks sorted by element or signature, so a task holds one batch and what it hands on.

Defined results: a null or empty text has an empty set, links with nothing and is its own component; a text of fewer
words than a shingle has one element, the whole sequence; null ids are allowed and never a component's id while it has
another one; rows of one id and different texts are nodes of their own; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import BLOOM, materialize, n_shuffle, only, raw_texts, settings, sliced, small_batches, unused

SHINGLE = 5
#: Members and bytes of a block of a family.
BLOCK, BLOCK_BYTES = 4096, 1 << 25
#: Expected elements in a cell for the largest sets of a band.
CELL = 2.0
#: Pairs that a task gathers before it hands on the distinct ones.
HELD = 1_000_000

_words: dict[bytes, int] = {}
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


TURNS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def word_ids(words: list[bytes]) -> np.ndarray:
    if len(_words) > 400_000:
        _words.clear()
    ids = list(map(_words.get, words))
    if None in ids:
        for i, x in enumerate(ids):
            if x is None:
                ids[i] = _words[words[i]] = xxhash.xxh3_64_intdigest(words[i]) - (1 << 63)
    return np.array(ids, dtype=np.int64).view(np.uint64)


def elements(texts: list[bytes], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (k is 5 at most)."""
    split = [x.lower().split() for x in texts]  # bytes: A-Z only, \x20 and \x09-\x0D only
    w = word_ids([x for words in split for x in words])
    rolled = np.full(max(0, len(w) - k + 1), k, dtype=np.uint64)
    for i in range(k if len(rolled) else 0):
        rolled += w[i : len(w) - k + 1 + i] * TURNS[i]
    rolled = mix(rolled)
    at = 0
    for words in split:
        n = len(words)
        if n >= k:
            yield distinct(rolled[at : at + n - k + 1])
        elif n:
            yield mix(np.array([n], np.uint64) + (w[at : at + n] * np.array(TURNS[:n])).sum(dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += n


def in_parts(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of texts of about so many bytes, to bound what is held at once."""
    part, size = [], 0
    for x in texts:
        part.append(x)
        size += len(x)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def all_elements(column: pa.Array) -> Iterator[np.ndarray]:
    for part in in_parts(raw_texts(column)):
        yield from elements(part)


def node_of(e: np.ndarray) -> int:
    """A hash of the whole set."""
    return int((mix(e + U64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) ^ mix(np.array([len(e)], np.uint64))[0]).view(np.int64))


def sampled(e: np.ndarray) -> np.ndarray:
    """The elements of a fixed part of the domain."""
    return e[e % U64(5) < U64(2)]


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), m (elements of the sampled part), node; one row per document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(e), len(sampled(e)), node_of(e)) for e in all_elements(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([x[k] for x in found], pa.int64()) for k in range(3)]], ["doc_id", "th", "n", "m", "node"])

    texts = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("th"), "text")
    return materialize(texts.mapInArrow(rows, "doc_id long, th long, n long, m long, node long"), "sets")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Over rows (key, node, count) sorted by them: node, count, and whether another one has the key.

    Of elements (count 0 or -1) with equal key and node one row comes; if both counts stand there, it comes with 0 and that
    is another one, too. All rows of counted elements come. A batch's last row waits for the next batch.
    """
    held, before, mixed = [np.zeros(0, np.int64)] * 3, np.zeros(0, bool), np.zeros(0, bool)
    for batch in batches:
        key, node, count = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
        if not len(key):
            continue
        same = np.concatenate([before if len(before) else [False], key[1:] == key[:-1]])
        keep = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (count[1:] > 0)])
        at = np.flatnonzero(keep)
        highest = np.maximum.reduceat(count, at)
        both = (count[at] == -1) & (highest == 0)
        if len(mixed):
            both[0] |= mixed[0]
        key, node, count, same = key[keep], node[keep], count[keep], same[keep]
        if len(key) > 1:
            yield node[:-1], np.where(both, 0, count)[:-1], same[:-1] | (key[1:] == key[:-1]) | both[:-1]
        held, before, mixed = [key[-1:], node[-1:], count[-1:]], same[-1:], both[-1:]
    if len(held[0]):
        yield held[1], np.where(mixed, 0, held[2]), before | mixed


def once_each(own: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows e, node, c of the elements of a batch's nodes, each element once.

    c: 0 for an element that the batch has once, -1 for one that it has counted, else the node's counted elements.
    """

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["e", "node", "c"])

    if not own:
        return
    e, node = np.concatenate(list(own.values())), np.repeat(np.array(list(own), np.int64), [len(p) for p in own.values()])
    order = np.argsort(e)
    e, node = e[order], node[order]
    same = np.concatenate([[False], e[1:] == e[:-1], [False]])
    twice, first = same[1:] | same[:-1], ~same[:-1]
    counted, n = np.unique(node[twice], return_counts=True)
    yield out([e[first].view(np.int64), node[first], -twice[first].astype(np.int64)])
    yield out([counted, counted, n])


def shared_counts(rows: DataFrame) -> DataFrame:
    """node, shared: of rows as once_each gives, the number of a node's elements that another node has too (or more).

    Equal sets may stand in several batches beside different neighbours. Take any batch of a node: its count has the
    elements that another node has there; each other element leaves it as a row of its own and is counted below if
    another node has it elsewhere, since that one's row, or the row of a batch that has counted it, has the same key. So
    the highest count of a node's batches and the counted rows are together never too few. An element may be counted in
    both, so they are at most twice the right number.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, count, other in runs(batches):
            use = (other & (count == 0)) | (count > 0)
            yield pa.RecordBatch.from_arrays([pa.array(node[use]), pa.array(count[use]), pa.array((count[use] == 0).astype(np.int64))], ["node", "most", "n"])

    dealt = rows.repartition(n_shuffle(rows.sparkSession), "e").sortWithinPartitions("e", "node", "c")
    small_batches(rows.sparkSession, 50_000)  # rows of three numbers
    return dealt.mapInArrow(shared, "node long, most long, n long").groupBy("node").agg((F.max("most") + F.sum("n")).alias("shared"))


def survivors(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of which all but a fourth may be in another set, by the sampled part: node, n, doc."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            own: dict[int, np.ndarray] = {}
            for e in all_elements(batch.column(0)):
                part = sampled(e)
                if len(part) and (node := node_of(e)) not in seen:  # copies come once from each task
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    own[node] = part
            yield from once_each(own)

    counts = shared_counts(only(docs, "text").mapInArrow(rows, "e long, node long, c long"))
    joined = nodes.join(counts, "node", "left").where(F.coalesce("shared", F.lit(0)) >= F.col("m") - F.expr("n div 4"))
    found = materialize(joined.select("node", "n", "doc"), "survivors")
    small_batches(docs.sparkSession)
    return found


def bands(most: int) -> np.ndarray:
    """Upper ends of the bands of set sizes, up to one that holds ``most``."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, 4 * ends[-1] // 3))
    return np.array([*ends, max(ends[-1] + 1, 4 * ends[-1] // 3)])


def sign(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The PartEnum signatures of a set, and for each whether it is for the next band only."""
    n, ends = len(e), bands(len(e))
    own = int(np.searchsorted(ends, n))
    out, ahead, short = [], [], False
    for band in (own, own + 1):
        r = int(ends[band])
        parts = max(1, round(r / (3 * CELL)))
        salt = mix(np.array([band + 1], np.uint64))[0]
        cell = (mix(e ^ salt) % U64(3 * parts)).astype(np.int64)
        count = np.bincount(cell, minlength=3 * parts).reshape(parts, 3)
        total = np.zeros(3 * parts, np.uint64)
        np.add.at(total, cell, mix(e + salt))
        total = total.reshape(parts, 3)
        number = np.arange(parts, dtype=np.uint64)
        for left_out in range(3):
            a, b = [c for c in range(3) if c != left_out]
            full = count[:, a] + count[:, b] > 0
            where = mix(salt + U64(4) * number + U64(left_out))
            out.append(mix(mix(total[:, a] + U64(1)) + U64(3) * mix(total[:, b] + U64(2)) + where)[full])
            ahead.append(np.full(len(out[-1]), band != own))
        most = (n + min(r, 4 * n // 3)) // 7
        short |= int(((count > 0).sum(axis=1) >= 2).sum()) <= most // 2
    if short:
        out.append(mix(np.sort(e)[: n // 4 + 1] + U64(0xD1B54A32D192ED03)))
        ahead.append(np.zeros(len(out[-1]), bool))
    return np.concatenate(out), np.concatenate(ahead)


def full_sets(docs: DataFrame, alive: DataFrame) -> DataFrame:
    """node, elements of the surviving nodes, each from the document of its lowest id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(all_elements(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(e) for e in found], pa.int64()), pa.array([e.tobytes() for e in found], pa.binary())], ["node", "elements"])

    ids = alive.where("n > 0").select(F.col("doc").alias("doc_id"))
    texts = only(docs, "doc_id", "text")
    texts = texts.join(ids, "doc_id", "left_semi").select("text").unionByName(texts.where("doc_id is null").select("text"))
    found = texts.mapInArrow(rows, "node long, elements binary").join(alive.select("node"), "node", "left_semi")
    with settings(docs.sparkSession, BLOOM):  # most texts are not of a surviving node, and need not be shuffled
        return materialize(found.dropDuplicates(["node"]), "elements")


def sharing_most(whole: DataFrame, sizes: DataFrame) -> DataFrame:
    """node, n, lacks (64ths of the set), elements of the nodes of which all but a fourth are in another one. sizes: node, n."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch], 200):
                sets_ = [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
                yield from once_each(dict(zip(part.column(0).to_pylist(), sets_, strict=True)))

    counts = shared_counts(whole.select("node", "elements").mapInArrow(rows, "e long, node long, c long"))
    joined = sizes.join(counts, "node").where("shared >= n - n div 4")
    kept = materialize(joined.select("node", "n", F.expr("64 * greatest(n - shared, 0) div n").alias("lacks")), "sharing")
    small_batches(whole.sparkSession)
    return materialize(whole.join(kept, "node").select("node", "n", "lacks", "elements"), "sets-left")


def families(whole: DataFrame) -> DataFrame:
    """first, node: the families of each node that shares a signature; a first member is in its own."""
    spark, most = whole.sparkSession, HELD

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lacks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = [sign(np.frombuffer(x, np.uint64)) for x in batch.column(2).to_pylist()]
            for at in range(0, len(found), 200):
                part = found[at : at + 200]
                sizes = [len(s) for s, _ in part]
                rank = np.repeat(lacks[at : at + 200], sizes) + 1000 * np.concatenate([a for _, a in part])  # own bands come first
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s for s, _ in part]).view(np.int64)), pa.array(rank), pa.array(np.repeat(nodes[at : at + 200], sizes))], ["sig", "rank", "node"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, above = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the run that may go on
        parts, size = [], 0

        def out() -> pa.RecordBatch:
            pairs = np.concatenate([*parts, np.zeros((0, 2), np.int64)])
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])] if len(pairs) else pairs
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["first", "node"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now, rank, node = (np.concatenate([h, c.to_numpy()]) for h, c in zip((key, above, first), batch.columns, strict=True))
            begins = np.concatenate([[True], now[1:] != now[:-1]])
            at = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            lead, lowest = node[at], rank[at]
            key, first, above = now[-1:], lead[-1:], lowest[-1:]
            use = (node != lead) & (lowest < 1000)  # else the band is none's own
            parts.append(np.stack([lead[use], node[use]], axis=1))
            size += len(parts[-1])
            if size > most:
                yield out()
                parts, size = [], 0
        yield out()

    signed = whole.select("node", "lacks", "elements").mapInArrow(rows, "sig long, rank long, node long").repartition(n_shuffle(spark), "sig").sortWithinPartitions("sig", "rank", F.xxhash64("node"), "node")
    small_batches(spark, 50_000)
    found = materialize(signed.mapInArrow(gather, "first long, node long").distinct(), "families")
    small_batches(spark)
    return found.unionByName(found.select("first", F.col("first").alias("node")).distinct())


def parities(sets_: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set: parities of the numbers of its elements in cells, 16 for each element of the largest set.

    Two rows differ in at most as many bits as the sets in elements.
    """
    cells = max(64, 1 << (16 * max(map(len, sets_)) - 1).bit_length())
    out, step = [], max(1, (1 << 22) // cells)
    for at in range(0, len(sets_), step):
        part = sets_[at : at + step]
        place = np.repeat(np.arange(len(part)) * cells, [len(e) for e in part])
        place += (mix(np.concatenate(part) ^ U64(0x8EBC6AF09C88C6E3)) & U64(cells - 1)).astype(np.int64)
        bits = np.bincount(place, minlength=len(part) * cells).astype(np.uint8) & 1
        out.append(np.packbits(bits).view(np.uint64).reshape(len(part), -1))
    return np.concatenate(out)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.sort(np.concatenate([x, y]))
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= 75 * (len(both) - inter)


def forest(side: np.ndarray, sets_: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the components of some sets; pairs within side 1 and pairs within side 2 are left out.

    Side 0, the first member, is compared with all, and so are sets of side 3 with each other.
    """
    k, n = len(sets_), np.array([len(e) for e in sets_])
    label, found, bits = np.arange(k), [], parities(sets_) if k > 3 else None
    for i in range(k - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        j = j[((side[i] != side[j]) | (side[i] == 3)) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))]
        if bits is not None and len(j):
            step = max(1, (1 << 21) // bits.shape[1])
            far = [np.bitwise_count(bits[j[at : at + step]] ^ bits[i]).sum(axis=1, dtype=np.int64) for at in range(0, len(j), step)]
            j = j[np.concatenate(far) <= (n[i] + n[j]) // 7]
        for at in j.tolist():
            if label[at] != label[i] and similar(sets_[i], sets_[at]):
                found.append((i, at))
                label[label == label[at]] = label[i]
    return found


def links(family: DataFrame, whole: DataFrame) -> DataFrame:
    """a, b: links that connect the same nodes as all links do."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        unit = None

        def out() -> pa.RecordBatch:
            found = forest(np.array([x[0] for x in held]), [np.frombuffer(x[2], np.uint64) for x in held]) if len(held) > 1 else []
            names = [(held[i][1], held[j][1]) for i, j in found]
            return pa.RecordBatch.from_arrays([pa.array([min(x) for x in names], pa.int64()), pa.array([max(x) for x in names], pa.int64())], ["a", "b"])

        for batch in batches:
            for now, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != unit:
                    yield out()
                    unit, held = now, []
                held.append(row)
        yield out()

    spark = family.sparkSession
    family = family.join(whole.select("node", "n"), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).cast("long")
    dealt = family.join(family.groupBy("first").agg(blocks.alias("blocks")), "first")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    lead = F.col("node") == F.col("first")
    every = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.transform(F.sequence(x, F.col("blocks") - 1), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    mine = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, own).alias("x"), F.greatest(x, own).alias("y")))
    dealt = dealt.select("first", "node", lead.alias("lead"), own.alias("own"), "blocks", F.explode(F.when(lead, every).otherwise(mine)).alias("u"))
    unit = F.when(F.col("blocks") == 1, F.col("first")).otherwise(F.xxhash64("first", "u.x", "u.y"))
    side = F.when(F.col("lead"), 0).when(F.col("u.x") == F.col("u.y"), 3).when(F.col("own") == F.col("u.x"), 1).otherwise(2)
    units = dealt.select(unit.alias("unit"), side.cast("long").alias("side"), "node").join(whole.select("node", "elements"), "node")
    units = units.select("unit", "side", "node", "elements").repartition(n_shuffle(spark), "unit").sortWithinPartitions("unit", "side", "node")
    return materialize(units.mapInArrow(rows, "a long, b long").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, label: one label for each component of the links (the smallest node)."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        low = materialize(labels.join(seen, F.col("node") == F.col("a")).select("node", F.least("label", "l").alias("label"), (F.col("l") < F.col("label")).alias("moved")), "lower")
        if low.where("moved").isEmpty():
            return labels
        jump = low.select(F.col("node").alias("at"), F.col("label").alias("next"))
        labels = materialize(low.join(jump, F.col("label") == F.col("at")).select("node", F.least("label", "next").alias("label")), "labels")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, component_id, node (texts with equal sets have the same); one row per document."""
    small_batches(docs.sparkSession)
    found = sets(docs)
    nodes = found.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.min("doc_id").alias("doc"))
    nodes = materialize(nodes, "nodes")
    alive = survivors(docs, nodes)
    whole = sharing_most(full_sets(docs, alive), alive.select("node", "n"))
    labels = components(links(families(whole), whole))
    named = labels.join(nodes.select("node", "doc"), "node")
    lowest = named.groupBy("label").agg(F.min("doc").alias("component"))
    to = named.join(lowest, "label").select("node", "component")
    own = nodes.join(to, "node", "left").select(F.col("node").alias("k"), F.coalesce("component", "doc").alias("component"))
    own = materialize(own, "classes")
    out = found.join(own, (F.col("node") == F.col("k")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "node")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of the lowest id of each component, and all documents without a shingle; all columns kept.

    Of rows that are equal in id and text one stays; a row whose id stays with another text goes by its own component.
    """
    d, t, keep, n = unused(docs, "_d", "_t", "_keep", "_n")
    stays = (F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))
    each = join(docs).groupBy(F.col("doc_id").alias(d), F.col("th").alias(t)).agg(F.first(stays).alias(keep), F.count(F.lit(1)).alias(n))
    odd = materialize(each.where(~F.col(keep) | (F.col(n) > 1)), "odd")  # the rows that go, and those that stand more than once
    at = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t))
    once = docs.join(odd, at, "left_anti")
    again = odd.where(keep)
    return once if again.isEmpty() else once.unionByName(docs.join(again, at, "left_semi").dropDuplicates(["doc_id", "text"]))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node", "th")


#: DuckDB SQL for the rows of op3_jaccard_join, by brute force.
OP3_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
p as (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) i from w where len(ws) > 0),
s as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') g from p),
n as (select doc_id, count(*) n from s group by 1),
x as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, l.b from r join l on l.a = r.reach)
select doc_id, coalesce(max(n.n), 0)::bigint n_shingles, min(reach) component_id from r left join n using (doc_id) group by doc_id
"""
