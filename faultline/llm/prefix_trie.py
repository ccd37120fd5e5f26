"""Prefix trie of conversations by van Emde Boas recursion.

Sequences are cut at half of their (power of two) depth, the upper and the lower parts again at half of theirs, and so
on, all parts of a size in one round, so the rounds are as many as the logarithm of the depth.

1. ``blocks``: names of aligned runs of turns of one conversation, each from the names of its halves.
2. ``prefixes``: down the recursion, a part knows the name of the prefix that it hangs from. The upper half hangs from the
   same one; the lower half hangs from the prefix at the cut, named by that and the upper half's block. Equal prefixes
   have equal names, whatever conversation they are in, so the name says in which lower tree of the forest a part lies. At
   the end each place of a conversation has the name of the prefix that ends there.
3. ``nodes``: the names, with their members counted and the smallest kept; one aggregate.
4. ``totals``: up the recursion, the sums of the lower trees are grouped by the prefix that they hang from and added to the
   nodes above it in the upper part, which are found by the places of one member. Before a round a node has the sum over
   its own part, after the last one over its subtree.

A name is 128 bits of md5. No conversation, node or part is gathered in a row; a hot node's members are counted before the
shuffle. ``end_digests`` hashes the ids that end at a node, which is sequential by its nature: ids are joined to pieces by
ranges first, and a node's pieces are streamed through one task that holds a batch of them.

Defined results: turns go by turn (null first), equal ones by the md5 of role and text; a null role or text is empty; rows
of a null conv_id belong to no conversation; a conversation without turns is a member of the root alone; repeated rows are
turns of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import crc32_sql, materialize, n_shuffle, only, placed, small_batches

#: Ids of a piece that is hashed at once.
PIECE = 1000


def named(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, i (place from 0), sym (16 bytes that name role and text), size (code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sym = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = only(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    named_turns = turns.select("conv_id", "turn", sym.alias("sym"), F.char_length(text).cast("long").alias("size"))
    return materialize(placed(named_turns, ["conv_id"], ["turn", "sym"], "i").select("conv_id", "i", "sym", "size"), "turns")


def blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """conv_id, j, b: for each level k the names of the whole runs of turns j * 2^k to (j + 1) * 2^k - 1."""
    out = [turns.select("conv_id", F.col("i").alias("j"), F.col("sym").alias("b"))]
    for _ in range(levels - 1):
        half = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("b")))
        pairs = out[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j2")).agg(half(0).alias("upper"), half(1).alias("lower")).where("lower is not null")
        out.append(materialize(pairs.select("conv_id", F.col("j2").alias("j"), named(F.col("upper"), F.col("lower")).alias("b")), "blocks"))
    return out


def prefixes(turns: DataFrame, convs: DataFrame, levels: int) -> DataFrame:
    """conv_id, s, name: the name of the first s turns of each conversation, for s from 0 to its length."""
    halves = blocks(turns, levels)
    parts = convs.select("conv_id", F.lit(0).cast("long").alias("j"), named(F.lit(b"")).alias("name"))
    for k in reversed(range(levels)):
        cut = halves[k].where("j % 2 = 0").select("conv_id", F.shiftright("j", 1).alias("j"), "b")
        lower = parts.join(cut, ["conv_id", "j"]).select("conv_id", (2 * F.col("j") + 1).alias("j"), named(F.col("name"), F.col("b")).alias("name"))
        parts = materialize(parts.select("conv_id", (2 * F.col("j")).alias("j"), "name").unionByName(lower), "prefixes")
    return parts.select("conv_id", F.col("j").alias("s"), "name")


def nodes(places: DataFrame, turns: DataFrame) -> DataFrame:
    """name, rep (smallest member), depth, n_convs, parent (name), n_children, own (tokens that sharing the node saves)."""
    found = materialize(places.groupBy("name").agg(F.min("conv_id").alias("rep"), F.first("s").alias("depth"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    last = F.col("depth") - 1
    at = found.select("name", F.col("rep").alias("conv_id"), last.alias("i"))
    above = at.join(places.select("conv_id", F.col("s").alias("i"), F.col("name").alias("parent")), ["conv_id", "i"]).join(turns.select("conv_id", "i", "size"), ["conv_id", "i"])
    above = materialize(above.select("name", "parent", "size"), "parents")
    kids = above.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    joined = found.join(above, "name", "left").join(kids, "name", "left")
    own = (F.col("n_convs") - 1) * F.coalesce("size", F.lit(0))
    return materialize(joined.select("name", "rep", "depth", "n_convs", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"), own.alias("own")), "nodes")


def totals(found: DataFrame, places: DataFrame, levels: int) -> DataFrame:
    """name, n_leaves, saved: sums over subtrees."""
    sums = found.select("name", "parent", "rep", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("own").alias("saved"))
    for k in range(levels):
        size = 1 << k
        lower = sums.where((F.col("depth") % (2 * size)) == size)  # the roots of the lower trees
        hung = lower.groupBy("parent").agg(F.min("rep").alias("conv_id"), F.first(F.shiftright("depth", k) - 1).alias("part"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("t"))
        above = hung.select("conv_id", "part", "l", "t").join(places.withColumn("part", F.shiftright("s", k)), ["conv_id", "part"])
        more = above.groupBy("name").agg(F.sum("l").alias("l"), F.sum("t").alias("t"))
        grown = sums.join(more, "name", "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("t", F.lit(0))})
        sums = materialize(grown.drop("l", "t"), "totals")
    return sums.select("name", "n_leaves", "saved")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (name, id) -> name, first id, ids joined by commas, for runs of equal names within a batch."""
    for batch in batches:
        names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, at = [], 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and names[end] == names[at] and end - at < PIECE:
                end += 1
            out.append((names[at], ids[at], ",".join(map(str, ids[at:end]))))
            at = end
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[], [], []], (pa.binary(), pa.int64(), pa.string()), strict=True)], ["name", "first", "ids"])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> name, sha256 of all of its ids."""
    name, state = None, None

    def out(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.string())], ["name", "ends_sha256"])

    for batch in batches:
        rows = []
        for now, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state is not None and now == name:
                state.update(b"," + ids.encode())
            else:
                if state is not None:
                    rows.append((name, state.hexdigest()))
                name, state = now, hashlib.sha256(ids.encode())
        yield out(rows)
    yield out([(name, state.hexdigest())] if state is not None else [])


def end_digests(places: DataFrame) -> DataFrame:
    """name, ends_sha256: of the nodes at which conversations end, the hash of their ids in ascending order."""
    n = n_shuffle(places.sparkSession)
    ends = places.groupBy("conv_id").agg(F.max_by("name", "s").alias("name")).select("name", "conv_id")
    joined = ends.repartitionByRange(n, "name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(pieces, "name binary, first long, ids string")
    return joined.repartition(n, "name").sortWithinPartitions("name", "first").mapInArrow(hashed, "name binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, i (from 0, without gaps), sym (bytes that name a turn), size. convs: conv_id of all conversations, each once.
    """
    small_batches(turns.sparkSession, 5000)
    longest = turns.agg(F.coalesce(F.max("i") + 1, F.lit(0))).first()[0]
    levels = max(1, int(longest).bit_length())
    places = prefixes(turns, convs, levels)
    found = nodes(places, turns)
    above = found.select(F.col("name").alias("parent"), F.col("rep").alias("parent_conv_id"))
    out = found.join(totals(found, places, levels), "name").join(materialize(end_digests(places), "ends"), "name", "left").join(above, "parent", "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))
    return out.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), digest.alias("ends_sha256"))


def shared_heads(turns: DataFrame, head: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin with the first ``head`` turns of conversation ``base`` in place of their own, and all ids.

    head (``most`` at most) and base are expressions of conv_id.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    each = sizes.select("conv_id", base.alias("base"), head.cast("long").alias("head"))
    each = each.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    each = materialize(each.withColumn("taken", F.least("head", F.coalesce("n_base", F.lit(0)))), "heads")
    first = turns.where(F.col("i") < most).withColumnRenamed("conv_id", "base")
    copied = each.select("conv_id", "base", "head").join(first, "base").where("i < head").select("conv_id", "i", "sym", "size")
    own = turns.join(each.select("conv_id", "head", "taken"), "conv_id").where("i >= head").select("conv_id", (F.col("i") - F.col("head") + F.col("taken")).alias("i"), "sym", "size")
    return materialize(copied.unionByName(own), "rebuilt"), each.select("conv_id")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    return trie(*shared_heads(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), head, conv - conv % 100, 5))


#: DuckDB SQL for the rows of op13_prefix_trie.
OP13_SQL = f"""
with a as (select conv_id c, turn, coalesce(text, '') x, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) s from conversations where conv_id is not null),
t as (select c, s, length(x) n, row_number() over (partition by c order by turn nulls first, s) - 1 p from a),
b as (select c base, count(*) n_base from t group by c),
h as (select c, c - c % 100 base, {crc32_sql("c::varchar")} % 6 h from (select distinct c from t)),
u as (select h.c, t.p + 1 d, s, n from h join t on t.c = h.base and t.p < h.h
  union all select t.c, least(h, coalesce(n_base, 0)) + p - h + 1, s, n from t join h on t.c = h.c left join b on b.base = h.base where p >= h),
z as (select c, d, n, string_agg(s, '' order by d) over (partition by c order by d) k from u union all select c, 0, 0, '' from h),
v as (select k, d, min(c) rep, count(*) m, any_value(n) n, left(k, greatest(0, 32 * (d - 1))) up from z group by k, d),
y as (select up k, d - 1 d, count(*) n_children from v where d > 0 group by up, d),
w as (select v.*, coalesce(n_children, 0) n_children, (m - 1) * n own from v left join y on y.k = v.k and y.d = v.d),
g as (select z.k, z.d, sum((w.n_children = 0)::bigint) n_leaves, sum(w.own) saved from w join z on z.c = w.rep and z.d <= w.d group by z.k, z.d),
e as (select k, sha256(string_agg(c::varchar, ',' order by c)) ends from (select c, arg_max(k, d) k from z group by c) group by k)
select w.rep conv_id, w.d::bigint depth, q.rep parent_conv_id, w.m n_convs, w.n_children, n_leaves::bigint n_leaves, saved::bigint saved_tokens, coalesce(ends, sha256('')) ends_sha256
from w join g on g.k = w.k and g.d = w.d left join e on e.k = w.k left join v q on q.k = w.up and q.d = w.d - 1
"""
