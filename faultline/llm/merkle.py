"""Merkle manifest of a table, with a proof of each row by pointer jumping.

Rows are leaves. In each tree (one for each group) leaves have places; runs of eight consecutive nodes are hashed to the
node above until one is left, the subroot. Subroots in the order of their groups form a tree of their own, whose top is
the root of the dataset.

1. ``runs``: the nodes of a level meet by (tree, place div 8), eight at most, so no key is hot. The first run of a tree
   with one node in it is that tree's top.
2. ``prove``: each node below the root holds its ancestor and the segment towards it, at first its parent and the run it
   stands in. A self-join gives a node its ancestor's ancestor and appends that one's segment, which doubles the distance
   in each round, so as many rounds are needed as the logarithm of the height. Nodes at the root wait. The ancestors of a
   round stand high above the rows; where they are few, which is counted, they are broadcast, and otherwise each has a
   few thousandths of the rows at most.
3. A segment is a list of (at, run): the digests of the run and the node's place in it. The others are the siblings.

A digest is sha256 over the concatenation of its inputs, digests as lowercase hex. Digests are kept as 32 bytes.

Defined results: a field that is null is hashed as ``-``; rows of one id stand in the order of their leaves; equal rows
have leaves and proofs of their own; a null id comes first and is never tampered with; a lone row is leaf, subroot and
root and its proof is the hash of nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import crc32_sql, documents, few, materialize, only, placed

ARITY = 8
#: Ancestors of a round that are broadcast at most; a row has up to 300 bytes for each level that it spans.
FEW = 4096
UPPER = "^"


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hex_of(x: Column) -> Column:
    return F.lower(F.hex(x))


def field(x: Column) -> Column:
    text = x.cast("string")
    return F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    return digest(*[field(x) for x in fields])


def runs(nodes: DataFrame) -> DataFrame:
    """tree, run (index), members (key, digest, h, rest; by place), all (their digests, concatenated). nodes: tree, place, key, digest, h, rest."""
    found = nodes.groupBy("tree", F.floor(F.col("place") / ARITY).alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", "key", "digest", "h", "rest"))).alias("members"))
    every = F.aggregate("members", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["digest"]))
    return materialize(found.withColumn("all", every), "runs")


def grown(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Builds trees from their lowest nodes. Gives the tops (as nodes) and a row for each node below a top.

    Rows: key, up (the parent's key), h (levels below), digest, seg (the run and the place in it), rest.
    """
    tops, below, level = None, None, 0
    while True:
        level += 1
        found = runs(nodes)
        lone = (F.col("run") == 0) & (F.size("members") == 1)
        done = found.where(lone).select("tree", F.inline("members"))
        tops = done if tops is None else tops.unionByName(done)
        found = found.where(~lone)
        if found.isEmpty():
            return tops, below
        up = F.concat_ws(":", F.lit(level), F.col("run"), F.col("tree"))
        hexes = F.aggregate("members", F.lit(""), lambda s, x: F.concat(s, hex_of(x["digest"])))
        children = found.select(up.alias("up"), "all", F.posexplode("members").alias("at", "m"))
        children = children.select("m.key", "up", "m.h", "m.digest", F.array(F.struct("at", F.col("all").alias("run"))).alias("seg"), "m.rest")
        below = children if below is None else below.unionByName(children)
        nodes = found.select("tree", F.col("run").alias("place"), up.alias("key"), digest(hexes).alias("digest"), (F.array_max("members.h") + 1).alias("h"), F.lit(None).cast(nodes.schema["rest"].dataType).alias("rest"))


def prove(leaves: DataFrame) -> DataFrame:
    """The columns of rest, leaf, seg (segment to the root), subroot, root; one row for each leaf.

    leaves: tree (text, unique to a group), group, place (from 0 in its tree), leaf (32 bytes), and whatever else is to be kept.
    """
    rest = [c for c in leaves.columns if c not in ("tree", "place", "leaf")]
    key = F.concat_ws(":", F.lit(0), F.col("place"), F.col("tree"))
    lowest = leaves.select("tree", "place", key.alias("key"), F.col("leaf").alias("digest"), F.lit(0).alias("h"), F.struct(*rest).alias("rest"))
    tops, below = grown(lowest)
    groups = leaves.where("place = 0").select(F.col("tree").alias("of"), F.col("group").alias("by"))
    tops = tops.join(groups, tops.tree == groups.of).select("by", "key", "digest", "h", "rest")
    tops = materialize(placed(tops, [], ["by"], "place").select(F.lit(UPPER).alias("tree"), "place", "key", "digest", "h", "rest"), "subroots")
    top, above = grown(tops)
    top = materialize(top, "root")
    if top.isEmpty():
        root, root_digest = "", b""
    else:
        root, root_digest = top.select("key", "digest").first()  # one row
    lone = top.select("key", F.col("key").alias("up"), "h", "digest", F.expr("array()").cast("array<struct<at:int,run:binary>>").alias("seg"), "rest", F.col("digest").alias("subroot"))
    state = lone
    if below is not None:
        is_top = F.lit(root_digest) if above is None else F.lit(None).cast("binary")  # a lone tree has the root for its subroot
        state = state.unionByName(below.withColumn("subroot", is_top))
    if above is not None:  # the subroots are the lowest nodes of the upper tree
        lowest_key = tops.select(F.col("key").alias("k"), F.lit(True).alias("sub"))
        marked = above.join(lowest_key, above.key == F.col("k"), "left")
        state = state.unionByName(marked.withColumn("subroot", F.when(F.col("sub"), F.col("digest"))).drop("k", "sub"))
    moving = materialize(state, "segments")
    finished, far = [], 1
    while True:
        finished.append(moving.where(F.col("up") == root))
        moving = moving.where(F.col("up") != root)
        if moving.isEmpty():
            break
        inner = moving.where("h > 0")
        for x in finished:
            inner = inner.unionByName(x.where("h > 0"))
        high = inner.where(F.col("h") >= far).select(F.col("key").alias("k"), F.col("up").alias("next"), F.col("seg").alias("more"), F.col("subroot").alias("its"))
        joined = moving.join(few(high, FEW), F.col("up") == F.col("k"))
        jumped = joined.select("key", F.col("next").alias("up"), "h", "digest", F.concat("seg", "more").alias("seg"), "rest", F.coalesce("subroot", "its").alias("subroot"))
        moving, far = materialize(jumped, "segments"), 2 * far
    out = finished[0]
    for x in finished[1:]:
        out = out.unionByName(x)
    return out.where("rest is not null").select("rest.*", F.col("digest").alias("leaf"), "seg", "subroot", F.lit(root_digest).alias("root"))


def siblings(s: Column) -> tuple[Column, Column]:
    """Hex of the digests before and after a node in its run."""
    before = F.substring(s["run"], F.lit(1), 32 * s["at"])
    return hex_of(before), hex_of(F.substring(s["run"], 32 * s["at"] + 33, F.lit(32 * ARITY)))


def proof_digest(seg: Column) -> Column:
    return F.sha2(F.aggregate(seg, F.lit(""), lambda h, s: F.concat(h, *siblings(s))).cast("binary"), 256)


def folded(leaf: Column, seg: Column) -> Column:
    """The root that follows from a leaf and its siblings, as hex."""
    step = lambda h, s: F.sha2(F.concat(siblings(s)[0], h, siblings(s)[1]).cast("binary"), 256)
    return F.aggregate(seg, hex_of(leaf), step)


def crc_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaves_of(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """tree, group, place, leaf, doc_id, claim; trees are languages.

    changed: the text as somebody else has it; claim is that row's leaf where it is another text, else null.
    """
    docs = only(docs, *FIELDS)
    other = [F.col(c) for c in FIELDS[:-1]]
    claim = F.lit(None).cast("binary") if changed is None else F.when(changed != F.col("text"), leaf_of(*other, changed))
    hashed = docs.select("doc_id", F.col("lang").alias("group"), leaf_of(*other, F.col("text")).alias("leaf"), claim.alias("claim"))
    tree = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit("-"))
    return placed(materialize(hashed, "leaves").withColumn("tree", tree), ["tree"], ["doc_id", "leaf"], "place")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(crc_of(F.col("doc_id")) % 3 == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    proofs = prove(materialize(leaves_of(documents(spark, sf_dir), tampered), "placed-leaves"))
    fold, root = folded(F.coalesce("claim", "leaf"), F.col("seg")), hex_of(F.col("root"))
    return proofs.select(
        "doc_id", hex_of(F.col("leaf")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), root.alias("root"), proof_digest(F.col("seg")).alias("proof_sha256"),
        fold.alias("folded_root"), (fold == root).alias("verified"),
    )


def _tree_sql(nodes: str, name: str, levels: int) -> str:
    """CTEs over ``nodes`` (tree, pos, d): {name}k, the nodes of level k below a top, with their siblings, and {name}_top."""
    out, below = [], nodes
    for k in range(levels):
        run = "over (partition by tree, pos // 8 order by pos rows between"
        out.append(f"{name}{k} as (select *, coalesce(string_agg(d, '') {run} unbounded preceding and 1 preceding), '') l, coalesce(string_agg(d, '') {run} 1 following and unbounded following), '') r from (select *, count(*) over (partition by tree) n from {below}) where n > 1)")
        out.append(f"{name}_{k + 1} as (select tree, pos // 8 pos, sha256(string_agg(d, '' order by pos)) d from {name}{k} group by tree, pos // 8)")
        below = f"{name}_{k + 1}"
    tops = " union all ".join(f"select tree, d from (select *, count(*) over (partition by tree) n from {x}) where n = 1" for x in [nodes, *[f"{name}_{k + 1}" for k in range(levels)]])
    return ", ".join([*out, f"{name}_top as ({tops})"])


def _fold_sql(rows: str, name: str, out: str, levels: int) -> str:
    """CTEs: rows (tree, pos, f, g, p and more) with f and g folded and p grown by the siblings of each level."""
    parts, below = [], rows
    for k in range(levels):
        parts.append(f"{out}_{k} as (select x.* replace (case when y.tree is null then f else sha256(y.l || f || y.r) end as f, case when y.tree is null then g else sha256(y.l || g || y.r) end as g, p || coalesce(y.l || y.r, '') as p) from {below} x left join {name}{k} y on x.tree = y.tree and x.pos // {8**k} = y.pos)")
        below = f"{out}_{k}"
    return ", ".join(parts)


_H = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"
_ROW = lambda text: f"sha256({' || '.join(_H(c) for c in FIELDS[:-1])} || {_H(text)})"
_LEVELS = 9

#: DuckDB SQL for the rows of op11_merkle_manifest, for up to 8^9 documents of a language.
OP11_SQL = f"""
with c as (select *, {crc32_sql("doc_id::varchar")} % 3 = 0 tampered, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from documents),
h as (select doc_id, lang, coalesce('=' || lang, '-') tree, {_ROW("text")} d, case when tampered and low <> text then {_ROW("low")} end other from c),
a as (select *, row_number() over (partition by tree order by doc_id nulls first, d) - 1 pos from h),
{_tree_sql("a", "t", _LEVELS)},
s as (select '^' tree, row_number() over (order by lang nulls first) - 1 pos, d, of from (select distinct lang, tree of from a) join t_top on tree = of),
{_tree_sql("s", "u", _LEVELS)},
x as (select tree, pos, doc_id, d leaf, d f, coalesce(other, d) g, '' p from a),
{_fold_sql("x", "t", "xf", _LEVELS)},
y as (select s.tree, s.pos, doc_id, leaf, f, g, p, s.d subroot from xf_{_LEVELS - 1} x join s on s.of = x.tree),
{_fold_sql("y", "u", "yf", _LEVELS)}
select doc_id, leaf, subroot, u_top.d root, sha256(p) proof_sha256, g folded_root, g = u_top.d verified from yf_{_LEVELS - 1}, u_top
"""
