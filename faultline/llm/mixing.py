"""Mixing sources to target weights over a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Sizes are counted in words. ``targets`` shares ``rate`` times all words by weight, with every source held to ``limit``
times its own size (water filling: the level is the largest of (total - caps below) / (weights above) over the sources
in order of cap / weight). A source is dealt in blocks: ``BLOCKS`` hash classes of its rows. It enters the mix as whole
passes over all blocks and, for the rest of its target, as blocks in permuted order; the block in which the rest ends
is taken row by row in permuted order, and the last row in part.

The tree shares the blocks among the output shards: a node holds each source's number of blocks, draws the left child's
numbers from the multivariate hypergeometric distribution (source after source, by inversion), and leaves the others to
the right child. Every shard gets exact quotas that sum up to the sources' blocks, distributed as if all blocks had
been shuffled and dealt. Within a source, shards take disjoint runs of the permuted blocks; within a shard, rows are
ordered by ``order_key``.

All random choices are hashes of a seed and keys, so reruns agree. Only (source, block) sums are ever put in order, at
most BLOCKS rows for each source; no task gets all rows of a source.

Defined results: a null text has size 0 and is never taken; a source without words has target 0; a null source is a
source of its own, last in order; null ids are allowed; repeated rows are rows of their own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import materialize, n_shuffle, only, unused
from faultline.operators.sampling import numbered_in

WEIGHTS = (5.0, 2.0, 1.0)
RATE, LIMIT = 1.5, 2.0
BLOCKS = 1024
SHARDS = 16


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) by the keys' hash."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, rate: float = RATE, limit: float = LIMIT) -> DataFrame:
    """source, source_size -> also weight and target. One row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(weights)
    t = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(limit)).withColumn("ratio", F.col("cap") / F.col("weight"))
    below = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(rate)
    left = total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    t = t.withColumn("level", level)
    return t.withColumn("target", F.least("cap", F.greatest(F.lit(0.0), F.max("level").over(everything)) * F.col("weight"))).drop("cap", "ratio", "level")


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Marked ones among the draws, by inversion at u: two passes over the possible counts."""
    low = F.greatest(F.lit(0).cast("long"), draws - (population - marked))
    high = F.least(marked, draws)
    counts = F.sequence(low, high)

    def log_weight(last: Column, k: Column) -> Column:
        more = F.log(((marked - k + 1) * (draws - k + 1)).cast("double") / (k * (population - marked - draws + k)).cast("double"))
        return F.when(k > low, last + more).otherwise(F.lit(0.0))

    def add(a: Column, k: Column) -> Column:
        w = log_weight(a["w"], k)
        top = F.greatest(a["top"], w)
        return F.struct(w.alias("w"), top.alias("top"), (a["sum"] * F.exp(a["top"] - top) + F.exp(w - top)).alias("sum"))

    whole = F.aggregate(counts, F.struct(F.lit(0.0).alias("w"), F.lit(-1e300).alias("top"), F.lit(0.0).alias("sum")), add, lambda a: a["top"] + F.log(a["sum"]))

    def pick(a: Column, k: Column) -> Column:
        w = log_weight(a["w"], k)
        sum_ = a["sum"] + F.exp(w - a["whole"])
        return F.struct(w.alias("w"), a["whole"].alias("whole"), sum_.alias("sum"), (a["n"] + F.when(sum_ < u, 1).otherwise(0)).cast("long").alias("n"))

    n = F.aggregate(counts, F.struct(F.lit(0.0).alias("w"), whole.alias("whole"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")), pick, lambda a: a["n"])
    return F.least(high, low + n)


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """source, quota (blocks) -> source, ends: for each shard the end of its run of the source's permuted blocks.

    shards is a power of two. The tree has one row for each node of a level, with the quotas of all sources in order.
    """
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "quota"))).alias("s"))
    nodes = nodes.select(F.lit(0).cast("long").alias("node"), F.col("s.source").alias("sources"), F.col("s.quota").alias("q"))

    def sum_of(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def left(width: int, total: Column, draws: Column, a: Column, i: Column) -> Column:
        """Appends to the left child's numbers that of source i, given those before; seen: blocks of the sources before it."""
        own = F.get(F.col("q"), i)
        u = uniform(F.lit(seed), F.lit(width), F.col("node"), i)
        n = hypergeometric(total - a["seen"], own, draws - a["drawn"], u)
        # an array of one number is made first, so that the draw is evaluated once
        return F.transform(F.array(n), lambda k: F.struct(F.array_append(a["out"], k).alias("out"), (a["seen"] + own).alias("seen"), (a["drawn"] + k).alias("drawn")))[0]

    zero = F.lit(0).cast("long")
    width = shards
    while width > 1:
        nodes = nodes.withColumn("total", sum_of(F.col("q"))).withColumn("draws", ((F.col("total") + (F.col("node") % 2)) / 2).cast("long"))
        places = F.when(F.size("q") > 0, F.sequence(F.lit(0), F.size("q") - 1)).otherwise(F.array().cast("array<int>"))
        begin = F.struct(F.array().cast("array<long>").alias("out"), zero.alias("seen"), zero.alias("drawn"))
        nodes = nodes.withColumn("l", F.aggregate(places, begin, lambda a, i: left(width, F.col("total"), F.col("draws"), a, i), lambda a: a["out"]))  # noqa: B023
        right = F.zip_with("q", "l", lambda a, b: a - b)
        nodes = nodes.select("sources", F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))).alias("c")).select("c.node", "sources", "c.q")
        width //= 2
    leaves = nodes.select("node", F.explode(F.arrays_zip("sources", "q")).alias("z")).select("node", F.col("z.sources").alias("source"), F.col("z.q").alias("quota"))
    each = leaves.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "quota"))), lambda x: x["quota"]).alias("each"))
    ends = F.transform("each", lambda _, i: sum_of(F.slice(F.col("each"), F.lit(1), i + 1)))
    return each.select("source", ends.alias("ends"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, rate: float = RATE, limit: float = LIMIT, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, th (hash of the text), size, source_size, target, taken, shards (of each copy), order_key."""
    slim = docs.select("doc_id", "source", F.xxhash64("text").alias("th"), n_words().alias("size"))
    slim = slim.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "th")).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    slim = materialize(slim, "mix")

    block = slim.groupBy("source", "block").agg(F.sum("size").alias("words"))
    goal = targets(block.groupBy("source").agg(F.sum("words").alias("source_size")), weights, rate, limit)
    # Both the block sums and the goals are small tables: at most BLOCKS rows for each source.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    goal = goal.withColumnRenamed("source", "s")
    block = block.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    block = block.withColumn("before", F.sum("words").over(order) - F.col("words"))
    block = block.withColumn("copies", F.col("passes") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0))

    cards = block.where("copies > 0").select("source", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("pass"))
    ends = splitting_tree(cards.groupBy("source").agg(F.count(F.lit(1)).alias("quota")), shards, seed).withColumnRenamed("source", "s")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block", "pass"), "block", "pass")).cast("long") - 1
    dealt = cards.withColumn("rank", rank).join(ends, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    dealt = dealt.groupBy(F.col("source").alias("ds"), F.col("block").alias("db")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("to"))
    block = block.join(dealt, F.col("source").eqNullSafe(F.col("ds")) & (F.col("block") == F.col("db")), "left").drop("ds", "db")
    plan = materialize(block.select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "passes", "rest", "before", "to"), "mixplan")

    rows = slim.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    within = Window.partitionBy("source", "block").orderBy("h", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.col("before") + F.sum("size").over(within) - F.col("size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - ahead))
    rows = rows.withColumn("taken", F.col("passes") * F.col("size") + part)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    return rows.select("doc_id", "source", "th", "size", "source_size", "target", "taken", F.slice(F.coalesce("to", F.array().cast("array<int>")), F.lit(1), copies).alias("shards"), F.xxhash64(F.lit(seed + 3), "h").alias("order_key"))


def with_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Each document's columns with the other columns of its row of the mix; rows equal in id, source and text take one each."""
    extra = [c for c in mixed.columns if c not in ("doc_id", "source", "th")]
    clash = [c for c in extra if c in docs.columns]
    if clash:
        raise ValueError(f"columns {clash} are in both tables")
    d, s, t, n = unused(docs, "_d", "_s", "_t", "_n")
    rows = mixed.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("th").alias(t), *extra)
    same = F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (F.xxhash64("text") == F.col(t))
    out = [*docs.columns, *extra]
    many = materialize(rows.groupBy(d, s, t).count().where("count > 1").drop("count"), "repeated")
    if many.isEmpty():
        return docs.join(rows, same).select(*out)
    key = lambda a, b: a[d].eqNullSafe(b[d]) & a[s].eqNullSafe(b[s]) & (a[t] == b[t])
    single = rows.join(many, key(rows, many), "left_anti")
    # Numbered by all columns of each side, so reruns agree; a key of any size is spread over tasks.
    content = lambda names: F.xxhash64(F.to_json(F.struct(*[F.col(f"`{x}`") for x in names])))
    some = numbered_in(docs.join(many, same), [d, s, t], [content(docs.columns)], n)
    numbered = numbered_in(rows.join(many, key(rows, many), "left_semi"), [d, s, t], [content(extra)], n)
    both = some.join(numbered.select(F.col(d).alias(d + "2"), F.col(s).alias(s + "2"), F.col(t).alias(t + "2"), F.col(n).alias(n + "2"), *extra), F.col(d).eqNullSafe(F.col(d + "2")) & F.col(s).eqNullSafe(F.col(s + "2")) & (F.col(t) == F.col(t + "2")) & (F.col(n) == F.col(n + "2")))
    return docs.join(single, same).select(*out).unionByName(both.select(*out))


def write_shards(docs: DataFrame, mixed: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the drawn rows as one folder for each shard, shuffled locally; a row stands in a shard once for each of its copies there."""
    shard, key, copy = unused(docs, "shard", "_order", "_copy")
    drawn = with_rows(docs, mixed.select("doc_id", "source", "th", F.col("order_key").alias(key), F.col("shards").alias(copy)))
    rows = drawn.select(*docs.columns, key, F.posexplode(copy).alias(copy, shard)).withColumn(key, F.xxhash64(key, copy))
    slots = max(1, n_shuffle(docs.sparkSession) // shards)
    dealt = rows.repartition(slots * shards, shard, F.pmod(key, F.lit(slots))).sortWithinPartitions(shard, key)
    dealt.select(*docs.columns, shard).write.partitionBy(shard).parquet(path)


def copies_of(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken (a part taken counts from one half), with their columns."""
    (times,) = unused(docs, "_times")
    share = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    drawn = with_rows(docs, mixed.select("doc_id", "source", "th", share.alias(times))).where(F.col(times) > 0)
    return drawn.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "text")).drop("source", "th")
