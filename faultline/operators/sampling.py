"""Sampling, mixing, numbering and splits. All random choices are seeded hashes of keys.

Numbers over a whole table (``numbered``) are dealt without one task holding the table: each range of the order is
counted, and a range's numbers start where those before it end.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from faultline.functions.seeded import md5_bucket, u
from faultline.functions.text import failure_weight
from faultline.sources.shared import materialize

MODEL_LIMITATION = "model_limitation"
#: Ranges of a hash by which the rows of a group are counted.
RANGES = 1 << 14


def numbered(df: DataFrame, order: list[Column | str], name: str = "row_number") -> DataFrame:
    """Adds the place of each row (from 1) in an order of unique keys: range partitions, then numbers within each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = materialize(ranged, "numbered")  # ranges are drawn from a sample: both readings below need the same ones
    part, place = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.p: r.n for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each partition
    starts, before = [], 0
    for p in sorted(counts):
        starts += [F.lit(p), F.lit(before)]
        before += counts[p]
    begin = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return ranged.withColumn(name, (begin + place + 1).cast("long")).drop("_id")


def numbered_in(df: DataFrame, group: list[str], order: list[Column | str], name: str = "row_number") -> DataFrame:
    """Adds the place of each row (from 1) in its group, in an order; rows that are equal in it stand as they come.

    Rows are dealt by ranges of group and order, so a group of any size is spread over tasks. Only groups that go on from
    one range to the next have an offset: at most two rows for each range, and these are broadcast.
    """
    part, id_ = "_in_part", "_in_id"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    ranged = materialize(ranged.withColumn(id_, F.monotonically_increasing_id()), "numbered").withColumn(part, F.shiftrightunsigned(id_, 33))
    ends = ranged.groupBy(part).agg(F.min(id_).alias("low"), F.max(id_).alias("high")).select(F.explode(F.array("low", "high")).alias(id_))
    same = lambda x, y: reduce(and_, [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in [part, *group]])
    edges = ranged.join(F.broadcast(ends), id_, "left_semi").select(part, *group).distinct()
    sizes = ranged.alias("r").join(F.broadcast(edges).alias("e"), same("r", "e"), "left_semi").groupBy(part, *group).agg(F.count(F.lit(1)).alias("_in_n"))
    before = F.sum("_in_n").over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(part, *group, before.alias("_in_before")).where("_in_before > 0")
    own = ranged.withColumn("_in_place", F.row_number().over(Window.partitionBy(part, *group).orderBy(id_)))
    joined = own.alias("r").join(F.broadcast(offsets).alias("o"), same("r", "o"), "left")
    return joined.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col("r._in_place") + F.coalesce("o._in_before", F.lit(0))).cast("long").alias(name))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """N rows without replacement: the n of the smallest hash."""
    return df.orderBy(u(seed, key), key).limit(n)


def sample_new(df: DataFrame, processed: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """N rows whose key was not processed."""
    return sample_rows(df.join(processed.select(key).distinct(), key, "left_anti"), n, key, seed)


def hash_bucket(df: DataFrame, key: str, n: int) -> DataFrame:
    """A repeatable split by md5."""
    return df.withColumn("bucket", md5_bucket(F.col(key).cast("string"), n))


def with_failure_key(images: DataFrame, seed: int = 0) -> DataFrame:
    """Adds failure_key, one failure of each image, drawn by (priority + 2)^2. Images without a usable key go.

    images: image_id, failure_breakdown (map), failed_reasons (array, used where the map has no usable key), ...
    """
    usable = lambda k: (k != "null") & (k != MODEL_LIMITATION)
    keys = F.filter(F.map_keys("failure_breakdown"), usable)
    backup = F.array_distinct(F.filter("failed_reasons", lambda k: k.isNotNull() & usable(k)))
    rank = lambda k: F.struct((-F.log(u(seed, F.col("image_id"), k)) / failure_weight(k)).alias("rank"), k.alias("key"))
    best = F.array_min(F.transform(F.when(F.size(keys) > 0, keys).otherwise(backup), rank))
    return images.withColumn("failure_key", best["key"]).where("failure_key is not null")


def sample_failure_keys(images: DataFrame, seed: int = 0) -> DataFrame:
    """image_id, failure_key."""
    return with_failure_key(images, seed).select("image_id", "failure_key")


def parse_ratios(text: str) -> dict[str, float]:
    """``name:ratio,name:ratio``; ratios are not negative and don't sum up to zero."""
    out = {}
    for part in filter(None, (x.strip() for x in text.split(","))):
        name, _, value = part.rpartition(":")
        out[name.strip()] = float(value)
    if not out or min(out.values()) < 0 or sum(out.values()) == 0:
        raise ValueError(f"no usable ratios in {text!r}")
    return out


def quotas(counts: DataFrame, ratios: dict[str, float], total: int | None, group: str = "pipeline_name") -> DataFrame:
    """R2: group, available, quota. counts: group, available. A table of a few rows, one for each group.

    Ratios are normalized over all names given; groups that are absent are left out. A quota is int(total * ratio), at
    least 1 and at most what is there. If the sum misses the total, quotas are scaled once without that cap, and the
    largest group (the first in order of the ratios) takes the difference. A quota may then exceed the group's rows;
    sampling takes what is there, and ``quota - available`` tells the shortfall.
    """
    spark = counts.sparkSession
    whole = sum(ratios.values())
    table = spark.createDataFrame([(k, v / whole, i) for i, (k, v) in enumerate(ratios.items())], f"{group} string, share double, pos int")
    t = counts.join(F.broadcast(table), group)
    everything = Window.partitionBy()
    if total is None:
        return t.select(group, "available", F.col("available").alias("quota"))
    one = F.lit(1).cast("long")
    t = t.withColumn("first", F.least(F.greatest(one, F.floor(F.lit(total) * F.col("share"))), F.col("available")))
    t = t.withColumn("sum1", F.sum("first").over(everything))
    scaled = F.greatest(one, F.floor(F.col("first") * (F.lit(float(total)) / F.col("sum1"))))
    t = t.withColumn("second", F.when(F.col("sum1") == total, F.col("first")).otherwise(scaled))
    t = t.withColumn("rest", F.lit(total) - F.sum("second").over(everything))
    t = t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("second"), "pos")))
    quota = F.when(F.col("rank") == 1, F.col("second") + F.col("rest")).otherwise(F.col("second"))
    return t.select(group, "available", quota.cast("long").alias("quota"))


def mix_groups(df: DataFrame, ratios: dict[str, float], total: int | None, key: str, group: str = "pipeline_name", seed: int = 0) -> DataFrame:
    """R2: the quota of each group by seeded order.

    One reading counts each group's rows by ranges of the hash, which gives the quotas and the range in which each ends.
    A second one counts the rows of those ranges by key, which gives the key in which each ends. Rows before it are taken
    by a filter; rows of that one key are numbered, where some of them are due and some not. No group and no key is gathered
    in a task.
    """
    if total is None and ratios:  # every row of the groups that are named
        return df.where(F.col(group).isin(list(ratios)))
    spark, kind = df.sparkSession, df.schema
    place = u(seed, key)
    at = F.floor(place * RANGES)

    def ends(n: DataFrame, by: list[str]) -> list:
        """For each group the value of ``by`` in whose rows its quota ends (null if none), and what is left of it there. n: group, left, by, n."""
        over = n.withColumn("upto", F.sum("n").over(Window.partitionBy(group).orderBy(*by))).withColumn("over", F.col("upto") > F.col("left"))
        end = F.min(F.when(F.col("over"), F.struct(*by, (F.col("left") - F.col("upto") + F.col("n")).alias("rest"))))
        return over.groupBy(group).agg(end.alias("end")).collect()  # one row for each name in ratios

    counts = df.where(F.col(group).isin(list(ratios))).groupBy(group, at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    quota = quotas(counts.groupBy(group).agg(F.sum("n").alias("available")), ratios, total, group).select(group, F.col("quota").alias("left"))
    ranges = {r[group]: r.end for r in ends(counts.join(F.broadcast(quota), group), ["at"])}

    def table(rows: list[tuple], columns: list[StructField]) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, StructType([StructField(group, kind[group].dataType), *columns])))

    number = lambda name: StructField(name, LongType())
    cut = table([(g, e.at, e.rest) for g, e in ranges.items() if e], [number("_at"), number("left")])
    edge = df.join(cut, group).where(at == F.col("_at"))
    keys = {r[group]: r.end for r in ends(edge.groupBy(group, "left", place.alias("u"), F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")), ["u", "k"])}
    last = [(g, e.at, keys[g].u, keys[g].k, keys[g].rest) if e else (g, None, None, None, None) for g, e in ranges.items()]
    rows = df.join(table(last, [number("_at"), StructField("_u", DoubleType()), StructField("_k", kind[key].dataType), number("_rest")]), group)
    sooner = (at < F.col("_at")) | ((at == F.col("_at")) & (F.struct(place.alias("u"), F.col(key).alias("k")) < F.struct(F.col("_u").alias("u"), F.col("_k").alias("k"))))
    whole = rows.where(F.col("_at").isNull() | sooner).select(*df.columns)
    if not any(r[-1] for r in last):
        return whole
    tied = rows.where((F.col("_rest") > 0) & (place == F.col("_u")) & F.col(key).eqNullSafe(F.col("_k"))).select(*df.columns, "_rest")
    content = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))  # spreads the rows of the key
    return whole.unionByName(numbered_in(tied, [group], [content], "_place").where("_place <= _rest").select(*df.columns))


def question_type(df: DataFrame, key: str, multiple_choice: float = 0.7, fill_in_blank: float = 0.3, seed: int = 0) -> DataFrame:
    """R4."""
    share = multiple_choice / (multiple_choice + fill_in_blank)
    return df.withColumn("question_type", F.when(u(seed, key) < share, "multiple_choice").otherwise("fill_in_blank"))


def keep_optional_slots(df: DataFrame, key: str, slots: str = "optional_slots", p: float = 0.5, seed: int = 0) -> DataFrame:
    """R5."""
    return df.withColumn(slots, F.filter(slots, lambda s: u(seed, F.col(key), s) < p))


def wrong_option_count(df: DataFrame, key: str, least: int = 2, most: int = 4, seed: int = 0) -> DataFrame:
    """R6."""
    return df.withColumn("n_wrong", (F.floor(u(seed, key) * (most - least + 1)) + least).cast("int"))


def shuffle_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A seeded order of all rows."""
    return df.orderBy(u(seed, key), key)


def train_test(df: DataFrame, key: str, train: float = 0.8, seed: int = 0) -> DataFrame:
    """A key's side never changes as the table grows."""
    return df.withColumn("split", F.when(u(seed, key) < train, "train").otherwise("test"))


def synthetic_annotations(spark, n: int, factors: list[str], most: int = 5, seed: int = 0) -> DataFrame:
    """1 to most random factors for each of n samples."""
    ids = spark.range(n).withColumn("n", F.floor(u(seed, "id") * most) + 1)
    scored = F.transform(F.array(*[F.lit(f) for f in factors]), lambda f: F.struct(u(seed + 1, F.col("id"), f).alias("u"), f.alias("f")))
    chosen = F.slice(F.array_sort(scored), F.lit(1), F.col("n").cast("int"))
    return ids.select(F.concat(F.lit("img_"), F.col("id").cast("string")).alias("image_id"), F.transform(chosen, lambda x: x["f"]).alias("filter_factor_texts"))


def letter_options(df: DataFrame, key: str, options: str = "options", answer: str = "answer_text", seed: int = 0) -> DataFrame:
    """Options in seeded order under letters, and the letter of the answer."""
    order = F.transform(F.array_sort(F.transform(options, lambda o: F.struct(u(seed, F.col(key), o).alias("u"), o.alias("o")))), lambda x: x["o"])
    letters = F.transform(order, lambda o, i: F.struct(F.char(i + 65).alias("letter"), o.alias("text")))
    return df.withColumn("lettered", letters).withColumn("answer_letter", F.char(F.array_position(order, F.col(answer)) + 64))


def running_index(df: DataFrame, order: str, start: int = 0, keep: Column | None = None) -> DataFrame:
    """W1 (after keep) and W2 (position among all rows): sample_index."""
    if keep is not None:
        df = df.where(keep)
    return numbered(df, [order], "_n").withColumn("sample_index", F.col("_n") - 1 + start).drop("_n")


def uniform_indices(spark, n: int, k: int) -> DataFrame:
    """K indices spread over n rows, rounded half to even."""
    if k <= 1 or n <= 1:
        return spark.createDataFrame([(0,)] if n else [], "idx long")
    return spark.range(min(k, n)).select(F.bround(F.col("id") * (n - 1) / (min(k, n) - 1)).cast("long").alias("idx")).distinct()


def empty_runs(batches: DataFrame) -> DataFrame:
    """Batch, hits -> run, the number of empty batches in a row up to each batch. One row for each batch."""
    order = Window.orderBy("batch")
    t = batches.withColumn("_block", F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("_block").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("run", F.sum(F.when(F.col("hits") > 0, 0).otherwise(1)).over(within)).drop("_block")


def batch_number(df: DataFrame, order: str, size: int) -> DataFrame:
    """W7."""
    return numbered(df, [order], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size) + 1).drop("_n")


def round_robin(df: DataFrame, order: str, n: int) -> DataFrame:
    """W8."""
    return numbered(df, [order], "_n").withColumn("part", (F.col("_n") - 1) % n).drop("_n")


def quota_split(spark, total: int, groups: int) -> DataFrame:
    """The first total % groups groups take one more."""
    return spark.range(groups).select(F.col("id").alias("group"), (F.lit(total // groups) + F.when(F.col("id") < total % groups, 1).otherwise(0)).cast("long").alias("quota"))


def unique_names(df: DataFrame, key: str, order: str) -> DataFrame:
    """File names of an image's rows, with _1, _2 ... after the first. An image may have any number of rows."""
    n = F.col("_nth") - 1
    named = numbered_in(df, [key], [order], "_nth")
    return named.withColumn("name", F.concat(F.col(key), F.when(n == 0, "").otherwise(F.concat(F.lit("_"), n.cast("string"))))).drop("_nth")


def until_target(batches: DataFrame, target: int) -> DataFrame:
    """Whole batches until the running number of hits reaches the target. One row for each batch."""
    before = F.sum("hits").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("hits")
    return batches.withColumn("_before", before).where(F.col("_before") < target).drop("_before")


def contiguous_parts(df: DataFrame, order: str, n: int) -> DataFrame:
    """N parts of equal size, the last takes the remainder."""
    size = max(1, df.count() // n)
    return numbered(df, [order], "_n").withColumn("part", F.least(F.floor((F.col("_n") - 1) / size), F.lit(n - 1)).cast("long")).drop("_n")
