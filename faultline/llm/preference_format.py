"""Preference formatting in DataFrame operations only.

A pair is a chosen and a rejected conversation. Their longest common turn prefix is rendered once, as the prompt; what
follows on either side is its completion, with loss on assistant turns alone. Everything stays one row per turn: the two
sides are joined turn by turn, the first differing turn of a pair is a minimum, and each rendered turn carries its pair,
part and mask. So no conversation is ever gathered in one place, however long it is; ``assemble`` joins the rows of pairs
into strings for consumers whose conversations fit in a row.

Defined results: turns are placed by their number, gaps don't matter; of rows with one pair, side and number the
smallest (role, text) counts; rows without pair or number are left out; a null role is "user", a null text empty; roles
compare without case; if one side is a prefix of the other, its completion is empty; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>\n"
END = "<|end|>\n"


def side(turns: DataFrame) -> DataFrame:
    """pair_id, turn, role, text with one row for each turn."""
    clean = turns.select("pair_id", "turn", F.lower(F.coalesce("role", F.lit("user"))).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.where("pair_id is not null and turn is not null")
    return clean.groupBy("pair_id", "turn").agg(F.min(F.struct("role", "text")).alias("t"))


def render(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Turns of both sides (pair_id, turn, role, text) -> pair_id, part, turn, role, rendered, loss_mask.

    part is prompt (once for both sides), chosen or rejected.
    """
    a = side(chosen).withColumnRenamed("t", "a")
    b = side(rejected).withColumnRenamed("t", "b")
    turns = a.join(b, ["pair_id", "turn"], "full")
    split = turns.where("not (a <=> b)").groupBy("pair_id").agg(F.min("turn").alias("split"))
    placed = turns.join(split, "pair_id", "left")
    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    prompt = F.array(F.struct(F.lit("prompt").alias("part"), F.col("a").alias("t")))
    both = F.array(F.struct(F.lit("chosen").alias("part"), F.col("a").alias("t")), F.struct(F.lit("rejected").alias("part"), F.col("b").alias("t")))
    rows = placed.select("pair_id", "turn", F.explode(F.when(common, prompt).otherwise(both)).alias("x")).where("x.t is not null")
    mask = ((F.col("x.part") != "prompt") & (F.col("x.t.role") == "assistant")).cast("int")
    return rows.select("pair_id", F.col("x.part").alias("part"), "turn", F.col("x.t.role").alias("role"), render(F.col("x.t")).alias("rendered"), mask.alias("loss_mask"))


def assemble(rows: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected and the masked spans of both completions, one row per pair."""

    def part(name: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("turn", "rendered", "loss_mask")))), lambda x: F.struct(x["rendered"].alias("rendered"), x["loss_mask"].alias("loss_mask")))

    parts = rows.groupBy("pair_id").agg(*[part(n).alias(n) for n in ("prompt", "chosen", "rejected")])

    def text(name: str) -> Column:
        return F.array_join(F.col(name)["rendered"], "").alias(name)

    return parts.select("pair_id", text("prompt"), text("chosen"), text("rejected"), F.col("chosen").alias("chosen_turns"), F.col("rejected").alias("rejected_turns"))


def pairs_from(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs out of one table of conversations: each with an assistant turn is the chosen side of a pair.

    The rejected side has the same turns up to the last assistant turn, and from there on the turns of the neighbouring
    conversation (ids 2k and 2k + 1 swap), which answers another question.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    cut = rows.where(F.lower("role") == "assistant").groupBy("conv_id").agg(F.max("turn").alias("cut"))
    own = rows.join(cut, "conv_id").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text", "cut")
    other = rows.withColumn("pair_id", F.col("conv_id").bitwiseXOR(F.lit(1))).drop("conv_id")
    other = other.join(cut.withColumnRenamed("conv_id", "pair_id"), "pair_id").where("turn >= cut")
    rejected = own.where("turn < cut").select("pair_id", "turn", "role", "text").unionByName(other.select("pair_id", "turn", "role", "text"))
    return own.drop("cut"), rejected


def op2_preference_format(spark, sf_dir: str) -> DataFrame:
    return format_pairs(*pairs_from(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: DuckDB SQL for the rows of op2_preference_format.
OP2_SQL = r"""
with r as (select conv_id, turn, lower(coalesce(role, 'user')) rl, coalesce(text, '') tx, role from conversations where conv_id is not null and turn is not null),
cut as (select conv_id, max(turn) c from r where lower(role) = 'assistant' group by 1),
ch as (select r.conv_id pair_id, turn, rl, tx, c from r join cut using (conv_id)),
re as (select pair_id, turn, rl, tx from ch where turn < c union all
  select cut.conv_id, r.turn, rl, tx from r join cut on cut.conv_id = xor(r.conv_id, 1) where r.turn >= c),
a as (select pair_id, turn, min((rl, tx)) t from ch group by 1, 2),
b as (select pair_id, turn, min((rl, tx)) t from re group by 1, 2),
j as (select coalesce(a.pair_id, b.pair_id) pair_id, coalesce(a.turn, b.turn) turn, a.t ta, b.t tb from a full join b on a.pair_id = b.pair_id and a.turn = b.turn),
s as (select pair_id, min(turn) split from j where ta is distinct from tb group by 1),
x as (select j.*, split from j left join s using (pair_id)),
o as (select pair_id, 'prompt' part, turn, ta t from x where split is null or turn < split
  union all select pair_id, 'chosen', turn, ta from x where turn >= split and ta is not null
  union all select pair_id, 'rejected', turn, tb from x where turn >= split and tb is not null)
select pair_id, part, turn, t[1] as "role", '<|' || t[1] || '|>' || chr(10) || t[2] || '<|end|>' || chr(10) rendered,
  (part <> 'prompt' and t[1] = 'assistant')::int loss_mask from o
"""
