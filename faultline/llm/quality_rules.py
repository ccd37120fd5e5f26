"""Quality rules as a bitmask ledger.

``ledger`` reads every text once and stores its measurements with one integer whose bit r says that rule r failed.
Policies are named masks over those bits. They apply to the stored ledger, so a new policy version costs a filter and no
second reading of the texts, and ``ablations`` needs only the counts of the distinct bit patterns (at most 2^rules
rows), whatever the number of documents.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows and repeated ids give one
ledger row each; a null id is kept as null; an empty table gives an empty ledger; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import only, raw_texts, small_batches

#: Rules in bit order: name and Spark SQL condition under which a document fails. The first two are the base rules.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("many_exclamations", "10 * n_bangs > 3 * n_words"),
)
BITS = {name: 1 << r for r, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]

#: Versioned policies: a document is kept when no bit of the mask is set.
POLICIES = {
    "v1": BASE,
    "v2": BASE | BITS["many_symbols"] | BITS["duplicate_lines"],
    "v3": BASE | BITS["many_symbols"] | BITS["duplicate_lines"] | BITS["short_words"] | BITS["long_words"] | BITS["many_exclamations"],
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(seen) + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()  # bytes split at \x20 and \x09-\x0D only
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        sum(text.count(bytes([c])) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        text.count(b"!"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements and ``failures``, the bits of the rules that it fails."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(x) for x in raw_texts(batch.column(1))], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, k]) for k in range(len(MEASURES))]], ["doc_id", *MEASURES])

    found = only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(fails), F.lit(1 << r)).otherwise(F.lit(0)).cast("long") for r, (_, fails) in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return found.withColumn("failures", failures)


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """Adds base_failed and kept under a policy version."""
    return rows.withColumns({
        "base_failed": F.col("failures").bitwiseAND(F.lit(BASE)) != 0,
        "kept": F.col("failures").bitwiseAND(F.lit(POLICIES[version] | BASE)) == 0,
    })


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy version and rule: documents the rule rejects, and those it alone rejects (kept without it)."""
    spark = rows.sparkSession
    patterns = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    policies = spark.createDataFrame([(v, name, mask, BITS[name]) for v, mask in POLICIES.items() for name in BITS if mask & BITS[name]], "version string, rule string, mask long, bit long")
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    return (
        patterns.crossJoin(F.broadcast(policies))  # at most 2^rules patterns by versions x rules
        .groupBy("version", "rule")
        .agg(
            F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this_rule"),
            F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("kept"),
        )
    )


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_policy(ledger(docs), "v3").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


#: DuckDB SQL for the rows of op7_quality_rules.
OP7_SQL = r"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from d),
win as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from (select rid, ws, unnest(range(1, len(ws) - 1)) i from w)),
rep as (select rid, count(distinct i + k) n from (select rid, i, count(*) over (partition by rid, g) c from win), (select unnest([0, 1, 2]) k) where c > 1 group by rid),
l as (select rid, count(*) n_lines, count(*) - count(distinct x) n_dup from (select rid, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by rid),
m as (select w.rid, w.doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(n_dup, 0)::bigint n_dup_lines,
  coalesce(rep.n, 0)::bigint n_repeat_words, coalesce(n_lines, 0)::bigint n_lines, (length(t) - length(replace(t, '!', '')))::bigint n_bangs
  from w left join rep using (rid) left join l using (rid)),
f as (select *, ((case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end) + (case when 10 * n_symbols > n_words then 4 else 0 end)
  + (case when 100 * n_dup_lines > 30 * n_lines then 8 else 0 end) + (case when word_chars < 2 * n_words then 16 else 0 end)
  + (case when word_chars > 15 * n_words then 32 else 0 end) + (case when 10 * n_bangs > 3 * n_words then 64 else 0 end))::bigint failures from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 base_failed, failures = 0 kept, failures from f
"""
