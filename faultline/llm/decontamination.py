"""Benchmark decontamination: one Aho-Corasick automaton over test questions and answers, scanning each text once.

Normalised text: A-Z in lower case, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ten consecutive words of an
item; an item of fewer words, but not none, is one window. The automaton reads numbers of words, so it tells at which
word a window ends, and place and length of the window give the words that are hit.

The windows are built into the automaton once in each Python worker, from the items' words, which are broadcast. That is
done only up to ``GROUP_WORDS`` words; a larger benchmark is cut into groups of whole items, each of which has an
automaton and a reading of its own, and the hits of a row in different groups are joined. So memory is bounded by the
group, and nothing is left out.

Rows are scanned in place, without a shuffle. Memory of a task is a batch of texts and the matches of one text; runs of
hits are kept as intervals.

Defined results: a null or empty text has no words and no hit; an item of null or empty text has no window; equal items
are named each; an item of null id hits words and is not named; rows of one id and different texts are rows of their own; an empty benchmark hits nothing; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import documents, materialize, only, raw_texts, sliced, small_batches, unused

WINDOW = 10
#: Words of the items of one automaton, which takes up to 130 MB in a worker (measured on random words).
GROUP_WORDS = 200_000

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lower case for A-Z, a space for what is in no word. Bytes from 0x80 on are parts of letters beyond ASCII.
NORMAL = bytes(c if c in _WORD_BYTES else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_RUN = re.compile(rb"[^ ]+")

SCANNED = "doc_id long, th long, n_words long, hits array<int>, items array<string>"

_built: dict[str, tuple] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Windows:
    """The automaton of some items: word numbers, and for each window its length and the items that have it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.owners: list[list[str]] = []
        known: dict[tuple, int] = {}
        for item, words in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                key = tuple(ids[at : at + window])
                if key not in known:
                    known[key] = len(self.owners)
                    self.owners.append([])
                    self.automaton.add_word(key, (known[key], len(key)))
                if item is not None and self.owners[known[key]][-1:] != [item]:
                    self.owners[known[key]].append(item)
        if known:
            self.automaton.make_automaton()
        self.empty = not known

    def scan(self, words: list[bytes]) -> tuple[list[int], set[int]]:
        """Begin and end (exclusive) of each run of hit words, one after the other, and the windows that occur."""
        if self.empty or not words:
            return [], set()
        runs: list[int] = []
        found: set[int] = set()
        number = self.number.get
        for end, (window, length) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            found.add(window)
            begin = end + 1 - length
            while runs and begin <= runs[-2]:  # a longer window may begin before earlier runs
                del runs[-2:]
            if runs and begin <= runs[-1]:
                runs[-1] = end + 1
            else:
                runs += [begin, end + 1]
        return runs, found


def windows_of(key: str, items: list[tuple[str, list[bytes]]]) -> Windows:
    """A worker builds an automaton once, and holds one."""
    if key not in _built:
        _built.clear()
        _built[key] = Windows(items)
    return _built[key]


def items_of(benchmark: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """item_id (text), words, n, upto (words of all items up to this one): the items that have a window."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [words_of(x) for x in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b" ".join(x) for x in parts], pa.binary()), pa.array([len(x) for x in parts], pa.int64())], ["item_id", "words", "n"])

    each = only(benchmark, "item_id", *columns).select(F.col("item_id").cast("string").alias("item_id"), F.explode(F.array(*columns)).alias("text"))
    return materialize(each.mapInArrow(rows, "item_id string, words binary, n long").where("n > 0"), "items")


def groups_of(items: DataFrame, most: int | None = None) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Lists of items of about so many words (by hash), each no larger than that unless one item is."""
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // (most or GROUP_WORDS)) if total > (most or GROUP_WORDS) else 1)
    for g in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == g).select("item_id", "words").collect()  # bounded by the group
        yield sorted(((r.item_id, bytes(r.words).split()) for r in part), key=lambda x: (x[0] is None, x))


def scan(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, th (hash of the text), n_words, hits (begin and end of each run of hit words), items (sorted); one row per document.

    docs: doc_id, text. benchmark: item_id and columns of text (questions, answers); a window lies in one column.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    docs = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("th"), "text")

    def scanned(items: list[tuple[str, list[bytes]]]) -> DataFrame:
        key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = windows_of(key, sent.value)
            for batch in sliced(batches, 100):
                n, hits, names = [], [], []
                for text in raw_texts(batch.column(2)):
                    words = words_of(text)
                    runs, found = windows.scan(words)
                    n.append(len(words))
                    hits.append(runs)
                    names.append(sorted({x for w in found for x in windows.owners[w]}))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], [x.split()[0] for x in SCANNED.split(", ")])

        return docs.mapInArrow(rows, SCANNED)

    found = [scanned(items) for items in groups_of(items_of(benchmark, columns))]
    if len(found) == 1:
        return found[0]
    doc, th = "_doc", "_th"
    more = found[0].where("size(hits) > 0")
    for x in found[1:]:
        more = more.unionByName(x.where("size(hits) > 0"))
    one = more.groupBy(F.col("doc_id").alias(doc), F.col("th").alias(th)).agg(F.collect_set("hits").alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("its"))
    one = materialize(one.select(doc, th, united(F.col("all")).alias("h"), "its"), "hits")  # a row for each document that is hit
    base = found[0].select("doc_id", "th", "n_words")
    joined = base.join(one, base.doc_id.eqNullSafe(F.col(doc)) & base.th.eqNullSafe(F.col(th)), "left")
    return joined.select("doc_id", "th", "n_words", F.coalesce("h", F.array().cast("array<int>")).alias("hits"), F.coalesce("its", F.array().cast("array<string>")).alias("items"))


def united(lists: Column) -> Column:
    """Runs of hit words of several groups as one list of runs."""
    pairs = F.flatten(F.transform(lists, lambda x: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(x), 1) - 1), lambda i: F.struct(F.element_at(x, (2 * i + 1).cast("int")).alias("b"), F.element_at(x, (2 * i + 2).cast("int")).alias("e")))))

    def step(runs: Column, p: Column) -> Column:
        last = F.element_at(runs, -1)
        joins = (F.size(runs) > 0) & (p["b"] <= F.when(F.size(runs) > 0, last))
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.greatest(last, p["e"])))
        return F.when(joins, longer).otherwise(F.concat(runs, F.array(p["b"], p["e"])))

    return F.aggregate(F.array_sort(pairs), F.array().cast("array<int>"), step)


def n_hit(hits: Column) -> Column:
    """Words in the runs: ends less begins."""
    return F.aggregate(F.transform(hits, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)


def spans(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """The documents that are hit, all columns kept, with spans: begin and end (exclusive, in code points of the text)."""
    doc, th, hits, out = unused(docs, "_doc", "_th", "_hits", "spans")
    hit = scanned.where("size(hits) > 0").select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("hits").alias(hits)).dropDuplicates([doc, th])
    joined = docs.join(hit, F.col("doc_id").eqNullSafe(F.col(doc)) & F.xxhash64("text").eqNullSafe(F.col(th)))

    @F.pandas_udf("array<struct<begin:int,end:int>>")
    def located(text, runs):
        return pd.Series([offsets(t, r) for t, r in zip(text, runs, strict=True)], dtype=object)

    return joined.withColumn(out, located("text", hits)).drop(doc, th, hits)


def offsets(text: str, runs) -> list[dict[str, int]]:
    """Code points of the text where runs of words begin and end."""
    raw = text.encode()
    places = [m.span() for m in _RUN.finditer(raw.translate(NORMAL))]
    ends = [(places[b][0], places[e - 1][1]) for b, e in zip(runs[::2], runs[1::2], strict=True)]
    marks = sorted({x for p in ends for x in p})
    points, at, n = [], 0, 0
    for m in marks:
        n += len(raw[at:m].decode())
        points.append(n)
        at = m
    point = lambda x: points[bisect.bisect_left(marks, x)]
    return [{"begin": point(b), "end": point(e)} for b, e in ends]


def op12_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = n_hit(F.col("hits"))
    names = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (hit > 0).alias("contaminated"))


#: DuckDB SQL for the rows of op12_benchmark_decontamination.
OP12_SQL = r"""
with w as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select item_id::varchar item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
v as (select distinct item_id, least(10, len(ws)) k, array_to_string(ws[i : i + 9], ' ') g from (select item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) i from b where len(ws) > 0)),
k as (select distinct k from v),
p as (select rid, i, k, array_to_string(ws[i : i + k - 1], ' ') g from (select rid, ws, unnest(range(1, len(ws) + 1)) i from w) join k on i + k - 1 <= len(ws)),
m as (select rid, i, p.k, item_id from p join v on p.k = v.k and p.g = v.g),
h as (select rid, count(distinct x) n from (select rid, unnest(range(i, i + k)) x from (select distinct rid, i, k from m)) group by rid),
t as (select rid, count(*) n, sha256(string_agg(item_id, ',' order by item_id)) s from (select distinct rid, item_id from m where item_id is not null) group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(h.n, 0)::bigint n_hit, coalesce(t.n, 0)::bigint n_items, coalesce(s, sha256('')) items_sha256, h.n is not null contaminated
from w left join h using (rid) left join t using (rid)
"""
