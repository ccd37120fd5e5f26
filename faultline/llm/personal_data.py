"""Personal data by patterns and by bootstrapped contexts, in DataFrame operations only.

Base spans are the four kinds of PATTERNS. They seed a graph: an instance is a surface form; its patterns are the two words
before it, and the one word before it, which holds for places that no seed has in full. A pattern's score for a kind is the share of its distinct instances known for that kind, with at least
``support`` of them; an unknown instance takes the best score of its patterns; once a round adds no instance, mentions of
identifier-like words and runs of digit groups whose instance reaches ``confidence`` and whose shape suits the kind
become spans too. Distinct instances count, so copies of a text lend no support. A run that begins with an
identifier-like word is found like one, but only the word counts as an instance of their pattern.

A match's place comes from splitting the text by the same pattern: pieces and matches alternate, so each start is the
length of all that stands before it, and the words before a match stand in the pieces and matches just before it. Patterns are written so that Java matches them without recursion and without
rescanning a run of signs: a run's first sign, or the place where the last match ended, is the only start that counts.

Defined results: a null or empty text has no spans; null ids are kept; rows equal in id and text get equal spans; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import materialize, unused

KINDS = ("email", "ip", "card", "phone")
WORD, GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
#: Identifier-like words: an @ or four digits.
CANDIDATE = rf"(?<!{WORD})(?={WORD}*?@|(?:[^\x20\x09-\x0D0-9]*+[0-9]){{4}}){WORD}++"
#: Digit groups with single spaces between them.
RUN = rf"(?<!{WORD})[+(]?[0-9][0-9().-]*+(?:\x20\(?[0-9][0-9().-]*+)++"
#: The longest beginning of such a run, up to a space or its end, that may be a card or a phone.
FITS = {2: r"^[0-9](?:-*\x20?[0-9]){11,18}-*(?=\x20|$)", 3: r"^[+(]?[0-9](?:[().-]*\x20?\(?[0-9]){5,14}[().-]*(?=\x20|$)"}
#: Spans by pattern have a kind, identifier-like words -1, runs -1 or, where such a word begins them, -2.
SPAN = "array<struct<kind:int,start:long,stop:long,form:string,context:string>>"


def digits(form: Column) -> Column:
    return F.regexp_replace(form, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        v = F.substring(number, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def holds(kind: str, form: Column) -> Column:
    """The test that a match must also pass."""
    if kind == "ip":
        return form.rlike(IP_PARTS)
    if kind == "card":
        return F.length(digits(form)).between(16, 19) & luhn(digits(form))
    if kind == "phone":
        return F.length(digits(form)).between(8, 15)
    return F.lit(True)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, span: int = 128) -> Column:
    """Sums of a list up to and with each element, in parts, since each sum over the whole list would take its length."""
    plus = lambda a, x: a + x
    zero = F.lit(0).cast("long")

    def part(parts: Column, own: Column, c: Column) -> Column:
        ahead = F.aggregate(F.slice(parts, F.lit(1), c), zero, lambda a, x: a + F.aggregate(x, zero, plus))
        return bound(ahead, lambda b: F.transform(own, lambda _, i: b + F.aggregate(F.slice(own, F.lit(1), i + 1), zero, plus)))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / span).cast("int")), lambda c: F.slice(values, c * span + 1, F.lit(span)))
    sums = bound(cut, lambda parts: F.flatten(F.transform(parts, lambda own, c: part(parts, own, c))))
    return F.when(F.size(values) > 0, sums).otherwise(F.array().cast("array<long>"))


TWO_WORDS = rf"{GAP}({WORD}+{GAP}+{WORD}+{GAP}*)$"


def context(text: Column, start: Column, near: Column) -> Column:
    """The two words before a place, in lower case; empty if there aren't two. near: what stands just before it."""
    close = F.regexp_extract(F.right(near, F.lit(120)), TWO_WORDS, 1)
    wider = F.regexp_extract(near, TWO_WORDS, 1)
    # the words begin further ahead, or with the text: from the place backwards
    far = F.reverse(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), start.cast("int"))), rf"^{GAP}*+{WORD}++{GAP}++{WORD}++", 0))
    return F.lower(F.regexp_replace(F.when(close != "", close).when(wider != "", wider).otherwise(far), rf"{GAP}+", " "))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern as spans, with the two words before each."""

    def spans(f: Column, p: Column, ends: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            stop = F.get(ends, i)
            start = stop - F.length(m)
            near = F.concat_ws("", F.get(p, i - 2), F.get(f, i - 2), F.get(p, i - 1), F.get(f, i - 1), F.get(p, i))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), m.alias("form"), context(text, start, near).alias("context"))

        return F.transform(f, one)

    def both(x: Column) -> Column:
        f, p = x["f"], x["p"]
        sizes = F.zip_with(f, F.slice(p, F.lit(1), F.size(f)), lambda m, b: (F.length(m) + F.length(b)).cast("long"))
        return bound(bound(sizes, lambda v: running(v)), lambda ends: spans(f, p, ends))

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"), F.split(text, pattern, -1).alias("p"))
    return bound(pair, both).cast(SPAN)


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), base and other: spans by pattern and identifier-like words outside of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    guard = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+"))}
    nothing = F.array().cast(SPAN)

    def spans(i: int, kind: str) -> Column:
        return F.when(guard[kind], F.filter(matches(text, PATTERNS[kind], i), lambda s: holds(kind, s["form"]))).otherwise(nothing)

    parts = [spans(i, kind) for i, kind in enumerate(KINDS)]
    found = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"), F.concat(*parts).alias("base"))
    words = F.when(F.col("text").rlike("[0-9@]"), matches(F.col("text"), CANDIDATE, -1)).otherwise(nothing)
    runs = F.when(F.col("text").rlike(r"[0-9][().-]*\x20\(?[0-9]"), F.filter(matches(F.col("text"), RUN, -1), lambda s: F.length(digits(s["form"])) >= 6)).otherwise(nothing)
    starts = F.transform("words", lambda w: w["start"])
    marked = F.transform("runs", lambda s: F.struct(F.when(F.array_contains(starts, s["start"]), -2).otherwise(-1).alias("kind"), s["start"], s["stop"], s["form"], s["context"]))
    found = found.withColumn("words", words).withColumn("runs", runs).withColumn("other", F.concat("words", marked))
    free = F.when(F.size("base") == 0, F.col("other")).otherwise(F.filter("other", lambda w: ~F.exists("base", lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"]))))
    return found.select("doc_id", "th", "base", free.alias("other"))


def fitted(kind: Column, form: Column) -> Column:
    """The part of a form that has the shape of a kind: a word, or the beginning of a run; empty if there is none."""
    run = F.coalesce(*[F.when(kind == k, F.regexp_extract(form, pattern, 0)) for k, pattern in FITS.items()], F.lit(""))
    return F.when(F.contains(form, F.lit(" ")), run).otherwise(F.when(suits(kind, form), form).otherwise(""))


def suits(kind: Column, form: Column) -> Column:
    """Whether a word has the shape of a kind."""
    n = F.length(digits(form))
    return (
        ((kind == 0) & F.contains(form, F.lit("@")))
        | ((kind == 1) & form.rlike(r"^[0-9]+(?:[.:][0-9]+){3}") & (n <= 12))
        | ((kind == 2) & (n >= 12) & form.rlike(r"^[0-9-]+\p{Punct}?$"))
        | ((kind == 3) & n.between(6, 15) & form.rlike(r"^[+(]?[0-9][0-9().-]*\p{Punct}?$"))
    )


def patterns_of(words: Column) -> Column:
    """The patterns of a place: the two words before it, and a mark with the last of them."""
    return F.array(words, F.concat(F.lit("~ "), F.regexp_extract(words, "[^ ]+ ?$", 0)))


def discover(found: DataFrame, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """doc_id, th, more: the spans that the graph of contexts and instances adds."""
    each = lambda c: found.select(F.explode(c).alias("s")).select("s.context", "s.form", "s.kind").where("context <> ''")
    own = each("base").unionByName(each("other")).groupBy("context", F.lower("form").alias("form")).agg(F.max("kind").alias("kind"))
    edges = own.withColumn("context", F.explode(patterns_of(F.col("context")))).groupBy("context", "form").agg(F.max("kind").alias("kind"))
    edges = materialize(edges, "contexts")
    # known: score of an instance for a kind; the seeds have 1
    known = edges.where("kind >= 0").select("form", F.col("kind").alias("k"), F.lit(1.0).alias("score")).distinct()
    counted = edges.where("kind >= -1")
    size = counted.groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    number = before = 0
    while True:
        hits = counted.join(known, "form").groupBy("context", "k").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("seeds"))
        patterns = hits.where(F.col("seeds") >= support).join(size, "context").select("context", "k", (F.col("mass") / F.col("n")).alias("p")).where("p >= 0.5")
        unknown = edges.where("kind < 0").join(patterns, "context").where(fitted(F.col("k"), F.col("form")) != "")
        best = materialize(unknown.groupBy("form", "k").agg(F.max("p").alias("score")), "instances")
        known = edges.where("kind >= 0").select("form", F.col("kind").alias("k"), F.lit(1.0).alias("score")).distinct().unionByName(best)
        number, added, before = number + 1, best.count() - before, best.count()
        if not before or (number > 1 and not added):  # scores only rise, so instances never go again
            break
    sure = best.where(F.col("score") >= confidence).groupBy("form").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"))
    new = found.where(F.size("other") > 0).select("doc_id", "th", F.explode("other").alias("s")).withColumn("form", F.lower("s.form")).join(sure, "form")
    form = fitted(F.col("k"), F.col("s.form"))
    span = F.struct(F.col("k").alias("kind"), F.col("s.start"), (F.col("s.start") + F.length(form)).alias("stop"), form.alias("form"), F.col("s.context"))
    within = lambda a, b: (b["start"] <= a["start"]) & (a["stop"] <= b["stop"]) & (b["stop"] - b["start"] > a["stop"] - a["start"])
    outer = F.filter("more", lambda a: ~F.exists("more", lambda b: within(a, b)))
    return materialize(new.select("doc_id", "th", span.alias("s")).distinct().groupBy("doc_id", "th").agg(F.collect_list("s").alias("more")).withColumn("more", outer), "discovered")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, th, base, spans (base ones and discovered ones), one row per document."""
    found = materialize(mentions(docs), "mentions")
    more = discover(found).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "more")
    both = found.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return both.select("doc_id", "th", "base", F.concat("base", F.coalesce("more", F.array().cast(SPAN))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["stop"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by <KIND>, all columns kept; n_chars, where present, follows the text."""
    d, t, found, new = unused(docs, "_d", "_t", "_spans", "_new")
    spans = find(docs.select("doc_id", "text")).where(F.size("spans") > 0).select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("spans").alias(found)).dropDuplicates([d, t])
    spans = materialize(spans, "redactions")
    text = F.col("text")
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(t)), "left")
    by_place = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def add(a: Column, s: Column) -> Column:
        kept = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        new = F.struct(s["stop"].alias("at"), F.concat(a["out"], kept, F.get(names, s["kind"])).alias("out"))
        longer = F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out"))  # overlaps the last span
        return F.when(s["start"] >= a["at"], new).otherwise(longer)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(by_place, start, add, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    # in a select of its own: within one select, "text" inside a lambda may mean the new column of that name
    joined = joined.withColumn(new, F.when(F.col(found).isNotNull(), clean))
    columns = []
    for c, kind in docs.dtypes:
        if c == "text":
            columns.append(F.coalesce(new, text).alias("text"))
        elif c == "n_chars":
            columns.append(F.coalesce(F.length(new).cast(kind), F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return joined.select(*columns)


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
