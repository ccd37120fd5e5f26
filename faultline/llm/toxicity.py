"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all thresholds and theta_1 < theta_2 < ... . The
output is the expected grade, the sum of P(grade >= k), with the probability of a grade above zero. x marks the distinct
words of a text, and beginnings of its longer words, that are in the model's vocabulary.

Fitting uses a bounded sample of labelled documents, ``sample_rows`` with the lowest hash of their id, equal rows counting
once (the documented bound; it takes all while there are fewer). Vocabulary: of the words of the sample, those whose presence departs
most clearly from independence of the grade (likelihood ratio), ``n_features`` at most. Scoring reads each text once, in
place, with the model's few thousand weights in each worker.

Defined results: a null or empty text has no features and gets the intercepts' grade; null or repeated ids are kept,
each row for itself; labels with a null id or grade are left out, repeated labels count once with their highest grade;
without labels of two grades the model rejects nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import materialize, only, raw_texts, small_batches

SAMPLE_ROWS = 20_000
N_FEATURES = 2000
LEAST_DOCS = 5
#: Likelihood ratio that a word must reach, far in the tail of chance for any vocabulary's size.
LEAST_RATIO = 30.0
N_GRADES = 3
STEM = 5

_word = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def features(text: bytes) -> set[str]:
    """The distinct words, and the beginnings (marked by a star) of longer ones, which word endings don't hide."""
    words = set(_word.findall(text.decode("utf-8", "replace").lower()))
    return words.union([w[:STEM] + "*" for w in words if len(w) > STEM])


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]

    def at_least(self, x: float) -> list[float]:
        """P(grade >= k) for k from 1."""
        return [1 / (1 + np.exp(min(50.0, max(-50.0, t - x)))) for t in self.thresholds]


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and severity: 0 if not toxic, 1 if toxic in a text of low quality, 2 if toxic in a fluent text.

    The top grade is open above, so texts with much evidence don't hold the weights of single words down.
    """
    grade = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.coalesce("quality", F.lit(1)) == 0), 1).when(F.col("toxic") == 1, 2)
    return labels.select("doc_id", grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))


def optimise(starts: np.ndarray, words: np.ndarray, y: np.ndarray, n_words: int, n_grades: int, rounds: int = 500, l2: float = 1e-5, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam over rows in compressed form: words[starts[i]:starts[i + 1]] are row i's features."""
    n = len(y)
    row = np.repeat(np.arange(n), np.diff(starts))
    w = np.zeros(n_words)
    # theta_1, then the logs of the gaps, so the order of the thresholds holds
    shares = [np.clip((y >= k).mean(), 0.5 / n, 1 - 0.5 / n) for k in range(1, n_grades)]
    theta = np.log(1 / np.array(shares) - 1)
    free = np.concatenate([w, theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    for t in range(1, rounds + 1):
        w = free[:n_words]
        gaps = np.exp(np.clip(free[n_words + 1 :], -10, 10))
        theta = free[n_words] + np.concatenate([[0], np.cumsum(gaps)])
        x = np.bincount(row, weights=w[words], minlength=n)
        up = 1 / (1 + np.exp(np.clip(theta[None, :] - x[:, None], -50, 50)))  # P(grade >= k)
        full = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        slope = full * (1 - full)
        i = np.arange(n)
        p = np.maximum(full[i, y] - full[i, y + 1], 1e-12)
        dx = (slope[i, y] - slope[i, y + 1]) / p / n  # of the log-likelihood
        dtheta = np.zeros(n_grades + 1)
        np.add.at(dtheta, y, -slope[i, y] / p / n)
        np.add.at(dtheta, y + 1, slope[i, y + 1] / p / n)
        dtheta = dtheta[1:-1]
        grad = -np.concatenate([np.bincount(words, weights=dx[row], minlength=n_words) - l2 * w, [dtheta.sum()], gaps * dtheta[::-1].cumsum()[::-1][1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        free = free - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(np.clip(free[n_words + 1 :], -10, 10))
    return free[:n_words], free[n_words] + np.concatenate([[0], np.cumsum(gaps)])


def fit(docs: DataFrame, graded: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = N_FEATURES, n_grades: int = N_GRADES) -> Model:
    """graded: doc_id, grade (0 to n_grades - 1), one row for each id."""
    spark = docs.sparkSession
    small_batches(spark)
    # Labelled documents of the lowest hash, equal rows once: sample_rows at most, whatever ids repeat.
    hashed = only(docs, "doc_id", "text").where("text is not null").select("doc_id", F.xxhash64("text").alias("th"))
    known = hashed.join(graded, "doc_id").distinct()
    sample = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(sample_rows), "sample")
    texts = only(docs, "doc_id", "text").where("text is not null").withColumn("th", F.xxhash64("text")).join(F.broadcast(sample), ["doc_id", "th"])
    texts = materialize(texts.dropDuplicates(["doc_id", "th"]).select("doc_id", "text", "grade"), "sample-texts")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[int]] = {}

        def rows() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(own.values(), pa.list_(pa.int64()))], ["word", "n"])
            own.clear()
            return got

        for batch in batches:
            for text, grade in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for word in features(text):
                    own.setdefault(word, [0] * n_grades)[grade] += 1
                if len(own) > 200_000:
                    yield rows()
        if own:
            yield rows()

    per_word = texts.mapInArrow(counts, "word string, n array<long>").select("word", *[F.col("n")[k].alias(f"n{k}") for k in range(n_grades)])
    summed = per_word.groupBy("word").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(n_grades)])
    totals = {r.grade: r.n for r in texts.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(totals.values())
    if len(totals) < 2:
        return Model({}, [50.0 + k for k in range(n_grades - 1)])
    df = sum((F.col(f"n{k}") for k in range(n_grades)), F.lit(0))
    ratio = F.lit(0.0)
    for k in range(n_grades):
        if share := totals.get(k, 0) / n:
            for seen, margin in ((F.col(f"n{k}"), df), (F.lit(totals[k]) - F.col(f"n{k}"), F.lit(n) - df)):
                ratio = ratio + F.when((seen > 0) & (margin > 0), 2 * seen * F.log(seen / (margin * share))).otherwise(0.0)
    chosen = summed.where(df >= LEAST_DOCS).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    names = [r.word for r in chosen.orderBy(F.desc("ratio"), "word").limit(n_features).collect()]
    place = {w: i for i, w in enumerate(names)}

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[w] for w in features(x) if w in place) for x in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "found"])

    rows = sorted(texts.mapInArrow(marks, "doc_id long, grade int, found array<int>").collect())  # sample_rows rows at most
    starts = np.concatenate([[0], np.cumsum([len(r.found) for r in rows])]).astype(np.int64)
    words = np.array([i for r in rows for i in r.found], dtype=np.int64)
    w, theta = optimise(starts, words, np.array([r.grade for r in rows]), len(names), n_grades)
    return Model(dict(zip(names, w.tolist(), strict=True)), theta.tolist())


def score(docs: DataFrame, model: Model, reject_at: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (probability of a grade above zero), grade, rejected."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.weights.keys()
        for batch in batches:
            ps = [model.at_least(sum(sorted(model.weights[w] for w in features(x) & known))) for x in raw_texts(batch.column(1))]
            first = [p[0] for p in ps]
            columns = [batch.column(0), pa.array([float(sum(p)) for p in ps], pa.float64()), pa.array([float(p) for p in first], pa.float64()), pa.array([sum(p >= 0.5 for p in q) for q in ps], pa.int32()), pa.array([bool(p >= reject_at) for p in first], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "p_toxic", "grade", "rejected"])

    return only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, severity double, p_toxic double, grade int, rejected boolean")


def keep_clean(docs: DataFrame, model: Model, reject_at: float = 0.5) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns, in one reading of the texts."""
    small_batches(docs.sparkSession)
    where = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.weights.keys()
        for batch in batches:
            keep = [model.at_least(sum(sorted(model.weights[w] for w in features(x) & known)))[0] < reject_at for x in raw_texts(batch.column(where))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, grades(labels)))
