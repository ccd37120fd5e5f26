"""The corpus operators against brute force, round trips and held-out figures, with the hard cases of each."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import jaccard_join, media_chunks, mixing, packing, personal_data, preference_format, quality_rules, recurrent_lm, tokens, toxicity, wavelet
from faultline.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars int, node long, label string"  # node and label clash with inner names
LONG = " ".join(f"word{i % 977} and,{i % 13}." for i in range(6000))
CASES = [
    (1, None, None, None, None, 7, "x"), (2, "", "en", "a", 0, 7, "x"), (None, "a null id", "en", "a", 9, None, None), (3, "one two", "en", "b", 7, 1, None), (3, "one two", "en", "b", 7, 1, None),
    (4, LONG, "en", "a", len(LONG), 2, "y"), (5, LONG, "en", None, len(LONG), 2, "y"), (6, "é, 日本 a b  c\n\n\td \x1c e", "en", "b", 3, 0, ""), (7, "mail me: a.b@c.de or b@c.d.e.f", "en", "c", 0, 0, ""),
    (8, " ".join(["copy"] * 300), "en", "c", 0, 0, ""), (9, "an end <|endoftext|> sign", "en", "c", 0, 0, ""),
]
TEXTS = [t or "" for _, t, *_ in CASES]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CASES, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


LIBRARY = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def key(x):
    return tuple((v is None, v) for v in x)


# --- 1


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    rows = [(7, f"word{i % 5} text") for i in range(60)] + [(i, f"fine text {i}") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    graded = spark.createDataFrame([(7, 1), *[(i, 0) for i in range(100, 160)]], "doc_id long, grade int")
    seen = []
    monkeypatch.setattr(toxicity, "optimise", lambda starts, words, y, n, k: (seen.append(len(y)), (np.zeros(n), np.arange(k - 1.0)))[1])
    toxicity.fit(docs, graded, sample_rows=40, n_grades=2)
    toxicity.fit(docs, graded, sample_rows=1000, n_grades=2)
    assert seen == [40, 65]  # equal rows count once


def test_toxicity_learns_ordered_grades(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{k}" for k in rng.integers(0, 400, 30)]
        grade = i % 10 == 0
        if grade:
            words[3] = "vile"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 20 != 0), int(grade)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train, rest = docs.where("doc_id < 400"), docs.where("doc_id >= 400")
    model = toxicity.fit(train, toxicity.grades(lab))
    assert model.thresholds == sorted(model.thresholds) and "vile" in model.weights
    got = {r.doc_id: r for r in toxicity.score(rest, model).collect()}
    assert all(r.rejected == (i % 10 == 0) for i, r in got.items())
    assert all(0 <= r.severity <= 2 for r in got.values())
    assert toxicity.keep_clean(rest, model).count() == 180


def test_toxicity_score_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(["Fine", "vileness", "sorry", "don't", "été"][k] for k in rng.integers(0, 5, int(rng.integers(0, 9)))) for _ in range(60)] + [None, ""]
    model = toxicity.Model({"vilen*": 2.5, "sorry": -1.0, "don't": 0.25, "été": 0.5}, [0.3, 1.9])
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        words = set((text or "").lower().split())
        x = 2.5 * ("vileness" in words) - ("sorry" in words) + 0.25 * ("don't" in words) + 0.5 * ("été" in words)
        p = [1 / (1 + math.exp(t - x)) for t in (0.3, 1.9)]
        assert math.isclose(got[i].severity, sum(p)) and math.isclose(got[i].p_toxic, p[0]) and got[i].grade == sum(q >= 0.5 for q in p) and got[i].rejected == (p[0] >= 0.5)


def test_toxicity_vocabulary_is_chosen_by_likelihood_ratio(spark, monkeypatch):
    rng, rows, labels = np.random.default_rng(6), [], []
    for i in range(300):
        toxic = i % 4 == 0
        rows.append((i, " ".join([f"w{chr(97 + k // 10)}{chr(97 + k % 10)}" for k in rng.integers(0, 30, 8)] + (["bad"] if toxic and rng.random() < 0.7 else []) + (["nice"] if not toxic and rng.random() < 0.5 else []))))
        labels.append((i, int(toxic) + int(toxic and i % 8 == 0)))
    monkeypatch.setattr(toxicity, "LEAST_RATIO", 3.0)
    seen = {}
    monkeypatch.setattr(toxicity, "optimise", lambda starts, words, y, n, k: (seen.update(n=n), (np.zeros(n), np.arange(k - 1.0)))[1])
    chosen = set(toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, grade int"), n_features=5).weights)
    ratio = {}
    for w in {w for _, t in rows for w in t.split()}:
        table = Counter((w in t.split(), g) for (_, t), (_, g) in zip(rows, labels, strict=True))
        ratio[w] = sum(2 * n * math.log(n * 300 / (sum(v for (a, _), v in table.items() if a == has) * sum(v for (_, b), v in table.items() if b == g))) for (has, g), n in table.items())
    want = {w for w, r in sorted(ratio.items(), key=lambda x: (-x[1], x[0])) if r >= 3}
    assert chosen == set(sorted(want, key=lambda w: (-ratio[w], w))[:5]) and {"bad", "nice"} <= chosen


def test_toxicity_reaches_the_optimum():
    rng = np.random.default_rng(9)
    found = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(900)]
    true = np.array([1.5, -1.0, 0.5, 0.0, 2.0, -0.5])
    noise = rng.logistic(size=900)
    y = np.digitize(np.array([true[f].sum() for f in found]) + noise, [0.5, 2.0])
    starts, words = np.concatenate([[0], np.cumsum([len(f) for f in found])]), np.concatenate(found)
    w, theta = toxicity.optimise(starts, words, y, 6, 3)

    def loss(v):
        x = np.array([v[f].sum() for f in found])
        up = [np.ones(900), *[1 / (1 + np.exp(t - x)) for t in v[6:]], np.zeros(900)]
        return -np.log([up[k][i] - up[k + 1][i] for i, k in enumerate(y)]).mean() + 0.5e-5 * (v[:6] ** 2).sum()

    best = np.concatenate([w, theta])
    slope = [(loss(best + e) - loss(best - e)) / 2e-5 for e in 1e-5 * np.eye(8)]
    assert np.abs(slope).max() < 2e-4 and theta[0] < theta[1]
    assert np.abs(w - true).max() < 0.5


def test_toxicity_cases(spark, docs, none):
    blank = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, toxicity.grades(blank))
    assert toxicity.score(docs, model).where("rejected").count() == 0 and toxicity.score(docs, model).count() == len(CASES)
    assert toxicity.score(none, model).count() == 0
    odd = spark.createDataFrame([(None, 1, 1), (3, None, 1), (3, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in toxicity.grades(odd).collect()] == [(3, 2)]


# --- 2


def test_preference_cases(spark):
    turn = "pair_id long, turn long, role string, text string, part string"
    chosen = spark.createDataFrame([(1, 0, "User", "hi", "z"), (1, 2, "assistant", "yes", "z"), (2, 0, "user", "q", "z"), (2, 0, "user", "q", "z"), (3, None, "user", "x", "z"), (None, 0, "user", "x", "z"), (4, 1, None, None, "z"), (5, 0, "user", "same", "z")], turn)
    rejected = spark.createDataFrame([(1, 0, "user", "hi", "z"), (1, 2, "assistant", "no", "z"), (1, 3, "user", "why", "z"), (2, 0, "user", "q", "z"), (5, 0, "user", "same", "z"), (5, 1, "assistant", "more", "z")], turn)
    got = sorted(tuple(r) for r in preference_format.format_pairs(chosen, rejected).select("pair_id", "part", "turn", "role", "loss_mask").collect())
    assert got == [
        (1, "chosen", 2, "assistant", 1), (1, "prompt", 0, "user", 0), (1, "rejected", 2, "assistant", 1), (1, "rejected", 3, "user", 0), (2, "prompt", 0, "user", 0),
        (4, "chosen", 1, "user", 0), (5, "prompt", 0, "user", 0), (5, "rejected", 1, "assistant", 1),
    ]
    pair = {r.pair_id: r for r in preference_format.assemble(preference_format.format_pairs(chosen, rejected)).collect()}[1]
    assert (pair.prompt, pair.chosen) == ("<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n")
    empty = spark.createDataFrame([], turn)
    assert preference_format.format_pairs(empty, empty).count() == 0


# --- 3


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        out.append((d, len(sets[i]), (min(known) if known else None) if sets[i] else d))
    return sorted(out, key=key)


def test_jaccard_cases(spark, docs, none):
    got = sorted((tuple(r) for r in jaccard_join.join(docs).drop("node", "th").collect()), key=key)
    assert got == brute_components([(d, t) for d, t, *_ in CASES])
    assert jaccard_join.join(none).count() == 0


def test_jaccard_families_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for family in range(12):
        base = [f"f{family}w{k}" for k in range(int(rng.integers(3, 160)))]
        for _ in range(12):  # copies that drift, so similarities lie on both sides of the threshold
            now = list(base)
            for _ in range(int(rng.integers(0, 5))):
                now[int(rng.integers(0, len(now)))] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(now)))
            if rng.random() < 0.3:
                base = now
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.join(docs).drop("node", "th").collect())
    assert got == brute_components(rows)
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {c for _, _, c in got}


def test_jaccard_hot_signature_and_blocks(spark, monkeypatch):
    rng, rows = np.random.default_rng(4), []
    shared = [f"s{k}" for k in range(9)]  # one passage in all texts, and pairs of near copies around it
    for i in range(24):
        own = [*shared, *[f"p{i}w{k}" for k in range(5)]]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, f"x{i}"]))]
    docs = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "HELD", 3)
    monkeypatch.setattr(jaccard_join, "small_batches", lambda spark, rows=0: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4))
    # one signature alone, so that no other one brings a pair together
    monkeypatch.setattr(jaccard_join, "sign", lambda e: (np.array([7], np.uint64), np.array([False])))
    for block, size in ((5, 1 << 25), (4096, 300), (4096, 1 << 25)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", size)
        assert sorted(tuple(r) for r in jaccard_join.join(docs).drop("node", "th").collect()) == brute_components(rows)


def test_jaccard_copies_in_two_tasks_with_other_neighbours(spark):
    rows, rng = [], np.random.default_rng(8)
    for i in range(300):
        n = [f"g{i}w{k}" for k in range(30)]
        m = list(n)
        m[int(rng.integers(0, 30))] = "x"  # a near copy
        at = int(rng.integers(0, 12))
        p = [*[f"q{i}w{k}" for k in range(20)], *n[at : at + 14], *[f"r{i}w{k}" for k in range(20)]]
        rows += [(0, 4 * i, " ".join(n)), (0, 4 * i + 1, " ".join(m)), (1, 4 * i + 2, " ".join(n)), (1, 4 * i + 3, " ".join(p))]
    rows.sort()
    docs = spark.createDataFrame(spark.sparkContext.parallelize([r[1:] for r in rows], 2), "doc_id long, text string")  # a half for each part
    assert docs.groupBy(F.spark_partition_id()).count().count() == 2
    assert sorted(tuple(r) for r in jaccard_join.join(docs).drop("node", "th").collect()) == brute_components([r[1:] for r in rows])


def indexed_components(rows):
    """As brute_components, over pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    up, at = {d: d for d in sets}, {}

    def find(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    same = {}
    for d in sorted(sets):
        same.setdefault(frozenset(sets[d]), []).append(d)
    for e, ids in same.items():
        for d in ids[1:] if e else []:
            up[find(d)] = find(ids[0])
        for x in e:
            at.setdefault(x, []).append(ids[0])
    for e, (d, *_) in same.items():
        for other, n in Counter(y for x in e for y in at[x] if y < d).items():
            if 100 * n >= 75 * (len(e) + len(sets[other]) - n):
                up[find(d)] = find(other)
    lowest = {}
    for d in sorted(sets):
        lowest.setdefault(find(d), d)
    return {d: (len(sets[d]), lowest[find(d)]) for d in sets}


def test_jaccard_is_the_same_however_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    expected = indexed_components([tuple(r) for r in docs.collect()])
    for n in (1, 4, 16):
        dealt = docs.coalesce(1) if n == 1 else docs.repartition(n, "doc_id")
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(dealt).collect()} == expected


def test_jaccard_keep_one_goes_by_rows(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "z"), (7, b, "y"), (None, b, "y"), (None, None, "n"), (None, "", "n"), (2, None, "n"), (2, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _d string")
    got = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect())
    assert got == Counter({(1, a): 1, (5, b): 1, (None, None): 1, (None, ""): 1, (2, None): 1})
    assert jaccard_join.keep_one(docs).columns == docs.columns


def test_jaccard_forest_joins_all_components():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**63, 80, dtype=np.uint64))
    sets = []
    for _ in range(60):
        out = int(rng.integers(0, 16))
        sets.append(np.unique(np.concatenate([rng.permutation(base)[out:], rng.integers(0, 2**63, out, dtype=np.uint64)])))
    for side in (np.array([0] + [3] * 59), np.array([0] + [1] * 30 + [2] * 29)):
        label = list(range(60))
        for i in range(60):
            for j in range(i):
                if (side[i] != side[j] or side[i] == 3) and jaccard_join.similar(sets[i], sets[j]):
                    label = [label[i] if x == label[j] else x for x in label]
        found = list(range(60))
        edges = jaccard_join.forest(side, sets)
        for i, j in edges:
            assert jaccard_join.similar(sets[i], sets[j])
            found = [found[i] if x == found[j] else x for x in found]
        assert len(edges) == 60 - len(set(label)) and {(label[i] == label[j]) == (found[i] == found[j]) for i in range(60) for j in range(60)} == {True}


def test_partenum_signs_every_similar_pair():
    rng = np.random.default_rng(5)
    for n in (1, 3, 4, 7, 20, 63, 150, 700):
        for _ in range(15):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            out = int(rng.integers(0, len(a) // 7 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 2**63, out, dtype=np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 75 * (len(a) + len(b) - inter):
                (x, ahead_x), (y, ahead_y) = jaccard_join.sign(a), jaccard_join.sign(b)
                _, i, j = np.intersect1d(x, y, return_indices=True)
                assert (~(ahead_x[i] & ahead_y[j])).any()  # in a band that is one's own
                bits = jaccard_join.parities([a, b])
                assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= (len(a) + len(b)) // 7


# --- 4


def library_ids(text):
    """By a tokenizer of its own, as the library reads the file."""
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4")


def check_packed(rows, docs, capacity=1024):
    want = {}
    for d, t in docs:
        ids = np.append(library_ids(t), 0).astype("<u4")
        want.setdefault((d, len(ids)), []).append(ids)
    covered = {k: np.zeros(k[1], int) for k in want}
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert any(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in want[r.doc_id, r.doc_tokens])
        covered[r.doc_id, r.doc_tokens][r.start : r.start + r.length] += 1
    for k, times in covered.items():
        assert (times == len(want[k])).all()  # each id in exactly one piece
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by_seq) * capacity


@pytest.mark.parametrize("windows", [1, 3, 16])
def test_packing_cases(docs, none, windows):
    rows = packing.pack(docs.repartition(3), open_windows=windows).collect()
    check_packed(rows, [(d, t) for d, t, *_ in CASES])
    assert packing.pack(none).count() == 0


def test_packing_pads_little(small):
    rows = packing.pack(small).collect()
    room = check_packed(rows, [(r.doc_id, r.text) for r in small.collect()])
    assert sum(r.length for r in rows) > 0.98 * room


# --- 5

BRUTE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BRUTE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base(spark, docs, none):
    odd = ["x@y.z_w@v.u", "a@b@c.d", "1.2.3.4.5.6.7.8", "300.1.1.1 007.1.2.3", "4111 1111-1111 1111", "4111111111111111" * 3, "+1 (2) 3.4-5678 9", "+12)", "é 日 a@b.cd", "1" * 20000, "a@b" + ".c" * 9000, "x@" * 3000, "1-2 3" * 2000, "255.255.255.255,1.1.1.1", "%+@a.b"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, t) for i, (_, t, *_) in enumerate(CASES)]
    got = {r.doc_id: r for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", personal_data.listed(F.col("base")).alias("b")).collect()}
    for i, t in rows:
        assert got[i].b == ",".join(brute_spans(t)), t
    assert personal_data.find(none).count() == 0 and personal_data.find(docs).count() == len(CASES)


def test_personal_data_contexts_discover(spark):
    rows = [(i, f"please call now +1 (202) 555-{1000 + i} or leave") for i in range(20)] + [(50, "please call now 202-555-1234 or leave"), (51, "the year 202-555-9999 was fine"), (52, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.s for r in personal_data.find(docs).select("doc_id", personal_data.listed(F.col("spans")).alias("s")).collect()}
    assert found[50] == "phone:16:28" and found[51] == "" and found[0] == "phone:16:33"
    clean = {r.doc_id: r.text for r in personal_data.redact(docs).collect()}
    assert clean[50] == "please call now <PHONE> or leave" and clean[51] == rows[21][1] and clean[52] is None and len(clean) == len(rows)


def test_personal_data_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de now", 17, "x", 5), (1, "mail a.b@c.de now", 17, "x", 5), (None, None, None, "y", 6), (2, "", 0, None, 7)], "doc_id long, text string, n_chars int, spans string, _d int")
    got = Counter(tuple(r) for r in personal_data.redact(docs).collect())
    assert got == Counter({(1, "mail <EMAIL> now", 16, "x", 5): 2, (None, None, None, "y", 6): 1, (2, "", 0, None, 7): 1})
    assert personal_data.redact(docs.where("false")).collect() == []


def test_personal_data_many_mentions_in_one_text(spark):
    words = [f"id{i:05d}" if i % 3 else f"u{i}@mail.example" for i in range(3000)]
    text = "  ".join(words)
    row = personal_data.mentions(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    at = [m.start() for m in re.finditer(r"\S+", text)]
    assert [(s.start, s.stop, s.form) for s in row.base] == [(at[i], at[i] + len(w), w) for i, w in enumerate(words) if not i % 3]
    assert [(s.start, s.form) for s in row.other] == [(at[i], w) for i, w in enumerate(words) if i % 3]
    assert [s.context.split() for s in row.other if s.start > at[2]] == [words[i - 2 : i] for i in range(3, 3000) if i % 3]


def test_personal_data_one_word_before_generalizes(spark):
    rows = [(i, f"{w} phone: +1 (202) 555-{1000 + i} or leave") for i, w in enumerate(["my", "her", "the", "office", "new"])]
    rows += [(50, "an unseen phone: 202-555-1234 here"), (51, "an unseen number: 202-555-9999 here"), (52, "PHONE:\n 202-555-1111")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.s for r in personal_data.find(docs).select("doc_id", personal_data.listed(F.col("spans")).alias("s")).collect()}
    assert found[50] == "phone:17:29" and found[51] == "" and found[52] == ""  # two words stand before a place


def test_personal_data_spaced_far_and_chained(spark):
    far = "x" * 90
    rows = [(i, f"please call me +1 (202) 555-{1000 + i} or leave") for i in range(20)] + [(100 + i, f"ring {far} +1 (202) 555-{2000 + i}") for i in range(20)]
    rows += [(50, "please call me 020 7946 0958 or leave"), (51, "please call me 5551234 567 now"), (52, f"ring {far} 202-555-1234"), (53, "the year 020 7946 0999 was fine")]
    # each context is reached only by the instances of the one before it
    rows += [(1000 + i, f"please ask for +1 (303) 555-{1000 + i} so") for i in range(100)]
    for number, (before, own, n) in enumerate([("please ask for", "hop one", 20), ("hop one", "hop two", 4), ("hop two", "hop three", 1)]):
        rows += [(2000 + 100 * number + i, f"{w} {7000000 + 1000 * number + i} so") for i in range(n) for w in (before, own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.text) for r in personal_data.redact(docs).collect()}
    assert {(50, "please call me <PHONE> or leave"), (51, "please call me <PHONE> now"), (52, f"ring {far} <PHONE>"), (53, rows[43][1])} <= found
    assert (2200, "hop two <PHONE> so") in found


def valid_card(n):
    return next(f"{x[:4]} {x[4:8]} {x[8:12]} {x[12:]}" for k in range(10) if luhn(x := f"{n}{n}{n}"[:15] + str(k)))


def brute_graph(found, support=3, confidence=0.8):
    """The spans that contexts and instances add, from the mentions of all documents, by plain loops."""

    def fit(kind, form):
        d = re.sub("[^0-9]", "", form)
        if " " in form:
            m = re.match(personal_data.FITS[kind], form, re.ASCII) if kind in personal_data.FITS else None
            return m[0] if m else ""
        sign = r"""[!-/:-@\[-`{-~]?$"""
        ok = {0: "@" in form, 1: bool(re.match(r"[0-9]+([.:][0-9]+){3}", form)) and len(d) <= 12, 2: len(d) >= 12 and bool(re.match(r"[0-9-]+" + sign, form)), 3: 6 <= len(d) <= 15 and bool(re.match(r"[+(]?[0-9][0-9().-]*" + sign, form))}
        return form if ok[kind] else ""

    edges = {}
    for _, base, other in found:
        for s in [*base, *other]:
            for pattern in [s.context, "~ " + re.search("[^ ]+ ?$", s.context)[0]] if s.context else []:
                key = pattern, s.form.lower()
                edges[key] = max(edges.get(key, -9), s.kind)
    seeds = {(f, k): 1.0 for (_, f), k in edges.items() if k >= 0}
    counted = [(c, f) for (c, f), k in edges.items() if k >= -1]
    known, best = dict(seeds), {}
    for _ in range(50):
        before, best = best, {}
        for c in {c for c, _ in counted}:
            forms = [f for x, f in counted if x == c]
            for k in range(4):
                scores = [known[f, k] for f in forms if (f, k) in known]
                if len(scores) >= support and sum(scores) / len(forms) >= 0.5:
                    for (x, f), kind in edges.items():
                        if x == c and kind < 0 and fit(k, f):
                            best[f, k] = max(best.get((f, k), 0), sum(scores) / len(forms))
        known = seeds | best
        if not best or set(best) == set(before):
            break
    out = Counter()
    for (f, k), score in best.items():
        if score >= confidence and (score, -k) == max((s, -j) for (g, j), s in best.items() if g == f):
            for doc, _, other in found:
                for s in other:
                    if s.form.lower() == f:
                        out[doc, k, s.start, s.start + len(fit(k, s.form))] += 1
    return set(out)


def test_personal_data_graph_matches_brute_force(spark):
    rng, rows = np.random.default_rng(8), []
    places = ["call me at", "my card is", "reach us via", "order number", "the year", "server host"]

    def thing(kind):
        n = rng.integers(10**6, 10**7)
        return {0: f"u{n}@x.example", 1: f"10.{n % 200}.{n % 90}.{n % 70}", 2: valid_card(n), 3: f"+1 202 {n}", 4: f"{n}", 5: f"{n // 1000}-{n % 1000:03d}-{n % 10000:04d}", 6: f"{n}{n}"[:13], 7: f"joe{n}@host"}[kind]

    main, odd = [3, 2, 0, 4, 4, 1], [[4, 5], [6, 5], [7, 7], [3, 5], [7, 6], [1, 4]]
    pool = [thing(k) for k in range(8) for _ in range(12)]
    for i in range(220):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            p = int(rng.integers(0, 6))
            x = rng.random()
            parts.append(f"{places[p]} {thing(main[p]) if x < 0.85 else thing(odd[p][int(x * 100) % 2]) if x < 0.98 else pool[int(rng.integers(0, len(pool)))]} ok")
        rows.append((i, "so ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.base, r.other) for r in personal_data.mentions(docs).collect()]
    got = set()
    for r in personal_data.discover(personal_data.materialize(personal_data.mentions(docs), "mentions")).collect():
        got |= {(r.doc_id, s.kind, s.start, s.stop) for s in r.more}
    want = brute_graph(found)
    inner = {a for a in want for b in want if a[0] == b[0] and b[2] <= a[2] and a[3] <= b[3] and b[3] - b[2] > a[3] - a[2]}
    assert got == want - inner and len(got) > 5


# --- 6


@pytest.mark.parametrize("n", [1, 5000, 200_000])  # the last in several parts of a plane
def test_wavelet_queries(n):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, max(3000, n // 4), n).astype(np.uint32)
    w = wavelet.Wavelet(wavelet.build(ids, np.array([n // 3, n - n // 3])))
    assert (w.decode() == ids).all() and w.ends.tolist() == [n // 3, n]
    for i in {0, 1, 511, 512, 513, 4095, 4096, 65535, 65536, n - 2, n - 1}:
        if 0 <= i < n:
            assert w.access(i) == ids[i]
    a, b = n // 50, n - n // 5
    for token in (int(ids[0]), int(ids[n // 2]), 2999, 1 << 20):
        places = np.flatnonzero(ids == token)
        assert w.count(token) == len(places) and w.count(token, a, b) == ((places >= a) & (places < b)).sum()
        assert [w.find(token, k) for k in range(len(places))] == places.tolist() and w.find(token, len(places)) == -1


def test_wavelet_reads_parts_only():
    ids = np.random.default_rng(2).integers(0, 50_000, 1 << 18).astype(np.uint32)
    w = wavelet.Wavelet(wavelet.build(ids, np.array([len(ids)])))
    assert w.access(100_000) == ids[100_000] and len(w._kept) <= 2 * w.bits < sum(len(p) - 1 for p in w.places)


def test_wavelet_cases(docs, none):
    rows = wavelet.read_documents(wavelet.write_shards(docs, shard_tokens=50)).collect()
    at, want = 0, []
    for d, t, *_ in sorted(CASES, key=lambda r: key((r[0] if r[0] is not None else -1, r[1] or ""))):
        ids = library_ids(t).tobytes() + (2).to_bytes(4, "little")
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(tuple(r) for r in rows if r.doc_id is not None) == sorted(x for x in want if x[0] is not None)
    assert [tuple(r) for r in rows if r.doc_id is None] == [x for x in want if x[0] is None]
    assert wavelet.read_documents(wavelet.write_shards(none)).count() == 0


def test_tokens_are_the_librarys(small):
    model = encoder()
    texts = [r.text for r in small.collect()] + TEXTS + ["a  b", " x ", "\n a\xa0 b", "it's 'll <|endoftext|> a,. b,", "a<|endoftext|>b", "<|endoftext|>", "́a b́", "", " ", "le. le, Le.\nAn le.\nAn,. é.\nÉ x" * 3]
    for _ in range(2):  # the second time from what it remembers
        for t in texts:
            assert (np.frombuffer(model.encode(t), "<u4") == library_ids(t)).all()
    model.known, model.older, most = {}, {}, tokens.MOST_PIECES
    try:
        tokens.MOST_PIECES = 20  # forgets all the time
        for t in texts:
            assert (np.frombuffer(model.encode(t), "<u4") == library_ids(t)).all()
    finally:
        tokens.MOST_PIECES = most


# --- 7


def test_quality_policies_and_ablations(spark, docs, none):
    led = quality_rules.ledger(docs)
    rows = {r.doc_id: r for r in quality_rules.apply_policy(led, "v3").collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and rows[4].kept and rows[8].n_repeat_words == 300 and rows[8].base_failed
    abl = {(r.version, r.rule): r for r in quality_rules.ablations(led).collect()}
    bits = [r.failures for r in led.collect()]
    for (version, rule), r in abl.items():
        mask, bit = quality_rules.POLICIES[version], quality_rules.BITS[rule]
        assert r.rejected == sum(bool(b & bit) for b in bits) and r.only_this_rule == sum((b & mask) == bit for b in bits) and r.kept == sum(not b & mask for b in bits)
    assert quality_rules.ledger(none).count() == 0


# --- 8


def test_hypergeometric_follows_its_distribution(spark):
    n = 20000
    rows = spark.range(n).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(12).cast("long"), F.lit(10).cast("long"), mixing.uniform(F.lit(3), F.col("id"))).alias("x"))
    got = Counter(r.x for r in rows.collect())
    for k in range(11):
        p = math.comb(12, k) * math.comb(18, 10 - k) / math.comb(30, 10)
        assert abs(got[k] / n - p) < 5 * math.sqrt(p / n) + 1e-3


def test_splitting_tree_keeps_quotas(spark):
    q = spark.createDataFrame([("a", 100), ("b", 7), (None, 33)], "source string, quota long")
    ends = {r.source: r.ends for r in mixing.splitting_tree(q, 8).collect()}
    assert {k: v[-1] for k, v in ends.items()} == {"a": 100, "b": 7, None: 33}
    sizes = [sum(v[i] - (v[i - 1] if i else 0) for v in ends.values()) for i in range(8)]
    assert sum(sizes) == 140 and max(sizes) - min(sizes) <= 3


def fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = {s: rest * w[s] / sum(w[x] for x in names if x not in capped) for s in names if s not in capped}
        over = [s for s, t in free.items() if t > 2 * sizes[s]]
        if not over:
            return capped | free
        capped |= {s: 2 * sizes[s] for s in over}


@pytest.mark.parametrize("blocks", [4, 1024])
def test_mixing(spark, small, blocks):
    docs = small.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 17 == 1, None).otherwise(F.col("source")))
    rows = mixing.mix(docs, blocks=blocks).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and len(r.shards) == (-(-r.taken // r.size) if r.size else 0)
    want = fill(sizes)
    for r in rows:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(docs, blocks=blocks).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_cases(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(CASES) and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0, 0.0)] * 2


def test_mixing_gives_equal_rows_the_same_in_reruns(spark):
    rows = [(None, "the same words here", "a", i) for i in range(60)] + [(None, f"other words {i % 7}", "a", 100 + i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    runs = []
    for n in (2, 5):
        dealt = docs.repartition(n, "row")
        mixed = mixing.materialize(mixing.mix(dealt.select("doc_id", "text", "source"), blocks=16), "mixed")
        runs.append(Counter((r.row, r.taken) for r in mixing.with_rows(dealt, mixed.select("doc_id", "source", "th", "taken")).collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 100 and len({t for _, t in runs[0]}) > 1


def test_mixing_writes_and_copies_row_by_row(spark, tmp_path):
    rows = [(i, f"w{i} " * (3 + i % 5), "ab"[i % 2], 0, "x") for i in range(40)]
    rows += [(7, rows[7][1], "b", 1, "again"), (7, rows[7][1], "b", 2, "again"), (7, "another text of the id", "b", 3, "y"), (7, rows[7][1], "a", 4, "other source")]
    rows += [(None, "no id here", None, 5, "n")] * 3 + [(None, "no id there", "a", 6, "n"), (99, None, "a", 7, "null"), (98, "", "b", 8, "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _times int, shard string")
    mixed = mixing.materialize(mixing.mix(docs.select("doc_id", "text", "source"), shards=4, blocks=8), "mixed")
    mine, theirs = mixing.with_rows(docs, mixed.select("doc_id", "source", "th", "taken")).collect(), mixed.collect()
    assert Counter((r.doc_id, r.source, r.taken) for r in mine) == Counter((r.doc_id, r.source, r.taken) for r in theirs) and len(mine) == len(rows)
    assert Counter((r.doc_id, r.text, r.source, r._times, r.shard) for r in mine) == Counter(rows)
    times = Counter((r.doc_id, r.source) for r in mixing.copies_of(docs, mixed).collect())
    want = Counter()
    for r in theirs:
        want[r.doc_id, r.source] += int(r.taken / r.size + 0.5) if r.size else 0
    assert times == +want
    mixing.write_shards(docs, mixed, str(tmp_path / "s"), 4)
    back = spark.read.schema("doc_id long, text string, source string, _times int, shard string, _shard int").parquet(str(tmp_path / "s")).collect()
    assert Counter((r._shard, r.doc_id, r.source) for r in back) == Counter((k, r.doc_id, r.source) for r in theirs for k in r.shards)
    assert {(r.doc_id, r.text, r.source, r._times, r.shard) for r in back} <= set(rows) and len(back) == sum(len(r.shards) for r in theirs)


# --- 9


def test_language_model(spark, small):
    counted = recurrent_lm.count_words(small)
    lex = recurrent_lm.lexicon(counted, listed=500, frequent=200, n_classes=10)
    weights = recurrent_lm.train(small, lex)
    rows = {r.doc_id: r for r in recurrent_lm.score(small, counted, lex, weights).collect()}
    texts = {r.doc_id: recurrent_lm.tokens((r.text or "").encode()) for r in small.collect()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 10 == 0}
    c = Counter(w for d, t in texts.items() if d not in held for w in t)
    n, v = sum(c.values()), len(c)
    for d, t in texts.items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (d in held, len(t), n, sum(c[w] > 0 for w in t))
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    assert sum(rows[d].score for d in held) > sum(rows[d].base_score for d in held)
    net, read = recurrent_lm.Network(lex, weights=weights), recurrent_lm.Reader(lex)
    for d in sorted(texts)[:60]:  # frequent, listed and unlisted words
        symbols = read(texts[d])[2]
        want = float(recurrent_lm.run(net, [symbols])[0]) / math.log(10)
        want += sum(math.log10((c[w] + 0.1) / lex.mass[recurrent_lm.spelling(w)]) for w, i in zip(texts[d], symbols, strict=True) if i >= lex.frequent)
        assert math.isclose(rows[d].score, want, rel_tol=1e-4)


def test_language_model_is_a_distribution(spark, small):
    counted = recurrent_lm.count_words(small)
    lex = recurrent_lm.lexicon(counted, listed=500, frequent=50, n_classes=5)
    net, n = recurrent_lm.Network(lex), 50 + recurrent_lm.N_SPELLINGS
    s = np.random.default_rng(0).normal(0, 0.5, (net.hidden + 1, n)).astype(np.float32)
    s[:], s[-1] = s[:, :1], 1
    p = np.exp(net.outputs(s, np.arange(n))[0])
    assert math.isclose(float(p.sum()), 1, rel_tol=1e-4)
    total = float(p[:50].sum())  # each word in its symbol, and an unseen one in each spelling
    for r in counted.collect():
        if lex.places.get(r.h, 50) >= 50:
            total += float(p[50 + r.s]) * (r.c + 0.1) / lex.mass[r.s]
    assert math.isclose(total + float((p[50:] * 0.1 / lex.mass).sum()), 1, rel_tol=1e-4)


def test_language_model_gradient(spark, small):
    lex = recurrent_lm.lexicon(recurrent_lm.count_words(small), listed=100, frequent=12, n_classes=3)
    rng = np.random.default_rng(2)
    net = recurrent_lm.Network(lex, hidden=4)
    net.all[:] = rng.normal(0, 0.3, net.all.shape)
    k = len(lex.classes)
    inputs, target, fresh = rng.integers(0, k + 1, (5, 3)), rng.integers(0, k, 15), rng.random((5, 3)) < 0.2

    def loss() -> float:
        states, _ = net.forward(inputs, fresh, np.zeros((4, 3), np.float32))
        return -float(net.outputs(states.reshape(5, -1), target)[0].astype(np.float64).mean())

    states, kept = net.forward(inputs, fresh, np.zeros((4, 3), np.float32))
    _, ds = net.outputs(states.reshape(5, -1), target, learn=True)
    net.backward(inputs, fresh, kept, ds.reshape(4, 5, 3))
    got = net.grad.copy()
    for k in rng.permutation(len(net.all))[:60]:
        was = net.all[k]
        net.all[k] = was + 0.01
        up = loss()
        net.all[k] = was - 0.01
        down = loss()
        net.all[k] = was
        assert abs((up - down) / 0.02 - got[k]) < 2e-3


def test_windows_carry_whole_texts(spark, small):
    lex = recurrent_lm.lexicon(recurrent_lm.count_words(small), listed=100, frequent=12, n_classes=3)
    net = recurrent_lm.Network(lex)
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 13, n).astype(np.int32) for n in (1, 40, 7, 100, 16, 17)]
    together, alone = recurrent_lm.run(net, texts), [recurrent_lm.run(net, [t])[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-4)


def test_language_model_cases(docs, none):
    counted = recurrent_lm.count_words(docs)
    lex = recurrent_lm.lexicon(counted)
    rows = recurrent_lm.score(docs, counted, lex, recurrent_lm.train(docs, lex)).collect()
    assert len(rows) == len(CASES) and all(math.isfinite(r.score) for r in rows)
    counted = recurrent_lm.count_words(none)
    lex = recurrent_lm.lexicon(counted)
    assert recurrent_lm.score(none, counted, lex, recurrent_lm.train(none, lex)).count() == 0
    assert all(math.isfinite(r.score) for r in recurrent_lm.score(docs, counted, lex, recurrent_lm.train(none, lex)).collect())


ODD = [None, "", " \t\r\n", " A b\x0bB  a ", "\u0130 A\u00a0a\x1c b\x00 \u00c9", LONG, "b"]


def test_language_model_splits_texts_by_part(monkeypatch):
    words, codes, sizes = recurrent_lm.distinct_tokens(pa.array(ODD))
    want = [recurrent_lm.tokens((t or "").encode()) for t in ODD]
    assert sizes.tolist() == [len(w) for w in want] and [words[c] for c in codes] == [w for t in want for w in t]
    words, codes, _ = recurrent_lm.distinct_tokens(pa.array(["a b a"] * 1000))
    assert sorted(words) == [b" ", b"a", b"b"] and len(codes) == 4000  # a word is looked up once in a part, not once a token
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + len(ODD))), pa.array(ODD)], ["doc_id", "text"]) for k in (0, 100)]
    for most in (1, 20, 10**9):
        monkeypatch.setattr(recurrent_lm, "PART_BYTES", most)
        found = list(recurrent_lm.parts(iter(batches)))
        assert [x for ids, _ in found for x in ids] == [*range(len(ODD)), *range(100, 100 + len(ODD))] and [t for _, x in found for t in x.to_pylist()] == ODD * 2
        assert all(sum(len((t or "").encode()) for t in x.to_pylist()[:-1]) < most for _, x in found)
    assert len(found) == 1


def test_language_model_reads_texts_once_for_training_and_scoring(small):
    counted = recurrent_lm.count_words(small)
    lex = recurrent_lm.lexicon(counted, listed=500, frequent=200, n_classes=10)
    encoded, bare = recurrent_lm.encode(small, lex), small.select("doc_id")  # texts are out of reach from here
    weights = recurrent_lm.train(bare, lex, encoded=encoded)
    rows = {r.doc_id: r for r in recurrent_lm.score(bare, counted, lex, weights, encoded=encoded).collect()}
    plain = {r.doc_id: r for r in recurrent_lm.score(small, counted, lex, weights).collect()}
    assert rows.keys() == plain.keys() and all(math.isclose(a, b, rel_tol=1e-5) for d in rows for a, b in zip(rows[d], plain[d], strict=True))
    read = recurrent_lm.Reader(lex)
    coded = {r.doc_id: np.frombuffer(r.symbols, "<u2").tolist() for r in encoded.select("doc_id", "symbols").collect()}
    assert all(coded[r.doc_id] == read(recurrent_lm.tokens((r.text or "").encode()))[2].tolist() for r in small.collect())


def test_language_model_groups_of_softmaxes(spark, small, monkeypatch):
    lex = recurrent_lm.lexicon(recurrent_lm.count_words(small), listed=300, frequent=100, n_classes=9)
    rng, found = np.random.default_rng(6), []
    s, target = rng.normal(0, 0.4, (recurrent_lm.HIDDEN + 1, 700)).astype(np.float32), rng.integers(0, len(lex.classes), 700)
    s[-1] = 1
    for most in (1, 900, 10**9):
        monkeypatch.setattr(recurrent_lm, "LOGITS", most)
        net = recurrent_lm.Network(lex)
        net.all += rng.normal(0, 0.3, net.all.shape).astype(np.float32) if not found else found[0][0] - net.all
        found.append((net.all.copy(), *net.outputs(s, target, learn=True), net.grad.copy()))
    assert all(np.allclose(x, y, rtol=1e-3, atol=1e-5) for f in found[1:] for x, y in zip(f, found[0], strict=True))


# --- 10


def test_media_cases(spark, docs, none):
    rows = media_chunks.read_back(media_chunks.store(docs.repartition(3))).collect()
    assert len(rows) == len(CASES)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d, t, *_ in CASES:
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = by[d][0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    a, b = by[4][0], by[5][0]
    assert a[1:] == b[1:] and by[3][0] == by[3][1]
    assert media_chunks.read_back(media_chunks.store(none)).count() == 0


def test_chunks_are_cut_by_content():
    rng = np.random.default_rng(8)
    body = rng.integers(0, 256, 100_000, dtype=np.uint8).tobytes()
    cut = lambda x: {x[a:b] for a, b in zip([0, *media_chunks.cuts(x)], media_chunks.cuts(x))}  # noqa: E731, B905
    assert b"".join(body[a:b] for a, b in zip([0, *media_chunks.cuts(body)], media_chunks.cuts(body), strict=False)) == body
    moved = cut(b"new head " * 7 + body)
    assert len(cut(body) & moved) > 0.9 * len(cut(body))
    assert all(len(c) <= media_chunks.MOST for c in moved)


# --- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        if name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == {c for _, _, c in brute_components(rows)}
        if name == "personal data":
            assert not any(brute_spans(r.text) for r in docs.collect()) and docs.count() == before.count()
        if name == "mixing":
            mixed = {(r.doc_id, r.source): r for r in mixing.mix(before).collect()}
            times = Counter((r.doc_id, r.source) for r in docs.collect())
            assert all(times[k] == int(r.taken / r.size + 0.5) for k, r in mixed.items() if r.size) and set(times) <= set(mixed)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    check_packed(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_cases(spark, docs, none, sf, tmp_path):
    """Null and empty texts, equal rows, a null id, extra columns with clashing names; and tables without rows."""
    import corpus_pipeline

    for name, rows in (("cases", docs.unionByName(docs.where("doc_id = 4"))), ("none", none)):
        at = tmp_path / name
        rows.write.parquet(str(at / "documents.parquet"))
        spark.read.parquet(f"{sf}/labels.parquet").where("false").write.parquet(str(at / "labels.parquet"))
        now = spark.read.parquet(str(at / "documents.parquet"))
        for stage, f in corpus_pipeline.STAGES:
            out = str(at / stage.replace(" ", "-"))
            f(spark, now, str(at)).write.parquet(out)
            now = spark.read.parquet(out)
            if stage != "packing":
                assert now.columns == docs.columns
            if stage == "near duplicates" and name == "cases":
                got = Counter((r.doc_id, r.text) for r in now.collect())
                kept = {c for _, _, c in brute_components([(d, t) for d, t, *_ in CASES])}
                assert set(got.values()) == {1} and {d for d, _ in got} == kept and 5 not in kept
        assert (now.count() > 0) == (name == "cases")


def test_preference_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = sorted(con.sql(preference_format.OP2_SQL).fetchall())
    cols = ["pair_id", "part", "turn", "role", "rendered", "loss_mask"]
    assert sorted(tuple(r) for r in preference_format.op2_preference_format(spark, sf).select(*cols).collect()) == want


def test_quality_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    found = quality_rules.op7_quality_rules(spark, sf)
    want = con.sql(f"select {', '.join(found.columns)} from ({quality_rules.OP7_SQL})").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
