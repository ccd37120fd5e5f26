"""Operators 11 to 13 against SQL over the given tables and brute force over the hard cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from faultline.llm import decontamination, merkle, prefix_trie, registry

DOCS = "doc_id long, text string, lang string, source string, n_chars int, place long, tree string, leaf string"  # the last three clash with inner names
LONG = " ".join(f"word{i % 977} and,{i % 13}." for i in range(6000))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_benchmark_decontamination", "op13_prefix_trie"])
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = registry.QUERIES[name](spark, sf)
    want = con.sql(f"select {', '.join(found.columns)} from ({registry.ORACLES[name]})").fetchall()
    assert Counter(tuple(r) for r in found.collect()) == Counter(want)


# --- 11


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof of each row (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(leaves):
        sibs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
        while len(level) > 1:
            for i, a in enumerate(at):
                sibs[i] += [level[k] for k in range(a - a % 8, min(len(level), a - a % 8 + 8)) if k != a]
            level, at = [sha(*level[k : k + 8]) for k in range(0, len(level), 8)], [a // 8 for a in at]
        return level[0], sibs

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0], sha(*map(field, r))))
    out, tops = [], []
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(by[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        top, sibs = tree([x for _, x in leaves])
        tops.append(top)
        out += [(d, leaf, len(tops) - 1, s) for (d, leaf), s in zip(leaves, sibs, strict=True)]
    if not tops:
        return []
    root, upper = tree(tops)
    return [(d, leaf, tops[t], root, sha(*s, *upper[t])) for d, leaf, t, s in out]


CASES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (None, "A null id", "en", "a", 9), (3, "One two", "en", "b", 7), (3, "One two", "en", "b", 7), (3, "another", "en", "b", 7),
    (4, LONG, "en", "a", len(LONG)), (-6, "É, 日本 A b", "", "ß", 3), (9, "x", "zh", "c", 0), (12, "x", "ü", "c", 0), (15, "x:1", "de", "c", 0),
]


@pytest.mark.parametrize("extra", [[], [(1, 7)], [(1, 8)], [(1, 9), (2, 64)], [(1, 65), (2, 1), (3, 73), *[(k, 1) for k in range(4, 12)]]])
def test_manifest_is_the_brute_force_one(spark, extra):
    rows = CASES if not extra else [(100 * g + i, f"Text {i}", f"l{g}", None, i) for g, n in extra for i in range(n)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS).repartition(3)
    proofs = merkle.prove(merkle.leaves_of(docs, F.upper("text")))
    shown = proofs.select("doc_id", merkle.hex_of(F.col("leaf")), merkle.hex_of(F.col("subroot")), merkle.hex_of(F.col("root")), merkle.proof_digest(F.col("seg")), merkle.folded(F.col("leaf"), F.col("seg")), merkle.folded(F.col("claim"), F.col("seg")))
    got = [tuple(r) for r in shown.collect()]
    want = brute_manifest([(d, s, lang, n, t) for d, t, lang, s, n in rows])
    assert Counter(r[:5] for r in got) == Counter(want)
    assert all(r[5] == r[3] and (r[6] is None or r[6] != r[3]) for r in got)
    if extra:  # all of these texts have lower case, so each claim fails
        assert all(r[6] for r in got)


def test_manifest_of_one_row_and_of_none(spark, monkeypatch):
    one = spark.createDataFrame([(5, "a", "en", "s", 1, 0, "", "")], DOCS)
    (r,) = merkle.prove(merkle.leaves_of(one)).collect()
    assert r.leaf == r.subroot == r.root and r.seg == []
    assert merkle.prove(merkle.leaves_of(one.where("false"))).count() == 0
    monkeypatch.setattr(merkle, "FEW", 0)  # without broadcasts
    rows = [(i, f"t{i}", "en", None, i, 0, "", "") for i in range(600)]
    proofs = merkle.prove(merkle.leaves_of(spark.createDataFrame(rows, DOCS))).select("doc_id", merkle.hex_of(F.col("leaf")), merkle.hex_of(F.col("subroot")), merkle.hex_of(F.col("root")), merkle.proof_digest(F.col("seg")))
    assert Counter(tuple(r) for r in proofs.collect()) == Counter(brute_manifest([(i, None, "en", n, t) for i, t, _, _, n, *_ in rows]))


# --- 12


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_leaks(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for k in range(1, 11):
                if i + k <= len(w) and (names := windows.get(tuple(w[i : i + k]))):
                    hit |= set(range(i, i + k))
                    found |= names
        out.append((d, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None)), tuple(sorted(hit))))
    return out


ITEMS = [
    (1, "Is the Quick, brown fox; that jumps over a lazy dog called Rex?"), (10, "yes; no!"), (2, "alpha"), (3, None), (4, "... ---"), (5, "ÉTÉ 日本 été"),
    (6, "fox that jumps over a lazy dog called rex and more words"), (2, "alpha"), (None, "secret word"), (7, "a a a a a a a a a a a a"), (8, "no"),
]
TEXTS = [
    (1, None), (2, ""), (None, "yes no"), (3, "the quick BROWN fox that jumps over a lazy DOG called rex and more"), (3, "the quick BROWN fox that jumps over a lazy DOG called rex and more"), (3, "Alpha, beta."), (4, LONG + " is the quick brown fox that jumps over a lazy " + LONG),
    (5, "été 日本 été ÉTÉ 日本 été"), (6, " ".join(["a"] * 40)), (7, "yes! no. alpha... yes no no"), (8, "secret\nword secret word"), (9, "nothing here"),
]


@pytest.mark.parametrize("most", [None, 12])
def test_leaks_are_those_of_brute_force(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(decontamination, "GROUP_WORDS", most)
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in TEXTS], "doc_id long, text string, th long, hits string")
    bench = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, words string")
    assert most is None or len(list(decontamination.groups_of(decontamination.items_of(bench)))) > 2
    found = decontamination.scan(docs, bench)
    got = [(r.doc_id, r.n_words, r.n, tuple(r["items"]), tuple(x for b, e in zip(r.hits[::2], r.hits[1::2], strict=True) for x in range(b, e))) for r in found.withColumn("n", decontamination.n_hit(F.col("hits"))).collect()]
    assert Counter(got) == Counter(brute_leaks(TEXTS, ITEMS))
    shown = decontamination.spans(docs, found)
    assert shown.columns == [*docs.columns, "spans"]
    spans = [(r.doc_id, r.text, [r.text[s.begin : s.end] for s in r.spans]) for r in shown.collect()]
    assert Counter(d for d, *_ in spans) == Counter(r[0] for r in got if r[2])
    cut = {t: s for _, t, s in spans}
    assert cut["Alpha, beta."] == ["Alpha"] and cut["secret\nword secret word"] == ["secret\nword secret word"]
    assert cut["été 日本 été ÉTÉ 日本 été"] == [] or "日本" in cut["été 日本 été ÉTÉ 日本 été"][0]
    assert [s.startswith("is the quick") and s.endswith("over a lazy") for s in cut[TEXTS[6][1]] if "quick" in s] == [True]


def test_leaks_of_questions_and_answers_and_of_nothing(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "beta gamma", "alpha"), (2, None, "nothing")], "item_id long, question string, answer string")
    hit = {r.doc_id: r["items"] for r in decontamination.scan(docs, bench, ("question", "answer")).where("size(hits) > 0").collect()}
    assert hit == {3: ["1"], 7: ["1"], 9: ["2"]}
    assert decontamination.scan(docs, bench.where("false"), ("question",)).where("size(hits) > 0").count() == 0
    assert decontamination.scan(docs.where("false"), bench, ("question",)).count() == 0


# --- 13


def brute_trie(conversations, head=lambda c: zlib.crc32(str(c).encode()) % 6, base=lambda c: c - (abs(c) % 100) * (1 if c > 0 else -1)):
    own = defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {c: tuple([*own.get(base(c), [])[: head(c)], *t[head(c) :]]) for c, t in own.items()}
    members = defaultdict(list)
    for c, t in sorted(built.items()):
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    own_saving = {k: (len(m) - 1) * (len(k[-1][1]) if k else 0) for k, m in members.items()}
    leaves, saved = Counter(), Counter()
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += own_saving[k]
    ends = lambda k: hashlib.sha256(",".join(str(c) for c in members[k] if built[c] == k).encode()).hexdigest()
    return [(m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], ends(k)) for k, m in members.items()]


def trie_rows(spark, rows):
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, i long, name string").repartition(3)
    return Counter(tuple(r) for r in prefix_trie.trie(*prefix_trie.shared_heads(prefix_trie.turns_of(table), head, F.col("conv_id") - F.col("conv_id") % 100, 5)).collect())


def test_trie_cases(spark):
    rows = [(100, k, "user", f"turn {k}") for k in range(7)] + [(c, k, None if k == 2 else "user", None if c % 3 == 0 and k == 1 else f"turn {k % 4}") for c in (101, 102, 103, 107, 150, 199, 205, 206) for k in range(c % 7)]
    rows += [(300, None, "a", "null turn"), (300, 0, "a", "é日"), (300, 0, "b", "tie"), (300, 0, "b", "tie"), (-5, 0, "x", "y"), (None, 0, "no", "id"), (106, 0, "", ""), (0, 0, "", "zero")]
    assert trie_rows(spark, rows) == Counter(brute_trie(rows))
    assert trie_rows(spark, [r for r in rows if r[0] is None]) == Counter()
    lone = [(206, 0, "a", "b")]  # its head is cut and there is nothing to take in its place
    assert trie_rows(spark, lone) == Counter(brute_trie(lone)) and zlib.crc32(b"206") % 6 > 0


def test_trie_of_a_deep_conversation_and_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)  # ids of a node come in many pieces
    rows = [(1, k, "u", f"t{k % 2}") for k in range(100)] + [(2, k, "u", f"t{k % 2}") for k in range(67)] + [(c, k, "u", "same") for c in range(1000, 1060) for k in range(3)]
    assert trie_rows(spark, rows) == Counter(brute_trie(rows))
