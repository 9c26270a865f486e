"""Problems 3, 5 and 6 against brute force on small fixtures."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sangam.functions.words import py_words
from sangam.llm import formatting_duplicates as FD
from sangam.llm import lookalikes as LA
from sangam.llm import near_duplicates as ND


def table(spark, rows, **extra):
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(3)
    for n in ("key", "w", "c1", "form", "f", "first_row_id", "low"):  # names that the operators use inside
        df = df.withColumn(n, F.lit("clash"))
    return df


def corpus(seed, n=150, vocabulary=400, hot=8, long=False):
    r = random.Random(seed)
    words, common = [f"w{i}" for i in range(vocabulary)], [f"common{i}" for i in range(hot)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = py_words(r.choice(out)[1])[:]
            for _ in range(r.randint(0, 5)):
                k, what = r.randrange(len(w)), r.random()
                w[k : k + 1] = [] if what < 0.3 else [r.choice(words)] if what < 0.6 else [w[k], r.choice(words)]
            if r.random() < 0.2:
                r.shuffle(w)
            text = " ".join(w)
            text = r.choice([text, text.upper(), text.replace(" ", ", "), " " + text + "!\n"])
        else:
            size = r.randint(60, 160) if long else r.randint(8, 40)
            text = " ".join(common[: hot // 2] + [r.choice(words if r.random() < 0.7 else common) for _ in range(size)])
        out.append((i, text or "x"))
    return out


def fields(t):
    p = [x for x in re.split(r"[;\r\n]+", t) if x.strip()]
    if len(p) < 2 or not re.search(r"[;\r\n]", t) or not all(re.fullmatch(r"\s*[^:;\r\n]+:\s*\S[^;\r\n]*", x) for x in p):
        return None
    return " ".join(sorted(" ".join(py_words(x)) for x in p))


def p6_key(t):
    return fields(t) or " ".join(py_words(t))


def brute_pairs(rows):
    sets = [(i, frozenset(py_words(t)), p6_key(t)) for i, t in rows if i is not None and t]
    sets = [x for x in sets if len(x[1]) >= 12]
    return {(min(a, b), max(a, b)) for (a, x, k), (b, y, m) in combinations(sets, 2) if 4 * len(x & y) >= 3 * len(x | y) and k != m}


@pytest.mark.parametrize("seed, kw", [(1, {}), (2, {"vocabulary": 40}), (3, {"long": True, "n": 80}), (4, {"vocabulary": 25, "hot": 20})])
def test_near_duplicates(spark, seed, kw):
    rows = corpus(seed, **kw)
    got = [tuple(r) for r in ND.similar_rows(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


def test_blocks_of_hot_shards_lose_nothing(spark):
    rows = corpus(5, n=200, vocabulary=30, hot=25)
    base = ND.base_rows(table(spark, rows), "row_id", "text")
    small = {tuple(sorted(r)) for r in ND.candidates(base, 4, limit=6).collect()}
    plain = {tuple(sorted(r)) for r in ND.candidates(base, 4).collect()}
    sets = {r.c1: set(r.w) for r in base.collect()}
    want = {tuple(sorted((a, b))) for a, b in combinations(sets, 2) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert want and want <= small and want <= plain


def test_near_duplicates_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    base = " ".join(f"v{i}" for i in range(12))
    rows = [(1, None), (2, ""), (3, "short text"), (4, long), (5, long + " more"), (None, base), (6, base), (6, base), (7, base + " extra"), (8, base.upper())]
    assert {tuple(r) for r in ND.similar_rows(table(spark, rows)).collect()} == {(4, 5), (6, 7), (7, 8)}
    assert ND.similar_rows(table(spark, rows).limit(0)).count() == 0
    got = {r.row_id: (r.class_id, r.group_id, r.n_links, r.n_partners) for r in ND.links(table(spark, rows)).collect()}
    assert got == {4: (4, 4, 1, 1), 5: (5, 4, 1, 1), 6: (6, 6, 1, 1), 8: (8, 6, 1, 1), 7: (7, 6, 2, 2)}


def test_lists_and_plain_texts_of_one_record_are_no_near_duplicates(spark):
    f = [f"name{i}: word{i} more{i}" for i in range(8)]
    plain = " ".join(x.replace(":", "") for x in f)
    rows = [(1, plain), (2, "; ".join(reversed(f))), (3, "; ".join(f[3:] + f[:3])), (4, plain + " end"), (5, ";".join(f))]
    assert {tuple(r) for r in ND.similar_rows(table(spark, rows)).collect()} == brute_pairs(rows) - {(1, 2), (1, 3)} | {(1, 4)}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_add_up_to_the_pairs(spark, seed):
    rows = corpus(seed, n=100, vocabulary=40 * seed)
    rows += [(1000 + i, t) for i, t in rows[:30]]
    pairs = brute_pairs(rows)
    got = {r.row_id: r for r in ND.links(table(spark, rows)).collect()}
    partners = defaultdict(set)
    for a, b in pairs:
        partners[a].add(b)
        partners[b].add(a)
    assert {i: r.n_partners for i, r in got.items()} == {i: len(partners[i]) for i in got} and set(partners) <= set(got)
    group = {i: r.group_id for i, r in got.items()}
    top = {i: i for i in got}
    find = lambda x: x if top[x] == x else find(top[x])
    for a, b in pairs | {(min(i, r.class_id), max(i, r.class_id)) for i, r in got.items()}:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    assert group == {i: find(i) for i in got}


def test_forest_finds_what_a_scan_finds():
    r = np.random.default_rng(0)
    shard = r.integers(0, 5, 400)
    sketch = r.integers(0, 1 << 62, 400).astype(np.uint64)
    near = sketch[r.integers(0, 400, 300)] ^ (np.uint64(1) << r.integers(0, 60, 300).astype(np.uint64))
    where, radius = r.integers(0, 5, 300), r.integers(0, 12, 300)
    q, m = ND.Forest(shard, sketch).search(where, near, radius)
    d = np.bitwise_count(near[:, None] ^ sketch[None])
    want = set(zip(*np.nonzero((d <= radius[:, None]) & (where[:, None] == shard[None]))))
    assert set(zip(q, m)) == want


def test_formatting_duplicates(spark):
    rows = corpus(9, n=120, vocabulary=60) + [(1000 + i, t) for i, t in enumerate(["a: x; b: y", "B: Y;\nA: X", "b y a x", "a x b y", "!!!", None, "", "a: x; b: z", "42", "42."])] + [(None, "a: x; b: y")]
    got = {r.row_id: r.first_row_id for r in FD.copies(table(spark, rows)).collect()}
    key = {i: p6_key(t) for i, t in rows if i is not None and t and re.search(r"[^\W_]", t)}
    lists = {" ".join(py_words(t)): fields(t) for _, t in rows if t and fields(t)}
    key = {i: lists.get(k, k) for i, k in key.items()}
    first = defaultdict(list)
    for i, k in key.items():
        first[k].append(i)
    assert got == {i: min(first[k]) for i, k in key.items()}
    assert {(r.first_row_id, r.copies) for r in FD.collapse(table(spark, rows)).collect()} == {(min(v), len(v)) for v in first.values()}
    assert FD.copies(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, FD.ALIASES])
def test_orders_of_lists_by_broadcast_and_by_join(spark, monkeypatch, most):
    monkeypatch.setattr(FD, "ALIASES", most)
    rows = [(2, "b: y; a: x"), (2, "a: x; b: y"), (2, "other text"), (3, "b y a x"), (4, "B Y, A X"), (5, "b y x a")]
    got = sorted(tuple(r) for r in FD.copies(spark.createDataFrame(rows, "row_id long, text string")).collect())
    assert got == [(2, 2), (2, 2), (2, 2), (3, 2), (4, 2), (5, 5)]


def test_a_third_of_all_rows_in_one_group_spans_partitions(spark):
    rows = [(i, "Same  text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = FD.collapse(table(spark, rows).select("row_id", "text"))
    assert got.where("copies > 1").collect() == [(0, 1000)]
    assert got.count() == 2001


LATTICE = LA.Lattice(np.full(27 * 27, 5.0))


@pytest.mark.parametrize(
    "a, b",
    [("Аll уеаr I sаw", "All year I saw"), ("ｍｅｉｎ", "mein"), ("diﬃcult", "difficult"), ("ka​b⁠l", "kabl"), ("x y　z", "x y z"), ("अाप", "आप"), ("अौर", "और"), ("ज़", "ज़"), ("कॊ".replace("ॊ", "ॊ"), "कॊ"), ("é", "é"), ("ো", "ো"), ("My арр", "My app"), ("# jісh", "# jich"), ("Νа", "Na"), ("ஒளவை", "ஔவை")],
)
def test_one_form(a, b):
    assert LATTICE.form(a) == LATTICE.form(b)
    assert LATTICE.form(LATTICE.form(a)) == LATTICE.form(a)


@pytest.mark.parametrize("a, b", [("wait…", "wait..."), ("Ω", "O"), ("α-β", "a-b"), ("x²", "x2"), ("a b", "a  b"), ("A", "a"), ("μ", "u"), ("Москва", "Mockba"), ("a\tb", "a b")])
def test_forms_that_stay_apart(a, b):
    assert LATTICE.form(a) != LATTICE.form(b)


def test_lookalike_pairs(spark):
    rows = [(1, "Sаw it"), (2, "Saw it"), (3, "Saw it"), (4, "saw it"), (5, "S​aw it"), (6, None), (7, ""), (None, "Saw it"), (8, "अाप"), (9, "आप"), (10, "x" * 100_000 + "а"), (11, "x" * 100_000 + "a")]
    got = [tuple(r) for r in LA.identical_pairs(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(1, 2), (1, 3), (1, 5), (2, 5), (3, 5), (8, 9), (10, 11)}
    assert LA.identical_pairs(table(spark, rows).limit(0)).count() == 0
    assert LA.normalised(table(spark, rows)).count() == len(rows)


@pytest.mark.parametrize("n", [60, 61, 5000])
def test_names_of_fields_have_any_length(spark, n):
    name = ("long name " * n)[:n].rstrip().ljust(n, "e")
    rows = [(1, f"{name}: x; b: y"), (2, f"b: y; {name}: x"), (3, f"b: z; {name}: x")]
    got = {r.row_id: r.first_row_id for r in FD.copies(spark.createDataFrame(rows, "row_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_bigrams_stay_within_texts(spark):
    df = spark.createDataFrame([("ab",), ("",), (None,), ("xy z",), ("Б c",)], "text string").coalesce(1)
    m = LA.bigram_counts(df).reshape(27, 27)
    at = lambda p: m[tuple(LA.LETTERS.find(c) + 1 for c in p)]
    assert at("ab") == at("xy") == at(" a") == at("b ") == at(" z") == at(" c") == 1 and at("bx") == 0 and at("zc") == 0
    assert LA.bigram_counts(df.limit(0)).sum() == 0
