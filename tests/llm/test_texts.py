"""Problems 1, 4, 7, 8 and 9 on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sangam.functions.words import py_words
from sangam.llm import contamination as CT
from sangam.llm import language as LG
from sangam.llm import packing as PK
from sangam.llm import repetition as RP
from sangam.llm import toxicity as TX

SF = "/root/testdata/sf0.01"


def docs(spark, rows, name="doc_id"):
    df = spark.createDataFrame(rows, f"{name} long, text string").repartition(3)
    for n in ("w", "tokens", "low", "share", "toks", "piece"):
        df = df.withColumn(n, F.lit("clash"))
    return df


def windows(text, n):
    w = py_words(text or "")
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def random_docs(seed, n=120):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 300)}"
    items = [(i, " ".join(word() for _ in range(r.randint(5, 40)))) for i in range(25)]
    out = []
    for i in range(n):
        t = [word() for _ in range(r.randint(0, 120))]
        if r.random() < 0.5:
            own = py_words(r.choice(items)[1])
            k = r.randrange(len(own))
            t[len(t) // 2 : len(t) // 2] = own[k : k + r.randint(8, 16)]
        if r.random() < 0.3:
            t = t * r.randint(2, 4)
        out.append((i, r.choice([" ".join(t), ", ".join(t).upper()])))
    return out + [(900, None), (901, ""), (902, "..."), (None, "a b c"), (903, " ".join(f"z{i}" for i in range(40_000)))], items


@pytest.mark.parametrize("most", [10**6, 5])
def test_leaks(spark, most):
    d, items = random_docs(1)
    got = [tuple(r) for r in CT.leaks(docs(spark, d), docs(spark, items, "item_id"), max_index=most).collect()]
    index = {}
    for i, t in items:
        for w in windows(t, 12):
            index.setdefault(w, set()).add(i)
    want = {(k, i) for k, t in d if k is not None for w in windows(t, 12) for i in index.get(w, ())}
    assert want and len(got) == len(set(got)) and set(got) == want
    assert CT.leaks(docs(spark, d), docs(spark, items, "item_id").limit(0)).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
@pytest.mark.parametrize("share", [0.4, 1.0])
def test_leaks_of_a_share_of_each_item(spark, most, share):
    d, items = random_docs(2)
    items = items + [(500 + k, " ".join(t.split()[:n])) for k, (_, t) in enumerate(d) if t and len(t.split()) > 90 for n in (30, 60, 90)]
    got = {tuple(r) for r in CT.leaks(docs(spark, d), docs(spark, items, "item_id"), max_index=most, share=share).collect()}
    want = set()
    for i, t in items:
        n = len(py_words(t or ""))
        least = max(12, -(-int(share * 100) * n // 100))
        runs = set(windows(t, least))
        want |= {(k, i) for k, x in d if k is not None and runs & set(windows(x, least))}
    assert want and got == want


def test_containment_is_exact_and_estimated(spark):
    d, items = random_docs(1)
    got = {(r.doc_id, r.item_id): r for r in CT.scores(docs(spark, d), docs(spark, items, "item_id")).collect()}
    for (k, i), r in got.items():
        x, y = ({w for j, t in rows if j == key for w in windows(t, 5)} for rows, key in ((d, k), (items, i)))
        assert abs(r.containment - len(x & y) / len(y)) < 1e-9 and 0 < r.estimate <= 1
    assert got and abs(sum(r.estimate - r.containment for r in got.values())) / len(got) < 0.1


def test_repetition(spark):
    d, _ = random_docs(2)
    got = {r.doc_id: r for r in RP.scores(docs(spark, d)).collect()}
    assert set(got) == {k for k, _ in d if k is not None}
    for k, t in d:
        if k is None:
            continue
        runs = windows(t, 4)
        share = 1 - len(set(runs)) / len(runs) if runs else 0.0
        assert abs(got[k].share - share) < 1e-9 and got[k].n_words == len(py_words(t or ""))
        assert got[k].repetitive == (len(py_words(t or "")) >= 20 and share >= 0.35)
    assert any(r.repetitive for r in got.values())
    assert RP.scores(docs(spark, d).limit(0)).count() == 0
    units = {r.doc_id: (r.sentence_share, r.line_share) for r in RP.unit_shares(docs(spark, [(1, "A b. a B! c d."), (2, None), (3, "x\nX\ny")])).collect()}
    assert units[2] == (0, 0) and abs(units[1][0] - 1 / 3) < 1e-9 and abs(units[3][1] - 1 / 3) < 1e-9


def test_bounds_of_the_ratio_are_safe():
    r = np.random.default_rng(0)
    w = np.clip(r.normal(0, 0.3, 2 * RP.BINS), -RP.CLIP, RP.CLIP)
    w[RP.BINS :] -= 2
    low, high = RP.bounds(w)
    for _ in range(300):
        n = r.integers(20, 100)
        k = r.integers(0, n + 1)
        score = (w[r.integers(RP.BINS, 2 * RP.BINS, k)].sum() + w[r.integers(0, RP.BINS, n - k)].sum()) / n
        assert score <= high if k >= RP.SHARE * n else score >= low


def test_the_ratio_decides(spark, monkeypatch):
    monkeypatch.setattr(RP, "CLIP", 1.0)
    r = random.Random(3)
    word = lambda: f"w{r.randint(0, 60)}"
    rows = []
    for i in range(1500):
        t = [word() for _ in range(60)]
        rows.append((i, " ".join(t + t[: r.choice([0, 0, 5, 10, 30, 50, 60])] if i % 4 == 0 else t)))
    rows += [(9000 + i, " ".join([word() for _ in range(40)] * 6)) for i in range(50)]
    got = RP.scores(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (got.repetitive == ((got.n_words >= 20) & (got.share >= 0.35))).all() and got.repetitive.any()
    assert got.checked.mean() < 0.5 and (got.repetitive & ~got.checked).any()


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    r = random.Random(seed)
    cap = r.choice([16, 64, 257])
    hist = {s: r.randint(1, 40) for s in r.sample(range(1, cap + 1), r.randint(1, min(cap, 40)))}
    permitted = sorted({cap, max(1, cap // 2), max(1, cap // 5)})
    groups = PK.plan(hist, permitted)
    placed: dict = {}
    for g in groups:
        used = sum(s * k for s, k in g.items)
        assert used == g.length - g.left and g.left >= 0 and g.length in permitted
        assert g.length == min(p for p in permitted if p >= used)
        for s, k in g.items:
            placed[s] = placed.get(s, 0) + k * g.count
    assert placed == hist
    total = sum(s * n for s, n in hist.items())
    assert sum(g.count for g in groups) <= 1.5 * total / cap + 3


def test_packing(spark):
    r = random.Random(0)
    rows = [(i, " ".join(r.choice(["ghar", "movie", "बहुत"]) for _ in range(r.choice([1, 3, 8, 30, 200])))) for i in range(300)] + [(900, None), (901, ""), (902, "a"), (902, "a"), (None, "x"), (903, "long " * 3000)]
    counts = PK.token_counts(docs(spark, rows))
    own = {}
    for x in counts.collect():
        own.setdefault(x.doc_id, []).append(x.tokens)
    caps = {1: 16, 2: 64, 3: 256}
    got = PK.pack_counts(counts, caps).toPandas()
    for b, cap in caps.items():
        x = got[got.budget_id == b]
        assert x.groupby("doc_id").tokens.sum().to_dict() == {k: sum(v) for k, v in own.items()}
        use = x.groupby("container").agg(used=("tokens", "sum"), length=("length", "max"))
        assert (use.used <= use.length).all() and (use.length <= cap).all()
        whole = {k for k, v in own.items() if max(v) <= cap}
        assert (x[x.doc_id.isin(whole)].piece == 0).all()  # nothing is split without need
        assert len(use) <= x.tokens.sum() / cap * 1.1 + 3
    joint = PK.pack_counts(counts, caps, joint=True).toPandas()
    assert set(joint.length) <= {16, 64, 256} and joint.tokens.sum() == sum(map(sum, own.values()))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert PK.pack_counts(PK.token_counts(empty), caps).count() == 0
    with pytest.raises(ValueError):
        PK.pack_counts(counts, {1: 1 << 30})
    budgets = spark.createDataFrame([(1, "a", 16), (None, "b", 5), (2, "c", None), (3, "d", 0)], "budget_id int, model_key string, capacity int")
    assert PK.capacities(budgets) == {1: 16}


@pytest.mark.parametrize("text, want", [("you f.u.c.k", ["you", "fuck"]), ("i d i o t now", ["idiot", "now"]), ("v3rm1n", ["vermin"]), ("haramkhoooor", ["haramkhor"]), ("a-s-h-l-e-e-l", ["ashlel"]), ("t*arki", ["t*arki"]), ("ѕhіt", ["shit"]), ("@x #y http://a.b", []), ("well-known fact", ["wel", "known", "fact"]), ("", [])])
def test_disguise(text, want):
    assert TX.tokens(text) == want


@pytest.mark.parametrize("text, want", [("$3x", ["sex"]), ("$3xy now", ["sexy", "now"]), ("$3w3r,", ["sewer"]), ("@$$h0l3", ["ashole"]), ("l33ch3$.", ["leches"]), ("k@chr@ hain", ["kachra", "hain"]), ("70pl3$$**", ["toples"]), ("!d10t", ["idiot"]), ("idiot! $50 50$ $$ @ !!", ["idiot"])])
def test_disguise_at_the_edges(text, want):
    assert TX.tokens(text) == want


def test_open_readings():
    m = TX.Model({}, TX._masks([], {"ashlel": 2.0, "harami": 2.0, "ghar": -2.0}))
    assert m.clean(TX.tokens("@shl33l @raj99: @limusa! log")) == ["ashlel", "log"]
    assert m.clean(TX.tokens("h@r@m! h@r@m!! gh@r! idiot!")) == ["harami", "harami", "ghar", "idiot"]
    assert m.clean(TX.tokens("@sh*el @@raj **h@r@m!**")) == ["ashlel", "harami"]


def test_calibration_uses_all_neutral_texts():
    r = random.Random(0)
    scores = {"calm": -1.0, "rude": 1.0}
    neutral = [[r.choices(["calm", "rude"], [9, 1 + i // 3000])[0] for _ in range(12)] for i in range(6000)]
    laws = []
    for texts in (neutral, neutral[::-1]):
        m = TX.Model(scores)
        TX._calibrate(m, texts)
        laws.append((m.lam, m.k))
    assert np.allclose(*laws, rtol=1e-6)


def brute_segments(line):
    """Maximal segments by their definition: the best segment, then the same left and right of it."""
    if not line or max(line) <= 0:
        return []
    best, at = 0.0, None
    for i in range(len(line)):
        s = 0.0
        for j in range(i, len(line)):
            s += line[j]
            if s > best + 1e-12:
                best, at = s, (i, j + 1)
    a, b = at
    return brute_segments(line[:a]) + [(a, b, best)] + [(x + b, y + b, s) for x, y, s in brute_segments(line[b:])]


@pytest.mark.parametrize("seed", range(20))
def test_segments(seed):
    r = random.Random(seed)
    line = [r.uniform(-3, 2) for _ in range(30)]
    got, want = TX.segments(line), brute_segments(line)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))


def test_toxicity(spark):
    r = random.Random(0)
    things, names = ["book", "lamp", "river", "song"], [f"nam{i}" for i in range(50)]
    fine = lambda: f"please check the {r.choice(things)} near {r.choice(names)} today"
    bad = lambda: f"you {r.choice(['stupid', 'worthless', 'pathetic'])} idiot get lost"
    rows, labels, truth = [], [], {}
    for i in range(1200):
        toxic = i % 12 == 0
        truth[i] = toxic
        rows.append((i, f"s{i % 3}" if i % 5 else None, fine() + " " + (bad() if toxic else fine())))
        if i % 3 == 0 or toxic:
            labels.append((i, ("abuse" if toxic else "ok") if r.random() > 0.03 else "ok"))
    labels += [(5, None), (7, "ok"), (7, "hate"), (None, "ok"), (99_999, "ok")]
    rows += [(5000, "s1", None), (5001, "s1", ""), (5002, "s1", "#tag 12"), (None, "s1", "x"), (5003, "s1", "word " * 50_000), (5004, "s1", "you stup1d id*ot get l-o-s-t"), (5004, "s1", "you stup1d id*ot get l-o-s-t")]
    df = spark.createDataFrame(rows, "row_id long, source string, text string").withColumn("toks", F.lit("clash"))
    lab = spark.createDataFrame(labels, "row_id long, verdict string")
    got = TX.scores(df, lab).collect()
    flags = {x.row_id: x.toxic for x in got}
    assert len(got) == len(rows) - 1
    hit = sum(flags[i] for i in truth if truth[i])
    false = sum(flags[i] for i in truth if not truth[i])
    assert hit >= 95 and false <= 2 and flags[5004] and not any(flags[i] for i in (5000, 5001, 5002, 5003))
    rates = {x.source: x for x in TX.source_rates(TX.scores(df, lab)).collect()}
    assert sum(x.n_rows for x in rates.values()) == len(rows) - 1 and None in rates
    none = TX.scores(df, lab.limit(0))
    assert none.where("toxic or score > 0").count() == 0
    assert TX.scores(df.limit(0), lab).count() == 0


def test_language_units():
    assert LG.units("Yeh accha hai. @tag Please check it now!\nहमारे यंत्र के लिए") == [["yeh", "accha", "hai"], ["please", "check", "it", "now"], ["हमारे", "यंत्र", "के", "लिए"]]
    assert LG.units("12 #x http://a.b 😂 é") == []
    assert LG.units("unka office bahut door hai हमारे यंत्र के लिए रुपये") == [["unka", "office", "bahut", "door", "hai"], ["हमारे", "यंत्र", "के", "लिए", "रुपये"]]


def test_language_held_out(spark):
    u = spark.read.parquet(f"{SF}/uploads.parquet").select("row_id", "text", "lang")
    held = F.pmod(F.xxhash64("row_id"), F.lit(3)) == 0
    net = LG.train(u.where(~held))
    u = u.where(held)  # rows that the network has not seen
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "12 #x", "en"), (None, "the book is here", "en"), (-4, "the weather is nice and we are going out today. " * 3000, None)], "row_id long, text string, lang string")
    got = LG.languages(u.unionByName(extra), net=net).collect()
    by = {}
    for r in got:
        by.setdefault(r.row_id, []).append(r)
    assert not {-1, -2, -3} & set(by) and by[-4][0].lang == "en"
    # a script tells its language without any model
    texts = {r.row_id: r.text or "" for r in u.collect()}
    for code, lo, hi in (("bn", "ঀ", "৿"), ("ta", "஀", "௿")):
        only = [i for i, t in texts.items() if t and sum(lo <= c <= hi for c in t) > 0.9 * sum(c.isalpha() for c in t) > 0]
        assert only and np.mean([i in by and by[i][0].lang in (code, "mul") for i in only]) > 0.97
    english = [i for i, t in texts.items() if t.isascii() and len(set(t.lower().split()) & {"the", "and", "was", "from", "please"}) >= 3 and not set(t.lower().split()) & {"hai", "ka", "ke", "mein", "se", "tha", "ko", "ki"}]
    assert np.mean([i in by and by[i][0].lang == "en" for i in english]) > 0.97
    for rs in by.values():
        assert all(0 <= r.confidence <= 1 for r in rs)
        segs = sorted((r for r in rs if r.seg_no), key=lambda r: r.seg_no)
        assert [r.seg_no for r in segs] == list(range(1, len(segs) + 1)) and (bool(segs) == (min(rs, key=lambda r: r.seg_no).lang == "mul"))
        assert all(a.lang != b.lang for a, b in zip(segs, segs[1:]))
    assert LG.found(u.limit(0)).count() == 0


def test_held_out_verdicts(spark):
    r = random.Random(4)
    word = lambda k: f"{k}{r.randint(0, 150)}"
    rows, labels = [], []
    for i in range(3000):
        bad = i % 20 == 0
        rows.append((i, " ".join([word("plain") for _ in range(12)] + ([f"vile{r.choice('abcdef')}", f"nasty{r.choice('abcdef')}", f"foul{r.choice('abcdef')}"] if bad else [])), "s"))
        if bad or i % 9 == 0:
            labels.append((i, "abuse" if bad else "ok"))
    df, lab = spark.createDataFrame(rows, "row_id long, text string, source string"), spark.createDataFrame(labels, "row_id long, verdict string")
    got = TX.held_out(df, lab, 3).toPandas()
    assert got.toxic.sum() == 150 and got.neutral.sum() == len(labels) - 150 and got.found.sum() > 135 and got.flagged.sum() < 3


def test_lengths_compete_in_joint_packing():
    r = random.Random(7)
    hist = {k: r.randint(1, 200) for k in range(1, 400)}
    used = sum(k * n for k, n in hist.items())
    allowed = [64, 256, 512, 2048]
    cost = lambda gs: sum(g.count * (g.length + PK.OVERHEAD + g.length**2 / PK.ATTENTION) for g in gs)
    joint, one = PK.plan(hist, allowed, quadratic=1 / PK.ATTENTION), PK.plan(hist, [2048])
    for gs in (joint, one):
        packed = {}
        for g in gs:
            assert 0 <= g.left < g.length and g.length in allowed and sum(k * n for k, n in g.items) == g.length - g.left
            for k, n in g.items:
                packed[k] = packed.get(k, 0) + n * g.count
        assert packed == hist
    assert len({g.length for g in joint}) >= 2 and cost(joint) < 0.95 * cost(one)
    # the least cost is not the least unused room, but little stays unused
    assert sum(g.left * g.count for g in joint) <= 0.005 * used
