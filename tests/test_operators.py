import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sangam.functions import indic
from sangam.functions import tokens as T
from sangam.functions.lexicon import Lexicons
from sangam.operators import augment as A
from sangam.operators import classify as C
from sangam.operators import convert as V
from sangam.operators import metrics as M
from sangam.operators import nested
from sangam.operators import sanitize as Z
from sangam.operators import switches as S
from sangam.plans import pipeline as PL
from sangam.plans.profile import profile

LEX = Lexicons(english=frozenset("good movie work very office".split()))


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def marked(spark, f, *values):
    df = texts(spark, *values).select("doc_id", f(F.col("text")).alias("o"))
    return [r[0] for r in df.orderBy("doc_id").select(S.join_marked(F.col("o"))).collect()]


@pytest.mark.parametrize("form, want", [("xml", "<EN>movie</EN>"), ("inline", "movie|EN"), ("prefix", "[EN] movie"), ("suffix", "movie [EN]")])
def test_tags(spark, form, want):
    assert marked(spark, lambda x: S.tag_tokens(x, LEX, tag_format=form), "movie") == [want]


def test_boundaries(spark):
    assert marked(spark, lambda x: S.tag_tokens(x, LEX, insert_boundary_markers=True), "yaar movie bahut good")[0].count("SWITCH") == 3
    with pytest.raises(ValueError):
        S.tag_tokens(F.lit("x"), tag_format="bad")


def test_switch_encoding(spark):
    enc = lambda **k: lambda x: S.encode_tokens(x, LEX, **k)
    assert marked(spark, enc(), "good bahut", "good, work", "good, bahut", None, "") == ["good [SWITCH_EN_HI_ROM] bahut", "good, work", "good, [SWITCH_EN_HI_ROM] bahut", None, ""]
    assert marked(spark, enc(directional_markers=False), "good bahut") == ["good [SWITCH] bahut"]
    assert marked(spark, enc(strategy="inline"), "good bahut") == ["good ⟨EN→HI_ROM⟩ bahut"]
    once = marked(spark, enc(), "good bahut good, work yaar")[0]
    assert marked(spark, enc(), once) == [once]
    with pytest.raises(ValueError):
        S.encode_tokens(F.lit("x"), strategy="bad")


def test_positions_against_plain_python(spark):
    rows = texts(spark, "good work, Rahul bahut yaar xyz good 12 movie http://a.b very very very very good", "", None, "!!")
    got = S.positions(rows, "doc_id", "text", LEX).where("id = 0").orderBy("pos").collect()
    labels = [r.lang for r in got]
    near, runs = A.near_switch(labels, 3), A.run_lengths(labels)
    assert [r.near for r in got] == [i in near for i in range(len(got))]
    assert [r.run for r in got] == runs
    assert got[0].switches / (got[0].content - 1) == A.switch_density(labels)


def test_density_examples():
    assert A.switch_density(["EN", "HI", "EN", "HI", "EN"]) == 1.0
    assert A.switch_density(["EN", "EN", "EN", "EN", "HI"]) == 0.25
    assert A.switch_density(["EN"]) == 0.0


def test_context_multiplier(spark):
    df = spark.createDataFrame([(["EN", "HI_ROM", "EN", "EN", "HI_ROM"],), (["EN", "UNK", "EN", "EN"],), ([],)], "l array<string>")
    got = [r[0] for r in df.select(S.context_multiplier(F.col("l"))).collect()]
    assert got == [[1.5] * 5, [1.0, 1.0, 0.7, 1.0], []]


def test_sanitizer(spark):
    df = texts(spark, "[SWITCH_EN_HI] <EN>a</EN> DEV:b", "x [SWITCH_EN_HI_ROM] y", None, "a|HI_ROM b", "⟨EN→HI_DEV⟩ z")
    assert [r[0] for r in df.select(Z.clean_for_model(F.col("text"))).collect()] == ["a b", "x y", "", "a b", "z"]
    assert [r[0] for r in df.select(Z.contains_markers(F.col("text"))).collect()] == [True, True, None, True, True]


@pytest.mark.parametrize("a, b", [("hoti", "होति"), ("hai", "है"), ("ya", "य"), ("hain", "हैन्"), ("aur", "और्"), ("karte", "कर्ते"), ("jismen", "जिस्मेन्"), ("instructions", "इन्स्त्रुच्तिओन्स्"), ("gaya", "गय"), ("unhonne", "उन्होन्ने"), ("zamin", "ज़मिन्"), ("bhaee", "भई"), ("samood", "समूद्"), ("duaa", "दुआ"), ("mitti", "मित्ति"), ("tumhara", "तुम्हर")])
def test_recorded_transliterations(a, b):
    assert indic.to_devanagari(a).replace("ज़", "ज़") == b.replace("ज़", "ज़")


def test_round_trip_validation():
    assert V.transliterate_word("koee") is None
    assert V.transliterate_word("bhaee") == "भई"
    assert indic.simplify_roman("ātmā") == "atma" and indic.simplify_roman("dīpak") == "dipak"


def test_script_operators_pass_english_and_are_idempotent(spark):
    df = texts(spark, "bahut good movie, aur kya hai 42 #bahut", None, "")
    once = V.script_unification(df, lex=LEX).select("doc_id", F.col("processed_text").alias("text"))
    got = [r.text for r in once.orderBy("doc_id").collect()]
    assert "good movie," in got[0] and "ब" in got[0] and got[1:] == [None, ""]
    assert [r.processed_text for r in V.script_unification(once, lex=LEX).orderBy("doc_id").collect()] == got
    tr = V.transliteration(df, lex=LEX).select("doc_id", F.col("processed_text").alias("text"))
    assert [r.processed_text for r in V.transliteration(tr, lex=LEX).orderBy("doc_id").collect()] == [r.text for r in tr.orderBy("doc_id").collect()]
    with pytest.raises(ValueError):
        V.script_unification(df, target_script="greek")


def test_augmentation_properties(spark):
    df = texts(spark, "very good movie and work", "xyz pqr", "Rahul good", None, "")
    kw = dict(lex=LEX, augmentation_probability=0.9, n_augments=2)
    a = [tuple(r) for r in A.augment(df.repartition(3), "doc_id", **kw).orderBy("doc_id", "is_augmented", "processed_text").collect()]
    b = [tuple(r) for r in A.augment(df.coalesce(1), "doc_id", **kw).orderBy("doc_id", "is_augmented", "processed_text").collect()]
    assert a == b
    new = [r for r in a if r[3]]
    assert {r[0] for r in new} <= {0, 2} and all(len(r[1].split()) == len(r[2].split()) and r[1] != r[2] for r in new)
    assert all("Rahul" in r[2] for r in new if r[0] == 2)
    with pytest.raises(ValueError):
        A.augment(df, "doc_id", n_augments=0)


def test_subword_sampling_restores_words(spark):
    df = texts(spark, "zindagi samajhna bahut shukriya 12345", None)
    got = A.subword_sampling(df, "doc_id", lex=LEX, hindi_dropout_prob=1.0, english_dropout_prob=1.0).orderBy("doc_id").collect()
    assert "▁" in got[0].processed_text and got[0].processed_text.replace("▁", "") == got[0].text and got[1].processed_text is None
    assert A.join_pieces(["▁un", "der", "stand"]) == "un▁der▁stand"


def test_pipeline_rules(spark):
    with pytest.raises(ValueError):
        PL.Pipeline(["transliteration", "script_unification"])
    with pytest.raises(ValueError):
        PL.Pipeline(["nope"])
    with pytest.raises(RuntimeError):
        PL.Pipeline([]).augment(spark.range(1))
    with pytest.warns(UserWarning, match="redundant"):
        PL.Pipeline(["language_identification_tagging", "switch_point_encoding"], enable_analysis=True)
    assert PL.Pipeline([]).process(texts(spark, "a", None)).count() == 2


def test_pipeline_modes_and_trace(spark):
    df = texts(spark, "acha movie", None).withColumn("extra", F.lit(1))
    p = PL.Pipeline(["phonetic_normalization", "switch_point_encoding"], output_mode="both", lexicons=LEX)
    out = p.process(df)
    assert out.columns == ["doc_id", "text", "extra", "processed_text", "analysis_switch_point_encoding"]
    assert out.first().processed_text == "accha movie"
    assert p.trace(df).first().trace[0].asDict() == {"module": "phonetic_normalization", "before": "acha movie", "after": "accha movie"}


def test_identity_profile(spark):
    df = texts(spark, "good bahut work yaar", "movie hai", None).withColumn("proc", F.col("text"))
    r = profile(df, "doc_id", "text", "proc", lex=LEX)
    assert r["retention"]["spri"] == 1.0 and r["information"]["delta_entropy"] == 0 and 0 <= r["composite"]["score"] <= 1


def test_retention_matches_greedy_python(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["good", "bahut", "zzz"]) for _ in range(r.randint(0, 12))), " ".join(r.choice(["good", "bahut"]) for _ in range(r.randint(0, 12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a string, b string")

    def places(t):
        k = [{"good": "EN", "bahut": "HI"}.get(x, "UNK") for x in t.split()]
        return [i / len(k) for i in range(1, len(k)) if k[i] != k[i - 1] and "UNK" not in k[i - 1 : i + 1]]

    want = []
    for _, a, b in rows:
        o, p = places(a), places(b)
        if o:
            hit = 0
            for x in o:
                m = next((y for y in p if abs(x - y) <= 0.15), None)
                if m is not None:
                    p.remove(m)
                    hit += 1
            want.append((len(o), hit))
    got = [(x.n_orig, x.n_matched) for x in M.retention(df, "a", "b", Lexicons(english=frozenset({"good"}), hindi=frozenset({"bahut"}))).where("ratio is not null").collect()]
    assert sorted(got) == sorted(want)


def test_vectors_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=(40, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    c, n = M.covariance(df, "embedding")
    assert n == 40 and np.allclose(c, np.cov(x.T))
    s = M.spectrum(df, "embedding").first()
    lam = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert math.isclose(s.condition_number, lam[0] / lam[-1], rel_tol=1e-6)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in M.cohesion(df, "embedding", "label").collect():
        k = u[np.arange(40) % 3 == r.label]
        g = k @ k.T
        assert math.isclose(r.cohesion, g[np.triu_indices(len(k), 1)].mean(), rel_tol=1e-9)
    pred = {r.id: r.pred_label for r in C.leave_one_out(df, "vec_id", "embedding", "label").collect()}
    for i in range(40):
        protos = [x[[j for j in range(40) if j % 3 == k and j != i]].mean(0) for k in range(3)]
        want = max(range(3), key=lambda k: (x[i] @ protos[k] / (np.linalg.norm(x[i]) * np.linalg.norm(protos[k]) + 1e-8), -k))
        assert pred[i] == want
    b = M.bootstrap_mean(df.select(F.col("label").cast("double").alias("l")), "l").first()
    assert b.low < b.mean < b.high
    assert -1 <= M.silhouette(df, "embedding", "label") <= 1


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert M.token_entropy(e, "text").first().entropy == 0 and M.fertility(e, "doc_id", "text").count() == 0
    assert M.spectrum(spark.createDataFrame([], "v array<double>"), "v").count() == 0
    assert PL.preset("P2").process(e).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([("1", None), (" 2 ", "negative"), (None, " POSITIVE"), ("7", "x"), (None, None), ("1.0", None)], "a string, b string")
    assert [r[0] for r in df.select(C.label_or_sentiment(F.col("a"), F.col("b"))).collect()] == [1, 2, 2, None, None, 1]


def test_composite_and_compare():
    assert M.composite({"spri": 1.0})["score"] == 1.0 and M.composite({})["score"] is None
    assert M.clip_scale(5, 0, 2) == 1.0 and M.clip_scale(None, 0, 1) is None and M.clip_scale(1, 1, 1) is None
    assert M.compare({"a": 2.0, "b": 0.0, "c": None}, {"a": 3.0, "b": 1.0, "c": 1.0}) == {"a": 50.0, "b": None, "c": None}


def test_nested_round_trip(spark):
    import json

    body = {"x": 1, "config": {"pipeline_config": {"rules": [{"a": 1}, "skip", {"a": 1, "examples": {"q": [1, {"z": 2}]}}], "stages": []}}, "status": {"state": "done", "history": {"state": "failed"}}}
    rows = [(1, "j", json.dumps(body)), (2, "j", None), (3, "j", "{cut"), (4, "j", ""), (5, "j", "[1]"), (6, "j", json.dumps({"pipeline_config": json.dumps({"layers": [{"k": None}]}), "wrap": {"pipeline_config": {"rules": [{}]}}})), (7, "j", json.dumps(body))]
    df = spark.createDataFrame(rows, "rec_id long, job_id string, body string").withColumn("hash", F.lit("clash"))
    occ = nested.occurrences(df)
    got = {tuple(r) for r in nested.elements(occ).where("rec_id in (1, 6)").collect()}
    assert got == {(1, "pipeline_config.rules[0]", "$"), (1, "pipeline_config.rules[2]", "$"), (1, "pipeline_config.rules[2].examples[0]", "pipeline_config.rules[2]"), (1, "status.history[0]", "$"), (6, "pipeline_config.layers[0]", "$")}
    bodies = {r.hash: json.loads(r.body) for r in nested.objects(occ).collect()}

    def build(v):
        if isinstance(v, dict):
            return build(bodies[v["$ref"]]) if set(v) == {"$ref"} else {k: build(x) for k, x in v.items()}
        return [build(x) for x in v] if isinstance(v, list) else v

    rec = {r.rec_id: r for r in nested.records(occ).collect()}
    assert build(bodies[rec[1].config_hash]) == body["config"]["pipeline_config"] and rec[1].config_hash == rec[7].config_hash
    assert set(rec) == {1, 6, 7} and rec[1].job_id == "j"
    empty = nested.occurrences(df.limit(0))
    assert empty.count() == 0 and nested.elements(empty).count() == 0 and nested.objects(empty).count() == 0


def test_small_statistics(spark):
    df = texts(spark, "yaar movie bahut good", "yaar ! ! !", None, "")
    t = S.tagging_stats(df.where("doc_id = 0"), "text", LEX).first()
    assert (t.content_tokens, t.boundaries, t.coverage, t.density) == (4, 3, 1.0, 1.0)
    assert S.tagging_stats(df.where("doc_id = 1"), "text", LEX).first().coverage == 1.0
    assert S.tagging_stats(df.limit(0), "text", LEX).first().total_tokens == 0
    assert S.switch_stats(df, "text", LEX).first().switches == 3


def test_pooling_and_markers(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0], ["[SWITCH_EN_HI]", "a"]), ([[1.0, 1.0]], [0], ["a"])], "v array<array<double>>, m array<int>, t array<string>")
    got = df.select(C.mean_pool(F.col("v"), F.col("m"), 2), C.has_switch_marker(F.col("t"))).collect()
    assert [list(r) for r in got] == [[[2.0, 3.0], True], [[0.0, 0.0], False]]


def test_summary_with_an_encoder(spark):
    df = spark.createDataFrame([(i, "aa" if i % 2 else "bbbb", float(i % 2), None) for i in range(10)] + [(10, None, None, "positive")], "doc_id long, text string, label double, sentiment string")
    r = C.summarize(df, "doc_id", "text", lambda ts: [[float("a" in t), float("b" in t)] for t in ts])
    assert r["accuracy"] == 1.0 and r["n"] == 10 and r["macro_f1"] == 1.0


def test_quantiles_are_exact_however_few_rows_are_sorted(spark):
    r = np.random.default_rng(5)
    for x in (r.normal(size=3000), np.repeat([1.0, 2.0, 3.0], 700), np.append(r.integers(0, 5, 999), 1e300), np.array([4.0]), np.array([1.0, np.nextafter(1.0, 2)] * 30)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
        for most in (1, 100_000):
            got = M.quantiles(df, "x", [0.0, 0.25, 0.5, 0.999, 1.0], most, 7)
            assert np.allclose(got, np.quantile(x, [0.0, 0.25, 0.5, 0.999, 1.0]), rtol=1e-12)
    assert M.quantiles(df.limit(0), "x", [0.5]) == [None]


def test_silhouette_in_blocks(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(size=(120, 3)) + 1.5 * (np.arange(120) % 3)[:, None], np.arange(120) % 3
    x[3], y[3] = x[0], y[0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(120):
        same = (y == y[i]) & (np.arange(120) != i)
        a, b = d[i, same].mean(), min(d[i, y == c].mean() for c in set(y) - {y[i]})
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "v array<double>, y int").repartition(3)
    for block in (17, 4000):
        assert abs(M.silhouette(df, "v", "y", block) - np.mean(want)) < 1e-9
    assert M.silhouette(df.where("y = 1"), "v", "y") is None and M.silhouette(df.limit(0), "v", "y") is None


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "i long, x double")
    a, b = (M.bootstrap_mean(df.repartition(n), "x", 200, id_col="i").first() for n in (1, 5))
    assert np.allclose(a, b) and a.low < 3 < a.high and abs(a.high - a.low - 4 * 2 / 500**0.5) < 0.15


def test_leave_one_out_keeps_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (1, [0.0, 1.0], 1), (2, [1.0, 0.1], 1)], "i long, v array<double>, y int")
    got = sorted(tuple(r) for r in C.leave_one_out(df, "i", "v", "y").collect())
    assert len(got) == 4 and [t for i, t, _ in got if i == 1] == [0, 0, 1]
    assert C.leave_one_out(df.limit(1), "i", "v", "y").first().pred_label is None
    assert C.leave_one_out(df.limit(0), "i", "v", "y").count() == 0


def test_centroid_bootstrap(spark):
    x = np.random.default_rng(1).normal(size=(60, 3)) + np.repeat([[0, 0, 0], [2, 0, 0]], 30, axis=0)
    df = spark.createDataFrame([([float(v) for v in r], i // 30) for i, r in enumerate(x)], "v array<double>, y int")
    b = M.centroid_bootstrap(df, "v", "y", 0, 1, rounds=200).first()
    assert b.low < np.linalg.norm(x[:30].mean(0) - x[30:].mean(0)) < b.high


def test_centroid_bootstrap_covers_the_table(spark):
    from sangam.plans import catalogue

    sf = "/root/testdata/sf0.001"
    v = catalogue.vectors(spark, sf).withColumn("k", F.col("label") % 2)
    crd = M.centroid_distance(v, "embedding", "k").first().euclidean
    b = catalogue.queries()["centroid_bootstrap"](spark, sf).first()
    assert b.low < b.mean < b.high
    want = M.centroid_bootstrap(v, "embedding", "k", 0, 1, id_col="vec_id").first()
    assert abs(b.mean - want.mean) < 1e-6 and b.low < crd * 1.5 and b.high > crd


def test_whole_composite_and_comparison(spark):
    from sangam.plans import catalogue

    sf = "/root/testdata/sf0.001"
    q = catalogue.queries()
    x = q["composite_six_terms"](spark, sf).first().asDict()
    score = x.pop("score")
    assert set(x) == set(M.TERMS) and None not in x.values() and abs(score - np.mean(list(x.values()))) < 1e-9
    c = {r.metric: r for r in q["compare_sections"](spark, sf).collect()}
    assert {"entropy", "vocab_size", "mi", "fertility_mean", "spri", "spectral_entropy", "crd_euclidean", "mean_cosine", "mpp"} <= set(c)
    assert c["spri"].baseline == 1.0 and abs(c["mean_cosine"].baseline - 1) < 1e-6 and abs(c["mpp"].candidate - score) < 1e-6
    assert c["mpp"].better == (c["mpp"].candidate > c["mpp"].baseline)
    two = q["compare_profiles"](spark, sf).first()
    assert abs(c["entropy"].change - two.entropy_change) < 1e-4 and abs(c["vocab_size"].change - two.vocab_change) < 1e-4


def plain_elements(rec_id, body):
    """Elements by a plain walk, without hashes."""
    out = []

    def go(v, path, inside):
        for name, x in v.items():
            todo = [(f"{path}.{name}", x, True)] if isinstance(x, list) else [(f"{path}.{name}", [x], True)] if isinstance(x, dict) and name in nested.ARRAYS else []
            if isinstance(x, dict) and not todo:
                go(x, f"{path}.{name}", inside)
            while todo:
                at, xs, direct = todo.pop()
                for i, y in enumerate(xs):
                    if isinstance(y, list):
                        todo.append((f"{at}[{i}]", y, False))
                    elif isinstance(y, dict):
                        element = direct and name in nested.ARRAYS
                        if element:
                            out.append((rec_id, f"{at}[{i}]", inside))
                        go(y, f"{at}[{i}]", f"{at}[{i}]" if element else inside)

    for root in nested.ROOTS:
        if isinstance(body.get(root), dict):
            go(body[root], root, "$")
    return out


@pytest.mark.parametrize("most", [0, nested.MAX_LINKS])
def test_elements_come_from_the_objects(spark, monkeypatch, most):
    import json

    monkeypatch.setattr(nested, "MAX_LINKS", most)
    body = '{"pipeline_config": {"rules": [{"name": "a", "steps": [{"x": 1}, 5, {"x": 1}]}, {"name": "a", "steps": [{"x": 1}, 5, {"x": 1}]}], "grid": [[{"notes": {"y": 1}}], [{"notes": {"y": 1}}]]}, "status": {"history": [{"k": {"checks": [{}, {}]}}]}}'
    rows = [(1, body), (2, body), (2, body), (3, "{"), (4, '{"status": {}}'), (5, '{"status": {"notes": [{"x": NaN}]}}'), (None, body)]
    df = spark.createDataFrame(rows, "rec_id long, body string").withColumn("hash", F.lit("clash"))
    occ = nested.occurrences(df)
    got = sorted(map(tuple, nested.elements(occ).collect()))
    assert got == sorted(x for i in (1, 2, 2) for x in plain_elements(i, json.loads(body))) and len(got) == 33
    assert sorted(map(tuple, nested.found(df).collect())) == got
    assert {r.n_occurrences for r in nested.objects(occ).collect()} == {3, 6, 12} | {r.n_occurrences for r in nested.objects(occ).collect()}
    # without hashes that tell objects apart the rows are others
    assert nested.elements(occ.withColumn("a", F.when(F.col("kind") == 2, "none").otherwise(F.col("a")))).count() == 0
    nodes = nested.flatten(json.loads(body)["status"])
    hs = [h for h, _ in nested.hashes(nodes)]
    assert len(set(hs)) == 4 and hs[-1] == hs[-2]  # the two empty checks are one object


def test_elements_are_the_same_whatever_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(nested, "HELD", 3)
    rows = [(i, '{"status": {"history": [{"k": %d}, {"notes": {"x": 1}}]}}' % (i % 3)) for i in range(20)]
    df = spark.createDataFrame(rows, "rec_id long, body string")
    got = sorted(map(tuple, nested.found(df).collect()))
    assert len(got) == 60 and got == sorted(map(tuple, nested.elements(nested.occurrences(df)).collect()))
    assert nested.found(df.limit(0)).count() == 0


def test_bodies_of_any_depth(spark):
    deep = 12_000
    body = '{"status": ' + '{"a": [' * deep + '{"steps": [{"x": "' + "9" * 10 + '"}]}' + "]}" * deep + ', "n": ' + "7" * 5000 + "}"
    lists = '{"status": {"notes": [' + "[" * 50_000 + "]" * 50_000 + ', {"k": 1}]}}'
    df = spark.createDataFrame([(1, body), (2, body[:-1]), (3, lists), (4, '{"status": {"notes": [{"\\ud800": 1}]}}')], "rec_id long, body string")
    got = {(r.rec_id, r.path[-9:], r.parent_path) for r in nested.found(df).collect()}
    assert got == {(1, ".steps[0]", "$"), (3, ".notes[1]", "$"), (4, ".notes[0]", "$")}


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\u0041\\"", true, null, {}, []], "a": {"b": "ü"}}', "[]", "  3 ", '"x"', '{"a" : [ ] , "b":[[1],[2,{"c":[]}]]}'])
def test_the_deep_reader_reads_what_the_plain_one_does(text):
    import json

    assert nested._read_deep(text) == json.loads(text)
    for cut in range(len(text.strip()) - 1):
        with pytest.raises(ValueError):
            json.loads(text[: cut + 1]) if text.strip()[:1] != "3" and json.loads(text) is not None else nested._read_deep("")
        if text.strip()[:1] in '[{"':
            with pytest.raises(ValueError):
                nested._read_deep(text.strip()[: cut + 1])


def test_pieces_from_asks_for_all_candidates(monkeypatch):
    import sys
    import types

    class Processor:
        def __init__(self, model_file):
            pass

        def nbest_encode_as_pieces(self, word, n):
            return [[str(k)] for k in range(n)]

    monkeypatch.setitem(sys.modules, "sentencepiece", types.SimpleNamespace(SentencePieceProcessor=Processor))
    draw = A.pieces_from("m", 64, 0.0)
    assert max(int(draw("word", random.Random(k))[0]) for k in range(300)) >= 48


def test_profile_has_its_sections(spark):
    df = spark.createDataFrame([(1, "the ghar is bahut good", "the ghar is good"), (2, "please check ghar", "please check ghar")], "doc_id long, text string, proc string")
    sides = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.2]), (1, [0.0, 1.0]), (1, [0.1, 1.0])], "label int, vector array<double>")
    r = profile(df, "doc_id", "text", "proc", lex=LEX, sides=sides)
    assert not [s for s in r.values() if "error" in s]
    assert sum(r["fertility"]["before"]["languages"].values()) == 8 and sum(r["fertility"]["after"]["histogram"]) == r["fertility"]["after"]["n"]
    assert {"low", "high"} <= set(r["fertility"]["bootstrap"]) & set(r["retention"]["bootstrap"]) & set(r["crd"]["bootstrap"])
    assert set(r["crd"]["cohesion"]) == {0, 1} and r["composite"]["terms"]["crd"] is not None


def test_encoders_load_once(spark):
    loaded = []

    def loader(name):
        loaded.append(name)
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    e = C.Encoders(loader)
    with pytest.raises(KeyError):
        e.get("none")
    assert e.get("xlmr")(["ab"]) == [[2.0, 1.0]] and e.get("xlmr") and loaded == ["xlm-roberta-base"]
    assert e.status()["xlmr"] and not e.status()["mbert"]
    e.unload()
    assert not any(e.status().values())
    df = spark.createDataFrame([("abc [SWITCH] d",), (None,), ("",)], "text string")
    got = C.evaluate_texts(df, "text", lambda ts: [[float(len(t)), 1.0] for t in ts]).collect()
    assert (got[0].n_tokens, got[0].n_chars, got[0].has_switch_marker, got[0].mean) == (3, 14, True, 7.5)
    assert got[1].vector is None and got[1].n_tokens == 0 and got[1].norm is None and got[2].vector == [0.0, 1.0]


def test_statistics_of_pipelines_and_variants(spark):
    df = texts(spark, "please check this good food yaar", "bahot acha yaar", None, "")
    p = PL.Pipeline(["phonetic_normalization", "language_identification_tagging", "code_switch_augmentation"], enable_analysis=True, output_mode="both", lexicons=LEX)
    got = {(r.module, r.statistic): r.value for r in p.collect_statistics(df).collect()}
    assert got["pipeline", "rows"] == 4 and got["pipeline", "texts"] == 3 and got["phonetic_normalization", "changed_rows"] == 1
    assert got["language_identification_tagging", "content_tokens"] == 9 and got["code_switch_augmentation", "originals"] == 4
    out = A.augment(df, "doc_id", lex=LEX, n_augments=2, augmentation_probability=1.0)
    s = A.replacement_stats(df, out, "doc_id", n_augments=2, lex=LEX).first()
    assert s.eligible_texts == 1 and s.generated + s.skipped == 2 and s.replaced_tokens == s.eligible_tokens * s.generated and 0 < s.density_before <= 1 and 0 < s.density_after <= 1
    assert A.replacement_stats(df.limit(0), out.limit(0), "doc_id").first().augmentation_yield == 0.0


def test_is_hindi(spark):
    assert [r[0] for r in texts(spark, "घर", "yaar", "movie", None, "").select(T.is_hindi(F.col("text"), LEX)).collect()] == [True, True, False, False, False]


def test_profile_through_the_cache(spark, tmp_path):
    from sangam.plans.profile import profile_through_cache
    from sangam.sources.cache import EmbeddingCache

    rows = [(i, f"the ghar {i}", f"the ghar {i}", f"<EN> the ghar {i}" if i else None) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, proc string, model_input_text string")
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    encoder = lambda ts: [[float(len(t)), float(sum(map(ord, t)) % 7), 1.0] for t in ts]
    r = profile_through_cache(df, "doc_id", "text", "proc", cache, "m", encoder, 3, lex=LEX)
    assert not [s for s in r.values() if "error" in s], r
    assert r["stability"]["n"] == 5 and sum(r["stability"]["histogram"]) == 5 and r["spectral"]["n_rows"] == 5  # the null text has no vector
    assert cache.stats().first().n == 11


def test_a_cluster_needs_a_shared_folder():
    import types

    from sangam.session import shared_dir

    def fake(master, d):
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, x: d), sparkContext=types.SimpleNamespace(master=master))

    with pytest.raises(RuntimeError):
        shared_dir(fake("spark://host:7077", None))
    assert shared_dir(fake("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
