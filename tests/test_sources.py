import json

import pytest
from pyspark.sql import functions as F

from sangam.sources import corpora, lexicons
from sangam.sources.cache import EmbeddingCache
from sangam.streaming import texts as ST


def test_csv(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text(',text,sentiment,label\n0,"two\nlines ""quoted""",neutral,1.0\n1,plain,,\n', encoding="utf-8")
    df = corpora.read_csv(spark, str(p), ("text", "sentiment", "label"))
    assert df.columns == ["text", "sentiment", "label"] and df.orderBy("text").collect()[1].text == 'two\nlines "quoted"'
    corpora.write_csv(df, str(tmp_path / "out"))
    assert corpora.read_csv(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(RuntimeError):
        corpora.read_csv(spark, str(p), ("nope",))


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"Ghar ": "घर"}), encoding="utf-8")
    (tmp_path / "m.csv").write_text("kaam,काम\n", encoding="utf-8")
    assert [tuple(r) for r in lexicons.layered(lexicons.read(spark, str(tmp_path / "m.json"))).collect()] == [("ghar", "घर")]
    assert lexicons.layered(lexicons.read(spark, str(tmp_path / "m.csv"))).first().target == "काम"
    with pytest.raises(FileNotFoundError):
        lexicons.read(spark, str(tmp_path / "none.json"))
    layers = spark.createDataFrame([("GHAR", "a", 1), ("ghar ", "b", 2), ("ghar", None, 3), (" ", "x", 1)], "roman string, target string, layer int")
    assert [tuple(r) for r in lexicons.layered(layers).collect()] == [("ghar", "b")]


def test_jobs(spark):
    rows = [(1, "a", '{"status": "running"}', "2025-01-01"), (2, "a", '{"status": {"state": "done"}, "progress": 100}', "2025-02-01"), (3, "a", "{cut", "2025-03-01"), (4, "b", None, "2025-01-01")]
    df = spark.createDataFrame(rows, "rec_id long, job_id string, body string, saved_at string").withColumn("saved_at", F.col("saved_at").cast("timestamp"))
    assert [tuple(r) for r in corpora.latest_status(df).collect()] == [("a", "done", 2)]
    assert corpora.flatten_metrics({"a": {"b": 1, "c": True, "d": "x"}, "e": 2.5}) == {"a.b": 1, "e": 2.5}


def test_cache(spark, tmp_path):
    c = EmbeddingCache(spark, str(tmp_path / "cache"))
    seen = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    assert c.misses(seen, "m").count() == 2
    got = c.encode(seen, "m", lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    assert {(r.text, tuple(r.vector)) for r in got.collect()} == {("a", (1.0, 1.0)), ("b", (1.0, 1.0)), (None, (0.0, 0.0))}
    assert c.misses(seen, "m").count() == 0 and c.misses(seen, "other").count() == 2
    assert [tuple(r) for r in c.stats().collect()] == [("m", 2)]
    c.clear("m")
    assert c.stats().count() == 0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "j", 0, "acha kaam good", "2025-01-01 00:10:00"), (2, "j", 0, "acha kaam good", "2025-01-01 00:20:00")], "row_id long, job_id string, row_no long, text string, t string").withColumn("received_at", F.col("t").cast("timestamp")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    from sangam.plans.pipeline import preset

    out = ST.process_stream(stream(), preset("P2"))
    q = out.writeStream.format("memory").queryName("p2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.processed_text for r in spark.table("p2").collect()} == {"accha kaam good"}
    q = ST.first_deliveries(stream()).writeStream.format("memory").queryName("first").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("first").count() == 1
    q = ST.language_rates(stream()).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.lang, r.n) for r in spark.table("rates").collect()} == {("HI", 4), ("EN", 2)}


def test_tracking(spark, tmp_path):
    from sangam.sources.tracking import Tracker

    t = Tracker(spark, str(tmp_path / "runs"))
    t.start("r1", "profile", job_id="j")
    t.params("r1", modules="P2")
    t.metrics("r1", {"a": {"b": 1.5}, "ok": True})
    t.artifact("r1", "config", {"x": 1})
    t.end("r1", "failed")
    assert [tuple(r) for r in t.runs().collect()] == [("r1", "failed", "profile")]
    assert {(r.kind, r.key) for r in t.facts().collect()} == {("param", "modules"), ("metric", "a.b"), ("artifact", "config")}


def test_english_word_list(spark, tmp_path):
    from sangam.sources import lexicons

    with pytest.raises(LookupError):
        lexicons.english(spark, str(tmp_path / "none.txt"))
    (tmp_path / "words.txt").write_text("The\n\n movie \nthe\n")
    words = lexicons.english(spark, str(tmp_path / "words.txt"))
    assert sorted(r.word for r in words.collect()) == ["movie", "the"]
    toks = spark.createDataFrame([("THE", 1), ("ghar", 2), (None, 3), ("the", 4)], "tok string, word int")
    assert {r.word: r.is_english for r in lexicons.english_flags(toks, "tok", words).collect()} == {1: True, 2: False, 3: False, 4: True}


@pytest.mark.parametrize("most", [100_000, 0])
def test_a_lexicon_that_is_joined(spark, monkeypatch, most):
    from sangam.operators import normalize as N
    from sangam.sources import lexicons

    lex = spark.createDataFrame([("ghar", "घर", 1), ("Ghar ", "गृह", 2), ("yaar", "यार", 1), ("x", None, 1)], "roman string, target string, layer int")
    df = spark.createDataFrame([(1, "Ghaaar GHAR, yar the 42! xyz"), (2, None), (3, ""), (4, "the ghar " * 2000)], "doc_id long, text string").withColumn("__x", F.lit(1))
    want = N.process(df, lambda toks: F.transform(toks, lambda t: N.balanced(t, lexicons.as_map(lex))), normalized=True)
    monkeypatch.setattr(lexicons, "MAX_ENTRIES", most)
    got = {r.doc_id: r.processed_text for r in lexicons.balanced_texts(df, "doc_id", lex).collect()}
    assert "गृह" in got[1] and "यार" in got[1] and got[2] is None and got[3] == "" and got[4].count("गृह") == 2000
    assert got == {r.doc_id: r.processed_text for r in want.collect()}


def test_records_are_written_and_recovered(spark, tmp_path):
    from sangam.sources import corpora

    jobs = spark.createDataFrame([(1, "a", '{"status":\n"x"}', "2024-01-01 00:00:00"), (2, "a", '{"status": "y"}', "2024-01-02 00:00:00"), (3, "b", "{cut", "2024-01-01 00:00:00"), (4, "c", None, "2024-01-01 00:00:00")], "rec_id long, job_id string, body string, saved_at string")
    corpora.write_records(jobs, str(tmp_path / "jobs"))
    assert [tuple(r) for r in corpora.read_records(spark, str(tmp_path / "jobs")).collect()] == [("a", '{"status": "y"}')]
    corpora.write_manifest(str(tmp_path / "m.json"), spark, names=["x"])
    assert "names" in (tmp_path / "m.json").read_text()
