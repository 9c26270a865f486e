import pytest
from pyspark.sql import functions as F

from sangam.functions import tokens as T
from sangam.functions.lexicon import CANON, HINDI, VARIANTS, Lexicons
from sangam.operators import normalize as N


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def rebuilt(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", T.tokenize(F.col("x")).alias("t"))
    return [r[0] for r in df.orderBy("i").select(T.reconstruct(F.col("t"))).collect()]


def test_artefacts_are_atomic(spark):
    got = col(spark, ["Check https://example.com. c@e.com #Tag! @user, can't 98.6% 12:30 बहुत है"], T.tokenize)[0]
    assert got == ["Check", "https://example.com", ".", "c@e.com", "#Tag", "!", "@user", ",", "can't", "98.6%", "12:30", "बहुत", "है"]


def test_parity_tokens_split_as_the_code_does(spark):
    got = col(spark, ["https://a.com 98.6% 9% बहुत"], lambda x: T.tokenize(x, True))[0]
    assert got == ["https://a", ".", "com", "98.6", "%", "9%", "बह", "ु", "त"]


@pytest.mark.parametrize("text", ["Hello, world!", "wait (for me) now.", "a [b] c: d", "yaar, kya hai?", 'he said"', ""])
def test_reconstruct_round_trip(spark, text):
    assert rebuilt(spark, [text]) == [text]


def test_null_and_long_texts(spark):
    assert rebuilt(spark, [None, "  ", "x " * 20_000]) == [None, "", ("x " * 20_000).strip()]


def test_four_languages(spark):
    lex = Lexicons(english=frozenset({"movie", "office", "lol"}))
    words = ["movie", "lol", "है", "bahut", "yaar", "xy", "gaya", "shadow", "dilaya", "", "123"]
    assert col(spark, words, lambda x: T.language4(x, lex)) == ["EN", "EN", "HI_DEV", "HI_ROM", "HI_ROM", "UNK", "HI_ROM", "UNK", "HI_ROM", "UNK", "UNK"]


def test_phonetic_scores(spark):
    assert [round(x, 2) for x in col(spark, ["gaya", "shadow", "theek", "ya"], T.phonetic_score)] == [0.65, 0.40, 0.40, 0.45]


def test_three_languages_differ_from_four(spark):
    lex = Lexicons(english=frozenset({"shop"}))
    assert col(spark, ["shadow", "shop", "है", "zzz"], lambda x: T.language3(x, lex)) == ["HI", "EN", "HI", "UNK"]


def test_lexicon_by_rule():
    assert {"mera", "meri", "mere", "kitna", "rahi", "purane", "ka", "ki", "ke"} <= HINDI
    assert "achha" not in HINDI and "bohot" not in HINDI
    assert CANON["achha"] == "acha" and CANON["bohot"] == "bahut"
    assert all(VARIANTS[c] == c for c in VARIANTS.values())


@pytest.mark.parametrize("a, b", [("acha", "accha"), ("achha", "accha"), ("bahot", "bahut"), ("bohot", "bahut"), ("yar", "yaar"), ("nhi", "nahi"), ("kyu", "kyun"), ("thik", "theek"), ("accha", "accha"), ("theek", "theek")])
def test_phonetic_map(spark, a, b):
    assert col(spark, [a], lambda x: N.one(N.phonetic, x)) == [b]


def test_runs_and_endings(spark):
    assert col(spark, ["naaaa", "khaanaa", "deeeewana", "kkkk"], N.cap_runs) == ["naa", "khaanaa", "deewana", "kk"]
    lex = Lexicons(hindi=frozenset({"karaa", "laaa", "haaa", "aa"}), english=frozenset())
    assert col(spark, ["karaa", "laaa", "haaa", "aa"], lambda x: N.one(N.phonetic, x, lex=lex, canonical={})) == ["kara", "laa", "haa", "aa"]


def test_language_aware(spark):
    lex = Lexicons(english=frozenset("idk tbh u should go sooo so good".split()))
    df = spark.createDataFrame([("acha accha achha bahut bohot bohut",), ("idk tbh u should go",), ("Bohot ACHA 42 #acha @bohot :)",), (None,)], "text string")
    got = [r[0] for r in N.process(df, N.language_aware, lex=lex, expand_slang=True).select("processed_text").collect()]
    assert got[0] == "accha accha accha bahut bahut bahut"
    assert got[1] == "i do not know to be honest you should go"
    assert got[2] == "Bahut ACCHA 42 #acha @bohot:)"
    assert got[3] is None


def test_balanced(spark):
    targets = F.create_map(*[F.lit(x) for kv in {"acha": "अच्छा", "mein": "में", "yaar": "यार", "bahut": "बहुत"}.items() for x in kv])
    lex = Lexicons(english=frozenset({"movie", "main"}))
    got = col(spark, ["accha", "achha", "acha", "me", "men", "yar", "movie", "main", "bahuut", "42"], lambda x: N.balanced(x, targets, lex))
    assert got == ["अच्छा"] * 3 + ["में"] * 2 + ["यार", "movie", "main", "bahuut", "42"]


def test_missing_column(spark):
    with pytest.raises(ValueError, match="no column"):
        N.process(spark.range(1), N.phonetic)


def test_nfkc_only_touches_what_it_must(spark):
    assert col(spark, ["ﬁne", "plain", None], T.nfkc) == ["fine", "plain", None]
