"""Tokens and their languages, as Column expressions."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .lexicon import BIGRAMS, CLUES, DEFAULT, SUFFIXES, THRESHOLD, Lexicons


def nfkc(text: Column) -> Column:
    """Compatibility composition; ASCII texts never leave the JVM."""

    @F.pandas_udf("string")
    def norm(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.coalesce(norm(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def tokenize(text: Column, parity: bool = False) -> Column:
    """Hierarchical tokens: URLs, e-mails, tags, mentions, numbers, contractions, words, single signs."""
    return F.regexp_extract_all(text, F.lit(P.token_pattern(parity)), F.lit(0))


def split_words(text: Column, lower: bool = True) -> Column:
    """Tokens between blanks, as the corpus metrics count them."""
    t = F.lower(text) if lower else text
    return F.filter(F.split(t, P.SPLIT), lambda x: x != "")


def is_punctuation(tok: Column) -> Column:
    return tok.rlike(P.PUNCTUATION)


def is_content(tok: Column) -> Column:
    """Neither punctuation nor a number: what tagging and switch encoding look at."""
    return ~is_punctuation(tok) & ~tok.rlike(P.DIGITS)


def has_devanagari(tok: Column) -> Column:
    return tok.rlike(P.DEVANAGARI)


def phonetic_score(tok: Column) -> Column:
    """How much a word of unknown language sounds like Hindi, 0 to 1."""
    t = F.lower(tok)
    vowels = F.length(F.regexp_replace(t, "[^aeiou]", "")) / F.length(t)
    s = F.when(t.rlike("|".join(BIGRAMS)), 0.30).otherwise(0.0) + F.when(t.rlike("(?:" + "|".join(SUFFIXES) + ")$"), 0.25).otherwise(0.0)
    s = s + F.when(vowels.between(0.25, 0.55), 0.10).otherwise(0.0) - F.when(F.length(t) <= 2, 0.20).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(s, F.lit(1.0)))


def language4(tok: Column, lex: Lexicons = DEFAULT) -> Column:
    """HI_DEV, HI_ROM, EN or UNK."""
    t = F.lower(tok)
    return (
        F.when(has_devanagari(tok), "HI_DEV")
        .when(t.isin(sorted(lex.hindi)), "HI_ROM")
        .when((F.length(t) >= lex.english_min_len) & t.isin(sorted(lex.english)), "EN")
        .when(t.rlike(P.ALPHA) & (phonetic_score(tok) >= THRESHOLD - 1e-9), "HI_ROM")
        .otherwise("UNK")
    )


def confidence4(tok: Column, lex: Lexicons = DEFAULT) -> Column:
    t = F.lower(tok)
    known = has_devanagari(tok) | t.isin(sorted(lex.hindi)) | ((F.length(t) >= lex.english_min_len) & t.isin(sorted(lex.english)))
    return F.when(known, 1.0).when(language4(tok, lex) == "HI_ROM", phonetic_score(tok)).otherwise(0.0)


def language3(tok: Column, lex: Lexicons = DEFAULT) -> Column:
    """HI, EN or UNK: the looser classifier of the corpus metrics. A different function from language4 on purpose."""
    t = F.lower(tok)
    return F.when(has_devanagari(t), "HI").when(t.isin(sorted(lex.hindi)), "HI").when(t.isin(sorted(lex.english)), "EN").when(t.rlike(P.ALPHA) & t.rlike("|".join(CLUES)), "HI").otherwise("UNK")


def is_hindi(t: Column, lex: Lexicons = DEFAULT) -> Column:
    """T-5: whether a token is Hindi in either script; false for null."""
    return F.coalesce(language4(t, lex).isin("HI_DEV", "HI_ROM"), F.lit(False))


def reconstruct(tokens: Column) -> Column:
    """Tokens as a text: closing signs and quotes attach to the left, opening brackets to the right."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))))

    def piece(t, last):
        spaced = F.concat(F.lit(" "), t)
        word = F.when(last.isin("(", "[", "{"), t).otherwise(spaced)
        return F.when(last.isNull(), t).when(is_punctuation(t), F.when(t.isin("(", "[", "{"), spaced).otherwise(t)).otherwise(word)

    return F.when(F.size(tokens) > 0, F.trim(F.array_join(F.zip_with(tokens, before, piece), ""))).otherwise(F.when(tokens.isNotNull(), ""))


def staged(items: Column, *steps) -> Column:
    """Fields of each element of an array, step by step: a step takes an element's fields and gives more of them.

    Each step is a pass of its own, so that what a later field uses several times is computed once.
    """
    def run(items, step, old):
        def one(x):
            new = step(lambda n: x[n]) if old else step(x)
            return F.struct(*[x[n].alias(n) for n in old], *[c.alias(n) for n, c in new.items()])

        return F.transform(items, one)

    names: list[str] = []
    for step in steps:
        items = run(items, step, tuple(names))
        names += (step(lambda n: F.lit("")) if names else step(F.lit(""))).keys()
    return items


def map_tokens(df: DataFrame, text: Column, output_col: str, f, parity: bool = False, preserve_punctuation: bool = True) -> DataFrame:
    """Tokenize, change the tokens that are no punctuation, reconstruct. f: array of tokens to array of tokens.

    Each step is a column of its own: an expression that several others use would be computed by each of them.
    """
    d = df.withColumn("__text", text).withColumn("__toks", tokenize(F.col("__text"), parity))
    if not preserve_punctuation:
        d = d.withColumn("__toks", F.filter("__toks", lambda t: ~is_punctuation(t)))
    d = d.withColumn("__out", F.zip_with("__toks", f(F.col("__toks")), lambda t, o: F.when(is_punctuation(t), t).otherwise(o)))
    return d.withColumn(output_col, reconstruct(F.col("__out"))).drop("__text", "__toks", "__out")
