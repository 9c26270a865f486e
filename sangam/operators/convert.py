"""Script conversion (X-3, X-4, and the rule-based part of X-5): one Arrow function over token arrays, with a memo of words.

Labels are Column expressions; only the words to be converted go to Python.
"""

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangam.functions import indic
from sangam.functions import tokens as T
from sangam.functions.lexicon import DEFAULT, Lexicons

from .normalize import balanced, canonical_key

UNKNOWN = ("validate", "preserve", "transliterate")
CONFIDENCE = ("none", "lexicon", "roundtrip")


def _words(words: Column, convert) -> Column:
    """convert over array<string>; null stays null."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        one = lru_cache(maxsize=100_000)(convert)
        return s.map(lambda ws: [None if w is None else one(w) for w in ws], na_action="ignore")

    return run(words)


def transliterate_word(word: str, scheme="itrans", strategy="roundtrip", least=0.6, hindi=frozenset(), detect=False) -> str | None:
    """The word in Devanagari, or null if validation refuses it."""
    used = indic.detect_scheme(word) if detect else scheme
    out = indic.to_devanagari(word if used != "itrans" else word.lower(), used)
    if strategy == "lexicon" and word.lower() not in hindi:
        return None
    # the way back uses the configured scheme even where detection chose another
    if strategy == "roundtrip" and indic.similarity(word, indic.to_roman(out, scheme)) < least:
        return None
    return out


def transliteration_tokens(toks: Column, lex: Lexicons = DEFAULT, source_scheme="itrans", confidence_strategy="roundtrip", min_roundtrip_similarity=0.6, unknown_strategy="validate", heuristic_scheme_detection=False) -> tuple[Column, Column]:
    """X-4: (array of words to convert or null, function result). Devanagari, English and non-words pass."""
    if source_scheme not in indic.SCHEMES:
        raise ValueError(f"source_scheme {source_scheme!r} is none of {sorted(indic.SCHEMES)}")
    if confidence_strategy not in CONFIDENCE or unknown_strategy not in UNKNOWN:
        raise ValueError("unknown confidence_strategy or unknown_strategy")
    labels = ("HI_ROM",) if unknown_strategy == "preserve" else ("HI_ROM", "UNK")
    want = F.transform(toks, lambda t: F.when(T.language4(t, lex).isin(*labels) & t.rlike(r"^[\p{L}\p{M}]+$"), t))
    hindi = lex.hindi
    conv = _words(want, lambda w: transliterate_word(w, source_scheme, confidence_strategy, min_roundtrip_similarity, hindi, heuristic_scheme_detection))
    return want, conv


def transliteration(df: DataFrame, text_col: str = "text", output_col: str = "processed_text", normalized: bool = False, **kw) -> DataFrame:
    d = df.withColumn("__toks", T.tokenize(F.col(text_col) if normalized else T.nfkc(F.col(text_col))))
    _, conv = transliteration_tokens(F.col("__toks"), **kw)
    d = d.withColumn("__conv", conv).withColumn("__out", F.zip_with("__toks", "__conv", lambda t, c: F.coalesce(c, t)))
    return d.withColumn(output_col, T.reconstruct(F.col("__out"))).drop("__toks", "__conv", "__out")


def unify_word(word: str, target="devanagari", scheme="itrans", validate=True, threshold=2, keep_scheme=False, post=None) -> str | None:
    """A word in the target script, or null if the way back is more than `threshold` edits off."""
    post = post or {}
    if target == "devanagari":
        out = indic.to_devanagari(word.lower(), scheme)
        if validate and indic.levenshtein(word.lower(), indic.simplify_roman(indic.to_roman(out, scheme), keep_scheme)) > threshold:
            return None
        return out
    roman = indic.simplify_roman(indic.to_roman(word, scheme), keep_scheme)
    roman = post.get(roman, roman)
    # the way back always reads the everyday scheme
    if validate and indic.levenshtein(word, indic.to_devanagari(roman, "itrans")) > threshold + len(word) // 2:
        return None
    return roman


def script_unification(df: DataFrame, text_col: str = "text", output_col: str = "processed_text", lex: Lexicons = DEFAULT, target_script="devanagari", roman_scheme="itrans", require_lexicon_match=True, roman_post_map=None, preserve_scheme_differences=False, round_trip_validate=True, round_trip_threshold=2, allow_language_fallback=True, normalized: bool = False) -> DataFrame:
    """X-3: romanised Hindi to Devanagari, or Devanagari to roman; all other tokens pass."""
    if target_script not in ("devanagari", "roman"):
        raise ValueError(f"target_script {target_script!r} is neither devanagari nor roman")
    if roman_scheme not in ("itrans", "hk", "iast"):
        raise ValueError(f"roman_scheme {roman_scheme!r} is none of hk, iast, itrans")
    source = "HI_ROM" if target_script == "devanagari" else "HI_DEV"
    gate = lambda t: F.lower(t).isin(sorted(lex.hindi)) | F.lit(not require_lexicon_match or allow_language_fallback)
    d = df.withColumn("__toks", T.tokenize(F.col(text_col) if normalized else T.nfkc(F.col(text_col))))
    want = F.transform("__toks", lambda t: F.when((T.language4(t, lex) == source) & gate(t) & ~T.is_punctuation(t), t))
    conv = _words(want, lambda w: unify_word(w, target_script, roman_scheme, round_trip_validate, round_trip_threshold, preserve_scheme_differences, roman_post_map))
    d = d.withColumn("__conv", conv).withColumn("__out", F.zip_with("__toks", "__conv", lambda t, c: F.coalesce(c, t)))
    return d.withColumn(output_col, T.reconstruct(F.col("__out"))).drop("__toks", "__conv", "__out")


def balanced_tokenization(df: DataFrame, targets: Column, text_col: str = "text", output_col: str = "processed_text", lex: Lexicons = DEFAULT, transliterate_unknown=True, normalized: bool = False) -> DataFrame:
    """X-5: lexicon spellings, and a spelling by rule for Hindi-like words outside it."""
    d = df.withColumn("__toks", T.tokenize(F.col(text_col) if normalized else T.nfkc(F.col(text_col))))
    d = d.withColumn("__bal", F.transform("__toks", lambda t: F.when(T.is_punctuation(t), t).otherwise(balanced(t, targets, lex))))
    if transliterate_unknown:
        want = F.transform("__bal", lambda t: F.when((T.language4(t, lex) == "HI_ROM") & ~F.lower(t).isin(sorted(lex.english)), canonical_key(t)))
        d = d.withColumn("__conv", _words(want, lambda w: indic.to_devanagari(w, "itrans"))).withColumn("__bal", F.zip_with("__bal", "__conv", lambda t, c: F.coalesce(c, t))).drop("__conv")
    return d.withColumn(output_col, T.reconstruct(F.col("__bal"))).drop("__toks", "__bal")


def transliteration_stats(df: DataFrame, text_col: str = "text", lex: Lexicons = DEFAULT, **kw) -> DataFrame:
    """X-4c: one row of counts and rates; an aggregation, so that retried tasks do not count twice."""
    d = df.withColumn("__toks", T.tokenize(T.nfkc(F.col(text_col))))
    want, conv = transliteration_tokens(F.col("__toks"), lex, **kw)
    d = d.select("__toks", want.alias("w"), conv.alias("c")).select(F.explode(F.arrays_zip("__toks", "w", "c")).alias("x"))
    t = d.select(F.col("x.w").isNotNull().cast("int").alias("tried"), F.col("x.c").isNotNull().cast("int").alias("done"), T.is_content(F.col("x.__toks")).cast("int").alias("content"))
    a = t.agg(F.coalesce(F.sum("content"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("tried"), F.lit(0)).alias("candidates"), F.coalesce(F.sum("done"), F.lit(0)).alias("converted"))
    rate = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return a.withColumn("transliteration_rate", rate("converted", "candidates")).withColumn("rejection_rate", F.when(F.col("candidates") > 0, 1 - F.col("converted") / F.col("candidates")).otherwise(0.0)).withColumn("conversion_coverage", rate("converted", "tokens"))
