"""Spelling operators (X-1, X-2, X-5) as token functions, and as table operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangam.functions import patterns as P
from sangam.functions import tokens as T
from sangam.functions.lexicon import CANON, CANONICAL, DEFAULT, PROTECTED, SLANG, VARIANTS, VARIANTS_PARITY, Lexicons


def lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])


def cap_runs(t: Column) -> Column:
    """Runs of three or more equal vowels, or of other letters, become two (X-1a)."""
    return F.regexp_replace(F.regexp_replace(t, r"([aeiouAEIOU])\1{2,}", "$1$1"), r"([^aeiouAEIOU])\1{2,}", "$1$1")


def compress(t: Column, n: int = 2) -> Column:
    """Runs of more than n equal characters become n (X-2b)."""
    return F.regexp_replace(t, r"(.)\1{%d,}" % n, "$1" * n)


def phonetic(toks: Column, lex: Lexicons = DEFAULT, normalize_repetitions=True, normalize_phonetics=True, preserve_english_intensity=True, canonical=None, protected=PROTECTED, parity=False) -> Column:
    """X-1 over an array of tokens: romanised Hindi to its canonical sound. In intended mode a word of the map is eligible
    whatever its label."""
    canonical = CANONICAL if canonical is None else canonical
    safe = sorted(protected)

    def first(t):
        lang = T.language4(t, lex)
        hindi = lang == "HI_ROM"
        if not parity and canonical:
            hindi = hindi | F.lower(t).isin(sorted(canonical))
        return {"t": t, "english": lang == "EN", "hindi": hindi, "m": F.coalesce(lookup(canonical)[F.lower(t)], t) if canonical else t}

    def second(x):
        return {"capped": cap_runs(x("m")) if normalize_repetitions else x("m")}

    def third(x):
        capped = x("capped")
        final = F.when(F.lower(capped).isin(safe), capped).otherwise(F.regexp_replace(capped, "(?<=[a-z]{3})aa$", "a")) if normalize_phonetics else capped
        english = x("t") if preserve_english_intensity or not normalize_repetitions else cap_runs(x("t"))
        return {"out": F.when(x("hindi"), F.when(F.lower(x("m")).isin(safe), x("m")).otherwise(final)).when(x("english"), english).otherwise(x("t"))}

    return F.transform(T.staged(toks, first, second, third), lambda x: x["out"])


def match_case(source: Column, target: Column) -> Column:
    """The source's capitals, if it is all upper case or a capitalised word (X-2e)."""
    cased = F.lower(source) != F.upper(source)
    title = F.concat(F.upper(F.substring(target, 1, 1)), F.lower(F.substring(target, 2, 1 << 20)))
    return F.when(cased & (source == F.upper(source)), F.upper(target)).when(cased & (source == F.initcap(source)), title).otherwise(target)


def language_aware(toks: Column, lex: Lexicons = DEFAULT, normalize_english=True, normalize_hindi=True, normalize_unknown=False, expand_slang=False, preserve_sentiment_intensity=False, sentiment_repeat_limit=3, vowel_repeat_limit=1, variants=None, slang=None, parity=False) -> Column:
    """X-2 over an array of tokens: spelling rules by language. In parity mode romanised Hindi passes unchanged, as its branch
    is never taken."""
    variants = (VARIANTS_PARITY if parity else VARIANTS) if variants is None else variants
    slang = SLANG if slang is None else slang
    limit = min(sentiment_repeat_limit - 1, 2) if preserve_sentiment_intensity else vowel_repeat_limit
    words = sorted(lex.hindi)

    def first(t):
        return {"t": t, "few": compress(t, sentiment_repeat_limit if preserve_sentiment_intensity else 2), "lang": T.language4(t, lex), "same": t.rlike(P.DIGITS) | t.rlike(P.ARTIFACT)}

    def second(x):
        return {"low": F.lower(x("few")), "short": F.regexp_replace(x("few"), r"([aeiouAEIOU])\1{%d,}" % limit, "$1" * limit)}

    def third(x):
        fixed = x("short")
        for pattern, to in P.REPAIRS:
            fixed = F.regexp_replace(fixed, pattern, to)
        known = F.coalesce(lookup(variants)[x("low")], lookup(variants)[F.lower(x("short"))]) if variants else F.lit(None).cast("string")
        return {"known": known, "fixed": fixed}

    def last(x):
        t, few, low, short, lang = x("t"), x("few"), x("low"), x("short"), x("lang")
        # canonical words of the lexicon keep their doubled vowels
        hindi = F.when(x("known").isNotNull(), match_case(t, x("known"))).when(low.isin(words), few).when(F.lower(short).isin(words), match_case(t, F.lower(short))).otherwise(x("fixed"))
        english = F.coalesce(lookup(slang)[low], few) if expand_slang and slang else few
        is_hindi = F.lit(False) if parity else (lang == "HI_ROM") | ((lang == "UNK") & low.isin(sorted(variants)))
        out = F.when(is_hindi, hindi if normalize_hindi else t).when(lang == "EN", english if normalize_english else t).when(lang == "UNK", few if normalize_unknown else t).otherwise(t)
        return {"out": F.when(x("same"), t).otherwise(out)}

    return F.transform(T.staged(toks, first, second, third, last), lambda x: x["out"])


def one(f, t: Column, **kw) -> Column:
    """A function over arrays of tokens for a single token."""
    return F.element_at(f(F.array(t), **kw), 1)


def canonical_key(t: Column) -> Column:
    """X-5a: the key under which a romanised word stands in the lexicon."""
    return F.coalesce(lookup(CANON)[F.lower(t)], F.lower(t))


def balanced(t: Column, targets: Column, lex: Lexicons = DEFAULT, parity=False) -> Column:
    """X-5: Devanagari spelling by lexicon. targets: a map column roman to Devanagari; English words pass first.

    Words outside the lexicon pass unchanged here; convert.transliterate_words gives them a spelling by rule.
    """
    short = F.regexp_replace(t, r"(.)\1{2,}", "$1$1")
    low = F.lower(short)
    found = F.coalesce(targets[canonical_key(short)], targets[low])
    english = low.isin(sorted(lex.english)) & (F.length(low) >= lex.english_min_len)
    return F.when(t.rlike(P.DIGITS), t).when(english, short).otherwise(F.coalesce(found, short))


def process(df: DataFrame, f, text_col: str = "text", output_col: str = "processed_text", parity: bool = False, normalized: bool = False, **kw) -> DataFrame:
    """T-10: a table with the text changed token by token; normalized: it is composed already. Null stays null (in parity mode it is the text nan)."""
    if text_col not in df.columns:
        raise ValueError(f"no column {text_col!r}; there are {df.columns}")
    text = F.col(text_col)
    if parity:
        text = F.coalesce(text, F.lit("nan"))
    return T.map_tokens(df, text if normalized else T.nfkc(text), output_col, lambda toks: f(toks, **kw), parity)
