"""Seeded augmentation: code-switch variants (G-1 to G-9) and subword sampling (X-6).

Random numbers come from a hash of (seed, row id, slot, attempt), so the result does not depend on partitions or retries.
Labels and positions are Column expressions; Python only draws and substitutes, a batch of rows at a time.
"""

import random

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.functions import patterns as P
from sangam.functions import tokens as T
from sangam.functions.lexicon import DEFAULT, REPLACEMENTS, Lexicons

from .switches import context_multiplier, density as switch_rate, document_switches


def switch_density(labels) -> float:
    """Changes between content labels by content labels less one; 0 below two."""
    c = [x for x in labels if x != "SKIP"]
    return sum(a != b for a, b in zip(c, c[1:])) / (len(c) - 1) if len(c) > 1 else 0.0


def near_switch(labels, window: int) -> set[int]:
    at = [i for i, x in enumerate(labels) if x != "SKIP"]
    edges = [p for a, b in zip(at, at[1:]) if labels[a] != labels[b] for p in (a, b)]
    return {p for e in edges for p in range(max(0, e - window), min(len(labels), e + window + 1))}


def run_lengths(labels) -> list[int]:
    out, last, n = [], None, 0
    for x in labels:
        if x != "SKIP":
            n = n + 1 if x == last else 1
            last = x
        out.append(n)
    return out


def probability(base, i, near, runs, before, now, strategy, boost, damping, threshold, target) -> float:
    p = base
    if i in near:
        p = min(1.0, p * (1.0 + before * (boost - 1.0) if strategy == "adaptive" else boost))
    if runs[i] > threshold:
        p = max(0.0, p - (runs[i] - threshold) * damping)
    if target > 0:
        p = max(0.0, min(1.0, p * (1.0 + 2.0 * (target - now))))
    return p


def augment(
    df: DataFrame, id_col: str, text_col: str = "text", lex: Lexicons = DEFAULT, augmentation_probability=0.3, n_augments=1, max_attempts=5, preserve_original=True, random_seed=42,
    replacement_lexicon=None, target_switch_density=0.0, context_strategy="fixed", switch_boost=1.8, switch_window=3, mono_damping=0.07, mono_threshold=4, output_col="processed_text",
) -> DataFrame:
    """G-1: the input's columns, output_col and is_augmented: each original row and up to n_augments variants that differ.

    Variants keep the number and order of tokens; null and empty texts have none.
    """
    if not 0 <= augmentation_probability <= 1 or n_augments < 1 or max_attempts < 1 or context_strategy not in ("fixed", "adaptive"):
        raise ValueError("probability in [0, 1], counts of 1 or more, strategy fixed or adaptive")
    words = REPLACEMENTS if replacement_lexicon is None else replacement_lexicon
    words = {k.lower(): list(v) for k, v in words.items()}
    skip = lambda t: T.is_punctuation(t) | t.rlike(P.DIGITS) | t.rlike("^(?:" + P.PROTECTED + ")$") | t.rlike(P.PROPER)
    d = df.withColumn("__t", T.tokenize(T.nfkc(F.col(text_col))))
    d = d.withColumn("__l", F.transform("__t", lambda t: F.when(skip(t), "SKIP").otherwise(T.language4(t, lex))))

    def variants(ids, toks, labels):
        out = []
        for i, ts, ls in zip(ids, toks, labels):
            found = []
            eligible = [k for k, (t, x) in enumerate(zip(ts if ts is not None else (), ls if ls is not None else ())) if x == "EN" and t.lower() in words]
            if eligible:
                ts, ls = list(ts), list(ls)
                near, runs, before = near_switch(ls, switch_window), run_lengths(ls), switch_density(ls)
                for slot in range(n_augments):
                    for attempt in range(max_attempts):
                        r = random.Random(xxhash.xxh64_intdigest(f"{random_seed}|{i}|{slot}|{attempt}"))
                        new, now = list(ts), list(ls)
                        for k in eligible:
                            dens = switch_density(now) if target_switch_density > 0 else before
                            if r.random() < probability(augmentation_probability, k, near, runs, before, dens, context_strategy, switch_boost, mono_damping, mono_threshold, target_switch_density):
                                new[k], now[k] = r.choice(words[ts[k].lower()]), "HI_ROM"
                        if new != list(ts):
                            found.append(new)
                            break
            out.append(found)
        return out

    @F.pandas_udf("array<array<string>>")
    def draw(ids, toks, labels):
        import pandas as pd

        return pd.Series(variants(ids, toks, labels))

    # marked so that no filter inferred from the explosion draws a second time
    d = d.withColumn("__v", draw.asNondeterministic()(F.col(id_col).cast("string"), "__t", "__l"))
    made = d.withColumn("__x", F.explode("__v")).withColumn(output_col, T.reconstruct(F.col("__x"))).withColumn("is_augmented", F.lit(True)).drop("__t", "__l", "__v", "__x")
    if not preserve_original:
        return made
    return df.withColumn(output_col, F.col(text_col)).withColumn("is_augmented", F.lit(False)).unionByName(made)


def augmentation_stats(out: DataFrame, text_col: str = "text") -> DataFrame:
    """G-9: originals, variants and their yield."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a = out.agg(n(~F.col("is_augmented")).alias("originals"), n(F.col("is_augmented")).alias("variants"))
    return a.withColumn("augmentation_yield", F.when(F.col("originals") > 0, F.col("variants") / F.col("originals")).otherwise(0.0))


def replacement_stats(df: DataFrame, out: DataFrame, id_col: str, text_col: str = "text", output_col: str = "processed_text", n_augments: int = 1, lex: Lexicons = DEFAULT, replacement_lexicon: dict | None = None) -> DataFrame:
    """G-9 whole, one row: eligible texts and tokens, generated and skipped variants, replaced tokens, mean densities of
    switches before and after, and the rates. out: what augment gave for df."""
    words = sorted(k.lower() for k in (REPLACEMENTS if replacement_lexicon is None else replacement_lexicon))
    skip = lambda t: T.is_punctuation(t) | t.rlike(P.DIGITS) | t.rlike("^(?:" + P.PROTECTED + ")$") | t.rlike(P.PROPER)
    toks = T.tokenize(T.nfkc(F.col(text_col)))
    n = F.size(F.filter("t", lambda t: ~skip(t) & (T.language4(t, lex) == "EN") & F.lower(t).isin(words)))
    texts = df.select(toks.alias("t")).select(F.coalesce(F.when(n >= 0, n), F.lit(0)).alias("n"))
    a = texts.agg(F.count_if(F.col("n") > 0).alias("eligible_texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("eligible_tokens"))
    made = out.where("is_augmented").select(toks.alias("t"), T.tokenize(F.col(output_col)).alias("u"))
    changed = F.size(F.filter(F.zip_with("t", "u", lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    b = made.select(changed.alias("c")).agg(F.count("*").alias("generated"), F.coalesce(F.sum("c"), F.lit(0)).alias("replaced_tokens"))

    def dens(rows, col, name):
        d = document_switches(rows.withColumn("__n", F.monotonically_increasing_id()), "__n", col, lex)
        return d.agg(F.avg(switch_rate(F.col("switches"), F.col("content"))).alias(name))

    r = a.join(b).join(dens(out.where("is_augmented"), text_col, "density_before")).join(dens(out.where("is_augmented"), output_col, "density_after"))
    r = r.withColumn("skipped", F.col("eligible_texts") * n_augments - F.col("generated"))
    rate = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return r.withColumn("replacement_rate", rate(F.col("replaced_tokens"), F.col("eligible_tokens") * n_augments)).withColumn("augmentation_yield", rate(F.col("generated"), F.col("eligible_texts") * n_augments))


def split_by_hash(word: str, r: random.Random) -> list[str]:
    """A piece sampler that needs no model: cuts at random places. A SentencePiece model gives its own (see pieces_from)."""
    cuts = sorted(r.sample(range(1, len(word)), min(len(word) - 1, 1 + r.randrange(2)))) if len(word) > 1 else []
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]


def pieces_from(model_file: str, nbest: int = 64, alpha: float = 0.1):
    """Sampler over the pieces of a SentencePiece model; the file must be there on every worker."""
    hold: dict = {}

    def sample(word: str, r: random.Random) -> list[str]:
        import sentencepiece

        if "m" not in hold:
            hold["m"] = sentencepiece.SentencePieceProcessor(model_file=model_file)
        m = hold["m"]
        options = m.nbest_encode_as_pieces(word, nbest) or [m.encode_as_pieces(word)]
        weights = [(k + 1) ** -alpha for k in range(len(options))]
        return r.choices(options, weights)[0]

    return sample


def join_pieces(pieces: list[str], marker: str = "▁") -> str:
    """X-6c: pieces joined by the marker; the first one's own marker and bare markers go."""
    p = [x[len(marker) :] if i == 0 and x.startswith(marker) else x for i, x in enumerate(pieces)]
    return marker.join(x for x in p if x and x != marker)


def subword_sampling(
    df: DataFrame, id_col: str, text_col: str = "text", output_col: str = "processed_text", lex: Lexicons = DEFAULT, sampler=split_by_hash, hindi_dropout_prob=0.3, english_dropout_prob=0.05,
    perturb_devanagari=False, min_token_length=5, subword_marker="▁", random_seed=42, boundary_multiplier=1.5, stable_span_multiplier=0.7, unknown_multiplier=1.0, normalized: bool = False,
) -> DataFrame:
    """X-6: words are cut into pieces with a chance that depends on their language and on the labels around them."""
    d = df.withColumn("__t", T.tokenize(F.col(text_col) if normalized else T.nfkc(F.col(text_col)))).withColumn("__l", F.transform("__t", lambda t: T.language4(t, lex)))
    d = d.withColumn("__m", context_multiplier(F.col("__l"), boundary_multiplier, stable_span_multiplier, unknown_multiplier))
    ok = lambda t: ~t.rlike(P.DIGITS) & ~T.is_punctuation(t) & (F.length(t) >= min_token_length) & (F.lit(perturb_devanagari) | ~T.has_devanagari(t))
    base = lambda x: F.when(x.isin("HI_ROM", "HI_DEV"), hindi_dropout_prob).otherwise(english_dropout_prob)
    d = d.withColumn("__p", F.zip_with(F.zip_with("__t", "__l", lambda t, x: F.when(ok(t), base(x)).otherwise(0.0)), "__m", lambda p, m: F.least(p * m, F.lit(1.0))))

    @F.pandas_udf("array<string>")
    def draw(ids, toks, probs):
        import pandas as pd

        out = []
        for i, ts, ps in zip(ids, toks, probs):
            if ts is None:
                out.append(None)
                continue
            r = random.Random(xxhash.xxh64_intdigest(f"{random_seed}|{i}"))
            out.append([join_pieces(sampler(t, r), subword_marker) if p > 0 and r.random() < p else t for t, p in zip(ts, ps)])
        return pd.Series(out)

    return d.withColumn("__o", draw(F.col(id_col).cast("string"), "__t", "__p")).withColumn(output_col, T.reconstruct(F.col("__o"))).drop("__t", "__l", "__m", "__p", "__o")


def proxy_sprc(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """M-18: tokens(doc_id, pos, switch, vector) to one row: mean entropy of a token's similarity to the others of its text,
    at switches less elsewhere. A text is the unit; only texts with a switch count."""

    def group(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("pos")
        if not pdf["switch"].any() or len(pdf) < 2:
            return pd.DataFrame({"n_sp": [], "s_sp": [], "n_other": [], "s_other": []})
        x = np.array(pdf["vector"].tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
        n_sp = n_other = 0
        s_sp = s_other = 0.0
        sw = pdf["switch"].to_numpy()
        for a in range(0, len(x), 512):  # in blocks, so that a long text needs no full matrix
            c = np.clip(x[a : a + 512] @ x.T, 0, None)
            c[np.arange(len(c)), a + np.arange(len(c))] = 0
            total = c.sum(1)
            ok = total >= 1e-9
            p = c[ok] / total[ok, None]
            e = -(p * np.log2(p + 1e-12)).sum(1)
            w = sw[a : a + 512][ok]
            n_sp, s_sp, n_other, s_other = n_sp + int(w.sum()), s_sp + e[w].sum(), n_other + int((~w).sum()), s_other + e[~w].sum()
        return pd.DataFrame({"n_sp": [n_sp], "s_sp": [s_sp], "n_other": [n_other], "s_other": [s_other]})

    per = tokens.groupBy(id_col).applyInPandas(group, "n_sp long, s_sp double, n_other long, s_other double")
    a = per.agg(F.count("*").alias("n_texts"), F.sum("n_sp").alias("n_switch"), F.sum("n_other").alias("n_other"), (F.sum("s_sp") / F.sum("n_sp")).alias("at_switch"), (F.sum("s_other") / F.sum("n_other")).alias("elsewhere"))
    return a.withColumn("proxy_sprc", F.col("at_switch") - F.col("elsewhere"))


def spac(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """M-19: the former name of proxy_sprc, with its value once more as spac_score."""
    import warnings

    warnings.warn("spac is proxy_sprc now", DeprecationWarning, stacklevel=2)
    r = proxy_sprc(tokens, id_col)
    return r.withColumn("spac_score", F.col("proxy_sprc"))
