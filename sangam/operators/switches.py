"""Language switches: tagging (A-1), switch encoding (A-2), and the token-position features of augmentation and sampling.

There are four definitions of a switch on purpose: between raw neighbours that are both known (metrics, 3 labels); between
content tokens whatever their labels (tagging); between known content tokens, unknown ones transparent (encoding); between
content tokens with unknown ones counted and numbers and signs skipped (density). Positions are array indices, so a
document never leaves its row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangam.functions import patterns as P
from sangam.functions import tokens as T
from sangam.functions.lexicon import DEFAULT, Lexicons

TAGS = {"xml": ("<%s>", "</%s>"), "inline": ("", "|%s"), "prefix": ("[%s] ", ""), "suffix": ("", " [%s]")}
BOUNDARIES = {"xml": ("<SWITCH ", "→", ">"), "inline": ("|||", "→", "|||"), "special": ("<SWITCH_", "_", ">")}
MARKERS = {"special_token": ("[SWITCH_", "_", "]"), "xml": ('<SWITCH from="', '" to="', '"/>'), "inline": ("⟨", "→", "⟩")}


def labelled(text: Column, lex: Lexicons = DEFAULT, parity: bool = False) -> Column:
    """array<struct<tok, lang>>: lang is null for punctuation and numbers."""
    return F.transform(T.tokenize(text, parity), lambda t: F.struct(t.alias("tok"), F.when(T.is_content(t), T.language4(t, lex)).alias("lang")))


def let(x: Column, body) -> Column:
    """body(x), with x computed once however often it is named."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _shifted(xs: Column, first: Column) -> Column:
    """The elements one place later; the first place takes `first`."""
    return F.concat(F.array(first), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))))


def _gaps(counting: Column, total: Column) -> Column:
    """How many elements stand between each counting one and the next (or the end); counting: structs with their place `at`."""
    ends = F.concat(F.slice(F.transform(counting, lambda k: k["at"]), 2, F.greatest(F.size(counting), F.lit(1))), F.array(total))
    return F.zip_with(counting, F.slice(ends, 1, F.size(counting)), lambda k, e: e - k["at"] - 1)


def _walk(items: Column, counts_as: Column | None, emit) -> Column:
    """Output tokens of labelled tokens. emit(token, last) gives the array of output tokens of one that counts, from the label
    of the one before it; all others pass. Each token is copied once, whatever the text's length."""
    counts = lambda x: x["lang"].isNotNull() if counts_as is None else x["lang"].isNotNull() & (x["lang"] != counts_as)

    def body(v):
        plain = lambda a, n: F.transform(F.slice(v, a, n), lambda x: x["tok"])
        placed = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("at"), x["tok"].alias("tok"), x["lang"].alias("lang"))), counts)

        def known(k):
            last = _shifted(F.transform(k, lambda x: x["lang"]), F.lit(None).cast("string"))
            each = F.zip_with(F.zip_with(k, last, lambda x, l: F.struct(x.alias("x"), l.alias("last"))), _gaps(k, F.size(v)), lambda x, g: F.concat(emit(x["x"], x["last"]), plain(x["x"]["at"] + 2, g)))
            return F.when(F.size(k) > 0, F.concat(plain(F.lit(1), F.element_at(k, 1)["at"]), F.flatten(each))).otherwise(F.transform(v, lambda x: x["tok"]))

        return let(placed, known)

    return let(items, body)


def _marker(form: tuple[str, str, str], a: Column, b: Column) -> Column:
    return F.concat(F.lit(form[0]), a, F.lit(form[1]), b, F.lit(form[2]))


def tag_tokens(text: Column, lex: Lexicons = DEFAULT, tag_unknown=True, tag_format="xml", insert_boundary_markers=False, boundary_format="xml", parity=False) -> Column:
    """A-1: each content token with its language; optionally a marker where the label changes (unknown counts)."""
    if tag_format not in TAGS:
        raise ValueError(f"tag_format {tag_format!r} is none of {sorted(TAGS)}")
    if boundary_format not in BOUNDARIES:
        raise ValueError(f"boundary_format {boundary_format!r} is none of {sorted(BOUNDARIES)}")
    before, after = TAGS[tag_format]

    def side(form, lang):
        a, _, b = form.partition("%s")
        return F.concat(F.lit(a), lang, F.lit(b)) if "%s" in form else F.lit("")

    def emit(x, last):
        tagged = F.when(x["lang"].isNull() | ((x["lang"] == "UNK") & F.lit(not tag_unknown)), x["tok"]).otherwise(F.concat(side(before, x["lang"]), x["tok"], side(after, x["lang"])))
        if not insert_boundary_markers:
            return F.array(tagged)
        return F.when(last.isNotNull() & (last != x["lang"]), F.array(_marker(BOUNDARIES[boundary_format], last, x["lang"]), tagged)).otherwise(F.array(tagged))

    return _walk(labelled(text, lex, parity), None, emit)


def encode_tokens(text: Column, lex: Lexicons = DEFAULT, strategy="special_token", directional_markers=True, mark_unknown=False, switch_marker="[SWITCH]", parity=False) -> Column:
    """A-2: a marker before each content token whose label differs from the last one. Old markers are dropped first."""
    if strategy not in (*MARKERS, "generic"):
        raise ValueError(f"strategy {strategy!r} is none of {sorted([*MARKERS, 'generic'])}")

    def emit(x, last):
        mark = _marker(MARKERS[strategy], last, x["lang"]) if directional_markers and strategy in MARKERS else F.lit(switch_marker)
        return F.when(last.isNotNull() & (last != x["lang"]), F.array(mark, x["tok"])).otherwise(F.array(x["tok"]))

    clean = text if parity else F.regexp_replace(text, r"\s*(?:" + P.SWITCH_MARKER + ")", "")
    return _walk(labelled(clean, lex, parity), None if mark_unknown else F.lit("UNK"), emit)


def join_marked(toks: Column) -> Column:
    """Tokens as a text; markers and tagged tokens count as words."""
    return T.reconstruct(toks)


def positions(df: DataFrame, id_col: str, text_col: str, lex: Lexicons = DEFAULT, window: int = 3) -> DataFrame:
    """(id, pos, tok, lang, lang4, near, run, switches, content): one row per token, made from its own row without a shuffle.

    lang: EN, HI_ROM, HI_DEV, UNK or SKIP (punctuation, numbers, protected tokens and names); near: within `window` tokens of
    a change between content neighbours; run: length so far of the stretch in one label, which SKIP inherits.
    """
    skip = lambda t: T.is_punctuation(t) | t.rlike(P.DIGITS) | t.rlike("^(?:" + P.PROTECTED + ")$") | t.rlike(P.PROPER)
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(T.tokenize(F.col(text_col)), lambda t: F.struct(t.alias("tok"), T.language4(t, lex).alias("lang4"), skip(t).alias("skip"))).alias("v"))
    rows = rows.select("id", "v", F.filter(F.transform("v", lambda x, i: F.struct(i.alias("at"), x["lang4"].alias("lang"), x["skip"].alias("skip"))), lambda x: ~x["skip"]).alias("k"))
    # each content token with the one before it; a change of label between them
    before = _shifted(F.col("k"), F.lit(None))
    rows = rows.select("id", "v", "k", F.zip_with("k", before, lambda x, b: F.struct(x["at"].alias("at"), b["at"].alias("prev"), F.coalesce(b["lang"] != x["lang"], F.lit(False)).alias("change"))).alias("c"))
    starts = F.filter(F.transform("c", lambda x, j: F.when(x["change"] | (j == 0), j)), lambda j: j.isNotNull())
    edges = F.array_distinct(F.flatten(F.transform(F.filter("c", lambda x: x["change"]), lambda x: F.array(x["prev"], x["at"]))))
    rows = rows.select("id", "v", "k", starts.alias("s"), edges.alias("e"), F.size(F.filter("c", lambda x: x["change"])).alias("switches"), F.size("k").alias("content"))
    # content tokens count up within their stretch, and what follows each of them has its count
    lengths = F.zip_with("s", F.concat(F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), F.array(F.size("k"))), lambda a, b: b - a)
    ups = F.flatten(F.transform(F.slice(lengths, 1, F.size("s")), lambda n: F.sequence(F.lit(1), n)))
    runs = F.flatten(F.zip_with(ups, _gaps(F.col("k"), F.size("v")), lambda r, g: F.array_repeat(r, g + 1)))
    lead = F.when(F.size("k") > 0, F.element_at("k", 1)["at"]).otherwise(F.size("v"))
    # places between two edges are near if either edge is
    to = lambda a, b, f: F.when(b > a, F.transform(F.sequence(a, F.greatest(b - 1, a)), f)).otherwise(F.array().cast("array<boolean>"))
    n, m = F.size("v"), F.size("e")
    inner = F.flatten(F.zip_with(F.slice("e", 1, F.greatest(m - 1, F.lit(0))), F.slice("e", 2, F.greatest(m, F.lit(1))), lambda a, b: to(a, b, lambda p: (p - a <= window) | (b - p <= window))))
    near = F.when(m > 0, F.concat(to(F.lit(0), F.element_at("e", 1), lambda p: F.element_at("e", 1) - p <= window), inner, to(F.element_at("e", -1), n, lambda p: p - F.element_at("e", -1) <= window))).otherwise(F.array_repeat(F.lit(False), n))
    rows = rows.select("id", "v", "switches", "content", F.concat(F.array_repeat(F.lit(0), lead), runs).alias("run"), near.alias("near"))
    rows = rows.select("id", "switches", "content", F.posexplode(F.arrays_zip("v", "run", "near")).alias("pos", "x"))
    v = F.col("x.v")
    return rows.select("id", "pos", v["tok"].alias("tok"), F.when(v["skip"], "SKIP").otherwise(v["lang4"]).alias("lang"), v["lang4"].alias("lang4"), F.col("x.near").alias("near"), F.col("x.run").alias("run"), "switches", "content")


def document_switches(df: DataFrame, id_col: str, text_col: str, lex: Lexicons = DEFAULT) -> DataFrame:
    """(id, switches, content) of every text with a token: the totals of positions(), without its rows."""
    skip = lambda t: T.is_punctuation(t) | t.rlike(P.DIGITS) | t.rlike("^(?:" + P.PROTECTED + ")$") | t.rlike(P.PROPER)
    d = df.select(F.col(id_col).alias("id"), T.tokenize(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    d = d.select("id", F.transform(F.filter("t", lambda t: ~skip(t)), lambda t: T.language4(t, lex)).alias("l"))
    pairs = F.zip_with(F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))), F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))), lambda a, b: a != b)
    return d.select("id", F.size(F.filter(pairs, lambda x: x)).alias("switches"), F.size("l").alias("content"))


def density(switches: Column, content: Column) -> Column:
    """G-4: changes between content tokens by content tokens less one; 0 below two."""
    return F.when(content >= 2, switches / (content - 1)).otherwise(0.0)


def substitution_probability(lang: Column, near: Column, run: Column, dens: Column, base=0.3, strategy="fixed", boost=1.8, damping=0.07, threshold=4) -> Column:
    """G-7 without a density target: boosted near switches, damped inside long stretches."""
    factor = F.lit(boost) if strategy == "fixed" else 1 + dens * (boost - 1)
    p = F.when(near, F.least(F.lit(1.0), base * factor)).otherwise(F.lit(base))
    return F.when(run > threshold, F.greatest(F.lit(0.0), p - (run - threshold) * damping)).otherwise(p)


def context_multiplier(langs: Column, boundary=1.5, stable=0.7, unknown=1.0) -> Column:
    """X-6a for an array of labels: the nearest known label on either side differs (boundary), both agree (stable), or
    there is none to tell; unknown tokens themselves take `unknown`."""


    def placed(v):
        return F.struct(F.size(v).alias("n"), F.filter(F.transform(v, lambda x, i: F.struct(i.alias("at"), x.alias("lang"))), lambda x: x["lang"] != "UNK").alias("k"))

    # one after the other, not one inside the other: Spark takes no Python function out of nested functions
    def sides(s):
        n, k = s["n"], s["k"]
        langs = F.transform(k, lambda x: x["lang"])
        after = F.concat(F.slice(langs, 2, F.greatest(F.size(k), F.lit(1))), F.array(F.lit(None).cast("string")))
        pairs = F.zip_with(_shifted(langs, F.lit(None).cast("string")), F.slice(after, 1, F.size(k)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        def one(x, p):
            a, b = p["a"], p["b"]
            return F.when((a.isNotNull() & (a != x)) | (b.isNotNull() & (b != x)), boundary).when((a == x) & (b == x), stable).otherwise(unknown)

        each = F.zip_with(F.zip_with(langs, pairs, one), _gaps(k, n), lambda m, g: F.concat(F.array(m), F.array_repeat(F.lit(unknown), g)))
        return F.when(F.size(k) > 0, F.concat(F.array_repeat(F.lit(unknown), F.element_at(k, 1)["at"]), F.flatten(each))).when(k.isNotNull(), F.array_repeat(F.lit(unknown), n))

    return let(let(langs, placed), sides)


def transitions(df: DataFrame, text_col: str, lex: Lexicons = DEFAULT) -> DataFrame:
    """A-2c: (from_label, to_label, n) between known content tokens, unknown ones transparent."""
    langs = F.filter(F.transform(labelled(F.col(text_col), lex), lambda x: x["lang"]), lambda x: x.isNotNull() & (x != "UNK"))
    pairs = df.select(langs.alias("l")).select(F.explode(F.arrays_zip(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))).alias("a"), F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))).alias("b"))).alias("p"))
    return pairs.where("p.a <> p.b").groupBy(F.col("p.a").alias("from_label"), F.col("p.b").alias("to_label")).agg(F.count("*").alias("n"))


def tagging_stats(df: DataFrame, text_col: str, lex: Lexicons = DEFAULT, tag_unknown: bool = True) -> DataFrame:
    """A-1c: (total_tokens, content_tokens, tagged_tokens, boundaries, coverage, density) of a table. An aggregation, so that
    retried tasks do not count twice."""
    langs = F.transform(labelled(F.col(text_col), lex), lambda x: x["lang"])
    rows = df.where(F.col(text_col).isNotNull()).select(langs.alias("l")).select(F.size("l").alias("total"), F.filter("l", lambda x: x.isNotNull()).alias("c"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))))
    changes = F.when(F.size("c") > 1, F.size(F.filter(F.zip_with("c", before, lambda a, b: b.isNotNull() & (a != b)), lambda x: x))).otherwise(0)
    tagged = F.size(F.filter("c", lambda x: F.lit(tag_unknown) | (x != "UNK")))
    a = rows.select("total", F.size("c").alias("n"), tagged.alias("t"), changes.alias("s")).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(v) for k, v in (("total", "total_tokens"), ("n", "content_tokens"), ("t", "tagged_tokens"), ("s", "boundaries"))])
    return a.withColumn("coverage", F.round(F.col("tagged_tokens") / F.greatest("content_tokens", F.lit(1)), 4)).withColumn("density", F.round(F.col("boundaries") / F.greatest(F.col("content_tokens") - 1, F.lit(1)), 4))


def switch_stats(df: DataFrame, text_col: str, lex: Lexicons = DEFAULT) -> DataFrame:
    """A-2c: (total_tokens, content_tokens, switches, density): changes between known tokens, unknown ones transparent."""
    n = tagging_stats(df, text_col, lex).select("total_tokens", "content_tokens")
    s = transitions(df, text_col, lex).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("switches"))
    return n.join(s).withColumn("density", F.round(F.col("switches") / F.greatest(F.col("content_tokens") - 1, F.lit(1)), 4))
