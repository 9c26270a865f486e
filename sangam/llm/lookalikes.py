"""Problem 5: one form for visually identical texts.

A text is composed canonically; full-width, half-width and ligature forms take their plain letters; ignorable
characters go; unusual spaces become blanks; vowel letters spelled as a letter and a sign become the one letter that
looks the same. Then every token that holds look-alike letters of another script is a lattice (each such letter, or its
Latin twin), and Viterbi picks the path with the best script-consistent character n-gram score. Case, punctuation, the
number of blanks and compatibility characters that look different (dots as one character, superscripts) stay.

Defined results: null stays null, empty stays empty; rows without an id have no partners; texts of any length are handled whole, token by token.
"""

import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangam.session import few, written

# Fixed values (letters whose usual glyphs are the same; Unicode confusables).
TWINS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ү": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I",
    "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J",
}
# Letters that are near twins only, read as Latin beside Latin letters but not by themselves.
NEAR = {"α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "η": "n", "τ": "t", "к": "k", "т": "t", "м": "m", "н": "h", "в": "b", "п": "n", "г": "r"}
# Spellings that the Unicode standard advises against, and the letter that looks the same.
SPELLINGS = {
    "अॆ": "ऄ", "अा": "आ", "र्इ": "ई", "उु": "ऊ", "एॅ": "ऍ", "एॆ": "ऎ", "एे": "ऐ",
    "अॉ": "ऑ", "आॅ": "ऑ", "अॊ": "ऒ", "आॆ": "ऒ", "अो": "ओ", "आे": "ओ", "अौ": "औ", "आै": "औ",
    "अॅ": "ॲ", "अऺ": "ॳ", "अऻ": "ॴ", "आऺ": "ॴ", "अॏ": "ॵ", "अॖ": "ॶ", "अॗ": "ॷ",
    "ाॅ": "ॉ", "ाॆ": "ॊ", "ाे": "ो", "ाै": "ौ",
    "অা": "আ", "ঋৃ": "ৠ", "ঌৢ": "ৡ", "ত্‍": "ৎ", "र्‍": "ऱ्", "அா": "ஆ",
}
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff"

_spell = re.compile("|".join(sorted(SPELLINGS, key=len, reverse=True)))
_tamil_au = re.compile("(ெ|ஒ)ள(?![ா-்ௗ])")
_ignore = re.compile(f"[{IGNORABLE}]+")
_space = re.compile("[   -   　]")
_compat = re.compile("[ﬀ-ﬆﬓ-ﬗ！-￯ĲĳǇ-ǌǱ-ǳ]+")
_lookalike = re.compile("[" + "".join(TWINS) + "".join(NEAR) + "]")
_token = re.compile(r"[^\W\d_]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_anchor = {"grek": re.compile("[Ͱ-Ͽἀ-῿]"), "cyrl": re.compile("[Ѐ-ԯ]")}
BINS = 27 * 27
#: Digests of texts (16 bytes) that are broadcast up to this number, and joined beyond.
BROADCAST_TEXTS = 500_000


def fold(text: str) -> str:
    """Everything but the lattice search."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFC", text)
    text = _compat.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = _spell.sub(lambda m: SPELLINGS[m.group()], text)
    text = _space.sub(" ", _ignore.sub("", text))
    text = _tamil_au.sub(lambda m: "ௌ" if m.group(1) == "ெ" else "ஔ", text)
    # what the deletions brought together may compose, or spell a letter, once more
    return unicodedata.normalize("NFC", _spell.sub(lambda m: SPELLINGS[m.group()], unicodedata.normalize("NFC", text)))


def bigram_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of the Latin letter bigrams (blank as edge) of all texts: 729 numbers, whatever the input's size."""
    import pyarrow as pa

    def count(batches):
        total = np.zeros(BINS, np.int64)
        code = np.zeros(256, np.int64)
        for i, c in enumerate(LETTERS, 1):
            code[ord(c)] = code[ord(c.upper())] = i
        for b in batches:
            col = b.column(0)
            col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_string())
            off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
            # a blank before each text and one at the end, so that no bigram spans two texts
            c = np.insert(code[raw], np.append(off[:-1] - off[0], len(raw)), 0)
            total += np.bincount(c[:-1] * 27 + c[1:], minlength=BINS) if len(c) > 1 else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS), pa.int32()), pa.array(total, pa.int64())], names=["bin", "n"])

    rows = df.select(F.col(text_col).alias("t")).where("t is not null").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BINS)
    for r in rows:
        out[r.bin] = r.n
    return out


class Lattice:
    """Viterbi over the readings of a token. Reading 0 keeps each letter, reading 1 takes its Latin twin.

    counts: Latin bigram counts of the corpus. A bigram of one other script scores as uniform over that script's letters
    and is worth its letters that have no twin (they anchor a token in its script); a change of script inside a token
    costs CHANGE.
    """

    CHANGE, OTHER = -12.0, math.log(1 / 40)

    def __init__(self, counts: np.ndarray):
        m = counts.reshape(27, 27) + 0.5
        self.latin = np.log(m / m.sum(1, keepdims=True)).tolist()
        self.memo: dict[str, str] = {}

    @staticmethod
    def script(ch: str) -> str:
        o = ord(ch)
        return "grek" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "cyrl" if 0x400 <= o < 0x530 else "latn"

    def score(self, a: str, b: str) -> float:
        sa, sb = (self.script(x) if x else None for x in (a, b))
        if sa and sb and sa != sb:
            return self.CHANGE
        if (sa or sb) == "latn":
            ia, ib = (LETTERS.find(unicodedata.normalize("NFD", x)[0].lower()) + 1 if x else 0 for x in (a, b))
            return self.latin[ia][ib]
        return self.OTHER

    def best(self, token: str, latin_text: bool) -> str:
        """latin_text: the text has Latin letters, or none at all that are bound to another script."""
        known = self.memo.get(key := token + ("1" if latin_text else "0"))
        if known is not None:
            return known
        near_too = any(self.script(c) == "latn" for c in token)
        # Script consistency with the text: where no letter binds the token to its script, keeping it there costs CHANGE.
        loose = latin_text and len(token) > 1 and all(self.script(c) == "latn" or c in TWINS or near_too and c in NEAR for c in token)
        stay = self.CHANGE if loose and any(c in TWINS for c in token) else 0.0
        steps = []
        for c in token:
            twin = TWINS.get(c) or (NEAR.get(c) if near_too else None)
            steps.append((c, twin) if twin else (c,))
        front = {"": (0.0, "")}
        for options in steps:
            after = {}
            for o in options:
                after[o] = max((s + self.score(prev, o) + (-2.0 if not latin_text and o != options[0] else 0.0) + (stay if len(options) > 1 and o == options[0] else 0.0), path + o) for prev, (s, path) in front.items())
            front = after
        s, path = max((s + self.score(prev, ""), p) for prev, (s, p) in front.items())
        if len(token) == 1 and token in TWINS and latin_text:
            path = TWINS[token]
        if len(self.memo) < 200_000:
            self.memo[key] = path
        return path

    def form(self, text: str) -> str:
        if text.isascii():
            return text
        text = fold(text)
        if not _lookalike.search(text):
            return text
        bound = sum(1 for c in text if "Ͱ" <= c < "԰" and c not in TWINS)
        latin_text = bound <= sum(1 for c in text if "A" <= c <= "z" and c.isalpha())
        return _token.sub(lambda m: self.best(m.group(), latin_text) if _lookalike.search(m.group()) else m.group(), text)


def form_col(text: Column, counts: np.ndarray) -> Column:
    """The one form of each text. ASCII texts are their own form and never leave the JVM."""
    table = counts.tolist()
    hold: dict = {}

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        lattice = hold.setdefault("l", None) or hold.__setitem__("l", Lattice(np.array(table))) or hold["l"]
        return s.map(lattice.form, na_action="ignore")

    return F.coalesce(form(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def normalised(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_id, form)."""
    counts = bigram_counts(df, text_col)
    return df.select(F.col(id_col).cast("long").alias("row_id"), form_col(F.col(text_col), counts).alias("form"))


def identical_pairs(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_id_a, row_id_b): rows whose stored texts differ and whose forms are equal.

    Pairs are made between the different texts of a form and then given their rows, so that copies of one text, however
    many, only meet rows they make a result with.
    """
    counts = bigram_counts(df, text_col)
    t = F.col(text_col)
    rows = df.where(t.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id"), F.unhex(F.md5(form_col(t, counts))).alias("f"), F.unhex(F.md5(t)).alias("t"))
    rows = written(rows, "p5-forms")
    # copies of a text are put together before texts meet, so that a text of a third of all rows is one row here
    texts = written(rows.groupBy("f", "t").agg(F.count("*").alias("n")), "p5-texts")
    several = texts.groupBy("f").agg(F.count("*").alias("k")).where("k > 1").select("f")
    texts = written(texts.join(several, "f", "left_semi").select("f", "t"), "p5-several")
    pairs = texts.select("f", F.col("t").alias("ta")).join(texts.select("f", F.col("t").alias("tb")), "f").where("ta < tb").select("ta", "tb")
    wanted = texts.select("t")
    members = rows.join(F.broadcast(wanted) if few(wanted, BROADCAST_TEXTS) else wanted, "t", "left_semi")
    a = members.select(F.col("t").alias("ta"), F.col("row_id").alias("a"))
    b = members.select(F.col("t").alias("tb"), F.col("row_id").alias("b"))
    return pairs.join(a, "ta").join(b, "tb").select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"))
