"""Lexicon tables (S-4, S-5): roman to Devanagari in layers, English words."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sangam.functions import tokens as T
from sangam.functions.lexicon import DEFAULT, Lexicons
from sangam.session import few

#: A lexicon that is used as a literal map has at most so many entries; a larger one is joined (balanced_texts).
MAX_ENTRIES = 100_000


def layered(df: DataFrame) -> DataFrame:
    """(roman, target): keys lower-cased and stripped, the highest layer with a target wins."""
    k = df.select(F.lower(F.trim("roman")).alias("roman"), "target", "layer").where("roman <> '' and target is not null")
    return k.groupBy("roman").agg(F.max_by("target", F.struct("layer", "target")).alias("target"))


def as_map(df: DataFrame) -> Column:
    """The lexicon as a literal map; refused beyond MAX_ENTRIES, for which balanced_texts joins."""
    rows = layered(df).orderBy("roman").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a lexicon of more than {MAX_ENTRIES} entries must be joined")
    if not rows:
        return F.from_json(F.lit("{}"), "map<string,string>")
    return F.create_map(*[F.lit(x) for r in rows for x in (r.roman, r.target)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon file: JSON {roman: target}, or CSV of at least two columns. A missing file raises FileNotFoundError."""
    import os

    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    if path.endswith(".json"):
        text = spark.read.text(path, wholetext=True)
        m = F.from_json("value", "map<string,string>")
        if text.select(m.alias("m")).where("m is null").limit(1).count():
            raise ValueError("the JSON lexicon is not an object")
        return text.select(F.explode(m).alias("roman", "target")).withColumn("layer", F.lit(1))
    df = spark.read.csv(path)
    if len(df.columns) < 2:
        raise ValueError("a CSV lexicon has at least two columns")
    return df.select(F.col(df.columns[0]).alias("roman"), F.col(df.columns[1]).alias("target"), F.lit(1).alias("layer"))


def english(spark: SparkSession, path: str) -> DataFrame:
    """S-5: (word) of an English word list, a word a line, lower-cased, each once. A missing list is a LookupError: nothing is
    fetched."""
    from .cache import _at

    fs, p = _at(spark, path)
    if not fs.exists(p):
        raise LookupError(f"no English word list at {path}; put one there, a word a line")
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def english_flags(tokens: DataFrame, tok_col: str, words: DataFrame, min_len: int = 1) -> DataFrame:
    """The tokens with is_english, by a join on the word: broadcast while the list is few, which is counted. words has each
    word once (see english)."""
    known = words.select(F.col("word").alias("__word"), F.lit(True).alias("__known"))
    j = tokens.join(F.broadcast(known) if few(known, MAX_ENTRIES) else known, F.lower(F.col(tok_col)) == F.col("__word"), "left")
    return j.withColumn("is_english", F.coalesce("__known", F.lit(False)) & (F.length(tok_col) >= min_len)).drop("__word", "__known")


def balanced_texts(df: DataFrame, id_col: str, lexicon: DataFrame, text_col: str = "text", output_col: str = "processed_text", lex: Lexicons = DEFAULT) -> DataFrame:
    """X-5 with a lexicon of any size: the different tokens of all texts take their spelling by joins, broadcast while the
    lexicon is few, and go back to their places. Rows are told apart by id_col, which must be unique; null stays null."""
    from sangam.operators import normalize as N

    toks = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.posexplode(T.tokenize(F.col(text_col))).alias("__pos", "__tok"))
    t = F.col("__tok")
    short = F.regexp_replace(t, r"(.)\1{2,}", "$1$1")
    low = F.lower(short)
    own = low.isin(sorted(lex.english)) & (F.length(low) >= lex.english_min_len)
    keys = toks.select("__tok").distinct().select("__tok", short.alias("__short"), N.canonical_key(short).alias("__key"), low.alias("__low"), F.when(T.is_content(t), F.when(own, F.lit(2)).otherwise(1)).otherwise(0).alias("__kind"))
    entries = layered(lexicon)
    entries = F.broadcast(entries) if few(entries, MAX_ENTRIES) else entries
    side = lambda name, to: entries.select(F.col("roman").alias(name), F.col("target").alias(to))
    done = keys.join(side("__key", "__a"), "__key", "left").join(side("__low", "__b"), "__low", "left")
    done = done.select("__tok", F.when(F.col("__kind") == 1, F.coalesce("__a", "__b", "__short")).when(F.col("__kind") == 2, F.col("__short")).otherwise(F.col("__tok")).alias("__new"))
    back = toks.join(done, "__tok").groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__new"))), lambda x: x["__new"]).alias("__toks"))
    out = df.join(back, F.col(id_col) == F.col("__id"), "left")
    return out.withColumn(output_col, F.when(F.col(text_col).isNotNull(), F.coalesce(T.reconstruct(F.col("__toks")), F.lit("")))).drop("__id", "__toks")
