"""Model-side metrics without a model: labels, nearest centroids, classification reports (C-1, C-6, C-7, C-9)."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import norm

# Label names and ids.
LABELS = {"negative": 0, "neutral": 1, "positive": 2}


def coerce_label(x: Column) -> Column:
    """C-1: 0, 1 or 2 from a number, its digits or a name; else null."""
    s = F.lower(F.trim(x.cast("string")))
    named = F.create_map(*[F.lit(v) for kv in LABELS.items() for v in kv])[s]
    number = s.try_cast("double")
    return F.coalesce(named, F.when(number.isin(0.0, 1.0, 2.0), number.cast("int")))


def label_or_sentiment(label: Column, sentiment: Column) -> Column:
    return F.coalesce(coerce_label(label), coerce_label(sentiment))


def confusion(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    return df.where(F.col(true_col).isNotNull() & F.col(pred_col).isNotNull()).groupBy(F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label")).agg(F.count("*").alias("n"))


def report(conf: DataFrame) -> DataFrame:
    """C-6: (label, precision, recall, f1, support); where a share has nothing to divide by it is 0."""
    hit = conf.where("true_label = pred_label").select(F.col("true_label").alias("label"), F.col("n").alias("tp"))
    support = conf.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("support"))
    said = conf.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("said"))
    t = support.join(said, "label", "full").join(hit, "label", "left").na.fill(0, ["tp", "support", "said"])
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    t = t.select("label", p.alias("precision"), r.alias("recall"), "support")
    return t.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)).select("label", "precision", "recall", "f1", "support")


def summary(rep: DataFrame, conf: DataFrame) -> DataFrame:
    """Accuracy and macro-F1 over the labels that occur as true ones."""
    acc = conf.agg((F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return acc.join(rep.where("support > 0").agg(F.avg("f1").alias("macro_f1")))


#: The centroid table is labels x dimensions; more labels than this are refused.
MAX_LABELS = 10_000


def leave_one_out(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """C-7: (id, true_label, pred_label): the nearest class centroid by cosine, a row's own vector taken out of its class.

    Class sums are one row per label, bounded by MAX_LABELS, and go to the tasks as one matrix; every row keeps its own result,
    also where ids repeat. Ties go to the lower label; a class left empty is skipped; without any class the prediction is null.
    """
    rows = df.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("true_label"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    per = rows.select("true_label", F.posexplode("v").alias("d", "x")).groupBy("true_label", "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    sums = per.groupBy("true_label").agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("s"), F.max("n").alias("n")).limit(MAX_LABELS + 1).collect()
    if len(sums) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    sums.sort(key=lambda r: r.true_label)
    names, count = [r.true_label for r in sums], np.array([r.n for r in sums], float)
    total = np.array([[x.s for x in r.s] for r in sums])
    place = {y: k for k, y in enumerate(names)}

    def nearest(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            y = np.array([place[v] for v in b.column(1).to_pylist()])
            x = np.array(b.column(2).to_pylist())
            at, length = np.arange(len(y)), np.sqrt((x * x).sum(1))
            scores = (x @ total.T / count) / (length[:, None] * np.sqrt((total * total).sum(1)) / count + 1e-8)
            p, k = total[y] - x, count[y] - 1
            with np.errstate(invalid="ignore", divide="ignore"):
                scores[at, y] = np.where(k > 0, ((x * p).sum(1) / k) / (length * np.sqrt((p * p).sum(1)) / k + 1e-8), -np.inf)
            best = scores.argmax(1)
            pred = [names[c] if scores[i, c] > -np.inf else None for i, c in enumerate(best)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, b.schema.field(1).type)], names=["id", "true_label", "pred_label"])

    kind = rows.schema["true_label"].dataType.simpleString()
    return rows.mapInArrow(nearest, f"id {rows.schema['id'].dataType.simpleString()}, true_label {kind}, pred_label {kind}")


def top_rows(df: DataFrame, id_col: str, k: int) -> DataFrame:
    """The first k rows by id: the deterministic form of a row limit (C-9)."""
    return df.orderBy(id_col).limit(k)


# What gives a control token away.
SWITCH_SIGNS = ("SWITCH", "DEV:", "TR:", "<EN", "<HI", "<UNK")


def has_switch_marker(tokens: Column) -> Column:
    """C-3: whether any token of an array is a control marker."""
    return F.exists(tokens, lambda t: t.rlike("|".join(SWITCH_SIGNS)))


def mean_pool(vectors: Column, mask: Column, dim: int) -> Column:
    """C-2: the mean of the vectors whose mask is 1, by at least 1e-9."""
    zero = F.array_repeat(F.lit(0.0), dim)
    pairs = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(pairs, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return F.transform(total, lambda x: x / n)


def encode(df: DataFrame, text_col: str, encoder, output_col: str = "vector") -> DataFrame:
    """C-8: encoder (a list of texts to a list of vectors) over Arrow batches; it is loaded once per worker by itself. Null
    texts get no vector."""
    import pandas as pd

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        known = s[s.notna()].tolist()
        vectors = iter(encoder(known) if known else [])
        return pd.Series([list(map(float, next(vectors))) if h else None for h in s.notna()], index=s.index, dtype=object)

    return df.withColumn(output_col, run(F.col(text_col)))


# The encoders that results are reported for, by key: display name and model name.
ENCODERS = {
    "xlmr": ("XLM-R", "xlm-roberta-base"),
    "muril": ("MuRIL", "google/muril-base-cased"),
    "nllb": ("NLLB", "facebook/nllb-200-distilled-600M"),
    "indicbert": ("IndicBERT", "ai4bharat/indic-bert"),
    "mbert": ("mBERT", "bert-base-multilingual-cased"),
}


class Encoders:
    """C-10, C-11, P-12: encoders by key, loaded when first asked for and once per process. loader: (model name) to an encoder, a
    function from texts to vectors; nothing is fetched by itself. It may be sent to workers, each of which loads its own."""

    _loaded: dict = {}

    def __init__(self, loader, registry: dict | None = None):
        self.loader, self.registry = loader, dict(registry or ENCODERS)

    def _key(self, key: str):
        if key not in self.registry:
            raise KeyError(f"{key!r} is none of {sorted(self.registry)}")
        return self.registry[key][1], getattr(self.loader, "__qualname__", repr(self.loader))

    def get(self, key: str):
        k = self._key(key)
        if k not in Encoders._loaded:
            Encoders._loaded[k] = self.loader(k[0])
        return Encoders._loaded[k]

    def unload(self, key: str | None = None) -> None:
        for k in [self._key(key)] if key else [self._key(x) for x in self.registry]:
            Encoders._loaded.pop(k, None)

    def status(self) -> dict[str, bool]:
        return {x: self._key(x) in Encoders._loaded for x in self.registry}

    def encoder(self, key: str):
        """The encoder as a function that loads itself where it runs, for encode() and EmbeddingCache."""
        self._key(key)
        return lambda texts: self.get(key)(texts)


def evaluate_texts(df: DataFrame, text_col: str, encoder) -> DataFrame:
    """C-8: each row with n_tokens, n_chars, has_switch_marker, vector, its norm, mean and deviation; a null text has 0 tokens and no vector."""
    from sangam.functions import tokens as T

    t = F.col(text_col)
    toks = T.split_words(F.coalesce(t, F.lit("")), lower=False)
    rows = encode(df, text_col, encoder).withColumn("n_tokens", F.size(toks)).withColumn("n_chars", F.coalesce(F.length(t), F.lit(0))).withColumn("has_switch_marker", has_switch_marker(toks))
    mean = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x) / F.size("vector")
    rows = rows.withColumn("norm", norm("vector")).withColumn("mean", F.when(F.size("vector") > 0, mean))
    return rows.withColumn("std", F.when(F.size("vector") > 0, F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("vector"))))


def summarize(df: DataFrame, id_col: str, text_col: str, encoder, sample_limit: int = 1000) -> dict:
    """C-9: averages over the first sample_limit rows by id, and the report of leave-one-out centroids on coerced labels."""
    rows = encode(top_rows(df, id_col, sample_limit), text_col, encoder)
    label = label_or_sentiment(F.col("label") if "label" in df.columns else F.lit(None), F.col("sentiment") if "sentiment" in df.columns else F.lit(None))
    rows = rows.withColumn("__y", label).persist()
    try:
        conf = confusion(leave_one_out(rows, id_col, "vector", "__y"), "true_label", "pred_label")
        rep = report(conf)
        stats = rows.where("vector is not null").agg(F.count("*").alias("n"), F.avg(norm("vector")).alias("mean_norm"), F.avg(F.length(text_col)).alias("mean_chars")).first().asDict()
        return stats | summary(rep, conf).first().asDict() | {"per_class": [r.asDict() for r in rep.orderBy("label").collect()], "confusion": [r.asDict() for r in conf.orderBy("true_label", "pred_label").collect()]}
    finally:
        rows.unpersist()
