"""Corpus metrics (M-1 to M-23; M-18 and its alias M-19 are in augment) as aggregations. Each works from per-row arrays or one token count, so the largest shuffle
is that of distinct tokens; results that leave Spark are of fixed size."""

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangam.functions import tokens as T
from sangam.functions.lexicon import DEFAULT, Lexicons
from sangam.session import written

EPS = 1e-12


def token_entropy(df: DataFrame, text_col: str) -> DataFrame:
    """M-2: entropy in bits of the lower-cased tokens; 0 without tokens. One pass: sum of c log c and the total."""
    counts = df.select(F.explode(T.split_words(F.col(text_col))).alias("tok")).groupBy("tok").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    # -sum p log2(p + eps) needs the total first; it is one row
    e = counts.join(F.broadcast(total)).select((-(F.col("c") / F.col("n")) * F.log2(F.col("c") / F.col("n") + EPS)).alias("e"))
    return e.agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("entropy"))


def vocabulary_size(df: DataFrame, text_col: str) -> DataFrame:
    """M-3: distinct tokens, case kept."""
    return df.select(F.explode(T.split_words(F.col(text_col), lower=False)).alias("tok")).agg(F.countDistinct("tok").alias("vocab_size"))


def language_counts(text: Column, lex: Lexicons = DEFAULT) -> tuple[Column, Column]:
    """Tokens that are English and Hindi (3 labels) of a text."""
    langs = F.transform(T.split_words(text, lower=False), lambda t: T.language3(t, lex))
    return F.size(F.filter(langs, lambda x: x == "EN")), F.size(F.filter(langs, lambda x: x == "HI"))


def balance_entropy(en: Column, hi: Column) -> Column:
    """M-13: entropy in bits of English against Hindi; null where there is neither."""
    n = en + hi

    def term(k):
        return F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0)

    return F.when(n > 0, term(en) + term(hi))


def fertility(df: DataFrame, id_col: str, text_col: str, lex: Lexicons = DEFAULT, *keep: str) -> DataFrame:
    """(id, n_en, n_hi, h_f) of every row with a text."""
    langs = F.transform(T.split_words(F.col(text_col), lower=False), lambda t: T.language3(t, lex))
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), *keep, langs.alias("langs"))
    n = lambda k: F.size(F.filter("langs", lambda x: x == k))
    return rows.select(id_col, *keep, n("EN").alias("n_en"), n("HI").alias("n_hi")).withColumn("h_f", balance_entropy(F.col("n_en"), F.col("n_hi")))


def quantiles(values: DataFrame, x: str, at: list[float], most: int = 100_000, bins: int = 4096) -> list[float | None]:
    """Exact quantiles with linear interpolation, without gathering the values: each pass counts `bins` ranges between two
    values that the wanted one lies between, until at most `most` rows are left there, which are then sorted.

    values: a written table; null and NaN do not count."""
    x_ = F.col(x).cast("double")
    rows = values.select(x_.alias("x")).where("x is not null and not isnan(x)")
    total = rows.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not total.n:
        return [None] * len(at)

    def nth(k: int) -> float:
        lo, hi, n = total.lo, total.hi, total.n
        while lo < hi and n > most:
            part = rows.where(F.col("x").between(lo, hi))
            step = (hi - lo) / bins
            # where doubles are too close for ranges there are few of them
            key = F.least(F.floor((F.col("x") - lo) / step), F.lit(bins - 1)) if step > 1e-300 else F.col("x")
            got = sorted((r.a, r.b, r.n) for r in part.groupBy(key.alias("k")).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n")).collect())
            for a, b, c in got:
                if k < c:
                    break
                k -= c
            if len(got) == 1 and (a, b) == (lo, hi):
                return float(lo if k == 0 else hi) if n == 2 else sorted(r.x for r in part.groupBy("x").count().collect())[0]
            lo, hi, n = a, b, c
        return float(lo) if lo == hi else sorted(r.x for r in rows.where(F.col("x").between(lo, hi)).collect())[k]

    out = []
    for q in at:
        place = q * (total.n - 1)
        k = math.floor(place)
        a = nth(k)
        out.append(a if place == k else a + (nth(k + 1) - a) * (place - k))
    return out


def describe(df: DataFrame, x: str) -> DataFrame:
    """M-14, one row: count, mean, median, deviation and variance of the population, corrected skewness and kurtosis."""
    rows = written(df.select(F.col(x).cast("double").alias(x)), "m14-values")
    n, c = F.count(x), F.col(x)
    g1, g2 = F.skewness(c), F.kurtosis(c)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))
    kurt = F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0))
    (median,) = quantiles(rows, x, [0.5])
    return rows.agg(n.alias("n"), F.avg(c).alias("mean"), F.lit(median).cast("double").alias("median"), F.stddev_pop(c).alias("std"), F.var_pop(c).alias("var"), skew.alias("skew"), kurt.alias("kurtosis"))


def histogram(df: DataFrame, x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n): values outside are dropped, the last bin is closed, empty bins are given."""
    b = F.least(F.floor((F.col(x) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    n = df.where(F.col(x).between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def switch_flags(text: Column, lex: Lexicons = DEFAULT) -> Column:
    """array<boolean> (M-17): a token whose label differs from its direct neighbour's before it, both known."""
    return label_changes(F.transform(T.split_words(text, lower=False), lambda t: T.language3(t, lex)))


def label_changes(langs: str | Column) -> Column:
    """Flags of an array of labels; give a column of the table, as its value is used several times."""
    langs = F.col(langs) if isinstance(langs, str) else langs
    before = F.concat(F.array(F.lit("UNK")), F.slice(langs, 1, F.greatest(F.size(langs) - 1, F.lit(0))))
    return F.when(F.size(langs) > 0, F.zip_with(langs, before, lambda a, b: (a != b) & (a != "UNK") & (b != "UNK"))).otherwise(F.array().cast("array<boolean>"))


def switch_points(df: DataFrame, id_col: str, text_col: str, lex: Lexicons = DEFAULT) -> DataFrame:
    """(id, n_tokens, n_switches)."""
    l = df.where(F.col(text_col).isNotNull()).select(id_col, F.transform(T.split_words(F.col(text_col), lower=False), lambda t: T.language3(t, lex)).alias("l"))
    f = l.select(id_col, label_changes("l").alias("f"))
    return f.select(id_col, F.size("f").alias("n_tokens"), F.size(F.filter("f", lambda x: x)).alias("n_switches"))


def retention(df: DataFrame, orig_col: str, proc_col: str, lex: Lexicons = DEFAULT, tolerance: float = 0.15) -> DataFrame:
    """M-20 per row: (n_orig, n_matched, ratio); first-fit one-to-one matching. Rows whose original has no switch have a null
    ratio and are no part of the metric; they are not filtered out here, as such a filter would be pushed down and compute
    all it rests on a second time."""

    langs = lambda c: F.transform(T.split_words(F.coalesce(c, F.lit("")), lower=False), lambda t: T.language3(t, lex))
    rows = df.select(langs(orig_col).alias("lo"), langs(proc_col).alias("lp")).select(label_changes("lo").alias("fo"), label_changes("lp").alias("fp"))
    at = lambda f: F.filter(F.transform(F.col(f), lambda x, i: F.when(x, i / F.size(F.col(f)))), lambda x: x.isNotNull())
    rows = rows.select(at("fo").alias("a"), at("fp").alias("b"))
    start = F.struct(F.col("b").alias("free"), F.lit(0).alias("hit"))

    def step(s, x):
        free = s["free"]
        first = F.array_position(F.transform(free, lambda y: F.abs(y - x) <= tolerance), True).cast("int")
        # the matched place is taken out
        rest = F.concat(F.slice(free, 1, F.greatest(first - 1, F.lit(0))), F.slice(free, first + 1, F.greatest(F.size(free) - first, F.lit(0))))
        return F.when(first > 0, F.struct(rest.alias("free"), (s["hit"] + 1).alias("hit"))).otherwise(F.struct(free.alias("free"), s["hit"].alias("hit")))

    hit = F.aggregate("a", start, step, lambda s: s["hit"])
    return rows.select(F.size("a").alias("n_orig"), hit.alias("n_matched")).withColumn("ratio", F.when(F.col("n_orig") > 0, F.col("n_matched") / F.col("n_orig")))


def retention_corpus(df: DataFrame, orig_col: str, proc_col: str, lex: Lexicons = DEFAULT) -> DataFrame:
    r = retention(df, orig_col, proc_col, lex)
    return r.agg(F.count("ratio").alias("n_rows"), F.coalesce(F.sum("n_orig"), F.lit(0)).alias("n_orig"), F.coalesce(F.sum("n_matched"), F.lit(0)).alias("n_matched"), F.avg("ratio").alias("mean_ratio"), F.try_divide(F.sum("n_matched"), F.sum("n_orig")).alias("spri"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def vector_stats(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """C-5: norm, mean and sample deviation of each vector."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(vec_col)
    rows = df.select(id_col, F.col(vec_col), norm(vec_col).alias("norm"), mean.alias("mean"))
    dev = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda s, x: s + (x.cast("double") - F.col("mean")) * (x.cast("double") - F.col("mean"))) / (F.size(vec_col) - 1))
    return rows.select(id_col, "norm", "mean", dev.alias("std"))


def stability_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """(c, e), written: cosine and euclidean distance of each pair of vectors; a pair that lacks one does not count."""
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b) + EPS)))
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(cos.alias("c"), F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)).alias("e"))
    return written(pairs, "m8-pairs")


def stability(df: DataFrame, a: str, b: str, pairs: DataFrame | None = None) -> DataFrame:
    """M-8 over pairs of vectors: cosine, euclidean and angular distance. The histogram of the cosines: histogram() of the pairs."""
    pairs = pairs if pairs is not None else stability_pairs(df, a, b)
    (median,) = quantiles(pairs, "c", [0.5])
    return pairs.agg(F.count("*").alias("n"), F.avg("c").alias("mean_cosine"), F.lit(median).cast("double").alias("median_cosine"), F.stddev_pop("c").alias("std_cosine"), F.min("c").alias("min_cosine"), F.max("c").alias("max_cosine"), F.avg("e").alias("mean_euclidean"), F.avg(F.acos("c")).alias("mean_angular"))


def centroids(df: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """(label, dim, value, n): element-wise means; one row per label and dimension."""
    x = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), F.posexplode(vec_col).alias("dim", "x"))
    return x.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"), F.count("*").alias("n"))


def centroid_distance(df: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """M-9: (label_a, label_b, euclidean, cosine) between class centroids, a few rows each."""
    c = centroids(df, vec_col, label_col)
    p = c.select("dim", F.col("label").alias("label_a"), F.col("value").alias("a")).join(c.select("dim", F.col("label").alias("label_b"), F.col("value").alias("b")), "dim").where("label_a < label_b")
    g = p.groupBy("label_a", "label_b")
    return g.agg(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("euclidean"), (F.sum(F.col("a") * F.col("b")) / (F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))))).alias("cosine"))


def cohesion(df: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """M-12: mean pairwise cosine inside each label, in closed form: no pair is made."""
    unit = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), norm(vec_col).alias("len"), F.col(vec_col).alias("v")).where("len > 0")
    x = unit.select("label", F.posexplode(F.transform("v", lambda y: y.cast("double") / F.col("len"))).alias("dim", "x"))
    s = x.groupBy("label", "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n")).groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return s.select("label", "n", F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1.0))).alias("cohesion"))


def sum_arrays(df: DataFrame, by: list[str], col: str, salts: int = 32) -> DataFrame:
    """Element-wise sums of equally long arrays; a row per partition and group goes in, an array per group comes out.

    Two rounds, the first by salted groups; each adds up as rows come and holds one array for each group."""

    def add(batches):
        import pyarrow as pa

        totals: dict = {}
        types = None
        for b in batches:
            types = [b.schema.field(i).type for i in range(len(by))]
            values = b.column(len(by))
            flat, off = values.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(np.diff(values.offsets.to_numpy())))
            for i, k in enumerate(zip(*(b.column(j).to_pylist() for j in range(len(by))))):
                v = flat[off[i] : off[i + 1]]
                totals[k] = totals[k] + v if k in totals else v.copy()
        if totals:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*totals), types)), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))], names=[*by, col])

    rows = df.select(*by, col)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).repartition("salt", *by).select(*by, col)
    return salted.mapInArrow(add, schema).repartition(*by).mapInArrow(add, schema)


def covariance(df: DataFrame, vec_col: str) -> tuple[np.ndarray, int]:
    """Covariance (ddof 1) by partial sums in the tasks: one d x d matrix per partition reaches the final sum."""

    def sums(batches):
        import pyarrow as pa

        g = None
        for b in batches:
            col = b.column(0)
            if not len(col):
                continue
            x = np.array(col.to_pylist(), np.float64)
            x1 = np.hstack([x, np.ones((len(x), 1))])
            g = x1.T @ x1 if g is None else g + x1.T @ x1
        if g is not None:
            n = g.shape[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, n * n + 1, n), pa.int32()), pa.array(g.ravel()))], names=["i", "v"])

    rows = df.where(F.col(vec_col).isNotNull()).select(vec_col).mapInArrow(sums, "i int, v array<double>")
    got = sum_arrays(rows, ["i"], "v").toArrow()
    if not got.num_rows:
        return np.zeros((0, 0)), 0
    g = np.zeros((got.num_rows, got.num_rows))
    g[got.column("i").to_numpy()] = np.array(got.column("v").to_pylist())
    rows, total = int(round(g[-1, -1])), g[-1, :-1]
    c = (g[:-1, :-1] - np.outer(total, total) / rows) / max(rows - 1, 1)
    return (c + c.T) / 2, rows


def spectrum(df: DataFrame, vec_col: str, exact_up_to: int = 2000, k: int = 50) -> DataFrame:
    """M-6/M-7: one row with entropy, condition number and decay of the covariance spectrum; beyond exact_up_to rows only the
    k largest values count."""
    c, rows = covariance(df, vec_col)
    spark = df.sparkSession
    schema = "n_rows long, embedding_dim int, n_values int, spectral_entropy double, condition_number double, decay double, top array<double>, cumulative array<double>"
    if rows < 2:
        return spark.createDataFrame([], schema)
    lam = np.sort(np.abs(np.linalg.eigvalsh(c)))[::-1]
    if rows > exact_up_to:
        lam = lam[: max(1, min(c.shape[0] - 1, k, rows - 1))]
    p = lam / lam.sum() if lam.sum() else lam
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    row = (rows, c.shape[0], len(lam), entropy, float(lam[0] / (lam[-1] + EPS)), float(p[0]), [float(x) for x in lam[:10]], [float(x) for x in np.cumsum(p)[:10]])
    return spark.createDataFrame([row], schema)


def tfidf_terms(df: DataFrame, text_col: str, max_features: int = 20000, pattern: str = r"[\p{L}\p{N}_]{2,}") -> DataFrame:
    """(term, df, n, idf): the max_features most frequent terms with smoothed idf."""
    toks = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(pattern), F.lit(0))
    docs = df.select(F.coalesce(toks, F.array().cast("array<string>")).alias("w"))
    n = df.agg(F.count("*").alias("n_docs"))
    # one pass: each occurrence, and each different term of a text once more
    each = F.concat(F.transform("w", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("df"))), F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("df"))))
    terms = docs.select(F.explode(each).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("n"), F.sum("x.df").alias("df")).orderBy(F.desc("n"), "term").limit(max_features)
    return terms.join(F.broadcast(n)).select("term", "df", "n", (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def term_label_mi(df: DataFrame, text_col: str, label_col: str, max_features: int = 20000) -> DataFrame:
    """M-4, discrete: mutual information in nats between the presence of each frequent term and the label."""
    rows = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("y"), F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("w"))
    ny = rows.groupBy("y").agg(F.count("*").alias("ny"))
    n = rows.agg(F.count("*").alias("n"))
    joint = rows.select("y", F.explode("w").alias("term")).groupBy("term", "y").agg(F.count("*").alias("c"))
    top = joint.groupBy("term").agg(F.sum("c").alias("nt")).orderBy(F.desc("nt"), "term").limit(max_features)
    # labels are few: every term meets every label so that absent combinations count
    grid = top.join(F.broadcast(ny)).join(joint, ["term", "y"], "left").join(F.broadcast(n)).select("term", "nt", "ny", "n", F.coalesce("c", F.lit(0)).alias("c"))

    def part(k, a, b):
        return F.when(k > 0, (k / F.col("n")) * F.log(k * F.col("n") / (a * b))).otherwise(0.0)

    with_, without = F.col("c"), F.col("ny") - F.col("c")
    return grid.groupBy("term").agg(F.max("nt").alias("df"), F.sum(part(with_, F.col("nt"), F.col("ny")) + part(without, F.col("n") - F.col("nt"), F.col("ny"))).alias("mi"))


def clip_scale(x: float | None, lo: float, hi: float, invert: bool = False) -> float | None:
    """M-21: x on [lo, hi] as [0, 1]; none for a missing value or an empty range."""
    if x is None or lo == hi:
        return None
    v = min(1.0, max(0.0, (x - lo) / (hi - lo)))
    return 1.0 - v if invert else v


#: M-22: term, range, inverted. The entropy of two languages has at most one bit (in parity mode ln 2).
TERMS = {"delta_mi": (-0.05, 0.05, True), "fertility_entropy": (0.0, 1.0, False), "crd": (0.0, 2.0, True), "stability": (-1.0, 1.0, False), "spectral_entropy": (0.0, 10.0, False), "spri": (0.0, 1.0, False)}


def composite(values: dict, weights: dict | None = None, embedding_dim: int | None = None, parity: bool = False) -> dict:
    """M-22: the weighted mean of the terms at hand, each on [0, 1]; missing ones do not count."""
    w = {k: 1 / len(TERMS) for k in TERMS}
    if weights:
        own = {k: v for k, v in weights.items() if k in TERMS}
        total = sum(own.values())
        w = {k: own.get(k, 0.0) / total for k in TERMS} if total else w
    out = {}
    for k, (lo, hi, inv) in TERMS.items():
        hi = math.log2(embedding_dim) if k == "spectral_entropy" and embedding_dim else math.log(2) if k == "fertility_entropy" and parity else hi
        out[k] = clip_scale(values.get(k), lo, hi, inv)
    used = sum(w[k] for k, v in out.items() if v is not None)
    return {"score": sum(v * w[k] for k, v in out.items() if v is not None) / used if used else None, "terms": out, "missing": [k for k, v in out.items() if v is None]}


def compare(old: dict, new: dict) -> dict:
    """M-23: percent change of each metric; none where the old value is missing or 0."""
    return {k: (new[k] - old[k]) / abs(old[k]) * 100 if old.get(k) and new.get(k) is not None else None for k in old}


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def _weights(ids: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """(rounds, rows): Poisson(1) weights that follow from each row's id alone, however the rows are partitioned."""
    mix, k = np.uint64(0x9E3779B97F4A7C15), np.arange(1, rounds + 1, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        h = ids.view(np.uint64)[None] * np.uint64(0xD6E8FEB86659FD93) + k * mix + np.uint64(seed)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(float) * 2.0**-53, "right")


def bootstrap_mean(df: DataFrame, x: str, rounds: int = 1000, seed: int = 0, id_col: str | None = None) -> DataFrame:
    """M-16: mean with a 95 % interval by the Poisson bootstrap: each row draws its own weights, so nothing is gathered.

    The weights follow from the row's id; without id_col, from its place in the table as it is read."""
    own = F.xxhash64(id_col) if id_col else F.monotonically_increasing_id()

    def sums(batches):
        import pyarrow as pa

        s, n = np.zeros(rounds), np.zeros(rounds)
        for b in batches:
            v, ids = b.column(0).to_numpy(zero_copy_only=False).astype(float), b.column(1).to_numpy(zero_copy_only=False)
            ok = ~np.isnan(v)
            v, ids = v[ok], ids[ok]
            for i in range(0, len(v), 1000):
                w = _weights(ids[i : i + 1000], rounds, seed)
                s += w @ v[i : i + 1000]
                n += w.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate([s, n]).tolist()], pa.list_(pa.float64()))], names=["k", "v"])

    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double"), own.alias("id")).mapInArrow(sums, "k int, v array<double>")
    halves = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda i: F.try_divide(F.get("v", i - 1), F.get("v", i + rounds - 1)))
    m = sum_arrays(rows, ["k"], "v").select(F.explode(halves).alias("m"))
    point = df.agg(F.avg(x).alias("mean"), F.count(x).alias("n"))
    return m.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).join(point).select("mean", "low", "high", "n")


def silhouette(df: DataFrame, vec_col: str, label_col: str, block: int = 4000) -> float | None:
    """M-11, euclidean and exact: every vector against all vectors. These are sent to the tasks in blocks of about `block`
    vectors, one pass over the table for each, in which every row adds up its distances by label; so memory is bounded for
    any table, while the work is quadratic by nature. None where labels are fewer than two, or none has two vectors."""
    rows = df.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(label_col).alias("y"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    size = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).limit(10_001).collect()}
    n = sum(size.values())
    if len(size) > 10_000:
        raise ValueError("more than 10,000 labels")
    if len(size) < 2 or n <= len(size):
        return None
    names = sorted(size)
    code = F.create_map(*[F.lit(x) for k, y in enumerate(names) for x in (y, k)])
    blocks = -(-n // block)
    start = F.array_repeat(F.lit(0.0), len(names))
    state = written(rows.select(code[F.col("y")].alias("c"), "v", F.pmod(F.xxhash64("v", F.monotonically_increasing_id()), F.lit(blocks)).alias("b"), start.alias("s")), "m11-rows")
    first = state
    for k in range(blocks):
        part = first.where(F.col("b") == k).select("c", "v").toArrow()
        if not part.num_rows:
            continue
        x, onehot = np.array(part.column("v").to_pylist()), np.eye(len(names))[part.column("c").to_numpy()]

        def add(batches, x=x, onehot=onehot):
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                v, s = np.array(b.column(1).to_pylist()), np.array(b.column(3).to_pylist())
                for i in range(0, len(v), 500):
                    own = v[i : i + 500]
                    d = np.sqrt(np.maximum((own**2).sum(1)[:, None] + (x**2).sum(1) - 2 * own @ x.T, 0))
                    near = d < 1e-6 * (1 + np.abs(own).max())  # cancellation: these few are computed as they are defined
                    for r, c in zip(*np.nonzero(near)):
                        d[r, c] = np.sqrt(((own[r] - x[c]) ** 2).sum())
                    s[i : i + 500] += d @ onehot
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["c", "v", "b", "s"])

        state = written(state.mapInArrow(add, "c int, v array<double>, b long, s array<double>"), "m11-rows")
    counts = F.array(*[F.lit(size[y]) for y in names])
    mine = F.get(counts, F.col("c"))
    a = F.get("s", F.col("c")) / (mine - 1)
    other = F.array_min(F.transform("s", lambda t, i: F.when(i != F.col("c"), t / F.get(counts, i))))
    score = F.when(mine > 1, F.try_divide(F.col("o") - F.col("a"), F.greatest("a", "o"))).otherwise(0.0)
    return state.select("c", F.when(mine > 1, a).alias("a"), other.alias("o")).select(F.coalesce(score, F.lit(0.0)).alias("x")).agg(F.avg("x")).first()[0]


def centroid_bootstrap(df: DataFrame, vec_col: str, label_col: str, a, b, rounds: int = 1000, seed: int = 0, id_col: str | None = None) -> DataFrame:
    """M-10: the distance between the centroids of two labels with a 95 % interval, by the Poisson bootstrap (weights as in
    bootstrap_mean). Each task gives one array for each label and round."""
    own = F.xxhash64(id_col) if id_col else F.monotonically_increasing_id()

    def sums(batches):
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            x, y, ids = np.array(batch.column(0).to_pylist(), float), np.array(batch.column(1).to_pylist()), batch.column(2).to_numpy(zero_copy_only=False)
            for side, label in enumerate((a, b)):
                at = np.flatnonzero(y == label) if len(x) else ()
                for i in range(0, len(at), 1000):
                    w = _weights(ids[at[i : i + 1000]], rounds, seed)
                    total[side] = total.get(side, 0) + np.hstack([w @ x[at[i : i + 1000]], w.sum(1)[:, None]])
        for side, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rounds, side), pa.int32()), pa.array(np.arange(rounds), pa.int32()), pa.array(t.tolist(), pa.list_(pa.float64()))], names=["side", "k", "v"])

    rows = df.where(F.col(vec_col).isNotNull() & F.col(label_col).isin(a, b)).select(vec_col, label_col, own.alias("id"))
    g = sum_arrays(rows.mapInArrow(sums, "side int, k int, v array<double>"), ["side", "k"], "v")
    g = g.select("side", "k", F.transform(F.slice("v", 1, F.size("v") - 1), lambda x: F.try_divide(x, F.element_at("v", -1))).alias("m"))
    both = g.where("side = 0").select("k", F.col("m").alias("p")).join(g.where("side = 1").select("k", F.col("m").alias("q")), "k")
    dist = both.select(norm(F.zip_with("p", "q", lambda x, y: x - y)).alias("crd"))
    return dist.agg(F.percentile("crd", F.lit(0.025)).alias("low"), F.percentile("crd", F.lit(0.975)).alias("high"), F.avg("crd").alias("mean"))
