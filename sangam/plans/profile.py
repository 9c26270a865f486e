"""The profile of an (original, processed) corpus (M-24): one driver dict of fixed size, each section kept apart from the
others' failures. Without Proxy-SPRC (M-18), which needs vectors of tokens."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.functions import tokens as T
from sangam.functions.lexicon import DEFAULT, Lexicons
from sangam.operators import metrics as M
from sangam.session import written


def _one(df: DataFrame) -> dict:
    r = df.first()
    return r.asDict() if r else {}


def profile(df: DataFrame, id_col: str, orig_col: str, proc_col: str, label_col: str | None = None, lex: Lexicons = DEFAULT, orig_vec: str | None = None, proc_vec: str | None = None, weights: dict | None = None, progress=None, sides: DataFrame | None = None) -> dict:
    """Sections: information, fertility, retention, spectral, stability, crd, composite. A missing label or vector leaves its
    section out. sides: (label, vector) of the distinct words of two languages, labels 0 and 1, for crd (M-9, M-10, M-12)."""
    if orig_col not in df.columns or proc_col not in df.columns:
        raise ValueError(f"no column {orig_col!r} or {proc_col!r}")
    out: dict = {}

    def section(name, percent, f):
        try:
            out[name] = f()
        except Exception as e:  # one metric's failure does not take the others along
            out[name] = {"error": f"{type(e).__name__}: {e}"[:500]}
        if progress:
            progress(percent, name)

    def information():
        a, b = (_one(M.token_entropy(df, c))["entropy"] for c in (orig_col, proc_col))
        va, vb = (_one(M.vocabulary_size(df, c))["vocab_size"] for c in (orig_col, proc_col))
        r = {"entropy_before": a, "entropy_after": b, "delta_entropy": b - a, "vocab_before": va, "vocab_after": vb}
        if label_col:
            mi = [_one(M.term_label_mi(df, c, label_col).agg(F.avg("mi").alias("m")))["m"] for c in (orig_col, proc_col)]
            r |= {"mi_before": mi[0], "mi_after": mi[1], "delta_mi": mi[0] - mi[1] if None not in mi else None}
        return r

    def fertility():
        r = {}
        for k, c in (("before", orig_col), ("after", proc_col)):
            h = M.fertility(df, id_col, c, lex)
            words = df.select(F.explode(F.transform(T.split_words(F.col(c), lower=False), lambda t: T.language3(t, lex))).alias("lang"))
            r[k] = _one(M.describe(h, "h_f")) | {"histogram": [x.n for x in M.histogram(h, "h_f", 0.0, 1.0, 10).orderBy("bin").collect()], "languages": {x.lang: x["count"] for x in words.groupBy("lang").count().collect()}}
        return r | {"bootstrap": _one(M.bootstrap_mean(h, "h_f", id_col=id_col))}

    def retention():
        return _one(M.retention_corpus(df, orig_col, proc_col, lex)) | {"bootstrap": _one(M.bootstrap_mean(M.retention(df, orig_col, proc_col, lex), "ratio"))}

    def crd():
        r = _one(M.centroid_distance(sides, "vector", "label").select("euclidean", "cosine"))
        return r | {"bootstrap": _one(M.centroid_bootstrap(sides, "vector", "label", 0, 1)), "cohesion": {x.label: x.cohesion for x in M.cohesion(sides, "vector", "label").collect()}, "silhouette": M.silhouette(sides, "vector", "label")}

    def stability():
        pairs = M.stability_pairs(df, orig_vec, proc_vec)
        return _one(M.stability(df, orig_vec, proc_vec, pairs)) | {"histogram": [x.n for x in M.histogram(pairs, "c", -1.0, 1.0, 20).orderBy("bin").collect()]}

    section("information", 20, information)
    section("fertility", 35, fertility)
    section("retention", 55, retention)
    if proc_vec:
        section("spectral", 70, lambda: _one(M.spectrum(df, proc_vec)))
    if orig_vec and proc_vec:
        section("stability", 82, stability)
    if sides is not None:
        section("crd", 90, crd)
    got = lambda s, k: out.get(s, {}).get(k)
    values = {"delta_mi": got("information", "delta_mi"), "fertility_entropy": (got("fertility", "after") or {}).get("mean"), "crd": got("crd", "euclidean"), "stability": got("stability", "mean_cosine"), "spectral_entropy": got("spectral", "spectral_entropy"), "spri": got("retention", "spri")}
    section("composite", 100, lambda: M.composite(values, weights, got("spectral", "embedding_dim")))
    return out


def profile_through_cache(df: DataFrame, id_col: str, orig_col: str, proc_col: str, cache, model: str, encode_fn, dim: int, model_col: str = "model_input_text", **kw) -> dict:
    """M-25: the profile with vectors through an EmbeddingCache. The spectral and stability sections read the text that goes
    into the model where there is one (model_col), all others the processed text. Null texts have no vector."""
    text = model_col if model_col in df.columns else proc_col

    def vectors(rows, col, name):
        v = cache.encode(rows, model, encode_fn, dim, col)
        return v.withColumn(name, F.when(F.col(col).isNotNull(), F.col("vector"))).drop("vector")

    rows = vectors(vectors(df.drop("vector"), orig_col, "__orig"), text, "__proc")
    return profile(written(rows, "m25-rows"), id_col, orig_col, proc_col, orig_vec="__orig", proc_vec="__proc", **kw)
