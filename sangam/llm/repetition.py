"""Problem 9: repetition inside a document, by a hashed n-gram log-likelihood ratio.

Every run of four words is hashed into one of BINS bins, apart for runs that already occurred earlier in the document.
Two multinomials over these features are counted over all documents: the raw corpus, and the trusted target, i.e. the
documents without any repeated run. A document's score is the mean log-ratio target / raw of its features, so its length
plays no part; single ratios are held within -CLIP and CLIP, so that no rare or frequent bin outweighs the others.

Every document is thresholded by its score. As repeated runs score near -CLIP and new ones near 0, a score bounds the share s of
repeated runs: it lies between (1 - s) * (least ratio of a new run) + s * (least of a repeated one) and the same with the
largest. At or below `low` the share is certainly SHARE or more, and the document is repetitive; above `high` it is
certainly less, and it is not; low and high follow from the ratios alone. Only for a score between them (`checked`) the exact
share is looked at.

Defined results: a null or empty text has 0 words and share 0; a text of fewer than 4 words has no run and score 0; no
document is skipped, whatever its length; rows without an id are left out; where all documents are repetitive nothing is
trusted, the ratios say nothing and every document is checked.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.functions.words import words_key

from . import shingles as sh

BINS, RUN, SHARE, LEAST_WORDS, CLIP = 2048, 4, 0.35, 20, 3.0


def _features(column):
    """(bin of each run, row of each run, repeated?, words per row)"""
    values, off, row = sh.flat(column)
    h, ok = sh.runs(values, RUN), sh.starts(off, RUN, len(values))
    h, row = h[ok], row[: len(ok)][ok]
    order = np.lexsort((h, row))  # stable: the earliest run of equal ones comes first
    again = np.zeros(len(h), bool)
    if len(h):
        same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        again[order[1:]] = same
    return (h >> np.uint64(53)).astype(np.int64) + BINS * again, row, again, np.diff(off)


def ratios(df: DataFrame, text_col: str) -> np.ndarray:
    """log(target / raw) of each feature, smoothed; counted over all documents."""

    def count(batches):
        raw, target = np.zeros(2 * BINS, np.int64), np.zeros(2 * BINS, np.int64)
        for b in batches:
            f, row, again, n = _features(b.column(0))
            raw += np.bincount(f, minlength=2 * BINS)
            dirty = np.bincount(row[again], minlength=len(n)) > 0
            target += np.bincount(f[~dirty[row]], minlength=2 * BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * BINS), pa.int32()), pa.array(raw), pa.array(target)], names=["bin", "raw", "target"])

    rows = df.select(sh.word_hashes(F.col(text_col)).alias("w")).mapInArrow(count, "bin int, raw long, target long").groupBy("bin").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(2 * BINS), np.zeros(2 * BINS)
    for k, r, t in rows:
        raw[k], target[k] = r, t
    a = 0.5
    out = np.log((target + a) / (target.sum() + 2 * a * BINS)) - np.log((raw + a) / (raw.sum() + 2 * a * BINS))
    out = np.clip(out, -CLIP, CLIP)
    out[raw == 0] = np.nan
    return out


def bounds(w: np.ndarray) -> tuple[float, float]:
    """(low, high): documents that score at most `low` have a share of SHARE or more, those above `high` less."""
    new, again = w[:BINS], w[BINS:]
    if np.isnan(again).all() or np.isnan(new).all():
        return -np.inf, np.inf
    # a score is linear in the share, so its extremes over a range of shares are at the ends of the range
    high = max((1 - s) * np.nanmax(new) + s * np.nanmax(again) for s in (SHARE, 1.0))
    low = min((1 - s) * np.nanmin(new) + s * np.nanmin(again) for s in (0.0, SHARE))
    return low - 1e-9, high + 1e-9


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, share, llr, checked, repetitive) of every document."""
    w = ratios(df, text_col)
    (low, high), w = bounds(w), np.nan_to_num(w)

    def score(batches):
        for b in batches:
            f, row, again, n = _features(b.column(1))
            runs = np.bincount(row, minlength=len(n))
            llr = np.bincount(row, weights=w[f], minlength=len(n)) / np.maximum(runs, 1)
            share = np.bincount(row[again], minlength=len(n)) / np.maximum(runs, 1)
            checked = (llr >= low) & (llr <= high)
            flag = (n >= LEAST_WORDS) & ((llr < low) | (checked & (share >= SHARE)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(share), pa.array(llr), pa.array(checked), pa.array(flag)], names=["doc_id", "n_words", "share", "llr", "checked", "repetitive"])

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), sh.word_hashes(F.col(text_col)).alias("w")).mapInArrow(score, "doc_id long, n_words long, share double, llr double, checked boolean, repetitive boolean")


def unit_shares(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_share, line_share): the share of sentences and of lines that occurred before in the document."""

    def share(parts):
        units = F.filter(F.transform(parts, words_key), lambda s: s != "")
        return F.when(F.size(units) > 0, 1 - F.size(F.array_distinct(units)) / F.size(units)).otherwise(0.0)

    t = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), share(F.split(t, r"[.!?।॥\n\r]+")).alias("sentence_share"), share(F.split(t, r"[\n\r]+")).alias("line_share"))
