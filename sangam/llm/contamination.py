"""Problem 8: evaluation passages inside documents, by size-partitioned MinHash containment.

A passage of an item is to be found inside a document of any length. The resemblance of sets says how much of one lies in
the other only where both are of like size, so both sides are brought to sets of one size: an item needs `span` words in
a row, or `share` of its own words where that is more, and items are partitioned by the words they need (classes bounded by
powers of two). In each class the items and the documents are cut into windows of the class's least size; a window is the
set of its five-word shingles, and its signature two MinHashes, under independent permutations, which make one band.
Windows with equal bands are candidates. A shared passage makes two windows with equal shingle sets, hence equal bands:
nothing is missed.

Candidates are verified word by word: the run of equal words around them must be as long as the item needs. `scores` also
gives the containment of the item in the document, as estimated from the bands and exactly from the shingles.

The item index is broadcast while it has at most `max_index` windows, which is checked; beyond, a bitmap of the index's bands
(FILTER bits) drops the document windows without a band in it, and what is left is joined by a shuffle, with the same result.

Defined results: null, empty and short texts (fewer words than needed) contain nothing and are contained nowhere; a pair is given
once however often its passages occur; rows with one id count as texts of one document or item, each for itself; rows
without an id are left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.session import width, written

from . import shingles as sh

SPAN, SHINGLE, MAX_INDEX, FILTER = 12, 5, 500_000, 26
SECOND = np.uint64(0xD6E8FEB86659FD93)
WINDOW = "id long, class int, need int, band long, words binary"


def need(n_words, span: int, share: float):
    """Words in a row that items of so many words must share with a document."""
    return np.maximum(span, np.ceil(share * np.asarray(n_words) - 1e-9).astype(np.int64))


def bands(values: np.ndarray, size: int) -> np.ndarray:
    """The band of each window of `size` words: two MinHashes of its shingles as one number."""
    h = sh.runs(values, SHINGLE)
    with np.errstate(over="ignore"):
        other = sh.scramble(h * SECOND + sh.MIX)
        low, second = (sh.sliding_min(x, size - SHINGLE + 1) for x in (h, other))
        return sh.scramble(low * sh.MIX + second)


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), sh.word_hashes(F.col(text_col)).alias("w")).distinct()


def classes(words: DataFrame, span: int, share: float) -> list[int]:
    """The least sizes of the classes that have items: span times the powers of two, at most 64 numbers."""
    if share <= 0:
        return [span]
    n = F.greatest(F.lit(span), F.ceil(F.lit(share) * F.size("w") - 1e-9))
    k = F.floor(F.log2(n / F.lit(float(span))) + 1e-12)
    return sorted(span << int(r.k) for r in words.where(F.size("w") >= span).select(k.alias("k")).distinct().collect())


def item_windows(words: DataFrame, sizes: list[int], span: int, share: float) -> DataFrame:
    """WINDOW rows of every item: its class, the words it needs, a band and the words around it (as far as a run may reach)."""

    def cut(batches):
        for b in batches:
            values, off, _ = sh.flat(b.column(1))
            n = np.diff(off)
            wanted = need(n, span, share)
            cls = np.searchsorted(sizes, wanted, "right") - 1
            out = [[] for _ in range(5)]
            for r in np.flatnonzero((n >= wanted) & (cls >= 0)):
                w, size = values[off[r] : off[r + 1]], sizes[cls[r]]
                reach = int(wanted[r]) - size
                band = bands(w, size)
                for i, x in enumerate(band.view(np.int64).tolist()):
                    lo = max(0, i - reach)
                    out[0].append(b.column(0)[r].as_py())
                    out[1].append(int(size))
                    out[2].append(int(wanted[r]))
                    out[3].append(x)
                    out[4].append(np.append(np.uint64(i - lo), w[lo : i + size + reach]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["id", "class", "need", "band", "words"])

    return words.mapInArrow(cut, WINDOW)


def verified(doc: np.ndarray, at: int, size: int, passage: np.ndarray, least: int) -> bool:
    """Whether the passage (its window's place first) agrees with the document's window in `least` words in a row."""
    i, words = int(passage[0]), passage[1:]
    if not np.array_equal(doc[at : at + size], words[i : i + size]):
        return False
    have = size
    while have < least and at + have < len(doc) and i + have < len(words) and doc[at + have] == words[i + have]:
        have += 1
    back = 0
    while have + back < least and back < at and back < i and doc[at - back - 1] == words[i - back - 1]:
        back += 1
    return have + back >= least


class Index:
    """Windows of items by class and band."""

    def __init__(self, ids, cls, least, band, words):
        order = np.lexsort((ids, band, cls))
        self.ids, self.least, self.words = ids[order], least[order], words.take(pa.array(order))
        cls, self.band = cls[order], band[order]
        self.at = {int(c): (np.searchsorted(cls, c, "left"), np.searchsorted(cls, c, "right")) for c in np.unique(cls)}

    def search(self, values: np.ndarray, off: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of the documents' rows and the items they contain."""
        found = set()
        for size, (a, b) in self.at.items():
            band = bands(values, size)
            ok = sh.starts(off, size, len(values))
            own = self.band[a:b]
            hit = np.flatnonzero(ok & (own[np.minimum(np.searchsorted(own, band), len(own) - 1)] == band))
            first, last = np.searchsorted(own, band[hit], "left"), np.searchsorted(own, band[hit], "right")
            for h, lo, hi in zip(hit.tolist(), first.tolist(), last.tolist()):
                r = int(row[h])
                doc = values[off[r] : off[r + 1]]
                for k in range(a + lo, a + hi):
                    pair = r, int(self.ids[k])
                    if pair not in found and verified(doc, h - int(off[r]), size, np.frombuffer(self.words[k].as_buffer(), np.uint64), int(self.least[k])):
                        found.add(pair)
        got = np.array(sorted(found), np.int64).reshape(-1, 2)
        return got[:, 0], got[:, 1]


def doc_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), sh.word_hashes(F.col(text_col)).alias("w"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", max_index: int = MAX_INDEX, span: int = SPAN, share: float = 0.0) -> DataFrame:
    """(doc_id, item_id): the document contains `span` consecutive words of the item (or `share` of its words, if more)."""
    words = item_words(items, item_id, text_col)
    sizes = classes(words, span, share)
    windows = item_windows(words, sizes, span, share)
    head = windows.limit(max_index + 1).toArrow() if sizes else None
    if head is not None and head.num_rows > max_index:
        return _by_shuffle(doc_words(docs, doc_id, text_col), windows, sizes, docs).distinct()
    parts = () if head is None else (head.column("id").to_numpy(), head.column("class").to_numpy(), head.column("need").to_numpy(), head.column("band").to_numpy().view(np.uint64), head.column("words").combine_chunks())

    def find(batches):
        index = Index(*parts) if parts and len(parts[0]) else None
        for b in batches:
            if index is None:
                continue
            values, off, row = sh.flat(b.column(1))
            r, item = index.search(values, off, row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(item)], names=["doc_id", "item_id"])

    return doc_words(docs, doc_id, text_col).mapInArrow(find, "doc_id long, item_id long").distinct()


def _by_shuffle(docs: DataFrame, windows: DataFrame, sizes: list[int], source: DataFrame) -> DataFrame:
    """The pairs, by a join on the band of the document windows that pass a bitmap of the index's bands."""
    windows = written(windows, "p8-index")
    place = F.shiftrightunsigned("band", 64 - FILTER)
    bits = windows.groupBy(F.floor(place / 64).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(band, %d) %% 64 as int))" % (64 - FILTER))).alias("b")).toArrow()
    filled = np.zeros(1 << (FILTER - 6), np.uint64)
    filled[bits.column("k").to_numpy()] = bits.column("b").to_numpy().view(np.uint64)
    widest = 2 * sizes[-1]

    def cut(batches):
        for b in batches:
            values, off, row = sh.flat(b.column(1))
            for size in sizes:
                band = bands(values, size)
                p = band >> np.uint64(64 - FILTER)
                near = (filled[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
                at = np.flatnonzero(sh.starts(off, size, len(values)) & near)
                r = row[at]
                lo, hi = np.maximum(off[r], at - widest), np.minimum(off[r + 1], at + size + widest)
                words = [np.append(np.uint64(i - x), values[x:y]).tobytes() for i, x, y in zip(at.tolist(), lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(np.full(len(at), size, np.int32)), pa.array(band[at].view(np.int64)), pa.array(words, pa.binary())], names=["doc_id", "class", "band", "around"])

    def check(batches):
        for b in batches:
            d, size, i, least, mine, words = (b.column(k).to_pylist() for k in range(6))
            keep = []
            for k in range(len(d)):
                doc = np.frombuffer(mine[k], np.uint64)
                keep.append(verified(doc[1:], int(doc[0]), size[k], np.frombuffer(words[k], np.uint64), least[k]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["doc_id", "item_id"]).filter(pa.array(keep, pa.bool_()))

    cuts = docs.mapInArrow(cut, "doc_id long, class int, band long, around binary")
    pairs = cuts.join(windows.repartition(width(source), "class", "band"), ["class", "band"]).select("doc_id", "class", F.col("id").alias("item_id"), "need", "around", "words")
    return pairs.mapInArrow(check, "doc_id long, item_id long")


def _sketch(words: DataFrame, name: str, pairs: DataFrame) -> DataFrame:
    """(name, shingle, band?) of the rows that occur in pairs: every shingle, and whether it is the MinHash of a window."""

    def cut(batches):
        for b in batches:
            values, off, row = sh.flat(b.column(1))
            h, ok = sh.runs(values, SHINGLE), sh.starts(off, SHINGLE, len(values))
            low = sh.sliding_min(h, SPAN - SHINGLE + 1)
            inside = sh.starts(off, SPAN, len(values))
            key = np.unique(np.stack([row[: len(inside)][inside], low[inside].view(np.int64)]), axis=1) if len(inside) else np.zeros((2, 0), np.int64)
            every = np.unique(np.stack([row[: len(ok)][ok], h[ok].view(np.int64)]), axis=1) if len(ok) else np.zeros((2, 0), np.int64)
            mark = np.isin(every[1] * 31 + every[0], key[1] * 31 + key[0])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(every[0])), pa.array(every[1]), pa.array(mark)], names=[name, "shingle", "is_min"])

    rows = words.toDF(name, "w").join(pairs.select(name).distinct(), name, "left_semi")
    return rows.select(name, "w").mapInArrow(cut, f"{name} long, shingle long, is_min boolean").groupBy(name, "shingle").agg(F.max("is_min").alias("is_min"))


def scores(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, item_id, estimate, containment) of each leak: the share of the item's window minima, and of its different
    shingles, that the document has."""
    pairs = written(leaks(docs, items, doc_id, item_id, text_col, **kw), "p8-pairs")
    d = _sketch(doc_words(docs, doc_id, text_col), "doc_id", pairs)
    i = _sketch(item_words(items, item_id, text_col), "item_id", pairs)
    all_ = i.groupBy("item_id").agg(F.count("*").alias("n"), F.sum(F.col("is_min").cast("int")).alias("m"))
    both = pairs.join(i, "item_id").join(d.select("doc_id", "shingle", F.col("is_min").alias("dm")), ["doc_id", "shingle"])
    hit = both.groupBy("doc_id", "item_id").agg(F.count("*").alias("c"), F.sum((F.col("is_min") & F.col("dm")).cast("int")).alias("e"))
    return hit.join(all_, "item_id").select("doc_id", "item_id", (F.col("e") / F.col("m")).alias("estimate"), (F.col("c") / F.col("n")).alias("containment"))


def report(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """(item_id, benchmark, n_docs): every item that leaked, and into how many documents."""
    n = leaks(docs, items, **kw).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.select("item_id", "benchmark").distinct().join(n, "item_id")
