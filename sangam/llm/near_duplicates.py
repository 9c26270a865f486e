"""Problem 3: groups of slightly edited texts, by BK-trees over set sketches.

Similarity is the Jaccard index of the sets of words, at least 3/4, of texts with at least 12 different words.

1. Sketch. Each word flips one of 64 bits. Two sets that differ in k words have sketches at most k bits apart, and sets of
   a and b words reach the threshold only if they differ in at most (a + b) / 7 words. So the search radius (a + b) // 7
   loses no pair.
2. Shards. Words are ordered by how often they occur (counts in BINS bins, a table of fixed size; the order needs no exact
   counts). Two sets over the threshold share one of their rarest words within a prefix whose length follows from their
   sizes, and their first m common words within that prefix plus m - 1. A shard is such a word; where a word is frequent,
   the shard is the first two, three or four common words, so that shards stay small.
3. Trees. The shorter sets of a shard form a BK-tree (children keyed by their distance to the parent); each longer set
   searches it along the edges within its radius. A shard that is still large is cut into a grid of blocks, each with
   its own tree, which is sent to every block of searching sets.
4. Candidates are verified on the word sets themselves.

Trees are built where their shard's sets meet, after a shuffle, and not broadcast as a whole: together they grow with the
table, and no bound holds for them. What is broadcast has one: bin counts, heavy keys, up to BROADCAST_IDS ids.

Sets, not rows, are compared: copies meet once. Rows of one set, canonical record and form are a class; links are found
between classes, and pairs of rows are made from them at the very end.

Defined results: null, empty and short texts (under 12 different words) and rows without an id have no partners; rows with
one id and one text count once, those with one id and several texts as one row each; texts with equal word sets are
partners unless they are copies up to formatting (problem 6) or look the same (problem 5), as any other pair is.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.functions.words import words_col
from sangam.session import few, width, written

from . import shingles as sh
from .formatting_duplicates import is_list, list_key
from .lookalikes import bigram_counts, form_col

LEAST, BITS = 12, 20
BINS = 1 << BITS
#: A shard of one word holds at most SHARD sets; a block of a large shard about HOT.
SHARD, HOT, DEEPEST = 96, 8192, 4
#: Sets with LONG words or more use shards of one word only (their prefixes are too long for combinations).
LONG = 97
#: Ids up to this many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Heavy keys (16 bytes each) that are sent to the tasks, and set ids that a task remembers.
MOST_HEAVY, SEEN = 1 << 20, 1 << 19


def base_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, h, c1, c2, o1, s1, w), written: hashes of the text, of the word set, of the words in order, of a list's sorted fields; the set.

    Short texts are dropped after writing: a filter on the words before it would make them a second time.
    """
    t = F.col(text_col)
    words = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(t).alias("h"), words_col(t).alias("words"), F.when(is_list(t), F.xxhash64(F.split(list_key(t), " "))).alias("s1"))
    rows = words.select("row_id", "h", "s1", F.xxhash64("words").alias("o1"), F.array_sort(F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))).alias("set"))
    rows = rows.select("row_id", "h", "s1", "o1", F.when(F.size("set") >= LEAST, F.col("set")).alias("w"))
    rows = rows.select("row_id", "h", F.xxhash64("w").alias("c1"), F.xxhash64(F.lit("2"), F.col("w")).alias("c2"), "o1", "s1", "w")
    return written(rows, "p3-base").where("w is not null")


def _bin(h: np.ndarray) -> np.ndarray:
    return (sh.scramble(h) >> np.uint64(64 - BITS)).astype(np.int64)


def word_counts(base: DataFrame) -> np.ndarray:
    """Occurrences of words by bin, over all rows: BINS numbers whatever the input."""

    def count(batches):
        total = np.zeros(BINS, np.int64)
        for b in batches:
            total += np.bincount(_bin(sh.flat(b.column(0))[0]), minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bin", "n"])

    return _collect_bins(base.select("w").mapInArrow(count, "bin int, n long"))


def _collect_bins(counts: DataFrame) -> np.ndarray:
    got = counts.groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BINS, np.int64)
    out[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return out


def _key(parts: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(parts[0]), salt, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = sh.scramble(h * sh.MIX + p)
    return h


def _among_keys(key: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array `heavy`."""
    return heavy[np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)] == key if len(heavy) else np.zeros(len(key), bool)


def _entries(column, counts: np.ndarray, total: int, heavy: np.ndarray):
    """(key, row, roles, n per row, sketch per row) of a batch; roles: 1 searches (longer set), 2 is searched, 3 both.

    heavy: the sorted keys that hold too many sets and are made deeper by one word.
    """
    values, off, row = sh.flat(column)
    n = np.diff(off)
    bit = np.uint64(1) << (sh.scramble(values) & np.uint64(63))
    sketch = np.bitwise_xor.reduceat(bit, off[:-1]) if len(values) else np.zeros(0, np.uint64)
    c = counts[_bin(values)]
    order = np.lexsort((values, c, row))
    values, c = values[order], c[order]
    probe, index = n - -(-3 * n // 4) + 1, n - -(-6 * n // 7) + 1
    out: list[tuple] = []

    def emit(rows, roles, key):
        out.append((key, rows, roles))

    # sets that may meet a long one: one-word shards
    for r in np.flatnonzero(n * 4 >= 3 * LONG):
        long = n[r] >= LONG
        p = probe[r] if long else index[r]
        v, cc = values[off[r] : off[r] + p], c[off[r] : off[r] + p]
        roles = np.where(np.arange(p) < index[r], 3 if long else 2, 1)
        k = cc > 1
        emit(np.full(k.sum(), r), roles[k], _key([v[k]], 1))
    short = np.flatnonzero(n < LONG)
    if len(short):
        width = int(probe[short].max()) + DEEPEST
        at = off[short][:, None] + np.arange(width)
        inside = np.arange(width) < n[short][:, None]
        at = np.minimum(at, max(len(values) - 1, 0))
        word, cnt = values[at], np.where(inside, c[at], 0)
        p, q = probe[short], index[short]

        def grow(level, rows, parts, pos, load, must):
            """Keys from `level` words on, for the rows whose last word stands at `pos`."""
            ok = (pos < p[rows] + level - 1) & inside[rows, pos]
            rows, parts, load, must = rows[ok], [x[ok] for x in parts], load[ok], must[ok]
            if not len(rows):
                return
            done = (load <= SHARD) | (level == DEEPEST)
            key = _key(parts, 2)
            if len(heavy) and level < DEEPEST:
                done = (done | must) & ~(_among_keys(key, heavy) & ~must)
            if done.any():
                roles = np.where(pos < q[rows[done]] + level - 1, 3, 1)
                emit(short[rows[done]], roles, key[done])
            more = ~done
            if more.any():
                rows, parts, load = rows[more], [x[more] for x in parts], load[more]
                deepen = np.zeros(len(rows), bool)
                for nxt in range(pos + 1, width):
                    left = nxt < p[rows] + level
                    if not left.any():
                        break
                    grow(level + 1, rows, [*parts, word[rows, nxt]], nxt, load * np.maximum(cnt[rows, nxt], 1) / max(total, 1), deepen)

        everyone = np.arange(len(short))
        for i in range(width):
            own = everyone[(i < p) & inside[:, i] & (cnt[:, i] > 1)]
            if len(own):
                grow(1, own, [word[own, i]], i, cnt[own, i].astype(np.float64), np.zeros(len(own), bool))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, n, sketch
    key, rows, roles = (np.concatenate(x) for x in zip(*out))
    return key, rows.astype(np.int64), roles.astype(np.int64), n, sketch


def heavy_keys(sets: DataFrame, counts: np.ndarray, total: int, heavy: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, their entries), sorted by key: the shards of more than `limit` entries, counted exactly.

    A table of BINS sums over the hashed keys, of fixed size, finds the bins that may hold one; only keys of such bins are
    counted one by one, by a shuffle. At most MOST_HEAVY keys come back, the largest ones: a shard that is not among them
    holds less than 1 / MOST_HEAVY of all entries.
    """

    def bins(batches):
        own = np.zeros(BINS, np.int64)
        seen = Seen()
        for b in batches:
            own += np.bincount(_bin(_entries(seen.new(b).column(1), counts, total, heavy)[0]), minlength=BINS)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at])], names=["bin", "n"])

    over = _collect_bins(sets.select("c1", "w").mapInArrow(bins, "bin int, n long")) > limit
    if not over.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def keys(batches):
        seen = Seen()
        for b in batches:
            key = _entries(seen.new(b).column(1), counts, total, heavy)[0]
            key, n = np.unique(key[over[_bin(key)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    many = sets.select("c1", "w").mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    got = many.orderBy(F.desc("n"), "key").limit(MOST_HEAVY).toArrow()
    key, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


class Seen:
    """Drops the sets of a task that came before in it. It holds SEEN ids and then starts anew, so that copies of one set,
    however many, give few entries; the shards drop what is left of them."""

    def __init__(self):
        self.ids = np.zeros(0, np.int64)

    def new(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        c = batch.column(0).to_numpy(zero_copy_only=False)
        own, first = np.unique(c, return_index=True)
        fresh = ~_among_keys(own, self.ids)
        self.ids = np.union1d(self.ids if len(self.ids) < SEEN else self.ids[:0], own[fresh])
        return batch if fresh.all() and len(own) == len(c) else batch.take(pa.array(np.sort(first[fresh])))


class Forest:
    """BK-trees of several shards at once, level by level. Nodes are the different sketches of a shard."""

    def __init__(self, shard: np.ndarray, sketch: np.ndarray):
        order = np.lexsort((sketch, shard))
        shard, sketch = shard[order], sketch[order]
        new = np.ones(len(shard), bool)
        new[1:] = (shard[1:] != shard[:-1]) | (sketch[1:] != sketch[:-1])
        self.members, self.first = order, np.append(np.flatnonzero(new), len(order))
        group, self.sketch = shard[new], sketch[new]
        node = np.arange(len(group))
        # a node far from the sorted order's start makes a better root than the least sketch
        shuffle = np.lexsort((sh.scramble(self.sketch), group))
        group, node = group[shuffle], node[shuffle]
        self.levels = []  # (sorted keys of the groups: parent group * 128 + distance, root of each group)
        while len(node):
            start = np.ones(len(group), bool)
            start[1:] = group[1:] != group[:-1]
            roots = node[start]
            self.levels.append((group[start], roots))
            g = np.cumsum(start) - 1
            rest = ~start
            g, node = g[rest], node[rest]
            d = np.bitwise_count(self.sketch[node] ^ self.sketch[roots[g]]).astype(np.int64)
            group = g * 128 + d
            order = np.argsort(group, kind="stable")
            group, node = group[order], node[order]

    def search(self, shard: np.ndarray, sketch: np.ndarray, radius: np.ndarray):
        """(query, member) of all members of the query's shard within its radius."""
        q, want_lo, want_hi = np.arange(len(shard)), shard, shard
        hits_q, hits_n = [], []
        for keys, roots in self.levels:
            lo, hi = np.searchsorted(keys, want_lo, "left"), np.searchsorted(keys, want_hi, "right")
            n = hi - lo
            q = np.repeat(q, n)
            if not len(q):
                break
            g = np.repeat(lo, n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            node = roots[g]
            d = np.bitwise_count(sketch[q] ^ self.sketch[node]).astype(np.int64)
            near = d <= radius[q]
            hits_q.append(q[near])
            hits_n.append(node[near])
            want_lo, want_hi = g * 128 + np.maximum(d - radius[q], 0), g * 128 + np.minimum(d + radius[q], 127)
        q, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hits_q, hits_n))
        n = self.first[node + 1] - self.first[node]
        at = np.repeat(self.first[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(q, n), self.members[at]


def _match(key, c, sketch, meta):
    """Candidate pairs (ids) among the entries of whole shards."""
    n, role = meta >> 2, meta & 3
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1]) | (sketch[1:] != sketch[:-1]) | (meta[1:] != meta[:-1])
    key, c, sketch, n, role = (x[new] for x in (key, c, sketch, n, role))
    shard = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1 if len(key) else key.astype(np.int64)
    size = np.bincount(shard)
    alive = size[shard] > 1
    c, sketch, n, role, shard = (x[alive] for x in (c, sketch, n, role, shard))
    idx, prb = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
    if not len(idx) or not len(prb):
        return np.zeros((2, 0), np.int64)
    forest = Forest(shard[idx], sketch[idx])
    weight = np.cumsum(np.bincount(shard[idx], minlength=shard.max() + 1)[shard[prb]])
    found = []
    for part in np.split(prb, np.searchsorted(weight, np.arange(2_000_000, int(weight[-1]) + 1, 2_000_000))):
        if not len(part):
            continue
        q, m = forest.search(shard[part], sketch[part], 2 * n[part] // 7)
        q, m = part[q], idx[m]
        ok = (c[q] != c[m]) & ((n[m] < n[q]) | ((n[m] == n[q]) & (c[m] < c[q]))) & (4 * n[m] >= 3 * n[q])
        q, m = q[ok], m[ok]
        ok = np.bitwise_count(sketch[q] ^ sketch[m]) <= (n[q] + n[m]) // 7
        found.append(np.stack([c[q[ok]], c[m[ok]]]))
    return np.unique(np.sort(np.concatenate(found, 1), axis=0), axis=1) if found else np.zeros((2, 0), np.int64)


def _trees(batches):
    """Shards from batches sorted by key; whole shards are handled as soon as they are complete."""
    held: list[list[np.ndarray]] = []
    have = 0

    def run(parts):
        key, block, c, sketch, meta = (np.concatenate(x) for x in zip(*parts))
        with np.errstate(over="ignore"):
            whole = key if not block.any() else (sh.scramble(key.view(np.uint64)) + block.astype(np.uint64)).view(np.int64)
        pairs = _match(whole, c, sketch.view(np.uint64), meta)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["ca", "cb"])

    last = None
    for b in batches:
        x = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        # copies of a set stand in a row: one is kept, so that memory holds different sets only
        new = np.zeros(len(x[0]), bool)
        for y, before in zip(x, last or [None] * 5):
            new |= np.append(before is None or y[0] != before, y[1:] != y[:-1]) if len(y) else new
        if len(new):
            last = [y[-1] for y in x]
        x = [y[new] for y in x]
        if not len(x[0]):
            continue
        held.append(x)
        have += len(x[0])
        if have >= 50_000:
            key, block = x[0], x[1]
            # all but the last shard are complete
            same = np.flatnonzero((key != key[-1]) | (block != block[-1]))
            if len(same):
                cut = same[-1] + 1
                held[-1] = [y[:cut] for y in x]
                yield run(held)
                held, have = [[y[cut:] for y in x]], len(key) - cut
    if have:
        yield run(held)


def candidates(base: DataFrame, partitions: int, limit: int = HOT) -> DataFrame:
    """(ca, cb): ids (c1) of word sets whose sketches lie within the radius in some shard. May hold a pair twice."""
    counts = word_counts(base)
    total = max(1, base.count())
    none = np.zeros(0, np.uint64)
    heavy, big, n_big = none, *heavy_keys(base, counts, total, none, limit)
    if len(big):
        heavy = big
        big, n_big = heavy_keys(base, counts, total, heavy, limit)
    side = -(-n_big // limit)

    def make(batches):
        seen = Seen()
        for b in batches:
            b = seen.new(b)
            key, row, roles, n, sketch = _entries(b.column(1), counts, total, heavy)
            c = b.column(0).to_numpy(zero_copy_only=False)[row]
            block = np.zeros(len(key), np.int32)
            if len(big):
                s = np.ones(len(key), np.int64)
                at = np.minimum(np.searchsorted(big, key), len(big) - 1)
                s[big[at] == key] = side[at][big[at] == key]
                mine = (sh.scramble(c.view(np.uint64)) % s.astype(np.uint64)).astype(np.int64)
                parts = []
                for role in (1, 2):  # searching sets go to every block row, searched ones to every block column
                    r = np.flatnonzero(roles & role)
                    k = np.repeat(r, s[r])
                    other = np.arange(len(k)) - np.repeat(np.cumsum(s[r]) - s[r], s[r])
                    parts.append((k, np.full(len(k), role), mine[k] * s[k] + other if role == 1 else other * s[k] + mine[k]))
                k, roles, block = (np.concatenate(x) for x in zip(*parts))
                key, row, c, block = key[k], row[k], c[k], block.astype(np.int32)
            meta = (n[row] << 2) + roles
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(block, pa.int32()), pa.array(c), pa.array(sketch[row].view(np.int64)), pa.array(meta.astype(np.int64))], names=["key", "block", "c", "sketch", "meta"])

    entries = base.select("c1", "w").mapInArrow(make, "key long, block int, c long, sketch long, meta long")
    return entries.repartition(partitions, "key", "block").sortWithinPartitions("key", "block", "c", "sketch", "meta").mapInArrow(_trees, "ca long, cb long")


def _among(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """Rows whose `col` is among the ids: by broadcast while they are few, which is counted, else by a shuffle."""
    return df.join(F.broadcast(ids) if few(ids, BROADCAST_IDS) else ids, col, "left_semi")


def similar_sets(base: DataFrame, partitions: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of set ids with their counts, rows of the sets concerned)."""
    found = written(candidates(base, partitions).distinct(), "p3-candidates")
    need = written(found.select(F.col("ca").alias("c1")).union(found.select("cb")).distinct(), "p3-need")
    rows = written(_among(base, "c1", need), "p3-rows")
    sets = rows.select("c1", "c2", "w").dropDuplicates(["c1", "c2"])
    a = sets.select(F.col("c1").alias("ca"), F.col("c2").alias("ca2"), F.col("w").alias("wa"))
    b = sets.select(F.col("c1").alias("cb"), F.col("c2").alias("cb2"), F.col("w").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    pairs = found.join(a, "ca").join(b, "cb").withColumn("both", both).where(F.col("both") * 7 >= (F.size("wa") + F.size("wb")) * 3)
    return pairs.select("ca", "ca2", "cb", "cb2", (F.col("both") / (F.size("wa") + F.size("wb") - F.col("both"))).alias("similarity")), rows


def classes(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base rows, members, class links), written.

    members: (row_id, class_id, size) of every row that may have a partner: rows of one word set, one canonical record
    (problem 6) and one form (problem 5) are a class, named by its smallest row. class links: (class_a, class_b, similarity)
    of the classes whose rows are partners, each pair once.
    """
    base = base_rows(df, id_col, text_col)
    pairs, rows = similar_sets(base, width(df))
    pairs = written(pairs, "p3-pairs")
    own = base.select("row_id", "h", "c1", "c2", "o1", "s1")
    # sets whose rows have their words in several orders
    orders = written(base.groupBy("c1", "c2").agg(F.min("o1").alias("lo"), F.max("o1").alias("hi")).where("lo <> hi").select("c1", "c2"), "p3-orders")
    inner = own.join(F.broadcast(orders) if few(orders, BROADCAST_IDS) else orders, ["c1", "c2"], "left_semi")
    used = pairs.select(F.col("ca").alias("c1")).union(pairs.select("cb")).distinct()
    rows = written(_among(rows.select("row_id", "h", "c1", "c2", "o1", "s1"), "c1", used).unionByName(inner).distinct(), "p3-used")
    # the canonical record of problem 6: a list's sorted fields, also for a text with a list's words in its order
    turned = written(rows.where("s1 is not null").groupBy("c1", "c2", "o1").agg(F.min("s1").alias("m1")), "p3-turned")
    k6 = F.coalesce("s1", "m1", "o1").alias("k6")
    rows = rows.join(F.broadcast(turned) if few(turned, BROADCAST_IDS) else turned, ["c1", "c2", "o1"], "left").select("row_id", "h", "c1", "c2", k6)
    t = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("t"))
    ids = written(rows.select("row_id").distinct(), "p3-ids")
    forms = written(_among(t, "row_id", ids).select("row_id", F.xxhash64("t").alias("h"), F.unhex(F.md5(form_col(F.col("t"), bigram_counts(df, text_col)))).alias("f")), "p3-forms")
    return base, written(rows.join(forms.distinct(), ["row_id", "h"]).drop("h"), "p3-members"), pairs


def class_links(members: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes with their sizes, links between them), from members and pairs of sets."""
    cls = written(members.groupBy("c1", "c2", "k6", "f").agg(F.min("row_id").alias("class_id"), F.count("*").alias("size")), "p3-classes")
    # lists of one record have different words where a mark without a blank joins two fields, so records are compared here too
    a = cls.select(F.col("c1").alias("ca"), F.col("c2").alias("ca2"), F.col("class_id").alias("a"), F.col("f").alias("fa"), F.col("k6").alias("ka"))
    b = cls.select(F.col("c1").alias("cb"), F.col("c2").alias("cb2"), F.col("class_id").alias("b"), F.col("f").alias("fb"), F.col("k6").alias("kb"))
    across = pairs.join(a, ["ca", "ca2"]).join(b, ["cb", "cb2"]).where("fa <> fb and ka <> kb").select("a", "b", "similarity")
    # classes of one set whose records differ, as sets of several orders have them
    several = cls.groupBy("c1", "c2").agg(F.min("k6").alias("lo"), F.max("k6").alias("hi")).where("lo <> hi").select(F.col("c1").alias("ca"), F.col("c2").alias("ca2"))
    left = a.join(several, ["ca", "ca2"], "left_semi")
    within = left.join(b, (F.col("ca") == F.col("cb")) & (F.col("ca2") == F.col("cb2"))).where("ka < kb and fa <> fb").select("a", "b", F.lit(1.0).alias("similarity"))
    both = across.unionByName(within).select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "similarity")
    return cls, written(both, "p3-links")


def similar_rows(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_id_a, row_id_b): pairs over the threshold that are neither copies up to formatting nor look the same."""
    _, members, pairs = classes(df, id_col, text_col)
    cls, both = class_links(members, pairs)
    rows = members.join(cls, ["c1", "c2", "k6", "f"]).select("row_id", "class_id")
    a, b = rows.withColumnsRenamed({"row_id": "a", "class_id": "class_a"}), rows.withColumnsRenamed({"row_id": "b", "class_id": "class_b"})
    return both.join(a, "class_a").join(b, "class_b").select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"))


def links(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_id, class_id, group_id, n_links, n_partners): one row for each id with enough words.

    class_id: the smallest row of its class; n_links: the classes similar to it; n_partners: their rows, so that the sum
    over all rows is twice the number of pairs of similar_rows; group_id: the smallest class that a chain of links leads to.
    """
    base, members, pairs = classes(df, id_col, text_col)
    cls, both = class_links(members, pairs)
    ways = both.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(both.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))
    size = cls.select(F.col("class_id").alias("other"), "size")
    n = ways.join(size, "other").groupBy("class_id").agg(F.count("*").alias("n_links"), F.sum("size").alias("n_partners"))
    groups = components(both.select("class_a", "class_b"))
    per = cls.join(n, "class_id", "left").join(groups, "class_id", "left")
    linked = members.join(per, ["c1", "c2", "k6", "f"]).select("row_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_partners", F.lit(0)).alias("n_partners"))
    # rows of sets that are like no other: their copies are a class
    alone = base.select("row_id", "c1", "c2").join(members.select("c1", "c2").distinct(), ["c1", "c2"], "left_anti").distinct()
    first = alone.groupBy("c1", "c2").agg(F.min("row_id").alias("class_id"))
    none = F.lit(0).cast("long")
    return linked.unionByName(alone.join(first, ["c1", "c2"]).select("row_id", "class_id", F.col("class_id").alias("group_id"), none.alias("n_links"), none.alias("n_partners")))


def components(edges: DataFrame) -> DataFrame:
    """(class_id, group_id): the smallest id that each end of an edge is connected to.

    Rounds of large and small stars (Kiveris et al. 2014): every node hands its larger neighbours, then its smaller ones,
    to the smallest of them, until each component is one star. Nothing but a count reaches the driver, and a node with many
    neighbours loses them within few rounds.
    """
    a, b = edges.columns
    now = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "p3-edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct(), "p3-large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b")
        after = written(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "p3-small")
        if after.count() == now.count() and after.exceptAll(now).isEmpty():
            break
        now = after
    stars = now.select(F.col("v").alias("class_id"), F.col("u").alias("group_id"))
    return stars.unionByName(now.select(F.col("u").alias("class_id"), F.col("u").alias("group_id")).distinct())
