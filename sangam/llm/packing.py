"""Problem 7: filling containers of fixed capacity, by variable-capacity best-fit on the histogram of lengths.

Lengths are measured in tokens of a public tokenizer. The plan needs only how many pieces have each length (at most as
many numbers as the largest capacity, whatever the corpus), so it is made once and exactly, over all documents: lengths
in falling order, each into the fullest open container that still takes it; where none does, the permitted length with the
least cost per token that the pieces still to be packed put into it is opened; at the end each container shrinks to the
least permitted length that holds its contents. A container of length p costs p + overhead + p * p * quadratic: its
tokens, used or not, a fixed part, and what grows with the length of a sequence (attention). One budget alone minimises
its number of containers (quadratic 0); packed jointly, the lengths compete with quadratic 1 / ATTENTION. Documents then look up their container by their rank among the documents of equal length. Ranks
come from salted groups, so a length shared by a third of all documents is no hot group.

Only a document longer than the capacity is split: into full containers and one remainder, which is packed like any
other piece.

Defined results: null, empty and blank texts may have 0 tokens and are put into the first container as pieces of
length 0; repeated ids are rows of their own; rows without an id are left out; capacities that are null or below 1 are ignored; a capacity over MAX_CAPACITY is refused.
"""

import base64
import bisect
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sangam.session import written

TOKENIZER = os.environ.get("SANGAM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_CAPACITY, OVERHEAD = 1 << 20, 8
#: The length at which attention costs as much as everything else, in joint packing.
ATTENTION = 4096
#: A rank group holds about so many documents.
PER_SALT = 200_000

_encoders: dict = {}


def encoder(path: str):
    """One encoder per worker and file."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def n_tokens(text: Column, path: str = TOKENIZER) -> Column:
    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        e = encoder(path)
        return s.map(lambda t: len(e.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)


class Group:
    """`count` containers of equal length and contents."""

    __slots__ = ("count", "length", "left", "items")

    def __init__(self, count, length, left, items):
        self.count, self.length, self.left, self.items = count, length, left, items


def plan(histogram: dict[int, int], permitted: list[int], overhead: int = OVERHEAD, quadratic: float = 0.0) -> list[Group]:
    """Best-fit over lengths in falling order, taken in bulk. histogram: pieces by length; permitted: container lengths."""
    permitted = sorted(permitted)
    open_at: dict[int, list[Group]] = {}
    lefts: list[int] = []  # sorted: the free lengths of open containers
    done: list[Group] = []
    rest = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    sizes = sorted(rest)  # those still to be packed

    def put(g: Group):
        if g.left == 0:
            done.append(g)
        elif g.left in open_at:
            open_at[g.left].append(g)
        else:
            open_at[g.left] = [g]
            bisect.insort(lefts, g.left)

    def fill(p: int) -> int:
        """The tokens that a new container of length p gets from the pieces at hand, the longest that fits each time."""
        free, at = p, bisect.bisect_right(sizes, p) - 1
        while at >= 0:
            s = sizes[at]
            free -= s * min(free // s, rest[s])
            at = min(at, bisect.bisect_right(sizes, free)) - 1
        return p - free

    def cost(p: int) -> float:
        return (p + overhead + quadratic * p * p) / fill(p)

    while sizes:
        s = sizes[-1]
        n = rest[s]
        while n:
            at = bisect.bisect_left(lefts, s)
            if at < len(lefts):
                left = lefts[at]
                g = open_at[left].pop()
                if not open_at[left]:
                    del open_at[left], lefts[at]
                # as many of this length as the container takes: each one after the first still fits it best
                k = min(left // s, n)
                m = min(g.count, n // k)
                if m < g.count:
                    put(Group(g.count - m, g.length, g.left, g.items))
                put(Group(m, g.length, left - k * s, [*g.items, (s, k)]))
                n -= m * k
                continue
            rest[s] = n
            able = [p for p in permitted if p >= s]
            c = min(able, key=lambda p: (cost(p), p)) if len(able) > 1 else able[0]
            k = min(c // s, n)
            m = n // k
            put(Group(m, c, c - k * s, [(s, k)]))
            n -= m * k
        sizes.pop()
    done += [g for gs in open_at.values() for g in gs]
    for g in done:
        used = g.length - g.left
        g.length = permitted[bisect.bisect_left(permitted, used)]
        g.left = g.length - used
    return done


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens), written: tokenizing is the dear part and is done once."""
    t = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(n_tokens(F.col(text_col), tokenizer), F.lit(0)).cast("long").alias("tokens"))
    return written(t, "p7-tokens")


def pack_counts(counts: DataFrame, capacities: dict[int, int], joint: bool = False, overhead: int = OVERHEAD) -> DataFrame:
    """(budget_id, doc_id, piece, start, tokens, container, length) for each budget id and its capacity.

    joint: one packing (budget 0) into all the capacities together, instead of one for each.
    """
    budgets = {0: max(capacities.values())} if joint and capacities else dict(capacities)
    if any(c > MAX_CAPACITY for c in budgets.values()):
        raise ValueError(f"a capacity exceeds {MAX_CAPACITY}")
    spark = counts.sparkSession
    schema = "budget_id int, doc_id long, piece long, start long, tokens long, container string, length int"
    if not budgets:
        return spark.createDataFrame([], schema)
    # ranks are given within a length and a salt; there are as many salts as keep a length of all documents in small groups
    salts = max(64, -(-counts.count() // PER_SALT))
    counts = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(c).cast("long").alias("c")) for b, c in budgets.items()])).alias("x")
    rows = counts.select("doc_id", "tokens", "salt", each).select("doc_id", "tokens", "salt", F.col("x.b").alias("budget_id"), F.col("x.c").alias("c"))
    over = F.col("tokens") > F.col("c")
    full = F.when(over, F.floor(F.col("tokens") / F.col("c"))).otherwise(0).cast("long")
    rows = rows.withColumn("full", full).withColumn("size", (F.col("tokens") - F.col("full") * F.col("c")).cast("int"))
    ends = rows.where((F.col("size") > 0) | (F.col("full") == 0))
    per_salt = ends.groupBy("budget_id", "size", "salt").agg(F.count("*").alias("n"))
    hist: dict[int, dict[int, int]] = {b: {} for b in budgets}
    for b, s, n in per_salt.groupBy("budget_id", "size").agg(F.sum("n")).collect():
        hist[b][s] = n
    slots = {}
    for b, c in budgets.items():
        allowed = sorted({x for x in capacities.values() if x <= c})
        base, table = 0, []
        for g in plan(hist[b], allowed, overhead, 1 / ATTENTION if joint else 0.0):
            table += [(s, k, base, g.count, g.length) for s, k in g.items]
            base += g.count
        table.sort(key=lambda x: -x[0])
        sizes, first, out = [], {}, []
        for s, k, at, m, length in table:
            r = first.get(s, 0)
            out.append((s, r, k, at, length))
            first[s] = r + k * m
        out.append((0, 0, max(1, hist[b].get(0, 0)), 0, next((x[4] for x in table if x[2] == 0), allowed[0])))
        out.sort()
        slots[b] = tuple(np.array(x, np.int64) for x in zip(*out))

    offsets = per_salt.withColumn("base", F.sum("n").over(W.partitionBy("budget_id", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
    offsets = offsets.select("budget_id", "size", "salt", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = ends.withColumn("rank", F.row_number().over(W.partitionBy("budget_id", "size", "salt").orderBy("doc_id")) - 1)
    ranked = ranked.join(offsets, ["budget_id", "size", "salt"]).select("budget_id", "doc_id", "full", "c", "size", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches):
        for b in batches:
            budget, size, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 4, 5))
            container, length = np.empty(len(size), object), np.zeros(len(size), np.int32)
            for k in np.unique(budget):
                s, r, per, at, cap = slots[int(k)]
                mine = np.flatnonzero(budget == k)
                # the last slot row of the size whose first rank is not above the rank
                key = s * (1 << 42) + r
                i = np.searchsorted(key, size[mine] * (1 << 42) + rank[mine], "right") - 1
                n = at[i] + (rank[mine] - r[i]) // per[i]
                container[mine] = [f"{k}-{x}" for x in n]
                length[mine] = cap[i]
            full, c = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(budget, pa.int32()), b.column(1), pa.array(full), pa.array(full * c), pa.array(size, pa.int64()), pa.array(container, pa.string()), pa.array(length)],
                names=["budget_id", "doc_id", "piece", "start", "tokens", "container", "length"],
            )

    packed = ranked.mapInArrow(place, schema)
    whole = rows.where("full > 0").select("budget_id", "doc_id", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("budget_id", "doc_id", "piece", (F.col("piece") * F.col("c")).alias("start"), F.col("c").alias("tokens"), F.concat_ws("-", "budget_id", F.lit("full"), "doc_id", "piece").alias("container"), F.col("c").cast("int").alias("length"))
    return packed.unionByName(whole)


def capacities(budgets: DataFrame) -> dict[int, int]:
    """Budget id to capacity; a table of a few rows by nature, refused beyond 1,000."""
    rows = budgets.select("budget_id", "capacity").where("capacity >= 1 and budget_id is not null").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 budgets")
    return {int(b): int(c) for b, c in sorted(map(tuple, rows))}


def pack(docs: DataFrame, budgets: DataFrame, joint: bool = False, **kw) -> DataFrame:
    caps = capacities(budgets)
    return pack_counts(token_counts(docs, **kw), caps, joint)


def summary(packed: DataFrame) -> DataFrame:
    """Per budget: containers, tokens, unused tokens, documents, split documents."""
    per = packed.groupBy("budget_id", "container").agg(F.sum("tokens").alias("used"), F.max("length").alias("length"))
    a = per.groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum(F.col("length") - F.col("used")).alias("unused"))
    docs = packed.groupBy("budget_id").agg(F.sum(F.when(F.col("start") == 0, 1).otherwise(0)).alias("documents"), F.sum(F.when((F.col("piece") == 1), 1).otherwise(0)).alias("split_documents"))
    return a.join(docs, "budget_id")
