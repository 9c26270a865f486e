"""Problem 6: duplicates hidden by formatting, by range partitioning, external sort and a scan of adjacent runs.

Canonical record: the words of a text joined by a blank; for a text that is a list of `name: value` fields, its
fields' words in sorted order. Records are range-partitioned by (key, id), so that one key's copies may spread over
several partitions, sorted on disk where needed, and scanned once; runs that cross a boundary are joined from one
summary row per partition (the only thing the driver gets: fixed size, as many as there are partitions).

Defined results: null texts and texts without letter or digit belong to no group; empty input gives no rows; repeated
ids count as rows; rows without an id are left out; extra columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangam.functions.words import words_key
from sangam.session import width, written

#: One field of a list: a name without colon or semicolon, a colon, a value.
FIELD_RE = r"^[^:;\r\n]+:\s*\S[^;\r\n]*$"
#: Lists whose order a plain text may follow are broadcast up to this number and size; beyond they are joined, in SALTS parts.
ALIASES, ALIAS_BYTES, SALTS = 200_000, 64 << 20, 16
SCAN = "pid int, kind int, row_id long, first_id long, head boolean, runs long, dig_first binary, dig_last binary"


def list_fields(text: Column) -> Column:
    """The non-blank parts of a text between semicolons and line breaks."""
    return F.filter(F.split(text, r"[;\r\n]+"), lambda p: F.length(F.trim(F.regexp_replace(p, r"\s+", " "))) > 0)


def is_list(text: Column) -> Column:
    """Whether a text is a list of at least two `name: value` fields."""
    parts = list_fields(text)
    return text.contains(":") & text.rlike(r"[;\n\r]") & (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(FIELD_RE))


def list_key(text: Column) -> Column:
    """The words of a list's fields, the fields in sorted order."""
    return F.array_join(F.array_sort(F.transform(list_fields(text), words_key)), " ")


def canonical(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, key, dig): the canonical record of every text that has a letter or digit, and its digest.

    Words are taken from each text once; what follows reads the written records.
    """
    t = F.col("text")
    base = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).where(t.rlike(r"[\p{L}\p{N}]") & F.col("row_id").isNotNull())
    rec = base.select("row_id", words_key(t).alias("flat"), F.when(is_list(t), list_key(t)).alias("sorted"))
    rec = written(rec.select("row_id", F.coalesce("sorted", "flat").alias("key"), F.unhex(F.md5("flat")).alias("dig"), F.col("sorted").isNotNull().alias("is_list"), F.coalesce(F.col("flat") != F.col("sorted"), F.lit(False)).alias("turned")), "p6-records")
    # A text with a list's words in a list's order, but without its separators, follows that list.
    alias = written(rec.where("turned").groupBy("dig").agg(F.min("key").alias("to")), "p6-alias")
    n, size = alias.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("to")), F.lit(0))).first()
    if n and (n > ALIASES or size > ALIAS_BYTES):  # too many to send: first those that any text asks for, then salted
        asked = rec.where("not is_list").select("dig").distinct()
        hit = alias.join(asked, "dig").select("dig", "to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rec = rec.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).join(hit, ["dig", "salt"], "left")
    elif n:
        rec = rec.join(F.broadcast(alias), "dig", "left")
    else:
        return rec.select("row_id", "key", F.unhex(F.md5("key")).alias("dig"))
    key = F.when(F.col("is_list"), F.col("key")).otherwise(F.coalesce("to", "key"))
    return rec.select("row_id", key.alias("key")).withColumn("dig", F.unhex(F.md5("key")))


def _scan(batches):
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    last_key = first_key = None
    first_id, runs = 0, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        keys, ids = b.column("key"), b.column("row_id").to_numpy(zero_copy_only=False)
        head = keys[0].as_py()
        new = np.append(head != last_key, pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)).astype(bool)
        if first_key is None:
            first_key = head
        # the place of the run's first row in this batch, -1 for a run that began before it
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        firsts = np.where(at >= 0, ids[at], first_id)
        run = runs + np.cumsum(new)
        first_id, runs, last_key = int(firsts[-1]), int(run[-1]), keys[-1].as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, pid, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(run == 1), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
            names=["pid", "kind", "row_id", "first_id", "head", "runs", "dig_first", "dig_last"],
        )
    if first_key is not None:
        dig = [hashlib.sha256(k.encode("utf-8", "surrogatepass")).digest() for k in (first_key, last_key)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([pid], pa.int32()), pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.array([first_id], pa.int64()), pa.array([None], pa.bool_()), pa.array([runs], pa.int64()), pa.array([dig[0]], pa.binary()), pa.array([dig[1]], pa.binary())],
            names=["pid", "kind", "row_id", "first_id", "head", "runs", "dig_first", "dig_last"],
        )


def copies(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_id, first_row_id) of every row with a letter or digit; first_row_id is the smallest id of its group."""
    spark = df.sparkSession
    rec = canonical(df, id_col, text_col).withColumn("pre", F.substring("key", 1, 24))
    order = ["pre", "dig", "row_id"]
    runs = rec.repartitionByRange(width(df), *order).sortWithinPartitions(*order).select("row_id", "key")
    scan = written(runs.mapInArrow(_scan, SCAN), "p6-runs")
    carry, before = [], None
    for s in scan.where("kind = 1").select("pid", "first_id", "runs", "dig_first", "dig_last").orderBy("pid").collect():
        joins = before is not None and before[0] == s.dig_first
        if joins:
            carry.append((s.pid, before[1]))
        before = (s.dig_last, before[1] if joins and s.runs == 1 else s.first_id)
    rows = scan.where("kind = 0")
    first = F.col("first_id")
    if carry:  # at most one row per partition
        rows = rows.join(F.broadcast(spark.createDataFrame(carry, "pid int, begun long")), "pid", "left")
        first = F.when(F.col("head"), F.coalesce("begun", first)).otherwise(first)
    return rows.select("row_id", first.cast("long").alias("first_row_id"))


def collapse(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(first_row_id, copies): one representative for each distinct content, with its exact number of rows."""
    return copies(df, id_col, text_col).groupBy("first_row_id").agg(F.count("*").alias("copies"))
