"""Words as 64-bit hashes and runs of words as rolling hashes, on the flat arrays of an Arrow batch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sangam.functions.words import words_col

MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    """array<bigint>: xxhash64 of each word, in order. Words count as equal where these agree."""
    return F.transform(words_col(text), lambda w: F.xxhash64(w))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values as uint64, offsets from 0, row of each value) of a list<int64> array; a null list counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null([]) if column.null_count else column
    off = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint64)
    off = off - off[0]
    return values, off, np.repeat(np.arange(len(off) - 1), np.diff(off))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def runs(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values (the last n - 1 starts are cut off)."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = h * MIX + values[i : i + m]
        return scramble(h)


def starts(off: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask over the starts of runs: true where the whole run lies in one row."""
    m = max(0, total - n + 1)
    ok = np.ones(m, bool)
    for k in range(1, n):  # a run that starts in the last n - 1 places of a row leaves it
        at = off[1:-1] - k
        at = at[(at >= 0) & (at < m)]
        ok[at] = False
    return ok


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, h.dtype)
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: m], out[width - have : width - have + m])
    return out[:m]
