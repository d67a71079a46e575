"""What the text and vector operators of this subpackage share.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of a text, unchanged.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.graph import materialised as stored  # noqa: F401  used as common.stored
from kinloom.operators.graph import shared_folder as shared_dir  # noqa: F401

#: The separators of words, and odd multipliers of the rolling hashes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for added columns that clash with none of df's, whatever the case of letters."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = f"{name}_"
        have.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and the like included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_digest(text: Column) -> Column:
    """128 bits that stand for a whole text; null stays null."""
    return F.unhex(F.md5(text.cast("binary")))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. n - 1, modulo 2 ** 64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, step = 1, base & _MASK
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        step, done = step * step & _MASK, done + take
    return out[:n]


_POWERS: dict[int, np.ndarray] = {}
_INVERSE = pow(_BASE, -1, 1 << 64)


def _power_table(n: int, base: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = _powers(max(1 << 16, 1 << (n - 1).bit_length()), base)
    return _POWERS[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the 64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes of UTF-8, of the words of a text."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SEPARATOR[data], out=inside[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words of a text, by a polynomial over its bytes and one prefix sum."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _power_table(len(data), _BASE)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power_table(len(data), _INVERSE)[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out += words[j : j + n] * np.uint64(pow(0xD6E8FEB86659FD93, 2 * j + 1, 1 << 64))
    return mix(out)


def byte_arrays(column: pa.Array) -> list[np.ndarray | None]:
    """The bytes of each value of an Arrow string or binary array, without copies of the values; null gives None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    known = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    return [flat[at[i] : at[i + 1]] if known[i] else None for i in range(len(column))]


def whole_groups(batches, columns: list[int]) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by some columns, cut so that no group of equal values of these spans two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in columns]
        last = [k[batch.num_rows - 1] for k in keys]
        first = batch.num_rows - 1
        while first > 0 and all(k[first - 1] == v for k, v in zip(keys, last, strict=True)):
            first -= 1
        if held and first > 0 or held and any(held[-1].column(c)[held[-1].num_rows - 1] != v for c, v in zip(columns, last, strict=True)):
            yield pa.concat_batches([*held, batch.slice(0, first)])
            held = []
        elif first > 0:
            yield batch.slice(0, first)
        held.append(batch.slice(first))
    if held:
        yield pa.concat_batches(held)


def cuts(batch: pa.RecordBatch, columns: list[int]) -> list[int]:
    """Where groups of equal values begin, and the end."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in columns:
        a = batch.column(c)
        new[1:] |= np.asarray(pa.compute.not_equal(a.slice(1), a.slice(0, len(a) - 1)))
    return [*np.flatnonzero(new).tolist(), batch.num_rows]
