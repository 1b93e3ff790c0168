"""Words, word hashes and word windows of whole UTF-8 texts, vectorised.

Texts arrive as Arrow string columns.  Runs of rows are handled together as
one byte buffer of about ``SLICE`` bytes (a longer text is a run of its own),
so a task's memory is bounded by the longest single text, not by the batch.

A word is a maximal run of bytes of a class; every class used here keeps or
excludes all bytes of a multi-byte character alike.  Word hashes are
polynomial over the bytes modulo 2**64, finished with a mixing function;
window hashes are polynomial over the word hashes.  They are functions of the
bytes alone, so all executors agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE = 1 << 18
U = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
WORD_SALT = 0xA24BAED4963EE407
WINDOW_SALT = 0x8CB92BA72F3D8DD7


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table: True for the bytes in the inclusive ranges."""
    t = np.zeros(256, bool)
    for lo, hi in ranges:
        t[lo:hi + 1] = True
    return t


#: everything but white space (0x20, 0x09-0x0D)
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: after lower-casing: digits, a-z and every non-ASCII character
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing function that spreads each input bit over all output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def up(b):
        a = np.full(size, b, U)
        a[0] = 1
        return np.multiply.accumulate(a)
    return up(base), up(pow(base, -1, 1 << 64))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    up, down = _powers(base, max(2 * SLICE, 1 << max(0, int(n)).bit_length()))
    return up[:n], down[:n]


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """c[i] = sum of values[j] * base**j for j < i; see ``range_hash``."""
    c = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * powers(base, len(values))[0], out=c[1:])
    return c


def range_hash(c: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[lo:hi] from prefix sums, independent of the position."""
    return (c[hi] - c[lo]) * powers(base, len(c))[1][lo]


def salt(size: int, constant: int) -> np.uint64:
    """size * constant modulo 2**64."""
    return U(size * constant & 0xFFFFFFFFFFFFFFFF)


class Words:
    """The words of a run of texts: byte starts and ends, text index, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        w = np.zeros(n + 2, bool)
        w[1:-1] = table[self.data]
        inside = w[1:-1]
        self.starts = np.flatnonzero(inside & (~w[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~w[2:] | edge[1:])) + 1
        #: first word of each text; one entry more than texts
        self.first = np.searchsorted(self.starts, offsets)
        self._c = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def prefix_sums(self) -> np.ndarray:
        if self._c is None:
            self._c = prefix_hash(self.data, BYTE_BASE)
        return self._c

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first ``prefix`` bytes."""
        ends = self.ends if prefix is None else np.minimum(self.ends, self.starts + prefix)
        h = range_hash(self.prefix_sums(), self.starts, ends, BYTE_BASE)
        return mix(h + (ends - self.starts).astype(U) * U(WORD_SALT))

    def windows(self, length: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``length`` words within one text."""
        last = np.repeat(self.first[1:], self.counts)  # end of the text of each word
        at = np.flatnonzero(np.arange(len(words)) + length <= last)
        return at, window_hash(words, at, at + length)


def window_hash(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of words[lo:hi], from the word hashes."""
    h = range_hash(prefix_hash(words, WORD_BASE), lo, hi, WORD_BASE)
    return mix(h + (hi - lo).astype(U) * U(WINDOW_SALT))


def runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


class Tally:
    """Occurrences of bucket numbers within a task, in one array of fixed size.

    Numbers are gathered and counted some hundred thousand at a time: a run of
    texts is small against the array."""

    def __init__(self, size: int, gather: int = 1 << 20):
        self.n, self.parts, self.held, self.gather = np.zeros(size, np.int32), [], 0, gather

    def add(self, at: np.ndarray) -> None:
        self.parts.append(at.astype(np.int32))
        self.held += len(at)
        if self.held >= self.gather:
            self.counts()

    def counts(self) -> np.ndarray:
        if self.parts:
            at, n = np.unique(np.concatenate(self.parts), return_counts=True)
            self.n[at] += n.astype(np.int32)
            self.parts, self.held = [], 0
        return self.n


def per_text(sums_at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each text; ``sums_at`` is ``Words.first``."""
    c = np.concatenate(([0], np.cumsum(values)))
    return c[sums_at[1:]] - c[sums_at[:-1]]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField],
                   make: Callable[[], Callable[[pa.Array], list]], rows: int | None = None) -> DataFrame:
    """Append columns computed from a text column, batch by batch, in place.

    ``make`` builds the batch function once per task (a place for models); ``rows``
    cuts batches further, where the new columns are large against the text.
    The rows keep their partitions: there is no shuffle and no id is needed.
    """
    schema = T.StructType(df.schema.fields + fields)
    at = df.columns.index(text_col)

    def run(batches):
        f = make()
        for b in batches:
            step = rows or max(1, b.num_rows)
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                cols = f(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=schema.names)
    return df.mapInArrow(run, schema)
