"""Shared vectorised text work for the operators that run in Python: bounded batches, word hashes, shingles.

Texts reach Python as Arrow batches. A batch is cut into pieces of a few MB of text, so
memory follows the piece (or one very long text) and not the batch. Words are found with
byte tables and hashed by a prefix polynomial modulo 2**64, so there is no loop over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PIECE_BYTES = 1 << 20
BATCH_ROWS = 1000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
#: Word bytes of the two word rules: everything but white space; and digits, letters and non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    if not len(_powers) or len(_powers["p"]) < n:
        size = max(n, 2 * PIECE_BYTES)
        for name, base in (("p", _BASE), ("q", _BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about limit bytes of text each; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit or i - start >= 8192:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each followed by a line feed, and each text's start (one more at the end). Nulls are empty."""
    raws = column.cast(pa.large_binary()).to_pylist()
    raws = [r or b"" for r in raws]
    joined = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    starts = np.zeros(len(raws) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raws], out=starts[1:])
    return joined, starts


def word_spans(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes. data ends with a byte that is not one."""
    inside = np.empty(len(data) + 1, np.int8)
    inside[0] = 0
    inside[1:] = table[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[begin:end] for each span."""
    p, q = _power(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * q[begin] + (end - begin).astype(np.uint64))


def words(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ASCII-lower-cased word in order, and for each text where its words begin (one more at the end)."""
    data, starts = text_bytes(column)
    begin, end = word_spans(data, table)
    hashes = span_hashes(_ASCII_LOWER[data], begin, end)
    return hashes, np.searchsorted(begin, starts)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words; hashes has at least that many."""
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        out = out * step + hashes[k : k + n]
    return mix(out)


def arrow_map(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows.mapInArrow with batches of at most BATCH_ROWS rows, for the session from here on: a batch of long texts stays small on both sides."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return rows.mapInArrow(work, schema)
