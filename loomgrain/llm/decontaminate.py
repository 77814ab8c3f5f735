"""Benchmark decontamination by spaced seeds.

Fixed masks over a window of at most SPAN words say which positions count; the words
under the others may differ. Every window of every benchmark item is hashed under each
mask, every window of every document too, and equal hashes are hits. A hit fixes how the
item lies along the document, its diagonal; there the words are compared one by one, and
the longest stretch that begins and ends with equal words and has at least IDENTITY equal
words is taken. The document is contaminated by the item if that stretch has RUN words,
or all of a shorter item's.

The masks leave no hole: wherever the differing words of such a stretch stand, some mask
finds a window between them. (A test goes through all placements up to 25 words; a longer
stretch holds one of 13 to 25 words that is no less equal.)

The benchmark is dealt into blocks of about BLOCK hashes, as many as its size asks for. A
block's texts go to the executors, where each Python worker builds the sorted seeds; then
documents are read in place: nothing is shuffled, and no document or word can be a hot
key. With several blocks each takes a pass, written before the next begins, so that one
block is in memory at a time. Hits are reduced to diagonals in portions of HITS, and an
item's diagonals along a document are compared in portions too, until one shows the whole
item; repetitive texts cost no more memory.

Words are runs of digits, ASCII letters (lower-cased) and all non-ASCII characters.
Items of fewer than SPAN words are sought as one solid seed of all their words; items of
fewer than `least` words (LEAST, a parameter; 1 takes all) say too little and take no part.

Defined cases: null and empty texts contaminate nothing and are clean; repeated rows are
judged each; items with equal text are all reported; of equally good stretches of an item
the first is reported; an empty table or benchmark gives no leaks; other columns pass
through, a column named `leaks` is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrain.llm.batches import ALNUM, arrow_map, mix, pieces, words
from loomgrain.session import written

# Which words of a window count. Found by search, as five of weight six that leave no placement out.
MASKS = ("1111011", "110101011", "11011011", "11100111", "111111")
SPAN, LEAST = 9, 5
RUN, IDENTITY = 13, 0.8
BLOCK = 8_000_000
HITS = 1_000_000
CELLS = 2_000_000  # words compared at once
_LEAK = ("item_id", "start", "n_words", "n_equal")
_STEP = np.uint64(0xD6E8FEB86659FD93)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash of each window's words under the mask."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), int(mask, 2), np.uint64)
    if n > 0:
        for i, c in enumerate(mask):
            if c == "1":
                out = out * _STEP + hashes[i : i + n]
    return mix(out)


@dataclass
class Index:
    """Items' words one after another, and sorted seeds with their item and place."""

    ids: list
    words: list[np.ndarray]
    masks: list[tuple[str, bool]]
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    shift: np.uint64


def index(ids: list, texts: list[str | None], least: int = LEAST) -> Index:
    hashes, at = words(pa.array(texts, pa.string()), ALNUM)
    own = [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    masks = [*((m, False) for m in MASKS), *(("1" * n, True) for n in range(least, SPAN))]
    found, used = [], []
    for mask, whole in masks:
        for i, w in enumerate(own):
            if len(w) == len(mask) if whole else len(w) >= SPAN:
                s = seeds(w, mask)
                found.append((s, np.full(len(s), i, np.int32), np.arange(len(s), dtype=np.int32)))
                if not used or used[-1] != (mask, whole):
                    used.append((mask, whole))
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    seed, item, place = (np.concatenate(c) for c in zip(empty, *found, strict=True))
    order = np.argsort(seed, kind="stable")
    seed = seed[order]
    size = max(22, min(28, (8 * len(seed)).bit_length()))
    shift = np.uint64(64 - size)
    bits = np.zeros(1 << size, bool)
    bits[(seed >> shift).astype(np.int64)] = True
    return Index(list(ids), own, used, seed, item[order], place[order], bits, shift)


def stretch(equal: np.ndarray) -> tuple[int, int]:
    """The longest [a, b) that begins and ends with equal words and has IDENTITY of them equal; the first if several."""
    # A stretch qualifies if the sum of (1 if equal else -IDENTITY/(1-IDENTITY)) is not negative.
    cost = round(IDENTITY / (1 - IDENTITY), 9)
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -cost))])
    starts = np.flatnonzero(equal)
    best = (0, 0)
    if not len(starts):
        return best
    ends = starts + 1
    # For each start the furthest end whose sum is no lower: ends' running maximum from the right is monotone.
    ahead = np.maximum.accumulate(sums[ends][::-1])[::-1]
    j = 0
    for a in starts.tolist():
        while j < len(ends) and ahead[j] >= sums[a] - 1e-9:
            j += 1
        b = int(ends[j - 1]) if j else 0
        if b - a > best[1] - best[0] and sums[b] >= sums[a] - 1e-9:
            best = (a, b)
    return best


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """stretch of each row at once: beginnings and ends."""
    many, n = equal.shape
    cost = round(IDENTITY / (1 - IDENTITY), 9)
    sums = np.zeros((many, n + 1))
    np.cumsum(np.where(equal, 1.0, -cost), axis=1, out=sums[:, 1:])
    ends = np.where(equal, sums[:, 1:], -np.inf)
    ahead = np.maximum.accumulate(ends[:, ::-1], axis=1)[:, ::-1]
    reach, begin, size = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(many, np.int64)
    for a in range(n):
        rows = np.flatnonzero(equal[:, a])
        go = rows
        while len(go := go[reach[go] < n]):
            go = go[ahead[go, reach[go]] >= sums[go, a] - 1e-9]
            reach[go] += 1
        rows = rows[reach[rows] - a > size[rows]]
        rows = rows[ends[rows, reach[rows] - 1] >= sums[rows, a] - 1e-9]
        begin[rows], size[rows] = a, reach[rows] - a
    return begin, begin + size


def _diagonals(own: np.ndarray, at: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, where the item would begin) of all hits, each once, in this order."""
    documents, ahead = len(at) - 1, max(map(len, ix.words), default=0)
    wide = len(own) + ahead + 1
    codes = np.zeros(0, np.int64)
    for mask, _ in ix.masks:
        s = seeds(own, mask)
        maybe = np.flatnonzero(ix.filter[(s >> ix.shift).astype(np.int64)])
        low, high = np.searchsorted(ix.seed, s[maybe], "left"), np.searchsorted(ix.seed, s[maybe], "right")
        sums = np.cumsum(high - low)
        cut = np.searchsorted(sums, np.arange(HITS, (sums[-1] if len(sums) else 0) + HITS, HITS))
        for a, b in zip([0, *(cut[:-1] + 1)], [*(cut[:-1] + 1), len(maybe)], strict=True):
            count = high[a:b] - low[a:b]
            if count.any():
                place = np.repeat(maybe[a:b], count)
                entry = np.repeat(low[a:b], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                doc = np.searchsorted(at, place, "right") - 1
                code = (ix.item[entry].astype(np.int64) * documents + doc) * wide + (place - ix.place[entry] + ahead)
                codes = np.union1d(codes, code)
    pair, start = codes // wide, codes % wide - ahead
    return pair // max(documents, 1), pair % max(documents, 1), start


def _best(own: np.ndarray, low: int, high: int, w: np.ndarray, starts: np.ndarray) -> tuple | None:
    """(first word, words, equal words) of the best stretch of item w along the document own[low:high]."""
    best = None
    portion = max(1, CELLS // max(len(w), 1))
    for p in range(0, len(starts), portion):
        some = starts[p : p + portion]
        if len(some) < 16:
            found = []
            for start in some.tolist():
                x, y = max(start, low), min(start + len(w), high)
                equal = own[x:y] == w[x - start : y - start]
                a, b = stretch(equal)
                found.append((x + a, b - a, int(equal[a:b].sum())))
        else:
            at = some[:, None] + np.arange(len(w))
            equal = (at >= low) & (at < high) & (own[np.clip(at, 0, len(own) - 1)] == w)
            a, b = stretches(equal)
            sums = np.concatenate([np.zeros((len(some), 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
            rows = np.arange(len(some))
            found = list(zip((some + a).tolist(), (b - a).tolist(), (sums[rows, b] - sums[rows, a]).tolist(), strict=True))
        found = [x for x in found if x[1] >= min(RUN, len(w)) and x[1]]
        if found:
            best = max([best, *found] if best else found, key=lambda x: (x[2], x[1], -x[0]))
            if best[2] == len(w):  # the whole item; the places that follow can't be better
                break
    return best


def leaks(own: np.ndarray, at: np.ndarray, ix: Index) -> list[list[tuple]]:
    """For each document (words own[at[i]:at[i + 1]]) the (item, start, words, equal words) of its best stretch of each item."""
    out: list[list[tuple]] = [[] for _ in range(len(at) - 1)]
    item, doc, start = _diagonals(own, at, ix)
    if len(item):
        cut = np.concatenate([[0], np.flatnonzero((np.diff(item) != 0) | (np.diff(doc) != 0)) + 1, [len(item)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            i, d = int(item[a]), int(doc[a])
            found = _best(own, int(at[d]), int(at[d + 1]), ix.words[i], start[a:b])
            if found:
                out[d].append((i, found[0] - int(at[d]), found[1], found[2]))
    return out


_built: dict[str, Index] = {}


def _index_of(held, least: int) -> Index:
    """The index of a broadcast block, built once in each Python worker; only the last one is kept."""
    name, ids, texts = held.value
    if name not in _built:
        _built.clear()
        _built[name] = index(ids, texts, least)
    return _built[name]


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[tuple[list, list]]:
    """ids and texts of items, about BLOCK hashes at a time."""
    items = benchmark.select(F.col(key).alias("id"), F.col(text).alias("t"))
    letters = items.agg(F.sum(F.length("t"))).first()[0] or 0
    many = -(-len(MASKS) * letters // (4 * BLOCK))  # words of four letters and a space, in the mean, or longer ones
    for i in range(many):
        own = items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(many)) == i).orderBy("id", "t").toArrow()
        if own.num_rows:
            yield own.column("id").to_pylist(), own.column("t").to_pylist()


def flag(rows: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """rows with leaks: the benchmark items that contaminate each, with the stretch's first word, length and equal words."""
    rows = rows.drop(*({"leaks"} - {text}))
    spark, names = rows.sparkSession, rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("leaks", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in _LEAK])))])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in _LEAK]))
    out = rows.withColumn("leaks", F.array().cast(schema["leaks"].dataType))
    held = None
    for ids, texts in _blocks(benchmark, item_key, item_text):
        if held is not None:
            out = written(out, "leaks")
            held.unpersist()
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, ids, texts))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ix = _index_of(held, least)
            for batch in batches:
                for piece in pieces(batch, text):
                    found = leaks(*words(piece.column(text), ALNUM), ix)
                    new = [
                        sorted((old or []) + [dict(zip(_LEAK, (ix.ids[i], *x), strict=True)) for i, *x in f], key=lambda x: (x["item_id"] is None, x["item_id"]))
                        for old, f in zip(piece.column("leaks").to_pylist(), found, strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(new, kind)], [*names, "leaks"])

        out = arrow_map(out, run, schema)
    return out
