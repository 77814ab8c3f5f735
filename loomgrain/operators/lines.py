"""Documents' lines and fixed chunks as runs for ranking, and the passages that may stand in a document: one look at a text.

A chunk's tokens are those of its lines, as no token spans white space, so a text is
tokenised once, in Arrow batches, with no shuffle and no block written. Lines are those of
views.line_blocks, chunks those of fixed.chunks; a document is one row (doc_id, text), its key its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.functions import folds as P
from loomgrain.functions import text as T
from loomgrain.operators import bm25, ranking
from loomgrain.operators.fixed import FixedConfig

PLACE = 10_000_000  # lines of a document, at most, in a unit's place in the corpus
STRATEGIES = ("line", "fixed")
LEADING = 5  # tokens of a passage that lead it to a document, at most
TOKENS = 1 << 19  # of the documents in a run
_TOKEN = re.compile(f"{T.LATIN_TOKEN}|[{T.CJK}]|{T.SYMBOL}")
#: Numbered first: what the token estimate counts and no ranking does, then the placeholder.
_DROPPED = (*T.QUERY_STOPWORDS, *"$€£¥=<>≤≥±×÷")
_BECOME_LATIN = "\u0130\u212a"  # characters outside the token classes whose lower case is within
_OWN = [f for f in ranking.RUN.split(", ") if not f.startswith("terms ")]
_ROW = ", ".join(["terms array<string>", *(f"{s}_{f}" for s in STRATEGIES for f in _OWN), "docs array<bigint>", "keys array<int>"])


def leading(needle: str) -> tuple[str, ...]:
    """The first tokens of a normalised lower-cased passage's inner words, which stand in a row wherever it does."""
    return tuple(_TOKEN.findall(" ".join(needle.split(" ")[1:-1]))[:LEADING])


def runs(docs: DataFrame, keys: list[tuple[str, ...]], config: FixedConfig = FixedConfig()) -> DataFrame:
    """docs (doc_id long, text) as rows of _ROW: by strategy what ranking.RUN says, the terms shared; docs and keys: where tokens of keys[key] stand in a row."""
    return ranking.small_blocks(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_runs(keys, config), _ROW), "runs")


def of(held: DataFrame, strategy: str) -> DataFrame:
    """runs()' rows for one strategy, as ranking.RUN."""
    return held.select("terms", *(F.col(f"{strategy}_{name}").alias(name) for name in (f.split(" ")[0] for f in _OWN)))


def met(held: DataFrame) -> DataFrame:
    """doc_id, key: which keys stand in which documents."""
    return held.select(F.explode(F.arrays_zip("docs", "keys")).alias("x")).select(F.col("x.docs").alias("doc_id"), F.col("x.keys").alias("key")).distinct()


class _Run:
    """Documents that are gathered: their tokens, by line and by window, and how many of them each unit has."""

    def __init__(self) -> None:
        self.tokens, self.docs, self.doc_sizes = [], [], []
        self.lines, self.line_sizes, self.chunk_of = [], [], []  # a line's chunk, by place; -1 where it is cut
        self.chunks, self.cut_tokens, self.cut_sizes, self.cut_chunks = [], [], [], []
        self.odd: list[tuple[int, list[str]]] = []  # documents that are looked for passages in lower case

    def add(self, doc: int, text: str, config: FixedConfig) -> None:
        target, step = config.target_tokens, max(1, config.target_tokens - max(0, config.overlap_tokens))
        began, index, held, opened = len(self.tokens), 0, 0, False
        for order, line in enumerate(text.split("\n"), 1):
            found = _TOKEN.findall(line)
            if not found and not P.normalize(line):
                continue
            size = len(found) or 1
            self.tokens += found
            self.lines.append(doc * PLACE + order)
            self.line_sizes.append(len(found))
            if size > target:
                opened = False
                self.chunk_of.append(-1)
                for window in windows(P.normalize(line), target, step):
                    index += 1
                    found = _TOKEN.findall(window)
                    self.cut_tokens += found
                    self.cut_sizes.append(len(found))
                    self.cut_chunks.append(len(self.chunks))
                    self.chunks.append(doc * PLACE + index)
                continue
            if not opened or held + size > target:
                index, held, opened = index + 1, 0, True
                self.chunks.append(doc * PLACE + index)
            held += size
            self.chunk_of.append(len(self.chunks) - 1)
        self.docs.append(doc)
        self.doc_sizes.append(len(self.tokens) - began)
        if any(c in text for c in _BECOME_LATIN):
            self.odd.append((doc, _TOKEN.findall(text.lower())))

    def row(self, keys: list[tuple[str, ...]]) -> pa.RecordBatch:
        spelled = pa.array([*self.tokens, *self.cut_tokens, *(t for _, tokens in self.odd for t in tokens)], pa.string()).dictionary_encode()
        first = [*_DROPPED, bm25.EMPTY_TOKEN, *(t for k in keys for t in k)]
        numbers = pa.concat_arrays([pa.array(first, pa.string()), pc.ascii_lower(spelled.dictionary)]).dictionary_encode()
        terms, number = numbers.dictionary, np.asarray(numbers.indices, np.int64)
        every = number[len(first) :][np.asarray(spelled.indices)]
        ids, cut, odd = np.split(every, np.cumsum([len(self.tokens), len(self.cut_tokens)]))
        ends = np.cumsum([len(_DROPPED) + 1, *map(len, keys)])
        keys = [tuple(k.tolist()) for k in np.split(number[: len(first)], ends)[1:-1]]
        line = np.repeat(np.arange(len(self.lines)), np.array(self.line_sizes, np.int64))
        chunk = np.array(self.chunk_of, np.int64)[line]
        whole = chunk >= 0
        chunk = np.concatenate([chunk[whole], np.repeat(np.array(self.cut_chunks, np.int64), np.array(self.cut_sizes, np.int64))])
        units = {"line": (self.lines, line, ids), "fixed": (self.chunks, chunk, np.concatenate([ids[whole], cut]))}
        found = {}
        for strategy, (names, row, tokens) in units.items():
            kept = tokens >= len(_DROPPED)
            row, tokens = row[kept], tokens[kept]
            none = np.flatnonzero(np.bincount(row, minlength=len(names)) == 0)
            row, tokens = np.append(row, none), np.append(tokens, np.full(len(none), len(_DROPPED)))
            found[strategy] = ranking.counted_run(np.array(names, np.int64), row, tokens, len(terms))
        used = np.flatnonzero(sum(found[s]["df"] for s in STRATEGIES))
        place = np.zeros(max(1, len(terms)), np.int32)
        place[used] = np.arange(len(used))
        columns = {"terms": ranking.one_row(terms.take(pa.array(used)))}
        for s in STRATEGIES:
            ids_of = np.frombuffer(found[s]["ids"][0].as_buffer(), np.int32)
            found[s] |= {"df": ranking.one_row(found[s]["df"][used]), "ids": ranking.blob(place[ids_of])}
            columns |= {f"{s}_{name}": values for name, values in found[s].items()}
        pairs = _standing(ids, np.repeat(np.array(self.docs, np.int64), np.array(self.doc_sizes, np.int64)), keys)
        if self.odd:
            pairs |= _standing(odd, np.repeat(np.array([d for d, _ in self.odd], np.int64), [len(tokens) for _, tokens in self.odd]), keys)
        some = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        columns |= {"docs": ranking.one_row(some[:, 0].copy()), "keys": ranking.one_row(some[:, 1].astype(np.int32))}
        names = [f.split(" ")[0] for f in _ROW.split(", ")]
        return pa.RecordBatch.from_arrays([columns[name] for name in names], names)


def windows(text: str, most: int, step: int) -> Iterator[str]:
    """T.word_windows of normalised text that is over most tokens."""
    words = P.mixed(text) if P.has_cjk(text) else text.split(" ")
    for at in range(0, max(0, -(-(len(words) - most) // step)) * step + 1, step):
        yield P.join(words[at : at + most])


def _hashed(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each size of ids in a row, in 64 bits."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + len(out)].astype(np.uint64)
    return out


def _standing(ids: np.ndarray, doc: np.ndarray, keys: list[tuple[int, ...]]) -> set[tuple[int, int]]:
    """(document, key) of keys that stand in ids; some more by chance, as only hashes are compared and a row may reach into the next document."""
    found: set[tuple[int, int]] = set()
    for size in sorted({len(k) for k in keys}):
        which = np.array([i for i, k in enumerate(keys) if len(k) == size])
        wanted = np.array([_hashed(np.array(keys[i]), size)[0] for i in which], np.uint64)
        order = np.argsort(wanted)
        which, wanted = which[order], wanted[order]
        hashes = _hashed(ids, size)
        at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
        hit = np.flatnonzero(wanted[at] == hashes)
        for d, h in set(zip(doc[hit].tolist(), hashes[hit].tolist(), strict=True)):
            a, b = (int(np.searchsorted(wanted, np.uint64(h), side)) for side in ("left", "right"))
            found |= {(d, int(k)) for k in which[a:b]}
    return found


def _runs(keys: list[tuple[str, ...]], config: FixedConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Run()
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                if text is None:
                    continue
                held.add(docs[i], text, config)
                if len(held.tokens) >= TOKENS:
                    yield held.row(keys)
                    held = _Run()
        if held.docs:
            yield held.row(keys)

    return run
