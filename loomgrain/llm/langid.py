"""Language ID by interpolated Kneser-Ney character models, one for each language.

A text's words (runs of letters, lower-cased) are sequences of characters between word
boundaries. For each language an order-5 model gives every character a probability after
up to four preceding ones: the highest order uses counts, lower orders the number of
different characters an n-gram follows, each order discounted by n1 / (n1 + 2 n2) and
interpolated with the next, down to a uniform distribution over the known characters.

The models of all languages share sorted arrays of n-gram hashes, with a row of log
probabilities (one for each language) beside each hash, and sorted arrays of contexts
with their interpolation weights. A text's cross-entropy is the mean over its characters;
the language with the lowest wins. A piece's distinct words are scored once and weighted.

Fit: of each language at most SAMPLE different texts are drawn by their hash, however
often each occurs, and of these as many as begin within SAMPLE_CHARS characters. The
sample is written once, so every use of it sees the same rows. Its words are counted on
the executors; the tables are built on the driver from the distinct words, which the two
parameters bound. Rejection: every fifth text of the sample is left out of the counts and
scored on the executors, and a text is rejected if its cross-entropy is above its
language's mean there by more than REJECT standard deviations, or if it has no letter.

Defined cases: null text, or one without a letter, is `und` with score 0 and rejected; a
tie goes to the first language in alphabetical order; a null label is not learned from;
without any labelled row every text is `und`; repeated rows each get their result; an
empty table gives no rows; other columns pass through, results replace their namesakes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.llm.batches import arrow_map, mix, pieces, span_hashes
from loomgrain.session import written

ORDER = 5
SAMPLE = 500
SAMPLE_CHARS = 3_000_000
OVER = 1.5  # drawn before the exact cut, as counts of different texts are estimates
FEW_LABELS = 10_000
REJECT = 8.0
UNKNOWN = "und"
_EDGE = 0  # the code of a word boundary
_HAS_LETTER = re.compile(r"[^\W\d_]")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def word_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts as (codes, begin, end), and for each word place its word and its text."""
    raws = [t.lower().encode("utf-32-le", "replace") for t in texts]
    data = np.frombuffer(b"\n\0\0\0".join(raws) + b"\n\0\0\0", np.uint32)
    starts = np.cumsum([0, *(len(r) // 4 + 1 for r in raws)])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = _letters()[data]
    edges = np.diff(inside)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    _, first, place = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
    return data, begin[first], end[first], place, np.searchsorted(starts, begin, "right") - 1


def _padded(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words laid out with ORDER - 1 boundaries before and one after each: codes, and for each predicted character its place, word and context length."""
    lens = end - begin
    room = lens + ORDER
    offset = np.concatenate([[0], np.cumsum(room)])
    codes = np.zeros(offset[-1], np.uint64)
    word = np.repeat(np.arange(len(lens)), lens)
    inner = np.arange(len(word)) - np.repeat(np.cumsum(lens) - lens, lens)
    codes[offset[word] + ORDER - 1 + inner] = data[begin[word] + inner]
    event_word = np.repeat(np.arange(len(lens)), lens + 1)
    nth = np.arange(len(event_word)) - np.repeat(np.cumsum(lens + 1) - (lens + 1), lens + 1)
    return codes, offset[event_word] + ORDER - 1 + nth, event_word, nth


def _grams(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size codes that end at each place, boundaries included."""
    out = np.full(len(at), size, np.uint64)
    for k in range(size - 1, -1, -1):
        out = out * np.uint64(0xD6E8FEB86659FD93) + codes[at - k] + np.uint64(1)
    return mix(out)


@dataclass
class Models:
    """By order 1..ORDER: sorted n-grams and their log2 probabilities; sorted contexts and their log2 weights."""

    languages: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    weight: list[np.ndarray]
    floor: float
    limit: np.ndarray | None = None

    def score_words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sum of log2 probabilities of each word's characters and closing boundary, for each language."""
        codes, at, word, _ = _padded(data, begin, end)
        total = np.zeros((len(at), len(self.languages)), np.float32)
        left = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            found, row = _lookup(self.grams[k - 1], _grams(codes, at[left], k))
            total[left[found]] += self.logp[k - 1][row[found]]
            left = left[~found]
            if not len(left):
                break
            seen, row = _lookup(self.contexts[k - 1], _grams(codes, at[left] - 1, k - 1))
            total[left[seen]] += self.weight[k - 1][row[seen]]
        total[left] += self.floor
        if not len(begin):
            return np.zeros((0, len(self.languages)))
        return np.add.reduceat(total, np.flatnonzero(np.diff(word, prepend=-1)), axis=0, dtype=np.float64)

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean bits a character for each text and language (infinite without letters), and the character counts."""
        data, begin, end, place, text = word_table(texts)
        bits, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        if len(place):
            words = -self.score_words(data, begin, end)
            lens = (end - begin + 1).astype(float)
            size = np.bincount(text, lens[place], len(texts))
            for i in range(len(self.languages)):
                bits[:, i] = np.bincount(text, words[place, i], len(texts))
        return np.where(size[:, None] > 0, bits / np.maximum(size, 1)[:, None], np.inf), size


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def fit(words: list[tuple[str, str, int]]) -> Models:
    """words: (language, word, count). The counts' tables for all languages at once."""
    languages = sorted({w[0] for w in words})
    number = {x: i for i, x in enumerate(languages)}
    many = len(languages)
    raw = [w[1].encode("utf-32-le") for w in words]
    data = np.frombuffer(b"".join(raw), np.uint32)
    ends = np.cumsum([len(r) // 4 for r in raw])
    begins = ends - [len(r) // 4 for r in raw]
    codes, at, word, nth = _padded(data, begins, ends)
    lang = np.array([number[w[0]] for w in words])[word]
    weight = np.array([w[2] for w in words], float)[word]
    alphabet = len(np.unique(codes[at])) + 1
    out = Models(languages, [], [], [], [], float(-np.log2(alphabet)))
    below_keys, below = np.zeros(0, np.uint64), np.zeros((0, many))
    for k in range(1, ORDER + 1):
        grams = _grams(codes, at, k)
        keys, first, row = np.unique(grams, return_index=True, return_inverse=True)
        counts = np.zeros((len(keys), many))
        if k == ORDER:
            np.add.at(counts, (row, lang), weight)
        else:  # how many different characters precede it: distinct (k+1)-grams of the language
            longer, one, inverse = np.unique(_grams(codes, at, k + 1), return_index=True, return_inverse=True)
            seen = np.zeros((len(longer), many), bool)
            seen[inverse, lang] = True
            np.add.at(counts, row[one], seen.astype(float))
            # An n-gram that starts at the word's beginning has only the boundary before it: use its count.
            opening = nth < k - 1
            start = np.zeros((len(keys), many))
            np.add.at(start, (row[opening], lang[opening]), weight[opening])
            counts = np.where(start > 0, start, counts)
        context, place = np.unique(_grams(codes, at[first] - 1, k - 1), return_inverse=True)
        once, twice = (counts == 1).sum(0), (counts == 2).sum(0)
        discount = np.where(once > 0, once / np.maximum(once + 2.0 * twice, 1), 0.5).clip(0.1, 0.95)
        total, kinds = np.zeros((len(context), many)), np.zeros((len(context), many))
        np.add.at(total, place, counts)
        np.add.at(kinds, place, (counts > 0).astype(float))
        lam = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
        if k == 1:
            lower = np.full((len(keys), many), 1.0 / alphabet)
        else:
            lower = below[np.searchsorted(below_keys, _grams(codes, at[first], k - 1))]
        share = np.where(total[place] > 0, np.maximum(counts - discount, 0) / np.maximum(total[place], 1e-9), 0)
        prob = share + lam[place] * lower
        out.grams.append(keys)
        out.logp.append(np.log2(np.maximum(prob, 1e-12)).astype(np.float32))
        out.contexts.append(context)
        out.weight.append(np.log2(np.maximum(lam, 1e-9)).astype(np.float32))
        below_keys, below = keys, prob
    return out


def _text_of(batch: pa.RecordBatch, text: str) -> list[str]:
    return [x or "" for x in batch.column(text).to_pylist()]


def _counted(text: str, label: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                labels = np.array(piece.column(label).to_pylist(), object)
                data, begin, end, place, where = word_table(_text_of(piece, text))
                names, number = np.unique(labels.astype(str), return_inverse=True)
                cell, counts = np.unique(place * len(names) + number[where], return_counts=True)
                spelled = [data[begin[w] : end[w]].tobytes().decode("utf-32-le") for w in (cell // len(names)).tolist()]
                arrays = [pa.array(names[cell % len(names)].tolist(), pa.string()), pa.array(spelled, pa.string()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["label", "word", "n"])

    return run


def _judged(label: str, text: str, held):
    """(label, bits) of texts that are long enough, under their own language's model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        number = {x: i for i, x in enumerate(m.languages)}
        for batch in batches:
            for piece in pieces(batch, text):
                bits, size = m.entropy(_text_of(piece, text))
                found = [(x, float(b[number[x]])) for x, b, n in zip(piece.column(label).to_pylist(), bits, size, strict=True) if n >= 20 and x in number]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["label", "bits"])

    return run


def drawn(rows: DataFrame, sample: int, chars: int) -> DataFrame:
    """label, text and nth (from 1) of the sample of each label's different texts."""
    hashed = rows.withColumn("h", F.xxhash64("text", F.lit(17)))
    sizes = written(hashed.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n")), "label-sizes")
    few = sizes.count() <= FEW_LABELS
    u = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    some = hashed.join(F.broadcast(sizes) if few else sizes, "label").filter(u * F.col("n") < OVER * sample).drop("n")
    order = Window.partitionBy("label").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h")
    before = F.coalesce(F.sum(F.length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = some.dropDuplicates(["label", "h"]).withColumns({"nth": F.row_number().over(order), "before": before})
    return ranked.filter((F.col("nth") <= sample) & (F.col("before") < chars)).select("label", "text", "nth")


def train(rows: DataFrame, label: str = "lang", text: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Models | None:
    """Fit on at most sample different texts of each label, about chars characters of them; four of five for counts and the rest for rejection."""
    rows = rows.select(F.col(label).alias("label"), F.col(text).alias("text")).filter("label IS NOT NULL AND text IS NOT NULL")
    picked = written(drawn(rows, sample, chars), "language-sample")
    counts = (
        arrow_map(picked.filter("nth % 5 <> 0").select("label", "text"), _counted("text", "label"), "label string, word string, n long")
        .groupBy("label", "word").agg(F.sum("n").alias("n")).toArrow()
    )
    words = list(zip(*(counts.column(c).to_pylist() for c in ("label", "word", "n")), strict=True))
    if not words:
        return None
    models = fit(sorted(words))
    models.limit = np.full(len(models.languages), np.inf)
    held = rows.sparkSession.sparkContext.broadcast(models)
    judged = arrow_map(picked.filter("nth % 5 = 0").select("label", "text"), _judged("label", "text", held), "label string, bits double")
    found = judged.groupBy("label").agg(F.count("*").alias("n"), F.avg("bits").alias("mean"), F.stddev_pop("bits").alias("spread")).collect()
    for r in found:  # at most one row a language
        if r.n >= 5:
            models.limit[models.languages.index(r.label)] = r["mean"] + REJECT * max(r.spread, 0.1)
    return models


_MADE = [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double"), ("bits", pa.float64(), "double"), ("rejected", pa.bool_(), "boolean")]


def identify(rows: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """rows with lang_pred, score, bits (cross-entropy a character; null without letters) and rejected."""
    rows = rows.drop(*({m[0] for m in _MADE} - {text}))
    held = rows.sparkSession.sparkContext.broadcast(models)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{n} {k}" for n, _, k in _MADE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for piece in pieces(batch, text):
                texts = _text_of(piece, text)
                made = [[UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)]
                if m is not None:
                    bits, size = m.entropy(texts)
                    for i in range(len(texts)):
                        if size[i] > 0:
                            best = int(np.argmin(bits[i]))
                            odds = np.exp2((bits[i, best] - bits[i]) * min(size[i], 64.0))
                            made[0][i], made[1][i] = m.languages[best], float(1 / odds.sum())
                            made[2][i], made[3][i] = float(bits[i, best]), bool(bits[i, best] > m.limit[best])
                arrays = [pa.array(v, k) for v, (_, k, _) in zip(made, _MADE, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], [*piece.schema.names, *(x[0] for x in _MADE)])

    return arrow_map(rows, run, schema)


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null keys are in no held-out fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(-1))
