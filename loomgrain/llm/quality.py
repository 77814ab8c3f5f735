"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a row of FEATURES (shares of character classes, word and line statistics;
none of them the label, the language, the source or the id). Each feature is cut into
bins at sample quantiles. Training goes round the features; in its turn a feature gets
one shallow regression tree (up to four leaves over its ordered bins) fitted to the
logistic loss's gradient, and the tree's values are added to the feature's lookup table.
When the single tables are done, the feature pairs with the strongest remaining
interaction get two-way tables in the same way, by trees of one cut on each axis.
A score is the intercept plus a table entry for each feature and pair, by vectorised
indexing, through the logistic function.

Fit: at most SAMPLE labelled rows, drawn by hash; every text is scored, whole.

Defined cases: null and empty texts have all-zero features and are scored as any other;
a document with several labels has their mean, rounded half up; labels of unknown
documents are ignored; with no labels every score is 0.5; constant features get one bin
and no weight; repeated rows each get their score; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.batches import _ASCII_LOWER, NOT_SPACE, arrow_map, pieces, span_hashes, text_bytes, word_spans

SAMPLE = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 120, 60, 8, 0.15
CUT = 0.7


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


_CLASSES = {
    "upper": _class((65, 90)),
    "lower": _class((97, 122)),
    "digit": _class((48, 57)),
    "wide": _class((128, 255)),
    "stop": _class((33, 33), (46, 46), (63, 63)),
    "bang": _class((33, 33)),
    "comma": _class((44, 44), (59, 59)),
    "symbol": _class((35, 38), (42, 43), (60, 62), (64, 64), (94, 96), (126, 126)),
    "bar": _class((124, 124)),
    "quote": _class((34, 34), (39, 41), (91, 93), (123, 123), (125, 125)),
    "slash": _class((45, 45), (47, 47), (58, 58), (92, 92)),
}
FEATURES = [f"share_{c}" for c in _CLASSES] + [
    "log_bytes", "log_words", "mean_word", "log_lines", "mean_line", "distinct_words", "repeated_next",
    "distinct_lines", "most_frequent", "long_words", "one_letter", "distinct_pairs",
]


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)


def featurise(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, starts = text_bytes(column)
    n = len(starts) - 1
    size = np.diff(starts) - 1.0
    safe = np.maximum(size, 1)
    out = [_per_text(t[data], starts) / safe for t in _CLASSES.values()]
    begin, end = word_spans(data, NOT_SPACE)
    words = span_hashes(_ASCII_LOWER[data], begin, end)
    at = np.searchsorted(begin, starts)
    count = np.diff(at).astype(float)
    some = np.maximum(count, 1)
    lens = end - begin
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    feeds = np.flatnonzero(data == 10)
    line_begin = np.concatenate([[0], feeds[:-1] + 1]) if len(feeds) else np.zeros(0, np.int64)
    full = feeds > line_begin
    line_begin, line_end = line_begin[full], feeds[full]
    lines = span_hashes(data, line_begin, line_end)
    line_at = np.searchsorted(line_begin, starts)
    line_count = np.diff(line_at).astype(float)
    pairs = words[:-1] * np.uint64(3) + words[1:] if len(words) > 1 else words[:0]
    distinct, most, line_kinds, pair_kinds = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        if count[i]:
            _, c = np.unique(words[at[i] : at[i + 1]], return_counts=True)
            distinct[i], most[i] = len(c), c.max()
            pair_kinds[i] = len(np.unique(pairs[at[i] : at[i + 1] - 1]))
            line_kinds[i] = len(np.unique(lines[line_at[i] : line_at[i + 1]]))
    out += [
        np.log1p(size), np.log1p(count), _sum(lens, at) / some,
        np.log1p(line_count), np.log1p(size / np.maximum(line_count, 1)), distinct / some, _per_text(same, at) / some,
        line_kinds / np.maximum(line_count, 1), most / some, _per_text(lens > 14, at) / some, _per_text(lens == 1, at) / some,
        pair_kinds / np.maximum(count - 1, 1),
    ]
    return np.column_stack(out)


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)


@dataclass
class Gam:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (a, b), table in self.pairs.items():
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)
    return cuts[cuts > values.min()] if len(values) else cuts


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 1.0) -> np.ndarray:
    """Values over ordered bins of a regression tree with at most 2**depth leaves. g, h: gradient and hessian sums of each bin."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = g.sum() - left_g, h.sum() - left_h
        gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1)
        gain[(left_h < least) | (right_h < least)] = -1
        cut = int(np.argmax(gain))
        if gain[cut] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            value = np.concatenate([_tree(g[: cut + 1], h[: cut + 1], depth - 1), _tree(g[cut + 1 :], h[cut + 1 :], depth - 1)])
    return value


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut on each axis of a two-way grid: gain over no cut, and the values of its four parts."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(m, 0), 1), ((1, 0), (1, 0))) for m in (g, h))
    r, c = g.shape
    best, cut = -1.0, (0, 0)
    base = g.sum() ** 2 / (h.sum() + 1)
    parts = lambda m, i, j: (m[i, j], m[i, c] - m[i, j], m[r, j] - m[i, j], m[r, c] - m[i, c] - m[r, j] + m[i, j])
    for i in range(1, r):
        for j in range(1, c):
            gain = sum(a * a / (b + 1) for a, b in zip(parts(cg, i, j), parts(ch, i, j), strict=True)) - base
            if gain > best:
                best, cut = gain, (i, j)
    out = np.zeros_like(g)
    if best > 0:
        i, j = cut
        v = [a / (b + 1) for a, b in zip(parts(cg, i, j), parts(ch, i, j), strict=True)]
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """x: rows of features, y: labels 0 or 1."""
    many = x.shape[1]
    if not len(y):
        return Gam(0.0, [np.zeros(0)] * many, [np.zeros(1)] * many, [np.zeros(0)] * many, {})
    rate = np.clip(y.mean(), 0.001, 0.999)
    edges = [_edges(x[:, j], BINS) for j in range(many)]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(many)]
    cell = [np.searchsorted(edges[j], x[:, j], "right") for j in range(many)]
    model = Gam(float(np.log(rate / (1 - rate))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, {})
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(many):
            if len(edges[j]):
                g, h = slopes()
                step = RATE * _tree(*(np.bincount(cell[j], w, len(edges[j]) + 1) for w in (g, h)))
                model.tables[j] += step
                total += step[cell[j]]
    small = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(many)]

    def grid(a: int, b: int, w: np.ndarray) -> np.ndarray:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(small[a] * shape[1] + small[b], w, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    usable = [j for j in range(many) if len(coarse[j])]
    ranked = sorted(((_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in combinations(usable, 2)), reverse=True)
    for _, a, b in ranked[:PAIRS]:
        model.pairs[a, b] = np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in model.pairs.items():
            g, h = slopes()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            table += step
            total += step[small[a], small[b]]
    return model


def features(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows without the text, with _x, the array of FEATURES."""
    kept = [f for f in rows.schema if f.name not in (text, "_x")]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["_x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                x = featurise(piece.column(text))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), flat], [*names, "_x"])

    return arrow_map(rows.select(*names, text), run, schema)


def train(featured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Gam:
    """Fit on at most sample of the featured rows that have a label."""
    each = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(
        F.floor(F.avg(label) + 0.5).cast("int").alias("_y")
    )
    drawn = F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << 30))
    known = each.count()
    share = min(1.0, 0.9 * sample / known) if known else 1.0
    picked = each.filter(drawn < int(share * (1 << 30)) + 1)
    got = featured.join(picked, key).select("_x", "_y").limit(sample).toArrow()
    x = np.array(got.column("_x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column("_y").to_pylist(), float)
    order = np.lexsort([*x.T, y])  # the rows' order of arrival must not matter
    return fit(x[order], y[order])


def score(featured: DataFrame, model: Gam) -> DataFrame:
    """featured with score and predicted instead of _x."""
    held = featured.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in featured.schema if f.name not in ("_x", "score", "predicted")]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("_x").flatten()).reshape(-1, len(FEATURES))
            p = held.value.score(x)
            arrays = [pa.array(p), pa.array((p >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *arrays], [*names, "score", "predicted"])

    return featured.select(*names, "_x").mapInArrow(run, schema)
