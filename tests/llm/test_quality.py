import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomgrain.llm import quality
from loomgrain.llm.entry import op3_quality
from loomgrain.llm.langid import fold


def quality_fold(key):
    return fold(key, 4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(out) > 500
    assert np.mean(out.predicted == out.quality) > 0.93, np.mean(out.predicted == out.quality)
    ranks = out.score.rank()
    pos = out.quality == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95, auc


def test_interaction_is_learned():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9
    by_hand = model.intercept + sum(t[np.searchsorted(e, v, "right")] for t, e, v in zip(model.tables, model.edges, x[7]))
    by_hand += sum(t[tuple(np.searchsorted(model.pair_edges[j], x[7, j], "right") for j in ab)] for ab, t in model.pairs.items())
    assert model.score(x[7:8])[0] == pytest.approx(1 / (1 + np.exp(-by_hand)))


def test_features_by_hand():
    x = quality.featurise(pa.array(["Ab ab cd\ncd!", None, ""]))
    f = dict(zip(quality.FEATURES, x[0]))
    assert f["share_upper"] == 1 / 12 and f["share_bang"] == 1 / 12 and f["mean_word"] == 9 / 4
    assert f["distinct_words"] == 3 / 4 and f["repeated_next"] == 1 / 4 and f["distinct_lines"] == 1
    assert not x[1:].any()


def plain_features(text):
    """FEATURES of one text by plain Python."""
    raw = (text or "").encode()
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = [w for w in re.split(rb"[ \t-\r]+", lowered) if w]
    lines = [x for x in raw.split(b"\n") if x]
    of = lambda test: sum(map(test, raw)) / max(len(raw), 1)
    inside = lambda chars: lambda b: b in chars
    some, pairs = max(len(words), 1), list(zip(words, words[1:]))
    counts = Counter(words)
    shares = [of(lambda b: 65 <= b <= 90), of(lambda b: 97 <= b <= 122), of(lambda b: 48 <= b <= 57), of(lambda b: b >= 128)]
    shares += [of(inside(c)) for c in (b"!.?", b"!", b",;", b"#$%&*+<=>@^_`~", b"|", b"\"'()[\\]{}", b"-/:\\")]
    return shares + [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / some, math.log1p(len(lines)), math.log1p(len(raw) / max(len(lines), 1)), len(counts) / some,
        sum(a == b for a, b in pairs) / some, len(set(lines)) / max(len(lines), 1) if words else 0.0, max(counts.values(), default=0) / some, sum(len(w) > 14 for w in words) / some,
        sum(len(w) == 1 for w in words) / some, len(set(pairs)) / max(len(words) - 1, 1),
    ]


def test_every_score_by_brute_force(spark):
    """The whole query against plain features, and a loop over the model's tables."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    x = quality.features(docs.select("doc_id", (quality_fold("doc_id") == 2).alias("held_out"), "text"))
    model = quality.train(x.filter("NOT held_out"), spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in x.filter("held_out").collect()} == {d for d in texts if zlib.crc32(str(d).encode()) % 4 == 2}
    for r in op3_quality(spark, sf).collect():
        f = plain_features(texts[r.doc_id])
        total = model.intercept
        for value, edges, table in zip(f, model.edges, model.tables, strict=True):
            total += table[sum(e <= value + 1e-12 for e in edges)]
        for (a, b), table in model.pairs.items():
            total += table[sum(e <= f[a] + 1e-12 for e in model.pair_edges[a]), sum(e <= f[b] + 1e-12 for e in model.pair_edges[b])]
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6) and r.predicted == (r.score >= 0.7)


def test_trees_by_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(60):
        g, h = rng.normal(size=6), rng.random(6) * 4 + 0.1
        gain = lambda i, j: g[i:j].sum() ** 2 / (h[i:j].sum() + 1)
        cuts = [c for c in range(1, 6) if h[:c].sum() >= 1 and h[c:].sum() >= 1]
        best = max(cuts, key=lambda c: gain(0, c) + gain(c, 6), default=None)
        got = quality._tree(g, h, 1)
        if best is not None and gain(0, best) + gain(best, 6) > gain(0, 6) + 1e-9:
            assert np.allclose(got, [g[:best].sum() / (h[:best].sum() + 1)] * best + [g[best:].sum() / (h[best:].sum() + 1)] * (6 - best))
        else:
            assert np.allclose(got, g.sum() / (h.sum() + 1))
        g2, h2 = rng.normal(size=(4, 5)), rng.random((4, 5))
        part = lambda a, b, c, d: g2[a:b, c:d].sum() ** 2 / (h2[a:b, c:d].sum() + 1)
        every = {(i, j): part(0, i, 0, j) + part(0, i, j, 5) + part(i, 4, 0, j) + part(i, 4, j, 5) for i in range(1, 4) for j in range(1, 5)}
        i, j = max(every, key=every.get)
        found, values = quality._quadrants(g2, h2)
        assert found == pytest.approx(every[i, j] - part(0, 4, 0, 5))
        assert found <= 0 or values[0, 0] == pytest.approx(g2[:i, :j].sum() / (h2[:i, :j].sum() + 1))


def test_defined_cases(spark):
    rows = spark.createDataFrame([(1, None, 2), (None, "", 2), (3, "a" * 300_000, 2), (3, "b c", 2)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    x = quality.features(rows)
    out = quality.score(x, quality.train(x, labels)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.score(x, quality.train(x, labels.limit(0))).collect()} == {0.5}
    assert quality.score(quality.features(rows.limit(0)), quality.fit(np.zeros((0, 23)), np.zeros(0))).collect() == []
