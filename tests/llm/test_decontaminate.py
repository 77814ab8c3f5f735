import itertools
import random
import re
import string
import time

import numpy as np
import pyarrow as pa

from loomgrain.llm import decontaminate as D

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_stretch(equal):
    best = (0, 0)
    for a in range(len(equal)):
        for b in range(a + 1, len(equal) + 1):
            if equal[a] and equal[b - 1] and sum(equal[a:b]) >= D.IDENTITY * (b - a) - 1e-9 and b - a > best[1] - best[0]:
                best = (a, b)
    return best


def test_stretch_by_brute_force():
    r = random.Random(4)
    for _ in range(400):
        equal = np.array([r.random() < r.choice([0.3, 0.7, 0.9]) for _ in range(r.randint(0, 30))], bool)
        assert D.stretch(equal) == brute_stretch(equal.tolist()), equal


def test_stretches_are_the_same_for_many_rows():
    r = np.random.default_rng(5)
    equal = np.concatenate([r.random((200, 23)) < p for p in (0.2, 0.6, 0.8, 0.95)])
    a, b = D.stretches(equal)
    assert list(zip(a.tolist(), b.tolist())) == [D.stretch(e) for e in equal]


def test_masks_leave_no_placement_out():
    """Every way to replace a fifth of 9 to 25 words leaves a window of some mask whole."""
    for n in range(9, 26):
        inner = range(1, n - 1) if n < D.RUN else range(n)  # a shorter item's stretch begins and ends with equal words
        used = np.array(list(itertools.combinations(inner, n // 5)))
        free = np.ones((len(used), n), bool)
        free[np.arange(len(used))[:, None], used] = False
        hit = np.zeros(len(used), bool)
        for mask in D.MASKS:
            on = [i for i, c in enumerate(mask) if c == "1"]
            for s in range(n - len(mask) + 1):
                hit |= free[:, [s + i for i in on]].all(axis=1)
        assert hit.all(), n


def brute_leaks(docs, items):
    split = lambda t: [w for w in re.split("[^0-9a-z\x80-\U0010ffff]+", (t or "").translate(LOWER)) if w]
    out = {}
    for d, text in docs:
        own, found = split(text), []
        for i, item in items:
            w, best = split(item), None
            for start in range(-len(w) + 1, len(own)):
                low, high = max(start, 0), min(start + len(w), len(own))
                a, b = brute_stretch([own[x] == w[x - start] for x in range(low, high)])
                equal = sum(own[low + x] == w[low + x - start] for x in range(a, b))
                if len(w) >= D.LEAST and b - a >= min(D.RUN, len(w)) and (len(w) >= D.SPAN or equal == len(w)):
                    if best is None or (equal, b - a, -low - a) > (best[2], best[1], -best[0]):
                        best = (low + a, b - a, equal)
            if best:
                found.append((i, *best))
        out[d] = found
    return out


def test_same_as_brute_force(spark, monkeypatch):
    """Texts of few different words, with passages of every length altered up to the limit; repeated rows, ties, odd items."""
    r = random.Random(8)
    items = [(i, " ".join(r.choice(["a", "b", "c", f"x{i}", f"y{r.randint(0, 9)}"]) for _ in range(n))) for i, n in enumerate([6, 8, 9, 10, 12, 13, 15, 20, 26, 30])]
    items += [(20, items[5][1]), (21, "a " * 14), (22, None), (23, "a b"), (24, "a " * 10 + "b " * 10)]
    docs = []
    for d in range(60):
        w = items[r.randrange(len(items[:10]))][1].split()
        for _ in range(r.randint(0, len(w) // 5)):
            w[r.randrange(len(w))] = "z"
        body = [r.choice(["a", "b", "c", "dd"]) for _ in range(r.randint(0, 30))]
        docs.append((d, " ".join(body[:9] + w + body[9:])))
    docs += [(70, "A a " * 20), (71, "a " * 30 + "b"), (72, None), (73, "")]
    want = brute_leaks(docs, items)
    for hits, cells in ((D.HITS, D.CELLS), (7, 100)):
        monkeypatch.setattr(D, "HITS", hits)
        monkeypatch.setattr(D, "CELLS", cells)
        got = run(spark, docs + docs[:3], items)
        assert {d: [(x.item_id, x.start, x.n_words, x.n_equal) for x in v] for d, v in got.items()} == want


def test_very_repetitive_texts():
    """Time and memory follow the text where every place is a hit."""
    ix = D.index([1, 2], ["the " * 60, "the " * 30 + "end " * 30])
    own, at = D.words(pa.array(["the " * 50_000]), D.ALNUM)
    began = time.perf_counter()
    assert D.leaks(own, at, ix) == [[(0, 0, 60, 60), (1, 0, 30, 30)]]
    assert time.perf_counter() - began < 10


def made(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuü") for _ in range(r.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    items = [text(40) for _ in range(12)] + [text(7), text(3)]
    docs, want = [], []
    for i in range(120):
        body, kind = text(150), i % 6
        item = i % 12
        passage = list(items[item])
        if kind == 1:  # one word in six replaced
            for j in range(3, 40, 6):
                passage[j] = word()
        elif kind == 2:  # half of it
            passage = passage[10:30]
        elif kind == 3:  # too little of it
            passage = passage[5:15]
        elif kind == 4:
            passage = [w.upper() if w.isascii() else w for w in passage]
        elif kind == 5:
            passage = []
        at = r.randint(0, 150)
        docs.append((i, r.choice([" ", ", ", "\n"]).join(body[:at] + passage + body[at:])))
        want.append([] if kind in (3, 5) else [item])
    docs += [(500, " ".join(text(20) + items[12] + text(5))), (501, " ".join(items[13] + text(9))), (502, None), (503, "")]
    want += [[12], [], [], []]
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "")], want


def run(spark, docs, items):
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS leaks")
    return {r.doc_id: r.leaks for r in D.flag(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_planted_passages(spark):
    docs, items, want = made()
    got = run(spark, docs, items)
    assert [[x.item_id for x in got[d]] for d, _ in docs] == want
    whole = got[0][0]
    assert (whole.n_words, whole.n_equal) == (40, 40)


def test_blocks_and_empty(spark, monkeypatch):
    docs, items, want = made(2)
    monkeypatch.setattr(D, "BLOCK", 900)
    got = run(spark, docs, items)
    assert [sorted(x.item_id for x in got[d]) for d, _ in docs] == want
    assert all(x == [] for x in run(spark, docs, []).values()) and run(spark, [], items) == {}


def test_every_contained_item_is_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, x.item_id) for r in D.flag(docs, items).collect() for x in r.leaks}
    plain = lambda t: " ".join(t.lower().split())
    texts = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    contained = {(d, i.item_id) for i in items.collect() for d, t in texts if plain(i.text) in t}
    assert contained and contained <= got
    assert len({d for d, _ in got}) < 120
