import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomgrain.llm import jaccard as J

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    """(doc_id, n, component) of each row by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def ours(spark, rows):
    out = J.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return Counter(map(tuple, out.collect()))


def corpus(seed, bases=12, copies=14, size=60):
    """Groups of copies with edits around the threshold, a shared passage, exact copies, and odd rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for _ in range(bases):
        base = [word() for _ in range(r.randint(6, size))]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                text[r.randrange(len(text))] = word()
            joined = r.choice([" ", "\n", "\t "]).join(text)
            rows.append(r.choice([joined, joined.upper() if joined.isascii() else joined, joined + " " + passage]))
    rows += [None, "", "  \n", "one", "One", "one two three four", "a b c d e", "A b c d e "] + ["hot copy of a text with words"] * 40
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_same_as_brute_force(spark):
    rows = corpus(1)
    assert ours(spark, rows) == brute(rows)


def test_repeated_ids_and_nulls(spark):
    rows = corpus(5, bases=3)
    rows += rows[:5] + [(1, "another text under the same id here"), (4, rows[0][1]), (None, rows[3][1]), (None, "alone in the world with no id"), (None, None)]
    assert ours(spark, rows) == brute(rows)


def test_small_parts_hot_tokens_and_splitting(spark, monkeypatch):
    rows = corpus(7, bases=6, copies=30)
    want = brute(rows)
    for name, value in {"RANGE": 40, "FAN": 3, "COPIES": -1, "GROUP_BYTES": 2000, "SLOTS": (2,)}.items():
        monkeypatch.setattr(J, name, value)
    assert ours(spark, rows) == want


def test_bytes_of_the_exchange_at_scale():
    """A group's blobs stay below three bytes a byte of text, however many parts an exchange makes (30 GB and 600 GB of text)."""
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(300)) for _ in range(2100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    size = sum(map(len, texts))
    weigh = lambda table: sum(pc.sum(pc.fill_null(pc.binary_length(table.column(c)), 0)).as_py() for c in ("groups", "entries", "docs")) + 24 * table.num_rows
    held = type("Held", (), {"value": np.zeros(0, np.uint64)})
    for parts in (8, 3333, 65536):
        blobs = pa.Table.from_batches(list(J._packed("text", parts, min(parts, J.FAN), held)(iter([batch]))))
        assert weigh(blobs) < 3 * size
        route = np.asarray(blobs.column("route"))
        if parts > J.FAN:
            finer = [J._split_again(parts, False)(blobs.filter(pa.array(route == x))) for x in range(0, J.FAN, 16)]
            assert sum(map(weigh, finer)) * 16 < 3 * size
            assert sum(J._opened(t, np.uint64)[1].size for t in finer) == sum(J._opened(blobs.filter(pa.array(route == x)), np.uint64)[1].size for x in range(0, J.FAN, 16))


def test_copies_of_a_third_of_the_rows(spark, monkeypatch):
    """Sets that very many rows have, and empty sets, are joined apart from the others."""
    rows = [(i, "one hot text that a third of all rows hold" if i % 3 == 0 else None if i % 3 == 1 else f"own words {i} of a row and more {i}") for i in range(600)]
    assert ours(spark, rows) == brute(rows)
    monkeypatch.setattr("loomgrain.llm.components.MOST", 3)
    rows = corpus(9, bases=4, copies=25)
    assert ours(spark, rows) == brute(rows)


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i * 7919 % 5000}" for i in range(120_000))
    rows = [(1, long), (2, long + " end"), (3, long.replace("w17 ", "x ")), (4, "short one of some words here")]
    frame = spark.createDataFrame([(*x, "q", 1, "z", 2) for x in rows], "doc_id long, text string, digest string, n long, label string, component_id int")
    found = J.similar_links(frame).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows) and frame.count() == len(found)


def test_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_LEAST", 20)
    common = "these six words are found everywhere here"
    rows = [(i, f"{common} {' '.join(f'w{i}x{k}' for k in range(i % 5))}") for i in range(150)]
    assert ours(spark, rows) == brute(rows)


def test_empty_and_documents(spark):
    assert ours(spark, []) == Counter() and ours(spark, [(1, None)]) == Counter([(1, 0, 1)])
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert ours(spark, docs) == brute(docs)


def test_links_are_counted(spark, monkeypatch):
    rows = corpus(3, bases=5) + [(900, None), (901, "alone in the world")]
    sets = []
    for _, text in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    link = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = {rows[i][0]: sum(i != j and bool(a) and bool(b) and link(a, b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in J.similar_links(frame).collect()} == want
    monkeypatch.setattr(J, "BLOCK_SETS", 3)
    monkeypatch.setattr(J, "COLUMNS", 7)
    found = J.similar_links(frame).collect()
    assert {r.doc_id: r.n_links for r in found} == want and len(found) == len(rows)
