import random

from loomgrain.llm import licenses as L

SCHEMA = "doc_id long, text string, labels int"


def brute(text):
    words = L.words_of(text or "")
    base = [(i, t.label) for t in L.PHRASES for i in range(len(words)) if words[i : i + len(t.words)] == t.words]
    return len(words), base


def brute_notices(text, anchors):
    """Places of notices: the anchor's key phrase, the others within the shift, and enough words within the shift."""
    words, out = L.words_of(text or ""), []
    at = lambda start, k: start >= 0 and words[start : start + len(k)] == k
    for t in L.NOTICES:
        place, key, _ = anchors[t]
        for i in range(len(words)):
            s = i - place
            if at(i, key) and all(p == place or any(at(s + p + d, k) for d in range(-t.shift, t.shift + 1)) for p, k in t.key_places):
                there = sum(w in words[max(s + j - t.shift, 0) : max(s + j + t.shift + 1, 0)] for j, w in enumerate(t.words))
                if there >= L.MATCH * len(t.words):
                    out.append((max(s, 0), t.label))
    return sorted(out)


def altered(r, t, insert, replace):
    """The template with words inserted and replaced outside its key phrases."""
    words = t.words
    held = {i for p, k in t.key_places for i in range(p, p + len(k))}
    free = [i for i in range(len(words)) if i not in held]
    for i in r.sample(free, min(replace, len(free))):
        words[i] = r.choice(["foo", "any", "the"])
    gaps = [i for i in range(len(words)) if not (i in held and i - 1 in held)]
    for i in sorted(r.sample(gaps, min(insert, len(gaps))), reverse=True):
        words.insert(i, r.choice(["bar", "one", "of"]))
    return " ".join(words)


def test_notices_by_brute_force(spark):
    """Altered notices, whole and cut, in other words: the same places as by trying every one; none within the limits is lost."""
    r = random.Random(6)
    other = lambda n: " ".join(r.choice(["the", "of", "software", "license", "use", "copy", "public", "any", "zz"]) for _ in range(n))
    rows, want = [], []
    for i in range(260):
        t = L.NOTICES[i % len(L.NOTICES)]
        exact = r.random() < 0.6
        text = altered(r, t, r.randint(0, L.SHIFT if exact else 9), 0 if exact else r.randint(0, 8))
        if not exact and r.random() < 0.3:
            text = " ".join(text.split()[r.randint(0, 6) :])
        rows.append((i, f"{other(r.randint(0, 9))} {text} {other(5)}", 1))
        want.append(t.label if exact else None)
    rows += [(900, rows[0][1], 1), (901, None, 1), (902, " ".join(t.text for t in L.NOTICES), 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    counts = L.document_counts(frame, "text", sorted({w for t in (*L.PHRASES, *L.NOTICES) for w in t.words}))
    anchors = {t: L._anchor(t, counts) for t in L.NOTICES}
    out = {x.doc_id: x for x in L.scan(frame).collect()}
    for d, text, _ in rows:
        base = [(i, x) for i, x in brute(text)[1]]
        assert sorted((p.start, p.label) for p in out[d].places) == sorted(base + brute_notices(text, anchors)), text
    assert all(x is None or x in out[i].labels.split(",") for i, x in enumerate(want))


def test_one_more_word_loses_nothing(spark):
    texts = [
        "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and associated documentation files",
        "Redistribution and use in the source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ]
    out = L.scan(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    assert [r.labels for r in out] == ["mit", "bsd"] and all(r.score == 1 for r in out)


def check(r):
    n, base = brute(r.text)
    starts = [i for i, _ in base]
    assert (r.n_words, r.n_base) == (n, len(base))
    assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if base else (None, None))
    assert r.base_labels == ",".join(sorted({x for _, x in base}))
    assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_defined_cases(spark):
    texts = [
        None, "", "...", "Released under the MIT License.", "UNDER THE MIT LICENSE under the mit license",
        "CC BY-NC 4.0 cc by nc cc by cc by nc", "Licensed under the Apache License, Version 2.0.", "apache license version 20",
        "mit " * 50 + "under the under the mit license", "é under the mit licenseé", "under the mıt license", "under the MIT Lİcense",
        "This work is licensed under the GNU General Public License, version 3.", "gnu general public license version 3",
        "licensed under the GNU Lesser General Public License version 3",
        "Permission is hereby granted, free of charge, to any human obtaining a copy of this software and associated files", "x " * 200_000 + "cc by nc",
    ]
    rows = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(3, texts[3], 3)], SCHEMA)
    out = {r.doc_id: r for r in L.scan(rows).collect()}
    for r in out.values():
        check(r)
    assert out[12].labels == "gpl-3" and out[14].labels == "lgpl-3" and out[15].labels == "mit" and out[15].score < 1
    assert L.scan(rows).count() == len(texts) + 1 and L.scan(rows.limit(0)).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.scan(docs).collect()
    assert len(out) == 1000
    for r in out:
        check(r)
    assert {"mit", "apache-2", "cc-by-nc", "gpl-3"} <= {x for r in out for x in r.labels.split(",")}
