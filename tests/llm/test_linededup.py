import random

from loomgrain.llm.linededup import dedup_lines

SCHEMA = "doc_id long, text string, source string, n_lines string"


def run(spark, rows, **kw):
    return {(r.doc_id, r.source): r for r in dedup_lines(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def out_of(r):
    return r.text, r.n_lines, r.n_dropped


def brute(rows, ratio, min_pages):
    hosts = {}
    for _, text, host in rows:
        hosts.setdefault(host, []).append({x for x in (text or "").split("\n") if x.strip(" ")})
    out = []
    for i, text, host in rows:
        held = lambda x: sum(x in s for s in hosts[host])
        lines = text.split("\n") if text is not None else []
        full = [x for x in lines if x.strip(" ")]
        bad = {x for x in full if held(x) >= min_pages and held(x) > len(hosts[host]) * ratio}
        kept = [x for x in lines if x not in bad]
        out.append((i, host, "\n".join(kept) if text is not None else None, len(full), sum(x in bad for x in lines)))
    return sorted(out, key=repr)


def test_same_as_brute_force(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i % 70, "\n".join(r.choice(["a", "b", "cc", "", " ", "d d", f"u{i}"]) for _ in range(r.randint(0, 7))), r.choice(["x", "x", "x", "y", None])) for i in range(150)]
    rows += rows[:9] + [(1, None, "x"), (None, "a\nb", "z"), (5, "long " * 40_000 + "\na", "x")]  # repeated rows, a host of one page, a long line
    frame = spark.createDataFrame([(*x, "") for x in rows], SCHEMA)
    for ratio, least in ((0.3, 1), (0.05, 5), (0.0, 2)):
        for slots in (256, 2):
            monkeypatch.setattr("loomgrain.llm.linededup.SLOTS", slots)
            out = [(r.doc_id, r.source, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(frame, ratio=ratio, min_pages=least).collect()]
            assert sorted(out, key=repr) == brute(rows, ratio, least)


def test_planted_line_is_cut_on_every_host(spark):
    rows = [(h * 1000 + i, f"own {h} {i}\nall rights reserved" if i % 12 == 0 else f"own {h} {i}", f"h{h}", "") for h in range(4) for i in range(60 + 90 * h)]
    assert all("rights" not in r.text for r in run(spark, rows, min_pages=5).values())


def test_boilerplate_is_cut_by_host(spark):
    rows = [(i, f"menu\nbody {i}\nmenu\n\nend", "a", "z") for i in range(20)]
    rows += [(100 + i, f"menu\nbody {i}", "b", "z") for i in range(3)]
    out = run(spark, rows, ratio=0.5, min_pages=5)
    r = out[(3, "a")]
    assert r.text == "body 3\n" and (r.n_lines, r.n_dropped) == (4, 3)
    assert out[(100, "b")].text == "menu\nbody 0" and out[(100, "b")].n_dropped == 0


def test_defined_cases(spark):
    rows = [(i, "same page\nof two lines", None, "") for i in range(10)]
    rows += [(50, None, None, ""), (51, "", None, ""), (52, "x" * 300_000 + "\nsame page", None, "")]
    gone = run(spark, rows)
    assert out_of(gone[(0, None)]) == ("", 2, 2) and out_of(gone[(52, None)]) == ("", 2, 2)
    out = run(spark, rows, min_pages=5, keep_whole=True)
    assert out[(0, None)].text == "same page\nof two lines" and out[(0, None)].n_dropped == 0
    assert out[(50, None)].text is None and out[(50, None)].n_lines == 0
    assert out[(51, None)].text == "" and out[(51, None)].n_dropped == 0
    assert out[(52, None)].text == "x" * 300_000
    assert run(spark, []) == {}


def test_salted_join_gives_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = sorted(map(tuple, dedup_lines(docs, ratio=0.02, min_pages=2).collect()))
    monkeypatch.setattr("loomgrain.llm.linededup.BROADCAST_LINES", -1)
    assert sorted(map(tuple, dedup_lines(docs, ratio=0.02, min_pages=2).collect())) == first
    assert any(r[-1] for r in first)
