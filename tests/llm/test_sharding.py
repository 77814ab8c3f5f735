import zlib
from collections import Counter

from pyspark.sql import functions as F

from loomgrain.llm.sharding import shard

SCHEMA = "doc_id long, text string, size int, other string"


def run(spark, rows, **kw):
    return [r.asDict() for r in shard(spark.createDataFrame(rows, SCHEMA), **kw).collect()]


def test_laws_on_mixed_rows(spark):
    rows = [(i, "x" * (i % 97), 5, "o") for i in range(2000)] + [(7, "hot copy of one text", 1, None)] * 1000
    rows += [(None, None, None, None), (3, None, None, None), (4, "", 0, ""), (5, "y" * 9000, 0, "")]
    out = run(spark, rows)
    assert len(out) == len(rows)
    assert Counter((r["doc_id"], r["text"], r["other"]) for r in out) == Counter((a, b, d) for a, b, _, d in rows)
    for r in out:
        raw = r["text"].encode() if r["text"] is not None else None
        assert r["size"] == (len(raw) if raw else 0) + 1
        assert r["text_crc32"] == (zlib.crc32(raw) if raw is not None else None)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    sizes, slots = Counter(), {}
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 16
    assert all(abs(sizes[i] - mean) <= 9001 + mean * 0.001 for i in range(16))


def test_many_ranges_and_an_unstable_input(spark, monkeypatch):
    """Ranges by array search; identical rows whose order changes from one reading to the next; a very long text."""
    monkeypatch.setattr("loomgrain.llm.sharding.FINE_BYTES", 400)
    rows = [(i % 900, "t" * (i % 13), 0, "") for i in range(3000)] + [(7, "hot", 1, None)] * 1500 + [(8, "w " * 300_000, 0, "")]
    frame = spark.createDataFrame(rows, SCHEMA).orderBy(F.rand())
    for tree in (256, 4):
        monkeypatch.setattr("loomgrain.llm.sharding.TREE", tree)
        out = shard(frame, carry=["doc_id"])
        assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        slots = {}
        for r in out.collect():
            slots.setdefault(r.shard, []).append(r.slot)
        assert sum(map(len, slots.values())) == len(rows)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_small_and_empty(spark):
    assert run(spark, []) == []
    out = run(spark, [(1, "a", 0, ""), (1, "a", 0, "")])
    assert len(out) == 2 and len({(r["shard"], r["slot"]) for r in out}) == 2


def test_balance_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = shard(docs, 4).collect()
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 4
    biggest = max(r.size for r in out)
    assert all(abs(s - mean) <= biggest + 1 for s in sizes.values())
