"""Hand-worked cases of the chunkers."""

import pytest
from pyspark.sql import functions as F

from loomgrain.functions import folds
from loomgrain.functions import text as T
from loomgrain.operators import boundary, chunk_rows, fixed, folded
from loomgrain.plans import api

BLOCK = (
    "doc_id string, dataset string, split string, source_doc_id string, block_id string, type string, text string, `order` int,"
    " title_path array<string>, section_name string, asset_file string, entity_tags array<string>"
)


def blocks(spark, rows, doc="d"):
    """rows: (type, text, path)."""
    return spark.createDataFrame([(doc, "ds", "sp", doc, f"b{i}", k, t, i, p, None, None, []) for i, (k, t, p) in enumerate(rows, 1)], BLOCK)


PATH = ["River Survey", "Spring Readings"]
PAIR = [
    ("doc", "ds", "part", "src", "b001", "paragraph",
     "Gauge Alpha was read twice a day. Every reading of Gauge Alpha went to the survey office, and the office kept a copy.", 1, PATH, "River Survey / Spring Readings", None, ["Gauge Alpha"]),
    ("doc", "ds", "part", "src", "b002", "table", "| Gauge | Level |\n|---|---|\n| Alpha | 12 |", 2, PATH, "River Survey / Spring Readings", "readings.json", []),
]


def test_pair_by_hand(spark):
    """23 and 4 words of text; with the title [River Survey > Spring Readings], four more and a sign each."""
    df = spark.createDataFrame(PAIR, BLOCK)
    config = boundary.StructureConfig(min_tokens=20, target_tokens=120, max_tokens=260)
    (c,) = folded.structure_chunks(df, config).collect()
    assert c.chunk_id == "doc_structure_chunk_00001" and c.token_count == 37 and c.source_blocks == ["b001", "b002"]
    # Title parts, kinds, the entity, then words by frequency: gauge 3, alpha 3, office 2, and the first of those that stand once.
    assert c.tags == ["river survey", "spring readings", "paragraph", "table", "gauge alpha", "gauge", "alpha", "office"]
    assert c.entity_tags == ["Gauge Alpha", "Every", "Gauge", "Level", "Alpha"]
    assert c.quality_flags == ["length_ok", "source_anchor_complete", "protected_block_intact", "title_path_consistent", "final_flush", "structure_adaptive_boundary", "structure_aware"]
    assert c.source_anchor.asDict() == {"dataset": "ds", "split": "part", "source_doc_id": "src", "sections": ["River Survey / Spring Readings"], "first_block_id": "b001", "last_block_id": "b002", "block_count": 2, "assets": ["readings.json"]}
    s = boundary.profiled(boundary.statistics(chunk_rows.documents(df), config), config).first()
    assert (s.avg_block_tokens, s.median_block_tokens, s.p75_block_tokens, s.short_block_rate, s.protected_block_rate) == (18.5, 9.0, 28.0, 0.5, 0.5)
    distance = s.avg_adjacent_distance
    assert s.continuity == round(1 - distance, 4) and s.profile == "context_coverage"  # .5218 - .1871 is from .18 to .34
    assert s.context_need == pytest.approx(0.30 * 0.5 + 0.22 + 0.20 * 2 / 80 + 0.18 * s.continuity + 0.10 * 0.5, abs=1e-4)
    assert s.structure_need == pytest.approx(0.34 * distance + 0.06 * 0.5, abs=1e-4)


def test_protected_blocks_stay_whole(spark):
    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    rows = [("paragraph", words(3, "a"), ["T"])] + [(k, words(20, k), ["T"]) for k in ("table", "code", "formula")] + [("paragraph", words(3, "z"), ["T"])]
    config = boundary.StructureConfig(min_tokens=4, target_tokens=8, max_tokens=12, include_title_context=False)
    out = folded.structure_chunks(blocks(spark, rows), config).collect()
    for b in ("b2", "b3", "b4"):
        (c,) = [c for c in out if b in c.source_blocks]
        assert c.source_blocks == [b] and {"protected_block_intact", "kept_protected_block_intact"} <= set(c.quality_flags)
        assert (c.source_anchor.first_block_id, c.source_anchor.last_block_id, c.source_anchor.block_count) == (b, b, 1)


def test_profiles(spark):
    config = boundary.StructureConfig(min_tokens=20, target_tokens=60, max_tokens=120)
    profile = lambda rows, c=config: boundary.profiled(boundary.statistics(chunk_rows.documents(blocks(spark, rows)), c), c).first()
    same = profile([("paragraph", "alpha beta gamma delta epsilon zeta", ["T"])] * 30)
    assert (same.profile, same.boundary_strength) == ("high_context_coverage", "loose") and same.target > 60 and same.hard_threshold > 0.62
    moving = profile([("paragraph", f"word{i} other{i}", [f"S{i}"]) for i in range(12)])
    assert (moving.profile, moving.boundary_strength, moving.target) == ("structure_preserving", "strong", 60) and moving.top_title_transition_rate > 0.8
    off = boundary.StructureConfig(min_tokens=20, target_tokens=60, max_tokens=120, adaptive_boundary=False)
    out = folded.structure_chunks(blocks(spark, [("paragraph", f"word{i}", ["T"]) for i in range(7)]), off).collect()
    assert out and not [f for c in out for f in c.quality_flags if "adaptive" in f]


def test_short_chunks_merge_to_the_right(spark):
    text = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [("paragraph", text(0, 5), ["A"]), ("paragraph", text(1, 28), ["A"]), ("paragraph", text(2, 5), ["B"])]
    config = boundary.StructureConfig(min_tokens=10, target_tokens=20, max_tokens=30, include_title_context=False, adaptive_boundary=False)
    out = sorted(folded.structure_chunks(blocks(spark, rows), config).collect(), key=lambda c: c["index"])
    assert [c.source_blocks for c in out] == [["b1"], ["b2"], ["b3"]]  # 5 + 28 > 30, and B is another title
    config = boundary.StructureConfig(min_tokens=10, target_tokens=20, max_tokens=40, include_title_context=False, adaptive_boundary=False, semantic_distance_threshold=0.1)
    out = sorted(folded.structure_chunks(blocks(spark, rows), config).collect(), key=lambda c: c["index"])
    assert [c["index"] for c in out] == list(range(1, len(out) + 1))


def test_fixed_packs_and_cuts(spark):
    w = lambda n, p="x": " ".join(f"{p}{i}" for i in range(n))
    out = sorted(fixed.chunks(blocks(spark, [("paragraph", w(300), []), ("paragraph", w(300), []), ("paragraph", w(100), [])])).collect(), key=lambda c: c["index"])
    assert [c.source_blocks for c in out] == [["b1"], ["b2", "b3"]]
    config = fixed.FixedConfig(target_tokens=4, overlap_tokens=1, min_tokens=1, max_tokens=4)
    out = sorted(fixed.chunks(blocks(spark, [("paragraph", "a b", []), ("paragraph", w(10, "w"), []), ("paragraph", "c", [])]), config).collect(), key=lambda c: c["index"])
    assert [c.text for c in out] == ["a b", "w0 w1 w2 w3", "w3 w4 w5 w6", "w6 w7 w8 w9", "c"]
    assert "split_long_block" in out[1].quality_flags and "split_long_block" not in out[0].quality_flags


def test_recursive_pieces_by_hand():
    assert folded.recursive_pieces("a b. c d. e f", 4) == [("a b. c d.", 2), ("e f", 2)]
    assert folded.recursive_pieces("a b c d e", 2) == [("a b", 5), ("c d", 5), ("e", 5)]
    # A part that is too long goes on to commas; the group before it, which fits, is named by that level too.
    assert folded.recursive_pieces("x. a b, c d e. f", 3) == [("x.", 3), ("a b,", 4), ("c d e.", 4), ("f", 2)]
    assert folded.recursive_pieces("", 3) == [] and folded.recursive_pieces("a b", 3) == [("a b", 0)]
    assert list(folds.packings([2, 9, 1, 2, 1, 1], 4)) == [(0, 1), (1, 2), (2, 5), (5, 6)] and list(folds.packings([], 4)) == []


def test_every_block_is_in_a_chunk(spark, sf):
    from loomgrain.plans import views

    rows = views.line_blocks(spark, sf)
    want = {r.block_id for r in chunk_rows.content_blocks(rows).select("block_id").collect()}
    for strategy in api.STRATEGIES:
        chunks = api.chunk(rows, strategy).select("doc_id", "index", "source_blocks", "text", "token_count").collect()
        assert {b for c in chunks for b in c.source_blocks} == want
        by_doc = {}
        for c in chunks:
            by_doc.setdefault(c.doc_id, []).append(c["index"])
            assert c.token_count == folds.size(folds.normalize(c.text)), c.text
        assert all(sorted(x) == list(range(1, len(x) + 1)) for x in by_doc.values())


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_text_functions_by_hand(spark):
    size = lambda t: one(spark, T.estimate_tokens(F.lit(t)))
    assert (size("don't pay $5 中文"), size("   "), size("!!"), size(None)) == (6, 0, 1, 0)
    assert one(spark, T.word_windows(F.lit("w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), 4, 1)) == ["w1 w2 w3 w4", "w4 w5 w6 w7", "w7 w8 w9 w10"]
    assert one(spark, T.nearest_rank(F.array(F.lit(36), F.lit(20)), 0.5)) == 20 and one(spark, T.nearest_rank(F.array(F.lit(36), F.lit(20)), 0.75)) == 36
    path = lambda *ps: one(spark, T.common_path(F.array(*[F.array(*map(F.lit, p)) for p in ps])))
    assert path("ABC", "AB") == ["A", "B"] and path("A", "B", "A") == ["A", "B"]
    assert one(spark, T.token_f1(F.lit("a b c"), F.lit("b c d"))) == pytest.approx(2 / 3)
    grams = one(spark, T.cjk_tokens(F.lit("一丁丂七丄丅"), 3))
    assert {len(g) for g in grams} == {2, 3}
    assert {len(g) for g in one(spark, T.cjk_tokens(F.lit("一丁丂七丄丅"), 4))} == {2, 3, 4}
    with pytest.raises(ValueError):
        T.tokens("x", "nope")
    for bad in ({"nope": 1},):
        with pytest.raises(ValueError):
            api.config_of("fixed", bad)


def test_sentences_keep_the_digits_of_their_place(spark):
    """A sentence at place 2 that begins or ends with a 2 is whole."""
    assert one(spark, T.sentences(F.lit("A. B. 28.68.1.2"))) == ["A.", "B.", "28.68.1.2"]


def test_summary_keeps_a_leading_zero(spark):
    assert one(spark, T.summary(F.lit("0.5 is half of 10. More."))) == "0.5 is half of 10."
