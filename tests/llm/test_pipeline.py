import hashlib

import corpus_pipeline as P
import public_tokenizers
from test_jaccard import brute
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgrain.llm import bpe, linededup
from loomgrain.session import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, sf), "stage")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if stage is not P.tokens:
            assert docs.columns == P.COLUMNS
        if stage is P.language:
            assert len(after) >= 0.97 * len(before) and all(after[d] == before[d] for d in after)
        if stage is P.lines:
            assert set(after) == set(before)
            for d, r in after.items():
                if r.text != before[d].text:
                    kept, old = r.text.split("\n"), iter(before[d].text.split("\n"))
                    assert all(x in old for x in kept) and r.n_chars == len(r.text)
        if stage is P.near_duplicates:
            rows = [(d, before[d].text) for d in before]
            assert set(after) == {d for d, _, c in brute(rows) if c == d}
            assert all(after[d] == before[d] for d in after)
        if stage is P.uncontaminated:
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not [d for d, r in after.items() if any(i in " ".join(r.text.lower().split()) for i in items)]
            assert len(after) >= 0.8 * len(before)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in list(after.values())[:40]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert linededup.RATIO < 1 and bpe.LONG > 0


def test_odd_rows(spark, sf):
    text = "The and of that with this is for the people there are words and more of them in it"
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, text, None, None, None), (None, text, "en", "a", 1), (3, None, "en", "a", 0)]
    rows += [(3, "other words under the id that has another text with it and the of", "en", "a", 0), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = P.near_duplicates(spark, docs, sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in kept) == [(False, 1, False), (False, 3, False), (False, 3, True), (False, 4, False)]
    for stage in (P.language, P.lines, P.uncontaminated, P.tokens):
        assert stage(spark, docs, sf).count() <= len(rows)
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert P.near_duplicates(spark, docs.limit(0), sf).count() == 0


def test_one_row_of_a_class_stays_whatever_the_ids(spark, sf):
    base = [f"w{i}" for i in range(80)]
    near, other = " ".join(base[:-1] + ["x"]), " ".join(f"o{i}" for i in range(30))
    text = " ".join(base)
    rows = [(5, text, "en", "a", 1), (5, text.upper(), "en", "b", 1), (7, near, "en", "a", 1), (8, other, "en", "a", 1), (5, other, "en", "a", 1), (9, text, "en", "a", 1)]
    rows += [(10, "", "en", "a", 0), (11, near, "en", "c", 1), (3, "alone " * 9, "en", "a", 1)] + [(None, near, "en", "a", 1), (None, text, "en", "a", 1)]
    kept = P.near_duplicates(spark, spark.createDataFrame(rows * 2, SCHEMA), sf).collect()
    named = sorted((r.doc_id, r.text.split(" ")[0].lower()) for r in kept if r.doc_id is not None)
    assert named == [(3, "alone"), (5, "o0"), (5, "w0"), (10, "")]
    assert not any(r.doc_id is None for r in kept)
    nameless = P.near_duplicates(spark, spark.createDataFrame(rows[-2:] * 3 + rows[3:4], SCHEMA), sf).collect()
    assert sorted((r.doc_id or 0) for r in nameless) == [0, 8]
    once = P.near_duplicates(spark, spark.createDataFrame(rows[2:4] + rows[5:6] + rows[7:8] * 2, SCHEMA), sf).collect()
    assert sorted(r.doc_id for r in once) == [7, 8]


def test_long_texts_and_clashing_columns(spark, sf):
    """Columns named like a stage's own are not carried, and a very long text stays whole."""
    prose = " ".join(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").limit(30).collect())
    long = " ".join(f"{w}{i}" if i % 9 == 0 else w for i, w in enumerate((prose + " ").split(" ") * 12))
    rows = [(1, long, "en", "a", len(long), "x", 5, "d"), (2, "the people and the words of this text are in it", "en", "a", 47, "y", 6, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang_pred string, n_dropped int, digest string")
    docs = docs.withColumns({"leaks": F.lit(1), "_digest": F.lit("z"), "n_tokens": F.lit(2), "label": F.lit(True), "_host": F.lit("h")})
    for _, stage in P.STAGES[1:-1]:
        out = {r.doc_id: r for r in stage(spark, docs, sf).collect()}
        assert list(out[2].asDict()) == P.COLUMNS and (stage is P.uncontaminated or out[1].text == long)
    assert P.tokens(spark, docs, sf).filter("doc_id = 1").first().n_tokens > 10_000
