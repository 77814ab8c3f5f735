"""One look at a text: lines, fixed chunks and passages as the block plans find them, on odd texts too."""

import pytest
from compare import compare
from loomgrain.operators import evidence, fixed, lines, ranking
from loomgrain.plans import catalogue, retrieval, views
from loomgrain.session import written

WORDS = [f"w{i % 97}" for i in range(2000)]
LONG = [" ".join(WORDS[:n]) for n in (511, 512, 513, 959, 960, 961, 1409)]
TEXTS = [
    *LONG, "\n".join(LONG), None, "", " \n\t\n", "the of and\n$ = £\n...\n__empty__ a", "a-b-c it's x- -y_'z A_B\r\nTable | x | y\n  \n\x1c\n\x1f x",
    "中文 ab1中 The\n" + "中 ab x-y " * 300, "ab cd " * 400 + "中", "Kelvin one two three four five six İn", "x" * 3000 + "\n" + "a-b " * 600, "word, " * 511 + "\n= " * 3,
    "\n".join("one two three" for _ in range(400)), "He said one Two\nthree  four, five six seven eight. Then", "one\n\ntwo",
]
PASSAGES = [
    "said one two three four, five six", "kelvin one two three", "K one two three four five six", "w3 w4 w5 w6", "one two", "two", "", None, "... ... ...", "w3 w4 w5 w6 w7 w8 w9 w10",
    "xkelvin one Two three four", "nowhere to be found here at all", "中 ab x-y 中", "A_B Table |",
]


def _tables(spark, path, ids=None):
    rows = [(k, text, "en", "web0", len(text or "")) for k, text in zip(ids or range(-2, len(TEXTS)), TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(path / "documents.parquet")
    spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, text string").toPandas().to_parquet(path / "benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("odd"))


def _vectors(held):
    return {r.unit: (r.dl, round(r.length, 9), sorted(zip(r.terms, r.counts, strict=True))) for r in held.vectors.collect()}


@pytest.mark.parametrize("tokens", [1 << 19, 1])
def test_units_are_those_of_the_blocks(spark, odd, tokens, monkeypatch):
    monkeypatch.setattr(lines, "TOKENS", tokens)
    asked, units = written(retrieval._asked(spark, odd, "query_id"), "asked"), retrieval._units(views.line_blocks(spark, odd))
    found, _ = retrieval._corpora(spark, odd)
    for name in lines.STRATEGIES:
        plain = ranking.corpus(written(ranking.tokenised(units[name]), "tokens"), asked)
        assert _vectors(found[name]) == _vectors(plain) != {}
        assert found[name].avgdl == plain.avgdl


def test_windows_follow_the_settings(spark, odd):
    config = fixed.FixedConfig(target_tokens=7, overlap_tokens=3)
    chunks = fixed.chunks(views.line_blocks(spark, odd), config).selectExpr(f"cast(doc_id as long) * {lines.PLACE} + index AS unit", "text")
    plain = {r.unit: len(r.tokens) for r in ranking.tokenised(chunks).collect()}
    held = lines.of(lines.runs(spark.read.parquet(f"{odd}/documents.parquet"), [], config), "fixed")
    assert {u: n for r in held.collect() for u, n in zip(memoryview(r.units).cast("q"), memoryview(r.dl).cast("i"), strict=True)} == plain


def test_passages_are_found_where_they_stand(spark, odd):
    items, docs = spark.read.parquet(f"{odd}/benchmark.parquet"), spark.read.parquet(f"{odd}/documents.parquet")
    pairs = retrieval._corpora(spark, odd, looked=True)[1]
    rows = lambda found: sorted(tuple(r) for r in found.collect())
    assert rows(evidence.containing(items, docs, pairs)) == rows(evidence.containment(items, docs)) != []


@pytest.mark.parametrize("name", ["best_by_metric", "eval_per_query"])
def test_texts_are_tokenised_once(spark, sf, name, monkeypatch):
    """Neither units' texts nor their tokens are written or tokenised by themselves, and SQL says the same."""

    def never(*_):
        raise AssertionError("tokenised again")

    monkeypatch.setattr(ranking, "tokenised", never)
    assert compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], sf) > 0


def test_documents_that_share_a_key(spark, tmp_path):
    sf = _tables(spark, tmp_path, [i // 2 for i in range(len(TEXTS))])
    held, pairs = retrieval._corpora(spark, sf, looked=True)
    assert pairs is None and held["line"].vectors.count() == views.line_blocks(spark, sf).count()
