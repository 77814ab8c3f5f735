"""Rankings without pairs: equal to the join by term, and no table of pairs is written."""

import random

import pytest
from loomgrain.operators import bm25, evaluation, evidence, lexical, ranking
from loomgrain.plans import catalogue, checks, chunking, retrieval
from loomgrain.session import written


def _corpus(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(draw.choices(words, [1 / (i + 1) for i in range(40)], k=draw.randint(0, 30))) for _ in range(300)]
    texts += [texts[7], "", "the and", "w1 " * 500, "rare0 w39", "rare1 rare1 w2"]
    units = spark.createDataFrame([(1000 - i, t, [f"b{i}"]) for i, t in enumerate(texts)], "unit long, text string, blocks array<string>")
    asks = [("a", "w1 w2 w2 w30"), ("b", "rare0 w3 nowhere"), ("c", "nowhere"), ("d", ""), ("e", "rare1 w39 __empty__"), ("f", texts[7] + " w0")]
    asked = spark.createDataFrame(asks, "query_id string, text string").select("query_id", bm25.T.bm25_tokens("text").alias("tokens"))
    gold = spark.createDataFrame([("a", "b7"), ("a", "b300"), ("b", "b304"), ("b", "b9"), ("c", "b12"), ("d", "b1"), ("e", "b301"), ("f", "b250")], "query_id string, block_id string")
    return units, written(ranking.tokenised(units), "tokens"), written(asked, "asked"), written(gold, "gold")


@pytest.mark.parametrize("common", [1 << 18, 5, 0])
def test_equal_to_the_join_by_term(spark, common):
    units, tokens, asked, gold = _corpus(spark)
    postings = written(bm25.postings(tokens, "unit"), "postings")
    held, some = ranking.corpus(tokens, asked, common), asked.filter("size(tokens) > 0")
    relevant = written(evaluation.relevant_units(units, gold), "relevant")
    for retriever, score in {"bm25": bm25.posting_scores, "cosine": lexical.posting_cosine}.items():
        pairs = written(score(bm25.counted(asked, "query_id"), postings, "query_id", "unit"), "pairs")
        rows = lambda top: sorted((r.query_id, r["rank"], r.unit, round(r.score, 6)) for r in top.collect())
        top, first = ranking.ranked(held, retriever, 5, ranking.best(held, retriever, relevant))
        assert rows(top) == rows(bm25.top_k_of_all(pairs, some, units, "query_id", "unit", 5))
        found = lambda x: {r.query_id: [round(v, 9) if isinstance(v, float) else v for v in r] for r in x.collect()}
        assert found(evaluation.judged_ranking(first, top, relevant, gold)) == found(evaluation.full_ranking(pairs, some, units, gold))


def _largest(spark, sf, name, monkeypatch):
    rows = []

    def counting(df, label, *codec):
        out = written(df, label, *codec)
        rows.append((out.count(), label))
        return out

    for module in (ranking, evaluation, bm25, lexical, retrieval, checks):
        monkeypatch.setattr(module, "written", counting)
    catalogue.queries()[name](spark, sf).collect()
    return max(rows)


@pytest.mark.parametrize("name", ["eval_per_query", "acceptance_report", "bad_cases", "baseline_delta", "best_by_metric", "case_type", "eval_metrics", "metric_rows", "query_comparison", "query_hits", "query_summary"])
def test_no_table_of_pairs(spark, sf, name, monkeypatch):
    """No written table is longer than units and terms together, as postings and scored pairs are."""
    units, terms = chunking.content_blocks(spark, sf).count(), retrieval.bm25_postings(spark, sf).count()
    assert _largest(spark, sf, name, monkeypatch)[0] <= units + terms


def test_tokens_in_batches_are_those_of_the_expressions(spark):
    texts = ["The A-b c'd it's x-", "中文 ab1中 The", None, "", "İstanbul Kelvin ſtop a_b -a", "of the"]
    units = spark.createDataFrame(list(enumerate(texts)), "unit long, text string")
    found = lambda rows, key: {r[key]: r.tokens for r in rows.collect()}
    assert "MapInArrow" in ranking.tokenised(units)._jdf.queryExecution().toString()
    assert found(ranking.tokenised(units), "unit") == found(bm25.tokenised(units, "unit"), "unit")


def test_leading_words_are_looked_up_or_hashed(spark, sf):
    items, docs = spark.read.parquet(f"{sf}/benchmark.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    pairs = lambda most: sorted(tuple(r) for r in evidence.containment(items, docs, most=most).collect())
    assert pairs(1_000_000) == pairs(0) != []
