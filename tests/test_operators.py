"""Hand-worked cases of evaluation, fusion, evidence, adapters, sources and the service functions."""

import functools
import io
import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrain.operators import bm25, dense, enrichment, evaluation, evidence, fusion, quality
from loomgrain.plans import api
from loomgrain.sources import adapters
from loomgrain.sources import io as S
from loomgrain.streaming.chunks import stream_chunks


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame([("s", "r", "q", 1, ["x"]), ("s", "r", "q", 2, ["g1"]), ("s", "r", "q", 3, ["g2", "g1"])], "strategy string, retriever string, query_id string, rank int, blocks array<string>")
    gold = spark.createDataFrame([("q", "g1"), ("q", "g2")], "query_id string, block_id string")
    r = evaluation.per_query(hits, gold).first()
    assert (r.first_relevant_rank, r.reciprocal_rank, r.recall_1, r.recall_3, r.hit_3, r.full_3) == (2, 0.5, 0.0, 1.0, 1, 1)
    assert r.ndcg == pytest.approx(0.693426, abs=1e-6)
    with pytest.raises(ValueError):
        evaluation.check_ks([0, 1])


def test_cases_by_hand(spark):
    rows = spark.createDataFrame(
        [("t", "r", "a", 2, 1.0), ("fixed", "r", "a", 1, 1.0), ("t", "r", "b", 1, 0.5), ("fixed", "r", "c", 1, 1.0), ("t", "r", "d", 1, 1.0), ("fixed", "r", "d", 1, 0.5), ("t", "r", "e", 1, 1.0)],
        "strategy string, retriever string, query_id string, first_relevant_rank long, recall_5 double",
    )
    got = {r.query_id: r.case_type for r in evaluation.case_types(rows, "t", "fixed").collect()}
    assert got == {"a": "baseline_beats_target", "b": "target_missing", "c": "target_absent", "d": "strategy_disagreement", "e": "target_ok"}


def test_min_max_and_fusion(spark):
    s = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (1, "c", 6.0), (2, "a", 3.0), (2, "b", 3.0)], "q int, d string, score double")
    got = {(r.q, r.d): r.x for r in fusion.min_max(s, "q", "score", "x").collect()}
    assert got == {(1, "a"): 0.0, (1, "b"): 0.5, (1, "c"): 1.0, (2, "a"): 0.0, (2, "b"): 0.0}
    total = spark.createDataFrame([(3,)], "n long")
    fuse = lambda x, y: {(r.q, r.d): r.score for r in fusion.fuse(x, y, "q", "d", total).collect() if r.q == 1}
    assert fuse(s, s) == {(1, "a"): 0.0, (1, "b"): 0.5, (1, "c"): 1.0}  # all three have a score on each side
    # One has no score on a side: it has 0 there, which is the least.
    assert fuse(s.filter("d <> 'a'"), s.filter("d <> 'c'")) == {(1, "a"): 0.225, (1, "b"): 0.816667, (1, "c"): 0.55}
    with pytest.raises(ValueError):
        fusion.fuse(s, s, "q", "d", total, 1.5)


def test_full_ranking_by_hand(spark):
    """A relevant unit at place 12, one without a score, one behind it by place, a query without tokens, and ties."""
    units = spark.createDataFrame([(i, [f"b{i}"]) for i in range(1, 21)] + [(30, ["b12", "b30"])], "unit long, blocks array<string>")
    scored = spark.createDataFrame(
        [("far", i, 20.0 - i) for i in range(1, 13)] + [("tie", i, 1.0) for i in (4, 2, 9)] + [("none", 3, 2.0), ("none", 1, 1.0), ("few", 5, 1.0)], "query_id string, unit long, score double"
    )
    gold = spark.createDataFrame([("far", "b12"), ("tie", "b9"), ("none", "b6"), ("few", "b5"), ("few", "b2"), ("mute", "b1")], "query_id string, block_id string")
    asked = spark.createDataFrame([("far",), ("tie",), ("none",), ("few",)], "query_id string")
    got = {r.query_id: r for r in evaluation.full_ranking(scored, asked, units, gold).collect()}
    assert {q: r.first_relevant_rank for q, r in got.items()} == {"far": 12, "tie": 3, "none": 6, "few": 1, "mute": 0}
    assert got["far"].reciprocal_rank == pytest.approx(1 / 12) and got["far"].ndcg == 0 and got["mute"].recall_5 == 0
    assert got["few"].recall_5 == 1 and got["few"].hit_1 == 1 and got["few"].full_3 == 1  # unit 2 comes third: 5, then 1 and 2 without a score
    assert got["few"].ndcg == pytest.approx((1 + 0.5) / (1 + 1 / 1.5849625007), abs=1e-6)
    s = evaluation.summary(spark.createDataFrame(got.values()).withColumns({"strategy": F.lit("s"), "retriever": F.lit("r")})).first()
    assert s.queries == 5 and s.mrr == pytest.approx((1 / 12 + 1 / 3 + 1 / 6 + 1) / 5, abs=1e-6)


def test_all_candidates_are_ranked(spark):
    scored = spark.createDataFrame([("q", 7, 1.0), ("q", 3, -0.5), ("p", 1, 2.0), ("p", 2, 1.0), ("p", 3, 1.0)], "q string, d int, score double")
    out = bm25.top_k_of_all(scored, spark.createDataFrame([("q",), ("p",), ("r",)], "q string"), spark.range(1, 9).select(F.col("id").cast("int").alias("d")), "q", "d", 3)
    got = sorted((r.q, r["rank"], r.d, r.score) for r in out.collect())
    assert got == [("p", 1, 1, 2.0), ("p", 2, 2, 1.0), ("p", 3, 3, 1.0), ("q", 1, 7, 1.0), ("q", 2, 1, 0.0), ("q", 3, 2, 0.0), ("r", 1, 1, 0.0), ("r", 2, 2, 0.0), ("r", 3, 3, 0.0)]


def test_dense_encoder_against_numpy(spark):
    r = random.Random(3)
    topics = [[f"{t}{i}" for i in range(12)] for t in "abc"]
    docs = [(i, [r.choice(topics[i % 3]) for _ in range(20)] + (["all"] if i % 2 else [])) for i in range(60)] + [(99, [])]
    asked = [("x", ["a1", "a2", "unseen"]), ("y", ["b3"]), ("z", ["unseen"])]
    corpus, queries = spark.createDataFrame(docs, "d int, tokens array<string>"), spark.createDataFrame(asked, "q string, tokens array<string>")
    terms = sorted({t for _, ts in docs for t in ts})
    df = [sum(t in ts for _, ts in docs) for t in terms]
    idf = np.log((1 + len(docs)) / (1 + np.array(df))) + 1
    raw = lambda ts: np.array([ts.count(t) for t in terms]) * idf
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    x = unit(np.stack([raw(ts) for _, ts in docs]))
    v = np.linalg.svd(x)[2][:3].T
    want = unit(unit(np.stack([raw(ts) for _, ts in asked])) @ v) @ unit(x @ v).T
    got = {(s.q, s.d): s.score for s in dense.search(corpus.repartition(40), queries, "d", "q", functools.partial(dense.tfidf_svd, dims=3)).collect()}
    for i, (q, _) in enumerate(asked):
        for j, (d, _) in enumerate(docs):
            assert got[q, d] == pytest.approx(want[i, j], abs=2e-3)
    small = dense.search(corpus.filter("d < 2"), queries, "d", "q").collect()
    assert len(small) == 6


def test_profiles_and_presets(spark):
    rows = spark.createDataFrame([("中文文本测试 and BM25",)], "text string")
    assert api.preset("zh_cjk", alpha=0.3) == {"profile": "cjk_2_4gram", "alpha": 0.3} and api.preset("default") == {}
    with pytest.raises(ValueError):
        api.preset("nope")
    found = bm25.T.with_tokens(rows, "jieba").first().tokens
    assert {"中文", "文本", "测试", "bm25"} <= set(found) and "and" not in found  # by the segmenter, or by bigrams without it
    chunks = spark.createDataFrame([("c1", "d", "中文检索评测", ["b1"]), ("c2", "d", "完全无关", ["b2"])], "chunk_id string, doc_id string, text string, source_blocks array<string>")
    asked = spark.createDataFrame([("q", "d", "检索评测", ["b1"], False)], "query_id string, doc_id string, question string, gold array<string>, is_unanswerable boolean")
    out = api.retrieve(asked, chunks, "bm25", idf="plus_one", **api.preset("zh_cjk")).orderBy("rank").collect()
    assert [(r.chunk_id, r.score > 0) for r in out] == [("c1", True), ("c2", False)]
    m = api.metrics(asked, chunks, "fixed", idf="plus_one", **api.preset("zh_cjk")).first()
    assert (m.mrr, m.chunks, m.search_scope, m.index_fields, m.unanswerable, m.no_gold) == (1.0, 2, "same_doc", "text", 0, 0)


def test_evidence_by_hand(spark):
    e = spark.createDataFrame([("q", "d", 0, "A b  c")], "query_id string, doc_id string, place int, text string")
    block = "doc_id string, block_id string, `order` int, type string, text string"
    b = spark.createDataFrame([("d", "1", 1, "paragraph", "x a b c y"), ("d", "2", 2, "paragraph", "q r"), ("d", "0", 0, "heading", "a b c")], block)
    r = evidence.match(e, b).first()
    assert (r.block_id, r.score, r.method, r.block_type) == ("1", 1.0, "substring", "paragraph")
    # A block within the evidence leads, then overlap raises the score: the method stays the earlier one's. Others stay unmatched or empty.
    e = spark.createDataFrame([("q", "d", 0, "a b c d e f g"), ("q", "d", 1, "nothing like it"), ("q", "d", 2, " "), ("q", "x", 3, "a")], "query_id string, doc_id string, place int, text string")
    b = spark.createDataFrame([("d", "1", 1, "table", "a b"), ("d", "2", 2, "table", "g f e d c b a")], block)
    got = {r.place: (r.block_id, r.score, r.method) for r in evidence.match(e, b).collect()}
    assert got == {0: ("2", 1.0, "block_in_evidence"), 1: (None, 0.0, "unmatched"), 2: (None, 0.0, "empty"), 3: (None, 0.0, "unmatched")}
    docs = spark.createDataFrame([(1, "so say we ALL of us"), (2, "all of it is here to be seen by us now ok")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "we all"), (2, "of it is  here to be seen by u")], "item_id int, text string")
    assert {tuple(r) for r in evidence.containment(items, docs).collect()} == {(1, 1), (2, 2)}
    r = random.Random(5)
    texts = [" ".join(r.choice(["ab", "abc", "bc", "c", "cab"]) for _ in range(r.randint(1, 30))) for _ in range(60)]
    needles = [x[a : a + r.randint(1, 40)] for x in texts for a in [r.randrange(len(x))]] + ["", "zz zz zz zz zz zz zz zz"]
    got = evidence.containment(spark.createDataFrame(list(enumerate(needles)), "item_id int, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, d) for i, n in enumerate(needles) for d, t in enumerate(texts) if n.strip() and n.strip() in t)
    assert evidence.containment(items.limit(0), docs).collect() == []


def test_markdown_by_hand(spark):
    text = "# T\npara\n\n- a\n- b\n|x|y|\n## U\n```\ncode\n\nmore\n```\ntail one\ntail two\n# V\n### W\nend\n```\nopen"
    rows = adapters.markdown_blocks(spark.createDataFrame([("m", text)], "doc_id string, text string")).orderBy("order").collect()
    assert [(r.type, r.text, r.title_path) for r in rows] == [
        ("heading", "T", ["T"]), ("paragraph", "para", ["T"]), ("list", "- a - b", ["T"]), ("table", "|x|y|", ["T"]), ("heading", "U", ["T", "U"]),
        ("code", "code more", ["T", "U"]), ("paragraph", "tail one tail two", ["T", "U"]), ("heading", "V", ["V"]), ("heading", "W", ["V", "W"]), ("paragraph", "end", ["V", "W"]), ("code", "open", ["V", "W"]),
    ]


def test_paper_adapter(spark):
    answer = "struct<unanswerable:boolean,free_form_answer:string,extractive_spans:array<string>,yes_no:boolean,evidence:array<string>,highlighted_evidence:array<string>>"
    schema = (
        "id string, title string, abstract string, sections array<struct<name:string,paragraphs:array<string>>>, figures array<struct<caption:string,file:string>>,"
        f" qas array<struct<question:string,question_id:string,answers:array<{answer}>,nlp_background:string,topic_background:string,paper_read:string>>"
    )
    qas = [("Q?", "q1", [(False, "Free", [], None, ["e1"], ["e1", "e2"]), (False, "", ["s1", "s2"], None, [], [])], "two", "x", "no"), ("N?", "q2", [(True, "", [], None, [], [])], "", "", "")]
    paper = spark.createDataFrame([("p/1", "Title", "Abs.", [("A ::: B", ["one", ""]), ("A ::: C", ["two"])], [("Table 1: t", "f.png")], qas)], schema)
    rows = adapters.paper_blocks(paper).orderBy("order").collect()
    assert [(r.type, r.text) for r in rows] == [
        ("title", "Title"), ("heading", "Abstract"), ("abstract", "Abs."), ("heading", "A"), ("heading", "B"), ("paragraph", "one"), ("heading", "C"), ("paragraph", "two"), ("table", "Table 1: t"),
    ]
    by_id = {r.block_id: r for r in rows}
    above = [by_id[r.parent_heading_id].text if r.parent_heading_id else None for r in rows]
    assert above == [None, None, "Abstract", None, "A", "B", "A", "C", None]
    assert [r.section_name for r in rows] == ["Title", "Abstract", "Abstract", "A", "A ::: B", "A ::: B", "A ::: C", "A ::: C", "Figures and Tables"]
    assert rows[0].block_id == "p_1_title_00001" and rows[-1].asset_file == "f.png" and rows[5].title_path == ["A", "B"]
    q = {r.query_id: r for r in adapters.paper_queries(paper).collect()}
    assert (q["q1"].answer, q["q1"].gold_evidence_texts, q["q1"].answer_type) == ("Free | s1 | s2", ["e1", "e2"], "extractive")
    assert q["q2"].is_unanswerable and q["q2"].answer == "UNANSWERABLE" and q["q1"].difficulty == "nlp=two;topic=x;paper_read=no"


def test_fact_and_candidate_adapters(spark):
    facts = spark.createDataFrame(
        [("r1", "q", "ans", [("X", ["s0", "s1"]), ("Y", ["t0"])], [("X", 1), ("Z", 0)])],
        "id string, question string, answer string, context array<struct<title:string,sentences:array<string>>>, facts array<struct<title:string,sentence:int>>",
    )
    assert [r.block_id for r in adapters.fact_blocks(facts).orderBy("order").collect()] == ["r1_c01_s001", "r1_c01_s002", "r1_c02_s001"]
    g = adapters.fact_gold(facts).first()
    assert (g.gold_block_ids, g.n_missing, g.is_unanswerable) == (["r1_c01_s002"], 1, False)
    doc = "struct<title:string,paragraphs:array<string>,segmented_title:array<string>,is_selected:boolean,most_related_para:int>"
    cand = spark.createDataFrame([("c1", "q", ["a", "b"], [1], [("T", ["p0", "p1"], ["t", "_"], False, 0), ("U", ["r0", "r1"], [], False, 1)])], f"question_id string, question string, answers array<string>, answer_docs array<int>, documents array<{doc}>")
    rows = adapters.candidate_blocks(cand).orderBy("order").collect()
    assert [r.block_id for r in rows] == ["c1_d01_p001", "c1_d01_p002", "c1_d02_p001", "c1_d02_p002"] and rows[0].title_path == ["候选文档1: T"] and rows[0].entity_tags == ["t"]
    g = adapters.candidate_gold(cand).first()
    assert (g.gold_block_ids, g.answer) == (["c1_d02_p002"], "a；b")


def test_sources_round_trip(spark, tmp_path):
    doc = {"doc_id": "d", "dataset": "x", "blocks": [{"block_id": "b1", "type": "paragraph", "text": "héllo", "order": 1, "title_path": ["T"]}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(doc) + "\n\n")
    (tmp_path / "b.json").write_text(json.dumps({"documents": [doc, doc]}))
    (tmp_path / "c.json").write_text(json.dumps([doc]))
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    assert [S.read_documents(spark, f"{tmp_path}/{n}").count() for n in ("a.jsonl", "b.json", "c.json", "d.json")] == [1, 2, 1, 1]
    assert adapters.flat_blocks(S.read_documents(spark, f"{tmp_path}/d.json")).first().text == "héllo"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("m.json", "1\n2\n3\n")
    assert [r.value for r in S.read_zip_lines(spark, f"{tmp_path}/z.zip", limit=2).collect()] == ["1", "2"]
    assert S.read_report(spark, f"{tmp_path}/none.json") == {} and S.read_report(spark, f"{tmp_path}/d.json")["doc_id"] == "d"
    assert S.infer_format("x.md") == "markdown"
    with pytest.raises(ValueError):
        S.infer_format("x.pdf")
    assert S.literal_cell("[{'a': array(['x', nan], dtype=object)}]") == ([{"a": ["x", None]}], None)
    assert S.literal_cell("__import__('os')")[1] and S.literal_cell("nan") == (None, None)


def test_zip_readers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("train.csv", 'id,title\n1,"a, ""b"""\n2,"two\nlines"\n')
        z.writestr("dev.csv", "id,title\n")
    assert S.zip_splits(spark, f"{tmp_path}/p.zip") == ["dev", "train"]
    rows = S.read_zip_csv(spark, f"{tmp_path}/p.zip", "train", ["id", "title", "none"]).orderBy("place").collect()
    assert [(r.id, r.title, r.none) for r in rows] == [("1", 'a, "b"', None), ("2", "two\nlines", None)]
    assert S.read_zip_csv(spark, f"{tmp_path}/p.zip", "train", ["id"], 1).count() == 1 and S.read_zip_csv(spark, f"{tmp_path}/p.zip", "dev", ["id"]).count() == 0
    with pytest.raises(ValueError, match="dev, train"):
        S.read_zip_csv(spark, f"{tmp_path}/p.zip", "test", ["id"])
    records = [{"k": i, "t": "é" * 3000} for i in range(60)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.json", json.dumps(records, ensure_ascii=False))
    found = S.read_zip_array(spark, f"{tmp_path}/a.zip").orderBy("place").collect()
    assert [json.loads(r.value) for r in found] == records
    assert S.read_zip_array(spark, f"{tmp_path}/a.zip", limit=7).count() == 7
    for text, want in (("[1, 23 , -4.5]", ["1", "23", "-4.5"]), (' [ {"a": [1]}\n, "x"]', ['{"a": [1]}', '"x"']), ("[]", [])):
        with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
            z.writestr("m.json", text)
        assert [r.value for r in S.read_zip_array(spark, f"{tmp_path}/b.zip").orderBy("place").collect()] == want
    odd = [{"a": ["]", '"', "\\", "{,"], "b": {}}, "x,]", [], None, 1.5, [[1], 2], "é\\\\"]
    for portion in (1, 2, 3, 7, 1000):
        assert [json.loads(v) for v in S.array_elements(io.StringIO(json.dumps(odd)), portion)] == odd
    for bad in ("", "[1, 2", '{"a": 1'):
        with pytest.raises(ValueError):
            list(S.array_elements(io.StringIO(bad)))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr(S.candidate_member("search", "dev"), "{}\n{}\n")
    assert S.read_candidates(spark, f"{tmp_path}/c.zip").count() == 2
    for bad in (("web", "dev"), ("search", "all")):
        with pytest.raises(ValueError):
            S.candidate_member(*bad)


def test_sinks(spark, tmp_path):
    blocks = adapters.markdown_blocks(spark.createDataFrame([("m", "# Alpha\nred fox | runs\n# Beta\nblue whale")], "doc_id string, text string"))
    chunks = api.chunk(blocks, "fixed")
    S.write_chunk_set(chunks, f"{tmp_path}/set")
    assert S.read_report(spark, f"{tmp_path}/set/chunk_report_fixed.json")["quality_flag_counts"]["fixed_window_baseline"] == 1
    assert len(S.read_report(spark, f"{tmp_path}/set/chunking_summary.json")["reports"]) == 1 and spark.read.parquet(f"{tmp_path}/set/chunks").count() == 1
    S.write_manual_csv(chunks, f"{tmp_path}/manual")
    rows = S.read_csv(spark, f"{tmp_path}/manual")
    assert rows.columns == S.MANUAL_COLUMNS and rows.first().tags.startswith("alpha | beta") and rows.first().evaluator is None
    queries = spark.createDataFrame([("q", "m", ["b1"], {"k": "v"})], "query_id string, doc_id string, gold_block_ids array<string>, metadata map<string,string>")
    S.write_queries_csv(queries, f"{tmp_path}/queries")
    back = S.read_csv(spark, f"{tmp_path}/queries")
    assert back.columns == S.QUERY_COLUMNS and json.loads(back.first().gold_block_ids) == ["b1"] and json.loads(back.first().metadata) == {"k": "v"}
    per = spark.createDataFrame([(s, "bm25", "q", 1, 1.0, 1.0, *[x] * 3, *[1] * 6) for s, x in (("fixed", 0.5), ("structure", 1.0))],
                                "strategy string, retriever string, query_id string, first_relevant_rank long, reciprocal_rank double, ndcg double, recall_1 double, recall_3 double, recall_5 double,"
                                " hit_1 int, hit_3 int, hit_5 int, full_1 int, full_3 int, full_5 int")
    S.write_evaluation(per, f"{tmp_path}/eval")
    whole = S.read_report(spark, f"{tmp_path}/eval/retrieval_eval_bm25_summary.json")
    assert whole["best_by_metric"]["recall_5"][0] == {"strategy": "structure", "retriever": "bm25", "value": 1.0} and whole["comparisons"][0]["r_recall_5"] == 100.0
    assert S.read_report(spark, f"{tmp_path}/eval/retrieval_eval_fixed_bm25.json")["queries"] == 1
    text = S.markdown_report("T", {"a|b": ["x", "y"]}, [{"n": 1, "m": "p|q\nr"}], ("note",))
    assert text == "# T\n\n- a|b: `x, y`\n\n| n | m |\n|---|---|\n| 1 | p\\|q r |\n\n- note\n"
    S.write_markdown("T", {}, chunks.select("chunk_id"), f"{tmp_path}/md")
    assert "m_fixed_chunk_00001" in "".join(r.value for r in spark.read.text(f"{tmp_path}/md").collect())
    doc = {"doc_id": "d", "blocks": [{"block_id": "b1", "type": "paragraph", "text": "t"}], "queries": [{"query_id": "q", "gold_block_ids": ["b1"]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    S.write_conversion(S.read_documents(spark, f"{tmp_path}/d.json"), queries, chunks.agg(F.count("*").alias("n")), f"{tmp_path}/conv")
    assert spark.read.json(f"{tmp_path}/conv/blocks.jsonl").first().block_id == "b1" and S.read_report(spark, f"{tmp_path}/conv/conversion_report.json") == {"n": 1}
    assert S.read_csv(spark, f"{tmp_path}/conv/queries.csv").first().query_id == "q"


def test_validation_by_hand(spark):
    anchor = "struct<dataset:string,source_doc_id:string,first_block_id:string,last_block_id:string,block_count:int,sections:array<string>>"
    full = ("s", "s", "b1", "b1", 1, [])
    chunks = spark.createDataFrame(
        [("c1", "text", ["b1"], full, ["length_ok"], 9), ("c2", "", ["b2", "x"], full, [], 90), ("c3", "t", [], None, ["f"], 5)],
        f"chunk_id string, text string, source_blocks array<string>, source_anchor {anchor}, quality_flags array<string>, token_count int",
    )
    blocks = spark.createDataFrame([("b1", "d", "d", "table", []), ("b2", "d", "d", "paragraph", ["T"]), ("b3", "e", None, "heading", [])], "block_id string, doc_id string, source_doc_id string, type string, title_path array<string>")
    errors = sorted((r.chunk_id, r.error) for r in quality.chunk_errors(chunks, blocks).collect())
    assert errors == [("c2", "empty_text"), ("c2", "unknown_block"), ("c3", "no_anchor"), ("c3", "no_source_blocks")]
    assert sorted((r.chunk_id, r.warning) for r in quality.chunk_warnings(chunks, 50).collect()) == [("c2", "no_quality_flags"), ("c2", "over_max_tokens")]
    v = quality.chunk_validation(chunks, blocks, 50).first()
    assert (v.chunks, v.min_tokens, v.max_tokens, v.avg_tokens, v.errors, v.warnings, v.status) == (3, 5, 90, 34.67, 4, 2, "failed")
    assert quality.chunk_validation(chunks.filter("chunk_id = 'c1'")).first().status == "passed"
    docs = spark.createDataFrame([("d", "provided_by_dataset", "post_normalization_packaging", [1])], "doc_id string, normalization_status string, governance_stage string, blocks array<int>")
    gold = spark.createDataFrame([("q", "d", ["b1", "nope"]), ("p", "z", [])], "query_id string, doc_id string, gold_block_ids array<string>")
    found = sorted((r.id, r.error) for r in quality.governed_errors(docs, blocks, gold).collect())
    assert found == [("b3", "no_anchor"), ("b3", "unknown_document"), ("p", "unknown_document"), ("q", "unknown_gold_block")]
    assert [r.id for r in quality.governed_warnings(blocks).collect()] == ["b1"]
    none = quality.governed_validation(docs, blocks.limit(0), gold.limit(0), gold.limit(0), spark.createDataFrame([], "block_id string")).first()
    assert none.evidence_match_rate is None and none.status == "passed"
    assert [(r.type, r.n) for r in quality.protected_types(blocks).collect()] == [("table", 1)]


def test_acceptance_by_hand(spark):
    rates = spark.createDataFrame([(100.0, 99.0, 100.0, 90.0, 95.0)], "field_rate double, anchor_rate double, unbroken_rate double, length_rate double, protected_rate double")
    read = lambda df: {r.metric: r.verdict for r in df.collect()}
    alone = read(quality.acceptance_report(rates))
    assert alone == {"field_rate": "passed", "anchor_rate": "failed", "unbroken_rate": "passed", "length_rate": "passed", "protected_rate": "passed", "retrieval_uplift": "pending", "boundary_coverage": "pending", "manual_evaluation": "pending"}
    delta = spark.createDataFrame([(12.0, None)], "r_recall_5 double, r_ndcg_5 double")
    scores = spark.createDataFrame([("4", " 5 ")] * 20 + [("9", "4"), ("x", "4")], "semantic_integrity_score string, tag_summary_score string")
    whole = read(quality.acceptance_report(rates, delta, spark.createDataFrame([(0.8,)], "coverage double"), quality.manual_pairs(scores)))
    assert (whole["retrieval_uplift"], whole["boundary_coverage"], whole["semantic_integrity_score"]) == ("failed", "passed", "passed")
    few = quality.manual_verdicts(quality.manual_pairs(scores.limit(19)))
    assert {r.verdict for r in few.collect()} == {"too_few"}


def test_provider_answers(spark):
    blocks = adapters.markdown_blocks(spark.createDataFrame([("m", "# Alpha\nred fox runs fast")], "doc_id string, text string"))
    raw = {"summary": " S  x ", "topic_tags": "a, A ,b", "entity_tags": ["E", "e", "F"], "semantic_integrity_score": 9, "tag_accuracy_score": "bad", "faithfulness_risk": "none",
           "qa_pairs": [{"question": "q?", "answer": "yes", "faithfulness_score": "4.256"}, {"question": "r", "answerability": "odd"}] + [{"question": "x"}] * 3}
    chunks = api.chunk(blocks, "fixed")
    before = enrichment.enrich(chunks).first().enrichment
    e = enrichment.provided(chunks, lambda c: c.withColumn("answer", F.lit("```json\n" + json.dumps(raw) + "\n```")), "model").first().enrichment
    assert (e.provider, e.summary, e.topic_tags, e.entity_tags, e.integrity, e.tag_accuracy, e.risk) == ("model", "S x", ["a", "b"], ["E", "F"], 5.0, before.tag_accuracy, before.risk)
    assert [(p.question, p.answer, p.answerability, p.faithfulness_score) for p in e.qa_pairs] == [("q?", "yes", "answerable", 4.26), ("r", "", "unanswerable", 4.5), ("x", "", "unanswerable", 4.5)]
    assert e.qa_pairs[0].instruction == "Answer using only the provided chunk."
    assert enrichment.provided(chunks, lambda c: c.withColumn("answer", F.lit("no json")), "model").first().enrichment == before


def test_routing(spark):
    assert api.route("build a large model corpus", 2) == "enrich" and api.route("请生成摘要", 1) == "enrich" and api.route("split these", 3) == "chunk_batch"
    assert api.wants_questions("生成问答") and api.wants_questions("instruction data") and not api.wants_questions("chunk it")


def test_read_model_and_paths(spark, tmp_path):
    made = []
    model = api.ReadModel(rows=lambda: made.append(1) or spark.range(3))
    assert model["rows"].count() == 3 and model["rows"].count() == 3 and made == [1]
    model.refresh()
    assert model["rows"].count() == 3 and made == [1, 1]
    model.refresh()
    with pytest.raises(KeyError):
        model["nope"]
    (tmp_path / "note one.md").write_text("# H\nsome body text")
    out = api.run_path(spark, f"{tmp_path}/note one.md", f"{tmp_path}/out", strategies=("fixed",))
    assert out["summary"].first().chunks == 1 and S.read_report(spark, f"{tmp_path}/out/chunks_fixed/chunking_summary.json")["reports"][0]["strategy"] == "fixed"
    chunks = {"fixed": out["chunks_fixed"]}
    asked = spark.createDataFrame([("q", "x", "body text", ["b"])], "query_id string, doc_id string, question string, gold array<string>")
    assert api.compare(asked, chunks, "q", idf="plus_one").count() == 1 and api.compare(asked, chunks, "other").count() == 0


def test_quality_by_hand(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "k int")
    assert sorted(r.place for r in quality.even_sample(rows, "k", 3).collect()) == [0, 2, 4]
    assert sorted(r.place for r in quality.even_sample(rows.filter("k < 4"), "k", 3).collect()) == [0, 2, 3]
    s = quality.manual_scores(spark.createDataFrame([("4.5",), ("x",), ("9",), ("2",), (None,)], "s string"), "s").first()
    assert (s.completed, s.average, s.least, s.greatest) == (2, 3.25, 2.0, 4.5)
    d = spark.createDataFrame([("t", "r", None, 20.0), ("u", "r", 11.0, 12.0)], "strategy string, retriever string, r_recall_5 double, r_ndcg_5 double")
    assert {r.strategy: r.passed for r in quality.uplift_ok(d).collect()} == {"t": False, "u": True}
    docs = spark.createDataFrame([("a", "simulated_governed", "post_normalization_packaging", [1]), ("b", "?", None, [])], "doc_id string, normalization_status string, governance_stage string, blocks array<int>")
    assert sorted(r.error for r in quality.document_errors(docs).collect()) == ["bad_stage", "bad_status", "no_blocks"]


def test_enrichment_by_hand(spark):
    assert [r.x for r in spark.createDataFrame([(["A", "a ", "", "b"],)], "v array<string>").select(enrichment.dedupe(F.col("v"), 5).alias("x")).collect()] == [["A", "b"]]
    got = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("x {\"b\": {}} y",), ("none",)], "s string").select(enrichment.extract_json(F.col("s")).alias("j")).collect()
    assert [r.j for r in got] == ['{"a": 1}', '{"b": {}}', None]
    assert api.route("please summarize", 2) == "enrich" and api.route("go", 1) == "chunk" and api.route("go", 0) == "inspect" and api.route("x", 3, "y") == "y"


def test_run_and_stream(spark, sf, tmp_path):
    blocks = adapters.markdown_blocks(spark.createDataFrame([("m", "# Alpha\nred fox runs fast\n# Beta\nblue whale swims deep")], "doc_id string, text string"))
    queries = spark.createDataFrame([("q1", "m", "where does the blue whale swim", ["m_b00004"], False), ("q2", "m", "x", [], False)], "query_id string, doc_id string, question string, gold array<string>, is_unanswerable boolean")
    out = api.run(blocks, queries, ("fixed",), enrich=True)
    assert out["report_fixed"].first().chunks == 1 and out["enriched_fixed"].first().enrichment.risk == "medium"
    for retriever in api.RETRIEVERS:
        r = api.evaluate(queries, api.chunk(blocks, "fixed"), "fixed", retriever, same_doc=True).collect()
        assert [x.query_id for x in r] == ["q1"] and r[0].recall_1 == 1.0
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("s", "# H\nbody text")], "doc_id string, text string").write.mode("overwrite").json(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id string, text string").json(f"{tmp_path}/in")
    query = stream_chunks(stream, adapters.markdown_blocks, f"{tmp_path}/out", f"{tmp_path}/cp", "fixed")
    query.awaitTermination()
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["body text"]


def test_small_service_functions(spark):
    rows = spark.createDataFrame([("q1", "Doc-A", "Where IS it"), ("q2", "b", None)], "query_id string, doc_id string, question string")
    assert [r.query_id for r in api.search_text(rows, "is it").collect()] == ["q1"] and api.search_text(rows, "Q").count() == 2 and api.search_text(rows, "doc-a").count() == 1
    metrics = spark.createDataFrame([("fixed", "bm25", *[0.5] * 5), ("structure", "bm25", *[0.7] * 5)], "strategy string, retriever string, recall_1 double, recall_3 double, recall_5 double, mrr double, ndcg_5 double")
    shown = api.overview(spark.range(1), spark.range(2), metrics)
    assert (len(shown["conversion"]), len(shown["chunking"]), len(shown["metrics"]), len(shown["best"])) == (1, 2, 2, 10)
    assert next(r for r in shown["best"] if r["metric"] == "mrr" and r["place"] == 1)["strategy"] == "structure"
    asked = spark.createDataFrame([(True, ["a"]), (False, []), (None, None), (False, ["b"])], "is_unanswerable boolean, gold array<string>")
    s = evaluation.skip_reasons(asked).first()
    assert (s.unanswerable, s.no_gold, evaluation.answerable(asked).count()) == (1, 2, 1)
    scores = spark.createDataFrame([("9",), ("-1",), ("x",), (None,), ("3.14159",)], "v string").select(enrichment.clamp(F.col("v"), F.lit(2.5)).alias("s"))
    assert [r.s for r in scores.collect()] == [5.0, 0.0, 2.5, 2.5, 3.14]
    listed = spark.createDataFrame([('["a", " b ", ""]',), ('"x, y ,"',), ("7",), (None,)], "v string").select(enrichment.as_list(F.col("v")).alias("l"))
    assert [r.l for r in listed.collect()] == [["a", "b"], ["x", "y"], ["7"], []]
    ids = spark.createDataFrame([("p/1 x",), ("///",), (None,)], "v string").select(bm25.T.safe_id_or_hash("v").alias("i"))
    assert [r.i for r in ids.collect()] == ["p_1_x", "da39a3ee5e6b", "da39a3ee5e6b"]


def test_fold_text_rules():
    from loomgrain.functions import folds

    assert folds.join(["a", "b"]) == "a b" and folds.join(["中", "b"]) == "中b"
    assert folds.windows("a b c d e", 2) == ["a b", "c d", "e"] and folds.windows("中文文本 ab", 3) == ["中文文", "本ab"]
    assert folds.packed_sentences("a b. c d. e f g h i. j.", 4) == ["a b. c d.", "e f g h", "i.", "j."]
    texts, none = ["the cat sat", "cat and dog", "the bird", "dog dog bird"], frozenset()
    cat, dog, bird, one = (math.log(5 / (1 + n)) + 1 for n in (2, 2, 2, 1))
    near = (cat * cat) / (math.hypot(cat, one) * math.hypot(cat, dog))
    assert folds.sentence_distances(texts, frozenset(["the", "and"]), 9)[0] == pytest.approx(1 - near)
    assert folds.sentence_distances(texts, none, 1) == [1.0, 1.0, 1.0]  # dog alone is left, three times; its sentences are no neighbours
    assert folds.sentence_distances(["a", "1"], none, 9) is None
    assert folds.linear_percentile([1, 2, 4], 0.75) == 3.0 and folds.linear_percentile([5.0], 0.75) == 5.0
    assert folds.packed_sentences("中文。文本。", 2) == ["中文。", "文本。"] and folds.packed_sentences("", 3) == []
