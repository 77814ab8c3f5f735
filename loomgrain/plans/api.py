"""The service surface as functions: chunk one or many documents, evaluate, and read results. Requests are validated, results are DataFrames."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.functions import text as T
from loomgrain.operators import bm25, boundary, dense, enrichment, evaluation, fixed, folded, fusion, reports
from loomgrain.session import written
from loomgrain.sources import adapters, io

STRATEGIES = {
    "fixed": (fixed.FixedConfig, fixed.chunks),
    "recursive": (folded.RecursiveConfig, folded.recursive_chunks),
    "semantic": (folded.SemanticConfig, folded.semantic_chunks),
    "structure": (boundary.StructureConfig, folded.structure_chunks),
}
RETRIEVERS = ("bm25", "dense", "hybrid")
ENCODERS: dict[str, dense.Encoder] = {"tfidf_svd": dense.tfidf_svd}
#: The CJK preset changes the tokenizer and nothing else.
PRESETS = {"default": {}, "zh_cjk": {"profile": "cjk_2_4gram"}}
# Words of a request that ask for enrichment, and for question-answer pairs.
ENRICH_WORDS = "llm|large model|semantic organization|semantic enrichment|summary|summarize|tag|entity|qa|大模型|语义组织|语义增强|摘要|标签|实体|问答".split("|")
QA_WORDS = "qa|question|instruction data|问答|指令数据".split("|")


def config_of(strategy: str, settings: dict | None = None):
    """The strategy's configuration; unknown strategies and settings are errors that name what is allowed."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; allowed: {', '.join(sorted(STRATEGIES))}")
    kind = STRATEGIES[strategy][0]
    allowed = {f.name for f in fields(kind)}
    if unknown := set(settings or {}) - allowed:
        raise ValueError(f"unknown settings {sorted(unknown)}; allowed: {', '.join(sorted(allowed))}")
    return kind(**(settings or {}))


def chunk(blocks: DataFrame, strategy: str = "structure", settings: dict | None = None) -> DataFrame:
    """Chunks of all documents whose blocks are given; one document or many is the same plan."""
    return STRATEGIES[strategy][1](blocks, config_of(strategy, settings)) if strategy in STRATEGIES else config_of(strategy)


def chunk_report(blocks: DataFrame, strategy: str = "structure", settings: dict | None = None) -> DataFrame:
    return reports.chunk_report(chunk(blocks, strategy, settings))


def preset(name: str, **settings) -> dict:
    """settings with the preset's own where they are not given."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; allowed: {', '.join(sorted(PRESETS))}")
    return PRESETS[name] | settings


def retrieve(
    queries: DataFrame, chunks: DataFrame, retriever: str = "bm25", k: int | None = 10, same_doc: bool = False, alpha: float = 0.55, profile: str = "mixed",
    idf: str = "okapi", metadata: bool = False, encoder: str | dense.Encoder = "tfidf_svd", position: str = "chunk_id",
) -> DataFrame:
    """query_id, chunk_id, score, rank. queries: query_id, doc_id, question. k None ranks all candidates.

    Every candidate is ranked, one without a shared term with score 0; corpus statistics stay
    global under same_doc. BM25 and dense ties go by position (a column of chunks), fused
    ties by chunk_id. A question without tokens has no hits.
    """
    if retriever not in RETRIEVERS:
        raise ValueError(f"unknown retriever {retriever!r}; allowed: {', '.join(RETRIEVERS)}")
    text = F.concat_ws(" ", "text", F.concat_ws(" ", "title_path"), F.concat_ws(" ", "tags"), "summary") if metadata else F.col("text")
    texts = chunks.select("chunk_id", text.alias("text"))
    asked = written(T.with_tokens(queries.select("query_id", F.col("question").alias("text")), profile).select("query_id", "tokens").filter(F.size("tokens") > 0), "asked")
    if isinstance(encoder, str) and encoder not in ENCODERS:
        raise ValueError(f"unknown encoder {encoder!r}; allowed: {', '.join(ENCODERS)}")
    own = list({"chunk_id", "doc_id", position})
    candidates = chunks.select(*own)
    scope = queries.select("query_id", "doc_id").join(candidates, "doc_id") if same_doc else None

    def sparse() -> DataFrame:
        return bm25.scores(asked, bm25.tokenised(texts, "chunk_id", profile=profile), "query_id", "chunk_id", idf)

    def near() -> DataFrame:
        return dense.search(dense.tokens(texts, "chunk_id", profile=profile), asked, "chunk_id", "query_id", ENCODERS[encoder] if isinstance(encoder, str) else encoder)

    def within(s: DataFrame) -> DataFrame:
        """The scores of the candidates in scope, all of them where a scope is given."""
        if scope is None:
            return s
        held = scope.select("query_id", "chunk_id").join(asked.select("query_id"), "query_id", "left_semi")
        return held.join(s, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    if retriever == "hybrid":
        total = scope.groupBy("query_id").agg(F.count("*").alias("n")) if same_doc else chunks.agg(F.count("*").alias("n"))
        scored = fusion.fuse(within(sparse()), within(near()), "query_id", "chunk_id", total, alpha)
        place = "chunk_id"
    else:
        scored, place = within(sparse() if retriever == "bm25" else near()), position
    if place != "chunk_id":
        scored = scored.join(candidates.select("chunk_id", place), "chunk_id")
    if k is None and scope is None and retriever == "bm25":  # every chunk, scored or not
        every = asked.select("query_id").join(candidates.select(*{"chunk_id", place}))
        scored = every.join(scored.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left").na.fill(0.0, ["score"])
    elif k is not None and scope is None and retriever == "bm25":
        top = bm25.top_k_of_all(scored, asked, candidates, "query_id", place, k)
        return top.join(candidates.select(*{"chunk_id", place}), place).select("query_id", "chunk_id", "score", "rank")
    return bm25.top_k(scored, "query_id", place, (1 << 62) if k is None else k).select("query_id", "chunk_id", "score", "rank")


def evaluate(queries: DataFrame, chunks: DataFrame, strategy: str, retriever: str = "bm25", same_doc: bool = True, ks=evaluation.KS, ndcg_k: int = 5, **settings) -> DataFrame:
    """Per-query measures over the whole ranking of all candidates. queries: query_id, doc_id, question, gold (block ids), is_unanswerable."""
    held = evaluation.answerable(queries)
    gold = held.select("query_id", F.explode("gold").alias("block_id")).distinct()
    ranked = retrieve(held, chunks, retriever, None, same_doc, **settings).join(chunks.select("chunk_id", F.col("source_blocks").alias("blocks")), "chunk_id")
    named = ranked.select(F.lit(strategy).alias("strategy"), F.lit(retriever).alias("retriever"), "query_id", "rank", "blocks")
    rows = evaluation.per_query(named, gold, ks, ndcg_k)
    # A query without hits is judged too.
    missing = gold.groupBy("query_id").agg(F.count("*").alias("gold_size")).join(rows.select("query_id"), "query_id", "left_anti")
    zeros = {c: F.lit(0) for c in ("first_relevant_rank", "n_relevant", "dcg", *(f"covered_{k}" for k in ks))}
    none = evaluation.measures(missing.withColumns({"strategy": F.lit(strategy), "retriever": F.lit(retriever), **zeros}), evaluation.check_ks(ks), ndcg_k)
    return rows.unionByName(none)


def metrics(queries: DataFrame, chunks: DataFrame, strategy: str, retriever: str = "bm25", same_doc: bool = True, metadata: bool = False, **settings) -> DataFrame:
    """The report row of a strategy and retriever: means, number of chunks, scope, index fields, and queries left out."""
    rows = evaluation.summary(evaluate(queries, chunks, strategy, retriever, same_doc, metadata=metadata, **settings))
    fields = ("text", "title_path", "tags", "summary") if metadata else ("text",)
    sizes = chunks.agg(F.lit(strategy).alias("strategy"), F.count("*").alias("chunks"))
    return evaluation.metric_rows(rows, sizes, "same_doc" if same_doc else "global", fields, evaluation.skip_reasons(queries))


def overview(conversion: DataFrame, chunk_reports: DataFrame, metrics: DataFrame) -> dict[str, list[dict]]:
    """The small reports a dashboard shows; each is a few rows."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    return {"conversion": rows(conversion), "chunking": rows(chunk_reports), "metrics": rows(metrics), "best": rows(evaluation.best_by_metric(metrics))}


def search_text(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose question, document id or query id contains the text, case-insensitive."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", "question", "doc_id", "query_id")), F.lit(query.lower())))


def compact(chunks: DataFrame) -> DataFrame:
    """A preview row for each chunk."""
    return chunks.select("chunk_id", "strategy", "token_count", "title_path", F.slice("source_blocks", 1, 5).alias("source_blocks"), "quality_flags", T.preview("text").alias("preview"))


def _asks(message: str, words: list[str]) -> bool:
    return any(w in message.lower() for w in words)


def wants_enrichment(message: str) -> bool:
    return _asks(message, ENRICH_WORDS)


def wants_questions(message: str) -> bool:
    return _asks(message, QA_WORDS)


def route(message: str, documents: int, preferred: str | None = None) -> str:
    """Which tool a request is for: the preferred one, inspect without documents, enrich by its words, else one or many."""
    if preferred:
        return preferred
    if documents == 0:
        return "inspect"
    if wants_enrichment(message):
        return "enrich"
    return "chunk" if documents == 1 else "chunk_batch"


def queries_of(per_query: DataFrame, target: str = "structure", baseline: str = "fixed", retriever: str | None = None) -> DataFrame:
    """The list of queries: a row for each retriever, query and strategy, with the case type."""
    rows = per_query if retriever is None else per_query.filter(F.col("retriever") == retriever)
    return evaluation.query_rows(rows, evaluation.case_types(rows, target, baseline))


def bad_cases(per_query: DataFrame, target: str = "structure", baseline: str = "fixed", retriever: str | None = None) -> DataFrame:
    rows = per_query if retriever is None else per_query.filter(F.col("retriever") == retriever)
    return evaluation.bad_cases(evaluation.case_types(rows, target, baseline))


def compare(queries: DataFrame, chunks: dict[str, DataFrame], query_id: str, retriever: str = "bm25", k: int = 5, **settings) -> DataFrame:
    """The best hits of each strategy for one query, with the gold blocks each covers; no rows if the query is unknown."""
    own = queries.filter(F.col("query_id") == query_id)
    gold, out = own.select("query_id", F.explode("gold").alias("block_id")), None
    for strategy, held in chunks.items():
        shown = held.select(F.col("chunk_id").alias("unit"), "title_path", "source_blocks", "token_count", "quality_flags", T.preview("text").alias("preview"))
        hits = retrieve(own, held, retriever, k, **settings).withColumnRenamed("chunk_id", "unit").join(shown, "unit")
        relevant = evaluation.relevant_units(held.select(F.col("chunk_id").alias("unit"), F.col("source_blocks").alias("blocks")), gold)
        rows = evaluation.comparison(hits.withColumn("strategy", F.lit(strategy)), relevant)
        out = rows if out is None else out.unionByName(rows)
    return out


class ReadModel:
    """What a dashboard reads, each table computed once and kept until refresh()."""

    def __init__(self, **tables: Callable[[], DataFrame]):
        self._make, self._held = tables, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._make:
            raise KeyError(f"{name!r}; known: {', '.join(sorted(self._make))}")
        if name not in self._held:
            self._held[name] = self._make[name]().persist()
        return self._held[name]

    def refresh(self) -> None:
        for held in self._held.values():
            held.unpersist()
        self._held.clear()


def run_path(spark: SparkSession, path: str, out: str | None = None, **settings) -> dict[str, DataFrame]:
    """Load governed documents or Markdown, run(), and, given a folder, write the chunks with their reports."""
    if io.infer_format(path) == "markdown":
        blocks = adapters.markdown_blocks(spark.read.text(path, wholetext=True).select(T.safe_id_or_hash(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*$", 1)).alias("doc_id"), F.col("value").alias("text")))
    else:
        blocks = adapters.flat_blocks(io.read_documents(spark, path))
    found = run(blocks, **settings)
    if out:
        for name, chunks in found.items():
            if name.startswith("chunks_"):
                io.write_chunk_set(chunks, f"{out}/{name}")
    return found


def run(blocks: DataFrame, queries: DataFrame | None = None, strategies: tuple[str, ...] = ("fixed", "structure"), retriever: str = "bm25", enrich: bool = False) -> dict[str, DataFrame]:
    """Chunk, evaluate where there is gold, enrich where asked: the end-to-end flow over blocks; `summary` has every strategy's report."""
    out: dict[str, DataFrame] = {}
    for strategy in strategies:
        chunks = chunk(blocks, strategy)
        out[f"chunks_{strategy}"] = chunks
        out[f"report_{strategy}"] = reports.chunk_report(chunks)
        if queries is not None:
            out[f"eval_{strategy}"] = evaluate(queries, chunks, strategy, retriever)
        if enrich:
            out[f"enriched_{strategy}"] = enrichment.enrich(chunks)
    summary = functools.reduce(DataFrame.unionByName, [out[f"report_{s}"] for s in strategies])
    if queries is not None:
        means = functools.reduce(DataFrame.unionByName, [evaluation.summary(out[f"eval_{s}"]) for s in strategies])
        summary = summary.join(means, "strategy", "left")
    return out | {"summary": summary}
