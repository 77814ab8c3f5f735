"""Validation, acceptance, enrichment and manual-score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrain.functions import text as T
from loomgrain.operators import enrichment, evaluation, evidence, fixed, folded, quality, reports
from loomgrain.plans import api, chunking, retrieval, views
from loomgrain.plans import chunksql as C
from loomgrain.plans import sqltext as S
from loomgrain.schemas import GOVERNANCE_STAGE
from loomgrain.session import dealt as table
from loomgrain.session import written
from loomgrain.sources.io import manual_sample


def _both(spark, sf):
    blocks = views.line_blocks(spark, sf)
    return blocks, fixed.chunks(blocks)


def membership_counts(spark, sf):
    return quality.membership(*_both(spark, sf)).groupBy("type", "n_chunks").agg(F.count("*").alias("blocks"))


def unknown_source_blocks(spark, sf):
    """References of chunks to blocks, with the paragraphs alone taken as known."""
    blocks, chunks = _both(spark, sf)
    return quality.unknown_blocks(chunks, blocks.filter("type = 'paragraph'"))


def acceptance_rates(spark, sf):
    return quality.acceptance(*_both(spark, sf))


def acceptance_verdicts(spark, sf):
    return quality.verdicts(quality.acceptance(*_both(spark, sf)))


def even_sample(spark, sf):
    return quality.even_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 20)


def manual_scores(spark, sf):
    rows = table(spark, sf, "labels").select((F.col("quality") * 5 - F.col("toxic")).cast("string").alias("score"))
    return quality.manual_scores(rows, "score")


def integrity_and_risk(spark, sf):
    chunks = _both(spark, sf)[1]
    return chunks.groupBy(enrichment.integrity().alias("integrity"), enrichment.risk().alias("risk")).agg(F.count("*").alias("chunks"))


def qa_rows(spark, sf):
    rows = enrichment.qa_rows(enrichment.enrich(_both(spark, sf)[1]))
    return rows.select("qa_id", "question", "answer", "answerability", "faithfulness_score")


def enrichment_report(spark, sf):
    return enrichment.report(enrichment.enrich(_both(spark, sf)[1]))


def chunk_validation(spark, sf):
    """Fixed chunks against the paragraphs alone, so that references to tables are errors; over 500 tokens is a warning."""
    blocks, chunks = _both(spark, sf)
    return quality.chunk_validation(chunks, blocks.filter("type = 'paragraph'"), 500)


def chunk_findings(spark, sf):
    """The validation's errors and warnings by kind."""
    blocks, chunks = _both(spark, sf)
    errors = quality.chunk_errors(chunks, blocks.filter("type = 'paragraph'")).select(F.lit("error").alias("level"), F.col("error").alias("kind"))
    warnings = quality.chunk_warnings(chunks, 500).select(F.lit("warning").alias("level"), F.col("warning").alias("kind"))
    return errors.unionByName(warnings).groupBy("level", "kind").agg(F.count("*").alias("n"))


def governed_validation(spark, sf):
    """Documents as governed documents (those with German text have another status), lines as blocks, benchmark passages as queries."""
    blocks = views.line_blocks(spark, sf)
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("lang") == "de", "raw").otherwise("provided_by_upstream").alias("normalization_status"),
        F.lit(GOVERNANCE_STAGE).alias("governance_stage"), F.filter(F.split("text", "\n"), lambda x: T.normalize(x) != "").alias("blocks"),
    )
    matches = written(evidence.match(retrieval._evidence(spark, sf), blocks), "matches")
    gold = matches.groupBy("query_id", "doc_id").agg(F.collect_set("block_id").alias("gold_block_ids"))
    return quality.governed_validation(docs, blocks, table(spark, sf, "benchmark"), gold.withColumn("query_id", F.col("query_id").cast("string")), matches)


def acceptance_report(spark, sf):
    """All verdicts over fixed chunks: rates, line units' uplift, boundaries of the turns' chunks; manual scores from the labels."""
    delta = evaluation.baseline_delta(evaluation.summary(retrieval._per_query(spark, sf))).filter("retriever = 'bm25'")
    coverage = reports.boundary_summary(folded.structure_chunks(views.turn_blocks(spark, sf)))
    scores = table(spark, sf, "labels").select((F.col("quality") * 2 + 3).cast("string").alias("semantic_integrity_score"), (F.col("quality") * 4 + F.col("toxic")).cast("string").alias("tag_summary_score"))
    return quality.acceptance_report(quality.acceptance(*_both(spark, sf)), delta, coverage, quality.manual_pairs(scores))


def protected_types(spark, sf):
    return quality.protected_types(views.line_blocks(spark, sf))


def field_counts(spark, sf):
    return quality.field_counts(_both(spark, sf)[1])


def compact_chunks(spark, sf):
    """The preview rows of fixed chunks."""
    listed = lambda c: F.array_join(c, ",").alias(c)
    return api.compact(_both(spark, sf)[1]).select("chunk_id", "strategy", "token_count", listed("title_path"), listed("source_blocks"), listed("quality_flags"), "preview")


def manual_rows(spark, sf):
    """Rows for manual scoring of an even sample of fixed chunks."""
    return manual_sample(_both(spark, sf)[1], 20).select("sample_no", "chunk_id", "title_path", "token_count", "quality_flags", "tags", "summary", "semantic_integrity_score")


QUERIES = {
    f.__name__: f
    for f in (
        membership_counts, unknown_source_blocks, acceptance_rates, acceptance_verdicts, even_sample, manual_scores, integrity_and_risk, qa_rows, enrichment_report,
        chunk_validation, chunk_findings, governed_validation, acceptance_report, protected_types, field_counts, compact_chunks, manual_rows,
    )
}

_WITH = f"WITH RECURSIVE {views.FIXED_SQL}"
_MEMBERS = f"""{_WITH}, held AS (SELECT doc_id, unnest(ords) AS ord FROM chunks), per AS (SELECT doc_id, ord, count(*) AS n FROM held GROUP BY ALL),
    members AS (SELECT type, coalesce(n, 0) AS n_chunks FROM lines LEFT JOIN per USING (doc_id, ord))"""
# The fields and anchors of the chunk rows are judged as they are in C.FIXED, of which text, tags, flags and blocks may be empty.
_RATES = f"""{C.FIXED}, held AS (SELECT doc_id, unnest(ords) AS ord FROM done), per AS (SELECT doc_id, ord, count(*) AS n FROM held GROUP BY ALL),
    members AS (SELECT type, coalesce(n, 0) AS n_chunks FROM src LEFT JOIN per USING (doc_id, ord)),
    heads AS (SELECT d.chunk_id, count(l.lang) > 0 AND bool_and(l.source IS NOT NULL) AS anchored FROM (SELECT chunk_id, doc_id, unnest(ords) AS ord FROM done) d
        JOIN lines l ON l.doc_id::VARCHAR = d.doc_id AND l.ord = d.ord GROUP BY ALL),
    judged AS (SELECT d.*, text <> '' AND summary <> '' AND len(tags) > 0 AND len(source_blocks) > 0 AND len(flags) > 0 AND token_count > 0 AND anchored AS full_row,
        list_contains(flags, 'source_anchor_complete') AND len(source_blocks) = len(ords) AND len(ords) > 0 AS anchor_row FROM done d JOIN heads USING (chunk_id)),
    rates AS (SELECT (SELECT count(*) FROM judged) AS chunks, (SELECT round(avg(CASE WHEN full_row THEN 100.0 ELSE 0 END), 2) FROM judged) AS field_rate,
    (SELECT round(avg(CASE WHEN anchor_row THEN 100.0 ELSE 0 END), 2) FROM judged) AS anchor_rate,
    (SELECT round(avg(CASE WHEN list_contains(flags, 'length_ok') THEN 100.0 ELSE 0 END), 2) FROM judged) AS length_rate,
    count(*) AS content_blocks, count(*) FILTER (type = 'table') AS protected_blocks,
    round(avg(CASE WHEN n_chunks = 1 THEN 100.0 ELSE 0 END), 2) AS unbroken_rate,
    coalesce(round(avg(CASE WHEN n_chunks = 1 THEN 100.0 ELSE 0 END) FILTER (type = 'table'), 2), 100.0) AS protected_rate FROM members)"""
_LONG = "UNPIVOT (SELECT field_rate, anchor_rate, unbroken_rate, length_rate, protected_rate FROM rates) ON COLUMNS(*) INTO NAME metric VALUE value"
_LIMIT = "CASE metric WHEN 'protected_rate' THEN 95 WHEN 'length_rate' THEN 90 ELSE 100 END"
_UNKNOWN = "unknown AS (SELECT chunk_id, ord FROM (SELECT chunk_id, doc_id, unnest(ords) AS ord FROM done) JOIN src USING (doc_id, ord) WHERE type = 'table')"
_SCORED = f"""{_WITH}, scored AS (SELECT round(4.8 - CASE WHEN token_count < 128 THEN 0.3 WHEN token_count > 512 THEN 0.5 ELSE 0.0 END, 2)::DOUBLE AS integrity,
    CASE WHEN token_count > 512 THEN 'medium' ELSE 'low' END AS risk FROM chunks)"""
SQL = {
    "membership_counts": f"{_MEMBERS} SELECT type, n_chunks, count(*) AS blocks FROM members GROUP BY ALL",
    "unknown_source_blocks": f"""{_WITH}, held AS (SELECT doc_id, idx, unnest(ords) AS ord FROM chunks)
        SELECT format('{{}}_fixed_chunk_{{:05d}}', doc_id, idx) AS chunk_id, format('{{}}_b{{:05d}}', doc_id, ord) AS block_id FROM held JOIN lines USING (doc_id, ord) WHERE type = 'table'""",
    "acceptance_rates": f"{_RATES} SELECT * FROM rates",
    "acceptance_verdicts": f"{_RATES}, long AS ({_LONG}) SELECT metric, value, value >= {_LIMIT} AS passed FROM long",
    "chunk_validation": f"""{C.FIXED}, {_UNKNOWN} SELECT count(*) AS chunks, min(token_count) AS min_tokens, max(token_count) AS max_tokens, round(avg(token_count), 2) AS avg_tokens,
        count(*) FILTER (text = '') + max(u) AS errors, count(*) FILTER (token_count > 500) AS warnings, CASE WHEN count(*) FILTER (text = '') + max(u) = 0 THEN 'passed' ELSE 'failed' END AS status
        FROM done, (SELECT count(*) AS u FROM unknown)""",
    "chunk_findings": f"""{C.FIXED}, {_UNKNOWN}, found AS (SELECT 'error' AS level, 'unknown_block' AS kind FROM unknown UNION ALL SELECT 'error', 'empty_text' FROM done WHERE text = ''
        UNION ALL SELECT 'warning', 'over_max_tokens' FROM done WHERE token_count > 500) SELECT level, kind, count(*) AS n FROM found GROUP BY ALL""",
    "governed_validation": f"""WITH {views.LINES_SQL}, {retrieval._MATCH}, golds AS (SELECT query_id, doc_id, count(block_id) AS n FROM matched GROUP BY ALL),
        bad AS (SELECT count(*) FILTER (lang = 'de') + count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM lines)) AS n FROM documents)
        SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM lines) AS blocks, (SELECT count(*) FROM benchmark) AS queries, (SELECT count(*) FROM golds) AS gold_records,
        count(*) AS evidence_items, count(block_id) AS matched_evidence_items, round(count(block_id) / count(*), 6) AS evidence_match_rate, (SELECT n FROM bad) AS errors,
        (SELECT count(*) FROM lines WHERE source IS NULL) AS warnings, CASE WHEN (SELECT n FROM bad) = 0 THEN 'passed' ELSE 'failed' END AS status FROM matched""",
    # The three measured parts of the report come from their own queries' SQL.
    "acceptance_report": f"""WITH r AS (FROM ({_RATES} SELECT * FROM rates)), long AS ({_LONG.replace('FROM rates', 'FROM r')}), d AS (FROM ({retrieval.SQL['baseline_delta']})), b AS (FROM ({chunking.SQL['boundary_summary']})),
        s AS (SELECT quality * 2 + 3 AS semantic_integrity_score, quality * 4 + toxic AS tag_summary_score FROM labels WHERE quality * 2 + 3 BETWEEN 1 AND 5 AND quality * 4 + toxic BETWEEN 1 AND 5),
        m AS (SELECT metric, count(*) AS completed, round(avg(v), 2) AS value, min(v) AS least FROM (UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE v) GROUP BY metric)
        SELECT metric, value::DOUBLE AS value, CASE WHEN value >= {_LIMIT} THEN 'passed' ELSE 'failed' END AS verdict FROM long UNION ALL
        SELECT 'retrieval_uplift', max(least(coalesce(r_recall_5, 0), coalesce(r_ndcg_5, 0))), CASE WHEN max(least(coalesce(r_recall_5, 0), coalesce(r_ndcg_5, 0))) >= 10 THEN 'passed' ELSE 'failed' END FROM d WHERE retriever = 'bm25' UNION ALL
        SELECT 'boundary_coverage', max(coverage), CASE WHEN max(coverage) >= 0.8 THEN 'passed' ELSE 'failed' END FROM b WHERE scored > 0 UNION ALL
        SELECT metric, value, CASE WHEN completed < 20 THEN 'too_few' WHEN value >= 4 AND least >= 3 THEN 'passed' ELSE 'failed' END FROM m""",
    "protected_types": f"WITH {views.LINES_SQL} SELECT type, count(*) AS n FROM lines WHERE type = 'table' GROUP BY type",
    "field_counts": f"""{C.FIXED} SELECT count(*) FILTER (len(tags) > 0) AS tags, count(*) FILTER (summary <> '') AS summary, count(*) FILTER (len(tags) > 0) AS entity_tags,
        count(*) FILTER (len(source_blocks) > 0) AS source_blocks FROM done""",
    "compact_chunks": f"""{C.FIXED} SELECT chunk_id, 'fixed' AS strategy, token_count, array_to_string(tops, ',') AS title_path, array_to_string(source_blocks[1:5], ',') AS source_blocks,
        array_to_string(flags, ',') AS quality_flags, left({S.normalize('text')}, 240) AS preview FROM done""",
    "manual_rows": f"""{C.FIXED}, r AS (SELECT *, row_number() OVER (ORDER BY chunk_id) - 1 AS place, count(*) OVER () AS n FROM done),
        w AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 19, 0) AS BIGINT) AS place FROM (SELECT max(n) AS n FROM r), range(0, 20) t(i))
        SELECT row_number() OVER (ORDER BY place) AS sample_no, chunk_id, array_to_string(tops, ' | ') AS title_path, token_count, array_to_string(flags, ' | ') AS quality_flags,
        array_to_string(tags, ' | ') AS tags, summary, '' AS semantic_integrity_score FROM r JOIN w USING (place)""",
    "even_sample": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents),
        w AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 19, 0) AS BIGINT) AS place FROM (SELECT max(n) AS n FROM r), range(0, 20) t(i))
        SELECT doc_id, place FROM r JOIN w USING (place)""",
    "manual_scores": """SELECT count(*) FILTER (s BETWEEN 1 AND 5) AS completed, round(avg(s) FILTER (s BETWEEN 1 AND 5), 2) AS average,
        min(s) FILTER (s BETWEEN 1 AND 5)::DOUBLE AS least, max(s) FILTER (s BETWEEN 1 AND 5)::DOUBLE AS greatest FROM (SELECT quality * 5 - toxic AS s FROM labels)""",
    # A question is about the first of the title and the tags that is no weak word.
    "qa_rows": f"""{C.FIXED}, named AS (SELECT *, list_filter(list_concat(tops, tags), lambda t: lower(t) NOT IN ({", ".join(f"'{w}'" for w in enrichment.WEAK)})) AS strong FROM done)
        SELECT chunk_id || '_qa_01' AS qa_id, 'According to the chunk, what is the main point about ' || coalesce(strong[1], tops[len(tops)], 'the chunk content') || '?' AS question, summary AS answer,
        CASE WHEN summary <> '' THEN 'answerable' ELSE 'unanswerable' END AS answerability, CASE WHEN summary <> '' THEN 4.7 ELSE 4.0 END::DOUBLE AS faithfulness_score FROM named""",
    "integrity_and_risk": f"{_SCORED} SELECT integrity, risk, count(*) AS chunks FROM scored GROUP BY ALL",
    "enrichment_report": f"""{_SCORED} SELECT risk, 'deterministic' AS provider, count(*) AS chunks, round(avg(integrity), 4) AS avg_integrity,
        4.7::DOUBLE AS avg_faithfulness, 4.5::DOUBLE AS avg_tag_accuracy FROM scored GROUP BY risk""",
}
