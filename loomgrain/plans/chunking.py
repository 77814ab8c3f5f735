"""Chunking queries: blocks, the four strategies, and what is read off their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.functions import text as T
from loomgrain.operators import boundary, chunk_rows, fixed, folded, reports, tfidf
from loomgrain.plans import chunksql as C
from loomgrain.plans import sqltext as S
from loomgrain.plans import views
from loomgrain.session import dealt as table


def content_blocks(spark, sf):
    blocks = chunk_rows.content_blocks(views.line_blocks(spark, sf))
    return blocks.select("block_id", "type", T.estimate_tokens("text").alias("tokens"), T.word_count("text").alias("words"))


def block_types(spark, sf):
    return views.line_blocks(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


def block_text_titled(spark, sf):
    text = T.block_text(F.col("text"), F.col("title_path"), True)
    return views.line_blocks(spark, sf).select("block_id", F.md5(text.cast("binary")).alias("digest"))


def page_blocks(spark, sf):
    found = F.regexp_extract_all("html", F.lit("<(title|h1|p|li)>([^<]*)"), F.lit(0))
    each = table(spark, sf, "pages").select("page_id", F.posexplode(found).alias("pos", "m"))
    tag = F.regexp_extract("m", "^<([a-z0-9]+)>", 1)
    kind = F.when(tag == "title", "title").when(tag == "h1", "heading").when(tag == "li", "list").otherwise("paragraph")
    text = T.normalize(F.regexp_replace("m", "^<[a-z0-9]+>", ""))
    return each.select("page_id", F.col("pos").cast("long").alias("pos"), kind.alias("type"), text.alias("text")).filter("text <> ''")


def _fixed(spark: SparkSession, sf: str) -> DataFrame:
    return fixed.chunks(views.line_blocks(spark, sf))


def fixed_chunks(spark, sf):
    return _fixed(spark, sf).select("chunk_id", "token_count", F.size("source_blocks").cast("long").alias("n_blocks"), F.md5(F.col("text").cast("binary")).alias("digest"))


def fixed_chunk_report(spark, sf):
    return reports.chunk_report(_fixed(spark, sf))


def flag_histogram(spark, sf):
    return reports.flag_histogram(_fixed(spark, sf))


def source_anchor(spark, sf):
    a = F.col("source_anchor")
    return _fixed(spark, sf).select(
        "chunk_id", a["first_block_id"].alias("first_block"), a["last_block_id"].alias("last_block"), a["block_count"].cast("long").alias("n_blocks"),
        F.array_join(a["sections"], ",").alias("sections"), F.array_join("title_path", "/").alias("title"),
    )


def _turn_docs(spark, sf):
    return chunk_rows.documents(views.turn_blocks(spark, sf))


def boundary_stats(spark, sf):
    return boundary.statistics(_turn_docs(spark, sf)).drop("blocks", "dataset", "split", "source_doc_id")


def adaptive_profile(spark, sf):
    found = boundary.profiled(boundary.statistics(_turn_docs(spark, sf)))
    return found.select("doc_id", "profile", "boundary_strength", F.col("target").cast("long").alias("target"), "hard_threshold", "soft_threshold", "distance_threshold")


def adjacent_similarity(spark, sf):
    docs = _turn_docs(spark, sf).withColumn("bags", F.transform("blocks", lambda b: T.bag_tokens(T.block_text(b["text"], b["title_path"], True))))
    at = F.explode(F.when(F.size("bags") > 1, F.sequence(F.lit(1), F.size("bags") - 1)))
    pairs = docs.select("doc_id", "bags", at.alias("i"))
    return pairs.select("doc_id", F.col("i").cast("long").alias("i"), boundary.bag_cosine(F.get("bags", F.col("i") - 1), F.get("bags", F.col("i"))).alias("similarity"))


def _units(spark, sf):
    return folded.semantic_units(views.turn_blocks(spark, sf))


def sentence_tfidf(spark, sf):
    w = tfidf.weights(_units(spark, sf), chunk_rows.HEADER)
    return w.select("doc_id", F.col("unit.i").cast("long").alias("block"), F.col("unit.j").cast("long").alias("sentence"), "term", F.round("w", 6).alias("w"))


def adjacent_tfidf_distance(spark, sf):
    d = tfidf.distances(_units(spark, sf), chunk_rows.HEADER)
    return d.filter("distance IS NOT NULL").select("doc_id", F.col("place").cast("long").alias("place"), F.round("distance", 6).alias("distance"))


def breakpoints_p75(spark, sf):
    b = tfidf.breakpoints(_units(spark, sf), chunk_rows.HEADER)
    return b.groupBy("doc_id").agg(F.count_if("breaks").alias("breaks"), F.count("*").alias("units"))


def _slim(chunks):
    listed = lambda c: F.array_join(c, ",").alias(c)
    return chunks.select("chunk_id", "doc_id", "token_count", listed("source_blocks"), listed("quality_flags"), listed("tags"), "summary")


def recursive_chunks(spark, sf):
    return _slim(folded.recursive_chunks(views.line_blocks(spark, sf)))


def semantic_chunks(spark, sf):
    return _slim(folded.semantic_chunks(views.line_blocks(spark, sf)))


def structure_chunks(spark, sf):
    return _slim(folded.structure_chunks(views.line_blocks(spark, sf)))


def structure_chunk_report(spark, sf):
    return reports.chunk_report(folded.structure_chunks(views.turn_blocks(spark, sf)))


def structure_turn_chunks(spark, sf):
    return _slim(folded.structure_chunks(views.turn_blocks(spark, sf)))


def boundary_reasons(spark, sf):
    return reports.reason_histogram(folded.structure_chunks(views.line_blocks(spark, sf)))


def boundary_summary(spark, sf):
    return reports.boundary_summary(folded.structure_chunks(views.turn_blocks(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (
        content_blocks, block_types, block_text_titled, page_blocks, fixed_chunks, fixed_chunk_report, flag_histogram, source_anchor,
        boundary_stats, adaptive_profile, adjacent_similarity, sentence_tfidf, adjacent_tfidf_distance, breakpoints_p75,
        recursive_chunks, semantic_chunks, structure_chunks, structure_turn_chunks, structure_chunk_report, boundary_summary, boundary_reasons,
    )
}

_BLOCK_ID = "format('{}_b{:05d}', doc_id, ord)"
_CHUNK_ID = "format('{}_fixed_chunk_{:05d}', doc_id, idx)"
_FLAG = "CASE WHEN token_count < 128 THEN 'short_chunk' WHEN token_count > 512 THEN 'long_chunk' ELSE 'length_ok' END"
_TURNS = f"""
    turns AS (SELECT 'c' || conv_id AS doc_id, turn, role, {S.normalize('text')} AS norm FROM conversations WHERE {S.normalize('text')} <> ''),
    titled AS (SELECT doc_id, turn, role, norm, CASE WHEN contains(lower(left(norm, 120)), lower(role)) THEN norm ELSE '[' || role || '] ' || norm END AS t FROM turns),
    blocks AS (SELECT *, {S.tokens('t')} AS size, {S.bag('t')} AS bag, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS i FROM titled),
    counts AS (SELECT doc_id, i, w, count(*) AS n FROM (SELECT doc_id, i, unnest(bag) AS w FROM blocks) GROUP BY ALL),
    norms AS (SELECT doc_id, i, sqrt(sum(n * n)) AS l FROM counts GROUP BY ALL),
    dots AS (SELECT a.doc_id, b.i, sum(a.n * b.n) AS dot FROM counts a JOIN counts b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.w = b.w GROUP BY ALL),
    sims AS (SELECT b.doc_id, b.i - 1 AS i, round(least(1.0, coalesce(dot / (x.l * y.l), 0.0)), 4) AS s
             FROM blocks b LEFT JOIN dots d ON d.doc_id = b.doc_id AND d.i = b.i
             LEFT JOIN norms x ON x.doc_id = b.doc_id AND x.i = b.i - 1 LEFT JOIN norms y ON y.doc_id = b.doc_id AND y.i = b.i WHERE b.i > 1)"""
_STATS = f"""
    {_TURNS},
    per AS (SELECT doc_id, count(*) AS block_count, round(round(avg(size), 9), 4) AS avg_block_tokens, list_sort(list(size)) AS sizes,
                   round(avg(CASE WHEN size < 180 THEN 1.0 ELSE 0.0 END), 4) AS short_block_rate,
                   round(avg(CASE WHEN size < 256 THEN 1.0 ELSE 0.0 END), 4) AS under_half_target_rate FROM blocks GROUP BY doc_id),
    steps AS (SELECT doc_id, i, role <> lag(role) OVER (PARTITION BY doc_id ORDER BY i) AS moved FROM blocks),
    moves AS (SELECT doc_id, coalesce(round(avg(CASE WHEN moved THEN 1.0 ELSE 0.0 END) FILTER (i > 1), 4), 0.0) AS rate FROM steps GROUP BY doc_id),
    dist AS (SELECT doc_id, round(round(avg(round(1 - s, 4)), 9), 4) AS mean, list_sort(list(round(1 - s, 4))) AS ds FROM sims GROUP BY doc_id),
    stats AS (SELECT p.doc_id, block_count, avg_block_tokens,
        CAST(sizes[1 + CAST(round_even((block_count - 1) * 0.5, 0) AS BIGINT)] AS DOUBLE) AS median_block_tokens,
        CAST(sizes[1 + CAST(round_even((block_count - 1) * 0.75, 0) AS BIGINT)] AS DOUBLE) AS p75_block_tokens,
        short_block_rate, under_half_target_rate, 0.0::DOUBLE AS protected_block_rate, rate AS title_transition_rate, rate AS top_title_transition_rate,
        coalesce(mean, 0.0) AS avg_adjacent_distance,
        coalesce(ds[1 + CAST(round_even((len(ds) - 1) * 0.75, 0) AS BIGINT)], 0.0) AS p75_adjacent_distance
      FROM per p JOIN moves m USING (doc_id) LEFT JOIN dist d USING (doc_id)),
    full_stats AS (SELECT *, round(greatest(0.0, 1.0 - avg_adjacent_distance), 4) AS continuity,
        round(round(least(1.0, 0.30 * short_block_rate + 0.22 * under_half_target_rate + 0.20 * least(1.0, block_count / 80)
              + 0.18 * round(greatest(0.0, 1.0 - avg_adjacent_distance), 4)), 9), 4) AS context_need,
        round(round(least(1.0, 0.60 * title_transition_rate + 0.24 * avg_adjacent_distance + 0.10 * p75_adjacent_distance), 9), 4) AS structure_need FROM stats)"""
_UNITS = rf"""
    turns AS (SELECT 'c' || conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block, {S.normalize('text')} AS norm
              FROM conversations WHERE {S.normalize('text')} <> ''),
    cut AS (SELECT doc_id, block, list_filter(list_transform(string_split(regexp_replace(norm, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS s FROM turns),
    units AS (SELECT doc_id, block, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS sentence FROM cut),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, sentence) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM units),
    tf AS (SELECT doc_id, place, term, count(*) AS tf FROM (SELECT doc_id, place, unnest(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\-'']*'), lambda t: regexp_replace(t, '[-'']+$', ''))) AS term FROM placed)
           WHERE regexp_matches(term, '^[a-z][a-z0-9_\-'']+$') AND term NOT IN ({", ".join(f"'{w}'" for w in tfidf.STOP)}) GROUP BY ALL),
    df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
    raw AS (SELECT tf.doc_id, tf.place, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (doc_id, term)
            JOIN (SELECT DISTINCT doc_id, n FROM placed) USING (doc_id)),
    weighted AS (SELECT doc_id, place, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, place)) AS w FROM raw),
    near AS (SELECT a.doc_id, a.place, sum(a.w * b.w) AS s FROM weighted a JOIN weighted b ON a.doc_id = b.doc_id AND a.term = b.term AND b.place = a.place + 1 GROUP BY ALL),
    distances AS (SELECT p.doc_id, p.place, 1.0 - coalesce(s, 0.0) AS distance FROM placed p LEFT JOIN near USING (doc_id, place) WHERE p.place < p.n)"""
_AVG = "round(round(avg({}), 9), 4)"
SQL = {
    "recursive_chunks": f"{C.RECURSIVE} SELECT {C.SLIM} FROM done",
    "semantic_chunks": f"{C.SEMANTIC} SELECT {C.SLIM} FROM done",
    "structure_chunks": f"{C.structure(C.DOCUMENT_SRC)} SELECT {C.SLIM} FROM merged",
    "structure_turn_chunks": f"{C.structure(C.TURN_SRC)} SELECT {C.SLIM} FROM merged",
    "structure_chunk_report": f"""{C.structure(C.TURN_SRC)} SELECT 'structure' AS strategy, count(*) AS chunks, sum(token_count)::BIGINT AS total_tokens,
        round(avg(token_count), 2) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens FROM merged""",
    "boundary_summary": f"""{C.structure(C.TURN_SRC)} SELECT 'structure' AS strategy, count(d) AS scored, round(count(d) / count(*), 4) AS coverage, {_AVG.format('d.score')} AS avg_score,
        round(max(d.score), 4) AS max_score, {_AVG.format('d.distance')} AS avg_distance, {_AVG.format('d.similarity')} AS avg_similarity, count(*) FILTER (d.triggered) AS semantic_triggered FROM merged""",
    "boundary_reasons": f"{C.structure(C.DOCUMENT_SRC)} SELECT 'structure' AS strategy, d.reason AS reason, count(*) AS n FROM merged WHERE d IS NOT NULL GROUP BY ALL",
    "content_blocks": f"WITH {views.LINES_SQL} SELECT {_BLOCK_ID} AS block_id, type, size AS tokens, len(string_split(norm, ' ')) AS words FROM lines",
    "block_types": f"WITH {views.LINES_SQL} SELECT type, count(*) AS n FROM lines GROUP BY type",
    "block_text_titled": f"""WITH {views.LINES_SQL} SELECT {_BLOCK_ID} AS block_id,
        md5(CASE WHEN contains(lower(left(norm, 120)), lower(source)) THEN norm ELSE '[' || source || '] ' || norm END) AS digest FROM lines""",
    "page_blocks": f"""
      SELECT page_id, pos, type, text FROM (
        SELECT page_id, pos, CASE tag WHEN 'title' THEN 'title' WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'list' ELSE 'paragraph' END AS type,
               {S.normalize("regexp_replace(m, '^<[a-z0-9]+>', '')")} AS text
        FROM (SELECT page_id, pos, m, regexp_extract(m, '^<([a-z0-9]+)>', 1) AS tag FROM (
          SELECT page_id, unnest(f) AS m, generate_subscripts(f, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<(title|h1|p|li)>([^<]*)') AS f FROM pages))))
      WHERE text <> ''""",
    "fixed_chunks": f"WITH RECURSIVE {views.FIXED_SQL} SELECT {_CHUNK_ID} AS chunk_id, token_count, len(ords) AS n_blocks, md5(text) AS digest FROM chunks",
    "fixed_chunk_report": f"""WITH RECURSIVE {views.FIXED_SQL} SELECT 'fixed' AS strategy, count(*) AS chunks, sum(token_count)::BIGINT AS total_tokens,
        round(avg(token_count), 2) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens FROM chunks""",
    "flag_histogram": f"""WITH RECURSIVE {views.FIXED_SQL}, flags AS (SELECT unnest(list_concat([{_FLAG}, 'source_anchor_complete', 'title_path_consistent', 'fixed_window_baseline'],
        list_concat(CASE WHEN has_table THEN ['protected_block_intact'] ELSE [] END, CASE WHEN cut THEN ['split_long_block'] ELSE [] END))) AS flag FROM chunks)
        SELECT 'fixed' AS strategy, flag, count(*) AS n FROM flags GROUP BY flag""",
    "source_anchor": f"""WITH RECURSIVE {views.FIXED_SQL} SELECT {_CHUNK_ID} AS chunk_id, format('{{}}_b{{:05d}}', doc_id, ords[1]) AS first_block,
        format('{{}}_b{{:05d}}', doc_id, ords[-1]) AS last_block, len(ords) AS n_blocks, source AS sections, source AS title FROM chunks""",
    "boundary_stats": f"WITH {_STATS} SELECT * FROM full_stats",
    "adaptive_profile": f"""WITH {_STATS},
      chosen AS (SELECT doc_id, CASE
          WHEN (structure_need >= 0.62 OR top_title_transition_rate >= 0.20 OR (title_transition_rate >= 0.42 AND avg_adjacent_distance >= 0.58))
               AND round(context_need - structure_need, 4) < 0.24 THEN 'structure_preserving'
          WHEN avg_block_tokens <= 512 * 0.45 AND round(context_need - structure_need, 4) >= 0.34 AND structure_need < 0.54 THEN 'high_context_coverage'
          WHEN round(context_need - structure_need, 4) >= 0.18 AND structure_need < 0.62 THEN 'context_coverage' ELSE 'balanced' END AS profile FROM full_stats)
      SELECT doc_id, profile, strength AS boundary_strength, target, hard::DOUBLE AS hard_threshold, soft::DOUBLE AS soft_threshold, far::DOUBLE AS distance_threshold FROM chosen JOIN
        (VALUES ('structure_preserving', 'strong', 512, 0.60, 0.50, 0.70), ('high_context_coverage', 'loose', 716, 0.86, 0.76, 0.92),
                ('context_coverage', 'relaxed', 640, 0.76, 0.66, 0.84), ('balanced', 'standard', 512, 0.62, 0.52, 0.72)) t(profile, strength, target, hard, soft, far) USING (profile)""",
    "adjacent_similarity": f"WITH {_TURNS} SELECT doc_id, i, s AS similarity FROM sims",
    "sentence_tfidf": f"WITH {_UNITS} SELECT w.doc_id, block, sentence, term, round(w, 6) AS w FROM weighted w JOIN placed p USING (doc_id, place)",
    "adjacent_tfidf_distance": f"WITH {_UNITS} SELECT doc_id, place, round(distance, 6) AS distance FROM distances",
    "breakpoints_p75": f"""WITH {_UNITS}, lim AS (SELECT doc_id, quantile_cont(round(distance, 9), 0.75) AS lim FROM distances GROUP BY doc_id),
      worded AS (SELECT DISTINCT doc_id FROM tf)
      SELECT p.doc_id, count(*) FILTER (n >= 3 AND w.doc_id IS NOT NULL AND round(distance, 9) >= lim) AS breaks, count(*) AS units
      FROM placed p LEFT JOIN distances d USING (doc_id, place) LEFT JOIN lim ON lim.doc_id = p.doc_id LEFT JOIN worded w ON w.doc_id = p.doc_id GROUP BY p.doc_id""",
}
