"""Queries that run the source adapters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrain.plans import views
from loomgrain.sources import adapters
from loomgrain.session import dealt as table


def markdown_blocks(spark, sf):
    """Every document's text read as Markdown."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return adapters.markdown_blocks(docs).select("block_id", "type", F.md5(F.col("text").cast("binary")).alias("digest"))


def fact_blocks(spark, sf):
    """Conversations as questions over contexts: a role is an article, its turns are the sentences."""
    turns = table(spark, sf, "conversations")
    roles = turns.groupBy("conv_id", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("sentences"))
    records = roles.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("role").alias("title"), "sentences"))).alias("context"))
    blocks = adapters.fact_blocks(records.withColumn("id", F.col("conv_id").cast("string")))
    return blocks.select("block_id", F.col("title_path")[0].alias("title"), F.md5(F.col("text").cast("binary")).alias("digest"))


QUERIES = {f.__name__: f for f in (markdown_blocks, fact_blocks)}
SQL = {
    # The tables hold no fences, headings or list marks, so a block is a run of table lines or of other lines between blank ones.
    "markdown_blocks": f"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
      kinds AS (SELECT doc_id, i, trim(line) AS line, CASE WHEN trim(line) = '' THEN 'blank' WHEN len(line) - len(replace(line, '|', '')) >= 2 THEN 'table'
        WHEN regexp_matches(trim(line), '^([-*+]|\\d+[.)])\\s+') THEN 'list' ELSE 'paragraph' END AS kind FROM raw),
      marked AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS fresh FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
      blocks AS (SELECT doc_id, run, kind, {views.S.normalize("string_agg(line, ' ' ORDER BY i)")} AS text FROM runs WHERE kind <> 'blank' GROUP BY ALL)
      SELECT format('{{}}_b{{:05d}}', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run)) AS block_id, kind AS type, md5(text) AS digest FROM blocks""",
    "fact_blocks": """WITH s AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS j, dense_rank() OVER (PARTITION BY conv_id ORDER BY role) AS i FROM conversations)
      SELECT format('{}_c{:02d}_s{:03d}', conv_id, i, j) AS block_id, role AS title, md5(text) AS digest FROM s WHERE trim(text) <> ''""",
}
