"""The driver's tables in the roles of the document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain import session
from loomgrain.functions import text as T
from loomgrain.plans import sqltext as S
from loomgrain.session import dealt as table


def line_blocks(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """documents as governed documents: a block for each line that is not blank, titled by its source; lines with two bars are tables.

    only: of the documents with these keys (doc_id), before any text is looked at.
    """
    docs = table(spark, sf, "documents") if only is None else session.table(spark, sf, "documents").join(only, "doc_id", "left_semi")
    each = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    bars = F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))
    return each.filter(T.normalize("text") != "").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.lit("documents").alias("dataset"),
        F.col("lang").alias("split"),
        F.col("doc_id").cast("string").alias("source_doc_id"),
        F.format_string("%d_b%05d", "doc_id", (F.col("at") + 1).cast("int")).alias("block_id"),
        F.when(bars >= 2, "table").otherwise("paragraph").alias("type"),
        "text",
        (F.col("at") + 1).alias("order"),
        F.array("source").alias("title_path"),
        F.col("source").alias("section_name"),
        F.lit(None).cast("string").alias("asset_file"),
        F.array().cast("array<string>").alias("entity_tags"),
    )


def turn_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as governed documents: a block for each turn, titled by its role, so titles do change."""
    turns = table(spark, sf, "conversations")
    return turns.select(
        F.format_string("c%d", "conv_id").alias("doc_id"),
        F.lit("conversations").alias("dataset"),
        F.lit("all").alias("split"),
        F.format_string("c%d", "conv_id").alias("source_doc_id"),
        F.format_string("c%d_b%05d", "conv_id", F.col("turn").cast("int")).alias("block_id"),
        F.lit("paragraph").alias("type"),
        "text",
        F.col("turn").cast("int").alias("order"),
        F.array("role").alias("title_path"),
        F.col("role").alias("section_name"),
        F.lit(None).cast("string").alias("asset_file"),
        F.array().cast("array<string>").alias("entity_tags"),
    )


LINES_SQL = f"""
    raw AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text,
                   generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents),
    lines AS (SELECT doc_id, source, lang, ord, text, {S.normalize('text')} AS norm,
                     CASE WHEN len(text) - len(replace(text, '|', '')) >= 2 THEN 'table' ELSE 'paragraph' END AS type,
                     {S.tokens('text')} AS size
              FROM raw WHERE {S.normalize('text')} <> '')"""

#: Fixed-window chunks of the lines: packing as a recursive walk, windows for lines over the target.
FIXED_SQL = f"""
    {LINES_SQL},
    seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM lines),
    walk AS (
      SELECT doc_id, i, 1 AS g, CASE WHEN size > 512 THEN 0 ELSE size END AS held, size <= 512 AS opened FROM seq WHERE i = 1
      UNION ALL
      SELECT s.doc_id, s.i,
             CASE WHEN s.size > 512 OR NOT w.opened OR w.held + s.size > 512 THEN w.g + 1 ELSE w.g END,
             CASE WHEN s.size > 512 THEN 0 WHEN NOT w.opened OR w.held + s.size > 512 THEN s.size ELSE w.held + s.size END,
             s.size <= 512
      FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
    grp AS (SELECT s.doc_id, s.lang, w.g, max(s.size) AS largest, string_agg(s.norm, ' ' ORDER BY s.ord) AS text,
                   list(s.ord ORDER BY s.ord) AS ords, bool_or(s.type = 'table') AS has_table, any_value(s.source) AS source
            FROM seq s JOIN walk w USING (doc_id, i) GROUP BY s.doc_id, s.lang, w.g),
    parts AS (SELECT doc_id, lang, source, g, ords, has_table, largest > 512 AS cut, unnest(p) AS text, generate_subscripts(p, 1) AS part
              FROM (SELECT *, CASE WHEN largest <= 512 THEN [text] ELSE
                      list_transform(range(0, greatest(0, CAST(ceil((len(string_split(text, ' ')) - 512) / 448) AS BIGINT)) + 1),
                        lambda k: array_to_string(list_slice(string_split(text, ' '), k * 448 + 1, k * 448 + 512), ' ')) END AS p FROM grp)),
    chunks AS (SELECT *, {S.tokens('text')} AS token_count,
                      row_number() OVER (PARTITION BY doc_id ORDER BY g, part) AS idx FROM parts)"""
