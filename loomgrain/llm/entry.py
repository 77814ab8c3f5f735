"""The queries of this subpackage by name, and the DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm import ann, bpe, decontaminate, html, jaccard, langid, licenses, linededup, quality, sharding
from loomgrain.session import table, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    found = licenses.scan(table(spark, sf, "documents").select("doc_id", "text"))
    return found.drop("text", "places")


def op2_html(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf, "pages").select("page_id", "url", "html")).drop("html")


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's quality, learned outside the held-out quarter."""
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", (langid.fold("doc_id", 4) == 2).alias("held_out"), "text")
    featured = written(quality.features(rows), "quality-features")
    model = quality.train(featured.filter("NOT held_out"), table(spark, sf, "labels"))
    return quality.score(featured, model)


def op4_ann(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest other vectors of every vector whose id is divisible by 20."""
    rows = table(spark, sf, "embeddings")
    return ann.search(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)


def op5_langid(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's language, learned outside the held-out fifth."""
    docs = table(spark, sf, "documents")
    models = langid.train(docs.filter(langid.fold("doc_id", 5) != 0))
    rows = docs.select("doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "text")
    return langid.identify(rows, models).drop("text")


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their source as the host; a ratio of fewer than MIN_PAGES pages says nothing."""
    found = linededup.dedup_lines(table(spark, sf, "documents"), min_pages=linededup.MIN_PAGES)
    return found.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's class under links of similarity 0.75 or more over 5-word shingles, and its number of links."""
    return jaccard.similar_links(table(spark, sf, "documents"))


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids and round trip under the public 50k byte-level vocabulary."""
    import public_tokenizers

    known = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.json"))
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.encode(rows, known, ids=False).drop("text")


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents into 16 shards of nearly equal bytes."""
    found = sharding.shard(table(spark, sf, "documents").select("doc_id", "text"), carry=["doc_id"])
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each contaminated document and the item it holds."""
    rows = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.flag(rows, table(spark, sf, "benchmark")).drop("text")
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


LINE_SQL = f"""
WITH host AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
cells AS (SELECT d.doc_id, d.source, unnest(string_split(d.text, chr(10))) AS line,
                 generate_subscripts(string_split(d.text, chr(10)), 1) AS pos FROM documents d),
freq AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM cells WHERE trim(line) <> '' GROUP BY source, line),
bad AS (SELECT f.source, f.line FROM freq f JOIN host h ON f.source IS NOT DISTINCT FROM h.source
        WHERE n >= {linededup.MIN_PAGES} AND n > pages * {linededup.RATIO}),
marked AS (SELECT c.*, trim(c.line) <> '' AS is_full, b.line IS NOT NULL AS is_bad
           FROM cells c LEFT JOIN bad b ON b.source IS NOT DISTINCT FROM c.source AND b.line = c.line),
docs AS (SELECT doc_id, count(*) FILTER (is_full) AS n_lines, count(*) FILTER (is_bad) AS n_bad,
                string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_bad) AS cut FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(x.n_lines, 0) AS n_lines,
       coalesce(x.n_bad, 0) AS n_dropped,
       CASE WHEN coalesce(x.n_bad, 0) = 0 THEN d.text ELSE coalesce(x.cut, '') END AS text
FROM documents d LEFT JOIN docs x ON x.doc_id = d.doc_id
"""

_QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_html": op2_html,
    "op3_quality": op3_quality,
    "op4_ann": op4_ann,
    "op5_langid": op5_langid,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_bpe": op8_bpe,
    "op9_sharding": op9_sharding,
    "op10_decontaminate": op10_decontaminate,
}
_SQL: dict[str, str] = {"op6_line_dedup": LINE_SQL}  # of the others, no exact form in SQL: tests hold them to brute force


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
