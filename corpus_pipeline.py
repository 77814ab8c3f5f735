"""Corpus pipeline: documents to clean, deduplicated, uncontaminated and tokenised documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Each works on all rows its predecessor kept:

1. language ID: documents whose language is rejected (no letter, or cross-entropy beyond
   the calibrated limit) go;
2. line dedup: lines that a source repeats on more than the boilerplate ratio of its
   documents are cut from the texts (but a document all of whose lines are repeated is
   left whole: its copies are the next stage's); every document stays (n_chars follows
   the text);
3. n-gram Jaccard join: of each class of near-duplicates the document with the least id
   stays, as one row, however often ids occur; rows without an id come last, and one
   stays only where no row of the class has an id;
4. benchmark decontamination: documents that hold a benchmark passage go;
5. BPE encoding and decoding: every document gets its token count and hashes.

Defined cases: null and empty texts have no language and go in stage 1; texts of any
length are whole in every stage; repeated rows of a class become one; columns beyond
those of documents, whatever their names, are not carried; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm import bpe, decontaminate, jaccard, langid, linededup
from loomgrain.session import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = langid.train(docs.filter(langid.fold("doc_id", 5) != 0))
    slim = docs.select(*COLUMNS)
    return langid.identify(slim, models).filter("NOT rejected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = linededup.dedup_lines(docs.select(*COLUMNS), min_pages=linededup.MIN_PAGES, keep_whole=True)
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that names its class stays. Rows that share an id, or have none, are told apart by their set's digest."""
    classes = written(jaccard.classified(docs), "classes")
    gone = classes.filter("component_id <> doc_id").select("doc_id").distinct()
    plain = docs.select(*COLUMNS)
    repeated = written(classes.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    rest = plain.join(gone, "doc_id", "left_anti")
    if repeated.isEmpty() and classes.filter("doc_id IS NULL").isEmpty():
        return rest.select(*COLUMNS)
    # An id that stands once is its row's key. Elsewhere (id, digest) is: of a class's, the least with an id stays, as its least row.
    odd = plain.filter("doc_id IS NULL").unionByName(plain.join(repeated, "doc_id", "left_semi").select(*COLUMNS))
    odd = written(jaccard.digested(odd), "odd")
    least = classes.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")).alias("m"))
    stay = least.select(F.col("m.doc_id").alias("_id"), F.col("m.digest").alias("_d"))
    kept = odd.join(stay, odd["doc_id"].eqNullSafe(stay["_id"]) & (odd["_digest"] == stay["_d"]), "left_semi")
    # Texts without words have no class: equal (id, text) rows become one.
    same = kept.unionByName(odd.filter("_digest IS NULL")).withColumn("_empty", F.when(F.col("_digest").isNull(), F.col("text")))
    one = same.groupBy("doc_id", "_digest", "_empty").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return rest.filter("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(one)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.flag(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    known = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.encode(docs.select(*COLUMNS), known, ids=False)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", uncontaminated),
    ("BPE encoding and decoding", tokens),
]

#: SQL expresses neither the language models nor the merges; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i + 1}")
    return docs
