"""BM25 as relational algebra: postings, corpus statistics and a term equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import text as T
from loomgrain.session import written

K1, B = 1.5, 0.75
EMPTY_TOKEN = "__empty__"
MOST_TERMS = 1_000_000  # of queries, that are broadcast


def tokenised(corpus: DataFrame, key: str, text: str = "text", profile: str = "mixed") -> DataFrame:
    """key, tokens: an empty token list holds one placeholder, which counts in the average length."""
    found = T.with_tokens(corpus.select(key, F.col(text).alias("text")), profile)
    return found.select(key, F.when(F.size("tokens") == 0, F.array(F.lit(EMPTY_TOKEN))).otherwise(F.col("tokens")).alias("tokens"))


def counted(queries: DataFrame, qkey: str) -> DataFrame:
    """qkey, term, qtf from (qkey, tokens)."""
    return queries.select(qkey, F.explode("tokens").alias("term")).groupBy(qkey, "term").agg(F.count("*").alias("qtf"))


def postings(docs: DataFrame, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """key, term, tf, dl; of the wanted terms only, if given, and then so before anything is shuffled."""
    terms = docs.select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if wanted is not None:
        terms = terms.join(bounded(wanted, MOST_TERMS), "term", "left_semi")
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """rows to be broadcast where they are at most most; beyond that Spark's own choice."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avgdl"))


def posting_stats(found: DataFrame, key: str) -> DataFrame:
    """corpus_stats from all postings."""
    return found.agg(F.countDistinct(key).alias("n_docs"), F.sum("tf").alias("t")).select("n_docs", (F.col("t") / F.col("n_docs")).alias("avgdl"))


def idf(df: DataFrame, variant: str) -> DataFrame:
    """df has term, df, n_docs. 'plus_one' is never negative; 'okapi' floors negatives at a quarter of the mean."""
    n, d = F.col("n_docs"), F.col("df")
    if variant == "plus_one":
        return df.withColumn("idf", F.log(1 + (n - d + 0.5) / (d + 0.5)))
    if variant != "okapi":
        raise ValueError(f"unknown idf variant {variant!r}")
    raw = df.withColumn("idf", F.log(n - d + 0.5) - F.log(d + 0.5))
    mean = raw.agg((F.avg("idf") * 0.25).alias("floor"))
    return raw.join(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")))


def scores(queries: DataFrame, docs: DataFrame, qkey: str, dkey: str, variant: str = "plus_one") -> DataFrame:
    """qkey, dkey, score for every pair that shares a term.

    queries has qkey and tokens, docs has dkey and tokens. A term that occurs twice in a
    query counts twice. Only the queries' terms are shuffled, and
    their postings are written, as the terms' counts need them too; under 'okapi' the terms'
    counts are taken over all postings first, as its floor is a mean over all terms.
    Statistics stay global whatever scope is filtered later.
    """
    asked = counted(queries, qkey)
    wanted = asked.select("term").distinct()
    if variant == "okapi":
        terms = docs.select(F.explode(F.array_distinct("tokens")).alias("term"))
        df = terms.groupBy("term").agg(F.count("*").alias("df"))
        held = written(postings(docs, dkey, wanted), "postings")
    else:
        held = written(postings(docs, dkey, wanted), "postings")
        df = held.groupBy("term").agg(F.count("*").alias("df"))
    return weighed(asked, held, idf(df.join(F.broadcast(corpus_stats(docs))), variant), qkey, dkey)


def posting_scores(asked: DataFrame, found: DataFrame, qkey: str, dkey: str, variant: str = "plus_one") -> DataFrame:
    """scores from written postings of a whole corpus; asked is counted()."""
    held = found.join(bounded(asked.select("term").distinct(), MOST_TERMS), "term", "left_semi")
    counts = found if variant == "okapi" else held  # okapi's floor is a mean over all terms
    df = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(posting_stats(found, dkey)))
    return weighed(asked, held, idf(df, variant), qkey, dkey)


def weighed(asked: DataFrame, held: DataFrame, df: DataFrame, qkey: str, dkey: str) -> DataFrame:
    hits = asked.join(df.select("term", "idf", "avgdl"), "term").join(held, "term")
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return hits.groupBy(qkey, dkey).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, qkey: str, dkey: str, k: int, places: int = 6) -> DataFrame:
    """Rank by score rounded to the given places, ties to the smaller document key."""
    order = Window.partitionBy(qkey).orderBy(F.desc("score"), F.asc(dkey))
    rounded = scored.withColumn("score", F.round("score", places))
    return rounded.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def top_k_of_all(scored: DataFrame, asked: DataFrame, candidates: DataFrame, qkey: str, dkey: str, k: int, places: int = 6) -> DataFrame:
    """top_k over all candidates: one that shares no term with a query has score 0 and its place by key.

    asked: the queries (qkey) that have a token; one without any has no hits. Only queries
    with fewer than k positive hits need other candidates, and of those the first by key.
    """
    best = written(top_k(scored.select(qkey, dkey, "score"), qkey, dkey, k, places), "top")
    positive = best.groupBy(qkey).agg(F.count_if(F.col("score") > 0).alias("m"))
    short = asked.select(qkey).distinct().join(positive, qkey, "left").filter(F.coalesce("m", F.lit(0)) < k).select(qkey)
    if short.isEmpty():
        return best
    held = scored.select(qkey, dkey, F.round("score", places).alias("score")).join(F.broadcast(short), qkey, "left_semi")
    most = held.groupBy(qkey).count().agg(F.max("count")).first()[0] or 0
    first = candidates.select(dkey).orderBy(dkey).limit(k + most)
    zeros = short.join(F.broadcast(first)).join(held, [qkey, dkey], "left_anti").withColumn("score", F.lit(0.0))
    more = top_k(held.unionByName(zeros), qkey, dkey, k, places)
    return best.join(F.broadcast(short), qkey, "left_anti").select(qkey, dkey, "score", "rank").unionByName(more.select(qkey, dkey, "score", "rank"))
