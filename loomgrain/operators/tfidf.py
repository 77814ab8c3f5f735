"""TF-IDF of a document's sentences and the distance of neighbours, as relational algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The token shape, and function words that say nothing about a sentence's subject.
RUN = r"([\p{L}\p{N}_][\p{L}\p{N}_\-']*)"
TOKEN = r"^[a-z][a-z0-9_\-']+$"
STOP = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do"
    " does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me"
    " more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them"
    " then there these they this those through to too under until up very was we were what when where which while who whom why will"
    " with would you your"
).split()


def terms(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unit, term, tf."""
    runs = F.regexp_extract_all(F.lower("text"), F.lit(RUN), F.lit(1))
    found = F.transform(runs, lambda t: F.regexp_replace(t, "[-']+$", ""))
    each = units.select(*keys, "unit", F.explode(F.filter(found, lambda t: t.rlike(TOKEN) & ~t.isin(STOP))).alias("term"))
    return each.groupBy(*keys, "unit", "term").agg(F.count("*").alias("tf"))


def weights(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unit, term, w: smooth idf ln((1+n)/(1+df))+1 within the document, rows of unit length."""
    tf = terms(units, keys)
    n = units.groupBy(*keys).agg(F.count("*").alias("n"))
    df = tf.groupBy(*keys, "term").agg(F.count("*").alias("df"))
    raw = tf.join(df, [*keys, "term"]).join(n, keys).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys, "unit")))
    return raw.withColumn("w", F.col("w") / norm).select(*keys, "unit", "term", "w")


def distances(units: DataFrame, keys: list[str]) -> DataFrame:
    """units with distance to the next unit (null at the end); 1 where either has no terms.

    Neighbours meet by an equi-join on (document, place, term), so only shared terms
    produce rows.
    """
    numbered = units.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("unit")))
    w = weights(numbered, keys).join(numbered.select(*keys, "unit", "place"), [*keys, "unit"])
    later = w.select(*keys, "term", (F.col("place") - 1).alias("place"), F.col("w").alias("v"))
    near = w.join(later, [*keys, "term", "place"]).groupBy(*keys, "place").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    size = F.count("*").over(Window.partitionBy(*keys))
    joined = numbered.withColumn("size", size).join(near, [*keys, "place"], "left")
    return joined.withColumn("distance", F.when(F.col("place") < F.col("size"), 1.0 - F.coalesce("s", F.lit(0.0)))).drop("s")


def breakpoints(units: DataFrame, keys: list[str], percentile: float = 75.0) -> DataFrame:
    """units with breaks: the distance to the next reaches the document's percentile (linear), given three units and any term."""
    d = distances(units, keys).withColumn("distance", F.round("distance", 9))
    limit = d.groupBy(*keys).agg(
        F.percentile("distance", percentile / 100).alias("limit"), F.min("distance").alias("least"), F.max("distance").alias("most")
    )
    joined = d.join(limit, keys)
    # Without any shared or own term every distance is 1: there is no vocabulary to speak of only if no unit has terms.
    has_terms = terms(units, keys).groupBy(*keys).agg(F.lit(True).alias("worded"))
    joined = joined.join(has_terms, keys, "left")
    holds = (F.col("size") >= 3) & F.coalesce("worded", F.lit(False)) & (F.col("distance") >= F.col("limit"))
    return joined.withColumn("breaks", F.coalesce(holds, F.lit(False))).drop("limit", "least", "most", "worded")
