"""Retrieval evaluation as aggregates over ranked hits: recall, hit, full recall, reciprocal rank, nDCG, deltas, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.operators import bm25
from loomgrain.session import written

KS = (1, 3, 5)


def check_ks(ks) -> list[int]:
    """Sorted unique positive cut-offs; anything else is an error."""
    found = sorted({int(k) for k in ks})
    if not found or found[0] <= 0:
        raise ValueError("cut-offs must be positive integers")
    return found


def answerable(queries: DataFrame) -> DataFrame:
    """Queries with an answer and gold blocks."""
    return queries.filter(~F.coalesce("is_unanswerable", F.lit(False)) & (F.coalesce(F.size("gold"), F.lit(0)) > 0))


def skip_reasons(queries: DataFrame) -> DataFrame:
    """One row: how many queries are unanswerable, how many of the others lack gold."""
    no = F.coalesce("is_unanswerable", F.lit(False))
    return queries.agg(F.count_if(no).alias("unanswerable"), F.count_if(~no & (F.coalesce(F.size("gold"), F.lit(0)) <= 0)).alias("no_gold"))


def judged(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """hits (strategy, retriever, query_id, rank, blocks) with the gold blocks each covers.

    gold has query_id and block_id, one row each; hits meet it block by block on an
    equi-join, so a hit's row does not grow with the gold set.
    """
    each = hits.select("strategy", "retriever", "query_id", "rank", F.explode("blocks").alias("block_id"))
    met = each.join(gold, ["query_id", "block_id"]).groupBy("strategy", "retriever", "query_id", "rank").agg(F.collect_set("block_id").alias("covered"))
    return hits.drop("blocks").join(met, ["strategy", "retriever", "query_id", "rank"], "left").withColumn("relevant", F.coalesce(F.size("covered") > 0, F.lit(False)))


def per_query(hits: DataFrame, gold: DataFrame, ks=KS, ndcg_k: int = 5) -> DataFrame:
    """One row for each strategy, retriever and query that has hits."""
    ks = check_ks(ks)
    j = judged(hits, gold)
    size = gold.groupBy("query_id").agg(F.countDistinct("block_id").alias("gold_size"))
    rank, rel = F.col("rank"), F.col("relevant")
    covered = {k: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(rank <= k, F.col("covered")))))) for k in ks}
    gains = F.sum(F.when(rel & (rank <= ndcg_k), 1.0 / F.log2(rank + 1.0)).otherwise(0.0))
    rows = j.groupBy("strategy", "retriever", "query_id").agg(
        F.coalesce(F.min(F.when(rel, rank)), F.lit(0)).cast("long").alias("first_relevant_rank"),
        F.count_if(rel).alias("n_relevant"),
        gains.alias("dcg"),
        *(c.cast("long").alias(f"covered_{k}") for k, c in covered.items()),
    )
    return measures(rows.join(size, "query_id"), ks, ndcg_k)


def relevant_units(units: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, unit, covered: the units (unit, blocks) that hold some of a query's gold blocks, and which."""
    each = units.select("unit", F.explode("blocks").alias("block_id"))
    return each.join(gold.distinct(), "block_id").groupBy("query_id", "unit").agg(F.collect_set("block_id").alias("covered"))


def full_ranking(scored: DataFrame, asked: DataFrame, units: DataFrame, gold: DataFrame, ks=KS, ndcg_k: int = 5, relevant: DataFrame | None = None) -> DataFrame:
    """One row for each query that has gold, over the whole ranking of all units.

    scored: query_id, unit, score of the pairs that share a term; every other unit has score
    0, ties go to the smaller unit, and a query without tokens (not in asked) has no hits.
    relevant may be given as written relevant_units(), where several rankings share it.
    The first relevant rank is found by counting the units ahead of the best relevant one,
    so nothing is sorted but the few hits that the cut-offs ask for.
    """
    ks = check_ks(ks)
    scored = written(scored.select("query_id", "unit", F.round("score", 6).alias("score")), "scored")
    relevant = written(relevant_units(units, gold), "relevant") if relevant is None else relevant
    held = relevant.join(scored, ["query_id", "unit"], "left").join(asked.select("query_id").distinct(), "query_id")
    place = F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), (-F.col("unit")).alias("u"))
    best = held.groupBy("query_id").agg(F.max(place).alias("b")).select("query_id", F.col("b.s").alias("s"), (-F.col("b.u")).alias("u"))
    best = written(best, "best")
    higher, before = F.col("score") > F.col("s"), F.col("unit") < F.col("u")
    ahead = scored.join(best, "query_id").groupBy("query_id").agg(
        F.count_if(higher | ((F.col("score") == F.col("s")) & before)).alias("ahead"), F.count("*").alias("matched"), F.count_if(before).alias("matched_before")
    )
    # Only where the best relevant unit has no positive score do units without a score stand before it.
    low = best.filter("s <= 0")
    if low.isEmpty():
        zeros = low.select("query_id", F.lit(0).cast("long").alias("units_before"), F.lit(0).cast("long").alias("units"))
    else:
        zeros = units.select("unit").join(F.broadcast(low)).groupBy("query_id").agg(F.count_if(before).alias("units_before"), F.count("*").alias("units"))
    none = F.lit(0).cast("long")
    count = lambda c: F.coalesce(c, none)
    unscored = (
        F.when(F.col("s") > 0, none).when(F.col("s") < 0, count("units") - count("matched")).otherwise(count("units_before") - count("matched_before"))
    )
    first = best.join(ahead, "query_id", "left").join(zeros, "query_id", "left").select("query_id", (1 + count("ahead") + unscored).alias("first_relevant_rank"))
    top = bm25.top_k_of_all(scored, asked, units, "query_id", "unit", max(*ks, ndcg_k))
    return judged_ranking(first, top, relevant, gold, ks, ndcg_k)


def judged_ranking(first: DataFrame, top: DataFrame, relevant: DataFrame, gold: DataFrame, ks=KS, ndcg_k: int = 5) -> DataFrame:
    """full_ranking's rows from query_id, first_relevant_rank and the best hits (query_id, unit, rank) of all units."""
    ks = check_ks(ks)
    top = top.join(relevant, ["query_id", "unit"])
    gains = top.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= ndcg_k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.count_if(F.col("rank") <= ks[-1]).alias("relevant_hits"),
        *(F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= k, F.col("covered")))))).cast("long").alias(f"covered_{k}") for k in ks),
    )
    size = gold.groupBy("query_id").agg(F.countDistinct("block_id").alias("gold_size"))
    number = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    rows = size.join(first, "query_id", "left").join(number, "query_id", "left").join(gains, "query_id", "left").na.fill(0)
    return measures(rows, ks, ndcg_k)


def measures(rows: DataFrame, ks: list[int], ndcg_k: int) -> DataFrame:
    """The measures of each query from its first relevant rank, dcg, number of relevant units, gold size and covered gold by cut-off."""
    first = F.col("first_relevant_rank")
    ideal = F.aggregate(
        F.when(F.col("n_relevant") > 0, F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(ndcg_k)).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda a, i: a + 1.0 / F.log2(i + 1.0),
    )
    names = [c for c in ("strategy", "retriever") if c in rows.columns]
    recall = lambda k: F.col(f"covered_{k}") / F.col("gold_size")
    return rows.select(
        *names, "query_id", "first_relevant_rank",
        F.when(first > 0, 1.0 / first).otherwise(0.0).alias("reciprocal_rank"),
        F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        *(recall(k).alias(f"recall_{k}") for k in ks),
        *((F.col(f"covered_{k}") > 0).cast("int").alias(f"hit_{k}") for k in ks),
        *((F.col(f"covered_{k}") == F.col("gold_size")).cast("int").alias(f"full_{k}") for k in ks),
        "gold_size", (F.col("gold_size") - F.col(f"covered_{ks[-1]}")).alias("missing_gold"), *(["relevant_hits"] if "relevant_hits" in rows.columns else []),
    )


def summary(rows: DataFrame, ks=KS) -> DataFrame:
    """Means over queries by strategy and retriever, six places."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return rows.groupBy("strategy", "retriever").agg(
        F.count("*").alias("queries"), mean("reciprocal_rank", "mrr"), mean("ndcg", "ndcg_5"),
        *(mean(f"{m}_{k}", f"{m}_{k}") for m in ("recall", "hit", "full") for k in check_ks(ks)),
    )


def metric_rows(metrics: DataFrame, sizes: DataFrame, scope: str = "global", fields: tuple[str, ...] = ("text",), skipped: DataFrame | None = None, retriever: str | None = None) -> DataFrame:
    """metrics with each strategy's number of chunks, the search scope, the index fields and (from skip_reasons) why queries were left out; of one retriever if asked."""
    rows = metrics.join(sizes, "strategy", "left").withColumns({"search_scope": F.lit(scope), "index_fields": F.lit(",".join(fields))})
    if skipped is not None:
        rows = rows.join(F.broadcast(skipped))
    return rows if retriever is None else rows.filter(F.col("retriever") == retriever)


def query_rows(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """One row for each retriever, query and strategy: the summary that a list of queries shows."""
    kept = rows.select("retriever", "query_id", "strategy", F.col("gold_size").alias("gold_blocks"), "first_relevant_rank", "reciprocal_rank", "recall_5", "hit_5", "missing_gold", "relevant_hits")
    return kept.join(cases.select("retriever", "query_id", "case_type"), ["retriever", "query_id"])


def comparison(hits: DataFrame, relevant: DataFrame, query_id: object | None = None) -> DataFrame:
    """The best hits side by side, with the gold blocks each covers; of one query if asked (no rows if it is unknown)."""
    met = hits.join(relevant, ["query_id", "unit"], "left")
    out = met.withColumns({"is_relevant": F.col("covered").isNotNull(), "covered": F.array_join(F.array_sort(F.coalesce("covered", F.array().cast("array<string>"))), ",")})
    return out if query_id is None else out.filter(F.col("query_id") == query_id)


METRICS = ("recall_1", "recall_3", "recall_5", "mrr", "ndcg_5")


def baseline_delta(metrics: DataFrame, baseline: str = "fixed") -> DataFrame:
    """Each other strategy's metrics less the baseline's, by retriever; relative in per cent, null where the base is 0."""
    base = metrics.filter(F.col("strategy") == baseline).select("retriever", *(F.col(m).alias(f"b_{m}") for m in METRICS))
    joined = metrics.filter(F.col("strategy") != baseline).join(base, "retriever")
    return joined.select(
        "strategy", "retriever",
        *(F.round(F.col(m) - F.col(f"b_{m}"), 6).alias(f"d_{m}") for m in METRICS),
        *(F.round(F.when(F.col(f"b_{m}") != 0, (F.col(m) - F.col(f"b_{m}")) / F.col(f"b_{m}") * 100), 2).alias(f"r_{m}") for m in METRICS),
    )


def best_by_metric(metrics: DataFrame, most: int = 5) -> DataFrame:
    """The best (strategy, retriever) pairs of each metric."""
    long = metrics.unpivot(["strategy", "retriever"], list(METRICS), "metric", "value")
    order = Window.partitionBy("metric").orderBy(F.desc("value"), "strategy", "retriever")
    return long.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most)


def case_types(rows: DataFrame, target: str, baseline: str, gold_sizes: DataFrame | None = None, top: int = 5) -> DataFrame:
    """query_id, case_type from per_query rows of one retriever; the first that holds: target absent, target misses gold, baseline first, recalls differ, ok."""
    r = F.col(f"recall_{top}")
    of = lambda s, c: F.max(F.when(F.col("strategy") == s, c))
    place = F.when(F.col("first_relevant_rank") > 0, F.col("first_relevant_rank")).otherwise(10_000)
    got = rows.groupBy("retriever", "query_id").agg(
        of(target, r).alias("own"), of(target, place).alias("own_rank"), of(baseline, place).alias("base_rank"), F.countDistinct(F.round(r, 9)).alias("kinds")
    )
    case = (
        F.when(F.col("own").isNull(), "target_absent")
        .when(F.col("own") < 1, "target_missing")
        .when(F.col("base_rank") < F.col("own_rank"), "baseline_beats_target")
        .when(F.col("kinds") > 1, "strategy_disagreement")
        .otherwise("target_ok")
    )
    return got.select("retriever", "query_id", F.round("own", 6).alias("recall"), case.alias("case_type"))


BAD = ("target_missing", "baseline_beats_target", "strategy_disagreement")


def bad_cases(cases: DataFrame) -> DataFrame:
    """Bad cases with their place: missing gold first, then lowest recall, then query."""
    order = Window.partitionBy("retriever").orderBy(F.when(F.col("case_type") == "target_missing", 0).otherwise(1), "recall", "query_id")
    return cases.filter(F.col("case_type").isin(*BAD)).withColumn("place", F.row_number().over(order).cast("long"))
