"""Which documents contain a passage, and which of a document's blocks is a passage's evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import text as T
from loomgrain.operators import bm25
from loomgrain.session import written

_KEY = 5  # words that lead a passage to the documents that may hold it, at most
MOST_KEYS = 1_000_000  # of passages, that are broadcast
# The least score of a match, and the kinds of block that can be evidence.
LEAST = 0.18
EVIDENCE_TYPES = "abstract paragraph table figure caption".split()


def _key(words: Column, start: Column | int, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.xxhash64(size, F.array_join(F.slice(words, start, size), " "))


def _windows(words: Column, sizes: list[int]) -> Column:
    def hashes(held: Column) -> Column:
        n = F.size(held)
        return F.concat(*[_window(held, n, k) for k in sizes])

    return F.array_distinct(T.let(words, hashes))


def _window(held: Column, n: Column, size: int) -> Column:
    at = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: _key(held, i, size))


def _led(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's key with every passage's leading words that stand in it; a place is looked at where its first word leads some passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value
        sizes: dict[str, set[int]] = {}
        for key in keys:
            words = key.split(" ")
            sizes.setdefault(words[0], set()).add(len(words))
        for batch in batches:
            rows, found = [], []
            for row in range(batch.num_rows):
                words = (batch.column(1)[row].as_py() or "").split(" ")
                met = {" ".join(words[i : i + k]) for i in [i for i, w in enumerate(words) if w in sizes] for k in sizes[words[i]]} & keys
                rows += [row] * len(met)
                found += met
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], [batch.schema.names[0], "h"])

    return run


def containment(items: DataFrame, docs: DataFrame, item_key: str = "item_id", doc_key: str = "doc_id", most: int = MOST_KEYS) -> DataFrame:
    """item_key, doc_key where the document's normalised lower-cased text contains the item's.

    A passage's inner words are whole words wherever it stands: passages meet their
    documents on the hash of up to five of them, from the second on; only the documents'
    windows that some passage asks for survive the join. Passages of one or two words have
    no inner word; those, a stated set, are compared with every document. Up to MOST_KEYS
    leading words are broadcast and looked up in Arrow batches; more meet on their hashes.
    """
    i = items.select(item_key, T.normalize_for_match("text").alias("needle")).filter("needle <> ''").withColumn("w", F.split("needle", " "))
    i = i.withColumn("k", F.least(F.lit(_KEY), F.size("w") - 2))
    sizes = sorted(r.k for r in i.select("k").distinct().collect())  # at most seven values
    d = docs.select(doc_key, T.normalize_for_match("text").alias("hay"))
    parts = []
    if inner := [k for k in sizes if k > 0]:
        words = i.filter("k > 0").select(item_key, "needle", F.array_join(F.slice("w", 2, F.col("k")), " ").alias("h"))
        first = {r.h for r in words.select("h").distinct().limit(most + 1).collect()}
        if len(first) <= most:
            kind = d.schema[doc_key].dataType.simpleString()
            led, keys = words, d.select(doc_key, "hay").mapInArrow(_led(docs.sparkSession.sparkContext.broadcast(first)), f"`{doc_key}` {kind}, h string")
        else:
            led = i.filter("k > 0").select(item_key, "needle", _key(F.col("w"), 2, F.col("k")).alias("h"))
            keys = d.select(doc_key, F.explode(_windows(F.split("hay", " "), inner)).alias("h"))
        met = written(led.join(keys, "h").select(item_key, "needle", doc_key).distinct(), "met")  # where they are few, documents need no shuffle
        held = met.join(docs.select(doc_key, "text"), doc_key).withColumn("hay", T.normalize_for_match("text"))
        parts.append(held.filter(F.contains("hay", "needle")).select(item_key, doc_key))
    if len(inner) < len(sizes):
        parts.append(i.filter("k <= 0").join(d, F.contains("hay", "needle")).select(item_key, doc_key))
    if not parts:
        return i.join(d, F.lit(False)).select(item_key, doc_key)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def containing(items: DataFrame, docs: DataFrame, pairs: DataFrame, item_key: str = "item_id", doc_key: str = "doc_id") -> DataFrame:
    """containment() of the pairs (item_key, doc_key) that are given as possible; one without doc_key is compared with every document."""
    needles = items.select(item_key, T.normalize_for_match("text").alias("needle")).filter("needle <> ''")
    holds = F.contains(T.normalize_for_match("text"), F.col("needle"))
    some = bm25.bounded(written(pairs.filter(F.col(doc_key).isNotNull()).join(needles, item_key), "met"), MOST_KEYS)
    found = docs.select(doc_key, "text").join(some, doc_key).filter(holds).select(item_key, doc_key)
    rest = written(pairs.filter(F.col(doc_key).isNull()).select(item_key).join(needles, item_key), "short")
    if rest.isEmpty():
        return found
    return found.unionByName(docs.select(doc_key, "text").join(F.broadcast(rest), holds).select(item_key, doc_key))


def match(evidence: DataFrame, blocks: DataFrame, least: float = LEAST) -> DataFrame:
    """The best block of its document for each evidence, one row each: evidence (query_id, doc_id, place, text), blocks (doc_id, block_id, type, order, text).

    Only blocks of an evidence kind take part. Containment either way scores by length
    ratio, else word overlap decides; ties go to the earlier block. The method is that of
    the last block, in document order, that raised the score by containment, if any. Below
    least the evidence is unmatched and keeps its score; blank evidence is 'empty'.
    """
    e = evidence.select("query_id", "doc_id", "place", T.normalize_for_match("text").alias("e"))
    blocks = blocks.join(bm25.bounded(e.select("doc_id").distinct(), MOST_KEYS), "doc_id", "left_semi")  # before any text is looked at
    b = blocks.filter(F.col("type").isin(EVIDENCE_TYPES)).select("doc_id", "block_id", F.col("type").alias("block_type"), "order", T.normalize_for_match("text").alias("b"))
    le, lb = F.length("e"), F.length("b")
    words = lambda c: F.array_distinct(F.split(c, " "))
    shared = F.size(F.array_intersect("ew", "bw"))
    f1 = F.when(shared == 0, F.lit(0.0)).otherwise(2.0 * shared / (F.size("ew") + F.size("bw")))  # T.token_f1, the sets found once a text
    within, holds = F.contains("b", "e"), F.contains("e", "b")
    scored = e.filter("e <> ''").withColumn("ew", words("e")).join(b.filter("b <> ''").withColumn("bw", words("b")), "doc_id").withColumns(
        {
            "score": F.when(within, F.least(F.lit(1.0), 0.85 + le / lb)).when(holds, F.least(F.lit(0.95), 0.75 + lb / le)).otherwise(f1),
            "method": F.when(within, "substring").when(holds, "block_in_evidence"),
        }
    )
    walk = Window.partitionBy("query_id", "doc_id", "place").orderBy("order")
    raised = F.col("score") > F.coalesce(F.max("score").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    said = scored.withColumn("named", F.when(raised, F.col("method"))).withColumn("named", F.last("named", ignorenulls=True).over(walk))
    best = said.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "doc_id", "place").orderBy(F.desc("score"), "order"))).filter("r = 1")
    found = e.join(best.select("query_id", "doc_id", "place", "block_id", "block_type", "score", "named"), ["query_id", "doc_id", "place"], "left")
    score = F.coalesce("score", F.lit(0.0))
    matched = score >= least
    method = F.when(F.col("e") == "", "empty").when(~matched, "unmatched").otherwise(F.coalesce("named", F.lit("token_overlap")))
    return found.select(
        "query_id", "doc_id", "place", F.when(matched, F.col("block_id")).alias("block_id"), F.when(matched, F.round(score, 4)).otherwise(score).alias("score"),
        method.alias("method"), F.when(matched, F.col("block_type")).alias("block_type"),
    )


def conversion_stats(blocks: DataFrame, queries: DataFrame, matches: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row: documents, blocks, queries by answerability, evidence items, how many met a block and at what rate, and warnings."""
    rate = F.when(F.count("*") > 0, F.round(F.count("block_id") / F.count("*"), 6))
    parts = [
        blocks.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("blocks")),
        queries.agg(F.count("*").alias("queries"), F.count_if("is_unanswerable").alias("unanswerable_queries"), F.count_if(~F.col("is_unanswerable")).alias("answerable_queries")),
        matches.agg(F.count("*").alias("evidence_items"), F.count("block_id").alias("matched_evidence_items"), rate.alias("evidence_match_rate")),
    ]
    if warnings is not None:
        parts.append(warnings.agg(F.count("*").alias("warnings")))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))
    return out
