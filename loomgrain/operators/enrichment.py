"""Chunk enrichment: the deterministic provider, the normaliser of any provider's raw answers, and question-answer rows.

A provider is a function from chunks to chunks with a column `answer`, the raw text of
its answer for each (null where it has none). What the answer holds in the expected form
replaces the deterministic values; the rest stays. A remote provider needs a network and
is not part of this.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.functions import text as T

PROVIDER = "deterministic"
# Tags that name no topic.
WEAK = "abstract|introduction|related work|paragraph|list|table|figure|caption|formula|code".split("|")


def _has(flag: str) -> Column:
    return F.array_contains("quality_flags", flag)


def _when(cond: Column, value: float) -> Column:
    return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))


def integrity() -> Column:
    raw = (
        4.6 + _when(_has("title_path_consistent"), 0.2) + _when(_has("section_boundary_respected"), 0.1) - _when(_has("mixed_title_paths"), 0.4)
        - _when(_has("short_chunk"), 0.3) - _when(_has("long_chunk"), 0.5)
    )
    return F.when(F.trim("text") == "", F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(5.0), raw)), 2))


def risk() -> Column:
    return F.when(~_has("source_anchor_complete"), "high").when(_has("long_chunk") | _has("mixed_title_paths"), "medium").otherwise("low")


def dedupe(values: Column, most: int) -> Column:
    """Trimmed, empties dropped, the first of each case-insensitive value kept, at most most."""
    trimmed = F.filter(F.transform(values, T.normalize), lambda v: v != "")

    def kept(held: Column) -> Column:
        lower = F.transform(held, F.lower)
        first = F.filter(F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1))), lambda i: F.array_position(lower, F.get(lower, i - 1)) == i)
        return F.transform(first, lambda i: F.get(held, i - 1))

    return F.slice(T.let(trimmed, kept), 1, most)


def clamp(value: Column, default: Column) -> Column:
    """A score in [0, 5] with two places; what does not parse becomes the default."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.coalesce(value.try_cast("double"), default))), 2)


def as_list(value: Column) -> Column:
    """A JSON value as a list of texts: a list's elements, or the parts of a text between commas; empties dropped."""
    listed = F.from_json(value, "array<string>")
    text = F.coalesce(F.get_json_object(F.concat(F.lit('{"x":'), value, F.lit("}")), "$.x"), F.lit(""))
    many = F.when(F.ltrim(value).startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.split(text, ","))
    return F.filter(F.transform(F.coalesce(many, F.array().cast("array<string>")), T.normalize), lambda x: x != "")


Provider = Callable[[DataFrame], DataFrame]
_PAIR = "struct<instruction:string,question:string,answer:string,answerability:string,faithfulness_score:string>"


def provided(chunks: DataFrame, provider: Provider, name: str, topic_tags: int = 8, entity_tags: int = 12) -> DataFrame:
    """chunks with enrichment by a provider's raw answers, normalised over the deterministic one."""
    return normalised(provider(enrich(chunks, topic_tags, entity_tags)), F.col("answer"), name, topic_tags, entity_tags).drop("answer")


def normalised(enriched: DataFrame, answer: Column, provider: str, topic_tags: int = 8, entity_tags: int = 12) -> DataFrame:
    """enrich() rows with what a raw answer holds: texts normalised, lists deduped and cut, scores clamped, an unknown risk or a missing value left as it was, at most three pairs."""
    rows = enriched.withColumn("_raw", extract_json(answer))
    old = F.col("enrichment")
    field = lambda n: F.get_json_object("_raw", f"$.{n}")
    text = lambda value, default: F.when(T.normalize(value) != "", T.normalize(value)).otherwise(default)

    def listed(name: str, default: Column, most: int) -> Column:
        found = F.when(F.ltrim(field(name)).startswith("["), as_list(field(name))).otherwise(F.filter(F.transform(F.split(field(name), ","), T.normalize), lambda x: x != ""))
        return F.when(field(name).isNotNull(), dedupe(F.coalesce(found, F.array().cast("array<string>")), most)).otherwise(default)

    def pair(p: Column) -> Column:
        known = p["answerability"].isin("answerable", "unanswerable")
        return F.struct(
            text(p["instruction"], F.lit("Answer using only the provided chunk.")).alias("instruction"), T.normalize(p["question"]).alias("question"), T.normalize(p["answer"]).alias("answer"),
            F.when(known, p["answerability"]).when(F.coalesce(p["answer"], F.lit("")) != "", "answerable").otherwise("unanswerable").alias("answerability"),
            clamp(p["faithfulness_score"], F.lit(4.5)).alias("faithfulness_score"), F.slice("source_blocks", 1, 5).alias("evidence_source_blocks"),
        )

    pairs = F.transform(F.slice(F.from_json(field("qa_pairs"), f"array<{_PAIR}>"), 1, 3), pair)
    score = lambda n, default: clamp(F.coalesce(field(n), F.lit("")), default)
    risk_found = F.when(field("faithfulness_risk").isin("low", "medium", "high"), field("faithfulness_risk")).otherwise(old["risk"])
    made = F.struct(
        F.lit(provider).alias("provider"), text(field("summary"), old["summary"]).alias("summary"), listed("topic_tags", old["topic_tags"], topic_tags).alias("topic_tags"),
        listed("entity_tags", old["entity_tags"], entity_tags).alias("entity_tags"), score("semantic_integrity_score", old["integrity"]).alias("integrity"),
        score("summary_faithfulness_score", old["faithfulness"]).alias("faithfulness"), score("tag_accuracy_score", old["tag_accuracy"]).alias("tag_accuracy"),
        risk_found.alias("risk"), F.when(field("qa_pairs").isNotNull(), F.coalesce(pairs, F.slice(old["qa_pairs"], 1, 0))).otherwise(old["qa_pairs"]).alias("qa_pairs"),
    )
    return rows.withColumn("enrichment", F.when(F.col("_raw").isNull(), old).otherwise(made)).drop("_raw")


def enrich(chunks: DataFrame, topic_tags: int = 8, entity_tags: int = 12) -> DataFrame:
    """chunks with enrichment (struct) by the deterministic provider."""
    summary = T.normalize(F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(T.summary("text", 60)))
    topics = dedupe(F.concat("title_path", "tags"), topic_tags)
    rows = chunks.withColumns({"_summary": summary, "_topics": topics})
    strong = F.filter("_topics", lambda t: ~F.lower(t).isin(WEAK))
    topic = F.coalesce(F.get(strong, F.lit(0)), F.when(F.size("title_path") > 0, F.element_at("title_path", -1)), F.lit("the chunk content"))
    faithful = F.when(F.col("_summary") != "", 4.7).otherwise(4.0)
    qa = F.struct(
        F.lit("Answer the question using only the provided chunk.").alias("instruction"),
        F.concat(F.lit("According to the chunk, what is the main point about "), topic, F.lit("?")).alias("question"),
        F.col("_summary").alias("answer"),
        F.when(F.col("_summary") != "", "answerable").otherwise("unanswerable").alias("answerability"),
        faithful.alias("faithfulness_score"),
        F.slice("source_blocks", 1, 5).alias("evidence_source_blocks"),
    )
    return rows.withColumn(
        "enrichment",
        F.struct(
            F.lit(PROVIDER).alias("provider"), F.col("_summary").alias("summary"), F.col("_topics").alias("topic_tags"),
            dedupe(F.col("entity_tags"), entity_tags).alias("entity_tags"), integrity().alias("integrity"), faithful.alias("faithfulness"),
            F.when(F.size("_topics") > 0, 4.5).otherwise(3.8).alias("tag_accuracy"), risk().alias("risk"), F.array(qa).alias("qa_pairs"),
        ),
    ).drop("_summary", "_topics")


def qa_rows(enriched: DataFrame) -> DataFrame:
    each = enriched.select("chunk_id", "doc_id", "dataset", "split", F.posexplode("enrichment.qa_pairs").alias("i", "qa"))
    return each.select(F.format_string("%s_qa_%02d", "chunk_id", F.col("i") + 1).alias("qa_id"), "chunk_id", "doc_id", "dataset", "split", "qa.*")


def report(enriched: DataFrame) -> DataFrame:
    """risk, provider, chunks and mean scores (four places)."""
    e = lambda c: F.col(f"enrichment.{c}")
    return enriched.groupBy(e("risk").alias("risk"), e("provider").alias("provider")).agg(
        F.count("*").alias("chunks"), *(F.round(F.avg(e(c)), 4).alias(f"avg_{c}") for c in ("integrity", "faithfulness", "tag_accuracy"))
    )


def extract_json(answer: Column) -> Column:
    """The JSON object in a model's answer: inside a fence, or from the first brace to the last."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare)
