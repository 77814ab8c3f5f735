"""From groups of blocks to chunk rows: identity, counts, anchors, flags, tags and summaries, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.functions import text as T
from loomgrain.schemas import CONTENT_TYPES, PROTECTED_TYPES

HEADER = ["doc_id", "dataset", "split", "source_doc_id"]


def content_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of a content type with text that is not blank."""
    return blocks.filter(F.col("type").isin(CONTENT_TYPES) & (T.normalize("text") != ""))


def documents(blocks: DataFrame) -> DataFrame:
    """One row a document with its content blocks in order: the only shuffle of a chunking plan.

    Rows are dealt by doc_id alone, as a constant header column would keep later groups from using that order.
    """
    flat = F.struct(
        F.col("order"), "block_id", "type", T.normalize("text").alias("text"), F.coalesce("title_path", F.array().cast("array<string>")).alias("title_path"),
        "section_name", "asset_file", F.coalesce("entity_tags", F.array().cast("array<string>")).alias("entity_tags"),
    )
    return content_blocks(blocks).repartition("doc_id").groupBy(*HEADER).agg(F.array_sort(F.collect_list(flat)).alias("blocks"))


def length_flag(tokens: Column, low: Column, high: Column) -> Column:
    return F.when(tokens < low, "short_chunk").when(tokens > high, "long_chunk").otherwise("length_ok")


def title_flag(members: Column) -> Column:
    """title_path_consistent, mixed_title_paths or null."""
    paths = F.array_distinct(F.filter(F.transform(members, lambda b: b["title_path"]), lambda p: F.size(p) > 0))
    tops = F.array_distinct(F.transform(paths, lambda p: p[0]))
    return F.when(F.size(paths) <= 1, "title_path_consistent").when(F.size(tops) > 1, "mixed_title_paths")


def quality_flags(tokens: Column, low: Column, high: Column, members: Column, extra: Column) -> Column:
    protected = F.exists(members, lambda b: b["type"].isin(PROTECTED_TYPES))
    named = F.array(
        length_flag(tokens, low, high),
        F.when(F.size(members) > 0, "source_anchor_complete"),
        F.when(protected, "protected_block_intact"),
        title_flag(members),
    )
    return F.array_distinct(F.concat(F.filter(named, lambda f: f.isNotNull()), extra))


def tags(members: Column, most: int = 8) -> Column:
    """Common title parts, block types, entity tags, then the most frequent words of four letters or more."""
    parts = F.filter(F.transform(T.common_path(F.transform(members, lambda b: b["title_path"])), lambda p: F.lower(T.normalize(p))), lambda p: p != "")
    kinds = F.array_sort(F.array_distinct(F.transform(members, lambda b: b["type"])))
    named = F.filter(F.transform(F.flatten(F.transform(members, lambda b: b["entity_tags"])), T.normalize_tag), lambda t: t != "")
    words = F.flatten(F.transform(members, lambda b: F.regexp_extract_all(F.lower(b["text"]), F.lit("([A-Za-z][A-Za-z0-9_-]{3,})"), F.lit(1))))
    words = T.frequent(F.filter(words, lambda w: ~w.isin(T.TAG_STOPWORDS)), most)
    return F.slice(F.array_distinct(F.concat(parts, kinds, named, words)), 1, most)


def entity_tags(members: Column) -> Column:
    found = F.array_distinct(F.flatten(F.transform(members, lambda b: F.concat(b["entity_tags"], T.entities(b["text"])))))
    return F.when(F.size(found) > 0, F.slice(found, 1, 12)).otherwise(tags(members, 4))


def distinct_field(members: Column, field: str) -> Column:
    """Distinct non-empty values in the order they are met."""
    return F.array_distinct(F.filter(F.transform(members, lambda b: b[field]), lambda s: s.isNotNull() & (s != "")))


def anchor(members: Column) -> Column:
    return F.struct(
        "dataset",
        "split",
        "source_doc_id",
        distinct_field(members, "section_name").alias("sections"),
        F.get(members, F.lit(0))["block_id"].alias("first_block_id"),
        F.element_at(members, -1)["block_id"].alias("last_block_id"),
        F.size(members).alias("block_count"),
        distinct_field(members, "asset_file").alias("assets"),
    )


def chunk_id(strategy: str, index: Column) -> Column:
    return F.format_string(f"%s_{strategy}_chunk_%05d", F.col("doc_id"), index.cast("int"))


def finish(groups: DataFrame, strategy: str, low: Column | int, high: Column | int) -> DataFrame:
    """groups: HEADER, index, text, members (blocks), extra_flags and any metadata column; gives chunk rows."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    members = F.col("members")
    counted = groups.withColumn("text", T.normalize("text")).withColumn("token_count", T.estimate_tokens("text"))
    meta = [c for c in groups.columns if c.startswith("meta_")]
    return counted.select(
        chunk_id(strategy, F.col("index")).alias("chunk_id"),
        *HEADER,
        F.col("index").cast("long").alias("index"),
        F.lit(strategy).alias("strategy"),
        "text",
        "token_count",
        T.common_path(F.transform(members, lambda b: b["title_path"])).alias("title_path"),
        F.transform(members, lambda b: b["block_id"]).alias("source_blocks"),
        anchor(members).alias("source_anchor"),
        tags(members).alias("tags"),
        T.summary("text").alias("summary"),
        entity_tags(members).alias("entity_tags"),
        quality_flags(F.col("token_count"), low, high, members, F.col("extra_flags")).alias("quality_flags"),
        *meta,
    )
