"""Fixed-window chunks: greedy packing of whole blocks up to a target, over-long blocks cut into overlapping windows.

The packing is a fold over a document's blocks inside one expression: the state is the
open group's number and its tokens, the output a group number for each block. Text never
enters the state. What follows is an explode and a group within the same partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import text as T
from loomgrain.operators import chunk_rows


@dataclass(frozen=True)
class FixedConfig:
    target_tokens: int = 512
    overlap_tokens: int = 64
    min_tokens: int = 128
    max_tokens: int = 512
    include_title_context: bool = False


_SHELF = 256  # group numbers are gathered on shelves, so that a step copies a shelf and not all that went before


def pack(tokens, target: int):
    """Group numbers (from 1) of greedy packing; a size over the target gets a group of its own."""
    none = F.array().cast("array<int>")
    zero = F.struct(
        F.lit(0).alias("group"), F.lit(0).cast("long").alias("held"), F.lit(False).alias("open"), none.alias("shelf"), F.array().cast("array<array<int>>").alias("out")
    )

    def step(acc, size):
        over = size > target
        fresh = over | ~acc["open"] | (acc["held"] + size > target)
        group = F.when(fresh, acc["group"] + 1).otherwise(acc["group"])
        held = F.when(over, F.lit(0).cast("long")).when(fresh, size).otherwise(acc["held"] + size)
        full = F.size(acc["shelf"]) >= _SHELF
        shelf = F.when(full, F.array(group)).otherwise(F.concat(acc["shelf"], F.array(group)))
        out = F.when(full, F.concat(acc["out"], F.array(acc["shelf"]))).otherwise(acc["out"])
        return F.struct(group.alias("group"), held.alias("held"), (~over).alias("open"), shelf.alias("shelf"), out.alias("out"))

    return F.aggregate(tokens, zero, step, lambda acc: F.concat(F.flatten(acc["out"]), acc["shelf"]))


def chunks(blocks: DataFrame, config: FixedConfig = FixedConfig()) -> DataFrame:
    docs = chunk_rows.documents(blocks)
    titled = lambda b: T.block_text(b["text"], b["title_path"], config.include_title_context)
    docs = docs.withColumn("texts", F.transform("blocks", titled)).withColumn("sizes", F.transform("texts", T.estimate_tokens))
    docs = docs.withColumn("groups", pack(F.col("sizes"), config.target_tokens))
    zipped = F.arrays_zip("blocks", "texts", "sizes", "groups")
    rows = docs.select(*chunk_rows.HEADER, F.posexplode(zipped).alias("i", "b")).select(
        *chunk_rows.HEADER, "i", F.col("b.blocks").alias("block"), F.col("b.texts").alias("text"), F.col("b.sizes").alias("size"), F.col("b.groups").alias("g")
    )
    parts = rows.groupBy(*chunk_rows.HEADER, "g").agg(
        F.array_sort(F.collect_list(F.struct("i", "block", "text"))).alias("m"), F.max("size").alias("largest")
    )
    over = F.col("largest") > config.target_tokens
    whole = F.array(F.array_join(F.transform("m", lambda x: x["text"]), " "))
    cut = T.word_windows(F.col("m")[0]["text"], config.target_tokens, config.overlap_tokens)
    pieces = parts.select(
        *chunk_rows.HEADER, "g", F.transform("m", lambda x: x["block"]).alias("members"), over.alias("over"),
        F.posexplode(F.when(over, cut).otherwise(whole)).alias("part", "text"),
    )
    order = Window.partitionBy(*chunk_rows.HEADER).orderBy("g", "part")
    flags = F.when(F.col("over"), F.array(F.lit("fixed_window_baseline"), F.lit("split_long_block"))).otherwise(F.array(F.lit("fixed_window_baseline")))
    numbered = pieces.withColumns({"index": F.row_number().over(order), "extra_flags": flags})
    return chunk_rows.finish(numbered, "fixed", config.min_tokens, config.max_tokens)
