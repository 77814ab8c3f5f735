"""Connected components over links, in DataFrame form, without collecting them anywhere.

Each turn first contracts the links that share a partition by union-find (a task sees its
own links only, a label's links are dealt over several tasks, and a task's memory is
bounded by MOST labels at a time), then hooks every label to the least label beside it, follows one more
step, and renames the ends of the remaining links. Turns end when no link has two ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.session import written

MOST = 500_000
SALTS = 16


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as links to the least label of each local component."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def stars() -> Iterator[pa.RecordBatch]:
        pairs = [(find(x), x) for x in list(root)]
        pairs = [p for p in pairs if p[0] != p[1]]
        root.clear()
        for i in range(0, len(pairs), 20_000):
            part = pairs[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.string()), pa.array([p[1] for p in part], pa.string())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > MOST:  # what is known so far leaves as links; the next turn meets them again
            yield from stars()
    yield from stars()


def merge(labels: DataFrame, links: DataFrame, most_turns: int = 100) -> DataFrame:
    """labels (id, label) after joining the labels of linked ids; links has ids a and b. Labels are strings."""
    to = labels.select(F.col("id"), F.col("label"))
    named = links.join(to.withColumnsRenamed({"id": "a", "label": "la"}), "a").join(to.withColumnsRenamed({"id": "b", "label": "lb"}), "b")
    edges = named.filter("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    moves = []  # what each turn renames; the labels follow all of it at the end, in one step
    for _ in range(most_turns):
        edges = written(edges.repartition("a", F.pmod(F.xxhash64("b"), F.lit(SALTS))).mapInArrow(_contract, "a string, b string"), "links")
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("x"), F.least("a", "p").alias("p"))
        further = least.select(F.col("x").alias("p"), F.col("p").alias("q"))
        parent = written(least.join(further, "p").select("x", F.least("p", "q").alias("p")), "parents")
        moves.append(parent)
        ends = lambda c, n: parent.select(F.col("x").alias(c), F.col("p").alias(n))  # noqa: B023, E731
        moved = edges.join(ends("a", "pa"), "a").join(ends("b", "pb"), "b").filter("pa != pb")
        edges = moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
    else:
        raise RuntimeError("components did not settle")
    for parent in moves:
        labels = labels.join(parent, labels["label"] == parent["x"], "left").select("id", F.coalesce("p", "label").alias("label"))
    return written(labels, "labels") if moves else labels
