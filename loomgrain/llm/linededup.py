"""Line dedup by site-relative frequency.

For each host, a line's ratio is the number of the host's pages that contain it over the
number of the host's pages. Lines above the ratio are boilerplate and are cut from that
host's pages. Two parameters, off by default, narrow the rule: min_pages asks that at
least so many pages hold a line (on a host of few pages one page is a large share), and
keep_whole leaves a page alone all of whose non-blank lines would go (a page that was
copied many times within its host is one for deduplication and not a template).

A page counts a line once, so the count is one groupBy whose map-side combine takes the
repeats; a host with a third of all rows is spread by its lines' hashes. A host has at
most (its mean distinct lines a page) / ratio boilerplate lines, whatever its size, so
the list that is joined back to the host's pages is bounded. That list is broadcast
when its measured size allows and otherwise joined on (host, salt), the list repeated
for each salt; both give the same rows. Within the list, lines are dealt into slots by
their hash, so that a page's line is compared with a few others only. Lines are known by
128 bits of two seeded hashes.

Defined cases: null text gives null text, no lines and no drop; an empty text has no
lines; blank lines are kept and never counted; a null host is a host of its own; a line
repeated on a page is dropped at each place; a page whose every line is boilerplate
becomes empty (or stays, with keep_whole); repeated rows each count as a page; an empty
table gives no rows; other columns pass through, and columns named like the results
are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.session import written

RATIO = 0.05
MIN_PAGES = 5  # of the registered query and the pipeline
BROADCAST_LINES = 200_000
SALTS = 64
SLOTS = 256


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.concat(F.lit("\x00"), line)).alias("b"))


def _slot(key: Column) -> Column:
    return F.pmod(key["a"], F.lit(SLOTS)).cast("int")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """_host, _bad (its boilerplate line keys, in an array for each slot) and _many (how many) for every host that has some."""
    kept = F.filter(F.array_distinct(_lines(F.col(text))), lambda x: F.trim(x) != "")
    held = pages.select(F.col(host).alias("_host"), F.explode(F.transform(kept, _line_key)).alias("_l"))
    counted = held.groupBy("_host", "_l").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("_pages"))
    joined = counted.join(totals, counted["_host"].eqNullSafe(totals["_host"])).drop(totals["_host"])
    over = joined.filter(F.col("n") > F.col("_pages") * ratio)
    slots = over.groupBy("_host", _slot(F.col("_l")).alias("k")).agg(F.sort_array(F.collect_list("_l")).alias("v"))
    listed = slots.groupBy("_host").agg(F.collect_list(F.struct("k", "v")).alias("s"), F.sum(F.size("v")).alias("_many"))
    at = F.map_from_entries("s")
    return listed.select("_host", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.element_at(at, k)).alias("_bad"), "_many")


def dedup_lines(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = 1, keep_whole: bool = False
) -> DataFrame:
    """pages with the text cut, and n_lines and n_dropped (non-blank lines before, and cut)."""
    pages = pages.drop(*({"n_lines", "n_dropped"} - {host, text}))
    bad = written(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    small = (bad.agg(F.sum("_many")).first()[0] or 0) <= BROADCAST_LINES
    if small:
        joined = pages.join(F.broadcast(bad), pages[host].eqNullSafe(bad["_host"]), "left")
    else:
        salted = pages.withColumn("_salt", F.pmod(F.xxhash64(text), F.lit(SALTS)))
        copies = bad.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(
            copies, salted[host].eqNullSafe(copies["_host"]) & (salted["_salt"] == copies["_s"]), "left"
        ).drop("_salt", "_s")
    blank = lambda x: F.trim(x) == ""
    known = lambda key: F.coalesce(F.array_contains(F.get(F.col("_bad"), _slot(key)), key), F.lit(False))
    lines = _lines(F.col(text))
    kept = F.when(
        F.col("_bad").isNotNull(),
        F.filter(lines, lambda x: blank(x) | ~known(_line_key(x))),
    ).otherwise(lines)
    full = lambda xs: F.size(F.filter(xs, lambda x: F.trim(x) != ""))
    # Two steps, so that the lines are split and matched once and not for each use.
    cut = joined.withColumn("_kept", kept).withColumns(
        {"_n": F.coalesce(full(lines), F.lit(0)), "_k": F.coalesce(full(F.col("_kept")), F.lit(0))}
    )
    whole = F.col("_k") == F.col("_n")
    if keep_whole:
        whole |= F.col("_k") == 0
    return cut.withColumns(
        {
            text: F.when(whole, F.col(text)).otherwise(F.array_join("_kept", "\n")),
            "n_lines": F.greatest(F.col("_n"), F.lit(0)).cast("long"),
            "n_dropped": F.when(whole, F.lit(0)).otherwise(F.col("_n") - F.col("_k")).cast("long"),
        }
    ).drop("_host", "_bad", "_many", "_kept", "_n", "_k")
