"""Sharding by histogram sort: find byte splitters by counting, then move every row once.

Each row gets a fixed-width text key: 16 hex digits of a hash of its text, 16 of its
doc_id and 16 that tell identical rows apart. Keys are spread evenly, equal texts are
neighbours in key order, and a splitter can still cut between copies, so one text that
holds a third of all rows does not unbalance the shards. As the last digits depend on the
rows' order, the carried columns are written once with their key: counting and moving
read the same keys, whatever is computed again.

The splitters are found by probing. A round counts the exact bytes below every candidate
boundary inside each open bracket, all partitions together, and keeps the sub-bracket
that holds the wanted byte rank. A bracket closes when its best boundary misses the
rank by no more than its tolerance, or when a single row spans it. For numbering, shards
are cut further into ranges of about FINE_BYTES, so many as the input asks for; their
splitters need be exact to a quarter of a range only. What a round sends to the driver
is bounded by 64 first probes for each splitter (4096 at least) or 256 for each open one.
The rows themselves move in one exchange at the end, a range to a group.

Law: `bytes`. Shard sizes differ from total/shards by at most the tolerance (0.05 % of
a shard) plus one row at each end. A row's size is its text's UTF-8 bytes plus 1.

Defined cases: a null text has size 1, text_crc32 null, and sorts as the empty key;
null doc_ids sort first; an empty table gives no rows; identical rows each get a slot;
other columns pass through, and columns named like the results are replaced by them.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.session import written

FIRST, NEXT = 3, 2  # hex digits a round adds to a bracket's prefix
TOLERANCE = 0.0005
FINE_BYTES = 256 << 20  # of a range that one window numbers
TREE = 256  # bounds that are compared as a tree of conditions; more are searched in an array
WIDTH = 48


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def keyed(rows: DataFrame, text: str, key: str) -> DataFrame:
    """rows with _size and _key. Identical rows get different keys from their place in the input."""
    doc = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    flipped = doc.bitwiseXOR(F.lit(-(2**63)).cast("long"))  # unsigned order of hex is the order of doc_id
    hashed = F.when(F.col(text).isNull(), F.lit("0" * 16)).otherwise(_hex(F.xxhash64(text), 16))
    place = _hex(F.monotonically_increasing_id(), 16)
    return rows.withColumns(
        {
            "_size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
            "_key": F.concat(hashed, _hex(flipped, 16), place),
        }
    )


def _children(keys: DataFrame, brackets: list[str], digits: int) -> dict[str, list]:
    """For each open bracket its sub-brackets in key order: prefix, bytes, rows, least and greatest key."""
    size = len(brackets[0])
    held = keys.filter(F.substring("_key", 1, size).isin(brackets)) if size else keys
    counted = held.groupBy(F.substring("_key", 1, size + digits).alias("p")).agg(
        F.sum("_size").alias("b"), F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")
    )
    found: dict[str, list] = {}
    for r in sorted(counted.collect(), key=lambda r: r.p):  # at most brackets * 16**digits rows
        found.setdefault(r.p[:size], []).append(r)
    return found


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))


def splitters(keys: DataFrame, wanted: list[int], slack: list[float]) -> list[str]:
    """For each wanted count of bytes the key at which, but for its slack, as many bytes lie below."""
    done: dict[int, str] = {}
    open_: dict[int, tuple[str, int]] = {i: ("", 0) for i in range(len(wanted))}  # prefix, bytes below it
    first = max(FIRST, -(-(64 * len(wanted)).bit_length() // 4))
    while open_:
        following: dict[int, tuple[str, int]] = {}
        for size in sorted({len(p) for p, _ in open_.values()}):
            now = {i: x for i, x in open_.items() if len(x[0]) == size}
            found = _children(keys, sorted({p for p, _ in now.values()}), first or min(NEXT, WIDTH - size))
            sums_of = {p: [*accumulate((k.b for k in kids), initial=0)] for p, kids in found.items()}
            for i, (prefix, below) in now.items():
                kids, sums = found[prefix], sums_of[prefix]
                at = min(max(bisect_right(sums, wanted[i] - below) - 1, 0), len(kids) - 1)
                kid, left, right = kids[at], below + sums[at], below + sums[at + 1]
                miss = min(abs(wanted[i] - left), abs(right - wanted[i]))
                if miss <= slack[i] or kid.lo == kid.hi:
                    if abs(wanted[i] - left) <= abs(right - wanted[i]):
                        done[i] = kid.lo
                    else:
                        done[i] = kid.hi + "~"  # just above this sub-bracket's last key
                else:
                    following[i] = (kid.lo[: _common(kid.lo, kid.hi)], left)  # skip digits all its keys share
        open_, first = following, 0
    return [done[i] for i in range(len(wanted))]


def _place(key: Column, bounds: list[str], base: int = 0) -> Column:
    """How many bounds are at most key: a balanced tree of comparisons, or a binary search in an array of many bounds."""
    if not bounds:
        return F.lit(base)
    if len(bounds) > TREE:
        every = F.array(*map(F.lit, bounds)) if len(bounds) <= 1000 else F.split(F.lit(",".join(bounds)), ",")

        def halved(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            right = F.get(every, mid) <= key
            lo, hi = F.when(right, mid + 1).otherwise(s["lo"]), F.when(right, s["hi"]).otherwise(mid)
            return F.when(s["lo"] < s["hi"], F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(s)

        whole = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), whole, halved, lambda s: s["lo"])
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _place(key, bounds[:mid], base)).otherwise(
        _place(key, bounds[mid + 1 :], base + mid + 1)
    )


def shard(
    rows: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", tolerance: float = TOLERANCE, carry: list[str] | None = None
) -> DataFrame:
    """rows (all columns, or those of carry) with size, text_crc32, law, shard, slot and grown_shard, moved into key order in one exchange."""
    mine = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = rows.drop(*(set(mine) - {text, key}))
    spark = rows.sparkSession
    carried = [F.col(c) for c in (rows.columns if carry is None else carry) if c not in mine]
    keys = written(keyed(rows, text, key).select(*carried, "_key", "_size", F.crc32(F.col(text).cast("binary")).alias("_crc")), "shard-keys")
    total, count = keys.agg(F.sum("_size"), F.count("*")).first()
    if not count:
        bounds, per = [], 1
    else:
        per = max(1, total // shards // FINE_BYTES)
        wanted = [total * i // (shards * per) for i in range(1, shards * per)]
        loose = total / (shards * per) / 4
        bounds = splitters(keys, wanted, [loose if i % per else tolerance * total / shards for i in range(1, shards * per)])
    fine = _place(F.col("_key"), bounds).cast("int")
    ranged = keys.withColumn("_fine", fine)
    before = ranged.groupBy("_fine").agg(F.count("*").alias("n")).collect()  # shards * per rows
    counts = {r["_fine"]: r["n"] for r in before}
    starts, run = [], 0
    for f in range(shards * per):
        run = 0 if f % per == 0 else run
        starts.append(run)
        run += counts.get(f, 0)
    if shards * per > int(spark.conf.get("spark.sql.shuffle.partitions")):
        ranged = ranged.repartition(shards * per, "_fine")
    order = Window.partitionBy("_fine").orderBy("_key")
    listed = F.array(*[F.lit(s).cast("long") for s in starts]) if len(starts) <= 1000 else F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    start = F.element_at(listed, F.col("_fine") + 1)
    return ranged.withColumns(
        {
            "size": F.col("_size"),
            "text_crc32": F.col("_crc"),
            "law": F.lit("bytes"),
            "shard": F.floor(F.col("_fine") / per).cast("int"),
            "slot": start + F.row_number().over(order) - 1,
            "grown_shard": F.lit(None).cast("int"),
        }
    ).drop("_fine", "_key", "_size", "_crc")
