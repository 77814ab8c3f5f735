"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct 5-word shingles. Two documents link when their sets'
Jaccard similarity reaches the threshold; the result is each document's class under links.

1. Equal sets are collapsed: a set's 128-bit digest stands for all documents that have it.
2. Shingles are ordered by document frequency, exactly, over one document of each
   digest. Documents are numbered within groups of a few MB. Entries (48-bit token,
   number) are packed into 64-bit integers, exchanged in blobs by token range, and sorted
   there; a blob names its groups, and each group's list of documents travels once, on
   its own. Tokens that occur once need no further work; the others go back to where
   their group's list is, again in blobs. An exchange into many parts goes by two steps.
3. With t the threshold, a set of n needs only its first n - ceil(t n) + 1 tokens as
   prefix: linked sets share a prefix token. A document whose prefix holds only tokens
   that occur once has no links; it is settled and leaves. On real text most do.
4. Documents with equal size and equal prefix are collapsed into groups (those that the
   group's first member verifies). Groups meet in the lists of their prefix tokens, and
   a pair must pass the size filter and the position filter.
5. Lists are first worked off in rounds. A round deals each list at random into slots of
   a few members (more from round to round), pairs those of different classes within a
   slot and verifies them, so that large groups of near copies become one class after few
   comparisons and stragglers find it. Then all remaining pairs of groups in different classes are
   enumerated (members of a list's largest class only against others), expanded to
   members and verified. No candidate is dropped: a pair is skipped only when its two
   documents are in one class already, where a link would change nothing.

A token that a large share of all documents holds never goes through a token range: such
tokens, whose number is bounded by the mean set size over that share, are found in the
first pass, broadcast, and ordered last. In the rounds a long token list is spread over its slots.

similar_links also counts every document's links: as no link leaves a class, each class of
different sets is compared with itself in blocks, all sets with all, and equal sets count
by their number.

Overlap is counted over the tokens that occur more than once; no other can be shared.
Tokens have 48 bits: two different shingles of a candidate pair with n and m shingles are
taken for one with a chance of about n m / 2**48 (one pair in 28 million at 3,000 each),
and that matters only within a shingle of the threshold.

Defined cases: null text and text without words have an empty set, n_shingles 0, and
link with nothing; a text of fewer than 5 words is one shingle; equal sets always link;
repeated rows and repeated ids are separate documents of their own sets; a null id is
never a class's id while another is there; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrain.llm import components
from loomgrain.llm.batches import NOT_SPACE, arrow_map, mix, pieces, shingles, words
from loomgrain.session import written

WORDS = 5
THRESHOLD = 75  # per cent
GROUP_BYTES = 4 << 20  # text of documents whose entries share blobs
RANGE = 1_500_000  # entries that a token range or a document bucket should hold
FAN = 256  # parts that one exchange makes of a blob
MOST_TASKS = 50_000
HOT_CLASS = 2_000  # digests of more than one row in so many are joined by broadcast
HOT_LEAST = 1_000  # and in at least so many
HOT_SHARE = 16  # a token in more than 1/16 of all documents is hot
COPIES = 2_000_000  # ids of collapsed documents that may be broadcast
SLOTS = (2, 8, 16, 32)  # by round: about so many random members of a token list meet
BLOCK_SETS = 1_024  # sets of a class that one side of a cell holds
BLOCK_TOKENS = 1_500_000  # and their tokens
COLUMNS = 2_048  # tokens compared at once
_ENTRY = np.dtype([("packed", "<u8"), ("df", "<u4")])
_RUN = np.dtype([("gid", "<u8"), ("n", "<u4")])  # entries of a group that follow one another
_DOC = np.dtype([("digest", "S16"), ("n", "<u4")])
_LOW = np.uint64(0xFFFF)
_HOT_DF = 0xFFFFFFFF


def sets_of(column: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    hashes, at = words(column, NOT_SPACE)
    out = []
    for i in range(len(at) - 1):
        own = hashes[at[i] : at[i + 1]]
        if len(own) >= WORDS:
            own = np.unique(shingles(own, WORDS))
        elif len(own):
            own = shingles(own, len(own))
        out.append(own)
    return out


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _tokens(own: np.ndarray) -> np.ndarray:
    return own >> np.uint64(16)


def _gathered(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[list[tuple[pa.RecordBatch, list[np.ndarray]]]]:
    """Pieces with their sets, about GROUP_BYTES of text (and under 2**16 documents) together."""
    held, size, docs = [], 0, 0
    for batch in batches:
        for piece in pieces(batch, text):
            own = sets_of(piece.column(text))
            if held and docs + len(own) > 60_000:
                yield held
                held, size, docs = [], 0, 0
            held.append((piece, own))
            size += piece.column(text).nbytes
            docs += len(own)
            if size >= GROUP_BYTES:
                yield held
                held, size, docs = [], 0, 0
    if held:
        yield held


def _measured(key: str, text: str):
    """Rows (key, n, digest), and rows (token, seen) of tokens that an eighth of a group's documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "digest", "token", "seen"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for group in _gathered(batches, text):
            every = []
            for piece, own in group:
                every += own
                n = len(own)
                columns = [piece.column(key), [len(s) for s in own], [digest(s).hex() if len(s) else None for s in own], [None] * n, [None] * n]
                yield pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            token, seen = np.unique(_tokens(np.concatenate(every)), return_counts=True)
            hot = seen >= max(64, len(every) // 8)
            if hot.any():
                m = int(hot.sum())
                columns = [[None] * m, [None] * m, [None] * m, token[hot].astype(np.int64), seen[hot]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _blobs(rows: list[tuple[int, np.ndarray, np.ndarray, bytes | None]]) -> pa.RecordBatch:
    """Rows (route, runs, entries, a group's documents or None)."""
    raw = lambda x: x if x is None or isinstance(x, bytes) else x.tobytes()
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(map(raw, c)) if k == pa.binary() else list(c), k) for c, k in zip(columns, kinds, strict=True)], ["route", "groups", "entries", "docs"])


_BLOB = "route long, groups binary, entries binary, docs binary"


def _ranges(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Which of parts equal ranges each 48-bit token falls in."""
    return (((tokens >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _buckets(gid: np.ndarray, parts: int) -> np.ndarray:
    """Which of parts buckets each group's documents are in."""
    return (((mix(gid) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _by_route(part: np.ndarray, gid: np.ndarray, entries: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, None]]:
    """One row for each part, its entries in runs of their groups."""
    order = np.lexsort((gid, part))
    part, gid, entries = part[order], gid[order], entries[order]
    out = []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b > a:
            at = np.concatenate([[0], np.flatnonzero(np.diff(gid[a:b])) + 1])
            runs = np.zeros(len(at), _RUN)
            runs["gid"], runs["n"] = gid[a:b][at], np.diff(np.append(at, b - a))
            out.append((int(part[a]), runs, entries[a:b], None))
    return out


def _packed(text: str, parts: int, ranges: int, held):
    """Blobs of (token, document) by token range; each group's documents, with their hot tokens, under a negative route."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, task = held.value, TaskContext.get()
        first = (task.partitionId() if task else 0) << 24  # the groups of a task follow its rows' order
        for number, group in enumerate(_gathered(batches, text)):
            own = [s for _, sets in group for s in sets if len(s)]
            if not own:
                continue
            gid = np.uint64(first + number)
            docs = np.array([(digest(s), len(s)) for s in own], _DOC)
            lens = [len(s) for s in own]
            token = _tokens(np.concatenate(own))
            packed = (token << np.uint64(16)) | np.repeat(np.arange(len(own), dtype=np.uint64), lens)
            found = np.zeros(0, _ENTRY)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                is_hot = hot[at] == token
                found = np.zeros(int(is_hot.sum()), _ENTRY)
                found["packed"], found["df"] = packed[is_hot], _HOT_DF
                packed = packed[~is_hot]
            route = -1 - int(_buckets(np.array([gid]), parts)[0])
            yield _blobs([(route, np.array([(gid, len(found))], _RUN), found, docs.tobytes())])
            packed = np.sort(packed)
            part = _ranges(packed >> np.uint64(16), ranges)  # in order, as packed is
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            yield _blobs([(int(part[a]), np.array([(gid, b - a)], _RUN), packed[a:b], None) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a])

    return run


def _opened(table: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a table's blobs and each one's group."""
    runs = np.frombuffer(b"".join(table.column("groups").to_pylist()), _RUN)
    return np.repeat(runs["gid"], runs["n"]), np.frombuffer(b"".join(table.column("entries").to_pylist()), kind)


def _rerouted(table: pa.Table, buckets: int) -> pa.Table:
    """Rows of groups' documents, routed to the groups' buckets."""
    gids = np.array([np.frombuffer(g, _RUN)["gid"][0] for g in table.column("groups").to_pylist()], np.uint64)
    return table.set_column(0, "route", pa.array(_buckets(gids, buckets), pa.int64()))


def _counted(buckets: int):
    """Of one token range: the entries of tokens that occur more than once, by their group's bucket."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("route")[0].as_py() < 0:
            return _rerouted(table, buckets)
        gid, packed = _opened(table, np.uint64)
        order = np.argsort(packed >> np.uint64(16), kind="stable")
        gid, packed = gid[order], packed[order]
        token = packed >> np.uint64(16)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1, [len(token)]])
        df = np.repeat(np.diff(edge), np.diff(edge))
        again = df > 1
        entry = np.zeros(int(again.sum()), _ENTRY)
        entry["packed"], entry["df"] = packed[again], df[again]
        return pa.Table.from_batches([_blobs(_by_route(_buckets(gid[again], buckets), gid[again], entry))])

    return run


def _prefixed(threshold: int):
    """Of one bucket: the documents that have a shared token in their prefix, with what verification needs."""

    def run(table: pa.Table) -> pa.Table:
        out = {"id": [], "n": [], "tokens": [], "prefix": [], "first": []}
        lists = sorted((int(np.frombuffer(g, _RUN)["gid"][0]), d) for g, d in zip(table.column("groups").to_pylist(), table.column("docs").to_pylist(), strict=True) if d is not None)
        docs = np.frombuffer(b"".join(d for _, d in lists), _DOC)
        begin = np.cumsum([0, *(len(d) // _DOC.itemsize for _, d in lists)])
        gid, entry = _opened(table, _ENTRY)
        doc = begin[np.searchsorted(np.array([g for g, _ in lists], np.uint64), gid)] + (entry["packed"] & _LOW).astype(np.int64)
        token = entry["packed"] >> np.uint64(16)
        order = np.lexsort((token, entry["df"], doc))
        token, doc = token[order], doc[order]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b > a:
                n = int(docs["n"][doc[a]])
                single = n - (b - a)
                reach = n - -(-threshold * n // 100) + 1 - single
                if reach > 0:
                    out["id"].append(docs["digest"][doc[a]].ljust(16, b"\0").hex())
                    out["n"].append(n)
                    out["tokens"].append(np.sort(token[a:b]).astype(np.int64))
                    out["prefix"].append(token[a : a + reach].astype(np.int64))
                    out["first"].append(single)
        longs = pa.list_(pa.int64())
        kinds = [pa.string(), pa.int64(), longs, longs, pa.int64()]
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _split_again(parts: int, back: bool):
    """Deals blobs of one coarse route to finer ones, for inputs that need more than FAN parts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["route", "groups", "entries", "docs"])
        if table.column("route")[0].as_py() < 0:
            return table
        lists = table.filter(pc.is_valid(table.column("docs")))
        blobs = table.filter(pc.is_null(table.column("docs")))
        gid, entry = _opened(blobs, _ENTRY if back else np.uint64)
        part = _buckets(gid, parts) if back else _ranges(entry >> np.uint64(16), parts)
        return pa.concat_tables([pa.Table.from_batches([_blobs(_by_route(part, gid, entry))]), _rerouted(lists, parts)])

    return run


def _exchange(blobs: DataFrame, parts: int, entries: int, back: bool) -> DataFrame:
    """Blobs routed to parts; they come routed to at most FAN and are split again while that is fewer."""
    now = min(parts, FAN)
    while now < parts:
        salts = max(1, -(-entries // (now * RANGE)))
        salted = blobs.withColumn("salt", F.pmod(F.xxhash64("groups"), F.lit(salts)))
        now = min(parts, now * FAN)
        blobs = _wide(salted, parts, "route", "salt").groupBy("route", "salt").applyInArrow(_split_again(now, back), _BLOB)
    return _wide(blobs, parts, "route")


def _wide(rows: DataFrame, parts: int, *by: str) -> DataFrame:
    """rows with a task for each part where the session's number of shuffle partitions is smaller."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(min(parts, MOST_TASKS), *by) if parts > most else rows


def _similar(a: Column, b: Column, na: Column, nb: Column, threshold: int) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return 100 * shared >= threshold * (na + nb - shared)


def _verified(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that link."""
    side = lambda x: docs.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(_similar(F.col("ta"), F.col("tb"), F.col("na"), F.col("nb"), threshold)).select("a", "b")


def _may_link(threshold: int) -> Column:
    """Size and position filter on (n, pos) and (m, other_pos)."""
    n, m = F.col("n"), F.col("m")
    need = F.ceil(threshold * (n + m) / (100 + threshold) - 1e-9)
    left = F.least(n - F.col("pos"), m - F.col("other_pos"))
    return (100 * F.least(n, m) >= threshold * F.greatest(n, m)) & (left >= need)


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked_classes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """id, label for docs (id, n, tokens, prefix, first): equal labels for ids that links connect."""
    labels = written(docs.select("id", F.col("id").alias("label")), "labels")
    alike = docs.select("id", "n", F.xxhash64("prefix").alias("h"), "first")
    groups = alike.groupBy("n", "first", "h").agg(F.min("id").alias("gid"), F.count("*").alias("c")).filter("c > 1")
    joined = alike.join(groups, ["n", "first", "h"]).filter("id != gid").select(*_pair("id", "gid"))
    links = written(_verified(joined, docs, threshold), "links")
    labels = components.merge(labels, links)
    group_of = links.select(F.col("b").alias("id"), F.col("a").alias("gid"))
    members = written(docs.select("id").join(group_of, "id", "left").select("id", F.coalesce("gid", "id").alias("gid")), "members")
    heads = docs.join(members.filter("id = gid").select("id"), "id", "left_semi")
    postings = written(
        heads.select(F.col("id").alias("gid"), "n", "first", F.posexplode("prefix").alias("p", "token")).select(
            "gid", "n", "token", (F.col("first") + F.col("p")).alias("pos")
        ),
        "postings",
    )
    for turn, slot in enumerate(SLOTS):
        mixed = written(_mixed(postings, labels), "mixed")
        if mixed.isEmpty():
            return labels
        dealt = mixed.withColumn("slot", F.pmod(F.xxhash64("gid", "token", F.lit(turn)), F.greatest(F.lit(1), F.ceil(F.col("c") / slot))))
        # At first every label is small; later a list's largest class is met only by the members outside it.
        left = dealt if turn == 0 else dealt.filter("NOT major")
        met = left.join(_other(dealt, "slot"), ["token", "slot"]).filter(_apart(turn > 0) & _may_link(threshold))
        pairs = met.select(*_pair("gid", "other")).distinct()
        labels = components.merge(labels, written(_verified(pairs, docs, threshold), "links"))
    mixed = written(_mixed(postings, labels), "mixed")
    if mixed.isEmpty():
        return labels
    # A list's largest class meets only the members outside it; of those each pair comes once.
    met = mixed.filter("NOT major").join(_other(mixed), "token").filter(_apart(True) & _may_link(threshold)).select(*_pair("gid", "other")).distinct()
    each = lambda x: members.select(F.col("gid").alias(x), F.col("id").alias(f"{x}_id"))
    expanded = met.join(each("a"), "a").join(each("b"), "b").select(*_pair("a_id", "b_id"))
    return components.merge(labels, written(_verified(expanded, docs, threshold), "links"))


def _other(mixed: DataFrame, *more: str) -> DataFrame:
    """The other side of a list's self-join."""
    return mixed.select(
        "token", *more, F.col("gid").alias("other"), F.col("n").alias("m"), F.col("pos").alias("other_pos"),
        F.col("label").alias("other_label"), F.col("major").alias("other_major"),
    )


def _apart(minor: bool) -> Column:
    """Different classes, each pair once; minor: the left side is never of its list's largest class."""
    once = F.col("gid") < F.col("other")
    return (F.col("label") != F.col("other_label")) & ((F.col("other_major") | once) if minor else once)


def _mixed(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of lists that hold more than one class, with label, the list's length c, and whether the label is its largest."""
    held = postings.join(labels.withColumnRenamed("id", "gid"), "gid")
    sizes = held.groupBy("token", "label").agg(F.count("*").alias("k"))
    lists = sizes.groupBy("token").agg(F.sum("k").alias("c"), F.count("*").alias("kinds"), F.max(F.struct("k", "label"))["label"].alias("top"))
    kept = held.join(lists.filter("kinds > 1"), "token")
    return kept.withColumn("major", F.col("label") == F.col("top")).drop("kinds", "top")


def digested(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with _digest, the digest of the text's set (null where that is empty)."""
    kind = T.StructType([*rows.schema.fields, T.StructField("_digest", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                own = [digest(s).hex() if len(s) else None for s in sets_of(piece.column(text))]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(own, pa.string())], kind.names)

    return arrow_map(rows, run, kind)


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each list of a has in common with each of b."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
    doc = [np.repeat(np.arange(len(x)), [len(t) for t in x]) for x in (a, b)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(a), len(b)), np.float32)
    at = [np.searchsorted(both, f) for f in flat]
    held = [both[np.minimum(p, len(both) - 1)] == f if len(both) else np.zeros(len(f), bool) for p, f in zip(at, flat, strict=True)]
    at, doc = [p[h] for p, h in zip(at, held, strict=True)], [d[h] for d, h in zip(doc, held, strict=True)]
    for start in range(0, len(both), COLUMNS):
        sides = []
        for p, d, x in zip(at, doc, (a, b), strict=True):
            some = (p >= start) & (p < start + COLUMNS)
            side = np.zeros((len(x), min(COLUMNS, len(both) - start)), np.float32)
            side[d[some], p[some] - start] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _linked(threshold: int):
    """Of one cell: for each set of the left side, the documents of the right side's sets that it links with."""

    def run(table: pa.Table) -> pa.Table:
        label = np.asarray(table.column("label").to_pylist(), object)
        left, right = (np.asarray(table.column(c)) for c in ("left", "right"))
        n, size = np.asarray(table.column("n")), np.asarray(table.column("size"))
        ids = np.asarray(table.column("id").to_pylist(), object)
        tokens = table.column("tokens").combine_chunks()
        begin, flat = np.asarray(tokens.offsets), np.asarray(tokens.values)
        order = np.argsort(label, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(label[order][1:] != label[order][:-1]) + 1, [len(order)]])
        found, links = [], []
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            own = order[x:y]
            a, b = own[left[own]], own[right[own]]
            lists = [[flat[begin[i] : begin[i + 1]] for i in side] for side in (a, b)]
            shared = _shared(*lists).astype(np.int64)
            links_of = (100 * shared >= threshold * (n[a][:, None] + n[b][None, :] - shared)) & (ids[a][:, None] != ids[b][None, :])
            found += ids[a].tolist()
            links += (links_of @ size[b]).tolist()
        return pa.table([pa.array(found, pa.string()), pa.array(links, pa.int64())], names=["id", "links"])

    return run


def _link_counts(docs: DataFrame, named: DataFrame, threshold: int) -> DataFrame:
    """digest, links: documents with other sets that a set links with. named: digest, label, size; docs: the candidates.

    A link's ends are of one class, so each class is compared with itself, all sets with all. Large
    classes are dealt into blocks and pairs of blocks, and only sums of a cell leave it: the rows
    are a class's sets times its blocks, the comparisons the square of its sets.
    """
    sized = docs.select("id", F.size("tokens").alias("k")).join(named, F.col("id") == F.col("digest"))
    whole = sized.groupBy("label").agg(F.count("*").alias("c"), F.sum("k").alias("t")).filter("c > 1")
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK_SETS, F.col("t") / BLOCK_TOKENS)).cast("int")
    held = docs.select("id", "n", "tokens").join(named, F.col("id") == F.col("digest")).drop("digest")
    held = held.join(whole.select("label", blocks.alias("blocks")), "label").withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    parts = max(1, -(-(whole.filter(blocks == 1).agg(F.sum("t")).first()[0] or 0) // BLOCK_TOKENS))
    cells = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A set is on the left of its block's row of cells and on the right of its block's column; a diagonal cell has it once.
    rows = cells.select(F.col("block").alias("i"), F.col("other").alias("j"), "label", "id", "n", "tokens", "size", "blocks").withColumns({"left": F.lit(True), "right": F.col("i") == F.col("j")})
    columns = cells.filter("block <> other").select(F.col("other").alias("i"), F.col("block").alias("j"), "label", "id", "n", "tokens", "size", "blocks")
    every = rows.unionByName(columns.withColumns({"left": F.lit(False), "right": F.lit(True)}))
    every = every.withColumn("cell", F.when(F.col("blocks") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(parts)).cast("string"))).drop("blocks")
    return every.groupBy("cell", "i", "j").applyInArrow(_linked(threshold), "id string, links long").groupBy("id").agg(F.sum("links").alias("links"))


def similar_links(rows: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row for each row: key, n_shingles, component_id, and n_links, the number of other rows it links with."""
    return classified(rows, key, text, threshold, links=True).select(key, "n_shingles", "component_id", "n_links")


def classified(rows: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, links: bool = False) -> DataFrame:
    """One row for each row: key, n_shingles, component_id, and its set's digest and class label (null for an empty set); with links also n_links."""
    spark = rows.sparkSession
    slim = rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    measured = written(arrow_map(slim, _measured("id", "text"), "id long, n long, digest string, token long, seen long"), "sets")
    sets = measured.filter("token IS NULL")
    classes = written(sets.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n")), "classes")
    count, total, extra = classes.agg(F.count("*"), F.sum("n"), F.sum(F.col("size") - 1)).first()
    if not count:
        none = F.lit(None).cast("string")
        return sets.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), "digest", none.alias("label"), F.lit(0).cast("long").alias("n_links"))
    # 1/HOT_SHARE of the documents: at most HOT_SHARE * (mean set size) tokens.
    seen = measured.filter("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen"))
    rows_in = sets.count()
    hot = sorted(r.token for r in seen.filter(F.col("seen") > max(HOT_LEAST, rows_in // HOT_SHARE)).collect())
    held = spark.sparkContext.broadcast(np.array(hot, np.uint64))
    # One document of each digest: all but those collapsed into another (an id that also stands for a digest stays).
    reps = classes.select(F.col("rep").alias("id"))
    if extra <= COPIES:
        copies = sets.join(classes.filter("size > 1").select("digest", "rep"), "digest").filter("id > rep").select("id").distinct()
        copies = written(copies.join(classes.select(F.col("rep").alias("id")), "id", "left_anti"), "copies")
        single = slim.join(F.broadcast(copies), "id", "left_anti")
    else:  # sorted, as groups must come out alike when a task runs again
        single = slim.filter("id IS NULL").unionByName(slim.join(reps, "id", "left_semi")).sortWithinPartitions("id", "text")
    parts = buckets = max(1, -(-total // RANGE))
    blobs = arrow_map(single, _packed("text", parts, min(parts, FAN), held), _BLOB)
    blobs = _exchange(blobs, parts, total, back=False)
    shared = blobs.groupBy("route").applyInArrow(_counted(min(buckets, FAN)), _BLOB)
    shared = _exchange(shared, buckets, total, back=True)
    docs = shared.groupBy("route").applyInArrow(_prefixed(threshold), "id string, n long, tokens array<long>, prefix array<long>, first long")
    docs = written(docs, "candidates")
    if not docs.groupBy("id").count().filter("count > 1").isEmpty():  # an id on several rows kept several rows of a set
        docs = written(docs.dropDuplicates(["id"]), "candidates")
    labels = linked_classes(docs, threshold)
    named = labels.join(classes, labels["id"] == classes["digest"]).select("digest", "label", "rep")
    least = named.groupBy("label").agg(F.min("rep").alias("component"), F.count("*").alias("k")).filter("k > 1")
    moved = named.join(least, "label").select("digest", "label", "component")
    final = classes.join(moved, "digest", "left").select("digest", F.coalesce("label", "digest").alias("label"), F.coalesce("component", "rep").alias("component"), "size")
    more = []
    if links:
        counts = _link_counts(docs, labels.join(classes, labels["id"] == classes["digest"]).select("digest", "label", "size"), threshold)
        counts = written(counts, "links").withColumnRenamed("id", "digest")
        final = final.join(counts, "digest", "left")
        more = [F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links")]
    final = written(final, "final")
    # A set that very many rows have would fill one task of the join: at most HOT_CLASS such sets go by broadcast.
    is_hot = F.col("size") > max(64, rows_in // HOT_CLASS)
    hottest, rest = F.broadcast(final.filter(is_hot)), final.filter(~is_hot)
    empty = sets.filter("digest IS NULL")
    common = sets.filter("digest IS NOT NULL").join(hottest.select("digest"), "digest", "left_anti").join(rest, "digest", "left")
    out = sets.join(hottest, "digest").unionByName(common).unionByName(empty, allowMissingColumns=True)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), "digest", "label", *more)


def similar_classes(rows: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row for each row: key, n_shingles, component_id (the least key that links reach)."""
    return classified(rows, key, text, threshold).select(key, "n_shingles", "component_id")
