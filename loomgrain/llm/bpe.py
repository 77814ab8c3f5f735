"""BPE encoding and decoding with a contiguous rank array.

A word is an array of parts and, beside it, the ranks of its adjacent pairs. The least
rank is found by a scan, that boundary is deleted and the one or two ranks beside it are
refreshed; for short words this beats any heap. Words of more than LONG symbols (one
unbroken run of letters can be a whole text) take a heap over the same ranks instead,
as scanning would be quadratic there; results are the same.

The vocabulary is a tokenizers JSON file given by path; it is read on the driver and sent
to executors once (its size is the vocabulary's, not the data's). Each Python worker
keeps a bounded dictionary of words it has encoded.

Defined cases: null text is encoded as empty (0 tokens, hashes of nothing, decoded text
empty); texts of any length are whole; an empty table gives no rows; repeated rows each
get their result; special tokens' strings in a text become their ids, the longest
first, as the library does; other columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from loomgrain.llm.batches import arrow_map, pieces

LONG = 200
CACHE = 100_000
#: Fixed value: how byte-level vocabularies of this kind split a text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by rule: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tables:
    """byte_ids: id of each byte; pairs: (left id, right id) to rank; merged: id that a rank makes; raw: bytes of each id."""

    byte_ids: list[int]
    pairs: dict[tuple[int, int], int]
    merged: list[int]
    raw: list[bytes]
    special: dict[str, int] = field(default_factory=dict)


def load(spark: SparkSession, path: str) -> Tables:
    """Read a byte-level BPE tokenizers JSON file from a local path or any store Spark can open."""
    if "://" in path:
        raw = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    else:
        with open(path, "rb") as f:
            raw = f.read()
    return tables(json.loads(raw))


def _unhandled(spec: dict) -> list[str]:
    """Settings of a tokenizer file that this encoder does not follow."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    found = [name for name in ("normalizer",) if spec.get(name)]
    if model.get("type", "BPE") != "BPE":
        found.append("model.type")
    found += [f"model.{n}" for n in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(n)]
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        found.append("pre_tokenizer")
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        found.append("decoder")
    found += [f"added_tokens.{n}" for n in ("single_word", "lstrip", "rstrip") if any(t.get(n) for t in spec.get("added_tokens") or [])]
    return found


def tables(spec: dict) -> Tables:
    """The tables of a byte-level BPE file; one with settings that would change results is an error."""
    if unhandled := _unhandled(spec):
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(unhandled)}")
    vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    out = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        out[i] = bytes(alphabet[c] for c in token)
    for token, i in special.items():
        out[i] = token.encode()
    pairs, merged = {}, []
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        pairs.setdefault((vocab[left], vocab[right]), rank)
        merged.append(vocab[left + right])
    by_byte = {alphabet[c]: vocab[c] for c in alphabet if c in vocab}
    return Tables([by_byte[b] for b in range(256)], pairs, merged, out, special)


def merge_short(ids: list[int], t: Tables) -> list[int]:
    """Merge in place by scanning the rank array."""
    get = t.pairs.get
    ranks = [get(p, _NONE) for p in zip(ids, ids[1:])]
    while ranks and (least := min(ranks)) != _NONE:
        i = ranks.index(least)
        ids[i] = t.merged[least]
        del ids[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get((ids[i - 1], ids[i]), _NONE)
        if i < len(ranks):
            ranks[i] = get((ids[i], ids[i + 1]), _NONE)
    return ids


def merge_long(ids: list[int], t: Tables) -> list[int]:
    """The same merges by a heap of (rank, place) over a linked list, for words of any length."""
    n, get = len(ids), t.pairs.get
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        if ids[i] < 0 or (j := after[i]) >= n or get((ids[i], ids[j])) != rank:
            continue  # one side has changed since
        ids[i], ids[j] = t.merged[rank], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get((ids[i], ids[k]))) is not None:
                heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := get((ids[h], ids[i]))) is not None:
            heappush(heap, (r, h))
    return [x for x in ids if x >= 0]


class _Words(dict):
    """Word to its ids as little-endian 32-bit integers; emptied when full, so memory stays bounded."""

    def __init__(self, t: Tables):
        super().__init__()
        self.t = t

    def __missing__(self, word: str) -> bytes:
        ids = [self.t.byte_ids[b] for b in word.encode("utf-8", "surrogatepass")]
        ids = merge_short(ids, self.t) if len(ids) <= LONG else merge_long(ids, self.t)
        out = np.asarray(ids, "<u4").tobytes()
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out


class Codec:
    def __init__(self, t: Tables):
        self.t, self.words = t, _Words(t)
        self.split = regex.compile(PATTERN).findall
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(t.special, key=len, reverse=True))) if t.special else None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not any(s in text for s in self.t.special):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out.extend(map(self.words.__getitem__, self.split(text[at : m.start()])))
            out.append(np.asarray([self.t.special[m[0]]], "<u4").tobytes())
            at = m.end()
        out.extend(map(self.words.__getitem__, self.split(text[at:])))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        raw = self.t.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def encode(rows: DataFrame, tables_: Tables, text: str = "text", ids: bool = True, decoded: bool = False) -> DataFrame:
    """rows with n_tokens, ids_sha256, decoded_sha256 and, where asked for, token_ids (array) and decoded (text)."""
    made = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    made += [("token_ids", pa.list_(pa.int32()), "array<int>")] * ids + [("decoded", pa.string(), "string")] * decoded
    names = {m[0] for m in made}
    rows = rows.drop(*(names - {text}))
    held = rows.sparkSession.sparkContext.broadcast(tables_)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{n} {k}" for n, _, k in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for batch in batches:
            for piece in pieces(batch, text):
                encoded = [codec.encode(x or "") for x in piece.column(text).to_pylist()]
                back = [codec.decode(x) for x in encoded]
                columns = [
                    [len(x) // 4 for x in encoded],
                    [hashlib.sha256(x).hexdigest() for x in encoded],
                    [hashlib.sha256(x.encode()).hexdigest() for x in back],
                ]
                columns += [[np.frombuffer(x, "<u4").astype(np.int32) for x in encoded]] * ids + [back] * decoded
                arrays = [pa.array(c, m[1]) for c, m in zip(columns, made, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], [*piece.schema.names, *(m[0] for m in made)])

    return arrow_map(rows, run, schema)
