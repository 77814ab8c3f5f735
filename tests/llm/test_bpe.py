import hashlib
import json
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgrain.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH) as f:
        return bpe.Codec(bpe.tables(json.load(f)))


def ids_of(codec, text):
    raw = codec.encode(text)
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


TEXTS = [
    "", " ", "  \n\t x", "The quick  brown fox's 12,345 don't <|endoftext|> it <|endoftext|>", "éèçñ ß 中文文本 😀🏽 é",
    "\x00\x1c\x1d\x85\xa0 a b​", "a" * 5000, "ab" * 3000 + "!" * 999, "<|endoftext|>", "   <|endoftext|>   ", "　x﻿",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library(codec, text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids_of(codec, text) == want
    assert codec.decode(codec.encode(text)) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn"))))
def test_same_as_library_on_any_text(codec, text):
    assert ids_of(codec, text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.text("abcdefgh the", min_size=201, max_size=400))
def test_heap_and_array_agree(codec, text):
    ids = [codec.t.byte_ids[b] for b in text.encode()]
    assert bpe.merge_short(list(ids), codec.t) == bpe.merge_long(list(ids), codec.t)


def test_on_rows(spark, codec):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "héllo wörld", "z"), (3, "w" * 50_000, None)], "doc_id long, text string, n_tokens string")
    out = bpe.encode(rows, codec.t, decoded=True).orderBy("doc_id").collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert (out[0].n_tokens, out[0].ids_sha256, out[0].decoded_sha256) == (0, nothing, nothing)
    assert {r.decoded for r in out[1:3]} == {"", "héllo wörld"} and out[3].decoded == "w" * 50_000
    assert out[3].token_ids == LIBRARY.encode("w" * 50_000, add_special_tokens=False).ids
    assert bpe.encode(rows.limit(0), codec.t).collect() == []


def test_documents_round_trip(spark, sf, codec):
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        want = LIBRARY.encode(r.text, add_special_tokens=False).ids
        assert ids_of(codec, r.text) == want and codec.decode(codec.encode(r.text)) == r.text


def test_settings_that_are_not_followed_are_refused(spark):
    with open(PATH) as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": spec["model"] | {"ignore_merges": True}}, {"decoder": None}):
        with pytest.raises(ValueError):
            bpe.tables(spec | change)
    with pytest.raises(ValueError):
        bpe.tables(spec | {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]})


def test_longest_special_token_wins():
    with open(PATH) as f:
        spec = json.load(f)
    first = spec["added_tokens"][0]
    spec["added_tokens"] = [first, first | {"id": 50257, "content": "<|x"}, first | {"id": 50258, "content": "<|x|>"}]
    codec, library = bpe.Codec(bpe.tables(spec)), Tokenizer.from_str(json.dumps(spec))
    for text in ("a<|x|>b", "<|x <|x|", "<|endoftext|><|x|>x"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
