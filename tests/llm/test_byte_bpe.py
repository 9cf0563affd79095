import hashlib
import struct

import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.llm import byte_bpe
from loamline.llm.queries import multilingual_tokenizer
from tests.llm.helpers import awkward, empty

PATH, PATTERN = multilingual_tokenizer()


@pytest.fixture(scope="module")
def codec():
    tokens = byte_bpe.read_ranks(PATH)
    return byte_bpe.Codec(tokens, byte_bpe.serialise(tokens), PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_same_ids_as_the_library_and_round_trip(codec, reference, text):
    ids = codec.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_every_token_and_pairs_of_tokens(codec, reference):
    tokens = byte_bpe.read_ranks(PATH)
    for a, b in zip(tokens[::7], tokens[5::7]):
        raw = a + b
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference.encode_ordinary(text)


def test_pattern_splits_every_character_alike(codec, reference):
    split = regex.compile(PATTERN).findall
    for cp in [*range(0x3100), *range(0xFF00, 0x10000), *range(0x1F600, 0x1F650)]:
        if not 0xD800 <= cp < 0xE000:
            text = f"a{chr(cp)} 1{chr(cp)}"
            ids = codec.encode(text)
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference.encode_ordinary(text), hex(cp)
            assert "".join(split(text)) == text


def test_cache_limit_changes_nothing(codec, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_CACHED", 3)
    codec.clear()
    text = "some words and some more words and again some"
    assert codec.decode(codec.encode(text)) == text.encode()
    assert len(codec) <= 3


def test_awkward_rows(spark, reference):
    rows = awkward(spark).select("doc_id", "text").collect()
    out = byte_bpe.encode(awkward(spark), PATH, PATTERN, with_decoded=True).collect()
    assert len(out) == len(rows)
    for r, o in zip(rows, out):
        want = reference.encode_ordinary(r.text or "")
        assert o.doc_id == r.doc_id and o.n_tokens == len(want)
        assert hashlib.sha256(o.ids).digest() == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).digest()
        assert bytes(o.decoded) == (r.text or "").encode()


def test_decode_operator(spark):
    enc = byte_bpe.encode(awkward(spark), PATH, PATTERN)
    got = sorted((r.doc_id is None, r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(enc, PATH).collect() if r.doc_id is not None)
    want = sorted((False, r.doc_id, (r.text or "").encode()) for r in awkward(spark).collect() if r.doc_id is not None)
    assert got == want


def test_empty_table(spark):
    assert byte_bpe.encode(empty(spark), PATH, PATTERN, with_decoded=True).collect() == []
