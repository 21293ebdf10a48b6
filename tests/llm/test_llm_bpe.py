import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gatewire.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as file:
        return bpe.Codec.of(file.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids_of(codec, texts):
    out = [b""] * len(texts)
    for number, ids, _ in codec.encode(texts):
        out[number] += ids
    return out


def odd_texts():
    rnd = random.Random(5)
    return [
        "", "a", " ", "\n", "it's I'LL don't", "<|endoftext|>", "a" * 3000, "ab" * 700, "é" * 200, "=" * 500, " " * 300 + "x",
        "日本語テキスト🙂🙂", "x\x1cy\x85z​ ", "".join(rnd.choice("etaoin") for _ in range(600)),
        "".join(chr(rnd.choice([rnd.randrange(32, 0x500), rnd.randrange(0xE000, 0x1FFFF)])) for _ in range(3000)),
    ]


def test_ids_are_the_librarys(codec, library):
    texts = odd_texts()
    for text, ids in zip(texts, ids_of(codec, texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:30]


def test_decoding_gives_the_bytes_back(codec):
    texts = odd_texts()
    assert codec.decode(ids_of(codec, texts)) == [t.encode() for t in texts]


def test_small_caches_and_blocks_change_nothing(codec, monkeypatch):
    texts = odd_texts()
    whole = ids_of(codec, texts)
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 400)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    codec.known = {}
    assert ids_of(codec, texts) == whole


def test_rows(spark, odd_docs, odd_rows, library):
    got = bpe.encode_and_decode(odd_docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    want = []
    for row in odd_rows:
        ids = library.encode_ordinary(row[1] or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((row[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest(), ids))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_table(no_docs):
    assert bpe.encode_and_decode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
