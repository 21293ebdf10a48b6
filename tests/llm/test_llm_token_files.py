import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gatewire.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("kind", ["small", "any", "same", "outliers"])
def test_blocks_come_back(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "small": rng.integers(100, 164, n),
        "any": rng.integers(0, 2**32, n),
        "same": np.full(n, 7),
        "outliers": np.where(rng.random(n) < 0.02, rng.integers(0, 2**32, n), rng.integers(5, 9, n)),
    }[kind].astype(np.uint32)
    payload = token_files.encode_blocks(ids)
    assert token_files.decode_blocks(payload).tolist() == ids.tolist()
    for block in range(-(-n // token_files.BLOCK)):
        part = ids[block * token_files.BLOCK : (block + 1) * token_files.BLOCK]
        assert token_files.read_block(payload, block).tolist() == part.tolist()
    if kind == "outliers" and n == 5000:
        assert len(payload) < n  # two bits and a few exceptions, not 32 bits


def test_special_strings_are_what_the_library_takes_them_for(library):
    with open(PATH, "rb") as file:
        encoder = token_files.Encoder.of(file.read())
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    texts = [f"hello {s} world" for s in special] + [f"a{s}b{s}{s} .{s}\n{s}" for s in special]
    texts += [s.upper() for s in special] + [s[:-1] for s in special] + [f"{s[:3]} {s[3:]}" for s in special]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert special and encoder.encode(texts) == want


def test_words_cut_into_pieces_get_the_ids_of_the_library(library):
    with open(PATH, "rb") as file:
        encoder = token_files.Encoder.of(file.read())
    assert encoder.pattern
    rng = random.Random(11)
    some = [*"aBz'sStT09.,<|>=!_~-éÉΣσςßİıάΩКЖщ·½Ⅷ²中文あ가🙂—’…«»¿ªºⅧǅϴⴀᲐᏣꭰक़ि̸€№™𐐀𐞀ߪ\x1c\x7f\x85\xa0\u2028", "'re", "'LL", "ΑΣ", " "]
    texts = ["".join(rng.choices(some, k=rng.randrange(1, 14))) for _ in range(20_000)]
    texts += ["a" + chr(i) + "." for i in range(0x3000)]
    want = [np.array(c.ids, "<u4").tobytes() for c in library.encode_batch(texts, add_special_tokens=False)]
    got = encoder.encode(texts)
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_other_steps_go_through_the_library(library):
    with open(PATH, "rb") as file:
        steps = json.load(file)
    steps["normalizer"] = None
    content = json.dumps(steps)
    texts = ["Some WORDS, 12", "naïve"]
    want = [np.array(c.ids, "<u4").tobytes() for c in Tokenizer.from_str(content).encode_batch(texts, add_special_tokens=False)]
    assert token_files.Encoder(content.encode()).encode(texts) == want


def expected(rows, library):
    start, out = 0, []
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")) + sorted(
        (r for r in rows if r[0] is None), key=lambda r: r[1] or ""
    )
    for ident, text in order:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((ident, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=lambda r: r[1])


@pytest.mark.parametrize("segment", [token_files.SEGMENT_IDS, 50])
def test_odd_rows(odd_docs, odd_rows, library, segment, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", segment)
    got = token_files.write_and_read(odd_docs, PATH).orderBy("start").collect()
    assert list(map(tuple, got)) == expected([r[:2] for r in odd_rows], library)


def test_whole_table(documents, library):
    got = token_files.write_and_read(documents, PATH).orderBy("start").collect()
    assert list(map(tuple, got)) == expected([(r["doc_id"], r["text"]) for r in documents.collect()], library)


def test_empty_table(no_docs):
    assert token_files.write_and_read(no_docs, PATH).count() == 0


def test_words_are_encoded_as_in_their_text(library):
    with open(PATH, "rb") as file:
        encoder = token_files.Encoder.of(file.read())
    texts = ["", " a  b\n", "x\x1cy\x85z\xa0w", "ΟΔΥΣΣΕΥΣ ΣΑΣ", "é ́", "it's<|endoftext|>", "日本語 🙂🙂", "İI ſ K"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
