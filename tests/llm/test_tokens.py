"""Ops 1 and 5 against the libraries that own the vocabularies."""

import hashlib
import random
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import bpe, tokencount

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"aabcdeth  '’\n\t.,!?0123½²ªſΣσςİǅéñßÀ̧́​　\x1c\x1f\x00\x85日本한ᄀ가🎉‍▁_-<|>", "<|endoftext|>", "'s", "'ll", "the", "ing", " the", "<0x41>", "</s>", "ΑΣ "]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE)


def texts():
    rng = random.Random(4)
    return [None, "", *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(1200)), "a" * 30000, "ab" * 9000, "hahaha" * 3000 + "x", " " * 3000, "é" * 5000, "".join(rng.choice("thein") for _ in range(20000))]


def test_encode_and_count(libraries):
    owner, pieces = libraries
    model, counter = bpe.word_bpe(WORD), tokencount.piece_counter(PIECE)
    every = texts()
    digests, totals = model.digests(every), counter.totals([t or "" for t in every])
    for text, (n, of_ids, of_text, chars), total in zip(every, digests, totals):
        ids = owner.encode(text or "", add_special_tokens=False).ids
        decoded = owner.decode(ids, skip_special_tokens=False)
        assert model.encode(text) == ids and n == len(ids) and model.decode(ids) == decoded
        assert of_ids == hashlib.sha256(struct.pack(f"<{n}I", *ids)).hexdigest() and of_text == hashlib.sha256(decoded.encode()).hexdigest()
        assert total == counter(text) == len(pieces.encode(text or ""))
        whole = bpe.TextDecoder(model.bytes)
        assert chars == len(whole.feed(np.array(ids, np.int32)) + whole.finish())


def test_every_code_point(libraries):
    owner, _ = libraries
    model = bpe.word_bpe(WORD)
    texts = []
    for low in range(0, 0x30000, 64):
        some = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000]
        texts += ["".join(f"a{c}b {c} x{c}1 " for c in some)] if some else []
    for text, e in zip(texts, owner.encode_batch(texts, add_special_tokens=False)):
        if model.encode(text) != e.ids:
            wrong = [f"U+{ord(c):04X}" for c in sorted(set(text)) if model.encode(f"a{c}b {c} x{c}1") != owner.encode(f"a{c}b {c} x{c}1", add_special_tokens=False).ids]
            assert not wrong, wrong


def test_texts_in_parts_and_a_small_memory(libraries, monkeypatch):
    owner, _ = libraries
    rng = random.Random(6)
    words = ["".join(rng.choice("theinaoué1'-") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    every = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["x" * 9000 + " <|endoftext|>" + "y z" * 50, None, "\u2003 \n"]
    monkeypatch.setattr(bpe, "SLICE_BYTES", 700)
    model = bpe.WordBpe(WORD, memory=150)
    for text, (n, of_ids, of_text, _) in zip(every, model.digests(every)):
        ids = owner.encode(text or "", add_special_tokens=False).ids
        assert n == len(ids) and of_ids == hashlib.sha256(struct.pack(f"<{n}I", *ids)).hexdigest()
        assert of_text == hashlib.sha256(owner.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert len(model.place) < 2000


def test_a_merge_before_its_sides_is_refused():
    assert bpe.is_proper([("a", "b"), ("ab", "c")], set("abc")) and not bpe.is_proper([("ab", "c"), ("a", "b")], set("abc"))


def test_transducer_is_independent_of_how_the_input_is_cut():
    model = bpe.word_bpe(WORD)
    rng = random.Random(1)
    word = "".join(rng.choice("thein") for _ in range(20000))
    whole = model.merge([*word[:-1], word[-1] + model.ending])
    for block in (1, 7, 5000):
        run, out = bpe.Transducer(model.merge, model.lookahead, block), []
        for at in range(0, len(word), 997):
            out += run.feed(list(word[at : at + 997]))
            assert len(run.held) <= model.lookahead + block + bpe.BLOCK
        assert out + list(run.finish(model.ending)) == whole


def test_lookahead_bounds_how_far_an_end_reaches():
    model = bpe.word_bpe(WORD)
    rng = random.Random(2)
    for _ in range(60):
        stem = [rng.choice("theinaou") for _ in range(3000)]
        ends = [model.merge(stem + [rng.choice("theinaou") for _ in range(40)]) for _ in range(3)]
        safe = 3000 - model.lookahead
        heads = []
        for tokens in ends:
            at, head = 0, []
            for t in tokens:
                if at + len(t) > safe:
                    break
                at += len(t)
                head.append(t)
            heads.append(head)
        assert heads[0] == heads[1] == heads[2]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 7))
def test_decoder_matches_utf8_with_replacement(data, block):
    model = bpe.word_bpe(WORD)
    ids, decoder = model.inner[np.frombuffer(data, np.uint8)], bpe.TextDecoder(model.bytes)
    got = ""
    for at in range(0, len(ids), block):
        got += decoder.feed(ids[at : at + block])
        assert len(decoder.held) < 4
    assert got + decoder.finish() == data.decode("utf-8", "replace")


def test_round_trip():
    model = bpe.word_bpe(WORD)
    decoder, ids = bpe.TextDecoder(model.bytes), np.array(model.encode("Héllo wörld 日本 again"), np.int32)
    assert "".join(decoder.feed(ids[i : i + 1]) for i in range(len(ids))).strip() == "héllo wörld 日本 again"


def test_awkward_rows(awkward, nothing):
    rows = bpe.encode_documents(awkward, WORD, with_ids=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == awkward.count() and all(r.n_tokens == len(r.ids) for r in rows)
    assert {r.ids_sha256 for r in rows if r.doc_id in (3, 4, 5)} == {empty}
    counts = tokencount.count_documents(awkward, PIECE, 100).collect()
    assert len(counts) == len(rows) and Counter(r.over_limit for r in counts)[True] == 2
    assert bpe.encode_documents(nothing, WORD).count() == tokencount.count_documents(nothing, PIECE).count() == 0


def test_slices_keep_every_row_in_order():
    import pyarrow as pa

    texts = [None, "", "abc" * 5, "x" * 40, None, "é" * 9, "y", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(bpe.slices(batch, 1, most=16))
    assert len(parts) > 2 and [r for p in parts for r in p.column(0).to_pylist()] == list(range(len(texts)))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert list(bpe.slices(batch.slice(0, 0), 1)) == []
    model = bpe.word_bpe(WORD)
    packed = bytearray()
    counts = [n for n, *_ in model.digests(["Hello there", None, "naïve 日本"], packed)]
    ids = list(struct.unpack(f"<{len(packed) // 4}I", packed))
    assert counts[1] == 0 and ids == model.encode("Hello there") + model.encode("naïve 日本") and sum(counts) == len(ids)
