import random

import numpy as np
import pytest
import tiktoken

from factloom.llm import bpe
from factloom.llm.bpe import PATTERN, VOCABULARY, decode, encode, vocabulary

MULTI = VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")


@pytest.mark.parametrize("path", [VOCABULARY, MULTI])
def test_ids_are_those_of_merging(path, plain):
    v = vocabulary(path)
    merged = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(2)
    odd = ["", " ", "  a  b \n\n c", "I'll we've don't 'S", "日本語 😀", "a\tb", " lead", "trail ", "<|endoftext|>", "\r\n  \r\n x", "x" * 3000]
    odd += ["".join(rng.choice(" \n\ta'.é1xZ ") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    for text in odd + plain:
        ids = np.frombuffer(v.encode(text), np.int32)
        assert ids.tolist() == merged.encode_ordinary(text)
        assert v.decode(ids) == text.encode()


def test_small_cache_changes_nothing(monkeypatch, plain):
    v = vocabulary(VOCABULARY)
    want = [v.encode(t) for t in plain[:20]]
    monkeypatch.setattr(bpe, "CACHE", 3)
    v.pieces.clear()
    v.plain.clear()
    assert [v.encode(t) for t in plain[:20]] == want


def test_edges_and_round_trip(messy, nothing):
    out = encode(messy, keep=["doc_id", "d"], verify=True)
    rows = out.collect()
    assert len(rows) == messy.count() and out.columns == ["doc_id", "d", "token_ids", "n_tokens", "round_trip"]
    assert all(r.round_trip is not False for r in rows)
    assert sum(r.token_ids is None for r in rows) == 2 and [r.n_tokens for r in rows if r.doc_id == 4] == [0]
    texts = sorted(t for (t,) in messy.where("text is not null").select("text").collect())
    assert sorted(r.text for r in decode(encode(messy)).where("text is not null").select("text").collect()) == texts
    assert encode(nothing).count() == 0 and "copy" in encode(nothing).columns


def test_what_comes_up_again_is_not_encoded_anew_when_the_cache_is_full(monkeypatch):
    """A frequent word stays while rare ones come and go, a word that a piece holds is that of the piece alone, and what is kept has a bound."""
    v = vocabulary(VOCABULARY)
    v.forget()
    asked = []
    real = v.encode_word
    monkeypatch.setattr(v, "encode_word", lambda word: asked.append(word) or real(word))
    monkeypatch.setattr(bpe, "CACHE", 50)
    merged = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(5)
    for i in range(400):
        rare = ["".join(rng.choices("abdeiknorstu", k=9)) for _ in range(2)]
        text = f"On xylograph {rare[0]} xylograph, {rare[1]}.\nXylograph {i}"
        assert np.frombuffer(v.encode(text), np.int32).tolist() == merged.encode_ordinary(text)
    assert asked.count(b" xylograph") == 1 and asked.count(b",") == 1
    assert max(map(len, (v.pieces, v.older, v.plain))) <= 50
    v.forget()
    assert not (v.pieces or v.older or v.plain or v.compatible_pairs)
