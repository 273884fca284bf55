"""Byte kernels and tokenization against plain Python and the library."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from basalt.llm import kernels as K
from basalt.llm import tokenization as T


def batch(texts):
    return pa.record_batch({"text": pa.array(texts, pa.string())})


def test_words_of_blocks():
    texts = ["a bb\tccc", "", None, "  x\u00a0y \x0b z ", "é" * 10, "w " * 700_000, "y" * 1_500_000 + " end"]
    got = []
    for first, end, data, bounds in K.blocks(batch(texts), "text"):
        starts, ends, at = K.words(data, bounds, K.SPACE)
        for d in range(end - first):
            got.append([data[a:b].tobytes() for a, b in zip(starts[at[d] : at[d + 1]], ends[at[d] : at[d + 1]], strict=True)])
    assert got == [(t or "").encode().split() for t in texts]


def test_hashes_tell_words_apart_wherever_they_stand():
    rng = random.Random(1)
    own = ["".join(rng.choices("ab\u00e9", k=rng.randint(1, 6))) for _ in range(5000)]
    data = np.frombuffer(" ".join(own).encode(), np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]), K.SPACE)
    hashes = K.hash_words(data, starts, ends)
    seen = {}
    for w, h in zip(own, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_giant_words():
    data = np.frombuffer(b"z" * 3_000_000 + b" " + b"z" * 3_000_000 + b" " + b"z" * 2_999_999, np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]), K.SPACE)
    a, b, c = K.hash_words(data, starts, ends).tolist()
    assert a == b != c


PIECES = ["it's", "I'LL", "don't", "caf\u00e9", "\u00c9cole", "\u0130stanbul", "\u03a3\u0391\u03a3", "\u6570\u636e", "12ab3", "x\u00b2", "\u00b5m", "<|endoftext|>", "a<|b", "e\u0301t", "...", "??!a", "\u00d7\u00f7", "\x1c", "\u2028", "\u00a0", "\u200b", "na\u00efve,", "\U0001f600ok", "'s", "''re", "\x7f", "\x00", "\u00c3", "\u00df", "A|B", "#tag", "\u0f0b"]


@pytest.mark.parametrize("seed", range(6))
def test_ids_are_the_library_s(seed):
    rng = random.Random(seed)
    enc = T.PieceEncoder(T.default_path())
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", " ", "\n", "\u3000"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, ""]
    for first, end, data, bounds in K.blocks(batch(texts), "text"):
        ids, at = enc.encode_block(data, bounds)
        for d in range(end - first):
            want = enc.tokenizer.encode(texts[first + d] or "", add_special_tokens=False).ids
            assert ids[at[d] : at[d + 1]].tolist() == want, texts[first + d]


def test_a_full_store_starts_anew(monkeypatch):
    monkeypatch.setattr(T, "MAX_PIECES", 50)
    enc = T.PieceEncoder(T.default_path())
    rng = random.Random(2)
    for _ in range(5):
        text = " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(80))
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = enc.encode_block(data, np.array([0, len(data)]))
        assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_separators_of_item_words():
    text = "A-b_c 12\u00e9x\x7fQ".encode()
    data = np.frombuffer(text, np.uint8)
    low = K.LOWER[data]
    starts, ends, _ = K.words(low, np.array([0, len(low)]), K.NOT_ALNUM)
    want = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    assert [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == want
