import random
import re

import numpy as np
import pytest

from spindrift.llm import dart_minhash as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def raw(text):
    return np.frombuffer(text.encode(), dtype=np.uint8)


def test_words_are_hashed_apart(monkeypatch):
    text = "One two, TWO one été Été 12 x" + "y" * 300 + " one"
    h = D.word_hashes(raw(text))
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    assert len(h) == len(words)
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(len(h)))
    monkeypatch.setattr(D, "BLOCK_BYTES", 7)
    assert (D.word_hashes(raw(text)) == h).all()
    assert len(D.word_hashes(raw(""))) == 0 == len(D.word_hashes(raw(" ., ")))


def test_shingles():
    a, b = D.shingles(raw("a b c d e f")), D.shingles(raw("x a b c d e"))
    assert len(a) == len(b) == 2 and a[0] == b[1]
    assert len(D.shingles(raw("a b"))) == 1 and D.shingles(raw("a b"))[0] != D.shingles(raw("b a"))[0]
    assert len(D.shingles(raw(""))) == 0


@pytest.mark.parametrize("n", [1, 3, 60, 2000, 30000])
@pytest.mark.parametrize("share", [0.3, 0.8])
def test_agreement_is_jaccard(n, share):
    rng = np.random.default_rng(n)
    k, same, both = 256, int(round(n * share)), []
    for _ in range(12 if n < 10000 else 3):
        pool = rng.integers(0, 1 << 63, 2 * n - same).astype(np.uint64)
        a, b = pool[:n], pool[n - same :]
        both.append((D.signature(a, k) == D.signature(b, k)).mean())
    want = same / (2 * n - same)
    assert abs(np.mean(both) - want) < 4 * max(0.02, np.sqrt(want * (1 - want) / (k * len(both))))


def test_weighted_agreement_is_weighted_jaccard():
    rng, got, want = np.random.default_rng(1), [], []
    for _ in range(20):
        e = rng.integers(0, 1 << 63, 80).astype(np.uint64)
        x, y = rng.choice([0, 0.4, 1, 2.5, 7], 80), rng.choice([0, 0.4, 1, 2.5, 7], 80)
        got.append((D.signature(e, 256, x) == D.signature(e, 256, y)).mean())
        want.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(got) - np.mean(want)) < 0.03
    assert len(D.signature(e, 256, np.zeros(80))) == 0 and (D.signature(e, 64, np.ones(80)) != 0).all()


def test_order_does_not_matter():
    random.seed(2)
    e = np.array([random.getrandbits(63) for _ in range(100)], dtype=np.uint64)
    assert (D.signature(e, 60) == D.signature(e[::-1].copy(), 60)).all()
    assert len(set(D.bands(D.signature(e, 60), 6).tolist())) == 10
