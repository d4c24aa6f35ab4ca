import random
import re

import numpy as np

from palimpsest.llm import wordhash as wh


def test_equal_words_hash_alike_anywhere():
    texts = ["a b  c", None, "", " \t\n", "c b a é", "A b", "x" * 50, "\x1cone\x0bword"]
    words = wh.hash_words(texts)
    assert words.counts().tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    h = words.hashes
    assert h[0] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 8
    assert wh.hash_words(["A B"], lower=True).hashes.tolist() == h[:2].tolist()


def test_slices_do_not_show(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["y" * 999 + " z"]
    whole = wh.hash_words(texts)
    monkeypatch.setattr(wh, "SLICE_BYTES", 101)
    parts = wh.hash_words(texts)
    assert (whole.hashes == parts.hashes).all() and (whole.first == parts.first).all()


def test_no_collisions():
    words = wh.hash_words([" ".join(f"{a}{b}" for a in range(600) for b in ("x", "ab", "ba", "aab"))])
    assert len(np.unique(words.hashes)) == 2400


def test_sliding():
    x = np.asarray([5, 1, 4, 4, 9, 0, 7])
    for width in range(1, 8):
        assert wh.sliding(x, width).tolist() == [x[i : i + width].min() for i in range(8 - width)]
