"""Pairs that cannot link are left out before their texts are fetched, and none that can."""

import random

import numpy as np

from panelcast.llm import jaccard
from panelcast.llm.jaccard import jaccard_components

from .data import documents, sentence
from .test_jaccard import brute, got


def test_long_texts_that_share_half_are_not_fetched(spark, monkeypatch):
    """A histogram of 256 cells evens out the differences of long texts; one pair in ten is a link here."""
    rng = random.Random(3)
    rows = []
    for k in range(20):
        body = sentence(rng, 3000, 100000)
        cut = 2900 if k % 10 == 0 else 2100
        rows += [" ".join(body), " ".join(body[:cut] + sentence(rng, 3000 - cut, 100000))]
    fetched, old = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda *a: fetched.append(a[-2].count()) or old(*a))
    assert got(jaccard_components(documents(spark, rows))) == brute(list(range(len(rows))), rows)
    assert sum(fetched) == 2


def test_unequal_cells_are_at_most_the_differences():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 31, 32, 33, 60, 64, 65, 500, 512, 513, 900, 4096, 5000]
    left, right, apart = [], [], []
    for n in sizes:
        for change in (0, 1, n // 7, n // 3, n):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            b = np.unique(np.concatenate((a[change:], rng.integers(0, 2**64, change + n // 4, np.uint64))))
            left.append(a)
            right.append(b)
            apart.append(len(np.setxor1d(a, b)))
    cells = [jaccard._parities(np.concatenate(x), np.concatenate(([0], np.cumsum([len(s) for s in x])))) for x in (left, right)]
    unequal = jaccard._unequal(*cells)
    assert (unequal <= apart).all() and (unequal % 2 == np.array(apart) % 2).all()
    n, m = (np.array([len(s) for s in x]) for x in (left, right))
    far = (n >= 500) & (np.array(apart) > (n + m) * 0.4)  # the limit of a link is a seventh
    assert far.sum() >= 10 and (unequal[far] > (n + m)[far] // 7).all()
    assert jaccard._parities(np.empty(0, np.uint64), np.array([0, 0])) == [bytes(jaccard.LEAST_CELLS // 8)]
    assert not len(jaccard._unequal([], []))
