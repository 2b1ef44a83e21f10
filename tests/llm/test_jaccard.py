import itertools
import random

import numpy as np
import pytest

from panelcast.llm import graph, jaccard
from panelcast.llm.graph import components, stars
from panelcast.llm.jaccard import jaccard_components

from .data import documents, fold, sentence, texts, words


def shingles(text):
    w = words(fold(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(ids, rows):
    sets = [shingles(t) for t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(j)] = find(i)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return sorted((ids[k], len(sets[k]), least[find(k)]) for k in range(len(rows)))


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = texts(seed)
    assert got(jaccard_components(documents(spark, rows))) == brute(list(range(len(rows))), rows)


def test_large_groups_of_near_copies(spark):
    """Hundreds of texts around one origin, far and near, over a passage that all others share."""
    rng = random.Random(5)
    origin, passage = sentence(rng, 150, 5000), sentence(rng, 40, 5000)
    rows = []
    for k in range(160):
        copy = list(origin)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(100000)}"
        rows.append(" ".join(copy))
        rows.append(" ".join(passage + sentence(rng, rng.randrange(5, 60), 100000)))
    assert got(jaccard_components(documents(spark, rows))) == brute(list(range(len(rows))), rows)


def test_sets_that_cannot_reach_the_bound_sign_single_shingles():
    """All shingles in one segment: the pair differs there, so only single shingles can show the link."""
    a = np.arange(1, 41, dtype=np.uint64)
    tokens, offsets = np.concatenate((a, a[:-2])), np.array([0, 40, 78])
    signed = jaccard.Signed(tokens, offsets, False, True)
    mine, other = (set(signed.key[(signed.row == r) & (signed.weight == 1)].tolist()) for r in (0, 1))
    assert mine & other and (signed.slack == 0).all()


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = ["a b c d e f", "a b c d e f", "q r s t u v", None, ""]
    out = jaccard_components(documents(spark, rows, [7, 7, None, 4, 3])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == [
        ("3", 0, "3"), ("4", 0, "4"), ("7", 2, "7"), ("7", 2, "7"), ("None", 2, "None"),
    ]
    assert jaccard_components(documents(spark, [])).count() == 0
    lone = jaccard_components(documents(spark, ["a b c d e f", "a b c d e f"], [None, None])).collect()
    assert [r["component_id"] for r in lone] == [None, None]


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_a_path_a_cycle_and_a_star(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    edges = [(i + 1, i) for i in range(40)] + [(101, 102), (102, 103), (103, 101)] + [(500, 200 + i) for i in range(50)] + [(9, 9), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 101 for i in (101, 102, 103)}, **{i: 200 for i in [500, *range(200, 250)]}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    label = components(spark.createDataFrame(edges[:20] + edges[40:], "a bigint, b bigint"))
    again = components(stars(label).unionByName(spark.createDataFrame(edges[20:40], "a bigint, b bigint")))
    assert {r["node"]: r["label"] for r in again.collect()} == got


def test_short_near_copies_of_many_seeds(spark):
    """Groups of distinct short near copies: all signatures are shared widely, and the two sets of a pair differ in what they sign."""
    rows, want = [], []
    for seed in range(80):
        rng = random.Random(seed)
        origin = [f"g{seed}w{i}" for i in range(rng.randrange(8, 14))]
        copies = {" ".join(origin)}
        while len(copies) < 32:
            copy = list(origin)
            for _ in range(rng.randrange(1, 3)):
                at = rng.choice([0, len(copy) - 1, rng.randrange(len(copy))])
                copy[at : at + 1] = rng.choice([[], [f"g{seed}n{rng.randrange(99)}"], [f"g{seed}n{rng.randrange(99)}", copy[at]], [copy[at], f"g{seed}n{rng.randrange(99)}"]])
            copies.add(" ".join(copy))
        ids = list(range(len(rows), len(rows) + len(copies)))
        rows += sorted(copies)
        want += brute(ids, sorted(copies))
    assert got(jaccard_components(documents(spark, rows))) == sorted(want)
