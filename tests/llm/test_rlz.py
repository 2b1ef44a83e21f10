import random
from collections import Counter

from panelcast.llm.rlz import remove_repeats

from .data import documents, sentence, texts, words


def brute(rows, k):
    seen = Counter(tuple(w[i : i + k]) for w in map(words, rows) for i in range(len(w) - k + 1))
    out = []
    for w in map(words, rows):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, rows, k, ids=None):
    ids = list(range(len(rows))) if ids is None else ids
    out = remove_repeats(documents(spark, rows, ids), k).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out)
    assert got == Counter((i, *x) for i, x in zip(ids, brute(rows, k), strict=True))
    return out


def test_equals_brute_force(spark):
    for k in (35, 12):
        check(spark, texts(3), k)


def test_stitched_passages_and_boundaries(spark):
    """Texts made of pieces of others: factors that touch, overlap, and end just short of a window."""
    rng = random.Random(7)
    source = [sentence(rng, 200, 100000) for _ in range(4)]
    rows = [" ".join(s) for s in source]
    for n in (34, 35, 36, 69, 70, 71):
        a, b = rng.sample(source, 2)
        rows.append(" ".join(a[:n] + b[50 : 50 + n]))
        rows.append(" ".join(["new"] * 3 + a[100 : 100 + n] + ["end"]))
    rows.append(" ".join(["again"] * 100))
    out = check(spark, rows, 35)
    assert max(r["n_factors"] for r in out) > 1


def test_odd_ids_and_empty_table(spark):
    long = " ".join(sentence(random.Random(2), 50, 100000))
    check(spark, [long, long, "few words", None], 35, [5, 5, None, None])
    assert remove_repeats(documents(spark, [])).count() == 0
