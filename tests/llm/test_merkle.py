import hashlib
import math

import pytest
from pyspark.sql import functions as F

from panelcast.llm import merkle
from panelcast.llm.merkle import MerkleConfig

from .data import documents, texts


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level, arity):
    """Every level of a tree, and for each leaf the siblings (before, after) on the way up."""
    levels, paths = [level], [[] for _ in level]
    while len(level) > 1:
        width = arity ** (len(levels) - 1)
        for i, p in enumerate(paths):
            at = i // width
            lo = at // arity * arity
            p.append(("".join(level[lo:at]), "".join(level[at + 1 : lo + arity])))
        level = [h("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        levels.append(level)
    return levels, paths


def brute(rows, arity=2):
    """(doc_id, leaf, path, subroot, root) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])], arity) for g in names}
    top, above = climb([trees[g][0][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for (known, i, digest), own in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.append((i if known else None, digest, tuple(own + above[k]), trees[g][0][-1][0], top[-1][0]))
    return out, trees, top


def table(spark, n, langs, extra=()):
    rows = [((i * 7919) % (2 * n) if i % 17 else None, f"s{i % 3}" if i % 5 else None, langs[i * i % len(langs)], i if i % 4 else None, t) for i, t in enumerate((texts() * 40)[:n])]
    rows += [rows[i] for i in extra]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, lo int")


@pytest.mark.parametrize("n, langs, arity, band", [
    (1, ["en"], 2, 4), (2, [None], 2, 4), (3, ["en", None, "é", "z", "en"], 2, 1), (97, ["en", "en", "en", "de", None], 2, 4), (300, [None, "en", "é", "zz", "a", "b", "c"], 2, 2),
    (513, ["en"], 2, 4), (260, ["en", "de"], 3, 2), (270, [f"l{i}" for i in range(19)], 2, 1), (64, ["x"], 2, 3),
])
def test_equals_brute_force(spark, n, langs, arity, band):
    rows, df = table(spark, n, langs, extra=[0] * (n // 3))
    m = merkle.manifest(df, MerkleConfig(arity=arity, band=band))
    got = [(r["row"]["doc_id"], r["leaf"], tuple(map(tuple, r["path"])), r["subroot"], r["root"]) for r in merkle.proofs(m).collect()]
    want, trees, top = brute(rows, arity)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    number = {r["group"]: r["tree"] for r in m.groups.collect()}
    labels = {}
    for g, (levels, _) in [*((number[g], t) for g, t in trees.items()), (None, (top, None))]:
        count = len(levels[0])
        for level, digests in enumerate(levels):
            for i, digest in enumerate(digests):
                labels[g, level, i * arity**level, min(count, (i + 1) * arity**level)] = digest
    found = merkle.nodes(m).collect()
    assert len(found) == len(labels) and {(r["tree"], r["level"], r["lo"], r["hi"]): r["digest"] for r in found} == labels


def test_folding_tells_what_was_altered(spark):
    rows, df = table(spark, 230, ["en", "de", None])
    changed = F.when(F.col("n_chars") % 3 == 0, merkle.leaf_digest(["doc_id", "source", "lang", F.col("n_chars") + 1, "text"]))
    m = merkle.manifest(df, altered=changed)
    again = merkle.folded(F.coalesce("altered", "leaf"), F.col("path")).alias("again")
    out = merkle.proofs(m).select("row", "leaf", "path", "root", again, merkle.proof_digest(F.col("path")).alias("proof")).collect()
    by_leaf = {leaf(r): r for r in rows}
    for r in out:
        own = by_leaf[r["leaf"]]
        x = leaf((*own[:3], own[3] + 1, own[4])) if own[3] is not None and own[3] % 3 == 0 else r["leaf"]
        for before, after in r["path"]:
            x = h(before + x + after)
        assert r["again"] == x and (x == r["root"]) == (own[3] is None or own[3] % 3 != 0)
        assert r["proof"] == h("".join(a + b for a, b in r["path"]))


def test_edge_texts_and_empty_table(spark):
    df = documents(spark)
    m = merkle.manifest(df)
    want, _, _ = brute([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()])
    assert sorted((r["row"]["doc_id"], r["leaf"], r["root"]) for r in merkle.proofs(m).collect()) == sorted((w[0], w[1], w[4]) for w in want)
    assert merkle.manifest(documents(spark, [])) is None


def test_one_row_repeated_is_many_leaves(spark):
    df = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("t").alias("text"))
    m = merkle.manifest(df)
    root = brute([(5, "s", "en", 1, "t")] * 3000)[0][0][4]
    out = merkle.proofs(m).select(merkle.folded(F.col("leaf"), F.col("path")).alias("x"), F.size("path").alias("n")).collect()
    assert {r["x"] for r in out} == {root} and len(out) == 3000 and {r["n"] for r in out} == {math.ceil(math.log2(3000))}


def test_a_very_long_text(spark):
    long = "word " * 10_000_000
    df = spark.createDataFrame([(1, "s", "en", 5, long), (2, "s", "en", 6, None)], "doc_id long, source string, lang string, n_chars long, text string")
    out = {r["row"]["doc_id"]: r["leaf"] for r in merkle.proofs(merkle.manifest(df)).select("row", "leaf").collect()}
    assert out[1] == leaf((1, "s", "en", 5, long)) and out[2] == leaf((2, "s", "en", 6, None))
