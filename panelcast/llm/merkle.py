"""Merkle manifest of a table: a tree for each group over its rows in order, and a tree over the groups' roots.

Nodes are labelled by the interval [lo, hi) of leaf ranks they cover.  Levels are taken in bands of a few:
the nodes at the foot of a band that fall into one aligned interval make a block, whose inner nodes need
nothing from outside.  Ancestors are attached by joins on the block of the band, in which a node belongs to
the parents whose interval contains its own; what remains of a parent's interval without the node's own are
its siblings.  A band has 2**-levels of the nodes below it, so all bands together cost about one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.ranking import global_position
from panelcast.session import cut_lineage

_NODE = "struct<lo:bigint,hi:bigint,digest:binary>"


@dataclass(frozen=True)
class MerkleConfig:
    """``columns`` enter a leaf in this order; groups are hashed in runs of ``arity`` by ``order``."""

    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "lang"
    order: str = "doc_id"
    arity: int = 2
    band: int = 4


@dataclass(frozen=True)
class Tree:
    """Block tables of one forest, bottom band first, and the roots (tree, digest) of its trees."""

    bands: tuple[DataFrame, ...]
    roots: DataFrame
    arity: int
    band: int

    def span(self, k: int) -> int:
        """Leaf ranks that a node at the foot of band ``k`` covers."""
        return self.arity ** (self.band * k)


@dataclass(frozen=True)
class Manifest:
    """Leaves (row, tree, n, lo, leaf, altered), groups (group, tree, n), the groups' trees and the tree over their roots."""

    leaves: DataFrame
    groups: DataFrame
    trees: Tree
    top: Tree


def leaf_digest(columns: Sequence[str | Column]) -> Column:
    """SHA-256 of the values: ``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    texts = [(F.col(f"`{c}`") if isinstance(c, str) else c).cast("string") for c in columns]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(run: Column) -> Column:
    """Digest of the digests of a run, as lowercase hex one after another."""
    return F.unhex(F.sha2(F.array_join(F.transform(run, lambda x: _hex(x["digest"])), "").cast("binary"), 256))


def _block(lo: str, span: int) -> Column:
    """Number of the aligned interval of ``span`` leaf ranks that a rank falls into."""
    return F.expr(f"{lo} div {span}L")


def _cut(nodes: Column, arity: int):
    return lambda at: F.slice(nodes, at, arity)


def _family(step: int):
    return lambda run: F.struct(F.lit(step).alias("step"), run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), run.alias("run"))


def _blocks(nodes: DataFrame, foot: int, arity: int, band: int) -> DataFrame:
    """One row a block: families (level, lo, hi, run of children) of all parents in it, and the node above all of them.

    A tree of ``n`` leaves has a parent level over nodes of ``width`` leaves only if n > width.
    """
    kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
    rows = nodes.groupBy("tree", "n", _block("lo", foot * arity**band).alias("bucket")).agg(kids.alias("_level_0"))
    for j in range(band):
        width = foot * arity**j
        below = F.col(f"_level_{j}")
        runs = F.transform(F.sequence(F.lit(1), F.size(below), F.lit(arity)), _cut(below, arity))
        goes_on = F.col("n") > width
        rows = rows.withColumn(f"_runs_{j}", F.when(goes_on, runs).otherwise(F.array().cast(f"array<array<{_NODE}>>")))
        parents = F.transform(
            f"_runs_{j}", lambda run: F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), _hash(run).alias("digest"))
        )
        rows = rows.withColumn(f"_level_{j + 1}", F.when(goes_on, parents).otherwise(below))
    families = [F.transform(f"_runs_{j}", _family(j)) for j in range(band)]
    return rows.select("tree", "n", "bucket", F.concat(*families).alias("families"), F.col(f"_level_{band}")[0].alias("top"))


def build(leaves: DataFrame, largest: int, arity: int, band: int) -> Tree:
    """All trees over ``leaves`` (tree, n, lo, digest), the largest of which has ``largest`` leaves."""
    nodes = leaves.select("tree", "n", "lo", (F.col("lo") + 1).alias("hi"), "digest")
    bands, roots, foot = [], None, 1
    while True:
        blocks = cut_lineage(_blocks(nodes, foot, arity, band))
        bands.append(blocks)
        foot *= arity**band
        done = blocks.where(F.col("n") <= foot).select("tree", F.col("top.digest").alias("digest"))
        roots = done if roots is None else roots.unionByName(done)
        if largest <= foot:
            return Tree(tuple(bands), roots, arity, band)
        nodes = blocks.where(F.col("n") > foot).select("tree", "n", "top.*")


def manifest(docs: DataFrame, config: MerkleConfig = MerkleConfig(), keep: Sequence[str] = ("doc_id",), altered: Column | None = None) -> Manifest | None:
    """The manifest of all rows of ``docs``; None for an empty table.

    Groups come in order of their value, null first, strings by bytes; rows of a group in order of ``order``,
    null first, then by digest; rows repeated whole are leaves of their own.  Nulls enter a leaf as ``-``, an
    empty text as ``0:``.  Other columns than those of the configuration and ``keep`` are not read.  ``altered``
    is the digest of a changed row, null where it is unchanged; it does not enter the tree.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{config.group}`").alias("group"), F.col(f"`{config.order}`").alias("order"),
        leaf_digest(config.columns).alias("leaf"), (F.lit(None).cast("binary") if altered is None else altered).alias("altered"),
        F.rand(1).alias("spread"),  # orders rows repeated whole, however many there are
    )
    placed = global_position(rows, ["group", "order", "leaf", "spread"], "at")
    sizes = placed.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = cut_lineage(global_position(sizes, ["group"], "tree"))
    largest, number = groups.agg(F.max("n"), F.count("*")).first()
    if not number:
        return None
    joined = placed.withColumnRenamed("group", "_group").join(groups, F.col("_group").eqNullSafe(F.col("group")))
    leaves = cut_lineage(joined.select("row", "tree", "n", (F.col("at") - F.col("first")).alias("lo"), "leaf", "altered"))
    trees = build(leaves.withColumnRenamed("leaf", "digest"), largest, config.arity, config.band)
    above = trees.roots.select(F.lit(0).cast("bigint").alias("tree"), F.lit(number).cast("bigint").alias("n"), F.col("tree").alias("lo"), "digest")
    return Manifest(leaves, groups.select("group", "tree", "n"), trees, build(above, number, config.arity, config.band))


def _siblings(lo: Column, hi: Column) -> Column:
    """Of the families whose interval contains [lo, hi), bottom up: hex digests of the children before and after it."""
    holds = F.filter("families", lambda f: (f["lo"] <= lo) & (hi <= f["hi"]))

    def rest(f: Column) -> Column:
        before = F.filter(f["run"], lambda x: x["hi"] <= lo)
        after = F.filter(f["run"], lambda x: x["lo"] >= hi)
        text = [F.array_join(F.transform(s, lambda x: _hex(x["digest"])), "") for s in (before, after)]
        return F.struct(text[0].alias("before"), text[1].alias("after"))

    return F.transform(holds, rest)


_PATH = "array<struct<before:string,after:string>>"


def _paths(tree: Tree, above: DataFrame) -> DataFrame:
    """(tree, at, path, root, crown) of every block of the bottom band: what lies above its top node, down from the roots.

    ``above`` has (tree, path, root) of the trees' roots; crown is the root of the block's own tree.
    """
    roots = tree.roots.join(above, "tree").select("tree", F.lit(0).cast("bigint").alias("at"), "path", "root", F.col("digest").alias("crown"))
    found = None
    for k in range(len(tree.bands) - 1, -1, -1):
        span = tree.span(k + 1)
        ends = tree.bands[k].where(F.col("n") <= span).select("tree").join(roots, "tree")
        level = ends
        if found is not None:  # nodes at the foot of band k + 1 are the tops of blocks of band k that go on
            tops = tree.bands[k].where(F.col("n") > span).select("tree", F.col("bucket").alias("at"), "top.lo", "top.hi")
            wide = tree.span(k + 2)
            upper = tree.bands[k + 1].select("tree", "bucket", "families").join(found.withColumnRenamed("at", "bucket"), ["tree", "bucket"])
            inner = tops.withColumn("bucket", _block("lo", wide)).join(upper, ["tree", "bucket"])
            path = F.concat(_siblings(F.col("lo"), F.col("hi")), F.col("path"))
            level = level.unionByName(inner.select("tree", "at", path.alias("path"), "root", "crown"))
        found = cut_lineage(level)
    return found


def _attached(leaves: DataFrame, tree: Tree, above: DataFrame) -> DataFrame:
    """``leaves`` (tree, lo, ...) with path, root and crown."""
    bottom = tree.bands[0].select("tree", "bucket", "families").join(_paths(tree, above).withColumnRenamed("at", "bucket"), ["tree", "bucket"])
    rows = leaves.withColumn("bucket", _block("lo", tree.span(1))).join(bottom, ["tree", "bucket"])
    own = _siblings(F.col("lo"), F.col("lo") + 1)
    return rows.withColumn("path", F.concat(own, F.col("path"))).drop("bucket", "families")


def proofs(m: Manifest) -> DataFrame:
    """row, leaf, altered, path (siblings before and after, level by level), subroot and root of every leaf; digests in hex."""
    none = F.array().cast(_PATH)
    top = m.top.roots.select("tree", none.alias("path"), F.col("digest").alias("root"))
    roots = m.trees.roots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("lo"))
    above = _attached(roots, m.top, top).select(F.col("lo").alias("tree"), "path", "root")
    found = _attached(m.leaves, m.trees, above)
    digests = [_hex(F.col(a)).alias(b) for a, b in (("leaf", "leaf"), ("altered", "altered"), ("crown", "subroot"), ("root", "root"))]
    return found.select("row", "path", *digests)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]).cast("binary"), 256))


def nodes(m: Manifest) -> DataFrame:
    """The manifest as a table: tree (null for the tree over the groups), level, lo, hi and digest of every node."""
    parts = []
    for tree, name in ((m.trees, F.col("tree")), (m.top, F.lit(None).cast("bigint"))):
        for k, blocks in enumerate(tree.bands):
            kids = blocks.select(name.alias("tree"), F.explode("families").alias("f")).select("tree", (F.lit(tree.band * k) + F.col("f.step")).alias("level"), F.explode("f.run").alias("x"))
            parts.append(kids.select("tree", "level", "x.lo", "x.hi", _hex(F.col("x.digest")).alias("digest")))
            last = blocks.where(F.col("n") <= tree.span(k + 1)).select(name.alias("tree"), "n", "top.*")
            steps = [F.when(F.col("n") > tree.arity**j, 1).otherwise(0) for j in range(tree.band * (k + 1))]
            parts.append(last.select("tree", sum(steps, F.lit(0)).alias("level"), "lo", "hi", _hex(F.col("digest")).alias("digest")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
