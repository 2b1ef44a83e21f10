"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage


def stars(label: DataFrame) -> DataFrame:
    """The links of a component table: as many as nodes, so that more links can be added to it cheaply."""
    return label.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


#: A graph of at most this many links has its minima sent to every task; a larger one joins them by shuffle.
FEW = 200_000


def by_size(df: DataFrame) -> DataFrame:
    """For the side of a join: a table of a few numbers a row is counted, and sent to every task if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def _with_least(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    return edges.join(F.broadcast(least) if few else least, "a")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both.where("b > a"), least, few).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(edges, least, few).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node with a link; label is the least node it can reach.

    ``links`` has columns a and b of one orderable type; loops, repeats and either direction are
    fine, rows with a null are ignored, an empty table gives an empty one.  Every round is written to
    the shared folder; minima are aggregated before they meet their neighbours, so a hub with
    millions of links costs one row in the aggregate.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    before = _state(edges)
    while before[0]:
        few = before[0] <= FEW
        edges = cut_lineage(_small_star(cut_lineage(_large_star(edges, few)), few))
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
