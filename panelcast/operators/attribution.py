"""Shapley contributions of features to the predictions of a boosted model, as joins and aggregates.

A leaf is reached when every feature on its path meets its merged condition.  Its path is a few rows (feature,
condition, share of the training rows that meet it); joined to the features of a row they say which conditions
hold.  The Shapley value of a feature in the game "unknown features pass with their share" is an integral over
t of a polynomial in the path's holds and shares, which a Gauss-Legendre rule gives exactly.  Contributions are
summed over leaves and trees by feature or family and add up to prediction minus expected value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.text import feature_family
from panelcast.operators.boosting import BoostedModel, Tree

_PATHS = "tree int, leaf int, value double, feature string, lo double, hi double, equal string, others array<string>, share double"
#: Stands for null and every category the model has not seen.
_UNSEEN = "\x00"


def _conditions(model: BoostedModel, tree: Tree) -> list[tuple[int, dict[str, list]]]:
    """(leaf, {feature: [lo, hi, equal, others, share]}) of all leaves but that of a tree without splits."""
    out, stack = [], [(0, {})]
    while stack:
        n, path = stack.pop()
        if tree.feature[n] < 0:
            if path:
                out.append((n, path))
            continue
        f, cut = int(tree.feature[n]), int(tree.cut[n])
        name, cuts = model.binning.names[f], model.binning.cuts[f]
        for kid, left in ((int(tree.left[n]), True), (int(tree.right[n]), False)):
            lo, hi, equal, others, share = path.get(name, [None, None, None, [], 1.0])
            if name in model.binning.categorical:
                value = cuts[cut] if cut < len(cuts) else _UNSEEN
                equal, others = (value, others) if left else (equal, [*others, value])
            elif left:
                hi = float(cuts[cut]) if hi is None else min(hi, float(cuts[cut]))
            else:
                lo = float(cuts[cut]) if lo is None else max(lo, float(cuts[cut]))
            stack.append((kid, {**path, name: [lo, hi, equal, others, share * float(tree.cover[kid] / tree.cover[n])]}))
    return out


def leaf_paths(model: BoostedModel, spark: SparkSession) -> DataFrame:
    """One row for each leaf and feature on its path; bounded by the trees, leaves and depth of the model."""
    rows = [
        (i, leaf, float(t.value[leaf]), name, *condition)
        for i, t in enumerate(model.trees) for leaf, path in _conditions(model, t) for name, condition in path.items()
    ]
    return spark.createDataFrame(rows, _PATHS)


def expected(model: BoostedModel) -> float:
    """The prediction when nothing is known of a row: leaf values by the share of training rows in them."""
    return model.base + sum(float((t.value * t.cover)[t.feature < 0].sum() / t.cover[0]) for t in model.trees)


def _holds() -> Column:
    above = F.col("lo").isNull() | (F.col("_x") > F.col("lo"))
    below = F.col("hi").isNull() | (F.col("_x") <= F.col("hi"))
    same = F.col("equal").isNull() | (F.col("_c") == F.col("equal"))
    return above & below & same & ~F.array_contains("others", F.coalesce("_c", F.lit("")))


def _values(points: int) -> Column:
    """Contribution of each entry (feature, holds, share) of a leaf's ``path``."""
    at, weight = np.polynomial.legendre.leggauss(points)
    at, weight = (at + 1) / 2, weight / 2

    def factor(e: Column, t: float) -> Column:
        return e["share"] + (e["holds"] - e["share"]) * F.lit(float(t))

    def product(t: float) -> Column:
        return F.aggregate("path", F.lit(1.0), lambda acc, e: acc * factor(e, t))

    def one(e: Column) -> Column:
        total = sum((F.lit(float(w)) * F.col("products")[i] / factor(e, t) for i, (t, w) in enumerate(zip(at, weight))), F.lit(0.0))
        return F.struct(e["feature"].alias("feature"), (F.col("value") * (e["holds"] - e["share"]) * total).alias("contribution"))

    products = F.array(*(product(t) for t in at)).alias("products")
    return products, F.transform("path", one)


def contributions(model: BoostedModel, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, feature and its contribution to the prediction, for every row of ``df`` and every feature some split uses.

    ``keys`` tell rows apart.  A feature that no tree splits on contributes nothing and has no row; a model without
    splits gives an empty table.  Nulls count as the smallest number, unseen categories as one of their own.
    """
    paths = leaf_paths(model, df.sparkSession)
    used = sorted({model.binning.names[f] for t in model.trees for f in t.feature[t.feature >= 0].tolist()})
    deepest = max((len(p) for t in model.trees for _, p in _conditions(model, t)), default=1)
    entries = []
    for name in used:
        x, c = F.lit(None).cast("double"), F.lit(None).cast("string")
        if name in model.binning.categorical:
            text = F.col(f"`{name}`").cast("string")
            known = F.array(*(F.lit(v) for v in model.binning.cuts[model.binning.names.index(name)])).cast("array<string>")
            c = F.when(F.coalesce(F.array_contains(known, text), F.lit(False)), text).otherwise(F.lit(_UNSEEN))
        else:
            x = F.coalesce(F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
        entries.append(F.struct(F.lit(name).alias("feature"), x.alias("_x"), c.alias("_c")))
    long = df.select(*keys, F.explode(F.array(*entries) if entries else F.array().cast("array<struct<feature:string,_x:double,_c:string>>")).alias("_e")).select(*keys, "_e.*")
    held = long.join(F.broadcast(paths), "feature").withColumn("holds", _holds().cast("double"))
    entry = F.struct("feature", "holds", "share")
    leaves = held.groupBy(*keys, "tree", "leaf", "value").agg(F.sort_array(F.collect_list(entry)).alias("path"))
    products, values = _values(-(-deepest // 2))
    found = leaves.select(*keys, "value", "path", products).select(*keys, F.inline(values))
    return found.groupBy(*keys, "feature").agg(F.sum("contribution").alias("contribution"))


def by_family(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contributions summed to the families of their features."""
    return table.groupBy(*keys, feature_family("feature").alias("family")).agg(F.sum("contribution").alias("contribution"))
