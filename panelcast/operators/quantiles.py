"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task.  Here a mergeable sketch first
brackets each quantile.  A second pass counts the values below a bracket map-side and shuffles
only the few values inside it, whose order gives the exact ranks.  A bracket is as wide as the
sketch's error and the group's size ask for: the same rule from one value to any number, and a
rank cannot lie outside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Half widths a bracket can have, as shares of the group; the last one takes in everything.
HALF_WIDTHS = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)
# Bins of one refining pass.
BINS = 1000

BELOW, INSIDE, ABOVE = 0, 1, 2


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: Sequence[str] = (),
    accuracy: int = 10000,
    few_keys: bool = False,
    refine: int = 0,
) -> DataFrame:
    """Linearly interpolated quantiles: one row per key, one column per name in ``probs``.

    ``few_keys`` states that the keys are bounded by a calendar or a schema (months, column
    names), so that the one-row-per-key bracket table may be broadcast.  ``refine`` adds passes
    that cut every bracket to the histogram bins holding the wanted ranks; one such pass suits raw
    facts, where a thousandth of a group is still too much for one task.
    """
    keys, names = list(keys), list(probs)
    src = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))

    def attach(rows: DataFrame, brackets: DataFrame) -> DataFrame:
        if keys:
            return rows.join(F.broadcast(brackets) if few_keys else brackets, keys)
        return rows.withColumn("_b", brackets.select("_b").scalar())

    def tag(brackets: DataFrame) -> DataFrame:
        """Counted values per quantile: those inside its bracket, and one null row for all below.

        A source row stays one row: its place relative to all brackets is a single number, and
        the value is kept in the grouping key only where it lies inside one of them.
        """
        code, hit = F.lit(0), F.lit(False)
        for i in range(len(names)):
            lo, hi = F.col("_b")[i]["lo"], F.col("_b")[i]["hi"]
            inside = F.col("_v").between(lo, hi)
            place = F.when(inside, INSIDE).when(F.col("_v") < lo, BELOW).otherwise(ABOVE)
            code, hit = code + place * 3**i, hit | inside
        counted = (
            attach(src, brackets)
            .select(*keys, code.alias("_code"), F.when(hit, F.col("_v")).alias("_v"))
            .groupBy(*keys, "_code", "_v")
            .agg(F.count(F.lit(1)).alias("_c"))
        )
        each = F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("i"), *[F.col("_b")[i][c].alias(c) for c in ("lo", "hi", "pos")],
                             (F.floor(F.col("_code") / 3**i) % 3).alias("place"))
                    for i in range(len(names))
                ]
            )
        )
        rows = attach(counted, brackets).select(*keys, "_v", "_c", each.alias("q")).where(F.col("q.place") != ABOVE)
        return rows.select(*keys, "q.i", "q.lo", "q.hi", "q.pos", F.when(F.col("q.place") == INSIDE, F.col("_v")).alias("_v"), "_c")

    brackets = _sketch(src, keys, [probs[n] for n in names], accuracy)
    for _ in range(refine):
        brackets = _narrow(tag(brackets), keys)
    inside = tag(brackets).groupBy(*keys, "i", "pos", "_v").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.struct(F.col("_v").isNotNull(), "_v")))["_v"]

    k = F.floor("pos")
    found = (
        inside.withColumn("_upto", F.sum("_c").over(w))
        .groupBy(*keys, "i", "pos")
        .agg(at(k).alias("a"), at(F.ceil("pos")).alias("z"))
    )
    q = F.col("a") + (F.col("z") - F.col("a")) * (F.col("pos") - k)
    pick = [F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(names)]
    return found.withColumn("q", q).groupBy(*keys).agg(*pick)


def _sketch(src: DataFrame, keys: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """One row per key: array of (lo, hi, pos), bracket and wanted 0-based rank of every quantile.

    A sketched quantile is off by at most 1 / accuracy of the group, and p * n and p * (n - 1)
    differ by less than one rank; the narrowest listed half width beyond twice that is taken.
    """
    steps = len(HALF_WIDTHS)
    edges = [e for p in probs for d in HALF_WIDTHS for e in (max(0.0, p - d), min(1.0, p + d))]
    sketch = src.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    need = F.lit(2.0 / accuracy) + F.try_divide(F.lit(2.0), F.col("_n"))  # null without rows

    def edge(i: int, side: int) -> Column:
        p, whole = probs[i], F.col("_max" if side else "_min")
        out = whole
        for j in reversed(range(steps - 1)):
            inside = p + HALF_WIDTHS[j] < 1 if side else p - HALF_WIDTHS[j] > 0
            out = F.when(need <= HALF_WIDTHS[j], F.col("_e")[2 * (steps * i + j) + side] if inside else whole).otherwise(out)
        return out

    rows = [
        F.struct(edge(i, 0).alias("lo"), edge(i, 1).alias("hi"), ((F.col("_n") - 1) * F.lit(float(p))).alias("pos"))
        for i, p in enumerate(probs)
    ]
    return sketch.select(*keys, F.array(*rows).alias("_b"))


def _narrow(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Replace each bracket by the range of the equal-width bins that contain its two ranks.

    The ordered window sees at most ``BINS`` + 1 rows per quantile.
    """
    width = (F.col("hi") - F.col("lo")) / BINS
    at = F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("lo"), width)), F.lit(0))
    bin_no = F.when(F.col("_v").isNull(), -1).otherwise(F.least(at, F.lit(BINS - 1)))
    counts = tagged.groupBy(*keys, "i", "pos", bin_no.cast("int").alias("_bin")).agg(
        F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    w = Window.partitionBy(*keys, "i").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_c").over(w))

    def bin_of(rank: Column) -> Column:
        return F.min_by(F.struct("_lo", "_hi"), F.when(F.col("_upto") > rank, F.col("_upto")))

    found = ranked.groupBy(*keys, "i", "pos").agg(bin_of(F.floor("pos")).alias("a"), bin_of(F.ceil("pos")).alias("z"))
    row = F.struct("i", F.col("a._lo").alias("lo"), F.col("z._hi").alias("hi"), "pos")
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_b"))
