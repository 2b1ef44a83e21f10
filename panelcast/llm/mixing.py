"""Mixing of sources to target weights along a training curriculum.

Each source has a weight schedule over training time 0..1.  Its integral gives the source's share of
all words; the share stops at ``max_passes`` times what the source holds and the excess is dealt to the
others by weight.  Inside a source documents stand in an order drawn by hash, repeated pass after pass;
the running number of words is the cumulative demand at which a copy is used up, and the inverse of the
source's integrated schedule turns it into a training position.  The mix is sorted by that position.

The running sums do not gather a source: its documents are dealt into many ranges of the hash, ranges
are summed, and only the sums are ordered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.session import cut_lineage

#: Words of a text; null has none.
WORD = r"[^\x20\x09-\x0D]+"

#: Knots (time, weight) of a piecewise linear schedule, from time 0 to time 1.
Schedule = list[tuple[float, float]]


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def rotating(position: int) -> Schedule:
    """Mean weights 1, 2, 3, repeating; in turn rising, level and falling over the training."""
    mean = 1.0 + position % 3
    tilt = (0.5, 0.0, -0.5)[position // 3 % 3]
    return [(0.0, mean * (1 - tilt)), (1.0, mean * (1 + tilt))]


@dataclass(frozen=True)
class MixConfig:
    schedule: Callable[[int], Schedule] = rotating
    max_passes: int = 3
    rows_per_range: int = 5_000
    seed: int = 0


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def targets(sizes: list[int], weights: list[float], max_passes: int) -> list[float]:
    """Words each source gives: shares of the total by weight, at most ``max_passes`` times its size, the excess dealt again."""
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        above = [i for i in sorted(open_) if weight > 0 and left * weights[i] / weight > max_passes * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / weight if weight > 0 else 0.0
            return out
        for i in above:
            out[i] = float(max_passes * sizes[i])
            left -= out[i]
            open_.remove(i)
    return out


def _position(demand: Column) -> Column:
    """Time at which a share ``demand`` (0..1) of a source has been used up, by its integrated schedule ``_pieces``."""
    piece = F.element_at(F.filter("_pieces", lambda p: p["y0"] <= demand), -1)
    slope = (piece["w1"] - piece["w0"]) / (piece["t1"] - piece["t0"])
    rest = demand - piece["y0"]
    # w0 x + slope x^2 / 2 = rest, solved without dividing by a slope of 0
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * slope * rest, F.lit(0.0)))
    step = F.when(piece["w0"] + root > 0, 2 * rest / (piece["w0"] + root)).otherwise(F.lit(0.0))
    return F.least(piece["t0"] + step, piece["t1"])


def _pieces(schedule: Schedule) -> list[tuple[float, ...]]:
    """Segments (t0, t1, w0, w1, y0) with weights scaled to an integral of 1; y0 is the integral before."""
    total, y, out = integral(schedule), 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        w0, w1 = w0 / total, w1 / total
        out.append((t0, t1, w0, w1, y))
        y += (t1 - t0) * (w0 + w1) / 2
    return out


def mix_plan(docs: DataFrame, carry: list[str], config: MixConfig = MixConfig()) -> DataFrame:
    """One row per row of ``docs``: ``_doc`` (struct of the columns in ``carry``), source, size, source_size, target, taken, positions.

    ``docs`` has doc_id, source and text.  Null text counts no words; a null source is one of its own, after all
    others.  ``positions`` are the training times of the copies taken, empty for none.  Rows repeated whole
    are interchangeable; each has its own place.  One row for each source reaches the driver.  The same rows
    give the same plan, however they are stored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_doc"),
        F.col("source").cast("string").alias("source"),
        word_count().alias("size"),
        F.xxhash64(F.lit(config.seed), "doc_id", "text").alias("_draw"),  # null ids are spread by their texts
    )
    narrow = cut_lineage(rows.select("source", "size", "_draw"))
    held = narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sources = sorted(held.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    schedules = [config.schedule(i) for i in range(len(sources))]
    wanted = targets([r["words"] for r in sources], [integral(s) for s in schedules], config.max_passes)
    table = spark.createDataFrame(
        [
            (r["source"], r["words"], t, -(-r["n"] // config.rows_per_range), _pieces(s))
            for r, t, s in zip(sources, wanted, schedules, strict=True)
        ],
        "_source string, source_size long, target double, _ranges long, _pieces array<struct<t0:double,t1:double,w0:double,w1:double,y0:double>>",
    )

    def in_range(df: DataFrame) -> DataFrame:
        """With the source's numbers and the range of the hash; the table is as long as the list of sources the driver holds."""
        share = F.shiftrightunsigned("_draw", 11) / F.lit(float(1 << 53))
        return df.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_range", F.floor(share * F.col("_ranges")))

    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_range(narrow).groupBy("_source", "_range").agg(F.sum("size").alias("_words"))
    starts = starts.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_source", "_range").orderBy("_draw", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        in_range(rows).withColumn("_upto", F.sum("size").over(inside))
        .join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("_middle", F.col("_start") + F.col("_upto") - F.col("size") / 2)
    )
    passes = F.transform(F.sequence(F.lit(0), F.lit(config.max_passes - 1)), lambda e: e * F.col("source_size") + F.col("_middle"))
    used = F.filter(passes, lambda c: c < F.col("target"))
    return placed.withColumn("_used", used).select(
        "_doc", "source", "size", "source_size", "target",
        (F.size("_used") * F.col("size")).cast("bigint").alias("taken"),
        F.transform("_used", lambda c: _position(c / F.col("target"))).alias("positions"),
    )


def mixed(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, one for each copy, sorted by training position.

    Columns are those of ``docs``; a document whose source has more than its target may be left out, one of a
    source with less comes up to ``max_passes`` times.
    """
    columns = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_doc"), "doc_id", "source", "text").withColumn("_row", F.xxhash64("_doc"))
    # places are found without the texts, which then move twice: to their places, and into training order
    plan = mix_plan(rows.select("doc_id", "source", "text", "_row"), ["_row"], config).select("_doc._row", "positions")
    plan = plan.where(F.size("positions") > 0).groupBy("_row").agg(F.flatten(F.collect_list("positions")).alias("_all"))
    placed = rows.select("_row", "_doc").join(plan, "_row")
    # rows equal in every column have their places together; one of them stands for all
    first = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    copies = placed.withColumn("_n", first).where("_n = 1").select("_row", "_doc", F.explode("_all").alias("_at"))
    return copies.orderBy("_at", "_row").select("_doc.*")
