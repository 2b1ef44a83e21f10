"""Regression metrics as aggregate expressions; usable globally or per group in the same pass.

Only rows with both an actual and a prediction count, in every metric.
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column
from pyspark.sql import functions as F

MapeVariant = Literal["nonzero", "epsilon", "plus_one"]


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def rmse(y: str, p: str) -> Column:
    e = F.col(y) - F.col(p)
    return F.sqrt(F.avg(e * e))


def r2(y: str, p: str, small: float | None = None) -> Column:
    """1 - SSE / SST.  SST = 0 gives null; groups under two rows give ``small`` when it is set."""
    e = F.col(y) - F.col(p)
    scored = F.when(e.isNotNull(), F.col(y))
    sst = F.var_pop(scored) * F.count(scored)
    value = 1 - F.try_divide(F.sum(e * e), F.when(sst > 0, sst))
    return value if small is None else F.when(F.count(scored) < 2, F.lit(float(small))).otherwise(value)


def mape(y: str, p: str, variant: MapeVariant = "nonzero") -> Column:
    """Mean absolute percentage error over non-zero rows, |y| > 1e-6 rows, or with y + 1 below the line."""
    e, a = F.abs(F.col(y) - F.col(p)), F.abs(F.col(y).cast("double"))
    if variant == "plus_one":
        return F.avg(F.try_divide(e, F.col(y) + 1.0)) * 100
    keep = a > (1e-6 if variant == "epsilon" else 0.0)
    return F.avg(F.when(keep, F.try_divide(e, a))) * 100


def regression_metrics(y: str, p: str, variant: MapeVariant = "nonzero") -> list[Column]:
    return [
        mae(y, p).alias("mae"),
        rmse(y, p).alias("rmse"),
        r2(y, p).alias("r2"),
        mape(y, p, variant).alias("mape"),
        F.count(F.col(y) - F.col(p)).alias("n_samples"),
    ]
