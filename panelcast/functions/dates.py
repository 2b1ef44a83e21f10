"""Date parsing, calendar parts, seasonal flags and event flags as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month sets of the seasonal flags and the default policy calendar.
FESTIVAL_PEAK_MONTHS = (1, 8, 10, 11)
EXAM_MONTHS = (2, 3, 4)
MONSOON_MONTHS = (7, 8, 9)
HARVEST_MONTHS = (3, 4, 10, 11)
BUDGET_MONTH = 2
FY_START_MONTH = 4
FY_END_MONTH = 3
FESTIVAL_MONTHS = (8, 9, 10, 11)
HOLIDAY_PEAK_MONTHS = (10, 11)
POLICY_PHASES = {
    "phase_1": ("2025-01-01", "2025-06-30"),
    "phase_2": ("2025-07-01", "2025-09-30"),
    "phase_3": ("2025-10-01", "2026-12-31"),
}
CAMPAIGN_PERIODS = (("2025-04-01", "2025-04-30"), ("2025-08-01", "2025-08-31"), ("2025-10-01", "2025-10-31"))


def _flag(cond: Column) -> Column:
    return cond.cast("int")


def _day(d: str | date) -> Column:
    return F.lit(str(d)).cast("date")


def strict_date(col: str, fmt: str = "dd-MM-yyyy") -> Column:
    """Parse or fail: a malformed value stops the job (ANSI mode)."""
    return F.to_date(F.col(col), fmt)


def lenient_date(col: str, fmt: str = "dd-MM-yyyy") -> Column:
    """Parse, or null where the text is not a date."""
    return F.try_to_date(F.col(col), fmt)


def month_key(col: str) -> Column:
    return F.date_format(col, "yyyy-MM")


def month_label(col: str) -> Column:
    return F.date_format(col, "MMM yyyy")


def month_start(key: str) -> Column:
    """First day of a ``yyyy-MM`` key."""
    return F.to_date(F.concat(F.col(key), F.lit("-01")))


def calendar_parts(d: str) -> dict[str, Column]:
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d),
        "quarter": F.quarter(d),
        "is_weekend": _flag(F.weekday(d) >= 5),
    }


def fiscal_parts(d: str, festival_months: Sequence[int] = FESTIVAL_MONTHS) -> dict[str, Column]:
    """Calendar and April-to-March financial-year columns."""
    m = F.month(d)
    return {
        "year": F.year(d),
        "month": m,
        "quarter": F.quarter(d),
        "financial_year": F.when(m >= FY_START_MONTH, F.year(d)).otherwise(F.year(d) - 1),
        "is_financial_year_start": _flag(m == FY_START_MONTH),
        "is_financial_year_end": _flag(m == FY_END_MONTH),
        "is_festival_month": _flag(m.isin(*festival_months)),
    }


def seasonal_flags(d: str) -> dict[str, Column]:
    m = F.month(d)
    return {
        "is_festival_peak": _flag(m.isin(*FESTIVAL_PEAK_MONTHS)),
        "is_exam_month": _flag(m.isin(*EXAM_MONTHS)),
        "is_budget_month": _flag(m == BUDGET_MONTH),
        "is_fy_start": _flag(m == FY_START_MONTH),
        "is_fy_end": _flag(m == FY_END_MONTH),
        "is_monsoon": _flag(m.isin(*MONSOON_MONTHS)),
        "is_harvest": _flag(m.isin(*HARVEST_MONTHS)),
    }


def quarter_flags(d: str) -> dict[str, Column]:
    q = F.quarter(d)
    return {"quarter": q} | {f"is_q{k}": _flag(q == k) for k in (1, 2, 3, 4)}


def month_cycle(d: str) -> dict[str, Column]:
    angle = F.lit(2.0) * F.pi() * F.month(d) / 12
    return {"month_sin": F.sin(angle), "month_cos": F.cos(angle)}


def time_trend(d: str, reference: Column) -> dict[str, Column]:
    """Months since the reference date, and their square."""
    months = (F.year(d) - F.year(reference)) * 12 + F.month(d) - F.month(reference)
    return {"months_since_start": months, "months_since_start_sq": months * months}


def intervention(d: str, at: str | date, name: str = "post_intervention", trend: bool = False) -> dict[str, Column]:
    """Step from a date on; optionally the 30-day months elapsed since then."""
    cols = {name: _flag(F.col(d) >= _day(at))}
    if trend:
        cols[f"{name}_time"] = F.greatest(F.datediff(F.col(d), _day(at)) / F.lit(30.0), F.lit(0.0))
    return cols


def recovery_phases(
    d: str, start: str = "2020-03-01", recovery: str = "2021-06-01", full: str = "2022-01-01"
) -> dict[str, Column]:
    """Impact, recovery and post flags over half-open ranges."""
    c = F.col(d)
    return {
        "is_covid_impact": _flag((c >= _day(start)) & (c < _day(recovery))),
        "is_covid_recovery": _flag((c >= _day(recovery)) & (c < _day(full))),
        "post_covid": _flag(c >= _day(full)),
    }


def policy_flags(
    d: str,
    phases: Mapping[str, tuple[str, str]] = POLICY_PHASES,
    campaigns: Sequence[tuple[str, str]] = CAMPAIGN_PERIODS,
) -> dict[str, Column]:
    """One flag per phase, any-campaign flag and number of campaigns already over.

    A literal handful of intervals becomes plain comparisons inside codegen; for interval tables
    see ``operators.calendars.interval_flags``.
    """
    c = F.col(d)
    cols = {f"is_{n}": _flag(c.between(_day(a), _day(b))) for n, (a, b) in phases.items()}
    running, over = F.lit(False), F.lit(0)
    for a, b in campaigns:
        running = running | c.between(_day(a), _day(b))
        over = over + _flag(c > _day(b))
    return cols | {"is_campaign_month": _flag(running), "campaign_count": over}


def challenger_flags(
    d: str,
    state_idx: str,
    scheme: Sequence[int],
    deadline: Sequence[int],
    campaign: Sequence[int],
    drive: Sequence[int],
    closure: Sequence[int],
) -> dict[str, Column]:
    """Scheme, deadline, campaign, drive and closure month flags and their interactions."""
    m = F.month(d)

    def within(months: Sequence[int]) -> Column:
        return m.isin(*months)

    any_event = within(scheme) | within(deadline) | within(campaign)
    return {
        "is_scheme_month": _flag(within(scheme)),
        "is_deadline_month": _flag(within(deadline)),
        "is_campaign": _flag(within(campaign)),
        "is_any_event": _flag(any_event),
        "is_holiday_peak": _flag(within(HOLIDAY_PEAK_MONTHS)),
        "is_fy_start": _flag(m == FY_START_MONTH),
        "is_fy_end": _flag(m == FY_END_MONTH),
        "is_quarter_start": _flag(m % 3 == 1),
        "is_quarter_end": _flag(m % 3 == 0),
        "is_drive_month": _flag(within(drive)),
        "is_closure_month": _flag(within(closure)),
        "state_x_month": F.col(state_idx) * m,
        "month_x_drive": m * _flag(within(drive)),
    }
