"""KPI algebra as Column expressions: ratios of sums, changes, goals, decomposition."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from adsight.functions import catalogue as C

ColumnLike = Column | str
Measures = Callable[[str], Column]


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def literal_map(mapping: Mapping[str, object]) -> Column:
    """A literal map column; look-ups stay inside code generation."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: Mapping[str, object], key: ColumnLike) -> Column:
    """Value of ``key`` in a literal mapping, null when absent."""
    return F.try_element_at(literal_map(mapping), col(key))


def ratio(numerator: ColumnLike, denominator: ColumnLike, scale: float = 1.0) -> Column:
    """``numerator / denominator * scale`` of sums; null if a side is null or the base is 0."""
    value = F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))
    return value if scale == 1.0 else value * F.lit(scale)


def metric_value(metric: str, measures: Measures, days: ColumnLike | int = 1) -> Column:
    """A metric over a window: a ratio of sums, or a base measure per day."""
    if metric in C.KPIS:
        kpi = C.KPIS[metric]
        return ratio(measures(kpi.numerator), measures(kpi.denominator), kpi.scale)
    total = measures(metric).cast("double")
    return total if days == 1 else total / (F.lit(days) if isinstance(days, int) else col(days))


def metric_by_name(
    metric: ColumnLike, measures: Measures, days: ColumnLike | int = 1,
    metrics: tuple[str, ...] = C.METRICS,
) -> Column:
    """The value of the metric *named in a column*, from the measures of the same row."""
    chosen = F.lit(None).cast("double")
    for name in reversed(metrics):
        chosen = F.when(col(metric) == name, metric_value(name, measures, days)).otherwise(chosen)
    return chosen


def kpi_columns(available: list[str], prefix: str = "") -> dict[str, Column]:
    """Every KPI whose two measures are among ``available`` columns."""
    return {
        prefix + name: ratio(kpi.numerator, kpi.denominator, kpi.scale)
        for name, kpi in C.KPIS.items()
        if kpi.numerator in available and kpi.denominator in available
    }


def change_pct(previous: ColumnLike, current: ColumnLike) -> Column:
    """Relative change in per cent; null without a usable previous value."""
    before, now = col(previous), col(current)
    return F.try_divide(now - before, F.abs(before)) * 100


def break_even_roas(margin_pct: ColumnLike) -> Column:
    """``100 / margin``; null outside (0, 100]."""
    margin = col(margin_pct).cast("double")
    return F.when((margin > 0) & (margin <= 100), F.lit(100.0) / margin)


def is_profitable_roas(roas: ColumnLike, margin_pct: ColumnLike) -> Column:
    return col(roas) > break_even_roas(margin_pct)


def higher_is_better(metric: ColumnLike) -> Column:
    """Direction of the metric named in a column (null: no direction)."""
    known = {m: C.direction(m) for m in C.METRICS if C.direction(m) is not None}
    return lookup(known, metric)


def goal_status(
    actual: ColumnLike, target: ColumnLike, higher: Column | bool = True,
    tolerance: float = C.GOAL_TOLERANCE,
) -> Column:
    """ahead / on_track / behind; a cost of zero or less is never behind."""
    value, goal = col(actual), col(target)
    up = F.lit(higher) if isinstance(higher, bool) else higher
    share = F.when(up, F.try_divide(value, goal)).otherwise(F.try_divide(goal, value))
    graded = (
        F.when(share >= 1 + tolerance, "ahead")
        .when(share >= 1 - tolerance, "on_track")
        .when(share.isNotNull(), "behind")
    )
    usable = value.isNotNull() & goal.isNotNull() & (goal > 0)
    return F.when(usable & ~up & (value <= 0), "ahead").when(usable, graded)


def days_in_month(day: ColumnLike) -> Column:
    return F.dayofmonth(F.last_day(col(day)))


def prorated_target(monthly: ColumnLike, elapsed: ColumnLike | int, day: ColumnLike) -> Column:
    """The share of a monthly target due after ``elapsed`` days of ``day``'s month."""
    gone = F.lit(elapsed) if isinstance(elapsed, int) else col(elapsed)
    total = days_in_month(day)
    valid = (gone >= 0) & (gone <= total)
    return F.when(valid, col(monthly).cast("double") * gone / total)


def improvement_pct(metric: ColumnLike, before: ColumnLike, after: ColumnLike) -> Column:
    """Change towards better, in per cent; null for a metric without a direction."""
    change = change_pct(before, after)
    better = higher_is_better(metric)
    return F.when(better, change).when(~better, -change)


def driver_shares(metric: str, before: Measures, after: Measures) -> Column:
    """Log-change attribution of one metric: array of (driver, before, after, change, share).

    Null when a value is missing or not positive, or when the metric did not move.
    """
    formula = C.FORMULAS[metric]
    values = {
        m: (metric_value(m, before), metric_value(m, after))
        for m in (metric, *(driver for driver, _ in formula))
    }
    positive = F.lit(True)
    for b, a in values.values():
        positive = positive & F.coalesce((b > 0) & (a > 0), F.lit(False))
    # ln of a non-positive value never runs: each term is guarded by its own sides.
    terms = [
        (driver, F.when(positive, sign * F.ln(F.try_divide(values[driver][1], values[driver][0]))))
        for driver, sign in formula
    ]
    total = terms[0][1]
    for _, term in terms[1:]:
        total = total + term
    rows = F.array(*[
        F.struct(
            F.lit(driver).alias("driver"),
            F.lit(order).alias("ord"),
            values[driver][0].alias("before"),
            values[driver][1].alias("after"),
            ((F.try_divide(values[driver][1], values[driver][0]) - 1) * 100).alias("change_pct"),
            (F.try_divide(term, total) * 100).alias("share_pct"),
        )
        for order, (driver, term) in enumerate(terms)
    ])
    return F.when(positive & (F.abs(total) > 1e-12), rows)
