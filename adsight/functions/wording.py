"""How computed numbers read in a sentence, as Column expressions.

``format_number`` is used throughout: it rounds half-even, which is what the expected texts do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.functions.kpi import ColumnLike, col, lookup


def label(metric: ColumnLike) -> Column:
    return lookup({m: C.label(m) for m in C.METRICS}, metric)


def plain(value: ColumnLike, digits: int = 0) -> Column:
    """Number without thousands separators."""
    return F.regexp_replace(F.format_number(col(value), digits), ",", "")


def rupees(value: ColumnLike) -> Column:
    """Rupees in crore, lakh or whole rupees by size."""
    v = col(value)
    return (
        F.when(F.abs(v) >= 1e7, F.concat(F.lit("₹"), plain(v / 1e7, 2), F.lit(" Cr")))
        .when(F.abs(v) >= 1e5, F.concat(F.lit("₹"), plain(v / 1e5, 2), F.lit(" L")))
        .otherwise(F.concat(F.lit("₹"), F.format_number(v, 0)))
    )


def as_shown(metric: ColumnLike, value: ColumnLike) -> Column:
    """A rate as a percentage, anything else as it is."""
    return F.when(col(metric).isin(*C.PERCENT_METRICS), col(value) * 100).otherwise(col(value))


def value_text(metric: ColumnLike, value: ColumnLike) -> Column:
    """A value in the unit its metric is read in."""
    m, v = col(metric), col(value)
    return (
        F.when(m.isin(*C.PERCENT_METRICS), F.concat(plain(v * 100, 2), F.lit("%")))
        .when(m.isin(*C.MULTIPLE_METRICS), F.concat(plain(v, 2), F.lit("x")))
        .when(m.isin(*C.COUNT_METRICS), F.format_number(v, 0))
        .otherwise(rupees(v))
    )


def value_or_na(metric: ColumnLike, value: ColumnLike) -> Column:
    return F.coalesce(value_text(metric, value), F.lit("n/a"))


def moved(change: ColumnLike) -> Column:
    c = col(change)
    way = F.when(c > 0, F.lit("rose ")).otherwise(F.lit("fell "))
    return F.when(c.isNull(), "moved").otherwise(
        F.concat(way, plain(F.abs(c)), F.lit("%")))


def title(name: ColumnLike, metric: ColumnLike, kind: ColumnLike) -> Column:
    """Whose movement it is and what it means, in plain words."""
    issue = col(kind) == "issue"
    phrase = F.when(issue, lookup({m: p[0] for m, p in C.PHRASES.items()}, metric)).otherwise(
        lookup({m: p[1] for m, p in C.PHRASES.items()}, metric))
    way = F.when(issue, "moved the wrong way").otherwise("moved the right way")
    generic = F.concat(col(name), F.lit(": "), label(metric), F.lit(" "), way)
    return F.coalesce(F.concat(col(name), F.lit(" "), phrase), generic)


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def plural(count: Column, one: str, many: str) -> Column:
    return F.when(count == 1, one).otherwise(many)


def filled(sentence: str, *values: Column) -> Column:
    """A fixed sentence with its placeholders replaced in order; null if a value is null."""
    parts = sentence.split("{}")
    pieces = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        pieces += [value, F.lit(rest)]
    return F.concat(*pieces)
