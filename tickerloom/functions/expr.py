"""Scalar expressions: NULL-safe ratios, label ladders, check flags and guarded statistics."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = dt.date | Column | None


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den``; NULL where the divisor is zero or NULL."""
    return F.try_divide(col(num), col(den))


def change_pct(now: str | Column, before: str | Column) -> Column:
    return (ratio(now, before) - 1) * 100


def rounded(c: Column, digits: int, on: bool = True) -> Column:
    return F.round(c, digits) if on else c


def ladder(steps: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """First label whose condition holds. A NULL condition does not hold."""
    (cond, label), *rest = steps
    out = F.when(cond, label)
    for cond, label in rest:
        out = out.when(cond, label)
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def as_int(flag: Column) -> Column:
    """A check as 0/1; unknown counts as 0."""
    return F.coalesce(flag.cast("int"), F.lit(0))


def total(cols: list[Column]) -> Column:
    return reduce(add, cols)


def all_known(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation over the pairs where both sides are known; NULL for a flat side instead of an error."""
    x, y = col(x), col(y)
    both = all_known(x, y)
    px, py = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def beta(x: str | Column, market: str | Column) -> Column:
    """Slope of ``x`` on ``market`` over complete pairs."""
    x, market = col(x), col(market)
    both = all_known(x, market)
    px, pm = F.when(both, x).cast("double"), F.when(both, market).cast("double")
    return F.try_divide(F.covar_samp(px, pm), F.var_samp(pm))


def joined(c: Column, sep: str = ", ") -> Column:
    """Aggregate: the non-NULL strings of ``c`` as one sorted text, NULL when there are none.

    Meant for columns whose number of distinct values is fixed by the model
    (rule names, signal names), so the collected array stays small.
    """
    found = F.array_sort(F.collect_set(c))
    return F.when(F.size(found) > 0, F.array_join(found, sep))


def texts(*conditional: Column, sep: str = "; ") -> Column:
    """The non-NULL texts in order, NULL when none applies."""
    found = F.array_compact(F.array(*conditional))
    return F.when(F.size(found) > 0, F.array_join(found, sep))


def as_of_date(as_of: AsOf, df: DataFrame, date_column: str) -> Column:
    """The evaluation date as a column: the caller's, or the newest date in ``df`` as a scalar subquery."""
    if as_of is None:
        return df.agg(F.max(date_column).cast("date").alias("as_of")).scalar()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    return F.lit(as_of).cast("date")
