"""Rolling, cross-sectional and forward-looking column functions.

A panel is long: one row for each (date, code).  Functions along time run over ts(), functions across
codes over cs(); a plan that keeps to these two has one exchange for each.  Rolling functions give null
until a window has min_periods values, as panel libraries do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def ts() -> WindowSpec:
    """A code's rows in order of date."""
    return Window.partitionBy("code").orderBy("date")


def cs() -> WindowSpec:
    """A date's cross section."""
    return Window.partitionBy("date")


def past() -> WindowSpec:
    """A code's rows up to this one."""
    return ts().rowsBetween(Window.unboundedPreceding, Window.currentRow)



def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def frame(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The last n rows, this one included."""
    return (w or ts()).rowsBetween(-(n - 1), Window.currentRow)


def rolling(fn: Callable[[Column], Column], c: Column | str, n: int, min_periods: int | None = None, w: WindowSpec | None = None) -> Column:
    """fn over the last n rows, null where fewer than min_periods (n if not given) of them have a value."""
    c = col(c)
    return F.when(F.count(c).over(frame(n, w)) >= (n if min_periods is None else min_periods), fn(c).over(frame(n, w)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero or missing divisor."""
    return F.try_divide(a, b)


def change(c: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    """The relative change against n rows before, which are n calendar steps on a dense panel."""
    return ratio(col(c), F.lag(col(c), n).over(w or ts())) - 1


def forward_return(c: Column | str, horizon: int) -> Column:
    return ratio(F.lead(col(c), horizon).over(ts()), col(c)) - 1


def ffill(c: Column | str) -> Column:
    """The last value so far."""
    return F.last(col(c), ignorenulls=True).over(past())


def drawdown(c: Column | str, w: WindowSpec | None = None) -> Column:
    return ratio(col(c), F.max(col(c)).over(w or past())) - 1


def avg_rank(c: Column | str, *by: str) -> Column:
    """The rank from 1 among the non-null values of a group, ties sharing the mean of their ranks."""
    c, by = col(c), by or ("date",)
    ordered = F.rank().over(Window.partitionBy(*by).orderBy(c.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    return F.when(c.isNotNull(), ordered + (ties - 1) / 2)


def pct_rank(c: Column | str, *by: str) -> Column:
    """avg_rank over the number of values, in (0, 1]."""
    return avg_rank(c, *by) / F.count(col(c)).over(Window.partitionBy(*(by or ("date",))))


def zscore(c: Column | str, *by: str) -> Column:
    """Distance from the group's mean in sample standard deviations; null where that is zero or undefined."""
    w = Window.partitionBy(*(by or ("date",)))
    return ratio(col(c) - F.avg(col(c)).over(w), F.stddev_samp(col(c)).over(w))


def quantile_bucket(c: Column | str, q: int) -> Column:
    """Bucket 0 to q - 1 of the value's place among its date's, by quantile edges of the places 1..n (not equal counts)."""
    n = F.count(col(c)).over(cs())
    place = F.row_number().over(cs().orderBy(col(c).asc_nulls_last(), "code"))
    # place p lies in bucket b if 1 + (n - 1) b / q < p <= 1 + (n - 1)(b + 1) / q; the first bucket includes its lower edge
    b = F.ceil((place - 1) * F.lit(q) / F.greatest(n - 1, F.lit(1))) - 1
    return F.when(col(c).isNotNull(), F.greatest(b, F.lit(0)))
