"""Small array-expression helpers: everything stays in the JVM as higher-order functions.

Two habits keep these plans cheap. Arrays that a lambda looks into are bound with
:func:`let`, because the optimizer may inline a column into the lambda and then
compute it once per element. Computed arrays are exploded with the outer form,
because for the inner form the optimizer adds a ``size(...) > 0`` filter that
computes the whole array a second time; rows of empty arrays are dropped after.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body`` as a lambda variable."""
    # the wrapper keeps default arguments of ``body`` from being read as an index parameter
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def indices(count: Column) -> Column:
    """0 .. count-1 as an int array (empty when count is 0)."""
    count = count.cast("int")
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def total(values: Column) -> Column:
    """Sum of a double array in array order; nulls count as zero."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def add_arrays(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def blend_at(values: Column, position: Column, width: Column) -> Column:
    """Linear interpolation at ``position``; samples outside 0..width-1 count as zero."""

    def taps(p: Column) -> Column:
        base = F.floor(p).cast("int")
        frac = p - F.floor(p)

        def tap(i: Column) -> Column:
            inside = (i >= 0) & (i < width)
            return F.when(inside, F.get(values, i)).otherwise(F.lit(0.0))

        return tap(base) * (1 - frac) + tap(base + 1) * frac

    return let(position, taps)


def run_firsts(sorted_structs: Column, key: str) -> Column:
    """First element of every run of equal ``key`` in an array sorted by that key."""
    return let(
        sorted_structs,
        lambda s: F.filter(
            s,
            lambda e, i: (i == 0) | (F.get(s, i - 1).getField(key) != e.getField(key)),
        ),
    )


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda b: b if isinstance(b, Column) else F.lit(b)
    return F.least(F.greatest(value, as_col(low)), as_col(high))
