"""Evaluating a sub-expression once."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(fn):
    """Makes a function of an array column evaluate that column once per row.

    Array lambdas do not share sub-expressions: without this, an array that is itself computed
    would be computed anew for every element.
    """
    @wraps(fn)
    def wrapped(value: Column, *args, **kwargs) -> Column:
        return bind(value, lambda v: fn(v, *args, **kwargs))

    return wrapped


def with_computed(df: DataFrame, name: str, value: Column, keep=None) -> DataFrame:
    """Adds a costly column that is computed exactly once per row; ``keep(value)`` filters on it.

    A filter on an ordinary column is pushed below its projection together with a copy of the
    expression. A generator is a boundary for that.
    """
    holder = F.array(value)
    return df.withColumn(name, F.explode(holder if keep is None else F.filter(holder, keep)))
