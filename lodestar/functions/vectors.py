"""Vector expressions over ``ARRAY<FLOAT|DOUBLE>`` columns, computed in double and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("l2", "ip")


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_l2(a, b))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def center(a: Column | str, mean: Column | str) -> Column:
    return F.zip_with(_d(a), _d(mean), lambda x, y: x - y)


def project(a: Column | str, mean: Column | str, axis: Column | str) -> Column:
    """Length of the centred vector along ``axis``."""
    return inner_product(center(a, mean), axis)


def norm(a: Column | str) -> Column:
    return F.sqrt(inner_product(a, a))


def normalize(a: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(_d(a), lambda x: F.when(n > 0, x / n).otherwise(x))


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return metric


def check_dimension(df: DataFrame, vector: str = "embedding", expect: int | None = None) -> int:
    """The one length of all vectors; a null vector, several lengths or another length than ``expect`` is an error."""
    low, high, nulls = df.agg(F.min(F.size(vector)), F.max(F.size(vector)), F.count_if(F.col(vector).isNull())).first()
    if low is None or nulls:
        raise ValueError("no vectors" if not nulls else f"{nulls} null vectors")
    if low != high:
        raise ValueError(f"vectors of {low} to {high} dimensions in one set")
    if expect is not None and low != expect:
        raise ValueError(f"vectors of {low} dimensions where {expect} are expected")
    return low
