"""Vector expressions over ``array<double>``."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length; an error where the sizes differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    size = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = F.when(size > 0, _dot(a, b) / size).otherwise(F.lit(0.0))
    same = F.size(a) == F.size(b)
    return F.when(same, value).when(~same, F.raise_error(F.lit("vectors differ in size")).cast("double"))
