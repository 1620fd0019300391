"""Literals that several modules share. They are functions, as a column needs a running session."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero() -> Column:
    return F.lit(0.0)


def no_scores() -> Column:
    return F.create_map().cast("map<string,double>")
