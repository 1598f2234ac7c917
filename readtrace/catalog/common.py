"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and widen integers, so values compare across engines."""
    def tidy(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.round(F.col(f.name), digits).cast("double").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            return F.col(f.name).cast("long").alias(f.name)
        return F.col(f.name)

    return df.select(*[tidy(f) for f in df.schema.fields])
