"""Canonical output types for result comparison.

Arrays -> '>'-joined strings, timestamps -> epoch micros, dates -> 'yyyy-MM-dd',
decimals / doubles -> double rounded to 6 places.  The oracle SQL produces the
same types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def canonical(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ">")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)
