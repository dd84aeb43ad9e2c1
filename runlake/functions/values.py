"""Numbers, instants and JSON-friendly values: H9, H10, H13."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_seconds_to_ts(seconds: Column) -> Column:
    """H9: the ``time`` column of a log report."""
    return F.timestamp_seconds(seconds)


def epoch_millis_to_ts(millis: Column) -> Column:
    """H9: the ``timestamp`` column of a log report."""
    return F.timestamp_millis(millis)


def try_number(text: Column) -> Column:
    """Numeric value of an answer cell, NULL where it holds other text."""
    return text.try_cast("double")


def rfc3339(ts: Column) -> Column:
    """An instant as RFC3339 UTC text, the fraction without trailing zeros."""
    text = F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0*$", ""), F.lit("Z"))


def json_value(c: Column, dtype: T.DataType) -> Column:
    """A column as a value that survives JSON.

    Instants become RFC3339 text and bytes become text.  A column whose values may not all
    be JSON numbers becomes a variant, so each row keeps a number where that is exact and
    text otherwise (NaN, infinities, wide integers, inexact decimals).
    """
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return rfc3339(c)
    if isinstance(dtype, T.BinaryType):
        return F.decode(c, "UTF-8")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        wide = c.cast("double")
        return (
            F.when(F.isnan(wide), F.lit("NaN").cast("variant"))
            .when(wide == float("inf"), F.lit("+Inf").cast("variant"))
            .when(wide == float("-inf"), F.lit("-Inf").cast("variant"))
            .otherwise(wide.cast("variant"))
        )
    if isinstance(dtype, T.DecimalType):
        if dtype.scale == 0:
            number = c.try_cast("bigint")
            return F.when(number.isNotNull(), number.cast("variant")).otherwise(
                c.cast("string").cast("variant")
            )
        plain = F.regexp_replace(c.cast("string"), r"\.?0*$", "")
        dyadic = c.cast("double") * F.lit(1048576.0)
        exact = (F.abs(dyadic) < F.lit(2.0**53)) & (dyadic == F.floor(dyadic).cast("double")) & (
            c.cast("double").cast(dtype) == c
        )
        return F.when(exact, c.cast("double").cast("variant")).otherwise(plain.cast("variant"))
    return c
