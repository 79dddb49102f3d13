"""Event-parameter extraction (array<struct<key, value>>) without explode or shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_FIELDS = {"int": "int_value", "string": "string_value",
           "float": "float_value", "double": "double_value"}
PARAM_ARRAYS = "_param_arrays"


def event_param(key: str, kind: str = "int", params: str | Column = "event_params") -> Column:
    """Value of the first parameter named ``key`` (first match wins on duplicate keys).

    ``array_position`` over the extracted key array plus a positional ``get`` on the
    extracted value array: both are code-generated (no lambda), and the nested field
    references let the Parquet reader prune ``event_params`` to the subfields used.
    """
    arr = F.col(params) if isinstance(params, str) else params
    pos = F.array_position(arr.getField("key"), F.lit(key)).cast("int") - 1
    return F.get(arr.getField("value").getField(_FIELDS[kind]), pos)


def event_param_any(key: str, params: str | Column = "event_params") -> Column:
    """String value, else the int value as string."""
    return F.coalesce(event_param(key, "string", params),
                      event_param(key, "int", params).cast("string"))


def event_param_alias(keys: tuple[str, ...] | list[str], kind: str = "int",
                      params: str | Column = "event_params") -> Column:
    """First non-null value over several spellings of one parameter."""
    return F.coalesce(*[event_param(k, kind, params) for k in keys])


def split_params(df: DataFrame, params: str = "event_params") -> DataFrame:
    """``params`` as a struct of arrays, one per field, for many lookups on a row (pass ``PARAM_ARRAYS`` to them).

    On an array of structs each lookup makes its own arrays of keys and values. The one-element ``inline``
    is a Generate node, over which the optimizer does not repeat them.
    """
    p = F.col(params)
    arrays = F.struct(p.getField("key").alias("key"), F.struct(*[
        p.getField("value").getField(f).alias(f) for f in ("int_value", "string_value")]).alias("value"))
    return df.select("*", F.inline(F.array(F.struct(arrays.alias(PARAM_ARRAYS)))))
