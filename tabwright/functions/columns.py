"""Column kinds and small Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)

# Text at most this long is its own grouping key; longer text is grouped by its digest.
PLAIN_KEY_LENGTH = 64


def kind_of(data_type: T.DataType) -> str:
    """``int``, ``float``, ``text``, ``bool`` or ``other``."""
    if isinstance(data_type, INTEGRAL):
        return "int"
    if isinstance(data_type, FRACTIONAL):
        return "float"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {field.name: kind_of(field.dataType) for field in df.schema.fields}


def columns_of_kind(df: DataFrame, *wanted: str, exclude: Iterable[str | None] = ()) -> list[str]:
    skip = set(exclude)
    return [name for name, kind in kinds(df).items() if kind in wanted and name not in skip]


def numeric_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    return columns_of_kind(df, "int", "float", exclude=exclude)


def text_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    return columns_of_kind(df, "text", exclude=exclude)


def quoted(name: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    return quoted(name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """There is one kind of missing value from here on: NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats})


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    """``100 * part / whole``, 0 for an empty whole."""
    value = F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def grouping_key(text: Column) -> Column:
    """A short stand-in for a text value that is equal exactly when the text is equal.

    Long documents are shuffled as 71 bytes instead of in full. No value of up to 64 characters can
    look like a digest key, as those are longer.
    """
    digest = F.concat(F.lit("sha256:"), F.sha2(text, 256))
    return F.when(F.length(text) <= PLAIN_KEY_LENGTH, text).otherwise(digest)


def exact_text(value: Column, data_type: T.DataType) -> Column:
    """Text that is equal exactly when the values are: no rounding, no time zone, parts told apart by their lengths."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0.0)).cast("string")  # one zero
    if isinstance(data_type, T.BinaryType):
        return F.hex(value)
    if isinstance(data_type, VectorUDT):
        return exact_text(vector_to_array(value), T.ArrayType(T.DoubleType()))
    if isinstance(data_type, T.ArrayType):
        return F.concat_ws("", F.transform(value, lambda x: measured_text(x, data_type.elementType)))
    if isinstance(data_type, T.MapType):
        entry = T.StructType([T.StructField("key", data_type.keyType), T.StructField("value", data_type.valueType)])
        return F.concat_ws("", F.array_sort(F.transform(F.map_entries(value), lambda x: measured_text(x, entry))))
    if isinstance(data_type, T.StructType):
        return F.concat(*[measured_text(value.getField(f.name), f.dataType) for f in data_type.fields]) if data_type.fields else F.lit("")
    if isinstance(data_type, T.VariantType):
        return F.to_json(value)
    return value.cast("string")


def measured_text(value: Column, data_type: T.DataType) -> Column:
    """``length:text``, and ``-`` for NULL, so that a row of them can be read in one way only."""
    text = exact_text(value, data_type)
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def slot_of(data_type: T.DataType) -> str:
    """Where values of a type are kept when columns are stacked: ``as_long``, ``as_double`` or ``as_text``.

    Decimals are text, as neither of the others holds all of them.
    """
    if isinstance(data_type, T.DecimalType):
        return "as_text"
    return {"int": "as_long", "float": "as_double"}.get(kind_of(data_type), "as_text")


def typed_key(name: str, data_type: T.DataType, digest: bool) -> Column:
    """A value as a grouping key of its slot's type: whole number, number, or text."""
    value, slot = quoted(name), slot_of(data_type)
    if slot == "as_long":
        return value.cast("bigint")
    if slot == "as_double":
        return value.cast("double")
    if digest and not isinstance(data_type, T.StringType):
        return grouping_key(F.when(value.isNotNull(), exact_text(value, data_type)))
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        value = F.when(value.isNotNull(), F.to_json(F.struct(value)))
    elif isinstance(data_type, T.BinaryType):
        value = F.hex(value)
    value = value.cast("string")
    return grouping_key(value) if digest else value
