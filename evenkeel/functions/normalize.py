"""Canonical text of values: equal data in different types becomes equal text.

Everything is built from Catalyst expressions, so it stays in generated code and touches only the selected columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import NULL_TEXT
from .names import named

_BLANK = r"(?iU)^(none|nan|nat|\s*)$"
_BLANK_LONGEST = 6  # of a text that is no white space: a word of four letters and a line end


def blank_to_null_text(text: Column) -> Column:
    """Null, blank, and the texts none, nan and nat in any case become N/A."""
    # The pattern is only tried on short texts and on those that don't begin with a visible ASCII character.
    may_be = (F.length(text) <= _BLANK_LONGEST) | ~F.substring(text, 1, 1).between("!", "~")
    return F.when(text.isNull() | (may_be & text.rlike(_BLANK)), F.lit(NULL_TEXT)).otherwise(text)


def null_to_null_text(text: Column) -> Column:
    """The same for texts that are never blank."""
    return F.coalesce(text, F.lit(NULL_TEXT))


def strip_zeros(text: Column) -> Column:
    """Drop a fraction of zeros, and zeros that end a fraction, of a number without an exponent."""
    trimmed = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(text.contains("."), trimmed).otherwise(text)


def decimal_text(value: Column) -> Column:
    return strip_zeros(value.cast("string"))


def double_text(value: Column) -> Column:
    """Plain digits where a decimal holds the very same number, else the exponent form in lower case; null if not a number.

    Between 0.001 and 10,000,000 the shortest text has no exponent.  Beyond, one decimal type is tried, by magnitude.
    """
    text, size = F.lower(value.cast("string")), F.abs(value)
    short = F.regexp_replace(text, r"\.0(?=e)", "")

    def digits(kind: str) -> Column:
        decimal = value.try_cast(kind)
        return F.when(decimal.cast("double") == value, strip_zeros(decimal.cast("string"))).otherwise(short)

    wide = F.when(size >= 1e20, digits("decimal(38,0)")).when(size >= 1, digits("decimal(38,18)")).otherwise(digits("decimal(38,37)"))
    shown = F.when(value == 0, F.lit("0")).when(text.contains("e"), wide).otherwise(strip_zeros(text))
    return F.when(~F.isnan(value), shown)


def timestamp_text(value: Column) -> Column:
    """Seconds only; a midnight is a bare date."""
    text = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    return F.when(text.endswith(" 00:00:00"), F.regexp_replace(text, " 00:00:00$", "")).otherwise(text)


def in_zone(value: Column, zone: str, session_zone: str) -> Column:
    """A timestamp with its instant shown as the wall clock of zone, whatever the session's zone is."""
    return F.to_utc_timestamp(F.from_utc_timestamp(value, zone), session_zone)


def canonical(value: Column, kind: T.DataType, zone: str = "UTC", session_zone: str = "UTC") -> Column:
    """The canonical text of a value of type kind; never null.

    JSON texts in string columns are compared as they are; use json_text() on them to make the order of keys irrelevant.
    """
    match kind:
        case T.BooleanType():
            text = value.cast("int").cast("string")
        case T.DateType():
            text = F.date_format(value, "yyyy-MM-dd")
        case T.TimestampType():
            text = timestamp_text(in_zone(value, zone, session_zone))
        case T.TimestampNTZType():
            text = timestamp_text(value)
        case T.DecimalType():
            text = decimal_text(value)
        case T.FloatType():
            text = double_text(value.cast("string").cast("double"))  # as the float reads, not as its binary expansion
        case T.DoubleType():
            text = double_text(value)
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            text = value.cast("string")
        case T.MapType():
            text = F.to_json(sorted_map(value))
        case T.ArrayType() | T.StructType():
            text = F.to_json(value)
        case T.VariantType():
            text = F.to_json(value)  # whose keys are in order
        case T.BinaryType():
            return blank_to_null_text(F.lower(F.hex(value)))
        case _:
            return blank_to_null_text(value.cast("string"))
    return null_to_null_text(text)


def sorted_map(value: Column) -> Column:
    """A map with its entries in order of their keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def json_text(text: Column) -> Column:
    """A JSON object or array with the keys of all its objects in order; other texts stay as they are."""
    parsed = F.try_parse_json(F.when(text.rlike(r"^\s*[{\[]"), text))
    return F.coalesce(F.to_json(parsed), text)


def canonical_frame(df: DataFrame, columns: list[str], zone: str = "UTC") -> DataFrame:
    """columns of df as canonical texts, under the same names."""
    session_zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    return df.select(*[canonical(named(c), df.schema[c].dataType, zone, session_zone).alias(c) for c in columns])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])
