"""Text expressions; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.functions.schema import col

# White space, token and number patterns, cell width.
WHITE = r"[\s\x1c-\x1f]"
WHITE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}+"
KEYWORD_PATTERN = r"(?=\p{Nd}*+[\p{L}\p{N}_&&[^\p{Nd}]])[\p{L}\p{N}_]{4,}+"
NUMBER_PATTERN = r"(?=\p{Nd})(?<![\p{L}\p{N}_])\p{Nd}+(?:[.,]\p{Nd}+)?(?![\p{L}\p{N}_])"
CELL_WIDTH = 80
MISSING_MARK = "—"


def strip(text: Column) -> Column:
    """Without leading and trailing white space, Unicode spaces included."""
    return F.btrim(text, F.lit(WHITE_CHARS))


def normalize(text: Column) -> Column:
    """Stripped, inner white space collapsed to one blank, lower case."""
    return F.lower(F.regexp_replace(strip(text), rf"(?U){WHITE}+", " "))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case word tokens of two or more characters, in text order."""
    return _found(F.lower(text), TOKEN_PATTERN)


def _first(found: Column, most: int | None) -> Column:
    return found if most is None else F.slice(found, 1, most)


def keywords(text: Column, most: int | None = None) -> Column:
    """Distinct words of more than three characters that are not plain digits: all, or the first ``most``."""
    return _first(F.array_distinct(_found(F.lower(text), KEYWORD_PATTERN)), most)


def numbers(text: Column, most: int | None = None) -> Column:
    """Numbers, with at most one decimal part: all, or the first ``most``."""
    return _first(_found(text, NUMBER_PATTERN), most)


def word_count(text: Column) -> Column:
    return F.size(_found(text, r"(?U)[^\s\x1c-\x1f]++")).cast("long")


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal needle that is not empty."""
    rest = F.length(F.replace(text, needle, F.lit("")))
    return ((F.length(text) - rest) / F.length(needle)).cast("long")


def truncate_cell(text: Column, width: int = CELL_WIDTH) -> Column:
    cut = F.concat(F.substring(text, 1, width - 1), F.lit("…"))
    return F.when(F.length(text) > width, cut).otherwise(text)


@F.pandas_udf(T.StringType())
def four_digits(values: pd.Series) -> pd.Series:
    """A number with four significant digits. No built-in expression prints these, and Java's
    formats round the shortest decimal form of a number instead of the number itself."""
    return values.map("{:.4g}".format)


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as text: null as a dash, fractions with four significant digits."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        shown = four_digits(col(name).cast("double"))
    elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        shown = F.to_json(col(name))
    else:
        shown = col(name).cast("string")
    return F.when(col(name).isNull(), F.lit(MISSING_MARK)).otherwise(shown)


def row_text(df: DataFrame, names: Sequence[str]) -> Column:
    """``name: value`` for each column, joined by bars."""
    cells = [F.concat(F.lit(f"{n}: "), cell_text(df, n)) for n in names]
    return F.concat_ws(" | ", *cells)


def flat_metadata(df: DataFrame, struct_name: str) -> Column:
    """A struct as a flat string map: null entries left out, nested values as JSON."""
    entries = []
    for field in df.schema[struct_name].dataType.fields:
        value = col(struct_name).getField(field.name)
        nested = isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType))
        entries += [F.lit(field.name), F.to_json(value) if nested else value.cast("string")]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
