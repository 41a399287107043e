"""Missing-marker normalisation of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import quoted, text_columns

# Texts that mean "missing", compared in lower case after stripping.
MISSING_MARKERS = ("?", "na", "n/a", "null", "none", "", "nan", "missing")

#: No longer text is a marker in lower case: four bytes a character, and lower case never has fewer characters.
MARKER_BYTES = 4 * max(map(len, MISSING_MARKERS))
WHITE = " \t\n\x0b\f\r"
#: Line ends that are no white space here; the expression strips white space before one at the end of a text, too.
LINE_ENDS = ("\x85", "\u2028", "\u2029")


def ends_with(text: Column, characters: str | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for character in characters:
        found = found | F.endswith(text, F.lit(character))
    return found


def stripped(text: Column) -> Column:
    """Text without ``^\\s+|\\s+$``. Only its ends are looked at: that expression tries every gap between words."""
    by_expression = F.regexp_replace(text, r"^\s+|\s+$", "")
    both, left = F.btrim(text, F.lit(WHITE)), F.ltrim(text, F.lit(WHITE))
    return F.when(ends_with(text, LINE_ENDS), by_expression).when(ends_with(text, WHITE), both).otherwise(left)


def normalized(df: DataFrame) -> dict[str, Column]:
    """The text columns without white space at their ends, missing markers as NULL."""
    found = {}
    for name in text_columns(df):
        text = stripped(quoted(name).cast("string"))
        found[name] = F.when((F.octet_length(text) > MARKER_BYTES) | ~F.lower(text).isin(*MISSING_MARKERS), text)
    return found


def normalize_missing(df: DataFrame) -> DataFrame:
    """Strip white space in text columns and turn missing markers into NULL; other columns are untouched."""
    changed = normalized(df)
    return df.withColumns(changed) if changed else df


def changes(df: DataFrame) -> dict[str, Column]:
    """Per text column 1 where ``normalize_missing`` gives another value, else NULL."""
    return {name: F.when(~text.eqNullSafe(quoted(name)), F.lit(1)) for name, text in normalized(df).items()}
