"""String functions that agree with the code-point and white-space rules of Python's str and re."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character of white space in a Java pattern under ``(?U)``: the Unicode class and the four information separators.
WS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """White space off both ends; a run of white space within the text is scanned once."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?U)\A{WS}+", ""), rf"(?U)(?<!{WS}){WS}++\z", "")


def held(c: Column) -> Column:
    """``c`` as a generated column: filters on it are not pushed below, so a long expression is evaluated once a row."""
    return F.explode(F.array(c))


def first_of(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = F
    for condition, name in cases:
        out = out.when(condition, F.lit(name))
    return F.lit(otherwise) if out is F else out.otherwise(F.lit(otherwise))


def count_of(c: Column, piece: str) -> Column:
    """Occurrences of a non-empty string that do not overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def truthy(c: Column) -> Column:
    """A string that is there and not empty, else null."""
    return F.when(c != "", c)


def words(c: Column) -> Column:
    """The words between runs of blanks, tabs and line ends."""
    return F.filter(F.split(c, r"[ \t\n\r]+"), lambda w: w != "")


#: The white-space class for DuckDB's patterns.
SQL_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def sql_strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{SQL_WS}+', ''), '{SQL_WS}+$', '')"
