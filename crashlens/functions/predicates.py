"""Predicates over text columns.

All follow three-valued logic: a NULL input gives a NULL predicate, which drops the row. The one exception is
``is_non_numeric``, where NULL is not a number and so passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Any text the float cast can accept: blanks and control characters are trimmed; then come a sign, if any, and a digit or a point, or
# NaN, Inf or Infinity and nothing else, in any case. "NA", "NONE" and the like are not tried.
_MAY_BE_NUMBER = r"^[\x00-\x20\x7f]*[-+]?([.0-9]|(?i:nan|inf|infinity)[\x00-\x20\x7f]*$)"


def _column(column: ColumnOrName) -> Column:
    return F.col(column) if isinstance(column, str) else column


def not_in(column: ColumnOrName, values: Iterable[str]) -> Column:
    return ~_column(column).isin(list(values))


def iin(column: ColumnOrName, values: Iterable[str]) -> Column:
    """IN, ignoring case."""
    return F.upper(_column(column)).isin([value.upper() for value in values])


def not_iin(column: ColumnOrName, values: Iterable[str]) -> Column:
    """NOT IN, ignoring case."""
    return ~F.lower(_column(column)).isin([value.lower() for value in values])


def icontains(column: ColumnOrName, text: str) -> Column:
    """Substring test, ignoring case."""
    return F.lower(_column(column)).contains(text.lower())


def contains_any(column: ColumnOrName, texts: Iterable[str]) -> Column:
    """Case-sensitive test for any of several substrings."""
    return reduce(or_, [_column(column).contains(text) for text in texts])


def any_column(predicate: Callable[[str], Column], columns: Iterable[str]) -> Column:
    """True where the predicate holds for at least one of the columns."""
    return reduce(or_, [predicate(column) for column in columns])


def at_least_text(column: ColumnOrName, floor: str, excluded: Iterable[str]) -> Column:
    """Text ordering ``>= floor`` (binary) without the excluded words, which would otherwise sort above it."""
    return not_in(column, excluded) & (_column(column) >= floor)


def parse_number(column: ColumnOrName, kind: str = "double") -> Column:
    """Text as a number, NULL where it does not parse.

    A failed parse raises and catches an exception inside the cast, which is some hundred times dearer than a
    look at its beginning, so only text that could be a number is tried.
    """
    text = _column(column)
    return F.when(text.rlike(_MAY_BE_NUMBER), text.try_cast(kind))


def is_non_numeric(column: ColumnOrName, kind: str = "float") -> Column:
    """True where text does not parse as a number, and for NULL."""
    return parse_number(column, kind).isNull()
