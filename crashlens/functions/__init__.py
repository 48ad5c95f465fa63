"""Column predicates that are safe with missing values."""

from crashlens.functions.predicates import (
    any_column,
    at_least_text,
    contains_any,
    icontains,
    iin,
    is_non_numeric,
    not_iin,
    not_in,
    parse_number,
)

__all__ = [
    "any_column",
    "at_least_text",
    "contains_any",
    "icontains",
    "iin",
    "is_non_numeric",
    "not_iin",
    "not_in",
    "parse_number",
]
