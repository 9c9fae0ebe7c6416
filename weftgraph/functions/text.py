"""Metadata access and the numeric-or-lexical comparison."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number: no padding, no digit separators, no NaN or infinity.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def json_field(metadata: Column, name: str) -> Column:
    """The value at a top-level key of JSON metadata; '' where it is missing or the text is no JSON."""
    return F.coalesce(F.get_json_object(metadata, f"$['{name}']"), F.lit(""))


def textual_field(metadata: Column, name: str) -> Column:
    """The value found by scanning the text for the quoted key, as lenient readers do; '' where it is missing."""
    return F.coalesce(F.regexp_extract(metadata, f'"{re.escape(name)}":[ "]*([^",]*)', 1), F.lit(""))


def compare(left: Column, right: str) -> Column:
    """-1, 0 or 1: by value if both sides are numbers, else by bytes."""
    lexical = F.when(left < right, -1).when(left > right, 1).otherwise(0)
    if not re.match(NUMBER, right):
        return lexical
    value, other = F.expr("try_cast(null as double)") if left is None else left.try_cast("double"), float(right)
    numeric = F.when(value < other, -1).when(value > other, 1).otherwise(0)
    return F.when(left.rlike(NUMBER), numeric).otherwise(lexical)
