"""Number parsing, rounding and printing that agree with IEEE doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time, however often ``use`` reads it.

    A column named twice in an expression is computed twice inside conditional branches; a lambda variable is not.
    """
    return F.transform(F.array(value), use)[0]


def to_number(text: Column) -> Column:
    """Text to double, null when it is not a plain decimal number."""
    text = text.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def round_even(x: Column, digits: int) -> Column:
    """Round the binary value of a double half to even.

    ``round`` is half-up and ``bround`` looks at the decimal text; ``format_number`` looks at the exact
    binary value, so 2.675 gives 2.67.
    """
    return F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit("")).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, 0.0 on an empty denominator."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator.cast("double") / denominator.cast("double"))


def float_text(x: Column) -> Column:
    """Shortest decimal text of a double without an exponent between 1e-4 and 1e16 (``484.0``)."""
    x = x.cast("double")
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    size = F.abs(x)
    wide = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(wide, plain).otherwise(x.cast("string"))
