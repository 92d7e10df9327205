"""Four price readers; each returns what its kind of source needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions.numbers import to_number
from adwatch.functions.text import SPACE

_STRICT = fixed.STRICT_PRICE.replace(r"[\d'’.,\s]", r"[\d'’.," + SPACE[1:]).replace(r"\s*", SPACE + "*")
_TOLERANT = fixed.TOLERANT_PRICE.replace(r"\s*", SPACE + "*")


def _priced(text: Column, pattern: str, amount: Column) -> Column:
    """Text without a match extracts as empty, which is neither a number nor a currency."""
    currency = F.nullif(F.upper(F.regexp_extract(text, pattern, 2)), F.lit(""))
    return F.struct(amount.try_cast("double").alias("amount"), currency.alias("currency"))


def strict_price(text: Column) -> Column:
    """``484 CHF`` gives ``(484.0, CHF)``; a currency is needed, a bad number keeps the currency."""
    raw = F.translate(F.regexp_extract(text, _STRICT, 1), ",", ".")
    return _priced(text, _STRICT, F.regexp_replace(raw, r"[^\d.]", ""))


def tolerant_price(text: Column) -> Column:
    """``1'250 CHF`` gives ``(1250.0, CHF)``; the currency may be missing."""
    return _priced(text, _TOLERANT, F.translate(F.regexp_extract(text, _TOLERANT, 1), ",'’", "."))


def structured_amount(value: Column) -> Column:
    """Number or numeric text of structured data."""
    return to_number(F.translate(value.cast("string"), ",'", "."))


def loose_amount(text: Column) -> Column:
    """``1'200.-`` gives 1200.0: keep digits and dots."""
    return to_number(F.regexp_replace(F.translate(text, ",", "."), r"[^\d.]", ""))
