"""Reading model responses: JSON in free text to typed columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch import fixed
from adwatch.functions.numbers import once, round_even, to_number
from adwatch.functions.price import loose_amount
from adwatch.functions.text import category, strip
from adwatch.functions.url import clean_url


def json_object(raw: Column) -> Column:
    """The JSON object inside a free-text answer as VARIANT, null when there is none."""

    def parse(text: Column) -> Column:
        return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))

    def only_object(found: Column) -> Column:
        return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)

    return once(once(strip(F.regexp_replace(strip(raw), fixed.ANSWER_FENCE, "")), parse), only_object)


def _text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _has(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def score_response(raw: Column) -> Column:
    """``struct(ok, suspicion_score, category, rationale)``; ``ok`` is false for an unusable answer."""
    return once(json_object(raw), _score)


def _score(v: Column) -> Column:
    number = F.when(_has(v, "score"), to_number(_text(v, "score"))).otherwise(F.lit(0.0))

    def row(n: Column) -> Column:
        ok = v.isNotNull() & n.isNotNull()
        return F.struct(
            ok.alias("ok"),
            F.when(ok, round_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)), 3)).alias("suspicion_score"),
            F.when(ok, category(_text(v, "categorie"))).alias("category"),
            F.when(ok, strip(F.coalesce(_text(v, "justification"), F.lit("")))).alias("rationale"),
        )

    return once(number, row)


def _strings(v: Column, key: str) -> Column:
    """A list of strings under ``key``, null when missing, empty or of another shape."""
    values = F.try_variant_get(v, f"$.{key}", "array<string>")
    return F.when(F.size(values) > 0, values)


def _tidy(values: Column) -> Column:
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda s: F.lower(strip(s)))
    return F.array_distinct(F.filter(trimmed, lambda s: s.isNotNull() & (s != "")))


def terms_response(raw: Column) -> Column:
    """Search terms of an expansion answer: trimmed, lower-case, distinct, order kept."""

    def terms(v: Column) -> Column:
        return F.when(v.isNotNull(), _tidy(F.coalesce(_strings(v, "termes"), _strings(v, "terms"))))

    return once(json_object(raw), terms)


def categories_response(raw: Column) -> Column:
    """Target categories of an expansion answer: a list or one string, known codes only."""
    known = F.array(*[F.lit(c) for c in fixed.TARGET_CATEGORIES])

    def single(v: Column, key: str) -> Column:
        return F.when(_text(v, key).isNotNull() & ~_text(v, key).startswith("["), F.array(_text(v, key)))

    def codes(v: Column) -> Column:
        found = F.coalesce(*[build(v, key) for key in ("categories", "categorie") for build in (_strings, single)])
        return F.when(v.isNotNull(), F.array_intersect(_tidy(found), known))

    return once(json_object(raw), codes)


@F.pandas_udf(T.StringType())
def _first_array(raw: pd.Series) -> pd.Series:
    decode = json.JSONDecoder().raw_decode

    def cut(text: str | None) -> str | None:
        at = text.find("[") if text else -1
        while at >= 0:
            try:
                return text[at:decode(text, at)[1]]
            except (ValueError, RecursionError):  # no array starts here, or one deeper than any answer
                at = text.find("[", at + 1)
        return None

    return raw.map(cut, na_action="ignore")


def first_json_array(raw: Column) -> Column:
    """Text of the first JSON array in a free-text answer.

    Spark has no operator that cuts a balanced array out of text, so answers go through Arrow.
    """
    return _first_array(raw)


def _as_text(v: Column) -> Column:
    """The value of a variant when it is a JSON string."""
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def array_items(array_text: Column) -> Column:
    """Elements of a JSON array as VARIANT, null when the text is not an array."""
    return F.try_variant_get(F.try_parse_json(array_text), "$", "array<variant>")


def explored_ads(items: Column) -> Column:
    """Valid ads among the elements of a JSON array: objects with a title, fields trimmed, currency upper-case, URL cleaned.

    ``price_json`` keeps the price as it was written, for identities and content hashes.
    """

    def field(item: Column, name: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", "variant")

    def ad(item: Column) -> Column:
        return F.struct(
            strip(_as_text(field(item, "title"))).alias("title"),
            strip(_as_text(field(item, "description"))).alias("description"),
            structured(field(item, "price_amount")).alias("price_amount"),
            F.to_json(field(item, "price_amount")).alias("price_json"),
            F.upper(strip(_as_text(field(item, "price_currency")))).alias("price_currency"),
            strip(_as_text(field(item, "seller"))).alias("seller"),
            strip(_as_text(field(item, "location"))).alias("location"),
            clean_url(_as_text(field(item, "url"))).alias("url"),
        )

    ads = F.transform(items, ad)
    return F.filter(ads, lambda a: a["title"].isNotNull() & (a["title"] != ""))


def structured(v: Column) -> Column:
    """A JSON number or numeric text as double."""
    return to_number(F.try_variant_get(v, "$", "string"))


def parsed_ad(raw: Column) -> Column:
    """Six fields of a parsed page plus ``ok`` and ``problems``."""
    return once(json_object(raw), _parsed)


def _parsed(v: Column) -> Column:
    amount = F.try_variant_get(v, "$.price_amount", "variant")
    is_text = F.schema_of_variant(amount) == "STRING"
    price = F.when(is_text, loose_amount(_text(v, "price_amount"))).otherwise(structured(amount))
    title = _text(v, "title")
    return F.struct(
        title.alias("title"),
        price.alias("price_amount"),
        F.nullif(F.upper(_as_text(F.try_variant_get(v, "$.price_currency", "variant"))), F.lit("")).alias("price_currency"),
        _text(v, "description").alias("description"),
        _text(v, "location").alias("location"),
        _text(v, "seller").alias("seller"),
        v.isNotNull().alias("parsed"),
    )
