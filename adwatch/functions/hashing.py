"""Fingerprints and deterministic identifiers."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch import fixed
from adwatch.functions.text import sha256


def json_text(c: Column) -> Column:
    """One value as JSON text, ``null`` for null. Built from a one-element array, brackets cut off."""
    quoted = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def content_hash(fields: dict[str, Column]) -> Column:
    """Fingerprint of an ad's content: JSON object with sorted keys, nulls kept.

    ``price_amount`` comes as JSON text (``float_text`` of a parsed price), since 12 and 12.0 are different texts.
    """
    parts = []
    for name in fixed.CONTENT_FIELDS:
        value = fields.get(name, F.lit(None).cast("string"))
        text = F.coalesce(value, F.lit("null")) if name == "price_amount" else json_text(value)
        parts += [F.lit(("{" if not parts else ", ") + f'"{name}": '), text]
    return sha256(F.concat(*parts, F.lit("}")))


def canonical_entry(entry: dict[str, Column]) -> Column:
    """Compact sorted JSON of the sealed fields. ``detail`` is already JSON text."""
    parts = []
    for name in fixed.SEALED_FIELDS:
        value = entry[name]
        text = F.coalesce(value, F.lit("{}")) if name == "detail" else json_text(value)
        parts += [F.lit(("{" if not parts else ",") + f'"{name}":'), text]
    return F.concat(*parts, F.lit("}"))


@F.pandas_udf(T.StringType())
def _sorted_json(detail: pd.Series) -> pd.Series:
    def tidy(text: str) -> str | None:
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return detail.map(tidy, na_action="ignore")


def canonical_detail(detail: Column) -> Column:
    """JSON text of another writer with sorted keys and no blanks.

    A VARIANT would sort the keys too, but it prints 1.0 as 1, and the seal covers the text.
    """
    return _sorted_json(detail)


def entry_hash(prev_hash: Column, canonical: Column) -> Column:
    return sha256(F.concat(F.coalesce(prev_hash, F.lit("")), canonical))


def name_uuid(name: Column, namespace: str = fixed.RULE_NAMESPACE) -> Column:
    """Version-5 UUID of a name."""
    space = F.unhex(F.lit(uuid.UUID(namespace).hex))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def rule_id(source: Column, title: Column) -> Column:
    """Stable id of a rule, so that a second ingest replaces the first."""
    return name_uuid(F.concat(source, F.lit("|"), title))


def iso_stamp(ts: Column) -> Column:
    """ISO-8601 in UTC with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
