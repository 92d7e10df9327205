"""Row checks and violation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions.text import blank


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of the blank fields, in the given order."""
    names = F.array(*[F.when(blank(c), F.lit(name)) for name, c in fields.items()])
    return F.filter(names, lambda n: n.isNotNull())


def record_problems(title: Column, price: Column) -> Column:
    """``struct(ok, problems)``: a title is needed, a price must be numeric text or null."""
    bad_price = price.isNotNull() & price.cast("string").try_cast("double").isNull()
    names = F.array(F.when(blank(title), F.lit("title")), F.when(bad_price, F.lit("price_amount")))
    problems = F.filter(names, lambda n: n.isNotNull())
    return F.struct((F.size(problems) == 0).alias("ok"), problems.alias("problems"))


def identified(ads: DataFrame, column: str = "external_id") -> DataFrame:
    """Ads with an identity; the others cannot be matched again."""
    return ads.where(F.col(column).isNotNull() & (F.col(column) != ""))


def invalid_codes(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose code is outside its vocabulary."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(allowed)))


def incoherent_scores(scores: DataFrame) -> DataFrame:
    """Low scores with a risk category, high scores without one."""
    score, none = F.col("suspicion_score"), F.col("category") == fixed.NO_CATEGORY
    return scores.where(((score < fixed.COHERENCE_LOW) & ~none) | ((score > fixed.COHERENCE_HIGH) & none))


def out_of_range_scores(scores: DataFrame) -> DataFrame:
    return scores.where(~F.col("suspicion_score").between(0, 1))


def missing_tables(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected names that are not there."""
    return expected.select("name").subtract(present.select("name"))
