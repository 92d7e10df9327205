"""Term filters, prefix search and searches for many terms at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adwatch.functions import text as X
from adwatch.operators.ordering import earliest, first_n

INLINE_TERMS = 100


def matching_terms(ads: DataFrame, terms: Sequence[str], title: Column, description: Column) -> DataFrame:
    """Relevance filter: keep ads with any non-empty term as substring of title and description."""
    kept = [t.lower() for t in terms if t]
    if not kept:
        return ads
    empty = F.lit("")
    blob = F.lower(F.concat_ws(" ", F.coalesce(title, empty), F.coalesce(description, empty)))
    return ads.where(X.contains_any(blob, kept))


def query_match(low: Column, query: str) -> Column:
    """A word of the lower-case text starts with a meaningful word of the query; plain substring when none is left."""
    tokens, hit = X.tokens_of(query), F.lit(False)
    for token in tokens:
        hit = hit | X.starts_word(low, token)
    return hit if tokens else low.contains(query.lower())


def _body(title: Column, description: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws("\n", F.coalesce(title, empty), F.coalesce(description, empty))


def prefix_search(ads: DataFrame, query: str, title: Column, description: Column) -> DataFrame:
    """Ads for one query. Its tokens are known while planning, so the test stays inside code generation."""
    if not query:
        return ads
    if X.tokens_of(query):
        return ads.where(query_match(F.lower(_body(title, description)), query))
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (title, description)]
    return ads.where(query_match(low[0], query) | query_match(low[1], query))


def search_body(title: str, description: str | None = None) -> Column:
    """The text that searches read."""
    return _body(F.col(title), F.col(description)) if description else F.coalesce(title, F.lit(""))


def term_tokens(terms: DataFrame) -> DataFrame:
    """Terms with their lower-case text and their useful words."""
    tokens = X.search_tokens(F.col("term"))
    return terms.select("term_id", "term", F.lower("term").alias("_needle"), tokens.alias("_tokens"))


def search_terms(ads: DataFrame, terms: DataFrame, key: str, title: str, description: str | None = None) -> DataFrame:
    """One search per term over all ads: the distinct ``(key, term_id, term)`` of all hits.

    ``terms`` is ``(term_id, term)``; terms that are null or empty find nothing. Rows of one key count as one ad, also
    those without a key. The result does not depend on the number of terms: up to ``INLINE_TERMS`` terms become conditions tested in one pass over each
    ad. A larger table joins on equality: every word of an ad yields its prefixes of the lengths in use, which meet
    the tokens without a candidate that fails; terms without tokens join on the grams of their own text.
    """
    body = search_body(title, description)
    listed = terms.select("term_id", "term").limit(INLINE_TERMS + 1).collect()
    if len(listed) <= INLINE_TERMS:
        return _search_inline(ads, terms.schema, listed, key, body).distinct()
    return _search_joined(ads, term_tokens(terms), key, body)


def _search_inline(ads: DataFrame, schema, listed: list, key: str, body: Column) -> DataFrame:
    low = F.col("_low")
    hits = [
        F.when(query_match(low, row["term"]), F.struct(F.lit(row["term_id"]).cast(schema["term_id"].dataType).alias("term_id"), F.lit(row["term"]).alias("term")))
        for row in listed
        if row["term"]
    ]
    split = ads.select(key, F.lower(body).alias("_low"))
    if not hits:
        return split.where("false").select(key, *[F.lit(None).cast(schema[n].dataType).alias(n) for n in ("term_id", "term")])
    return split.select(key, F.inline(F.array_compact(F.array(*hits))))


def _search_joined(ads: DataFrame, prepared: DataFrame, key: str, body: Column) -> DataFrame:
    worded = prepared.where(F.size("_tokens") > 0).select("term_id", "term", F.explode("_tokens").alias("_prefix"))
    lengths = worded.agg(F.collect_set(F.length("_prefix")).alias("n"))
    split = ads.select(key, F.array_distinct(X.words(body)).alias("_words"), F.lower(body).alias("_low"))
    prefixes = F.flatten(
        F.transform("_words", lambda w: F.transform(F.filter("_lengths", lambda n: n <= F.length(w)), lambda n: F.left(w, n)))
    )
    words = split.withColumn("_lengths", lengths.scalar()).select(key, F.explode(F.array_distinct(prefixes)).alias("_prefix"))
    by_word = words.join(worded, "_prefix").select(key, "term_id", "term").distinct()

    # Terms without a token are short or made of stop words: meet them on a leading gram, then verify.
    plain = prepared.where((F.size("_tokens") == 0) & (F.col("_needle") != ""))
    plain = plain.select("term_id", "term", "_needle", F.left("_needle", F.lit(3)).alias("_gram"))
    sizes = plain.agg(F.collect_set(F.length("_gram")).alias("n"))
    # A look-ahead yields overlapping grams in one pass over the text.
    none = F.array().cast("array<string>")
    grams = F.concat(
        *[
            F.when(F.array_contains("_sizes", n), F.array_distinct(F.regexp_extract_all("_low", F.lit(f"(?s)(?=(.{{{n}}}))"), 1))).otherwise(none)
            for n in (1, 2, 3)
        ]
    )
    text = split.withColumn("_sizes", sizes.scalar()).select(key, F.explode(grams).alias("_gram"))
    met = text.join(plain, "_gram").select(key, "term_id", "term", "_needle")
    whole = split.select(F.col(key).alias("_key"), "_low")
    by_text = met.join(whole, F.col(key).eqNullSafe(F.col("_key"))).where(F.contains("_low", "_needle")).select(key, "term_id", "term")
    return by_word.unionByName(by_text.distinct())


def first_hits(hits: DataFrame, key: str) -> DataFrame:
    """Each ad once, with the first term that found it."""
    return earliest(hits, [key], ["term_id"], ["term_id", "term"])


def expanded_terms(responses: DataFrame, limit: int = 0) -> DataFrame:
    """Seed answers ``(run_id, seed_no, terms)`` to distinct terms per run in first-seen order, optionally capped."""
    rows = responses.select("run_id", "seed_no", F.posexplode("terms").alias("position", "term"))
    distinct = earliest(rows, ["run_id", "term"], ["seed_no", "position"], ["seed_no", "position"])
    return first_n(distinct, ["run_id"], ["seed_no", "position", "term"], limit) if limit > 0 else distinct


def expanded_categories(responses: DataFrame) -> DataFrame:
    """Seed answers ``(run_id, seed_no, categories)`` to distinct target categories per run."""
    rows = responses.select("run_id", "seed_no", F.posexplode("categories").alias("position", "category"))
    return earliest(rows, ["run_id", "category"], ["seed_no", "position"], ["seed_no", "position"])


def site_labels_like(sites: DataFrame, typed: str) -> DataFrame:
    """Sites whose label contains the typed text, case ignored."""
    return sites.where(F.lower("label").contains(typed.lower()))

