"""Boilerplate lines by their spread over sites: sketches per line hash, exact counts near the threshold.

Every line that holds a word is known by a hash. A HyperLogLog sketch of its sites is built in each map task and merged by
aggregation. Lines whose estimate is clear of the threshold are decided by it; for lines within ``MARGIN`` of it, and only
for those, distinct pairs of line and site are counted exactly. A line on ``min_sites`` sites or more is boilerplate: it
stays where it first stands (smallest id, then first line), and every other place loses it.
JVM expressions only.

* Lines are parts between newlines, compared without white space at the ends; lines without a word are never removed.
  Null texts stay null and empty ones empty. A null site counts as one site. Rows with equal ids: one of their places is the
  first. An empty table gives an empty result. Other columns are carried along; one that has the name of an output is
  replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adwatch.llm.common import settle, with_outputs

#: Sites on which a line counts as boilerplate.
MIN_SITES = 10
#: Base-2 logarithm of the sketch's buckets, and the share around the threshold in which sketches are not trusted:
#: over ten standard errors (1.04 / sqrt(4096)) of an estimate.
SKETCH_BITS, MARGIN = 12, 0.25
#: Places of one line, and share of all places, from which a line is hot: its places are dealt over several tasks.
HOT_PLACES, HOT_SHARE = 100_000, 1 / 50_000
BLANK = " \t\x0b\f\r"


def places(df: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """One row per line with a word: doc_id, key (hash of the text), site, place, line (hash)."""
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), _hash(F.col(f"`{text}`")).alias("key"),
                     F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("\x00")).alias("site"),
                     F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("place", "line"))
    bare = F.btrim("line", F.lit(BLANK))
    return rows.where(F.length(bare) > 0).select(
        "doc_id", "key", "site", "place", _hash(bare).alias("line"))


def _hash(text):
    """128 bits of a text."""
    return F.unhex(F.md5(text.cast("binary")))


def spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Boilerplate lines: line, n_sites (estimated, or exact near the threshold), n_places, first (doc_id, key, place)."""
    sketched = lines.groupBy("line").agg(
        F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"), F.count(F.lit(1)).alias("n_places"),
        F.min(F.struct("doc_id", "key", "place")).alias("first"))
    estimated = settle(sketched.select("line", F.hll_sketch_estimate("sketch").alias("n_sites"), "n_places", "first")
                       .where(F.col("n_sites") >= int(min_sites * (1 - MARGIN))))
    near = F.col("n_sites") < min_sites * (1 + MARGIN)
    unsure = estimated.where(near)
    exact = (lines.select("line", "site").join(unsure.select("line"), "line", "left_semi").distinct()
             .groupBy("line").agg(F.count(F.lit(1)).alias("n_sites")))
    counted = unsure.drop("n_sites").join(exact, "line")
    found = estimated.where(~near).unionByName(counted.select(*estimated.columns))
    return found.where(F.col("n_sites") >= min_sites)


def _met(lines: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """The places of boilerplate lines. Hot lines, fewer than ``1 / HOT_SHARE``, are cut into parts."""
    limit = F.greatest(F.lit(HOT_PLACES), boilerplate.agg(F.sum("n_places") * HOT_SHARE).scalar())
    parts = F.ceil(F.col("n_places") / limit).cast("int")
    often = boilerplate.where(F.col("n_places") > limit).select("line", parts.alias("_parts"))
    if often.isEmpty():  # of a written table
        return lines.join(boilerplate.select("line", "first"), "line")
    hot = F.broadcast(often)
    dealt = lines.join(hot, "line", "left").withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("doc_id", "key", "place"), F.col("_parts"))).otherwise(0).cast("int"))
    every = boilerplate.select("line", "first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return dealt.drop("_parts").join(every, ["line", "_part"]).drop("_part")


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
          removed: str = "n_removed_lines") -> DataFrame:
    """The table with boilerplate lines taken out of ``text`` and ``removed``, the number of lines each row has lost.

    A text with no line of its own is a copy of others rather than one with boilerplate in it: it stays whole, for
    near-duplicate removal to judge.
    """
    rows = with_outputs(df, removed)
    kept = rows.columns
    lines = places(rows, doc_id, text, site)
    boilerplate = settle(spread(lines, min_sites)).select("line", "first", "n_places")
    stays = F.col("first").eqNullSafe(F.struct("doc_id", "key", "place"))
    hits = (_met(lines.drop("site"), boilerplate).groupBy("doc_id", "key")
            .agg(F.collect_set(F.struct("place", stays.alias("stays"))).alias("hits")))
    lost = hits.select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.size("hits").alias("_hits"),
        F.transform(F.filter("hits", lambda h: ~h["stays"]), lambda h: h["place"]).alias("_lost")).where(F.size("_lost") > 0)
    own = F.col(f"`{text}`")
    joined = rows.join(lost, F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (_hash(own) == F.col("_key")), "left")
    parts = joined.withColumn("_parts", F.when(F.col("_lost").isNotNull(), F.split(own, "\n")))
    worded = F.size(F.filter("_parts", lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0))
    takes = F.col("_lost").isNotNull() & (F.col("_hits") < worded)
    left = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_lost"))
    shorter = F.array_join(F.transform(left, lambda i: F.get("_parts", i)), "\n")
    flagged = parts.withColumn("_takes", F.coalesce(takes, F.lit(False)))
    return flagged.select(
        *[F.when(F.col("_takes"), shorter).otherwise(own).alias(c) if c == text else F.col(f"`{c}`") for c in kept],
        F.when(F.col("_takes"), F.size("_lost")).otherwise(F.lit(0)).cast("long").alias(removed))
