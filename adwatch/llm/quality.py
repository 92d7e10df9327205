"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit, and policies are masks over the bits.

``ledger`` measures each whole text and stores the measurements beside ``failed``, one bit a rule. A policy is a row
(version, mask); ``apply_policies`` decides by one bitwise and per version, ``ablations`` counts from the table of distinct
masks what each rule rejects, alone and at all, without looking at a text again. JVM expressions only.

* Null and empty texts have no words: all measurements 0, rule ``short`` failed. Repeated rows are measured each for
  itself; an empty table gives an empty ledger and ablations of zero rows. Other columns are carried along; one that has
  the name of an output is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adwatch.llm.common import SPACE, with_outputs

#: Symbols counted, and limits of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Limits of the further rules.
MAX_SYMBOLS_PERCENT, MAX_DUP_LINES_PERCENT, MIN_MEAN_CHARS, MAX_MEAN_CHARS = 30, 50, 2, 20

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def rules() -> dict[str, Column]:
    """The rules in order of their bits, as conditions on the measurements under which a text fails."""
    words = F.col("n_words")
    return {
        "short": words < MIN_WORDS,
        "repeated": F.col("n_repeat_words") * 100 > words * MAX_REPEATED_PERCENT,
        "symbols": F.col("n_symbols") * 100 > words * MAX_SYMBOLS_PERCENT,
        "dup_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * MAX_DUP_LINES_PERCENT,
        "tiny_words": F.col("word_chars") < words * MIN_MEAN_CHARS,
        "huge_words": F.col("word_chars") > words * MAX_MEAN_CHARS,
    }


BITS = {name: 1 << i for i, name in enumerate(("short", "repeated", "symbols", "dup_lines", "tiny_words", "huge_words"))}
BASE_MASK = BITS["short"] | BITS["repeated"]
#: Policies by version: the rules whose failure rejects a text.
POLICIES = {1: BASE_MASK, 2: BASE_MASK | BITS["symbols"] | BITS["dup_lines"], 3: sum(BITS.values())}


def _repeated(words: Column) -> Column:
    """Words in windows of three that occur twice or more, from an array of words.

    Windows are compared by 64-bit hash within one text. They are sorted with their places; a window equal to a
    neighbour is repeated, and each repeated window adds the words that the one before it in the text has not covered.
    """
    last = F.size(words) - 2
    keyed = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("k"), i.alias("i")))
    # a staged lambda binds each array once
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    places = lambda s: F.filter(s, lambda x, j: (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"]))
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    of = once(F.sort_array(keyed), lambda s: once(F.sort_array(F.transform(places(s), lambda x: x["i"])), covered))
    return F.when(last > 0, of).otherwise(F.lit(0)).cast("long")


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """The table with the measurements and ``failed``, the bits of the rules that each text fails."""
    rows = with_outputs(df, *MEASUREMENTS, "failed")
    blank = F.lit(" \t\n\x0b\f\r")
    held = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = F.btrim(held, blank)
    kept = [F.col(f"`{c}`") for c in rows.columns]
    staged = rows.select(
        *kept, held.alias("_t"), F.when(F.length(bare) > 0, F.split(bare, SPACE)).otherwise(F.array().cast("array<string>")).alias("_w"),
        F.filter(F.split(held, "\n"), lambda x: F.length(F.btrim(x, blank)) > 0).alias("_l"))
    measured = staged.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_w")).alias("n_repeat_words"))
    bits = [F.when(fails, F.lit(BITS[name])).otherwise(F.lit(0)).cast("long") for name, fails in rules().items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def passes(mask: int) -> Column:
    """Whether a ledger row fails none of a policy's rules."""
    return F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policies(entries: DataFrame, policies: dict[int, int] = POLICIES) -> DataFrame:
    """The ledger with ``kept``: a map of policy version to decision."""
    pairs = [x for version, mask in policies.items() for x in (F.lit(version), passes(mask))]
    return entries.withColumn("kept", F.create_map(*pairs))


def ablations(entries: DataFrame, policies: dict[int, int] = POLICIES) -> DataFrame:
    """Per policy and rule: texts that fail the rule, that fail it alone, and that would stay without it.

    One aggregation to the distinct masks (at most two to the power of the rules), then bitwise counts over those.
    """
    spark = entries.sparkSession
    masks = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    table = spark.createDataFrame([(v, m, name, BITS[name]) for v, m in policies.items() for name in BITS if m & BITS[name]],
                                  "version int, mask long, rule string, bit long")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    others = F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return masks.join(F.broadcast(table), F.lit(True)).groupBy("version", "rule").agg(
        count(fails)("n_failed"), count(others)("n_failed_alone"),
        count(F.col("failed").bitwiseAND(F.col("mask")) == 0)("n_kept"),
        count(F.col("failed").bitwiseAND(F.col("mask").bitwiseXOR(F.col("bit"))) == 0)("n_kept_without"))
