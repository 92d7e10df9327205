"""Detectors against ground truth: confusion matrix, readings per difficulty, score distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions.numbers import ratio, round_even
from adwatch.functions.text import keyword_category, keyword_flag

LABEL_COLUMNS = ("suspect", "categorie", "difficulte")


def eval_ads(ads: DataFrame) -> DataFrame:
    """Evaluation ads under the names the scorer reads."""
    return ads.select(
        "id", "title", "description", F.col("price").alias("price_amount"), F.col("currency").alias("price_currency"), "location"
    )


def detect_keywords(ads: DataFrame, text: Column, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``kw_flag`` and ``kw_category`` of the keyword detector."""
    return ads.withColumn("kw_category", keyword_category(text, lists)).withColumn(
        "kw_flag", keyword_flag(F.col("kw_category"))
    )


def pending_evaluation(ads: DataFrame, results: DataFrame) -> DataFrame:
    """Ads without a result yet: the rest of an interrupted evaluation."""
    return ads.join(results.select("id"), ads["id"].cast("string") == results["id"].cast("string"), "left_anti")


def evaluation_rows(ads: DataFrame, labels: DataFrame, results: DataFrame) -> DataFrame:
    """Ads that have both a label and a result."""
    key = F.col("id").cast("string").alias("id")
    truth = labels.select(key, *LABEL_COLUMNS)
    answers = results.select(key, "llm_score", "llm_category", "kw_flag", "kw_category")
    return ads.select(key).join(truth, "id").join(answers, "id")


def detectors(rows: DataFrame, threshold: float = fixed.EVALUATION_THRESHOLD) -> DataFrame:
    """One row per ad and detector: the model at ``threshold`` and the keyword detector."""
    answer = "struct<detector:string,flagged:boolean,found:string>"
    pair = F.array(
        F.struct(F.lit("llm_rag").alias("detector"), (F.col("llm_score") >= threshold).alias("flagged"), F.col("llm_category").alias("found")).cast(answer),
        F.struct(F.lit("baseline_motscles").alias("detector"), F.col("kw_flag").alias("flagged"), F.col("kw_category").alias("found")).cast(answer),
    )
    return rows.select(*LABEL_COLUMNS, F.inline(pair))


def confusion(rows: DataFrame, keys: tuple[str, ...] = ("detector",)) -> DataFrame:
    """tp, fp, fn, tn and the true positives with the right category, in one pass."""
    flagged, suspect = F.col("flagged"), F.col("suspect")
    return rows.groupBy(*keys).agg(
        F.count_if(flagged & suspect).alias("tp"),
        F.count_if(flagged & ~suspect).alias("fp"),
        F.count_if(~flagged & suspect).alias("fn"),
        F.count_if(~flagged & ~suspect).alias("tn"),
        F.count_if(flagged & suspect & (F.col("found") == F.col("categorie"))).alias("category_hits"),
    )


def quality(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and category accuracy to 3 places; 0.0 where nothing is counted."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(F.lit(2.0) * precision * recall / (precision + recall))
    return counts.select(
        *[c for c in counts.columns if c != "category_hits"],
        round_even(precision, 3).alias("precision"),
        round_even(recall, 3).alias("recall"),
        round_even(f1, 3).alias("f1"),
        round_even(ratio(F.col("category_hits"), tp), 3).alias("category_accuracy"),
    )


def by_difficulty(rows: DataFrame) -> DataFrame:
    """Per detector and difficulty: recall where ads are suspect, avoidance where they are not."""
    known = rows.where(F.col("difficulte").isin(fixed.DIFFICULTIES))
    counted = known.groupBy("detector", "difficulte").agg(
        F.count_if("flagged").alias("flagged"), F.count(F.lit(1)).alias("total")
    )
    wanted = F.col("difficulte").isin("explicite", "implicite")
    hits = F.when(wanted, F.col("flagged")).otherwise(F.col("total") - F.col("flagged"))
    return counted.select(
        "detector",
        "difficulte",
        F.when(wanted, "rappel").otherwise("evitement").alias("reading"),
        round_even(ratio(hits, F.col("total")), 3).alias("value"),
        "flagged",
        "total",
    )


def corpus_summary(labels: DataFrame) -> DataFrame:
    """Counts of an evaluation corpus as ``(measure, code, n)`` rows."""
    trap = F.coalesce("piege", F.lit(False))
    grouped = labels.groupBy("suspect", trap.alias("piege"), "categorie", "difficulte").agg(F.count(F.lit(1)).alias("n"))
    suspect, trap = F.col("suspect"), F.col("piege")

    def measure(name: str, code: Column, when: Column | None = None) -> Column:
        row = F.struct(F.lit(name).alias("measure"), code.alias("code"))
        return row if when is None else F.when(when, row)

    none = F.lit("")
    measures = F.array(
        measure("total", none),
        measure("suspects", none, suspect),
        measure("pieges", none, trap),
        measure("benignes", none, ~suspect & ~trap),
        measure("difficulte", F.col("difficulte")),
        measure("categorie", F.col("categorie"), suspect),
    )
    return grouped.select("n", F.inline(F.array_compact(measures))).groupBy("measure", "code").agg(F.sum("n").alias("n"))


def scored_labels(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Results with a label: ``(id, score, suspect, piege, difficulte)``."""
    key = F.col("id").cast("string").alias("id")
    truth = labels.select(key, "suspect", F.coalesce("piege", F.lit(False)).alias("piege"), "difficulte")
    return results.select(key, F.col("llm_score").cast("decimal(4,3)").alias("score")).join(truth, "id")


def score_groups(rows: DataFrame) -> DataFrame:
    """Scores with every group they count in: illicit or licit, traps, and the difficulty."""
    groups = F.array(
        F.when(F.col("suspect"), F.lit("illicites")).otherwise(F.lit("licites")),
        F.when(F.col("piege"), F.lit("pieges")),
        F.concat(F.lit("niveau:"), F.col("difficulte")),
    )
    return rows.select("score", F.explode(F.array_compact(groups)).alias("grp"))


def score_stats(grouped: DataFrame) -> DataFrame:
    """n, min, max, mean (three places) and upper median per group.

    A score has three decimals, so a group has at most 1,001 distinct values. Counting those first leaves a table
    of bounded size, from which the median follows by a running count; no group is ever sorted as a whole.
    """
    counts = grouped.groupBy("grp", "score").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("grp")
    running = F.sum("c").over(whole.orderBy("score"))
    placed = counts.select("grp", "score", "c", running.alias("upto"), F.sum("c").over(whole).alias("n"))
    above = F.col("upto") > F.floor(F.col("n") / 2)
    return placed.groupBy("grp").agg(
        F.max("n").alias("n"),
        F.min("score").cast("double").alias("min"),
        F.max("score").cast("double").alias("max"),
        round_even(F.sum(F.col("score").cast("decimal(20,3)") * F.col("c")).cast("double") / F.max("n"), 3).alias("mean"),
        F.min(F.when(above, F.col("score"))).cast("double").alias("median"),
    )


def score_histogram(rows: DataFrame) -> DataFrame:
    """Ten bins of 0.1 per class, the last one closed, empty bins included."""
    tenth = F.least(F.lit(9), F.floor(F.col("score").cast("double") * 10).cast("int"))
    counted = rows.groupBy(tenth.alias("bin")).agg(
        F.count_if("suspect").alias("illicites"), F.count_if(~F.col("suspect")).alias("licites")
    )
    bins = rows.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counted, "bin", "left").na.fill(0, ["illicites", "licites"])


def separation(rows: DataFrame) -> DataFrame:
    """Lowest illicit score, highest licit score and the gap between them."""
    found = rows.agg(
        F.min(F.when(F.col("suspect"), F.col("score"))).alias("lowest_illicit"),
        F.max(F.when(~F.col("suspect"), F.col("score"))).alias("highest_licit"),
    )
    gap = F.col("lowest_illicit") - F.col("highest_licit")
    return found.select(
        F.col("lowest_illicit").cast("double"), F.col("highest_licit").cast("double"),
        gap.cast("double").alias("gap"), (gap > 0).alias("clean"),
    )


def common_ids(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids present on both sides."""
    key = F.col("id").cast("string").alias("id")
    return results.select(key).intersect(labels.select(key))
