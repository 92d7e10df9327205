"""Bands, labels, prompt texts and the run narrative."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions.numbers import float_text, round_even, to_number
from adwatch.functions.text import strip


def _mapped(code: Column, table: dict[str, str]) -> Column:
    out = None
    for key, label in table.items():
        out = F.when(code == key, F.lit(label)) if out is None else out.when(code == key, F.lit(label))
    return out


def tolerant_score(value: Column) -> Column:
    """Score as double; null and non-numeric count as 0."""
    return F.coalesce(to_number(value), F.lit(0.0))


def risk_band(score: Column) -> Column:
    return (
        F.when(score >= fixed.ALERT_THRESHOLD, "eleve").when(score >= fixed.WATCH_THRESHOLD, "moyen").otherwise("normal")
    )


def points(score: Column) -> Column:
    """Score on a scale of 100."""
    return round_even(score.cast("double") * 100, 0).cast("int")


def category_label(code: Column) -> Column:
    return F.coalesce(_mapped(code, fixed.CATEGORY_LABELS), code)


def decision_label(decision: Column) -> Column:
    return F.coalesce(_mapped(decision, fixed.DECISION_LABELS), F.lit(fixed.NOT_REVIEWED_LABEL))


def origin_label(mode: Column) -> Column:
    return F.coalesce(_mapped(mode, fixed.ORIGIN_LABELS), F.lit(fixed.UNKNOWN_LABEL))


def depth_steps(depth: Column) -> Column:
    out = None
    for name, steps in fixed.DEPTH_STEPS.items():
        out = F.when(depth == name, steps) if out is None else out.when(depth == name, steps)
    return out.otherwise(fixed.DEPTH_STEPS[fixed.DEFAULT_DEPTH])


def third_party_transfer(model: Column, api_base: Column) -> Column:
    """True when the model's provider lies outside the house."""
    provider = F.when(model.contains("/"), F.substring_index(model, "/", 1)).otherwise("")
    base = F.coalesce(api_base, F.lit(""))
    return F.when(provider == fixed.THIRD_PARTY_PROVIDER, True).otherwise(
        (provider == fixed.OPEN_PROVIDER) & ((base == "") | base.contains(fixed.OPEN_PROVIDER_HOST))
    )


def compose_location(postal_code: Column, locality: Column) -> Column:
    parts = [F.nullif(c, F.lit("")) for c in (postal_code, locality)]
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def ad_prompt(title: Column, description: Column, amount: Column, currency: Column, location: Column) -> Column:
    """The ad as the scorer reads it; price and place only when known."""
    empty = F.lit("")
    price = strip(F.concat(F.lit(fixed.PROMPT_PRICE), float_text(amount), F.lit(" "), F.coalesce(currency, empty)))
    return F.concat_ws(
        "\n",
        F.concat(F.lit(fixed.PROMPT_TITLE), F.coalesce(title, empty)),
        F.concat(F.lit(fixed.PROMPT_DESCRIPTION), F.coalesce(description, empty)),
        F.when(amount.isNotNull(), price),
        F.when(location != "", F.concat(F.lit(fixed.PROMPT_PLACE), location)),
    )


def rules_prompt(rules: Column) -> Column:
    """The retrieved rules as a prompt block, nearest first; empty without rules."""

    def line(r: Column) -> Column:
        return F.concat(F.lit("- ["), r["category"], F.lit("] "), r["title"], F.lit(" ("), r["source"], F.lit(") : "), r["text"])

    block = F.concat(F.lit("\n" + fixed.PROMPT_RULES + "\n"), F.array_join(F.transform(rules, line), "\n"))
    return F.when(F.size(rules) > 0, block).otherwise("")


def rule_text(title: Column, text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), strip(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(text, F.lit("")))))


def ad_query_text(title: Column, description: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), strip(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))))


def exploration_brief(
    template: str,
    start_url: Column,
    focus: Column,
    terms: Column,
    focus_text: str = "\nObjet prioritaire : {focus}\n{examples}",
    examples_text: str = "Exemples, sans s'y limiter : {terms}.\n",
    most_terms: int | None = None,
) -> Column:
    """Fill ``{start_url}`` and ``{focus_block}`` of a brief; no block without a focus. All terms, or the first ``most_terms``."""
    focus = strip(F.coalesce(focus, F.lit("")))
    kept = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t != "")
    if most_terms is not None:
        kept = F.slice(kept, 1, most_terms)
    examples = F.when(F.size(kept) > 0, _fill(examples_text, terms=F.array_join(kept, ", "))).otherwise("")
    block = F.when(focus != "", _fill(focus_text, focus=focus, examples=examples)).otherwise("")
    return _fill(template, start_url=start_url, focus_block=block)


def _fill(template: str, **values: Column) -> Column:
    """Replace ``{name}`` by a column, left to right."""
    start = F.lit(template)
    return reduce(lambda c, item: F.replace(c, F.lit("{" + item[0] + "}"), item[1].cast("string")), values.items(), start)


def _labels(codes: Column) -> Column:
    return F.array_join(F.transform(codes, category_label), ", ")


def scoring_sentence(scored: Column, alerts: Column, per_category: Column) -> Column:
    """``per_category`` is an array of ``struct(category, n)``; shown by count, larger first."""
    numbered = F.transform(per_category, lambda e, i: F.struct((-e["n"]).alias("n"), i.alias("at"), e["category"].alias("category")))
    detail = F.transform(
        F.array_sort(numbered),
        lambda e: F.concat((-e["n"]).cast("string"), F.lit(" "), category_label(e["category"])),
    )
    scored, alerts = F.coalesce(scored, F.lit(0)), F.coalesce(alerts, F.lit(0))
    return F.when(
        F.size(per_category) > 0,
        _fill(fixed.SENTENCE_SCORING, alerts=alerts, scored=scored, detail=F.array_join(detail, ", ")),
    ).otherwise(_fill(fixed.SENTENCE_SCORING_NONE, scored=scored))


def run_narrative(
    exploration: Column,
    sites: Column,
    focus: Column,
    target_categories: Column,
    term_count: Column,
    collected: Column,
    scored: Column,
    alerts: Column,
    per_category: Column,
) -> Column:
    """One paragraph on how a run went, in the wording of its mode."""
    no_codes = F.array().cast("array<string>")
    targets = F.coalesce(target_categories, no_codes)
    focus = strip(F.coalesce(focus, F.lit("")))
    count = F.coalesce(term_count, F.lit(0))
    target = F.when(F.size(targets) > 0, _fill(fixed.SENTENCE_TARGET, categories=_labels(targets))).otherwise(
        fixed.SENTENCE_NO_TARGET
    )
    search = _fill(fixed.SENTENCE_SEARCH, target=target, terms=count)
    opening = F.when(sites == 1, fixed.SENTENCE_ONE_SITE).otherwise(
        _fill(fixed.SENTENCE_MANY_SITES, sites=F.coalesce(sites, F.lit(0)))
    )
    led = F.when(
        F.size(targets) > 0, _fill(fixed.SENTENCE_FOCUS_CATEGORIES, focus=focus, categories=_labels(targets))
    ).otherwise(_fill(fixed.SENTENCE_FOCUS, focus=focus))
    derived = F.when(count > 0, _fill(fixed.SENTENCE_FOCUS_TERMS, terms=count)).otherwise("")
    explored = F.concat(opening, F.when(focus != "", F.concat(led, derived)).otherwise(""))
    return F.concat_ws(
        " ",
        F.when(exploration, explored).otherwise(search),
        _fill(fixed.SENTENCE_COLLECTED, collected=F.coalesce(collected, F.lit(0))),
        scoring_sentence(scored, alerts, per_category),
    )
