"""Which addresses may be collected, and how many per session."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions import url as U
from adwatch.operators.ordering import first_n
from adwatch.operators.skew import lookup_join


def _domains(allowlist: Iterable[str]) -> list[str]:
    return [d.lower().lstrip(".") for d in allowlist if d]


def domain_allowed(url: Column, allowlist: Iterable[str]) -> Column:
    """Host is an allowed domain or lies below one. One pattern reads the host once, whatever the length of the list."""
    domains = "|".join(re.escape(d) for d in _domains(allowlist))
    return F.coalesce(U.host_text(url).rlike(rf"(^|\.)({domains})$"), F.lit(False)) if domains else F.lit(False)


def path_blocked(url: Column, blocklist: Iterable[str]) -> Column:
    """A blocked word stands anywhere in the address."""
    low, hit = F.lower(url), F.lit(False)
    for word in blocklist:
        hit = hit | low.contains(word.lower())
    return hit


def is_download(url: Column, allow_downloads: bool = False) -> Column:
    if allow_downloads:
        return F.lit(False)
    endings = "|".join(re.escape(e) for e in fixed.DOWNLOAD_EXTENSIONS)
    return F.lower(U.path(url)).rlike(f"({endings})$")


def scope_verdict(
    url: Column, allowlist: Iterable[str], blocklist: Iterable[str] = (), allow_downloads: bool = False
) -> Column:
    """``struct(allowed, reason)``; the first failing test names the reason."""
    outside = F.concat(F.lit(fixed.REASON_DOMAIN), F.coalesce(U.host(url), F.lit("None")))
    reason = (
        F.when(~domain_allowed(url, allowlist), outside)
        .when(path_blocked(url, blocklist), fixed.REASON_BLOCKLIST)
        .when(is_download(url, allow_downloads), fixed.REASON_DOWNLOAD)
        .otherwise(fixed.REASON_OK)
    )
    return F.struct((reason == fixed.REASON_OK).alias("allowed"), reason.alias("reason"))


def in_domain_table(pages: DataFrame, allowlist: DataFrame, url: str = "url", domain: str = "domain") -> DataFrame:
    """Pages whose host is in a domain table of any size.

    Hosts are made distinct first, then every parent domain of a host is an equality key.
    """
    named = pages.withColumn("_host", U.host(F.col(url)))
    labels = F.split("_host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    domains = allowlist.select(F.ltrim(F.lower(domain), F.lit(".")).alias("_domain")).distinct()
    hosts = (
        named.where(F.col("_host").isNotNull()).select("_host").distinct()
        .select("_host", F.explode(parents).alias("_domain"))
        .join(domains, "_domain", "left_semi")
        .select("_host").distinct()
    )
    return lookup_join(named, hosts, ["_host"]).drop("_host")


def within_budget(requests: DataFrame, session: Sequence[str], order: Sequence[str], budget: int) -> DataFrame:
    """The requests of each session that fit its action budget."""
    return first_n(requests, session, order, budget)


def budget_use(requests: DataFrame, session: Sequence[str], budget: int) -> DataFrame:
    """Per session: requests made, used, cut and budget left."""
    made = F.col("requested")
    return requests.groupBy(*session).agg(F.count(F.lit(1)).alias("requested")).select(
        *session,
        "requested",
        F.least(made, F.lit(budget)).cast("long").alias("used"),
        F.greatest(made - budget, F.lit(0)).cast("long").alias("cut"),
        F.greatest(F.lit(budget) - made, F.lit(0)).cast("long").alias("remaining"),
    )


def split_by_allowlist(requested: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected site labels. Entries without label or address do not count; platform defaults to label."""
    usable = sites.where((F.col("label") != "") & (F.col("base_url") != "")).select(
        "label", "base_url", F.coalesce(F.nullif(F.col("platform"), F.lit("")), "label").alias("platform")
    )
    accepted = usable.join(requested.select("label").distinct(), "label", "left_semi")
    rejected = requested.join(usable, "label", "left_anti")
    return accepted, rejected


def canonical_check(requests: DataFrame, platforms: DataFrame) -> DataFrame:
    """Compare a requested address with its platform's own; adds ``verdict`` and the ``effective_url``."""
    own = platforms.select(F.col("name").alias("platform"), F.rtrim("base_url", F.lit("/")).alias("_own"), F.lit(True).alias("_known"))
    asked = F.nullif(F.col("base_url"), F.lit(""))
    own_url = F.nullif(F.col("_own"), F.lit(""))
    verdict = (
        F.when(F.col("_known").isNull(), "unknown_platform")
        .when(own_url.isNotNull() & asked.isNotNull() & (F.rtrim(asked, F.lit("/")) != own_url), "refused")
        .when(own_url.isNull() & asked.isNull(), "no_url")
        .otherwise("ok")
    )
    return (
        requests.join(own, "platform", "left")
        .withColumn("verdict", verdict)
        .withColumn("effective_url", F.when(F.col("verdict") == "ok", F.coalesce(own_url, asked)))
        .drop("_own", "_known")
    )
