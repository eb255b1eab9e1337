"""URL filters: curated rules first, then empirical-Bayes host reputation.

Labelled outcomes of pages are counted per host, registered domain and suffix. Each level's success rate is a beta
distribution centred on the level above (all pages, suffix, registered domain), whose weight is the beta-binomial
estimate by moments over that level's groups. A host's reputation is its posterior; a page is blocked when the upper
posterior bound of its host is below the wanted rate, so a host without outcomes is judged by its domain, its suffix and
at last by all pages. The bound is the posterior mean plus `z` posterior standard deviations, a normal approximation of
the beta quantile, cut at 1. Built-in functions only.

Nulls: a null url or one without `://` has an empty host and path, fits no rule, and is judged as the host ''. Labels with
a null outcome or page are left out; several labels of a page all count. Repeated pages are judged row by row. With no
labels at all every page without a rule is allowed. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladefreq.operators.joins import hot_key_join

#: Host and path; the host is what stands after the first `://`.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Least and greatest weight of a prior, in outcomes.
WEIGHTS = (1.0, 1000.0)


def url_host(url: str | Column) -> Column:
    """Host with A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, UPPER.lower())


def url_path(url: str | Column) -> Column:
    """Path up to the query or fragment; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fitting_rule(host: str, path: str, rules: Sequence[str]) -> Column:
    """The longest of `rules` ('host/path prefix') that fits, ties by text; null if none does."""

    def fits(rule: str) -> Column:
        name, _, prefix = rule.partition("/")
        own = (F.col(host) == name) | F.endswith(F.col(host), F.lit(f".{name}"))
        return own & F.startswith(F.col(path), F.lit(f"/{prefix}"))

    longest = sorted(rules, key=lambda r: (-len(r), r))
    return F.coalesce(*[F.when(fits(r), F.lit(r)) for r in longest], F.lit(None).cast("string"))


def domain_of(host: str, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """Suffix (the longest of `suffixes` that the host ends with, else its last label) and registered domain (one label
    more, or the host itself)."""
    last = F.substring_index(host, ".", -1)
    known = [F.when(F.endswith(F.col(host), F.lit(f".{s}")), F.lit(s)) for s in sorted(suffixes, key=lambda s: -len(s))]
    suffix = F.coalesce(*known, last)
    labels = F.split(host, r"\.")
    taken = F.least(F.size(labels), F.size(F.split(suffix, r"\.")) + 1)
    return suffix, F.array_join(F.slice(labels, F.size(labels) - taken + 1, taken), ".")


def _weight(groups: DataFrame, level: str, name: str) -> DataFrame:
    """One row: the weight of the beta prior over the groups of a level, by moments of the beta-binomial."""
    g = groups.groupBy(level).agg(F.sum("good").alias("k"), F.sum("n").alias("n"))
    # S = sum n (p - m)^2 = sum k^2 / n - m sum k, with m = sum k / sum n.
    t = g.agg(
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q"),
        F.sum("k").cast("double").alias("k"),
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("n2"),
        F.count("*").alias("groups"),
    )
    m = F.col("k") / F.col("n")
    spread, even = F.col("q") - m * F.col("k"), m * (1 - m)
    top = spread - even * (F.col("groups") - 1)
    bottom = even * (F.col("n") - F.col("n2") / F.col("n") - (F.col("groups") - 1))
    share = F.when(bottom > 0, top / bottom)
    weight = F.when(share > 0, F.least(F.greatest(1 / share - 1, F.lit(WEIGHTS[0])), F.lit(WEIGHTS[1])))
    return t.select(F.coalesce(weight, F.lit(WEIGHTS[1])).alias(name))


def host_reputation(hosts: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = (), z: float = 1.645) -> DataFrame:
    """Posterior mean and upper bound (`z` standard deviations) of every row of `hosts` (host, once each).

    `outcomes`: host, good (successes), n (outcomes), one row per host.
    """
    suffix, domain = domain_of("host", suffixes)
    levels = outcomes.where("n > 0").withColumns({"suffix": suffix, "domain": domain})
    whole = levels.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).select(
        F.coalesce(F.col("good") / F.col("n"), F.lit(1.0)).alias("m0")
    )
    out = hosts.withColumns({"suffix": suffix, "domain": domain})
    for name in ("suffix", "domain", "host"):
        sums = levels.groupBy(name).agg(F.sum("good").alias(f"good_{name}"), F.sum("n").alias(f"n_{name}"))
        out = out.join(sums, name, "left").fillna(0, [f"good_{name}", f"n_{name}"])
    # Four numbers, each the only cell of its table.
    centre, prior = whole.scalar(), {}
    for name in ("suffix", "domain", "host"):
        prior[name] = _weight(levels, name, f"w_{name}").scalar()
        centre = (F.col(f"good_{name}") + prior[name] * centre) / (F.col(f"n_{name}") + prior[name])
    weight = F.col("n_host") + prior["host"]
    return out.select("host", centre.alias("posterior"), weight.alias("weight")).select(
        "host",
        "posterior",
        F.least(
            F.lit(1.0),
            F.col("posterior") + z * F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (F.col("weight") + 1)),
        ).alias("upper"),
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    allow: Sequence[str],
    block: Sequence[str],
    least_rate: float = 0.5,
    suffixes: Sequence[str] = (),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Every page with host, path, rule, verdict, posterior and upper bound. `labels`: page_id, good (0 or 1)."""
    parts = pages.select(
        F.col(id_col).alias("page_id"), url_host(url_col).alias("host"), url_path(url_col).alias("path")
    )
    judged = parts.withColumn("rule", fitting_rule("host", "path", [*allow, *block]))
    counted = labels.where(F.col("good").isNotNull()).groupBy("page_id").agg(
        F.sum("good").alias("good"), F.count("*").alias("n")
    )
    seen = parts.select("page_id", "host").join(counted, "page_id", "left").fillna(0, ["good", "n"])
    outcomes = seen.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    reputation = host_reputation(outcomes.select("host"), outcomes, suffixes)
    joined = hot_key_join(judged, reputation, "host", how="left", spread=["page_id", "path"])
    by_rule = F.when(F.col("rule").isin(*allow), F.lit("allow")).when(F.col("rule").isNotNull(), F.lit("block"))
    by_host = F.when(F.col("upper") < least_rate, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_host).alias("verdict"), "posterior", "upper")
