"""URL filter by rules and by the empirical-Bayes reputation of hosts.

Labelled page outcomes are summed by host, registered domain and suffix. From
the corpus down to the host, each level's bad share is shrunk towards the one
above it: a beta prior, whose weight is the level's own spread (beta-binomial
moments), meets the level's counts. A host is blocked when the lower bound of
its posterior bad share passes a limit. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logistra.llm.frames import pick
from logistra.storage import stored

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# (host, path, verdict): a rule fits its host, all subdomains and paths that start so.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Suffixes of two labels under which names are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in")
# A host is blocked if its bad share is above LIMIT with a certainty of about
# 95%: posterior mean minus Z standard deviations.
LIMIT = 0.25
Z = 1.645
# Range of a prior's weight, in pages.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0


def with_host(pages: DataFrame) -> DataFrame:
    """``pages`` (with url) with ``host`` and ``path``; both empty for null or no ``://``."""
    rest = "substring(url, instr(url, '://') + 3)"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{_UPPER}', '{_UPPER.lower()}')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return pages.selectExpr(
        "*",
        f"if(instr(url, '://') > 0, {host}, '') AS host",
        f"if(instr(url, '://') > 0, {path}, '') AS path",
    )


def rule_of(rules=RULES) -> tuple[str, str]:
    """SQL of the longest fitting rule, as host and path in one text, and of its verdict."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    name, verdict = "CASE", "CASE"
    for host, path, said in longest:
        # A host that has no name but the rule's, or one in front of it.
        fits = f"(host = '{host}' OR host LIKE '%.{host}') AND startswith(path, '{path}')"
        name += f" WHEN {fits} THEN '{host}{path}'"
        verdict += f" WHEN {fits} THEN '{said}'"
    return f"{name} END", f"{verdict} END"


def _levels() -> tuple[str, str]:
    """SQL of a host's suffix and registered domain."""
    labels = "split(host, '[.]')"
    two = f"array_join(slice({labels}, -2, 2), '.')"
    long_suffixes = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
    width = f"if({two} IN ({long_suffixes}), 2, 1)"
    last = f"if(size({labels}) > {{n}}, array_join(slice({labels}, -({{n}}), {{n}}), '.'), host)"
    return last.format(n=f"({width})"), last.format(n=f"({width} + 1)")


def _posterior(parents: DataFrame, children: DataFrame, parent: str, kept: list[str]) -> DataFrame:
    """Children with the ``weight`` of their parent's prior and their posterior ``mean``.

    The weight follows from how far the bad shares p of the n labelled pages of
    a parent's children scatter around the parent's mean m. With k labelled
    children of N pages, S = sum n (p - m)^2 exceeds k m (1 - m) by the variance
    between children times N - sum n^2 / N, and the beta prior of that variance
    weighs m (1 - m) / variance - 1 pages, within fixed bounds.
    """
    joined = children.join(parents.select(parent, F.col("mean").alias("prior")), parent)
    moments = joined.groupBy(parent).agg(
        F.expr("coalesce(sum(if(n > 0, n * pow(bad / n - prior, 2), 0D)), 0D)").alias("scatter"),
        F.expr("max(prior) * (1 - max(prior))").alias("spread"),
        F.expr("count_if(n > 0)").alias("k"),
        F.expr("CAST(sum(n) AS double)").alias("total"),
        F.expr("sum(CAST(n AS double) * n)").alias("squares"),
    )
    weight = (
        "if(k > 1 AND spread > 0 AND scatter > k * spread AND total * total > squares,"
        f" greatest({LEAST_WEIGHT}D, least({MOST_WEIGHT}D,"
        " spread * (total - squares / total) / (scatter - k * spread) - 1)),"
        f" {MOST_WEIGHT}D) AS weight"
    )
    return joined.join(moments.selectExpr(parent, weight), parent).selectExpr(
        *kept, "n", "bad", "weight", "(bad + weight * prior) / (n + weight) AS mean"
    )


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(host, n, bad, mean, low)`` of every host of ``pages`` (page_id, host).

    ``outcomes`` holds (page_id, bad); ids may repeat and each row counts; rows
    with a null in either column count nowhere. Hosts without a labelled page
    have their domain's share, domains without one their suffix's, and suffixes
    that of all pages; without any outcome the share is 0. Pages are summed by
    host first, so a host with most of the pages is one row afterwards.
    """
    said = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum("bad").alias("bad")
    )
    suffix, domain = _levels()
    hosts, _ = stored(
        pages.join(said, "page_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .selectExpr("*", f"{suffix} AS suffix", f"{domain} AS domain", "0 AS root"),
        "hosts",
    )
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("root", "suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("root", "suffix").agg(*sums)
    root = suffixes.groupBy("root").agg(F.expr("coalesce(sum(bad) / nullif(sum(n), 0), 0D)").alias("mean"))
    by_suffix = _posterior(root, suffixes, "root", ["suffix"])
    by_domain, _ = stored(_posterior(by_suffix, domains, "suffix", ["domain"]), "domains")
    return _posterior(by_domain, hosts, "domain", ["host"]).selectExpr(
        "host", "n", "bad", "mean",
        f"mean - {Z}D * sqrt(mean * (1 - mean) / (n + weight + 1)) AS low",
    )


def verdicts(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_share, low)`` for every row of ``pages``.

    The longest fitting rule decides; without one a page is blocked if its
    host's lower bound is above LIMIT, and allowed if it is exactly LIMIT. Pages without a
    host, null urls among them, have an empty one, which is a host like others. Each row is
    judged for itself, rows of one page_id too; a null page_id has no outcome. Equal
    rows give equal rows; no outcomes leave all to the rules; an empty table gives none.
    """
    parts = with_host(pick(pages, "page_id", "url").selectExpr("page_id", "url"))
    rule, said = rule_of(rules)
    hosts = reputation(parts.select("page_id", "host"), pick(outcomes, "page_id", "bad"))
    judged = hosts.selectExpr("host", "mean AS bad_share", "low")
    return parts.select("page_id", "host", "path").join(judged, "host").selectExpr(
        "page_id", "host", "path", f"{rule} AS rule",
        f"coalesce({said}, if(low > {LIMIT}D, 'block', 'allow')) AS verdict", "bad_share", "low",
    )
