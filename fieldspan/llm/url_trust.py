"""URL filters: rules first, else trust and distrust propagated along host links, thresholded per host."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspan.llm.common import Stages

#: Share of a host's score that goes on to its neighbours in a step.
DAMPING = 0.8
#: Share of the seeds' mass that may be left underway when propagation stops.
REST = 0.02
#: Units of a page's seed. Scores are whole numbers, so sums do not depend on the order. A billion: a hub hands
#: a unit or more to each of 800 million neighbours, and the pages of a host fit in a long up to as many.
UNIT = 1_000_000_000
#: Distrusted less trusted page equivalents, per page of a host, from which the host is blocked.
THRESHOLD = 0.5
#: Steps between written tables.
STEPS_PER_STAGE = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Targets of href and src attributes, quoted or not.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?([^"'>\s]*)"""


class Rule(NamedTuple):
    """``site`` is a host and the beginning of a path; it fits the host, its subdomains and longer paths."""

    verdict: str
    site: str

    @property
    def host(self) -> str:
        return self.site.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.site.split("/", 1)[1]


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))


def host_of(url: str | Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: str, path: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(site, verdict) of the longest rule that fits, the one of the longer host among equals; null if none does."""
    choice = F.lit(None).cast("struct<site:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.site), len(r.host))):
        fits = F.endswith(F.concat(F.lit("."), F.col(host)), F.lit("." + rule.host)) & F.startswith(F.col(path), F.lit(rule.path))
        choice = F.when(fits, F.struct(F.lit(rule.site).alias("site"), F.lit(rule.verdict).alias("verdict"))).otherwise(choice)
    return choice


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n) between different hosts, from pages with a ``host`` column; counted before they move.

    A link is an absolute or protocol-relative target, one for each occurrence, and one of
    each page of a subdomain to the host above it (``a.b.org`` to ``b.org``), since what is
    under a name is vouched for by it; names of fewer than three labels have none above.
    """
    targets = F.regexp_extract_all(html, F.lit(LINK), 1)
    absolute = F.filter(targets, lambda t: t.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]"))
    hosts = F.transform(absolute, lambda t: F.translate(F.regexp_extract(t, r"//([^/?#]*)", 1), _UPPER, _LOWER))
    above = F.when(F.size(F.split("host", r"\.")) >= 3, F.array(F.regexp_extract("host", r"^[^.]*\.(.*)$", 1))).otherwise(F.array().cast("array<string>"))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.concat(F.coalesce(hosts, F.array().cast("array<string>")), above)).alias("dst"))
    return links.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, stages: Stages, *, damping: float = DAMPING, rest: float = REST) -> DataFrame:
    """(kind, host, score): personalised PageRank from the seeds (kind, host, mass), in whole units.

    Mass of kind ``trust`` goes along the links in proportion to their numbers, ``distrust``
    against them, both in the same joins. A host keeps what arrives and hands on ``damping``
    of it; a host without links onwards keeps all of its own, which only scales the
    scores of its seeds, so nothing has to be sent back to them. The steps are as many as it takes
    to leave ``rest`` of the mass underway. A link rounds down, by less than a billionth of a page's seed.
    """
    ways = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    ways = ways.union(links.select(F.lit("distrust"), "dst", "src", "n"))
    out = ways.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    ways = stages.keep(ways.join(out, ["kind", "host"]).select("kind", "host", "to", (damping * F.col("n") / F.col("all")).alias("share")), "ways")

    moving = seeds.select("kind", "host", "mass")
    total, pending = moving, 0
    for step in range(math.ceil(math.log(rest) / math.log(damping))):
        sent = moving.join(ways, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.floor(F.col("mass") * F.col("share")).alias("mass"))
        moving = sent.where("mass > 0").groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if (step + 1) % STEPS_PER_STAGE == 0:
            moving = stages.keep(moving, "moving")
            if moving.isEmpty():
                break
        else:
            moving = stages.keep(moving, f"moving {step % STEPS_PER_STAGE}")
        total = total.union(moving)
        pending += 1
        if pending == STEPS_PER_STAGE:
            total, pending = stages.keep(total.groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "total"), 0
    return total.groupBy("kind", "host").agg(F.sum("mass").alias("score"))


def judge_urls(
    pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rest: float = REST
) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, host_blocked.

    A rule decides where one fits. Elsewhere the host does: pages that rules allow are
    trusted seeds of their hosts, pages that rules block are distrusted ones. Trust is handed on along
    host links, distrust against them. A host is blocked if distrust less trust reaches
    ``threshold`` page equivalents for each of its pages; a host that nothing reaches is allowed.

    Null urls and urls without ``://`` have an empty host and path, no links, and are allowed.
    Null html has no links. Repeated pages count repeatedly and keep a row each. Only hosts
    and links are propagated, each counted before it moves; pages meet their host's verdict in a
    join that is a broadcast only if Spark finds the hosts to be few.
    """
    stages = Stages(pages.sparkSession)
    placed = pages.select(F.col(key).alias("key"), F.col(html).alias("html"), host_of(url).alias("host"), path_of(url).alias("path"))
    placed = placed.withColumn("found", matching_rule("host", "path", rules))
    judged = placed.select("key", "host", "path", F.col("found.site").alias("rule"), F.col("found.verdict").alias("ruled"))

    links = stages.keep(host_links(placed), "links")
    hosts = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("trust"), F.count_if(F.col("ruled") == "block").alias("distrust")
    )
    hosts = stages.keep(hosts, "hosts")
    kinds = F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "mass")
    seeds = stages.keep(hosts.select("host", kinds).where("mass > 0").withColumn("mass", F.col("mass") * UNIT), "seeds")

    scores = propagate(links, seeds, stages, damping=damping, rest=rest).groupBy("host").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0)).alias(f"{k}_score") for k in ("trust", "distrust")]
    )
    over = F.col("distrust_score") - F.col("trust_score") >= threshold * UNIT * F.col("pages")
    verdicts = hosts.join(scores, "host", "left").select("host", F.coalesce(over, F.lit(False)).alias("host_blocked"))
    verdicts = stages.keep(verdicts, "verdicts")
    full = judged.join(verdicts, "host", "left").withColumn("host_blocked", F.coalesce("host_blocked", F.lit(False)))
    verdict = F.coalesce("ruled", F.when(F.col("host_blocked"), "block").otherwise("allow"))
    return full.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "host_blocked")
