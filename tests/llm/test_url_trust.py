"""Rules and propagation against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldspan.llm import url_trust
from fieldspan.llm.url_trust import DAMPING, REST, RULES, THRESHOLD, UNIT, judge_urls

PAGES = "page_id long, url string, html string, host string, path int, rule string, mass int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (lowered(m[1]), m[2]) if m else ("", "")


def ruled(host, path):
    fits = [r for r in RULES if ("." + host).endswith("." + r.site.split("/")[0]) and path.startswith("/" + r.site.split("/", 1)[1])]
    return max(fits, key=lambda r: len(r.site), default=None)


def brute_force(pages):
    links, hosts = {}, {}
    for _, url, html in pages:
        host, path = split(url)
        if not host:
            continue
        rule = ruled(host, path)
        hosts.setdefault(host, [0, 0, 0])[0] += 1
        if rule:
            hosts[host][1 if rule.verdict == "allow" else 2] += 1
        targets = [lowered(m[1]) for t in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?([^"'>\s]*)""", html or "") if (m := re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", t))]
        targets += [host.split(".", 1)[1]] if host.count(".") >= 2 else []
        for t in targets:
            if t != host and t:
                links[host, t] = links.get((host, t), 0) + 1
    score = {}
    for kind, sign in (("trust", -1), ("distrust", 1)):
        ways = {(a, b) if kind == "trust" else (b, a): n for (a, b), n in links.items()}
        out = {}
        for (a, _), n in ways.items():
            out[a] = out.get(a, 0) + n
        mass = {h: x[1 if kind == "trust" else 2] * UNIT for h, x in hosts.items() if x[1 if kind == "trust" else 2]}
        for h, m in mass.items():
            score[h] = score.get(h, 0) + sign * m
        for _ in range(math.ceil(math.log(REST) / math.log(DAMPING))):
            arrived = {}
            for (a, b), n in ways.items():
                m = math.floor(mass.get(a, 0) * (DAMPING * n / out[a]))
                if m:
                    arrived[b] = arrived.get(b, 0) + m
            mass = arrived
            for h, m in mass.items():
                score[h] = score.get(h, 0) + sign * m
    result = []
    for page, url, _ in pages:
        host, path = split(url)
        rule = ruled(host, path)
        blocked = bool(host) and score.get(host, 0) >= THRESHOLD * UNIT * hosts[host][0]
        result.append((page, host, path, rule and rule.site, rule.verdict if rule else "block" if blocked else "allow"))
    return sorted(result, key=repr)


def judged(spark, pages):
    rows = judge_urls(spark.createDataFrame([(*p, "h", 1, "r", 1) for p in pages], PAGES)).select("page_id", "host", "path", "rule", "verdict").collect()
    return sorted(map(tuple, rows), key=repr)


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    hosts = [f"{s}{n}.{t}" for s in ("", "www.", "blog.") for n in ("a", "b", "example", "d") for t in ("com", "net", "org")]
    others = [h for h in hosts if not h.endswith(".com")]
    pages = []
    for i in range(400):
        to = "".join(f'<a href="https://{rnd.choice(hosts)}/x">x</a> <img SRC=//{rnd.choice(hosts).upper()}?y> <a href="/own">' for _ in range(rnd.randrange(3)))
        pages.append((i, f"http://{rnd.choice(hosts if i % 10 == 0 else others)}{rnd.choice(('', '/', '/en/1', '/es/2', '/fr/', '/de?q=/es/', '#x', '/es/4'))}", to))
    pages += [(500, None, "x"), (501, "no scheme", "<a href='http://a.com'>"), (502, "http://", ""), (503, "HTTP://WWW.Example.COM/en/?a#b", None), (504, "http://É.org/é://x", "")]
    pages += [(505, "http://www.example.com/en/x", ""), (506, "http://example.com/en/x", ""), (507, "http://notexample.com/en/x", ""), (505, "http://www.example.com/en/x", ""), (None, "x://b.net/fr/", "")]
    assert judged(spark, pages) == brute_force(pages)
    assert {r[4] for r in judged(spark, pages) if r[3] is None} == {"allow", "block"}


def test_trust_outweighs_distrust(spark):
    bad = [(i, f"http://bad.net/es/{i}", "") for i in range(4)]
    links = [(10, "http://fan.org/", '<a href="http://bad.net/">'), (11, "http://known.org/", "")]
    trusted = [(20 + i, "http://good.com/", '<a href="http://known.org/">') for i in range(3)]
    verdicts = {p[0]: p[4] for p in judged(spark, bad + links + trusted)}
    assert (verdicts[10], verdicts[11]) == ("block", "allow")


def test_no_pages_and_no_links(spark):
    assert judged(spark, []) == []
    assert judged(spark, [(1, "http://x.org/a", "")]) == [(1, "x.org", "/a", None, "allow")]


def test_a_hub_hands_its_trust_on(spark):
    """A hub of 200,000 links: what each neighbour gets is little, but they pass it on."""
    from fieldspan.llm.common import Stages

    links = spark.range(200_000).select(F.lit("hub").alias("src"), F.concat(F.lit("h"), "id").alias("dst"), F.lit(1).cast("long").alias("n"))
    onward = spark.range(20_000).select(F.concat(F.lit("h"), (F.col("id") % 4).cast("string")).alias("src"), F.concat(F.lit("t"), F.col("id") % 20).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    seeds = spark.createDataFrame([("trust", "hub", url_trust.UNIT)], "kind string, host string, mass long")
    scores = {r.host: r.score for r in url_trust.propagate(links.union(onward), seeds, Stages(spark)).where("host in ('h5', 't0', 't19')").collect()}
    assert scores["h5"] == int(0.8 * url_trust.UNIT / 200_000)
    assert scores["t0"] == pytest.approx(0.8 * 0.8 * url_trust.UNIT / 200_000 / 5, rel=0.01) and scores["t19"] > 0
