"""Host reputation against plain Python on planted hosts; rules; odd hosts."""

import math
from collections import defaultdict

import numpy as np

from palimpsest.llm import urls


def levels(host):
    name = host.rsplit(":", 1)[0] if ":" in host and host.rsplit(":", 1)[1].isdigit() else host
    if name.replace(".", "").isdigit():
        return name, name
    part = name.split(".")
    long = len(part) >= 2 and len(part[-1]) == 2 and part[-2] in ("ac", "co", "com", "edu", "gov", "ne", "net", "or", "org")
    return ".".join(part[-3:] if long else part[-2:]), ".".join(part[-2:] if long else part[-1:])


def judged(rows):
    """Verdicts of hosts from (host, bad) rows."""
    counts = [defaultdict(lambda: [0, 0]) for _ in range(3)]
    for host, bad in rows:
        domain, suffix = levels(host)
        for c, key in zip(counts, ((suffix,), (suffix, domain), (suffix, domain, host)), strict=True):
            c[key][0] += 1
            c[key][1] += bad
    total, n = sum(b for _, b in rows), len(rows)
    rate = total / n

    def weight(groups):
        k, spread, nn = len(groups), sum(b * b / m for m, b in groups), sum(m * m for m, _ in groups)
        expected = n - nn / n
        if k < 2 or expected <= 0:
            return 50.0
        rho = ((spread - total * rate) - (k - 1) * rate * (1 - rate)) / (rate * (1 - rate) * expected)
        return max(2.0, min(50.0, 1 / rho - 1)) if rho > 0 else 50.0

    weights = [weight(list(c.values())) for c in counts]
    out = {}
    for host in {h for h, _ in rows}:
        domain, suffix = levels(host)
        p = rate
        for c, w, key in zip(counts, weights, ((suffix,), (suffix, domain), (suffix, domain, host)), strict=True):
            m, b = c[key]
            p, size = (p * w + b) / (w + m), w + m
        out[host] = "block" if p - urls.QUANTILE * math.sqrt(p * (1 - p) / (size + 1)) > min(rate, 0.5) else "allow"
    return out


def test_planted_hosts(spark):
    rng = np.random.default_rng(3)
    hosts = {f"h{k}.site{k % 6}.{s}": 0.1 for k in range(30) for s in ("com", "co.uk")} | {f"s{k}.spam.co.uk": 0.8 for k in range(6)} | {"10.0.0.7": 0.9, "10.0.0.8:8080": 0.05, "deal.shop.com:81": 0.9}
    rows = [(h, int(rng.random() < p)) for h, p in hosts.items() for _ in range(int(rng.integers(3, 40)))]
    pages = spark.createDataFrame([(k, f"http://{h}/x") for k, (h, _) in enumerate(rows)] + [(-1, None), (-2, "no scheme"), (-3, "http://new.spam.co.uk/a")], "page_id long, url string")
    outcomes = spark.createDataFrame([(f"http://{h}/x", b) for h, b in rows], "url string, bad int")
    got = {r.page_id: r for r in urls.judge(pages, outcomes, ()).collect()}
    want = judged(rows)
    assert {got[k].host: got[k].verdict for k in range(len(rows))} == want
    assert all(want[h] == "block" for h, p in hosts.items() if p >= 0.8 and "spam" in h) and want["10.0.0.8:8080"] == "allow"
    assert got[-3].verdict == "block"  # an unseen host of a bad domain
    assert (got[-1].host, got[-1].path, got[-1].verdict) == (got[-2].host, got[-2].path, got[-2].verdict) == ("", "", "allow")


def test_the_first_of_equally_long_rules_wins(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c/d")], "page_id long, url string")
    rules = (urls.UrlRule("allow", "a.b", "/c"), urls.UrlRule("block", "b", "/c/d"), urls.UrlRule("block", "a.b", "/c"))
    assert urls.ruled(pages, rules).first().rule_verdict == "allow"


def test_what_html_shows(spark):
    html = '<!DOCTYPE html><html><head><title>t</title></head><body><!-- a <p> --><script>var x="</p>";</script><P class="a">One &lt;two&gt;</P><p>three <b>four</b>&amp;lt;</p><STYLE>p{}</STYLE>5 < 6</body></html>'
    pages = spark.createDataFrame([(html,)], "html string")
    assert pages.select(urls.shown(pages.html)).first()[0].split() == ["One", "<two>", "three", "four&lt;", "5", "<", "6"]


def test_outcomes_are_the_rules_verdict(spark):
    good = "<p>" + " ".join(f"the {a} of {b} was here" for a, b in zip("abcdefghij", "klmnopqrst", strict=True)) + "</p>"
    rows = [("http://a/", good), ("http://b/", good + "<p>" + "### " * 40 + "</p>"), ("http://c/", ""), ("http://d/", None), (None, good), ("http://a/", good)]
    got = urls.outcomes_of(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("http://a/", 0), ("http://a/", 0), ("http://b/", 1), ("http://c/", 1), (None, 0)], key=str)
