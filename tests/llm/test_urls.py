"""URL rules and host PageRank against plain Python."""

import random
import re
from urllib.parse import urlsplit

import numpy as np
import pytest

from siltstone.llm import urls

SCHEMA = "page_id long, url string, html string, host string, verdict string, rank double"


def a(*hrefs):
    return "".join(f'<p><A class="x" href="{h}">t</a></p>' for h in hrefs)


PAGES = [
    (1, "https://Example.COM/en/7", a("http://friend.org/x", "/own", "//cdn.net/y")),
    (2, "http://example.com/en/8", a("http://spam.biz/")),
    (3, "http://spam.biz/q?x#y", a("http://bad.com/en/1", "http://bad.com/en/2")),
    (4, "http://bad.com/en/1", None),
    (5, "http://friend.org/es/1", a("http://third.info/")),
    (6, "http://third.info", a("http://friend.org/")),
    (7, "http://links-to-spam.biz/p", a("http://spam.biz/1", "mailto:x@bad.com")),
    (8, None, a("http://bad.com/")),
    (9, "no scheme", ""),
    (10, "x://a.example.net/de/81?q", ""),
    (11, "x://a.example.net/de/9", ""),
    (11, "x://a.example.net/de/9", ""),
    (12, "https://notexample.com/en/7", ""),
    (13, "http://host.only?x/en/", ""),
]


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 0.5) for r in rows], SCHEMA)


def brute():
    import re

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0]

    def ruled(host, path):
        fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    links, seed = {}, {"trust": {}, "distrust": {}}
    hosts = set()
    for _, url, html in PAGES:
        host, path = parts(url)
        hosts.add(host)
        v = ruled(host, path)[1]
        if v:
            kind = "trust" if v == "allow" else "distrust"
            seed[kind][host] = seed[kind].get(host, 0) + 1
        for href in re.findall(r'href="((?:https?:)?//[^"]*)"', html or ""):
            to = urlsplit(href).netloc.lower()
            if host and to and to != host:
                hosts.add(to)
                links[host, to] = links.get((host, to), 0) + 1
    ranks = {}
    for kind in seed:
        total = sum(seed[kind].values()) or 1
        start = {h: seed[kind].get(h, 0) / total for h in hosts}
        edges = {k: n for k, n in links.items()} if kind == "trust" else {(b, a): n for (a, b), n in links.items()}
        out = {}
        for (x, _), n in edges.items():
            out[x] = out.get(x, 0) + n
        r = dict(start)
        for _ in range(urls.ROUNDS):
            r = {h: start[h] + 0.85 * sum(r[x] * n / out[x] for (x, y), n in edges.items() if y == h) for h in hosts}
        ranks[kind] = r
    want = []
    for i, url, _ in PAGES:
        host, path = parts(url)
        rule, verdict = ruled(host, path)
        want.append((i, host, path, rule, verdict or ("block" if ranks["distrust"][host] > ranks["trust"][host] else "allow"), ranks["trust"][host], ranks["distrust"][host]))
    return want


def test_against_brute_force(spark):
    key = lambda r: (r[0], r[1], r[2])
    got = sorted(map(tuple, urls.judge(make(spark, PAGES)).collect()), key=key)
    want = sorted(brute(), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:])
    verdicts = {g[0]: g[4] for g in got}
    assert verdicts[7] == "block" and verdicts[3] == "block"  # who links to the blocked
    assert verdicts[6] == "allow"


def linked_pages(hosts=2_000, pages=5_000, links=20, seed=3):
    """Pages of many hosts: a tenth of all links lead to one host, a third of the hosts have no pages."""
    rng = random.Random(seed)
    name = lambda k: f"h{k}.{rng_tld(k)}"
    rows = []
    for i in range(pages):
        k = int(rng.random() ** 3 * hosts * 2 / 3)  # a few hosts have most pages
        to = [0 if rng.random() < 0.1 else rng.randrange(hosts) for _ in range(links)]
        rows.append((i, f"http://{name(k)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{i}", a(*(f"https://{name(t)}/x" for t in to))))
    return rows


def rng_tld(k):
    return ("com", "net", "org", "info")[k % 4]


def test_a_linked_graph_against_power_iteration(spark):
    rows = linked_pages()
    host = lambda u: u.split("//")[1].split("/")[0]
    names = sorted({host(u) for _, u, _ in rows} | {host(x) for _, _, h in rows for x in re.findall('href="([^"]*)"', h)})
    at = {h: i for i, h in enumerate(names)}
    flow = np.zeros((len(names), len(names)))
    seed = {"trust": np.zeros(len(names)), "distrust": np.zeros(len(names))}
    for _, u, h in rows:
        path = "/" + u.split("/", 3)[3]
        ending = host(u).rsplit(".", 1)[1]
        if (ending, path[:4]) in {("com", "/en/"), ("org", "/es/")}:
            seed["distrust"][at[host(u)]] += 1
        if (ending, path[:4]) == ("net", "/de/"):
            seed["trust"][at[host(u)]] += 1
        for x in re.findall('href="([^"]*)"', h):
            if host(x) != host(u):
                flow[at[host(u)], at[host(x)]] += 1
    assert (flow > 0).sum() > 50_000
    want = {}
    for kind, m in (("trust", flow), ("distrust", flow.T)):
        out = m.sum(axis=1, keepdims=True)
        step = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
        rank = v = seed[kind] / seed[kind].sum()
        for _ in range(urls.ROUNDS):
            rank = v + urls.DAMPING * rank @ step
        want[kind] = rank
    got = urls.host_scores(make(spark, rows)).collect()
    assert len(got) == len(names)
    for r in got:
        assert (r["trust"], r["distrust"]) == pytest.approx((want["trust"][at[r["host"]]], want["distrust"][at[r["host"]]]), rel=1e-9)


def test_ranks_of_unlinked_hosts_do_not_depend_on_links(spark):
    alone = [(1, "http://a.net/de/1", ""), (2, "http://b.com/en/1", None), (3, "http://b.com/fr/1", "")]
    more = [*alone, (4, "http://c.info/", a("http://d.info/"))]
    of = lambda rows: {r["host"]: (r["trust"], r["distrust"]) for r in urls.host_scores(make(spark, rows)).collect()}
    assert of(alone).items() <= of(more).items()


def test_equal_rules_and_long_pages(spark):
    rules = (("block", "x.com", "/ab"), ("allow", "x.com", "/a"), ("allow", "com", "/abc.."))
    rows = [(1, "http://x.com/abc..", "<a " * 200_000 + a("http://y.com/") + "z" * 1_000_000), (2, "http://x.com/ab", "<a href=" * 100_000)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(make(spark, rows), rules=rules).collect()}
    assert got == {1: ("com/abc..", "allow"), 2: ("x.com/ab", "block")}
    tied = (("block", "x.com", "/b"), ("allow", "x.com", "/a"), ("allow", "m.x.com", ""))
    rows = [(1, "http://m.x.com/b", ""), (2, "http://m.x.com/a", "")]
    assert {r["page_id"]: r["rule"] for r in urls.judge(make(spark, rows), rules=tied).collect()} == {1: "x.com/b", 2: "x.com/a"}


def test_empty_table(spark):
    assert urls.judge(make(spark, [])).count() == 0
