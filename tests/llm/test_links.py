"""URL rules by hand, propagation against plain iteration over a small host graph."""

import random

import duckdb
import pytest

from scoreweave.llm import links, oracle, queries

URLS = {
    None: ("", "", None), "": ("", "", None), "no scheme/x": ("", "", None), "http://A.Example.COM/en/x?y": ("a.example.com", "/en/x", "example.com/en/"),
    "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"), "x://www.example.com/en": ("www.example.com", "/en", "com/"),
    "http://m.www.example.com/en/q": ("m.www.example.com", "/en/q", "www.example.com/en/"), "http://example.net/es/1": ("example.net", "/es/1", "net/es/"),
    "http://example.net/de/1": ("example.net", "/de/1", None), "http://notcom/a": ("notcom", "/a", None), "http://com": ("com", "", None),
    "http://com/": ("com", "/", "com/"), "http://a.com?x://b.net/es/": ("a.com", "", None), "://net/fr/#": ("net", "/fr/", "net/fr/"),
    "http://ÄB.com/": ("Äb.com", "/", "com/"), "http://a.com:80/": ("a.com:80", "/", None), "http://a\nb.com/x\ny": ("a\nb.com", "/x\ny", "com/"),
}


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "old") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    out = links.judge(pages).collect()
    assert len(out) == len(URLS)
    for r in out:
        assert (r.host, r.path, r.rule) == URLS[r.url], r.url
        if r.rule:
            assert r.verdict == ("block" if r.rule in ("example.com/en/", "net/es/", "net/fr/") else "allow")
        else:
            assert r.verdict == ("block" if r.host == "example.net" else "allow")


def test_empty_table(spark):
    assert links.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute(seeds, edges):
    hosts = {h for h, *_ in seeds} | {h for e in edges for h in e[:2]}
    out = {}
    for k, way in ((1, 1), (2, -1)):
        total = sum(s[k] for s in seeds)
        seed = {s[0]: s[k] / total for s in seeds if s[k]} if total else {}
        moves = [(a, b, n) if way == 1 else (b, a, n) for a, b, n in edges]
        weight = {h: sum(n for a, _, n in moves if a == h) for h in hosts}
        score = dict(seed)
        for _ in range(200):
            score = {h: 0.15 * seed.get(h, 0) + 0.85 * sum(score.get(a, 0) * n / weight[a] for a, b, n in moves if b == h) for h in hosts}
        out[k] = score
    return {h: (out[1][h], out[2][h]) for h in hosts}


def test_propagation_equals_iteration(spark):
    rng = random.Random(5)
    hosts = [f"h{i}.org" for i in range(25)]
    edges = {(rng.choice(hosts), rng.choice(hosts)): rng.randrange(1, 5) for _ in range(70)}
    edges = [(a, b, n) for (a, b), n in edges.items() if a != b]
    seeds = [(h, rng.randrange(3), rng.randrange(2)) for h in hosts[:10]]
    got = links.propagated(spark.createDataFrame(seeds, "host string, trust long, distrust long"), spark.createDataFrame(edges, "src string, dst string, n long"))
    want = brute(seeds, edges)
    for r in got.collect():
        assert (r.trust, r.distrust) == pytest.approx(want[r.host], abs=2e-5)


def test_links_carry_distrust_back(spark):
    page = lambda i, url, *to: (i, url, "".join(f"<a class=x HREF = '{t}'>t</a>" for t in to))
    rows = [
        page(1, "http://bad.net/es/1"), page(2, "http://friend.org/1", "https://bad.net/x", "/local"), page(3, "http://good.com/1", "http://liked.org/a"),
        page(4, "http://liked.org/1"), page(5, "http://alone.org/1"), page(6, "http://liked.org/2", "http://bad.net/"),
    ]
    out = {r.page_id: r for r in links.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i].verdict for i in range(1, 7)] == ["block", "block", "allow", "allow", "allow", "allow"]
    assert "html" not in out[1].asDict() and out[2].distrust > out[2].trust == 0


def test_light_seeds_reach_hosts_three_links_away(spark):
    """One of three million blocked pages carries the distrust of a thousand chains of three links."""
    chains = [(f"http://{a}{i}.org/", f"<a href='http://{b}/'>t</a>") for i in range(1000) for a, b in (("r", "light.net"), ("s", f"r{i}.org"), ("t", f"s{i}.org"))]
    rows = [("http://light.net/es/1", None), *chains, ("http://alone.org/", None), ("http://com/", None)]
    heavy = spark.range(3_000_000).selectExpr("-1L AS page_id", "'http://heavy.net/es/1' AS url", "CAST(NULL AS string) AS html")
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    out = {r.host: r for r in links.judge(pages.unionByName(heavy)).filter("page_id >= 0").collect()}
    for way, name in enumerate("rst", 1):
        for i in range(1000):
            r = out[f"{name}{i}.org"]
            assert r.verdict == "block"
            assert r.distrust == pytest.approx(0.15 * 0.85**way / 1000 / 3_000_001, rel=1e-5)
    assert out["alone.org"].verdict == out["com"].verdict == "allow"


def test_addresses_without_scheme_and_base(spark):
    rows = [
        ("a.org", "<a href='//B.org/x'>b</a><a href=/here>a</a><a href='/go?to=http://no.org/'>a</a><a href='mailto:x@no.org'>m</a>"),
        ("c.org", "<BASE target=_top><base target=_top HREF = '//d.org/e/'><base href='http://no.org/'><a href=f>d</a><a href='/g'>d</a><a href='HTTPS://b.org'>b</a>"),
        ("e.org", "<base href='/sub/'><a href=f>e</a>"), ("f.org", "<base href='http://d.org/'>"), ("", "<a href='//b.org'>b</a>"), ("g.org", None),
    ]
    edges = links.host_edges(spark.createDataFrame(rows, "host string, html string"), "host", "html").collect()
    assert sorted(map(tuple, edges)) == [("a.org", "b.org", 1), ("c.org", "b.org", 1), ("c.org", "d.org", 2)]


def test_sql_agrees_on_linked_pages(spark, tmp_path):
    """The expected SQL over pages that link: absolute, ``//host`` and relative addresses, with and without a base."""
    rng = random.Random(11)
    hosts = [f"h{i}.org" for i in range(30)] + ["a.net", "b.net", "good.com"]
    ways = ["http://{}/x", "HTTPS://{}/y?z", "//{}/w", "/local/{}", "mailto:me@{}", "{}/page", "#top"]
    rows = []
    for i in range(300):
        links_ = "".join(f"<a HREF={q}{rng.choice(ways).format(rng.choice(hosts))}{q}>t</a>" for q in (rng.choice("'\"") for _ in range(rng.randrange(4))))
        base = f"<base target=x href='//{rng.choice(hosts)}/b/'>" if i % 9 == 0 else ""
        rows.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['es', 'fr', 'de', 'en'])}/{i}", base + links_ if i % 20 else None))
    rows += [(1000, None, "<a href='http://a.net/'>"), (1001, "nowhere", ""), (1002, "http://H1.org", "<a href=//A.net>")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.execute(oracle.STATEMENTS["op6_url_filters"]).fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op6_url_filters(spark, folder).collect()}
    assert got == want
    unruled = [v[3] for v in got.values() if v[2] is None and v[0].endswith(".org")]
    assert {"allow", "block"} == set(unruled)
