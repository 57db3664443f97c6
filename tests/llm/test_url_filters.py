from __future__ import annotations

import re
from collections import defaultdict

import awardtrace.llm.url_filters as url_filters
from awardtrace.llm.url_filters import DAMPING, MARGIN, RULES, judge

URLS = [None, "", "no scheme", "http://", "HTTP://Sub.EXAMPLE.org/en/1x?q#f", "http://example.org/es/a", "http://example.org/es",
        "http://notexample.org/es/", "http://org/x", "http://example.org", "http://a.com/fr/x#y", "http://b.com/de/", "ftp://b.com?x=/de/",
        "x://c.com/y://z", "http://bad.com/de/1", "http://bad.com/en/1", "http://friend.net/a", "http://lone.net/", "http://good.com/fr/2",
        "http://good.com/other", "http://linked.net/q"]
HTML = {14: '<a href="http://linked.net/x">', 16: "<a href='//bad.com/1'> <a href=http://bad.com/2>", 18: '<img src="https://Linked.NET/y">',
        17: '<a href="/only/here">', 20: None}


def _parse(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def _brute(rows):
    pages = []
    for k, url, html in rows:
        host, path = _parse(url)
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        pages.append((k, host, path, html or "", max(fit)[1:] if fit else None))
    links = defaultdict(float)
    hosts = {p[1] for p in pages if p[1]}
    for _, host, _, html, _ in pages:
        for target in re.findall(r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html):
            if host and target.lower() != host:
                links[host, target.lower()] += 1
    for h in hosts:
        up = re.match(r"^[^.]+\.(.+\..+)$", h)
        if up:
            links[h, up[1]] += 1
            links[up[1], h] += 1
    score = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        ways = {(a, b) if kind == "trust" else (b, a): n for (a, b), n in links.items()}
        out, seeds = defaultdict(float), defaultdict(float)
        for (a, _), n in ways.items():
            out[a] += n
        for _, host, _, _, rule in pages:
            if rule and host and rule[1] == verdict:
                seeds[host] += 1
        total = sum(seeds.values())
        rank = {h: n / total for h, n in seeds.items()}
        for _ in range(200):  # far beyond the tolerance
            new = defaultdict(float, {h: n / total * (1 - DAMPING) for h, n in seeds.items()})
            for (a, b), n in ways.items():
                new[b] += DAMPING * rank.get(a, 0) * n / out[a]
            rank = new
        score[kind] = rank
    own = lambda h: "block" if score["distrust"].get(h, 0) > MARGIN * score["trust"].get(h, 0) else "allow"
    return {k: (h, p, r and r[0], r[1] if r else own(h)) for k, h, p, _, r in pages}


def test_against_brute_force(spark):
    rows = [(i, u, HTML.get(i, "")) for i, u in enumerate(URLS)]
    docs = spark.createDataFrame([(*r, "h", 1.0) for r in rows], "page_id long, url string, html string, host string, trust double")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(docs).collect()}
    assert got == _brute(rows)
    assert got[4][2:] == ("example.org/en/1", "block") and got[16][3] == "block" and got[17][3] == "allow"


def test_without_rows_or_seeds(spark):
    schema = "page_id long, url string, html string"
    assert judge(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, "http://lone.net/", None), (1, "http://lone.net/", None)], schema)
    assert [r.verdict for r in judge(one).collect()] == ["allow", "allow"]


def test_chain_longer_than_the_rounds_between_two_tables(spark):
    """Distrust reaches the start of a chain of links to a blocked host, as in converged ranks."""
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(20)]
    rows[-1] = (19, "http://h19.net/", '<a href="http://bad.com/x">')
    rows.append((20, "http://bad.com/de/1", ""))
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(r.verdict == "block" for r in got.values())
    for i in range(20):  # 20 - i links from the seed, which no link leads back to
        assert abs(got[i].distrust - (1 - DAMPING) * DAMPING ** (20 - i)) < 1e-5 and got[i].trust == 0


def test_few_staged_folders_and_both_joins(spark, monkeypatch, tmp_path):
    """At most three tables are alive at any time and one is left; a join without broadcast gives the same ranks."""
    from awardtrace.sources import tables

    monkeypatch.setattr(tables, "staging_root", lambda _: str(tmp_path))
    alive = []
    write = tables.stage
    monkeypatch.setattr(url_filters, "stage", lambda df, name: (write(df, name), alive.append(len(list(tmp_path.iterdir()))))[0])
    rows = [(i, f"http://h{i % 7}.net/{i}", f'<a href="http://h{i * 3 % 11}.net/"><a href="http://bad.com/">') for i in range(40)]
    rows += [(99, "http://bad.com/de/1", "x" * 200_000 + "<a href=//h3.net>"), (98, "http://org/", '<a href="http://h1.net">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, round(r.trust, 5), round(r.distrust, 5)) for r in judge(pages).collect()}
    assert max(alive) <= 4 and len(list(tmp_path.iterdir())) == 1  # links, seeds, old and new ranks
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(url_filters, "LINKS_A_TASK", 5)
    assert got == {r.page_id: (r.verdict, round(r.trust, 5), round(r.distrust, 5)) for r in judge(pages).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[3] for k, v in _brute(rows).items()}
