from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from fathom.llm import urls


def judged(spark, rows, **more):
    return {r.page_id: r for r in urls.judge(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string"), **more).collect()}


def test_rules(spark):
    given = {
        1: ("http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("https://example.net/fr/#a", "example.net", "/fr/", "net/", "block"),
        3: ("https://xexample.net/en/", "xexample.net", "/en/", "net/", "block"),
        4: ("http://b.example.com/de/1", "b.example.com", "/de/1", "example.com/de/", "block"),
        5: ("http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
        6: ("http://b.org/fr", "b.org", "/fr", None, "allow"),
        7: ("no scheme", "", "", None, "allow"),
        8: (None, "", "", None, "allow"),
        9: ("http://y.net", "y.net", "", None, "allow"),
        10: ("x://É.NET?a=://b/", "É.net", "", None, "allow"),
        11: ("http://z.net/a://b", "z.net", "/a://b", "net/", "block"),
        12: ("http://z.net?q", "z.net", "", None, "block"),
    }
    found = judged(spark, [(k, v[0], None) for k, v in given.items()])
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in found.items()} == {k: v[1:] for k, v in given.items()}


def brute(links, seeds, rounds):
    out: dict = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    ranks = dict(seeds)
    for _ in range(rounds):
        new = dict(seeds)
        for a, to in out.items():
            for b in to:
                if a in ranks:
                    new[b] = new.get(b, 0) + 0.85 * ranks[a] / len(to)
        ranks = new
    return ranks


def test_ranks_against_a_loop(spark):
    links = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "e"), ("e", "d")]
    seeds = {"a": 1.0, "d": 0.25}
    found = urls.spread(spark.createDataFrame(links, "from string, to string"), spark.createDataFrame([*seeds.items(), ("b", 0.0)], "host string, seed double"))
    expected = brute(links, seeds, urls.ROUNDS)
    assert {r.host: round(r.rank, 9) for r in found.collect()} == {k: round(v, 9) for k, v in expected.items()}


def test_distrust_goes_against_links(spark):
    page = lambda *to: "".join(f'<a HREF="https://{h}/x">x</a>' for h in to)
    rows = [
        (1, "http://bad.net/a", page("friend.test", "own.test")), (2, "http://spam.test/", page("bad.net", "Bad.NET")), (3, "http://spam.test/", page("bad.net")),
        (4, "http://own.test/", page("own.test", "good.org")), (5, "http://good.org/fr/a", None), (6, "http://good.org/x", page("friend.test")), (7, "http://friend.test/", ""),
    ]
    found = judged(spark, rows)
    assert {k: r.verdict for k, r in found.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    assert found[7].trust > 0 and found[4].distrust == 0


def page_to(*hosts):
    return "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)


def test_a_blocked_host_with_many_linkers(spark):
    farm, bad = [f"farm{k}.test" for k in range(8)], ["bad1.net", "bad2.net", "bad3.net"]
    rows = [(k, f"http://{h}/", page_to(*bad)) for k, h in enumerate(farm)] + [(10 + k, f"http://{h}/", None) for k, h in enumerate(bad)]
    rows += [(20, "http://single.test/", page_to("bad1.net")), (21, "http://mixed.test/", page_to("bad1.net", "a.test", "b.test", "c.test"))]
    found = judged(spark, rows)
    assert {k: r.verdict for k, r in found.items() if k < 21} == {r[0]: "block" for r in rows if r[0] < 21}
    assert {round(found[k].distrust, 9) for k in (0, 7, 20)} == {0.85} and round(found[10].distrust, 9) == 1
    assert found[21].verdict == "allow" and round(found[21].distrust, 9) == 0.2125


def test_trust_goes_further_than_ten_links(spark):
    rows = [(k, f"http://h{k}.org/{'fr/' if k == 0 else 'x'}", page_to(f"h{k + 1}.org")) for k in range(13)]
    found = judged(spark, rows)
    assert {k: round(r.trust, 9) for k, r in found.items()} == {k: round(0.85**k, 9) for k in range(13)}


def test_distrust_against_a_loop(spark):
    links = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "e"), ("e", "d"), ("f", "b"), ("b", "f")]
    seeds = {"c": 1.0, "d": 0.25}
    found = urls.spread_back(spark.createDataFrame(links, "from string, to string"), spark.createDataFrame([*seeds.items(), ("b", 0.0)], "host string, seed double"), 0.3)
    ranks = dict.fromkeys("abcdef", 0.0)
    for _ in range(60):
        to = {h: [ranks[b] for a, b in links if a == h] for h in ranks}
        ranks = {h: seeds.get(h, 0.0) + (1 - seeds.get(h, 0.0)) * 0.3 * sum(to[h]) / len(to[h]) for h in ranks}
    assert {r.host: round(r.rank, 8) for r in found.collect()} == {k: round(v, 8) for k, v in ranks.items()}


def test_sql_on_pages_with_links(spark, tmp_path):
    rng = random.Random(4)
    hosts = [f"h{k}.{rng.choice(['test', 'org', 'net', 'com'])}" for k in range(60)]
    rows = [(k, f"http://{rng.choice(hosts)}/{rng.choice(['fr/', 'de/', 'x'])}", page_to(*rng.sample(hosts, rng.randrange(3)))) for k in range(150)]
    rows += [(200 + k, f"http://chain{k}.test/", page_to(f"chain{k + 1}.test" if k < 3 else "bad.net")) for k in range(4)]
    rows += [(300, "http://bad.net/", None), (301, None, page_to("bad.net")), (300, "http://bad.net/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    found = sorted(map(str, (tuple(r) for r in urls.op8_judge_urls(spark, str(tmp_path)).collect())))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert found == sorted(map(str, db.execute(urls.OP8_SQL).fetchall()))
    assert {"None"} < {str(r[3]) for r in db.execute(urls.OP8_SQL).fetchall()}
    ruled = {r[4] for r in db.execute(urls.OP8_SQL).fetchall() if r[3] is None}
    assert ruled == {"allow", "block"}


def test_empty(spark):
    assert judged(spark, []) == {}


def test_links(spark):
    html = "<a href=//x.test/a> <a href='HTTP://Y.test?q'> <a href=\"/rel\"> <a href=\"mailto:a@b\">"
    pages = spark.createDataFrame([("h", html), ("h", html), ("", html), ("x.test", html)], "host string, html string")
    assert {tuple(r) for r in urls.host_links(pages).collect()} == {("h", "x.test"), ("h", "y.test"), ("x.test", "y.test")}
