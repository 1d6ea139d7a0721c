import random

from llm import brute
from tidemark.llm import url_filter

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark, rules):
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = brute.lower(rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [
        (len(h + p), h.count(".") + 1, v == "block", h + p, v)
        for v, h, p in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, table(spark, rules)).collect()}


def test_equals_brute_force(spark):
    rng = random.Random(1)
    hosts = ["example.net", "EXAMPLE.net", "a.b.example.com", "org", "x.org", "notexample.net", "net", "a..net", ".net", "net.", "É.org", "u@x.net:80", "a.com"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/", "/FR/", "//en/", "/é/ 1", "/en/de/"]
    ends = ["", "?a=/en/", "#x://y", "?", "/?q"]
    urls = [f"{rng.choice(['http', '', 'a:b'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(ends)}" for _ in range(600)]
    urls += [None, "", "://", "http:/example.net/", "no scheme", "a://b://example.net/en/", "x://?y", "http://net" + ".net" * 500 + "/" + "p" * 5000]
    more = [*RULES, ("allow", "b.example.com", "/d"), ("block", "x.org", "/"), ("block", "org", "/fr/"), ("allow", "com", "/é/ 1")]
    for rules in (RULES, more):
        assert judged(spark, urls, rules) == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_equally_long_rules(spark):
    rules = [("allow", "b.net", "/x"), ("block", "net", "/xyz"), ("allow", "net", "/xyz")]
    assert judged(spark, ["h://a.b.net/xyz"], rules) == {0: ("a.b.net", "/xyz", "b.net/x", "allow")}
    assert judged(spark, ["h://c.net/xyz"], rules) == {0: ("c.net", "/xyz", "net/xyz", "block")}


def test_odd_rows(spark):
    pages = spark.createDataFrame(
        [(None, None, "x", 1), (None, None, "x", 1), (2, "http://a.net/", "y", 2), (2, "http://a.net/", "y", 2)],
        "page_id long, url string, verdict string, digest int",
    )
    got = url_filter.judge(pages, table(spark, RULES))
    assert sorted(got.columns) == sorted(["page_id", "url", "digest", "host", "path", "rule", "verdict"])
    rows = got.collect()
    assert sorted(str(r.verdict) for r in rows) == ["allow", "allow", "block", "block"]
    assert {r.rule for r in rows} == {None, "net/"}
    assert url_filter.judge(pages.limit(0), table(spark, RULES)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, table(spark, [])).collect()} == {"allow"}
