"""URL filters against a rule-by-rule search."""

import random
from collections import Counter

from lodestone.llm import urls

HOSTS = ["com", "example.com", "www.example.com", "EXAMPLE.com", "a.www.example.com", "badexample.com", "net", "x.net", "org", "", "é.net", ".com", "user@example.com:80"]
PATHS = ["", "/", "/en", "/en/", "/en/1", "/english", "/es/", "/es/a/b", "//", "/en//x", "/a/b/c", "/a/b", "/a/bc"]


def slow(url, rules, default="allow"):
    host, path = urls.split_url(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, default)


def test_urls(spark):
    r = random.Random(3)
    rules = sorted({(r.choice(["", "com", "example.com", "www.example.com", "net", "x.net"]), r.choice(["", "/", "/en", "/en/", "/es/", "/a/b", "/a/", "//"]), r.choice(["allow", "block"])) for _ in range(40)})
    all_urls = [None, "", "x", "://", "http://", "mailto:a@b.com"] + [f"{s}://{h}{p}{q}" for s in ("http", "HTTPS") for h in HOSTS for p in PATHS for q in ("", "?x=/en/", "#/es/")]
    df = spark.createDataFrame([(i if i % 50 else None, u, "h", "v") for i, u in enumerate(all_urls)], "page_id long, url string, host string, verdict string")
    for own in (rules, urls.RULES):
        want = Counter((i if i % 50 else None, *slow(u, own)) for i, u in enumerate(all_urls))
        for most in (1000, 0):
            got = urls.url_verdicts(df, own, max_rules=most)
            assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
            assert Counter(map(tuple, got.collect())) == want, most
    assert urls.url_verdicts(df.limit(0), rules).count() == 0
    assert urls.url_verdicts(df, spark.createDataFrame(rules, urls.RULE_SCHEMA)).count() == len(all_urls)


def test_id_with_an_inner_name(spark):
    df = spark.createDataFrame([("http://example.com/en/", "http://x.net/es/")], "__url string, url string")
    for most in (1000, 0):
        got = urls.url_verdicts(df, urls.RULES, id_col="__url", max_rules=most).collect()
        assert [(r["__url"], r.host, r.verdict) for r in got] == [("http://example.com/en/", "x.net", "block")]
