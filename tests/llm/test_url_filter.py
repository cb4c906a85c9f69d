from __future__ import annotations

import pytest

from hemiciclo.llm.url_filter import SOFT, STRICT, bounded_hits, judge_urls


@pytest.mark.parametrize(("url", "strict", "soft"), [("http://casino.example/x", {"casino"}, set()), ("http://casinoroyale.example", set(), set()), ("http://a.b/free-bets?free", set(), {"free", "bets"}), ("http://a.b/freebets", set(), set()), ("http://a.b/cheap_pills", set(), {"cheap", "pills"}), ("spam", {"spam"}, set()), ("", set(), set())])
def test_boundaries(url, strict, soft):
    assert bounded_hits(url, STRICT, SOFT) == (strict, soft)


def test_rules_and_verdicts(spark):
    urls = {
        1: ("http://a.com/en/1", "a.com", "/en/1", "com/en/", "block"), 2: ("HTTPS://WWW.Example.COM/en/7?x#y", "www.example.com", "/en/7", "example.com/en/7", "allow"),
        3: ("http://x.net/de/1", "x.net", "/de/1", "net/de/", "allow"), 4: ("http://example.net/de/85", "example.net", "/de/85", "example.net/de/8", "block"),
        5: ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"), 6: ("http://a.org/es", "a.org", "/es", None, "allow"),
        7: ("http://a.fr?casino", "a.fr", "", None, "block"), 8: ("no scheme free bets", "", "", None, "block"), 9: (None, "", "", None, "allow"), 10: ("", "", "", None, "allow"),
        11: ("http://casino.net/de/1", "casino.net", "/de/1", "net/de/", "allow"), 12: ("a://b://c/d", "b:", "//c/d", None, "allow"), 13: ("http://x.fr/free", "x.fr", "/free", None, "allow"),
    }
    df = spark.createDataFrame([(k, v[0], "clash", 1) for k, v in urls.items()] * 2, "page_id long, url string, host string, verdict int")
    rows = judge_urls(df).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.page_id][1:]
    assert judge_urls(df.where("false")).count() == 0
