"""URL verdicts: parsing and rules against plain Python, the classifier on separable URLs."""

import re

import pytest

from patronage.llm import queries, url_filter


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "http://a.org/x", "http://xorg/", "https://example.org/es/1", "https://sub.example.org/en/12?q=http://b.com/de/",
    "ftp://EXAMPLE.com/fr/é#frag", "http://example.com/de/", "http://example.com/de", "x://h?://a.org/", "http://É.Org/a\nb/c", "http://example.org/en/2", "http://example.org:80/en/1", "http://example.com?x/fr/",
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, features string, label string")


def test_parts_and_rules(pages):
    found = url_filter.judge(pages, queries.RULES).collect()
    assert len(found) == len(URLS) + 3
    for row in found:
        host, path = parse(row.url)
        rule = rule_of(host, path, queries.RULES)
        assert (row.host, row.path) == (host, path)
        assert row.rule == (rule and rule.host + rule.path)
        assert row.verdict == rule.verdict if rule else row.verdict in ("allow", "block")


def test_whole_table(spark, testdata):
    found = queries.op5_url_filter(spark, f"{testdata}/sf0.01").collect()
    assert len(found) == spark.read.parquet(f"{testdata}/sf0.01/pages.parquet").count()
    assert {row.verdict for row in found} == {"allow", "block"}
    for row in found:
        rule = rule_of(row.host, row.path, queries.RULES)
        assert row.rule == (rule and rule.host + rule.path)


def test_classifier_generalises(spark):
    rules = [url_filter.Rule("good.net", "/", "allow"), url_filter.Rule("casino.net", "/", "block")]
    urls = [f"http://good.net/news/{i}" for i in range(30)] + [f"http://casino.net/bets/{i}" for i in range(30)]
    other = ["http://other.com/news/77", "http://other.com/bets/77"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls + other)], "page_id long, url string")
    found = {row.url: row.verdict for row in url_filter.judge(pages, rules).collect()}
    assert [found[u] for u in other] == ["allow", "block"]


def test_nothing_labelled_and_empty(spark, pages):
    assert {row.verdict for row in url_filter.judge(pages, []).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), queries.RULES).collect() == []
    one = url_filter.judge(pages, [url_filter.Rule("org", "/", "block")]).collect()
    assert {row.verdict for row in one} <= {"allow", "block"}
