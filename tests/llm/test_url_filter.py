import pytest

from barloom.llm.queries import URL_RULES
from barloom.llm.url_filter import UrlRule, filter_urls


def judged(spark, urls, rules=URL_RULES, **more):
    pages = spark.createDataFrame(
        [(i, u, "h", 1, "r") for i, u in enumerate(urls)], "page_id long, url string, host string, row int, rule string"
    )
    rows = filter_urls(pages, rules, **more).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}, rows


CASES = {
    "http://example.com/en/x": ("example.com", "/en/x", "example.com/en/", "block"),
    "HTTP://WWW.Example.COM/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://a.www.example.com/en/1?q#f": ("a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://example.com/EN/x": ("example.com", "/EN/x", "com/", "allow"),
    "http://example.com": ("example.com", "", None, "deny"),
    "http://example.com?x=/en/": ("example.com", "", None, "deny"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://b.net/es/": ("b.net", "/es/", "net/es/", "block"),
    "http://b.net/es": ("b.net", "/es", None, "deny"),
    "http://net/fr/x": ("net", "/fr/x", "net/fr/", "block"),
    "ftp://x.org://y.com/en/": ("x.org:", "//y.com/en/", None, "deny"),
    "example.com/en/": ("", "", None, "deny"),
    "http://ÄÉ.com/": ("ÄÉ.com", "/", "com/", "allow"),
    "": ("", "", None, "deny"),
    "://": ("", "", None, "deny"),
}


def test_cases(spark):
    found, _ = judged(spark, list(CASES), default="deny")
    assert [found[i] for i in range(len(CASES))] == list(CASES.values())


def test_nulls_repeats_and_long_urls(spark):
    long_url = "http://example.com/en/" + "a/" * 20_000
    pages = spark.createDataFrame([(1, None), (1, long_url), (1, long_url), (None, None)], "page_id long, url string")
    rows = filter_urls(pages, URL_RULES).collect()
    assert sorted((r.page_id is None, r.verdict, r.rule or "") for r in rows) == [
        (False, "allow", ""), (False, "block", "example.com/en/"), (False, "block", "example.com/en/"),
        (True, "allow", ""),
    ]
    assert filter_urls(pages.limit(0), URL_RULES).collect() == []


def test_only_candidates_run(spark):
    """Rules are filed under the literal that fewest urls have, so most urls try few of them."""
    urls = [f"http://h{i}.com/p/" for i in range(50)]
    _, rows = judged(spark, urls, [UrlRule(f"h{i}.com/p/", "block") for i in range(50)])
    assert {r.n_candidates for r in rows} == {1} and {r.verdict for r in rows} == {"block"}


def test_rules_are_checked():
    with pytest.raises(ValueError):
        from pyspark.sql import SparkSession

        from barloom.llm.url_filter import rule_table

        rule_table(SparkSession.getActiveSession(), [UrlRule("/x/", "block")])
