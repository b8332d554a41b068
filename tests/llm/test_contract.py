"""Results that a query's contract fixes."""

from __future__ import annotations

from tessera.llm import url_filter

#: The contract's rules and a page of each; the third is decided by the longer of two that fit.
RULES = [("com/en/", "block", "http://a.com/en/1"), ("example.com/en/7", "allow", "http://x.example.com/en/70"), ("net/de/", "allow", "http://b.example.net/de/1"), ("example.net/de/8", "block", "http://example.net/de/8"), ("org/es/", "block", "http://c.org/es/")]


def test_rules_of_url_filters(spark):
    assert {r: a for a, r in url_filter.RULES} == {r: a for r, a, _ in RULES}
    pages = spark.createDataFrame([(k, url) for k, (_, _, url) in enumerate(RULES)], "page_id long, url string")
    # a listed page that a rule allows stays allowed
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, pages.filter("page_id = 2").select("url")).collect()}
    assert got == {k: (rule, action) for k, (rule, action, _) in enumerate(RULES)}
