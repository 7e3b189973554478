from __future__ import annotations

import re

from tests.compare import compare, connect
from tonegap.llm import url_rules
from tonegap.llm.queries import QUERIES, URL_RULES

URLS = [
    "http://www.Example.org/en/1/x?q#f", "https://example.org/en/2", "http://a.b.example.org/es/", "http://example.org/es", "http://notexample.org/es/x",
    "http://x.com/fr/a", "http://x.com/de/a", "http://com/de/", "http://x.net/", "x.org/a", "", None, "://", "a://org", "a://org?/x", "a://org/", "http://org#/",
    "http://x.org:80/", "http://y..com/fr/", "http://a.com/de/\n/b", "http://é.org/ü", "a://b://c.org/x",
]


def brute(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = []
    for verdict, text in rules:
        at = text.find("/")
        h, p = text[:at], text[at:]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fit.append((len(text), text, verdict))
    return host, path, *(max(fit)[1:] if fit else (None, "allow"))


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(k, u, "r", "h") for k, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    return {r.page_id: tuple(r)[1:] for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect()}


def test_cases(spark):
    nested = [*URL_RULES, ("allow", "example.org/es/a"), ("block", "example.org/es/ab/"), ("allow", "b.example.org/"), ("block", "x.com/"), ("allow", "com/de/a")]
    urls = [*URLS, *(f"http://{h}/{p}" for h in ("example.org", "b.example.org", "x.com", "org") for p in ("es/a", "es/ab/c", "es/b", "de/a", "de/b", ""))]
    for rules in (URL_RULES, nested, [("block", "org/")]):
        assert judged(spark, urls, rules) == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_repeated_and_missing_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/"), (None, None)], "page_id long, url string")
    rows = sorted(map(tuple, url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES)).collect()), key=str)
    assert rows == sorted([(1, "a.org", "/", "org/", "allow")] * 2 + [(None, "a.org", "/", "org/", "allow"), (None, "", "", None, "allow")], key=str)
    assert url_rules.judge_urls(pages.limit(0), url_rules.rule_table(spark, URL_RULES)).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES).limit(0)).collect()} == {"allow"}


def test_no_python_on_the_main_path(spark):
    pages = spark.range(3).selectExpr("id AS page_id", "'http://a.org/' AS url")
    plan = url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("op7_url_rules", "op2_warc_members"):
        assert compare(spark, connect(sf), QUERIES[name], sf)[0] == []
