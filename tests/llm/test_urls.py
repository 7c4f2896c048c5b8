import re

from pyspark.sql import functions as F

from faultframe.llm import urls

URLS = [
    "http://example.com/en/1", "https://WWW.Example.COM/en/x?q#f", "http://m.example.com/en/", "http://example.com/de/3", "http://a.net/es/1",
    "http://net/fr/", "http://a.net/fr", "http://b.net/de/", "http://xnet/es/", "https://a.org/es/1", "http://a.com", "http://a.com?x=/", "no scheme",
    "", None, "x://", "a://b://c/d", "http://A.NET/ES/1", "http://É.net/es/#", "http://a.com#/en/", "//a.com/en/", "http://notexample.com/en/1",
    "ftp://user@www.example.com/en/?", "http://" + "a." * 30_000 + "net/es/" + "p/" * 30_000,
]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(pages, urls.ALLOW).collect()}
    for k, url in enumerate(URLS):
        host, path, rule, verdict = by_hand(url)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), url
        assert got[k].verdict == (verdict or urls.ALLOW)


def test_the_model_learns_from_labels(spark):
    rows = [(f"http://s{k % 7}.{'bad' if k % 2 else 'good'}{k % 5}.org/{'win' if k % 2 else 'news'}/{k}", "block" if k % 2 else "allow") for k in range(300)]
    model = urls.fit(spark.createDataFrame(rows, "url string, verdict string"))
    new = spark.createDataFrame([(1, "http://x.bad9.org/win/9", 0.1), (2, "http://y.good8.org/news/1", 0.2), (3, None, 0.3)], "page_id long, url string, probability double")
    got = {r.page_id: r for r in urls.judge(new, model).collect()}
    assert (got[1].verdict, got[2].verdict) == ("block", "allow") and got[3].verdict in ("allow", "block") and got[3].probability == 0.3
    assert all(r.rule is None and 0 <= r.block_score <= 1 for r in got.values())


def test_without_two_classes(spark):
    one = spark.createDataFrame([("http://a.net/es/1", "block")], "url string, verdict string")
    assert urls.fit(one) == "block" and urls.fit(one.limit(0)) == "allow"
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages, urls.fit(urls.labelled_by_rules(pages))).count() == 0
