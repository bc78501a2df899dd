import re

from chromaframe.llm.queries import URL_RULES, op4_url_filter
from chromaframe.llm.urlfilter import filter_urls


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def judge(url):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


URLS = ["http://A.COM/x", "http://com/", "http://com", "https://www.example.com/en/a?b#c", "https://example.com/en/", "x.example.com/en/", None, "", "://net/es/x", "http://a.net/fr/", "http://a.net/fr", "a://b://c.net/es/", "http://É.ORG/Ü", "http://w.example.com/en/?q"]


def test_rules_and_list(spark):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("É.org/Ü",), ("nowhere.org",), (None,)], "listed string")
    got = {r.page_id: r for r in filter_urls(pages, listed, "listed", URL_RULES).collect()}
    assert len(got) == len(URLS)
    for k, url in enumerate(URLS):
        host, path, rule, verdict = judge(url)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == (verdict or ("block" if k == 12 else "allow"))


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(pages, spark.createDataFrame([], "u string"), "u", URL_RULES).count() == 0


def test_query_follows_the_rules(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op4_url_filter(spark, sf_dir).collect():
        host, path, rule, verdict = judge(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict in (None, r.verdict)


def test_clashing_names_and_hot_urls(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(k, "http://hot.org/") for k in range(500)] + [(500 + k, f"http://h{k}.org/") for k in range(100)] + [(700, None)], "page_id long, url string")
    mine = ["_block", "_pick", "_key", "_hit", "_canonical", "w0", "w7", "_W1", "block", "name"]
    for c in mine:
        pages = pages.withColumn(c, F.lit("mine"))
    got = filter_urls(pages, spark.createDataFrame([("hot.org",), ("h7.org",)], "u string"), "u", URL_RULES)
    assert got.columns == [*pages.columns, "listed", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == 601 and all(r[c] == "mine" for r in rows for c in mine)
    assert {r.page_id for r in rows if r.listed} == {*range(500), 507}
