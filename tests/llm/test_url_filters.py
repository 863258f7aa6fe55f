import pytest

from loomline.llm import url_filters as U

from .helpers import by_id

CASES = [
    ("http://a.com/x", "a.com", "/x", "com/", "allow"),
    ("https://WWW.Example.com/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://b.net/es/", "b.net", "/es/", "net/es/", "block"),
    ("http://net/fr/x", "net", "/fr/x", "net/fr/", "block"),
    ("http://b.net/es", "b.net", "/es", None, "allow"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("http://a.com?x=/en/", "a.com", "", None, "allow"),
    ("x\ny://Ä.ORG#/a", "Ä.org", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "mine") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, bad int")


def test_rules(spark):
    got = by_id(U.url_verdicts(pages(spark, [c[0] for c in CASES]), outcomes(spark, [])), "page_id")
    for i, case in enumerate(CASES):
        assert tuple(got[i][k] for k in ("host", "path", "rule", "verdict")) == case[1:], case


def test_reputation_blocks_by_the_lower_bound_and_shrinks_small_hosts(spark):
    urls = [f"http://bad.site.org/{i}" for i in range(60)] + [f"http://new.site.org/{i}" for i in range(2)] + [f"http://h{i % 30}.fine.org/{i}" for i in range(300)] + ["http://odd.fine.org/"]
    labels = [(i, 1) for i in range(50)] + [(i, 0) for i in range(62, 362)] + [(362, 1), (5, 0), (None, 1)]
    got = by_id(U.url_verdicts(pages(spark, urls), outcomes(spark, labels)), "page_id")
    assert all(got[i]["verdict"] == "block" for i in range(60))
    assert all(got[i]["verdict"] == "allow" for i in range(62, 363))  # odd.fine.org has one label, and it is bad
    assert got[362]["bad_rate"] < 0.9 and got[60]["bad_rate"] > got[100]["bad_rate"]


@pytest.mark.parametrize("host, domain, suffix", [("a.b.c.com", "c.com", "com"), ("x.y.co.uk", "y.co.uk", "co.uk"), ("com", "com", "com"), ("1.2.3.4:80", "1.2.3.4", "1.2.3.4"), ("", "", ""), ("a.com:8080", "a.com", "com"), ("co.uk", "co.uk", "uk")])
def test_levels(spark, host, domain, suffix):
    row = U.with_levels(spark.createDataFrame([(host,)], "host string")).first()
    assert (row.domain, row.suffix) == (domain, suffix)


def test_repeated_rows_and_empty_table(spark):
    frame = pages(spark, ["http://a.org/"] * 3)
    assert U.url_verdicts(frame.union(frame), outcomes(spark, [(0, 1)])).count() == 6
    assert U.url_verdicts(frame.limit(0), outcomes(spark, [(0, 1)])).collect() == []


def test_main_path_is_native(spark):
    plan = U.url_verdicts(pages(spark, ["http://a.org/"]), outcomes(spark, []))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
