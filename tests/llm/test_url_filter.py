import pytest

from floorledger.llm.queries import URL_RULES
from floorledger.llm.url_filter import url_filter

SCHEMA = "page_id long, url string, host string"
CASES = [
    ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("https://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("https://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("https://example.net", "example.net", "", None, None),
    ("ftp://x.example.com/de/a", "x.example.com", "/de/a", "example.com/de/", "block"),
    ("http://example.com/fr/", "example.com", "/fr/", None, None),
    ("http://w.org/fr/#x", "w.org", "/fr/", "org/fr/", "allow"),
    ("http://org/fr/", "org", "/fr/", "org/fr/", "allow"),
    ("http://É.ORG?a=/fr/", "É.org", "", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("://net/", "net", "/", "net/", "block"),
    ("http://u:p@h.net:80/p\nq", "u:p@h.net:80", "/p\nq", None, None),
    ("http://long.net/" + "p" * 50_000, "long.net", "/" + "p" * 50_000, "net/", "block"),
]


def test_parts_rules_and_odd_urls(spark):
    rows = [(k, c[0], "clash") for k, c in enumerate(CASES)] + [(None, "http://a.net/", None), (0, CASES[0][0], None)]
    got = url_filter(spark.createDataFrame(rows, SCHEMA), URL_RULES, rounds=3).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for k, (_, host, path, rule, verdict) in enumerate(CASES):
        r = by[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("block", "allow")
    assert by[None]["verdict"] == "block"


def test_learns_from_the_labelled_table(spark):
    words = ["casino", "poker", "bets"], ["school", "garden", "books"]
    known = [(f"http://{w}{k}.example.com/{w}/{k}", ("block", "allow")[i]) for i, ws in enumerate(words) for w in ws for k in range(40)]
    labelled = spark.createDataFrame([*known, (None, "block"), ("http://x/", None)], "url string, verdict string")
    pages = [(k, f"https://{w}-site.org/{w}/page{k}.html") for k, w in enumerate(words[0] + words[1])]
    got = url_filter(spark.createDataFrame(pages, "page_id long, url string"), [], labelled=labelled).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {k: "block" if k < 3 else "allow" for k in range(6)}


def test_method_agrees_with_held_out_rules(spark):
    """Trained on half of the urls that rules judge, it gives the other half its rules' verdicts."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    ruled = url_filter(pages, URL_RULES, rounds=1).filter("rule IS NOT NULL").select("page_id", "verdict").join(pages, "page_id")
    train, test = ruled.filter("page_id % 2 = 0"), ruled.filter("page_id % 2 = 1")
    got = url_filter(test, [], labelled=train.select("url", "verdict")).select("page_id", "score")
    rows = got.join(test, "page_id").collect()
    right = sum((r["score"] > 0.5) == (r["verdict"] == "block") for r in rows) / len(rows)
    assert right > 0.85


@pytest.mark.parametrize("rows", [[], [(1, "http://x.info/a", None)]])
def test_nothing_to_learn_from(spark, rows):
    got = url_filter(spark.createDataFrame(rows, SCHEMA), URL_RULES).collect()
    assert [(r["verdict"], r["score"]) for r in got] == [("allow", 0.5)] * len(rows)
