"""Pages and urls that nothing can be made of harm no other page; and functions on odd inputs."""

import pytest
from pyspark.sql import functions as F

from leafpress.functions import text as X
from leafpress.functions.common import common_bytes
from leafpress.operators.page import Page, common_part
from leafpress.operators.rules import rule_list
from leafpress.plans import pages as P

RULE = "struct<bodies:array<string>,noises:array<string>,title:string,author:string,pub_time:string,reserved_nodes:array<string>,no_semantic_denoise:boolean,need_browser_crawl:boolean,body_use_rule_only:boolean>"


def test_bad_pages_give_errors(spark):
    good = "<title>T</title><p>Some text of a page.</p>"
    bad = ([], ["//p["], "", "", "", [], False, False, False)
    rows = [
        (1, "http://h/", good, None), (2, "http://h/", '<meta property="og:url" content="http://[">' + good, None), (3, "http://[x", good, None),
        (4, "http://h/", "<div>" * 1500 + "deep" + good, None), (5, "http://h/", good, bad), (6, None, good, None), (7, "http://h/", "", None),
    ]
    pages = spark.createDataFrame(rows, f"page_id long, url string, html string, rule {RULE}")
    got = {r["page_id"]: r for r in P.parse(pages).collect()}
    assert len(got) == len(rows) and [k for k, r in got.items() if r["error"]] == [5, 6, 7]
    assert "XPathError" in got[5]["error"] and all("Some text" in got[k]["text"] for k in (1, 2, 3, 4))
    nodes = {r["page_id"]: r["nodes"] for r in P.dom_nodes(pages).collect()}
    assert len(nodes) == len(rows) and max(n["depth"] for n in nodes[4]) > 1500
    assert {r["page_id"]: len(r["found"] or ()) for r in P.select(pages, "//p").collect()}[4] == 1


def test_blank_time_goes_on_to_patterns():
    page = Page('<meta itemprop="datePublished" content=" "><p>on 2024-05-06 07:08:09</p>', "http://h/")
    assert page.publish_time() == "2024-05-06 07:08:09"


@pytest.mark.parametrize("a,b", [("", "x"), ("x", ""), ("abcab", "xabyab"), ("aaaa", "aa"), ("é☃é", "☃é"), ("ab" * 50, "ba" * 40), ("xyz", "abc")])
def test_longest_common(a, b):
    a, b = a.encode(), b.encode()
    want = max((a[i:j] for i in range(len(a) + 1) for j in range(i, len(a) + 1) if a[i:j] in b), key=len)
    assert common_bytes(a, b) == want


def test_common_part_is_read_off_the_title():
    assert common_part("A “quoted” title - Site", 'A "quoted" title') == "A “quoted” title"
    assert common_part("The long title - Site", "* The long title *") == "The long title "
    assert common_part("abc", "xyz") == ""


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_columns_on_odd_inputs(spark):
    links = F.create_map(F.lit("a.b"), F.lit("$1"), F.lit("a"), F.lit("x\\y"), F.lit("\\E"), F.lit("E"), F.lit(""), F.lit("no"))
    assert one(spark, X.replace_links(F.lit("a.b a axb \\E "), links)) == "$1 x\\y x\\yxb E "
    assert one(spark, X.replace_links(F.lit("a"), F.create_map().cast("map<string,string>"))) == "a"
    assert one(spark, X.trim_left_common(F.lit("😀ab"), F.lit("😀ax"))) == "b"
    assert one(spark, X.trim_left_common(F.lit("ab"), F.lit("abc"))) == ""
    assert one(spark, X.trim_left_common(F.lit("abc"), F.lit("ab"))) == "c"
    assert [one(spark, X.norm_time(F.lit(t))) for t in ("Jan  2 15:04:05", "3:04PM", "2024-01-02T03:04:05.1234Z", "at noon")] == ["0000-01-02 15:04:05", "0000-01-01 15:04", "2024-01-02 03:04:05", "at noon"]


def test_rules_by_time(spark):
    rows = [("a", "x", 1, 0, 5, 9), ("b", "y", 1, 0, 7, 8)]
    rules = spark.createDataFrame(rows, "host string, host_name string, stage int, status int, update_time long, create_time long")
    order = lambda by: [r["host"] for r in rule_list(rules, order_by=by).collect()]
    assert [order(x) for x in ("", "-update_time", "-create_time")] == [["a", "b"], ["b", "a"], ["a", "b"]]
