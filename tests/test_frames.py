"""DataFrame operators: pipeline, stores, streaming and the entry module."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafpress.operators import rules
from leafpress.plans import pages
from leafpress.sources import store
from leafpress.streaming.pages import parse_stream, read_pages

FAST = ["clean_text", "pdepth", "title_denoise", "worth_type", "style_rule", "dom_nodes", "centroid_choice", "rule_pick", "rule_publish", "cache_lookup_ttl", "image_upsert", "segment_ids"]


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    text = lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)
    norm = lambda rows: sorted(tuple(map(text, r)) for r in rows)
    assert norm(map(tuple, got.select(*cols).collect())) == norm(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_pages_without_content(spark):
    rows = [(1, "http://a/", None), (2, None, "<p>x</p>"), (3, "http://a/", ""), (4, "http://a/", "<p>short</p>")]
    out = {r["page_id"]: r for r in pages.parse(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(out[k]["worthless"] and out[k]["worth_type"] == 3 for k in out) and out[1]["error"] and out[4]["error"] is None


def test_rule_that_refuses_a_page(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    values = {"bodies": F.array(F.lit("//nothing")), "noises": F.array().cast("array<string>"), "reserved_nodes": F.array().cast("array<string>"), "body_use_rule_only": F.lit(True), "no_semantic_denoise": F.lit(False), "need_browser_crawl": F.lit(False)}
    table = spark.range(1).select(F.lit("a.b").alias("host"), *(values.get(v, F.lit("")).alias(v) for v in rules.VALUES), now.alias("create_time"), now.alias("update_time"), F.lit(0).alias("status"), F.lit(1).alias("stage"))
    found = rules.pick_rules(spark.createDataFrame([(1, "http://www.a.b/c", "<p>x</p>"), (2, "http://other/", "<p>x</p>")], "page_id int, url string, html string"), table)
    out = {r["page_id"]: r["error"] for r in pages.segment(found).collect()}
    assert out[1] and out[2] is None


def test_cache_append_and_lookup(spark, tmp_path):
    now = F.lit("2024-01-02").cast("timestamp")
    rows = spark.createDataFrame([("u", "x"), ("", "y"), ("v", None)], "url string, html string")
    store.cache_append(rows, str(tmp_path / "cache"), now)
    store.cache_append(rows.withColumn("html", F.lit("new")), str(tmp_path / "cache"), F.lit("2024-01-03").cast("timestamp"))
    got = store.cache_lookup(store.cache_read(spark, str(tmp_path / "cache")), rows, F.lit("2024-01-04").cast("timestamp"))
    assert {r["url"]: r["html"] for r in got.collect()} == {"u": "new", "v": "new"}


def against_sql(spark, folder, name):
    """Rows of a query over ``pages`` of a folder, and of its SQL."""
    got = entry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def test_pages_with_one_address_are_fetched_each(spark, tmp_path):
    rows = [(i, f"https://a.b/{i // 4}", f"<p>{i}</p>") for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = against_sql(spark, tmp_path, "crawl_fallback")
    assert len(got) == 40 and got == want


@pytest.mark.parametrize("name", ["distill_page", "segment_page", "parse_page"])
def test_short_articles_beside_long_ads(spark, tmp_path, name):
    rows = [(i, f"https://a.b/{i}", f"<html><head><title>Name {i}</title></head><body><div>{'ad words ' * (i * 20)}</div><article><h1>Name {i}</h1><p>Some words.</p></article></body></html>") for i in range(4)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = against_sql(spark, tmp_path, name)
    assert got == want


def test_answers_to_one_request_give_one_row(spark):
    asked = spark.createDataFrame([("u",), ("v",), ("v",), ("w",)], "url string")
    table = lambda *rows: spark.createDataFrame(list(rows), "url string, html string")
    got = store.fetch(asked, table(("u", "a"), ("u", "b"), ("v", "")), table(("v", "c"), ("v", None), ("u", "x")), table(("q", "y")))
    assert sorted(map(tuple, got.select("url", "source", "html").collect())) == [("u", "cache", "b"), ("v", "plain", "c"), ("v", "plain", "c"), ("w", "error", None)]


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/pages.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    parse_stream(read_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    key = lambda df: sorted((r["page_id"], r["title"], r["text"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(pages.parse(batch))
