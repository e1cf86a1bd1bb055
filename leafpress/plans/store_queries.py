"""Registered queries of the rule store, the fetch cache and the image map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.operators import rules as R
from leafpress.plans.scalar_queries import table
from leafpress.sources import decode, store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_NOW = "TIMESTAMP '2024-01-30 00:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def now():
    return F.expr(f"{_NOW}")


def rules(spark, d) -> DataFrame:
    """Rules made of nations: two stages, some retired, hosts of several kinds."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    host = F.when(k % 5 == 0, F.lower("n_name")).when(k % 5 == 1, F.concat(F.lower("n_name"), F.lit("/a"))).when(k % 5 == 2, F.concat(F.lit("th"), F.substring(F.lower("n_name"), 1, 1))).when(k % 5 == 3, F.concat(F.substring(F.lower("n_name"), 1, 1), F.lit(".*com"))).otherwise(F.lit("www"))
    base = n.select(host.alias("host"), F.col("n_name").alias("host_name"), k.alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("stage"))
    base = base.filter(~((F.col("stage") == 0) & (F.col("k") % 3 == 0)) & ~((F.col("stage") == 1) & (F.col("k") % 4 == 0)))
    some = lambda t: F.array(F.lit(t))
    base = base.select(
        "host", "host_name", some("//article").alias("bodies"), some("//aside").alias("noises"), F.lit("").alias("author"), F.lit("empty").alias("pub_time"), F.concat(F.lit("t"), "k").alias("title"), some("aside").alias("reserved_nodes"),
        F.lit(False).alias("no_semantic_denoise"), (F.col("k") % 2 == 0).alias("need_browser_crawl"), F.lit(False).alias("body_use_rule_only"), now().alias("create_time"), now().alias("update_time"), F.when(F.col("k") % 7 == 6, 1).otherwise(0).alias("status"), "stage", "k",
    )
    best = base.groupBy("host", "stage", "status").agg(F.max_by(F.struct(*[c for c in base.columns if c not in ("host", "stage", "status")]), "k").alias("r"))
    return best.select("host", "r.*", "status", "stage").select(*[f.split(" ")[0] for f in R.RULE.split(", ")])


_RULES = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, stage, status ORDER BY k DESC) AS rn FROM (
  SELECT CASE k % 5 WHEN 0 THEN lower(n_name) WHEN 1 THEN lower(n_name) || '/a' WHEN 2 THEN 'th' || left(lower(n_name), 1) WHEN 3 THEN left(lower(n_name), 1) || '.*com' ELSE 'www' END AS host, n_name AS host_name, k, stage,
    't' || k AS title, CASE WHEN k % 7 = 6 THEN 1 ELSE 0 END AS status
  FROM (SELECT n_nationkey AS k, n_name, unnest([0, 1]) AS stage FROM nation) WHERE NOT (stage = 0 AND k % 3 = 0) AND NOT (stage = 1 AND k % 4 = 0))) WHERE rn = 1)"""
_BARE = r"regexp_replace(url, '^(https?://|www\.)+', '')"
_PROD = f"(SELECT * FROM {_RULES} WHERE status = 0 AND stage = 1)"
_MATCH = f"(starts_with({_BARE}, host) OR regexp_matches(host, '[*+]') AND regexp_matches({_BARE}, host))"


@query(f"SELECT DISTINCT url, host FROM pages JOIN {_PROD} ON {_MATCH}")
def rule_match(spark, d):
    return R.match_rules(table(spark, d, "pages"), R.valid_rules(rules(spark, d)))


@query(f"SELECT page_id, max(CASE WHEN rk = 1 THEN host END) AS rule_host, max(CASE WHEN rk = 1 THEN title END) AS title FROM (SELECT page_id, host, title, row_number() OVER (PARTITION BY page_id ORDER BY strlen(host) DESC, host DESC) AS rk FROM pages LEFT JOIN {_PROD} ON {_MATCH}) GROUP BY page_id")
def rule_pick(spark, d):
    return R.pick_rules(table(spark, d, "pages"), rules(spark, d)).select("page_id", "rule_host", F.col("rule.title").alias("title"))


def _group_sql(first: int, both: bool) -> str:
    other = f" UNION ALL SELECT host, stage, title FROM r WHERE stage <> {first} AND host NOT IN (SELECT host FROM r WHERE stage = {first})" if both else ""
    return f"WITH r AS (SELECT host, stage, title FROM {_RULES} WHERE status = 0) SELECT host, stage, title FROM r WHERE stage = {first}{other}"


@query(_group_sql(1, False))
def rule_stage_prod_only(spark, d):
    return R.valid_rules(rules(spark, d), R.PROD_ONLY).select("host", "stage", "title")


@query(_group_sql(0, False))
def rule_stage_testing_only(spark, d):
    return R.valid_rules(rules(spark, d), R.TESTING_ONLY).select("host", "stage", "title")


@query(_group_sql(1, True))
def rule_stage_prod_prior(spark, d):
    return R.valid_rules(rules(spark, d), R.PROD_PRIOR).select("host", "stage", "title")


@query(_group_sql(0, True))
def rule_stage_testing_prior(spark, d):
    return R.valid_rules(rules(spark, d), R.TESTING_PRIOR).select("host", "stage", "title")


@query(f"SELECT host, stage, max(CASE WHEN stage = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY host) AS editing FROM {_RULES} WHERE status = 0 AND (contains(host_name, 'A') OR contains(host, 'A'))")
def rule_list(spark, d):
    return R.rule_list(rules(spark, d), "A").select("host", "stage", "editing")


@query(f"SELECT host, stage, title FROM {_RULES} WHERE status = 0 AND host = 'www' AND stage = 1")
def rule_detail(spark, d):
    return R.rule_detail(rules(spark, d), "www", 1).select("host", "stage", "title")


_AFTER = "TIMESTAMP '2024-02-01 00:00:00'"


def _changes(spark, d) -> DataFrame:
    """A changed rule for every other nation's name, and new ones."""
    r = rules(spark, d).filter("status = 0").dropDuplicates(["host"])
    return r.select("host", *[F.lit("changed").alias(v) if v == "title" else F.col(v) for v in R.VALUES])


@query(f"SELECT host, stage, title, status FROM (SELECT host, 0 AS stage, 'changed' AS title, 0 AS status FROM (SELECT DISTINCT host FROM {_RULES} WHERE status = 0) WHERE host NOT IN (SELECT host FROM {_RULES} WHERE status = 0 AND stage = 0) UNION ALL SELECT host, stage, title, status FROM {_RULES})")
def rule_new(spark, d):
    return R.rule_new(rules(spark, d), _changes(spark, d), F.expr(_AFTER)).select("host", "stage", "title", "status")


@query(f"SELECT host, stage, CASE WHEN stage = 0 AND status = 0 THEN 'changed' ELSE title END AS title, CASE WHEN stage = 0 AND status = 0 THEN {_AFTER} ELSE {_NOW} END AS update_time, {_NOW} AS create_time FROM {_RULES}")
def rule_update(spark, d):
    return R.rule_update(rules(spark, d), _changes(spark, d), F.expr(_AFTER)).select("host", "stage", "title", "update_time", "create_time")


@query(f"""WITH r AS (SELECT * FROM {_RULES}), t AS (SELECT * FROM r WHERE status = 0 AND stage = 0), p AS (SELECT * FROM r WHERE status = 0 AND stage = 1)
SELECT coalesce(t.host, p.host) AS host, 1 AS stage, coalesce(t.title, p.title) AS title, 0 AS status FROM p FULL JOIN t ON p.host = t.host UNION ALL SELECT host, stage, title, 1 FROM t UNION ALL SELECT host, stage, title, status FROM r WHERE status = 1""")
def rule_publish(spark, d):
    return R.rule_publish(rules(spark, d), [], F.expr(_AFTER)).select("host", "stage", "title", "status")


@query(f"WITH r AS (SELECT * FROM {_RULES}) SELECT host, stage, title, status FROM r UNION ALL SELECT host, 0, title, 0 FROM r WHERE status = 0 AND stage = 1 AND host IN ('www', 'china', 'japan/a') AND host NOT IN (SELECT host FROM r WHERE status = 0 AND stage = 0)")
def rule_to_test(spark, d):
    return R.rule_to_test(rules(spark, d), ["www", "china", "japan/a"], F.expr(_AFTER)).select("host", "stage", "title", "status")


@query(f"SELECT host, stage, CASE WHEN status = 0 AND stage = 1 AND host IN ('www', 'china') THEN 1 ELSE status END AS status FROM {_RULES}")
def rule_delete(spark, d):
    return R.rule_delete(rules(spark, d), ["www", "china"], 1, F.expr(_AFTER)).select("host", "stage", "status")


@query(f"WITH r AS (SELECT * FROM {_RULES} WHERE status = 0) SELECT coalesce(c.host, r.host) AS host, coalesce(c.stage, r.stage) AS stage, coalesce(c.title, r.title) AS title FROM r FULL JOIN (SELECT DISTINCT host, 1 AS stage, 'changed' AS title FROM r) c ON r.host = c.host AND r.stage = c.stage")
def rule_upsert(spark, d):
    changes = _changes(spark, d).withColumn("stage", F.lit(1))
    return R.rule_upsert(rules(spark, d), changes, F.expr(_AFTER)).filter("status = 0").select("host", "stage", "title")


@query(f"SELECT host, stage, title, {_NOW} AS create_time FROM {_RULES} WHERE status = 0 AND stage = 1")
def rule_export_import(spark, d):
    texts = R.export_rules(rules(spark, d))
    empty = spark.createDataFrame([], R.RULE)
    return R.import_rules(empty, texts, F.expr(_AFTER)).select("host", "stage", "title", "create_time")


def _cache(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.concat_ws("/", "event_type", F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("html"), F.col("ts").alias("create_time"), F.col("ts").alias("update_time"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("status"))


_CACHE = "(SELECT 'u' || user_id AS url, event_type || '/' || lpad(event_id::VARCHAR, 9, '0') AS html, ts AS create_time, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS status FROM events)"


@query(f"SELECT url, html, create_time FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY create_time DESC, html DESC) AS k FROM {_CACHE} WHERE status = 0 AND create_time >= {_NOW} - INTERVAL 144 HOUR) WHERE k = 1")
def cache_lookup_ttl(spark, d):
    cache = _cache(spark, d)
    return store.cache_lookup(cache, cache.select("url"), now())


@query(f"SELECT 'u' || user_id AS url, event_type AS html, {_NOW} AS create_time FROM events WHERE event_type <> 'click' AND user_id % 3 <> 0")
def cache_save_valid(spark, d):
    e = table(spark, d, "events")
    pages = e.select(F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("url"), F.when(F.col("event_type") == "click", None).otherwise(F.col("event_type")).alias("html"))
    return store.cache_rows(pages, now()).select("url", "html", "create_time")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'cache' WHEN page_id % 3 = 0 THEN 'plain' WHEN page_id % 5 = 0 THEN 'browser' ELSE 'error' END AS source, CASE WHEN page_id % 2 = 0 OR page_id % 3 = 0 OR page_id % 5 = 0 THEN html END AS html FROM pages")
def crawl_fallback(spark, d):
    """Several pages have one address, so each request is answered by its number."""
    pages = table(spark, d, "pages")
    some = lambda n: pages.filter(F.col("page_id") % n == 0).select("page_id", "html")
    return store.fetch(pages.select("page_id", "url"), some(2), some(3), some(5), ("page_id",)).select("page_id", "source", "html")


def _images(spark, d, where: str, to: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return table(spark, d, "part").filter(where).select(F.concat(F.lit("s"), k).alias("src_img_url"), F.concat(F.lit(to), k).alias("oss_img_url"), now().alias("create_time"), now().alias("update_time"), F.lit(0).alias("status"))


@query(f"SELECT 's' || p_partkey AS src_img_url, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END || p_partkey AS oss_img_url, CASE WHEN p_partkey % 2 = 0 THEN {_NOW} ELSE {_AFTER} END AS create_time FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def image_upsert(spark, d):
    out = store.image_upsert(_images(spark, d, "p_partkey % 2 = 0", "old"), _images(spark, d, "p_partkey % 3 = 0", "new").select("src_img_url", "oss_img_url"), F.expr(_AFTER))
    return out.select("src_img_url", "oss_img_url", "create_time")


@query("SELECT 's' || p_partkey AS src_img_url, 'old' || p_partkey AS oss_img_url FROM part WHERE p_partkey % 6 = 0")
def image_lookup(spark, d):
    return store.image_lookup(_images(spark, d, "p_partkey % 2 = 0", "old"), _images(spark, d, "p_partkey % 3 = 0", "x")).select("src_img_url", "oss_img_url")


#: The bytes of 网页 in GBK, of 中文 in HZ (behind what is no UTF-8), and of 㐀 in GB18030.
_GBK, _HZ, _GB18030 = b"\xcd\xf8\xd2\xb3", b"~{VPND~}", b"\x81\x39\xee\x39"


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'a' || doc_id || '网页' WHEN 2 THEN '㐀' || doc_id || '网页' END AS text FROM documents")
def decode_bytes(spark, d):
    """UTF-8, GBK and GB18030 (four bytes a sign); bytes of no known code give none."""
    k, n = F.col("doc_id") % 4, F.encode(F.col("doc_id").cast("string"), "UTF-8")
    raw = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.lit(b"a"), n, F.lit(_GBK))).when(k == 2, F.concat(F.lit(_GB18030), n, F.lit(_GBK))).otherwise(F.concat(n, F.lit(b"\xff\xff")))
    return table(spark, d, "documents").select("doc_id", decode.decode_bytes(raw).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '中文' || doc_id ELSE 'x' || doc_id END AS text FROM documents")
def decode_hz(spark, d):
    """HZ is seven-bit, so it is plain text for UTF-8 and is read when it is asked for."""
    n = F.encode(F.col("doc_id").cast("string"), "UTF-8")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(_HZ), n)).otherwise(F.concat(F.lit(b"x"), n))
    return table(spark, d, "documents").select("doc_id", decode.decode_bytes(raw, ("hz",)).alias("text"))
