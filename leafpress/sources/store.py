"""The fetch cache and the image map as append-only or rewritten tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRAWL = "url string, html string, create_time timestamp, update_time timestamp, status int"
IMAGES = "src_img_url string, oss_img_url string, create_time timestamp, update_time timestamp, status int"
VALID, DELETED = 0, 1
TTL_HOURS = 144


def cache_lookup(cache: DataFrame, urls: DataFrame, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Newest valid html of each url that is not older than the time to live."""
    fresh = cache.filter((F.col("status") == VALID) & (F.col("create_time") >= now - F.make_dt_interval(hours=F.lit(ttl_hours))))
    newest = fresh.join(urls.select("url").distinct(), "url", "left_semi").groupBy("url")
    return newest.agg(F.max_by("html", F.struct("create_time", "html")).alias("html"), F.max("create_time").alias("create_time"))


def cache_rows(pages: DataFrame, now: Column) -> DataFrame:
    """Rows to append for fetched pages; pages without a url or html are refused."""
    full = pages.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("html", F.lit("")) != ""))
    return full.select("url", "html", now.alias("create_time"), now.alias("update_time"), F.lit(VALID).alias("status"))


def cache_append(pages: DataFrame, path: str, now: Column | None = None) -> None:
    cache_rows(pages, now if now is not None else F.current_timestamp()).write.mode("append").parquet(path)


def cache_read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CRAWL).parquet(path)


def back_to_cache(parsed: DataFrame) -> DataFrame:
    """Pages that were fetched now, have content and are wanted in the cache."""
    return parsed.filter("fetched and not worthless and save_crawl_html")


def fetch(requests: DataFrame, cached: DataFrame, plain: DataFrame, browser: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """Html of each request: cache, then plain fetch, then browser; ``source`` says which.

    A request gives one row. Requests are told apart by ``keys``; of several filled
    answers to one the last by code points counts.
    """
    out = requests
    for name, got in (("cache", cached), ("plain", plain), ("browser", browser)):
        one = got.groupBy(*keys).agg(F.max(F.nullif("html", F.lit(""))).alias(name))
        out = out.join(one, [*keys], "left")
    source = F.when(F.col("cache").isNotNull(), "cache").when(F.col("plain").isNotNull(), "plain").when(F.col("browser").isNotNull(), "browser").otherwise("error")
    return out.withColumn("source", source).withColumn("html", F.coalesce("cache", "plain", "browser")).drop("cache", "plain", "browser")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], values: list[str], now: Column, keep_times: bool = False) -> DataFrame:
    """The table with changed or added valid rows; creation times stay, update times move.

    One full join on the keys; among changes with one key the last by update
    order is expected to be chosen before. ``keep_times``: times come with the changes.
    """
    old = table.filter(F.col("status") == VALID).select(*(F.col(c).alias(f"_{c}" if c not in keys else c) for c in table.columns))
    new = changes.select(*keys, *(F.col(v).alias(f"n_{v}") for v in values), *([F.col(t).alias(f"n_{t}") for t in ("create_time", "update_time")] if keep_times else []), F.lit(True).alias("_new"))
    both = old.join(new, keys, "full")
    fresh = F.coalesce("_new", F.lit(False))
    created = F.coalesce(F.col("n_create_time") if keep_times else F.lit(None), F.col("_create_time"), now)
    updated = F.when(fresh, F.col("n_update_time") if keep_times else now).otherwise(F.col("_update_time"))
    cols = {"create_time": created, "update_time": updated, "status": F.lit(VALID)} | {v: F.when(fresh, F.col(f"n_{v}")).otherwise(F.col(f"_{v}")) for v in values}
    merged = both.select(*(cols[c].alias(c) if c in cols else F.col(c) if c in keys else F.col(f"_{c}").alias(c) for c in table.columns))
    return merged.unionByName(table.filter(F.col("status") != VALID))


def image_upsert(table: DataFrame, images: DataFrame, now: Column) -> DataFrame:
    """Add or change image addresses, all or none: an empty one refuses the batch."""
    bad = images.filter((F.coalesce("src_img_url", F.lit("")) == "") | (F.coalesce("oss_img_url", F.lit("")) == "")).limit(1).count()
    if bad:
        raise ValueError("an image has no address")
    return upsert(table, images, ["src_img_url"], ["oss_img_url"], now)


def image_lookup(table: DataFrame, wanted: DataFrame) -> DataFrame:
    return table.filter(F.col("status") == VALID).join(wanted.select("src_img_url").distinct(), "src_img_url", "left_semi")
