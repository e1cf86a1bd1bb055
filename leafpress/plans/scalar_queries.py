"""Registered queries of scalar functions, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.functions import fixed, text as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# DuckDB's form of trimming all white space.
def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0B\p{{Z}}\x{{85}}]+|[\s\x0B\p{{Z}}\x{{85}}]+\z', '', 'g')"


def sql_clean(x: str) -> str:
    for pattern, into in fixed.CLEAN_CHAIN:
        into = into.replace("'", "''").replace("\n", "' || chr(10) || '")
        x = f"regexp_replace({x}, '{pattern}', '{into}', 'g')" if pattern.startswith("[") or len(pattern) > 1 else f"replace({x}, '{pattern}', '{into}')"
    return sql_trim(x.replace("[\\t\\n\\f\\r ]{255,}", "[\\t\\n\\f\\r ]{255,255}[\\t\\n\\f\\r ]*"))


_NOISY = "text || chr(9) || chr(10) || ' ‘q’ “w” …—–  <b> </b>x  '"


@query("SELECT page_id, url, html FROM pages")
def scan_pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", "html")


@query("SELECT page_id, replace(replace(replace(replace(html, '&amp;', '&'), '&nbsp;', ' '), '<ne-', '<'), '</ne-', '</') AS html FROM (SELECT page_id, '<ne-p>&nbsp;' || html || '</ne-p>' AS html FROM pages)")
def unescape_html(spark, d):
    return table(spark, d, "pages").select("page_id", X.unescape_html(F.concat(F.lit("<ne-p>&nbsp;"), "html", F.lit("</ne-p>"))).alias("html"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<textarea\b([^>]*)>', '<div\1>', 'g'), '(?i)</textarea>', '</div>', 'g') AS html
FROM (SELECT page_id, '<TextArea rows="3">x</textAREA>' || html AS html FROM pages)""")
def textarea_to_div(spark, d):
    return table(spark, d, "pages").select("page_id", X.textarea_to_div(F.concat(F.lit('<TextArea rows="3">x</textAREA>'), "html")).alias("html"))


@query(f"SELECT doc_id, {sql_clean(_NOISY)} AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_text(F.concat("text", F.lit("\t\n ‘q’ “w” …—–  <b> </b>x  "))).alias("cleaned"))


@query(r"SELECT doc_id, regexp_replace(text || chr(12288) || 'x', '[\t\n\f\r \p{Zs}]+', '', 'g') AS bare FROM documents")
def remove_space(spark, d):
    return table(spark, d, "documents").select("doc_id", X.remove_space(F.concat("text", F.lit("　x"))).alias("bare"))


@query(r"""SELECT page_id, link, CASE WHEN starts_with(link, 'http') THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN starts_with(link, '://') THEN 'http' || link
  WHEN starts_with(link, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || link ELSE regexp_extract(url, '^(https?://.*/)', 1) || link END AS absolute
FROM (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'https://a.b/c' WHEN 1 THEN '//cdn.x/i.png' WHEN 2 THEN '://y.z/i' WHEN 3 THEN '/img/' || page_id || '.png' ELSE 'rel' || page_id || '.html' END AS link FROM pages)""")
def abs_link(spark, d):
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    link = F.when(k == 0, F.lit("https://a.b/c")).when(k == 1, "//cdn.x/i.png").when(k == 2, "://y.z/i").when(k == 3, F.concat(F.lit("/img/"), n, F.lit(".png"))).otherwise(F.concat(F.lit("rel"), n, F.lit(".html")))
    return table(spark, d, "pages").select("page_id", link.alias("link"), X.abs_link(link, F.col("url")).alias("absolute"))


_XPATH_SQL = "'/html/body/' || (['div','section','p','table','ul'])[(l_partkey % 5 + 1)::INT] || '[' || l_linenumber || ']/' || (['span','li[2]','h2','b','td'])[(l_suppkey % 5 + 1)::INT] || '/a[' || l_orderkey % 7 || ']'"


def _xpaths(spark, d) -> DataFrame:
    pick = lambda names, c: F.element_at(X.literals(names), (F.col(c) % 5 + 1).cast("int"))
    path = F.concat(F.lit("/html/body/"), pick(["div", "section", "p", "table", "ul"], "l_partkey"), F.lit("["), F.col("l_linenumber").cast("string"), F.lit("]/"), pick(["span", "li[2]", "h2", "b", "td"], "l_suppkey"), F.lit("/a["), (F.col("l_orderkey") % 7).cast("string"), F.lit("]"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", path.alias("xpath"))


_XPATHS = f"(SELECT l_orderkey, l_linenumber, {_XPATH_SQL} AS xpath FROM lineitem)"


@query(rf"SELECT l_orderkey, l_linenumber, regexp_replace(xpath, '(.*/({'|'.join(fixed.PARAGRAPH_TAGS)})(\[\d+\])?)(/.*)?$', '\1') AS pdepth FROM {_XPATHS}")
def pdepth(spark, d):
    return _xpaths(spark, d).select("l_orderkey", "l_linenumber", X.pdepth(F.col("xpath")).alias("pdepth"))


@query(rf"SELECT l_orderkey, l_linenumber, array_to_string(list_transform(string_split(xpath, '/'), lambda x: regexp_replace(x, '\[\d+\]', '', 'g')), ',') AS parts FROM {_XPATHS}")
def xpath_split(spark, d):
    return _xpaths(spark, d).select("l_orderkey", "l_linenumber", F.array_join(X.xpath_split(F.col("xpath")), ",").alias("parts"))


_GOLD = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.GOLD_TAGS.items()) + "}"


@query(rf"SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(xpath, '\[\d*\]', '', 'g'), '/'), lambda x: {_GOLD}[x]), lambda x: x IS NOT NULL))), ',') AS tags FROM {_XPATHS}")
def xpath_tags(spark, d):
    return _xpaths(spark, d).select("l_orderkey", "l_linenumber", F.array_join(X.xpath_tags(F.col("xpath")), ",").alias("tags"))


_COLORS = ["#fff", "#000", "white", "rgb(255, 255, 255)", "rgb(10, 20, 30)", "DarkBlue", "#abcdef", "rgba(0,0,0,0.5)", "transparent", "#123"]
_COLOR_SQL = f"({sql_list(_COLORS)})[(p_size % 10 + 1)::INT]"


def _colors(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size", F.element_at(X.literals(_COLORS), (F.col("p_size") % 10 + 1).cast("int")).alias("color"))


@query(f"SELECT p_partkey, color, (['other','white','dark','white','white','dark','dark','other','other','white','dark'])[CASE color WHEN '#fff' THEN 2 WHEN '#000' THEN 3 WHEN 'white' THEN 4 WHEN 'rgb(255, 255, 255)' THEN 5 WHEN 'rgb(10, 20, 30)' THEN 6 WHEN 'DarkBlue' THEN 7 WHEN 'transparent' THEN 10 WHEN '#123' THEN 11 ELSE 1 END] AS class FROM (SELECT p_partkey, {_COLOR_SQL} AS color FROM part)")
def color_class(spark, d):
    return _colors(spark, d).select("p_partkey", "color", X.color_class(F.col("color")).alias("class"))


@query(f"SELECT p_partkey, 'background: url(http://x/y);color:' || {_COLOR_SQL} || '; width : ' || p_size || 'px ;color: c' || p_size AS style, 'color: c' || p_size || ';width: ' || p_size || 'px' AS normal FROM part")
def style_map(spark, d):
    size = F.col("p_size").cast("string")
    style = F.concat(F.lit("background: url(http://x/y);color:"), "color", F.lit("; width : "), size, F.lit("px ;color: c"), size)
    return _colors(spark, d).select("p_partkey", style.alias("style"), X.style_text(X.style_map(style)).alias("normal"))


@query(f"""SELECT p_partkey, tag, concat_ws(';', CASE WHEN color IN ('#abcdef', 'rgba(0,0,0,0.5)') THEN 'background: ' || color END, CASE WHEN color NOT IN ('#fff', 'white', 'rgb(255, 255, 255)', 'transparent') THEN 'color: ' || color END,
  'font-weight: bold', CASE WHEN tag = 'ol' THEN 'list-style: none' END, CASE WHEN tag = 'img' AND p_size % 4 <> 0 THEN 'width: ' || p_size || '%' END) AS style
FROM (SELECT p_partkey, p_size, {_COLOR_SQL} AS color, (['p', 'img', 'ol'])[(p_partkey % 3 + 1)::INT] AS tag FROM part)""")
def style_rule(spark, d):
    width = F.when(F.col("p_size") % 4 == 0, F.lit("100%")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("%")))
    style = F.concat(F.lit("font-weight: bold !important;color:"), "color", F.lit(";background:"), "color", F.lit(";list-style: none;position:fixed;width:"), width)
    tag = F.element_at(X.literals(["p", "img", "ol"]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _colors(spark, d).select("p_partkey", tag.alias("tag"), X.style_rule(tag, style).alias("style"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host, regexp_replace('https://www.http://www.' || url, '^(https?://|www\.)+', '') AS bare FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", X.url_host(F.col("url")).alias("host"), X.bare_url(F.concat(F.lit("https://www.http://www."), "url")).alias("bare"))


_PDF_ENDS = ["", ".PDF", ".pdf?x=1#y", ".pdf"]


@query(f"""SELECT page_id, ends_with(link, '.pdf') OR contains(link, 'arxiv.org/pdf') OR link LIKE '%files.example/download?file_id=%' AS pdf, contains(link, 'store.example') AS own
FROM (SELECT page_id, CASE page_id % 7 WHEN 4 THEN 'https://arxiv.org/pdf/24' || page_id WHEN 5 THEN 'https://files.example/download?file_id=' || page_id WHEN 6 THEN 'https://store.example/x' ELSE url || ({sql_list(_PDF_ENDS)})[(page_id % 7 % 4 + 1)::INT] END AS link FROM pages)""")
def url_is_pdf(spark, d):
    """As written: upper case and what follows the ending make it another url."""
    k, n = F.col("page_id") % 7, F.col("page_id").cast("string")
    link = F.concat("url", F.element_at(X.literals(_PDF_ENDS), (k % 4 + 1).cast("int")))
    link = F.when(k == 4, F.concat(F.lit("https://arxiv.org/pdf/24"), n)).when(k == 5, F.concat(F.lit("https://files.example/download?file_id="), n)).when(k == 6, F.lit("https://store.example/x")).otherwise(link)
    download = r"files\.example/download\?file_id=.*"
    return table(spark, d, "pages").select("page_id", X.url_is_pdf(link, (download,)).alias("pdf"), X.url_is_own_pdf(link, ("store.example",), ()).alias("own"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def md5_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))


@query()
def short_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.short_hash(F.col("text"), F.lit("v1")).alias("digest"))


@query("""SELECT p_partkey, coalesce(first(substring(a, i, n) ORDER BY n DESC, i) FILTER (contains(b, substring(a, i, n))), '') AS common
FROM (SELECT *, unnest(generate_series(1, length(a) - i + 1)) AS n FROM (SELECT p_partkey, p_name AS a, p_brand || ' ' || reverse(p_name) || substring(p_name, 3, p_size % 9) AS b, unnest(generate_series(1, length(p_name))) AS i FROM part)) GROUP BY p_partkey""")
def lcs(spark, d):
    b = F.concat("p_brand", F.lit(" "), F.reverse("p_name"), F.substring("p_name", F.lit(3), (F.col("p_size") % 9).cast("int")))
    return table(spark, d, "part").select("p_partkey", X.longest_common(F.col("p_name"), b).alias("common"))


@query("SELECT p_partkey, p_name AS common FROM part")
def lcs_mapped(spark, d):
    """A heading that holds a title, with other signs around it, gives the title as it was written."""
    full = F.concat("p_name", F.lit(" – "), "p_brand")
    part = F.concat(F.lit("<< "), "p_name", F.lit("\t >>"))
    return table(spark, d, "part").select("p_partkey", F.trim(X.common_in_full(full, part)).alias("common"))


@query("""SELECT doc_id, replace(replace(replace(text || ' <the> and', 'and', chr(1)), 'an', 'B'), chr(1), 'an') AS replaced FROM documents""")
def replace_links(spark, d):
    """One pass: what replaces ``and`` is not replaced again, and an empty value leaves its key."""
    links = F.create_map(F.lit("an"), F.lit("B"), F.lit("and"), F.lit("an"), F.lit("<the>"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", X.replace_links(F.concat("text", F.lit(" <the> and")), links).alias("replaced"))


@query("SELECT doc_id, substring(text, 1, 50) AS head, substring(text, 11) AS rest FROM (SELECT doc_id, text || 'zzzzzzzzzzzz' AS text FROM documents)")
def first_n(spark, d):
    text = F.concat("text", F.lit("zzzzzzzzzzzz"))
    cut = F.concat(F.substring(text, 1, 10), F.lit("\u0001"))
    return table(spark, d, "documents").select("doc_id", F.substring(text, 1, 50).alias("head"), X.trim_left_common(text, cut).alias("rest"))


@query("SELECT page_id, starts_with(url, 'https://a') OR starts_with(url, 'https://s') OR starts_with(url, 'http://') AS hit FROM pages")
def has_prefix(spark, d):
    return table(spark, d, "pages").select("page_id", X.has_prefix(F.col("url"), X.literals(["https://a", "https://s", "http://"])).alias("hit"))


@query(r"""SELECT doc_id, len(w) AS n, list_bool_or(list_transform(w, lambda x: x = 'the')) AS any_the, list_bool_and(list_transform(w, lambda x: length(x) > 0)) AS all_full,
  array_to_string(list_transform(list_filter(w, lambda x: length(x) > 12), lambda x: reverse(x)), ' ') AS long, list_min(w) AS least, coalesce(list_position(w, 'the'), 0)::BIGINT AS place
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def hof_collections(spark, d):
    w = F.split("text", " ")
    words = table(spark, d, "documents").select("doc_id", w.alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n"), F.exists("w", lambda x: x == "the").alias("any_the"), F.forall("w", lambda x: F.length(x) > 0).alias("all_full"), F.array_join(F.transform(F.filter("w", lambda x: F.length(x) > 12), F.reverse), " ").alias("long"), F.array_min("w").alias("least"), F.array_position("w", "the").alias("place"))


@query("""SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT doc_id, w, min(i) AS i FROM (
  SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) GROUP BY doc_id, w) GROUP BY doc_id""")
def dedup_ordered(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def json_roundtrip(spark, d):
    rows = table(spark, d, "documents").select(F.to_json(F.struct("doc_id", "lang", "source", "n_chars")).alias("j"))
    return rows.select(F.from_json("j", "doc_id bigint, lang string, source string, n_chars bigint").alias("r")).select("r.*")


@query("SELECT o_orderkey, round(o_totalprice / 7, 2) AS rounded FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def round_half_up(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(F.floor("o_totalprice").cast("double") / 7, 2).alias("rounded"))


_TITLE_SQL = "(CASE p_partkey % 4 WHEN 0 THEN p_name || '-' || p_brand WHEN 1 THEN '【[' || p_name || ']】' WHEN 2 THEN p_name || ' | ' || p_name ELSE '(' || p_name || '_x' END)"


def _titles(spark, d) -> DataFrame:
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, F.concat("p_name", F.lit("-"), "p_brand")).when(k == 1, F.concat(F.lit("【["), "p_name", F.lit("]】"))).when(k == 2, F.concat("p_name", F.lit(" | "), "p_name")).otherwise(F.concat(F.lit("("), "p_name", F.lit("_x")))
    return table(spark, d, "part").select("p_partkey", "p_name", title.alias("raw"))


@query(f"""SELECT p_partkey, CASE WHEN strlen(front)::FLOAT / strlen(t)::FLOAT > 0.7::FLOAT THEN front ELSE t END AS title
FROM (SELECT p_partkey, t, array_to_string(list_slice(string_split_regex(t, '{fixed.TITLE_SPLIT}'), 1, -2), '') AS front FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN p_name ELSE {_TITLE_SQL} END AS t FROM part))""")
def title_denoise(spark, d):
    return _titles(spark, d).select("p_partkey", X.title_denoise(F.col("raw")).alias("title"))


# (Spark pattern, DuckDB pattern) of the layouts that are written out and read back.
_LAYOUTS = [
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"), ("yyyy/MM/dd HH:mm", "%Y/%m/%d %H:%M"), ("yyyy年MM月dd日 HH:mm", "%Y年%m月%d日 %H:%M"),
    ("MMM d, yyyy", "%b %-d, %Y"), ("dd.MM.yyyy", "%d.%m.%Y"), ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "%a, %d %b %Y %H:%M:%S GMT"), ("d MMMM yyyy", "%-d %B %Y"), ("yyyy-MM-dd'T'HH:mm:ss'+08:00'", "%Y-%m-%dT%H:%M:%S+08:00"),
    ("'at' yyyy-MM-dd HH:mm:ss 'on'", "at %Y-%m-%d %H:%M:%S on"), ("'no time'", "no time"),
    ("yyyy-MM-dd'T'HH:mm:ss.SS'Z'", "%Y-%m-%dT%H:%M:%SZ"), ("MMM d HH:mm:ss", "%b %-d %H:%M:%S"), ("EEE MMM d HH:mm:ss 'MST' yyyy", "%c"),
]
_NORMAL = "trim(regexp_replace(regexp_replace(strftime({t}, '%Y-%m-%d %H:%M:%S'), ':00$', ''), '00:00$', ''))"
#: With minutes, so that the forms differ.
_MOMENT = "(o_orderdate + to_minutes((o_orderkey % 1440)::BIGINT) + to_seconds((o_orderkey % 60)::BIGINT))"
_LATER = "to_days(5000)"


@query(f"""SELECT o_orderkey, CASE WHEN k IN (4, 5, 7) THEN strftime(t, '%Y-%m-%d') WHEN k IN (2, 3) THEN {_NORMAL.format(t="date_trunc('minute', t)")} WHEN k = 10 THEN 'no time' WHEN k = 12 THEN '0000' || substring({_NORMAL.format(t='t')}, 5) ELSE {_NORMAL.format(t='t')} END AS normal
FROM (SELECT o_orderkey, o_orderkey % 14 AS k, {_MOMENT} AS t FROM orders)""")
def norm_time(spark, d):
    t = F.col("o_orderdate") + F.make_dt_interval(mins=F.col("o_orderkey") % 1440, secs=F.col("o_orderkey") % 60)
    raw = F.lit(None).cast("string")
    for k, (p, _) in enumerate(_LAYOUTS):
        raw = F.when(F.col("k") == k, F.concat(F.lit("at "), F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.lit(" on")) if k == 9 else F.date_format("t", p)).otherwise(raw)
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 14).alias("k"), t.cast("timestamp").alias("t"))
    return rows.select("o_orderkey", X.norm_time(raw).alias("normal"))


@query(f"SELECT o_orderkey, strftime({_MOMENT} + {_LATER}, '%Y-%m-%d %H:%M:%S') AS clock FROM orders")
def epoch_time(spark, d):
    t = F.col("o_orderdate") + F.make_dt_interval(mins=F.col("o_orderkey") % 1440, secs=F.col("o_orderkey") % 60)
    seconds = F.unix_timestamp(t.cast("timestamp")) + 5000 * 86400
    text = F.when(F.col("o_orderkey") % 2 == 0, seconds.cast("string")).otherwise((seconds * 1000 + 7).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", X.epoch_time(text).alias("clock"))


_GROUPS = "[" + ", ".join(sql_list(g) for g in fixed.WORTHLESS_KEYWORDS) + "]"
_WORTH = f"""SELECT doc_id, CASE WHEN length(text) < 100 AND (regexp_matches({sql_clean('title')}, '{"|".join(fixed.WORTHLESS_TITLES)}')
    OR list_bool_or(list_transform({_GROUPS}, lambda g: len(list_filter(g, lambda w: contains(text, w))) >= 0.75 * len(g) OR len(list_filter(g, lambda w: contains(text, w))) + 1 = len(g)))) THEN 2
  WHEN length(CASE WHEN title = '' THEN text ELSE replace(text, title, '') END) <= 100 THEN 3 ELSE 1 END AS worth
FROM (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'nginx 404' WHEN 1 THEN '内容 作者' ELSE text END AS text, CASE doc_id % 7 WHEN 0 THEN '404 Not Found' WHEN 1 THEN left(text, 30) WHEN 2 THEN 'x 404 ' || chr(9) || ' Not  Found' ELSE '' END AS title FROM documents)"""


def _pages_with_titles(spark, d) -> DataFrame:
    text = F.when(F.col("doc_id") % 9 == 0, "nginx 404").when(F.col("doc_id") % 9 == 1, "内容 作者").otherwise(F.col("text"))
    title = F.when(F.col("doc_id") % 7 == 0, "404 Not Found").when(F.col("doc_id") % 7 == 1, F.substring("text", 1, 30)).when(F.col("doc_id") % 7 == 2, F.lit("x 404 \t Not  Found")).otherwise("")
    return table(spark, d, "documents").select("doc_id", text.alias("text"), title.alias("title"))


@query(f"SELECT doc_id, worth = 2 AS gone FROM ({_WORTH})")
def worth_404(spark, d):
    return _pages_with_titles(spark, d).select("doc_id", F.coalesce(X.worth_404(F.col("title"), F.col("text")), F.lit(False)).alias("gone"))


@query("SELECT doc_id, length(text) <= 100 AS thin FROM documents")
def worth_content(spark, d):
    return table(spark, d, "documents").select("doc_id", X.worth_content(F.lit(""), F.col("text")).alias("thin"))


@query(_WORTH)
def worth_type(spark, d):
    return _pages_with_titles(spark, d).select("doc_id", X.worth_type(F.col("title"), F.col("text")).alias("worth"))


@query(f"SELECT worth, count(*) AS n FROM ({_WORTH}) GROUP BY worth")
def worth_hist(spark, d):
    return worth_type(spark, d).groupBy("worth").agg(F.count(F.lit(1)).alias("n"))


_TINY = "[" + ", ".join(f"{{'phrase': '{p.replace(chr(39), chr(39) * 2)}', 'most': {n}}}" for p, n in fixed.TINY_NOISE) + "]"


@query(f"""SELECT doc_id, len(list_filter(string_split(body, chr(10)), lambda l: list_bool_or(list_transform({_TINY}, lambda r: contains(l, r.phrase) AND length(l) <= r.most))))::BIGINT AS notices
FROM (SELECT doc_id, text || chr(10) || 'see 点击上方' || chr(10) || left(repeat('广告 ', 30), (doc_id % 90)::INT) || chr(10) || text || '阅读原文' AS body FROM documents)""")
def tiny_noise(spark, d):
    """How many lines of a text, with some notices added, are small notices."""
    body = F.concat("text", F.lit("\nsee 点击上方\n"), F.substring(F.repeat(F.lit("广告 "), F.lit(30)), F.lit(1), (F.col("doc_id") % 90).cast("int")), F.lit("\n"), "text", F.lit("阅读原文"))
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split(body, "\n"), lambda l: X.tiny_noise(l))).cast("bigint").alias("notices"))


@query("SELECT p_partkey, 'class,data-x' AS kept FROM part")
def attr_filter(spark, d):
    attrs = F.create_map(F.lit("class"), F.col("p_name"), F.lit("12"), F.col("p_brand"), F.lit("@click"), F.lit("x"), F.lit("xlink:href"), F.lit("y"), F.lit("data-x"), F.lit("z"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(X.attr_filter(attrs))), ",").alias("kept"))


@query("""SELECT p_partkey, 'data-leaf-intro,href,position_id,src' AS kept, 'https://h.x/' || p_partkey AS href FROM part""")
def link_rule(spark, d):
    attrs = F.create_map(F.lit("href"), F.concat(F.lit("/"), F.col("p_partkey").cast("string")), F.lit("class"), F.lit("c"), F.lit("position_id"), F.lit("3"), F.lit("data-leaf-intro"), F.lit("1"), F.lit("src"), F.lit("s"), F.lit("onclick"), F.lit("o"))
    kept = X.kept_attrs(attrs)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"), X.abs_link(kept["href"], F.lit("https://h.x/a/b")).alias("href"))
