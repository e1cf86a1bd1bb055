"""Registered queries of the tree operators. Where ``pages`` lacks a feature, HTML is
built from table columns, so that the expected result follows from the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions import fixed
from leafpress.functions import text as X
from leafpress.operators import windows as W
from leafpress.plans import pages as P
from leafpress.plans.scalar_queries import _MOMENT, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def built(spark, d, name: str, key: str, html: Column, url: Column | None = None) -> DataFrame:
    """Rows of a table as pages."""
    return table(spark, d, name).select(key, (url if url is not None else F.lit("https://site.example/a/b.html")).alias("url"), html.alias("html"))


def text(c: str) -> Column:
    return F.col(c).cast("string")


@query("SELECT page_id, (length(html) - length(replace(html, '<p>', '')))/3 - (length(split_part(html, '</article>', 2)) - length(replace(split_part(html, '</article>', 2), '<p>', '')))/3 - CASE WHEN contains(html, 'var t=\"<p>') THEN 1 ELSE 0 END AS paragraphs, 1 AS articles FROM pages")
def dom_nodes(spark, d):
    nodes = P.dom_nodes(table(spark, d, "pages").select("page_id", "url", "html"))
    inside = lambda tag: F.size(F.filter("nodes", lambda n: n["tag"] == tag))
    return nodes.select("page_id", inside("p").cast("double").alias("paragraphs"), inside("article").alias("articles"))


@query("""SELECT p_partkey, 'html1-' || n || ' head2-2 body3-' || n || ' div4-' || (n - 1) || ' ' || array_to_string(list_transform(generate_series(5, n - 1), lambda i: 'p' || i || '-' || i), ' ') || ' iframe' || n || '-' || n AS tree
FROM (SELECT p_partkey, p_size % 4 + 6 AS n FROM part)""")
def preprocess_prune(spark, d):
    """What pruning leaves, with the numbers of each element and of the last one in it."""
    paragraphs = F.repeat(F.lit("<p>x</p><button>b</button><div aria-hidden='true'>h</div>"), (F.col("p_size") % 4 + 1).cast("int"))
    html = F.concat(F.lit("<nav>n</nav><div>"), paragraphs, F.lit("<script>s</script><p style='display: none'>d</p></div><footer>f</footer><div class='header'>h</div><iframe>i</iframe><style>y</style>"))
    nodes = P.dom_nodes(built(spark, d, "part", "p_partkey", html))
    return nodes.select("p_partkey", F.array_join(F.transform("nodes", lambda n: F.concat(n["tag"], n["pid"].cast("string"), F.lit("-"), n["last_pid"].cast("string"))), " ").alias("tree"))


def _list() -> Column:
    return F.concat(F.lit("<html><body><div><p>"), F.col("p_name"), F.lit("</p><ul>"), F.repeat(F.lit("<li>x"), (F.col("p_size") % 7 + 1).cast("int")), F.lit("</ul><p>"), text("p_size"), F.lit("</p></div></body></html>"))


@query("""SELECT p_partkey, '/html/body/div/ul/li' || CASE WHEN p_size % 7 = 0 THEN '' ELSE '[' || (p_size % 7 + 1) || ']' END AS last_item, '/html/body/div/p[2]' AS second, (p_size % 7 + 8)::INT AS last_pid FROM part""")
def node_xpath(spark, d):
    nodes = P.dom_nodes(built(spark, d, "part", "p_partkey", _list()))
    last = lambda tag: F.element_at(F.filter("nodes", lambda n: n["tag"] == tag), -1)
    return nodes.select("p_partkey", last("li")["xpath"].alias("last_item"), last("p")["xpath"].alias("second"), last("p")["pid"].alias("last_pid"))


@query("SELECT p_partkey, p_size % 7 + 8 AS nodes, '/html/body/div/p[2]' AS last, p_size::VARCHAR AS text FROM part")
def dom_nodes_sql(spark, d):
    """The tree in SQL, by a table function."""
    P.register_dom_nodes(spark)
    pages = built(spark, d, "part", "p_partkey", _list())
    return spark.sql("SELECT p_partkey, count(*) AS nodes, max_by(xpath, pid) AS last, max_by(text, pid) AS text FROM {pages}, LATERAL dom_nodes(html, url) GROUP BY p_partkey", pages=pages)


@query("SELECT p_partkey, (p_size % 7 + 1)::INT AS items, p_size::VARCHAR AS second FROM part")
def xpath_select(spark, d):
    pages = built(spark, d, "part", "p_partkey", _list())
    items, second = P.select(pages, "//ul/li"), P.select(pages, "//p[2] | //p[@id='none']")
    items = items.select("p_partkey", F.size("found").alias("items"))
    return items.join(second.select("p_partkey", F.col("found")[0]["text"].alias("second")), "p_partkey")


@query("SELECT p_partkey, p_size % 3 = 0 AS has_image, p_size % 2 = 0 AS has_video, TRUE AS has_text, p_size % 5 = 0 AS nested FROM part")
def node_predicates(spark, d):
    size = F.col("p_size")
    html = F.concat(F.lit("<body><p>t</p>"), F.when(size % 3 == 0, "<img data-src='/a.png'>").otherwise("<img alt='a'>"), F.when(size % 2 == 0, "<video></video>").otherwise("<br>"), F.when(size % 5 == 0, "<table><tr><td><table></table></td></tr></table>").otherwise("<table></table>"), F.lit("</body>"))
    nodes = P.dom_nodes(built(spark, d, "part", "p_partkey", html))
    has = lambda test: F.exists("nodes", test)
    image = lambda n: (n["tag"] == "img") & F.exists(X.literals(["src", "_src", "data-src", "data-original", "data-lazy-bgimg", "data-lazy-src"]), lambda k: F.coalesce(n["attrs"][k], F.lit("")) != "")
    nested = lambda n: (n["tag"] == "table") & F.exists("nodes", lambda m: (m["tag"] == "table") & (m["pid"] > n["pid"]) & (m["pid"] <= n["last_pid"]))
    return nodes.select("p_partkey", has(image).alias("has_image"), has(lambda n: n["tag"] == "video").alias("has_video"), has(lambda n: F.trim(n["text"]) != "").alias("has_text"), has(nested).alias("nested"))


@query("SELECT p_partkey, trim(p_name) || chr(10) || 'b' || p_size || chr(10) || 'tail' AS text FROM part")
def raw_text(spark, d):
    html = F.concat(F.lit("<body><p>"), F.col("p_name"), F.lit("</p><div class='h idden'>no</div><script>no</script><div style='DISPLAY : none'>no</div><p><b>b"), text("p_size"), F.lit("</b>tail</p></body>"))
    return P.page_text(built(spark, d, "part", "p_partkey", html)).select("p_partkey", F.replace("text", F.lit("\n\n"), F.lit("\n")).alias("text"))


def _image() -> Column:
    return F.concat(F.lit("<body><p>x</p><img src='"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("http://i/"), text("p_partkey"))).otherwise(F.concat(F.lit("/i/"), text("p_partkey"))), F.lit("' data-src='https://j/"), text("p_size"), F.lit("'></body>"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'http://i/' || p_partkey || ',' ELSE '' END || 'https://j/' || p_size AS images FROM part")
def images(spark, d):
    nodes = P.dom_nodes(built(spark, d, "part", "p_partkey", _image()))
    keys = X.literals(["src", "_src", "data-src", "data-original", "data-lazy-bgimg", "data-lazy-src"])
    links = F.flatten(F.transform(F.filter("nodes", lambda n: n["tag"] == "img"), lambda n: F.filter(F.transform(keys, lambda k: n["attrs"][k]), lambda v: F.startswith(v, F.lit("http")))))
    return nodes.select("p_partkey", F.array_join(links, ",").alias("images"))


@query("SELECT p_partkey, 'https://j/' || p_size AS link, '5' AS pid FROM part")
def images_with_pid(spark, d):
    html = F.concat(F.lit("<body><p>x</p><img data-src='https://j/"), text("p_size"), F.lit("'></body>"))
    rows = P.segment(built(spark, d, "part", "p_partkey", html)).select("p_partkey", F.explode("images").alias("link", "pid"))
    return rows.select("p_partkey", "link", "pid")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS author FROM customer")
def author(spark, d):
    key = F.when(F.col("c_custkey") % 3 == 0, "article:author").otherwise("author")
    meta = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("<meta "), F.when(F.col("c_custkey") % 2 == 0, "name").otherwise("property"), F.lit("='"), key, F.lit("' content='"), F.col("c_name"), F.lit("'>")))
    rows = P.metadata(built(spark, d, "customer", "c_custkey", F.concat(F.lit("<html><head>"), meta, F.lit("</head><body><p>t</p></body></html>"))))
    return rows.select("c_custkey", F.col("meta.author").alias("author"))


@query("SELECT c_custkey, 'U' || c_custkey AS uid, 'signed ' || c_nationkey AS description, 'http://img/' || c_custkey AS profile_url FROM customer")
def author_meta(spark, d):
    script = F.concat(F.lit("<script>var biz = \""), F.when(F.col("c_custkey") % 2 == 0, "x").otherwise(F.concat(F.lit("U"), text("c_custkey"))), F.lit('"; var profile_signature = " signed '), text("c_nationkey"), F.lit(' "; var hd_head_img = "http://img/'), text("c_custkey"), F.lit('";</script>'))
    meta = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<meta property='og:url' content='http://x/y?a=1&__biz=U"), text("c_custkey"), F.lit("'>"))).otherwise("")
    rows = P.metadata(built(spark, d, "customer", "c_custkey", F.concat(F.lit("<head>"), meta, script, F.lit("</head><body>t</body>"))))
    return rows.select("c_custkey", "meta.author_meta.uid", "meta.author_meta.description", "meta.author_meta.profile_url")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'h ' || p_name ELSE p_name END AS title FROM part")
def title(spark, d):
    k = F.col("p_partkey") % 3
    head = F.when(k == 0, F.concat(F.lit("<title>【"), F.col("p_name"), F.lit("】</title>"))).when(k == 1, F.concat(F.lit("<meta property='og:title' content='"), F.col("p_name"), F.lit("'>"))).otherwise("")
    rows = P.metadata(built(spark, d, "part", "p_partkey", F.concat(F.lit("<head>"), head, F.lit("</head><body><h2>h "), F.col("p_name"), F.lit("</h2></body>"))))
    return rows.select("p_partkey", F.col("meta.title").alias("title"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN strftime(t, '%Y-%m-%d') ELSE trim(regexp_replace(regexp_replace(strftime(t, '%Y-%m-%d %H:%M:%S'), ':00$', ''), '00:00$', '')) END AS pub_time FROM (SELECT o_orderkey, {_MOMENT} AS t FROM orders)")
def publish_time(spark, d):
    t = F.col("o_orderdate") + F.make_dt_interval(mins=F.col("o_orderkey") % 1440, secs=F.col("o_orderkey") % 60)
    k, full = F.col("o_orderkey") % 4, F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    head = F.when(k == 0, F.concat(F.lit("<meta property='article:published_time' content='"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00'>"))).when(k == 1, F.concat(F.lit("<script>var createTime = '"), full, F.lit("';</script>"))).when(k == 2, F.concat(F.lit("<meta itemprop='dateUpdate' content='1999-01-01'><meta itemprop='datePublished' content='"), full, F.lit("'>"))).otherwise("")
    body = F.when(k == 3, F.concat(F.lit("<p>on "), F.date_format(t, "yyyy/MM/dd"), F.lit("</p>"))).otherwise("<p>t</p>")
    rows = P.metadata(built(spark, d, "orders", "o_orderkey", F.concat(F.lit("<head>"), head, F.lit("</head><body>"), body, F.lit("</body>"))))
    return rows.select("o_orderkey", F.col("meta.publish_time").alias("pub_time"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'og ' || s_name ELSE '' END AS description,
  CASE WHEN s_suppkey % 2 = 0 THEN 'https://site.example/i/' || s_suppkey ELSE '' END AS surface_image,
  CASE s_suppkey % 3 WHEN 0 THEN 'https://site.example/f.ico' WHEN 1 THEN '' ELSE 'https://site.example/favicon.ico' END AS site_icon FROM supplier""")
def meta_fields(spark, d):
    k = F.col("s_suppkey") % 3
    about = F.when(k == 0, F.concat(F.lit("<meta name='og:description' content='no'><meta name='description' content='"), F.col("s_name"), F.lit("'>"))).when(k == 1, F.concat(F.lit("<meta property='og:description' content='og "), F.col("s_name"), F.lit("'>"))).otherwise("")
    image = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("<meta property='og:image' content='/i/"), text("s_suppkey"), F.lit("'>"))).otherwise("")
    icon = F.when(k == 0, "<link rel='Shortcut Icon' href='/f.ico'>").when(k == 1, "<link rel='x' href='/g'>").otherwise("")
    rows = P.metadata(built(spark, d, "supplier", "s_suppkey", F.concat(F.lit("<head>"), about, image, icon, F.lit("</head><body>t</body>"))))
    return rows.select("s_suppkey", "meta.description", "meta.surface_image", "meta.site_icon")


@query("SELECT s_suppkey, s_name AS name, 'last ' || s_suppkey AS twice FROM supplier")
def meta_map(spark, d):
    html = F.concat(F.lit("<head><meta name='a' content='"), F.col("s_name"), F.lit("'><meta property='b' content='first'><meta name='b' content='last "), text("s_suppkey"), F.lit("'><meta name='c'></head>"))
    nodes = P.dom_nodes(built(spark, d, "supplier", "s_suppkey", html))
    pairs = F.transform(F.filter("nodes", lambda n: n["tag"] == "meta"), lambda n: F.struct(F.coalesce(F.nullif(n["attrs"]["name"], F.lit("")), n["attrs"]["property"]).alias("k"), n["attrs"]["content"].alias("v")))
    full = F.filter(pairs, lambda p: (F.coalesce(p["k"], F.lit("")) != "") & (F.coalesce(p["v"], F.lit("")) != ""))
    last = lambda k: F.element_at(F.filter("pairs", lambda p: p["k"] == k), -1)["v"]
    return nodes.select("s_suppkey", full.alias("pairs")).select("s_suppkey", last("a").alias("name"), last("b").alias("twice"))


@query("SELECT s_suppkey, s_name AS by_text, '/k/' || s_suppkey AS by_attr, 'second' AS by_second FROM supplier")
def extract_xpath(spark, d):
    html = F.concat(F.lit("<body><a href='/k/"), text("s_suppkey"), F.lit("'> · "), F.col("s_name"), F.lit(" ·<i>x</i></a><p>second</p></body>"))
    rows = P.page_map(built(spark, d, "supplier", "s_suppkey", html), lambda r: (lambda p: {"by_text": p.by_xpath("//a/text()"), "by_attr": p.by_xpath("//a/@href"), "by_second": p.by_xpath("//u | //p")})(P._page(r)), "by_text string, by_attr string, by_second string", ("html", "url"))
    return rows


def _share() -> Column:
    return F.concat(F.lit("<body><div>"), F.repeat(F.lit("d"), (F.col("p_size") + 1).cast("int")), F.lit("</div><article><p>"), F.repeat(F.lit("a"), F.lit(30)), F.lit("</p></article></body>"))


@query("SELECT p_partkey, (30::FLOAT / (30 + p_size + 1 + 1)::FLOAT) > 0.6::FLOAT AS article_only FROM part")
def centroid_choice(spark, d):
    rows = P.cleaned(built(spark, d, "part", "p_partkey", _share()), ["centroid"])
    return rows.select("p_partkey", (~F.contains("text", F.lit("d"))).alias("article_only"))


@query("""SELECT p_partkey, p_size % 2 = 0 AS image, p_size % 3 = 0 AS link, p_size % 5 <> 0 AS ad, TRUE AS body, FALSE AS notice, FALSE AS void FROM part""")
def clean_passes(spark, d):
    size = F.col("p_size")
    html = F.concat(
        F.lit("<body><p>"), F.repeat(F.lit("body text "), F.lit(20)), F.lit("</p><p>点击上方</p>"),
        F.when(size % 2 == 0, "<img src='http://x/pic.png'>").otherwise("<img src='http://x/logo.png'>"),
        F.when(size % 3 == 0, "<a href='/z'>zz link</a>").otherwise("<a href='/z'>zz 关注</a>"),
        F.when(size % 5 == 0, "<div data-ad='1' id='x'>the ad</div>").otherwise("<div data-x='1' id='x'>the ad</div>"), F.lit("<link rel='x'><div><span></span></div></body>"),
    )
    rows = P.cleaned(built(spark, d, "part", "p_partkey", html), ["tiny_noise", "potential_noise", "noise_images", "noise_links", "meta_links", "empty_tags"])
    has = lambda t: F.contains("cleaned", F.lit(t))
    return rows.select("p_partkey", has("<img").alias("image"), has("zz").alias("link"), has("the ad").alias("ad"), has("body text").alias("body"), has("点击").alias("notice"), has("<span").alias("void"))


@query("SELECT s_suppkey, s_suppkey % 4 + 2 AS links, CASE WHEN (s_suppkey % 4 + 2) * 4 >= 0.7 * ((s_suppkey % 4 + 2) * 4 + s_suppkey % 12 + (s_suppkey % 4 + 2)) THEN TRUE ELSE FALSE END AS dense FROM supplier")
def link_density(spark, d):
    n = (F.col("s_suppkey") % 4 + 2).cast("int")
    html = F.concat(F.lit("<body><div>"), F.repeat(F.lit("<a href='/q'>link</a>"), n), F.repeat(F.lit("t"), (F.col("s_suppkey") % 12 + n).cast("int")), F.lit("</div></body>"))
    nodes = P.dom_nodes(built(spark, d, "supplier", "s_suppkey", html))
    links = F.filter("nodes", lambda x: x["tag"] == "a")
    own = F.aggregate(links, F.lit(0), lambda a, x: a + F.octet_length(x["text"]))
    all_ = F.aggregate("nodes", F.lit(0), lambda a, x: a + F.octet_length(x["text"]) + F.octet_length(x["tail"]))
    return nodes.select("s_suppkey", F.size(links).cast("bigint").alias("links"), (own >= 0.7 * all_).alias("dense"))


@query("SELECT s_suppkey, s_suppkey % 2 = 0 AS bundle_gone, TRUE AS text_kept FROM supplier")
def link_bundle(spark, d):
    nav = F.when(F.col("s_suppkey") % 2 == 0, "<ul><li><a href='/a'>one</a></li><li><a href='/b'>two</a></li><li><a href='/c'>three</a></li></ul>").otherwise("<p>one <a href='/a'>a</a> in a long line of words that is not made of links</p>")
    html = F.concat(F.lit("<body><div>"), nav, F.lit("</div><p>"), F.repeat(F.lit("plain text "), F.lit(30)), F.lit("</p></body>"))
    rows = P.cleaned(built(spark, d, "supplier", "s_suppkey", html), ["link_bundles"])
    return rows.select("s_suppkey", (~F.contains("text", F.lit("one"))).alias("bundle_gone"), F.contains("text", F.lit("plain")).alias("text_kept"))


def _table() -> Column:
    return F.concat(F.lit("<body><p>"), F.repeat(F.lit("x"), F.lit(20)), F.lit("</p><table><tr><td>"), F.repeat(F.lit("t"), (F.col("p_size") * 3 + 1).cast("int")), F.lit("</td></tr></table></body>"))


@query("SELECT p_partkey, CASE WHEN (p_size * 3 + 1)::FLOAT / (p_size * 3 + 1 + 20 + 1)::FLOAT >= 0.8::FLOAT THEN 0 ELSE 1 END AS tables FROM part")
def table_atoms(spark, d):
    rows = P.segment(built(spark, d, "part", "p_partkey", _table()))
    return rows.select("p_partkey", F.size(F.filter("sentences", lambda s: s["table_html"] != "")).alias("tables"))


@query("SELECT p_partkey, 'https://site.example/i/' || p_size || '.png' AS url, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS images FROM part")
def image_atoms(spark, d):
    one = F.concat(F.lit("<img data-src='/i/"), text("p_size"), F.lit(".png'>"))
    two = F.when(F.col("p_size") % 2 == 0, one).otherwise("<div style=\"background-image:url(/other.png)\">q</div>")
    rows = P.segment(built(spark, d, "part", "p_partkey", F.concat(F.lit("<body><p>text</p>"), one, two, F.lit("</body>"))))
    shown = F.filter("sentences", lambda s: s["url"] != "")
    return rows.select("p_partkey", shown[0]["url"].alias("url"), F.size(shown).alias("images"))


@query("SELECT p_partkey, p_size % 3 = 0 AS video FROM part")
def video_nodes(spark, d):
    k = F.col("p_size") % 3
    html = F.concat(F.lit("<body><p>text</p><div class='"), F.when(k == 0, "a video_iframe b").when(k == 1, "embed-container x").otherwise("c"), F.lit("'>inside</div></body>"))
    rows = P.segment(built(spark, d, "part", "p_partkey", html))
    return rows.select("p_partkey", (~F.exists("sentences", lambda s: F.contains(s["text"], F.lit("inside")))).alias("video"))


def _runs_of_text() -> Column:
    """Paragraphs of text, bold text and a tail."""
    n = (F.col("p_size") % 4 + 1).cast("int")
    return F.concat(F.lit("<body><div>"), F.repeat(F.concat(F.lit("<p>"), F.col("p_brand"), F.lit("<b>bold</b>tail</p>")), n), F.lit("</div><h2>end</h2></body>"))


def _atoms(spark, d) -> DataFrame:
    rows = P.page_map(built(spark, d, "part", "p_partkey", _runs_of_text()), lambda r: {"atoms": P._page(r).atoms()}, f"atoms array<{P.ATOM}>", ("html",))
    return rows.select("p_partkey", F.posexplode("atoms").alias("place", "a")).select("p_partkey", "place", "a.*")


#: The atoms of these pages, counted from 0: three a paragraph, then the heading.
_ATOMS = "(SELECT p_partkey, p_brand, n, unnest(generate_series(0, 3 * n)) AS place FROM (SELECT p_partkey, p_brand, p_size % 4 + 1 AS n FROM part))"
_PATH = "CASE WHEN place = 3 * n THEN '/html/body/h2' ELSE '/html/body/div/p' || CASE WHEN n > 1 THEN '[' || (place // 3 + 1) || ']' ELSE '' END || CASE WHEN place % 3 = 0 THEN '' ELSE '/b' END END"


@query(f"""SELECT p_partkey, place::INT AS place, CASE WHEN place = 3 * n THEN 'end' WHEN place % 3 = 0 THEN p_brand WHEN place % 3 = 1 THEN 'bold' ELSE 'tail' END AS text, {_PATH} AS xpath, place < 3 * n AND place % 3 = 2 AS tail, (place // 3 + 1)::INT AS segment_id FROM {_ATOMS}""")
def atoms(spark, d):
    return _atoms(spark, d).select("p_partkey", "place", "text", "xpath", "tail", "segment_id")


@query(f"SELECT p_partkey, place::INT AS place, (place // 3 + 1)::BIGINT AS run FROM {_ATOMS}")
def paragraphs(spark, d):
    """Atoms in runs of one paragraph element."""
    rows = _atoms(spark, d).withColumn("paragraph", X.pdepth(F.col("xpath")))
    return W.runs(rows, ["p_partkey"], ["place"], ["paragraph"]).select("p_partkey", "place", "run")


@query(f"SELECT p_partkey, place::INT AS place, (place + 1)::BIGINT AS run FROM {_ATOMS}")
def atom_windows(spark, d):
    """Atoms in runs of one element and side of it: here each is alone."""
    return W.runs(_atoms(spark, d), ["p_partkey"], ["place"], ["xpath", "tail"]).select("p_partkey", "place", "run")


@query("SELECT s_suppkey, '0-1 3-' || (3 + s_suppkey % 3) || ' ' || (s_suppkey % 3 + 5) || '-' || (s_suppkey % 3 + 5) AS windows FROM supplier")
def label_windows(spark, d):
    """Runs of sentences under one label that makes a subtree."""

    def run(row):
        from leafpress.operators.page import label_windows, sentence

        labels = ["abstract"] * 2 + ["content"] + ["introduction"] * (row["s_suppkey"] % 3 + 1) + ["O", "abstract"]
        sents = [sentence([]) | {"label": x, "segment_id": i, "at": i} for i, x in enumerate(labels)]
        return {"windows": " ".join(f"{w[0]['at']}-{w[-1]['at']}" for w in label_windows(sents))}

    return P.page_map(table(spark, d, "supplier").select("s_suppkey"), run, "windows string")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k = 1 OR before IS DISTINCT FROM event_type")
def dedup_adjacent(spark, d):
    return W.drop_adjacent(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY first) AS segment_id FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_suppkey % 3) AS first FROM lineitem)")
def segment_ids(spark, d):
    path = F.concat(F.lit("/html/body/div["), (F.col("l_suppkey") % 3 + 1).cast("string"), F.lit("]/span"))
    return W.segment_ids(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", X.pdepth(path)).select("l_orderkey", "l_linenumber", "segment_id")


@query("SELECT o_orderkey, l_linenumber FROM (SELECT o_orderkey, 10 * (o_orderkey % 7) + 3 AS place FROM orders) JOIN (SELECT l_orderkey, l_linenumber, 10 * (l_linenumber - 1) AS a, 10 * l_linenumber - 1 AS b FROM lineitem) ON o_orderkey = l_orderkey AND place BETWEEN a AND b")
def interval_lookup(spark, d):
    points = table(spark, d, "orders").select("o_orderkey", (10 * (F.col("o_orderkey") % 7) + 3).alias("at"))
    spans = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (10 * (F.col("l_linenumber") - 1)).alias("a"), (10 * F.col("l_linenumber") - 1).alias("b"))
    return W.interval_lookup(points, spans, ["o_orderkey"], "at", "a", "b").select("o_orderkey", "l_linenumber")


@query()
def sentences_stop_sign(spark, d):
    """Sentences of whole texts by the sentence operator, blank ones left out."""

    def run(row):
        from leafpress.operators.sentences import cut

        text = row["text"] or ""
        return {"cut": sum(1 for a, b in cut(text) if text[a:b].strip())}

    return P.page_map(table(spark, d, "documents").select("doc_id", "text"), run, "cut bigint", ("text",))


@query("""SELECT p_partkey, array_to_string(list_transform(generate_series(0, p_size % 5), lambda i: 'Part ' || i || ' of it' || (['.', '!', '?'])[(i % 3 + 1)::INT]), '|') || '|' || array_to_string(list_transform(generate_series(0, p_size % 4), lambda i: '第' || i || '句。'), '|') AS cut FROM part""")
def sentence_cut(spark, d):
    """Sentences between stops of two scripts."""
    some = lambda n, f: F.transform(F.sequence(F.lit(0), (F.col("p_size") % n).cast("int")), f)
    english = some(5, lambda i: F.concat(F.lit("Part "), i.cast("string"), F.lit(" of it"), F.element_at(X.literals([".", "!", "?"]), i % 3 + 1)))
    chinese = some(4, lambda i: F.concat(F.lit("第"), i.cast("string"), F.lit("句。")))

    def run(row):
        from leafpress.operators.sentences import cut

        return {"cut": "|".join(row["text"][a:b].strip() for a, b in cut(row["text"]))}

    rows = table(spark, d, "part").select("p_partkey", F.concat(F.array_join(english, " "), F.lit(" "), F.array_join(chinese, "")).alias("text"))
    return P.page_map(rows, run, "cut string", ("text",))


@query()
def sentences_full(spark, d):
    def run(row):
        from leafpress.operators.sentences import cut

        return {"sentences": [row["html"][a:b] for a, b in cut(row["html"])]}

    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("html"))
    return P.page_map(rows, run, "sentences array<string>", ("html",)).select("doc_id", F.posexplode("sentences").alias("at", "sentence"))


def _labelled(spark, d) -> DataFrame:
    pages = built(spark, d, "supplier", "s_suppkey", F.concat(F.lit("<body><p>"), F.repeat(F.lit("body words "), F.lit(20)), F.lit("</p><h3>Head</h3><p>noise "), F.col("s_name"), F.lit("</p><p>from somewhere</p></body>")))
    give = lambda s: F.when(F.contains(s["text"], F.lit("noise")), "O").when(F.contains(s["text"], F.lit("Head")), "title1").when(F.contains(s["text"], F.lit("from")), "source").otherwise("content")
    return P.label(P.segment(pages), give)


@query("SELECT s_suppkey, FALSE AS noise, TRUE AS body, TRUE AS heading, 1 AS worth_type FROM supplier")
def label_rules(spark, d):
    out = P.distill(_labelled(spark, d))
    has = lambda t: F.contains("readable_html", F.lit(t))
    return out.select("s_suppkey", has("noise").alias("noise"), has("body words").alias("body"), has('data-leaf-h1="1"').alias("heading"), "worth_type")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'from ' || s_name ELSE '' END AS content_source FROM supplier")
def content_source(spark, d):
    """The text of the first sentence that is labelled as the source, if there is one."""
    html = F.concat(F.lit("<body><p>body words</p>"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("<p>from "), F.col("s_name"), F.lit("</p><p>from a later one</p>"))).otherwise("<p>none</p>"), F.lit("</body>"))
    give = lambda s: F.when(s["text"].startswith("from"), "source").otherwise("content")
    out = P.recover_meta(P.label(P.segment(built(spark, d, "supplier", "s_suppkey", html)), give))
    return out.select("s_suppkey", "meta.content_source")


@query("SELECT s_suppkey, 'Head' AS title, 'A' || s_suppkey AS author, 'from somewhere' AS content_source FROM supplier")
def recover_meta(spark, d):
    rows = _labelled(spark, d).withColumn("model", F.struct(F.concat(F.lit("T"), text("s_suppkey")).alias("title"), F.concat(F.lit("A"), text("s_suppkey")).alias("author"), F.lit(None).cast("string").alias("publish_time"), F.lit("").alias("content_source")))
    return P.recover_meta(rows, "model").select("s_suppkey", "meta.title", "meta.author", "meta.content_source")


@query("""SELECT s_suppkey, '{"url":"https://site.example/a/b.html","infos":[{"position":0,"text":"Head","segment_id":0,"tags":[],"label":"O"},{"position":1,"text":"noise ' || s_name || '","segment_id":1,"tags":[],"label":"O"}]}' AS request FROM supplier""")
def label_request(spark, d):
    html = F.concat(F.lit("<title>Head</title><p>noise "), F.col("s_name"), F.lit("</p>"))
    return P.label_request(P.segment(built(spark, d, "supplier", "s_suppkey", html))).select("s_suppkey", "request")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'label service: no answer' WHEN s_suppkey % 5 = 1 THEN 'label service: bad request' WHEN s_suppkey % 5 = 2 THEN 'label service: code 77' END AS error,
  CASE WHEN s_suppkey % 5 < 3 THEN ',' WHEN s_suppkey % 5 = 3 THEN 'article_title,content' ELSE 'article_title,O' END AS labels FROM supplier""")
def label_service(spark, d):
    """Answers of a labelling service: codes, labels, and labels that are missing."""
    html = F.concat(F.lit("<title>Head</title><p>"), F.col("s_name"), F.lit("</p>"))
    rows = P.segment(built(spark, d, "supplier", "s_suppkey", html, F.concat(F.lit("https://x.y/"), text("s_suppkey"))))

    def ask(requests):
        out = []
        for r in requests:
            k = int(r.split('"url":"https://x.y/')[1].split('"')[0]) % 5
            out.append([(1001, None), (1001, None), (77, None), (0, ["article_title", "content"]), (0, ["article_title"])][k])
        return out

    answers = P.call_labeller(P.label_request(rows.filter("s_suppkey % 5 <> 0")), ask)
    done = P.apply_labels(rows, answers)
    return done.select("s_suppkey", "error", F.array_join(F.transform("sentences", lambda s: s["label"]), ",").alias("labels"))


@query("SELECT p_partkey, (p_size % 6 + 2)::BIGINT AS sentences, 'content' AS label FROM part")
def label_mock(spark, d):
    """Without a labeller every sentence is content."""
    html = F.concat(F.lit("<title>Head</title><p>"), F.repeat(F.lit("One more. "), (F.col("p_size") % 6 + 1).cast("int")), F.lit("</p>"))
    rows = P.label(P.segment(built(spark, d, "part", "p_partkey", html))).select("p_partkey", F.explode("sentences").alias("s"))
    return rows.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("sentences"), F.array_join(F.collect_set("s.label"), ",").alias("label"))


@query("""SELECT p_partkey, array_to_string(list_transform(l, lambda x: 'h' || (len(list_distinct(list_filter(l, lambda y: y < x))) + 1)), ' ') AS tags
FROM (SELECT p_partkey, [p_size % 6 + 1, p_partkey % 3 + 2, 6, p_size % 2 + 1] AS l FROM part)""")
def heading_tier(spark, d):
    """Heading levels of a page, numbered without gaps."""
    levels = [F.col("p_size") % 6 + 1, F.col("p_partkey") % 3 + 2, F.lit(6), F.col("p_size") % 2 + 1]
    heads = [F.concat(F.lit("<h"), n.cast("string"), F.lit(">t</h"), n.cast("string"), F.lit(">")) for n in levels]
    rows = P.cleaned(built(spark, d, "part", "p_partkey", F.concat(F.lit("<body>"), *heads, F.lit("</body>"))), ["tier_headings"])
    return rows.select("p_partkey", F.array_join(F.regexp_extract_all("cleaned", F.lit("<(h[1-6]) "), F.lit(1)), " ").alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'rgb; display: contents;' ELSE 'rgb' END AS style, p_size % 2 = 0 AS own_style, 1 AS saved FROM part")
def style_nodes(spark, d):
    """Items of marked introductions, a site's own style, and saved styles in the head."""
    mark = F.when(F.col("p_size") % 3 == 0, "<div data-leaf-intro='1'>").otherwise("<div>")
    html = F.concat(F.lit("<style>p{}</style><body>"), mark, F.lit("<ul><li><i style='rgb'>x</i></li></ul></div></body>"))
    url = F.when(F.col("p_size") % 2 == 0, "https://web.okjike.com/a").otherwise("https://site.example/")
    rows = P.cleaned(built(spark, d, "part", "p_partkey", html, url), ["styles", "restore"])
    return rows.select("p_partkey", F.regexp_extract("cleaned", '<i style="([^"]*)"', 1).alias("style"), F.contains("cleaned", F.lit("line-height")).alias("own_style"), F.regexp_count("cleaned", F.lit(r"p\{\}")).alias("saved"))


@query("SELECT p_partkey, CASE WHEN length(p_name) >= 0.7 * (length(p_name) + p_size % 20 + 1) THEN p_name ELSE p_name || ' ' || repeat('z', (p_size % 20)::INT) END AS title FROM part WHERE p_size % 20 > 0")
def title_headings(spark, d):
    """The part of the title that a heading repeats, if it is most of the title."""
    html = F.concat(F.lit("<title>"), F.col("p_name"), F.lit(" "), F.repeat(F.lit("z"), (F.col("p_size") % 20).cast("int")), F.lit("</title><h3>"), F.col("p_name"), F.lit("</h3>"))
    rows = P.page_map(built(spark, d, "part", "p_partkey", html).filter("p_partkey is not null"), lambda r: {"title": P._page(r).title_by_headings()}, "title string", ("html", "url"))
    return rows.join(table(spark, d, "part").filter("p_size % 20 > 0").select("p_partkey"), "p_partkey").select("p_partkey", F.trim("title").alias("title"))


@query("SELECT p_partkey, (p_size % 4) AS videos FROM part")
def beyond_canvas(spark, d):
    """Videos before the first and after the last labelled sentence go; those between stay."""
    n = (F.col("p_size") % 4).cast("int")
    video = F.lit("<div><video src='v'></video></div>")
    html = F.concat(F.lit("<body>"), video, F.lit("<p>noise one</p><p>first text</p>"), F.repeat(video, n), F.lit("<p>last text</p><p>noise two</p>"), video, F.lit("</body>"))
    give = lambda s: F.when(F.contains(s["text"], F.lit("noise")), "O").otherwise("content")
    rows = P.distill(P.label(P.segment(built(spark, d, "part", "p_partkey", html)), give))
    return rows.select("p_partkey", F.regexp_count("readable_html", F.lit("<video")).cast("bigint").alias("videos"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'div' ELSE 'span' END AS holder FROM supplier")
def subtree_wrap(spark, d):
    """An introduction's sentences: the element that holds nearly nothing else is marked; else they get one of their own."""
    rest = F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.repeat(F.lit("other text "), F.lit(30)))
    html = F.concat(F.lit("<body><div><p>Intro one words. </p><p>Intro two words.</p><p>"), rest, F.lit("</p></div><p>"), F.repeat(F.lit("body "), F.lit(60)), F.lit("</p></body>"))
    give = lambda s: F.when(F.contains(s["text"], F.lit("Intro")), "introduction").otherwise("content")
    rows = P.distill(P.label(P.segment(built(spark, d, "supplier", "s_suppkey", html)), give))
    return rows.select("s_suppkey", F.regexp_extract("readable_html", r'<(\w+)[^>]* data-leaf-intro="1"', 1).alias("holder"))


@query("SELECT p_partkey, 'div height=\"' || p_size || '\"' AS div, 'img data-src=\"https://site.example/i/' || p_size || '\"' AS img FROM part")
def div_image_rules(spark, d):
    """What formatting leaves of a box's and an image's attributes."""
    html = F.concat(F.lit("<body><div class='c' height='"), text("p_size"), F.lit("' onclick='o'><p>t</p><img class='k' data-src='/i/"), text("p_size"), F.lit("' alt='a'></div></body>"))
    rows = P.cleaned(built(spark, d, "part", "p_partkey", html), ["format_nodes"])
    bare = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("cleaned", f"<({tag}[^>]*?) ?/?>", 1), ' position_id="[0-9]+"', ""))
    return rows.select("p_partkey", bare("div").alias("div"), bare("img").alias("img"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def cache_back(spark, d):
    """Pages that go back to the cache: fetched now, with content, and wanted there."""
    from leafpress.sources import store

    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 2 == 0).alias("fetched"), (F.col("s_suppkey") % 3 == 0).alias("worthless"), (F.col("s_suppkey") % 5 != 0).alias("save_crawl_html"))
    return store.back_to_cache(rows).select("s_suppkey")


#: Text, title and verdict of the raw pages, told by their markup: the article's text without white space.
_PLAIN = r"""(SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[\s\p{Z}]', '', 'g') AS bare, trim(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS whole_title FROM pages)"""
_PLAIN = f"""(SELECT *, trim(CASE WHEN strlen(front)::FLOAT / strlen(whole_title)::FLOAT > 0.7::FLOAT THEN front ELSE whole_title END) AS title
FROM (SELECT *, array_to_string(list_slice(string_split_regex(whole_title, '{fixed.TITLE_SPLIT}'), 1, -2), '') AS front FROM {_PLAIN}))"""


def _ruled(spark, d) -> DataFrame:
    """The raw pages under a site rule that names the article as their body, however short it is."""
    rule = {"bodies": F.array(F.lit("//article")), "title": F.lit(""), "author": F.lit(""), "pub_time": F.lit(""), "need_browser_crawl": F.lit(False), "body_use_rule_only": F.lit(False), "no_semantic_denoise": F.lit(False)}
    none = F.array().cast("array<string>")
    rule = F.struct(*(v.alias(k) for k, v in rule.items()), none.alias("noises"), none.alias("reserved_nodes"))
    return table(spark, d, "pages").select("page_id", "url", "html", rule.alias("rule"))


@query("SELECT p_partkey, 'https://site.example/i/' || p_size || '.png' AS image FROM part WHERE p_size % 2 = 0")
def surviving_images(spark, d):
    one = F.concat(F.lit("<body><p>"), F.repeat(F.lit("w "), F.lit(80)), F.lit("</p><img src='/i/"), text("p_size"), F.lit(".png'></body>"))
    pages = built(spark, d, "part", "p_partkey", one, F.concat(F.lit("https://site.example/"), text("p_partkey")))
    give = lambda s: F.when((s["url"] != "") & F.rlike(s["url"], F.lit(r"[13579]\.png$")), "O").otherwise("content")
    labelled = P.label(P.segment(pages), give)
    left = P.surviving_images(labelled, P.distill(labelled))
    return left.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("p_partkey"), "image")


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\p{Z}]", "")


@query(f"SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, title, bare FROM {_PLAIN}")
def segment_page(spark, d):
    """Host, title and all sentences of the raw pages."""
    rows = P.segment(_ruled(spark, d))
    body = F.array_join(F.transform(F.filter("sentences", lambda s: s["segment_id"] > 0), lambda s: s["text"]), "")
    return rows.select("page_id", "url", F.regexp_extract("meta.site_icon", r"^https://(.*)/favicon\.ico$", 1).alias("host"), "meta.title", _bare(body).alias("bare"))


@query("""SELECT s_suppkey, '<body position_id="7"><head><meta name="description" content="About ' || s_suppkey || '" /><meta property="og:image" content="" /><link rel="icon" href="https://site.example/favicon.ico" /><meta name="publish_time" content="2024-05-06" /><meta name="author" content="' || s_name || '" /><title>T' || s_suppkey || '</title></head>'
  || '<p position_id="8"><leaf-pos-group position_id="9"><leaf-pos position_id="10">Body ' || s_nationkey || '.</leaf-pos></leaf-pos-group></p></body>' AS readable FROM supplier""")
def reader_html(spark, d):
    """The whole reader page of a simple page."""
    html = F.concat(F.lit("<head><title>T"), text("s_suppkey"), F.lit("</title><meta name='author' content='"), F.col("s_name"), F.lit("'><meta name='description' content='About "), text("s_suppkey"), F.lit("'><meta itemprop='datePublished' content='2024-05-06'></head><body><nav>n</nav><p>Body "), text("s_nationkey"), F.lit(".</p></body>"))
    return P.parse(built(spark, d, "supplier", "s_suppkey", html)).select("s_suppkey", F.col("readable_html").alias("readable"))


@query(f"SELECT page_id, bare, 0 AS images, CASE WHEN length(bare) > 300 THEN 1 END AS worth_type FROM {_PLAIN}")
def distill_page(spark, d):
    """Text and images of the raw pages, and the verdict on those that are long enough by far."""
    rows = P.distill(P.label(P.segment(_ruled(spark, d))))
    bare = _bare(F.col("text"))
    return rows.select("page_id", bare.alias("bare"), F.size("images").alias("images"), F.when(F.length(bare) > 300, F.col("worth_type")).alias("worth_type"))


@query(f"""SELECT page_id, url, 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/favicon.ico' AS site_icon, title, bare, '' AS author, '' AS description, '' AS surface_image, 'none' AS error FROM {_PLAIN}""")
def parse_page(spark, d):
    rows = P.parse(_ruled(spark, d))
    return rows.select("page_id", "url", "site_icon", "title", _bare(F.col("text")).alias("bare"), "author", "description", "surface_image", F.coalesce("error", F.lit("none")).alias("error"))


@query("SELECT page_id, page_id % 3 = 0 OR page_id % 3 = 1 AND page_id % 2 = 0 AS need_browser FROM pages")
def need_browser(spark, d):
    k = F.col("page_id") % 3
    flag = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("bodies", "array<string>"), ("noises", "array<string>"), ("title", "string"), ("author", "string"), ("pub_time", "string"), ("reserved_nodes", "array<string>"), ("no_semantic_denoise", "boolean"))), (k == 0).alias("need_browser_crawl"), F.lit(False).alias("body_use_rule_only"))
    html = F.concat(F.lit("<body><p id='js_text_desc'>"), F.when(F.col("page_id") % 2 == 0, "a b c").otherwise("long enough text"), F.lit("</p></body>"))
    url = F.when(k == 1, "https://mp.weixin.qq.com/s").otherwise("https://other.example/")
    rows = table(spark, d, "pages").select("page_id", url.alias("url"), html.alias("html"), flag.alias("rule"))
    return P.need_browser(rows).select("page_id", "need_browser")


@query("SELECT s_suppkey, s_suppkey % 2 = 0 AS in_body, FALSE AS noise, 'By ' || s_name AS author FROM supplier")
def site_rule_clean(spark, d):
    rule = F.struct(F.when(F.col("s_suppkey") % 2 == 1, F.array(F.lit("//div[@class='main']"))).otherwise(F.array().cast("array<string>")).alias("bodies"), F.array(F.lit("//p[contains(@class,'bad')]")).alias("noises"), F.lit("").alias("title"), F.lit("//u | //i/text()").alias("author"), F.lit("empty").alias("pub_time"), F.array().cast("array<string>").alias("reserved_nodes"), F.lit(False).alias("no_semantic_denoise"), F.lit(False).alias("need_browser_crawl"), F.lit(False).alias("body_use_rule_only"))
    html = F.concat(F.lit("<body><p>outer</p><i>By "), F.col("s_name"), F.lit("</i><div class='main'><p>inner</p><p class='so bad'>noise</p></div></body>"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.lit("https://x.y/").alias("url"), html.alias("html"), rule.alias("rule"))
    body = P.cleaned(rows, ["by_rule"]).select("s_suppkey", F.contains("text", F.lit("outer")).alias("in_body"), F.contains("text", F.lit("noise")).alias("noise"))
    return body.join(P.metadata(rows).select("s_suppkey", "meta.author"), "s_suppkey")
