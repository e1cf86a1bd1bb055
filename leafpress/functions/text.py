"""Native column functions over text, links, styles, xpaths and times."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafpress.functions import fixed
from leafpress.functions.common import common_bytes

_SPACE = r"\s\p{Z}\u0085"


def text_trim(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, rf"^[{_SPACE}]+|[{_SPACE}]+\z", "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def unescape_html(c: Column) -> Column:
    """The light unescape: ``&amp;``, ``&nbsp;`` and the ``ne-`` tag prefix only."""
    c = F.replace(F.replace(c, F.lit("&amp;"), F.lit("&")), F.lit("&nbsp;"), F.lit(" "))
    return F.replace(F.replace(c, F.lit("<ne-"), F.lit("<")), F.lit("</ne-"), F.lit("</"))


def textarea_to_div(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)<textarea\b([^>]*)>", "<div$1>")
    return F.regexp_replace(c, r"(?i)</textarea>", "</div>")


def clean_text(c: Column) -> Column:
    for pattern, into in fixed.CLEAN_CHAIN:
        c = F.regexp_replace(c, pattern, into) if len(pattern) > 1 else F.replace(c, F.lit(pattern), F.lit(into))
    return text_trim(c)


def remove_space(c: Column) -> Column:
    return F.regexp_replace(c, r"[\t\n\f\r \p{Zs}]+", "")


@F.pandas_udf(T.StringType())
def _resolve(link: pd.Series, url: pd.Series) -> pd.Series:
    def one(a: str | None, b: str | None) -> str | None:
        try:
            return a if a is None or b is None else urljoin(b, a)
        except ValueError:
            return a

    return pd.Series([one(a, b) for a, b in zip(link, url)], dtype=object)


def abs_link(link: Column, url: Column, resolve: bool = True) -> Column:
    """Absolute form of a link on a page; ``resolve`` adds the general relative case,
    which alone leaves the JVM."""
    host = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    out = F.when(link.startswith("http"), link).when(link.startswith("//"), F.concat(F.lit("http:"), link)).when(link.startswith("://"), F.concat(F.lit("http"), link))
    plain = link.startswith("/") & ~F.rlike(link, F.lit(r"/\.|[ \\]")) & (host != "")
    return out.when(plain, F.concat(host, link)).otherwise(_resolve(link, url) if resolve else link)


def pdepth(xpath: Column) -> Column:
    """The xpath up to its deepest paragraph element."""
    tags = "|".join(fixed.PARAGRAPH_TAGS)
    return F.regexp_replace(xpath, rf"(.*/({tags})(\[\d+\])?)(/.*)?\z", "$1")


def xpath_split(xpath: Column) -> Column:
    return F.transform(F.split(xpath, "/"), lambda x: F.regexp_replace(x, r"\[\d+\]", ""))


def xpath_tags(xpath: Column) -> Column:
    """Sorted distinct layout tags on the way to a node."""
    gold = F.create_map(*(F.lit(x) for kv in fixed.GOLD_TAGS.items() for x in kv))
    names = F.split(F.regexp_replace(xpath, r"\[\d*\]", ""), "/")
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda x: F.try_element_at(gold, x)), lambda x: x.isNotNull())))


def style_map(style: Column) -> Column:
    """Properties of a style text; parts that are not ``name:value`` are dropped, the last of a name wins."""
    parts = F.transform(F.split(style, ";"), lambda s: F.split(s, ":"))
    pairs = F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.struct(text_trim(p[0]).alias("key"), text_trim(p[1]).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def style_text(properties: Column) -> Column:
    """A style text with sorted properties."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ";")


def is_white(color: Column) -> Column:
    bare = F.replace(color, F.lit(" "), F.lit(""))
    return F.coalesce(color.isin(fixed.WHITE) | bare.isin("rgb(255,255,255)", "rgba(255,255,255,1)"), F.lit(False))


def _dim(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r.cast("double") + 0.587 * g.cast("double") + 0.114 * b.cast("double") < 128


def is_dark(color: Column) -> Column:
    """Dark by name, or by perceived brightness of rgb or hex values."""
    named = F.contains(F.lower(color), F.lit("black")) | F.contains(F.lower(color), F.lit("dark"))
    digits = F.regexp_extract_all(color, F.lit(r"\d+"), F.lit(0))
    rgb = F.rlike(color, F.lit(r"rgba?\(\d+,\s*\d+,\s*\d+\)")) & _dim(digits[0], digits[1], digits[2])
    hexa = F.regexp_replace(color, "^#", "")
    hexa = F.when(F.length(hexa) == 3, F.regexp_replace(hexa, "(.)(.)(.)", "$1$1$2$2$3$3")).otherwise(hexa)
    part = lambda i: F.conv(F.substring(hexa, i, 2), 16, 10)
    by_hex = F.rlike(color, F.lit("#([0-9a-fA-F]{3}){1,2}")) & F.rlike(hexa, F.lit(r"^[0-9a-fA-F]{6}\z")) & _dim(part(1), part(3), part(5))
    return F.coalesce(named | rgb | by_hex, F.lit(False))


def color_class(color: Column) -> Column:
    return F.when(is_white(color), "white").when(is_dark(color), "dark").otherwise("other")


def url_host(url: Column) -> Column:
    """Host as written between the slashes; empty for other schemes."""
    return F.regexp_extract(url, r"^https?://([^/]*)", 1)


def bare_url(url: Column) -> Column:
    """The url without schemes and ``www.`` in front, as often as they come."""
    return F.regexp_replace(url, r"^(https?://|www\.)+", "")


def url_is_pdf(url: Column, downloads: tuple[str, ...] = ()) -> Column:
    """A url that ends in ``.pdf`` as written, a preprint server's, or one that matches a download pattern."""
    out = url.endswith(".pdf") | F.contains(url, F.lit("arxiv.org/pdf"))
    for pattern in downloads:
        out = out | F.rlike(url, F.lit(pattern))
    return out


def url_is_own_pdf(url: Column, stores: tuple[str, ...], downloads: tuple[str, ...]) -> Column:
    """A url of one's own file stores (parts of a url) or download services (patterns)."""
    out = F.lit(False)
    for part in stores:
        out = out | F.contains(url, F.lit(part))
    for pattern in downloads:
        out = out | F.rlike(url, F.lit(pattern))
    return out


def is_stored_image(url: Column, store: str) -> Column:
    """An image that lies in one's own store already."""
    return F.coalesce(F.contains(url, F.lit(store)), F.lit(False))


@F.pandas_udf(T.StringType())
def short_hash(value: pd.Series, key: pd.Series) -> pd.Series:
    """First 8 hex digits of BLAKE2b-256 keyed by a version."""
    return pd.Series([None if v is None else hashlib.blake2b(v.encode(), key=(k or "").encode()[:64], digest_size=32).hexdigest()[:8] for v, k in zip(value, key)], dtype=object)


@F.pandas_udf(T.StringType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common substring (of bytes, the first of equals)."""

    return pd.Series([None if x is None or y is None else common_bytes(x.encode(), y.encode()).decode("utf-8", "ignore") for x, y in zip(a, b)], dtype=object)


def common_in_full(full: Column, part: Column) -> Column:
    """The longest common text of two cleaned texts, read off the first as it was before cleaning."""
    bare = clean_text(full)

    def read(common: Column) -> Column:
        at = F.greatest(F.instr(bare, common), F.lit(1))
        return F.when(common == "", F.lit("")).otherwise(F.substring(full, at, F.char_length(common)))

    return let(longest_common(bare, clean_text(part)), read)


def replace_links(c: Column, links: Column) -> Column:
    """Replace a map's keys by its values in one pass, longer keys first; an empty value leaves its key."""
    quoted = lambda k: F.concat(F.lit("\\Q"), F.replace(k, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    keys = F.filter(F.map_keys(links), lambda k: k != "")
    order = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))

    def replaced(pattern: Column) -> Column:
        between, found = F.split(c, pattern, -1), F.regexp_extract_all(c, pattern, F.lit(0))
        new = F.transform(found, lambda m: F.coalesce(F.nullif(F.try_element_at(links, m), F.lit("")), m))
        return F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    pattern = F.array_join(F.transform(order, lambda e: quoted(e["k"])), "|")
    return F.when(F.size(keys) <= 0, c).when(c == "", c).otherwise(let(pattern, replaced))


def trim_left_common(c: Column, cut: Column) -> Column:
    """``c`` without the characters in front that it shares with ``cut``."""
    points = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    same = F.zip_with(points(c), points(F.substring(cut, F.lit(1), F.length(c))), lambda a, b: a.eqNullSafe(b))
    return let(F.array_position(same, False), lambda at: F.when(at == 0, F.lit("")).otherwise(F.substring(c, at.cast("int"), F.length(c))))


def has_prefix(c: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: F.startswith(c, p))


def title_denoise(title: Column) -> Column:
    """Title without outer bracket pairs, and without its last part if most of it stays."""

    def strip(t: Column, _: Column) -> Column:
        out = t
        for left, right in reversed(fixed.TITLE_PAIRS):
            inner = F.substring(t, F.lit(2), F.length(t) - 2)
            out = F.when(t.startswith(left) & t.endswith(right) & (F.length(t) > 1), inner).otherwise(out)
        return out

    pairs = F.length(F.regexp_extract(title, r"^[【\[「（(]+", 0))
    bare = F.when(pairs > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(pairs, F.lit(1))), title, strip)).otherwise(title)

    def cut(t: Column) -> Column:
        parts = F.split(t, fixed.TITLE_SPLIT, -1)
        front = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "")
        ratio = F.try_divide(F.octet_length(front), F.octet_length(t)).cast("float")
        return F.when(ratio > F.lit(fixed.TITLE_RATIO).cast("float"), front).otherwise(t)

    return let(bare, cut)


def first_line(c: Column) -> Column:
    """First line that is not blank; a literal ``\\n`` is a line break."""
    lines = F.transform(F.split(F.replace(c, F.lit("\\n"), F.lit("\n")), "\n"), text_trim)
    return F.coalesce(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1)), c)


_FIELDS = {"yyyy": r"\d{4}", "yy": r"\d\d", "MMMM": "[A-Z][a-z]{2,8}", "MMM": "[A-Z][a-z]{2}", "MM": r"\d\d", "M": r"\d{1,2}", "dd": r"\d\d", "d": r"\d{1,2}", "HH": r"\d\d", "H": r"\d{1,2}", "hh": r"\d\d", "h": r"\d{1,2}", "mm": r"\d\d", "ss": r"\d\d", "a": "[AP]M"}


def _shape(layout: str) -> str:
    """A pattern of the texts that can be in a layout."""
    out = ""
    for m in re.finditer(r"''|'[^']*'|([a-zA-Z])\1*|.", layout):
        part = m[0]
        out += "'" if part == "''" else re.escape(part[1:-1]) if part[0] == "'" else _FIELDS.get(part) or re.escape(part)
    return rf"^{out}\z"


def _parsed(c: Column) -> Column:
    """Normal form of a text in one of the layouts, or null."""
    c = F.regexp_replace(c, r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +", "")
    c = F.regexp_replace(c, r"(?<=[0-9])Z\z|(?<=:\d\d) ?[+-]\d\d:?\d\d\z| [+-]\d{4}\z| [A-Z]{3,4}\z", "")
    c = F.regexp_replace(c, r"([A-Z][a-z]{2,8})  +(\d)", "$1 $2")
    c = F.regexp_replace(c, r"^([A-Z][a-z]{2} \d{1,2} \d\d:\d\d:\d\d) [A-Z]{3,4} (\d{4})\z", "$1 $2")
    c = F.regexp_replace(c, r"^([A-Z][a-z]{2} \d{1,2} \d\d:\d\d:\d\d) [+-]\d{4} (\d{4})\z", "$1 $2")
    c = F.regexp_replace(c, r"(:\d\d)\.\d+\z", "$1")
    # A layout is tried only on texts of its shape: a text that fails to parse costs an exception.
    read = lambda p, t=c: F.when(F.rlike(c, F.lit(_shape(p.removeprefix("yyyy~")))), F.try_to_timestamp(t, F.lit(p.replace("~", " "))))
    when = F.coalesce(*(read(p) for p in fixed.TIME_LAYOUTS))
    yearless = F.coalesce(*(read(f"yyyy~{p}", F.concat(F.lit("2000 "), c)) for p in fixed.YEARLESS_LAYOUTS))
    text = F.coalesce(F.date_format(when, "yyyy-MM-dd HH:mm:ss"), F.date_format(yearless, "'0000'-MM-dd HH:mm:ss"))
    return text_trim(F.regexp_replace(F.regexp_replace(text, r":00\z", ""), r"00:00\z", ""))


def norm_time(c: Column) -> Column:
    """``YYYY-MM-DD[ HH:MM[:SS]]`` of a time text; a text without a known time stays."""
    found = F.filter(F.array(*(F.regexp_extract(c, p, 0) for p in fixed.TIME_PATTERNS)), lambda m: m != "")
    searched = F.try_element_at(F.filter(F.transform(found, _parsed), lambda t: t.isNotNull()), F.lit(1))
    return F.coalesce(_parsed(c), searched, c)


def is_epoch(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^[0-9]{8,}\z"))


def epoch_time(c: Column) -> Column:
    """Wall clock (UTC) of seconds, or of milliseconds if there are 13 digits."""
    n = c.try_cast("bigint")
    seconds = F.when(F.length(c) == 13, F.floor(n / 1000)).otherwise(n)
    return F.when(is_epoch(c) & n.isNotNull() & (F.length(c) <= 13), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")).otherwise(c)


def worth_404(title: Column, text: Column) -> Column:
    """Short page with an error title, or with enough words of a group of error words."""
    groups = F.array(*(literals(g) for g in fixed.WORTHLESS_KEYWORDS))

    def fires(group: Column) -> Column:
        hits = F.size(F.filter(group, lambda w: F.contains(text, w)))
        return (hits >= F.lit(fixed.WORTHLESS_RATIO) * F.size(group)) | (hits + 1 == F.size(group))

    named = F.rlike(clean_text(title), F.lit("|".join(fixed.WORTHLESS_TITLES)))
    return (F.char_length(text) < fixed.WORTHLESS_CHARS) & (named | F.exists(groups, fires))


def worth_content(title: Column, text: Column, labels: Column | None = None) -> Column:
    """Hardly any text besides the title, and no figure."""
    rest = F.when(title == "", text).otherwise(F.replace(text, title, F.lit("")))
    short = F.char_length(rest) <= fixed.WORTHLESS_CHARS
    return short if labels is None else short & ~F.array_contains(labels, fixed.LABEL_FIGURE)


def worth_type(title: Column, text: Column, labels: Column | None = None) -> Column:
    return F.when(worth_404(title, text), 2).when(worth_content(title, text, labels), 3).otherwise(1)


def attr_filter(attrs: Column) -> Column:
    """Attributes whose names are plain identifiers."""
    return F.map_filter(attrs, lambda k, v: F.rlike(k, F.lit(r"^[a-zA-Z_][a-zA-Z0-9_-]*\z")))


def tiny_noise(c: Column, rules: list[tuple[str, int]] | None = None) -> Column:
    """Whether a text is a small notice: a phrase occurs and the text is no longer than its limit."""
    rules = rules or fixed.TINY_NOISE
    table = F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(n).alias("most")) for p, n in rules))
    some = F.rlike(c, F.lit("|".join(f"\\Q{p}\\E" for p, _ in rules)))  # one pass tells most texts off
    return (F.char_length(c) <= max(n for _, n in rules)) & some & F.exists(table, lambda r: F.contains(c, r["phrase"]) & (F.char_length(c) <= r["most"]))


def kept_attrs(attrs: Column, mark: str = "leaf") -> Column:
    """Attributes that formatting keeps: addresses, sizes, links, and marks."""
    keep = [*fixed.ATTRS_KEPT, *fixed.IMAGE_ATTRS, *fixed.ANCHOR_ATTRS]
    return F.map_filter(attrs, lambda k, v: k.isin(keep) | F.contains(F.lower(k), F.lit(mark)))


def style_rule(tag: Column, style: Column) -> Column:
    """The style that formatting leaves on an element."""
    kept = F.when(tag.isin(fixed.IMAGE_TAGS), literals(fixed.STYLE_KEPT + fixed.STYLE_KEPT_IMAGE)).otherwise(literals(fixed.STYLE_KEPT))

    def rule(m: Column) -> Column:
        bg = F.coalesce(F.try_element_at(m, F.lit("background")), F.try_element_at(m, F.lit("background-color")))
        extreme = is_white(bg) | is_dark(bg)
        m = F.map_filter(m, lambda k, v: ~(k.isin("background", "background-color") & extreme))
        m = F.map_filter(m, lambda k, v: ~((k == "width") & (v == "100%")) & ~((k == "color") & is_white(v)))
        return F.map_filter(m, lambda k, v: (k != "list-style") | (tag == "ol"))

    bare = F.transform_values(style_map(style), lambda k, v: text_trim(F.replace(v, F.lit("!important"), F.lit(""))))
    return let(F.map_filter(bare, lambda k, v: F.array_contains(kept, k) & (v != "")), lambda m: style_text(rule(m)))
