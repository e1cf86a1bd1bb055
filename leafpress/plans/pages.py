"""The page operators over DataFrames: segment, label, distill and parse.

Input rows hold ``url`` and ``html``, and optionally ``rule`` (from
``operators.rules.pick_rules``). The page kernel runs once per page in Arrow
batches; everything that does not depend on a tree is native.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leafpress.functions import fixed
from leafpress.functions import text as X
from leafpress.operators.page import Page, PageError, Rule, raw_text

ATOM = "struct<text:string,position_id:int,xpath:string,immutable:boolean,tags:array<string>,tail:boolean,segment_id:int>"
SENTENCE = f"struct<text:string,atoms:array<{ATOM}>,segment_id:int,tags:array<string>,url:string,table_html:string,label:string>"
AUTHOR = "struct<name:string,profile_url:string,description:string,uid:string>"
META = f"struct<title:string,author:string,content_source:string,publish_time:string,site_icon:string,surface_image:string,description:string,author_meta:{AUTHOR}>"
NODE = "struct<pid:int,parent:int,last_pid:int,depth:int,tag:string,attrs:map<string,string>,text:string,tail:string,xpath:string>"
SEGMENT = f"meta {META}, sentences array<{SENTENCE}>, segmented string, images map<string,string>, error string"
DISTILL = "readable_html string, text string, images array<string>"
#: Pages in an Arrow slice of the kernel's output.
SLICE = 64
#: File bytes a core under which an input is dealt over the cores.
SMALL = 32_000_000


def _nullable(kind: T.DataType) -> T.DataType:
    text = kind.json()
    for flag in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{flag}":false', f'"{flag}":true')
    return T._parse_datatype_json_string(text)


def _as(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """The column in the declared type; nested types that differ in nullability are rebuilt."""
    return column if column.type == kind else pa.array(column.to_pylist(), kind)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, where the input files are too small to be split that far.

    Large inputs are left as they are scanned, without a shuffle.
    """
    if df.isStreaming:
        return df
    session = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    cores = session.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if size < cores * SMALL else df


def safely(step: Callable[[dict], dict], row: dict) -> dict:
    """What a step makes of a row; a row that it cannot handle says so and harms no other."""
    try:
        return step(row)
    except Exception as e:  # noqa: BLE001  pages hold anything
        return {"error": f"{type(e).__name__}: {e}"}


def page_map(df: DataFrame, step: Callable[[dict], dict], fields: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add a kernel's columns to each row; batches are cut so that no slice holds many pages.

    A row at which the step raises gets nulls, and the reason in ``error`` if there is such a field.
    """
    kept = [T.StructField(f.name, _nullable(f.dataType)) for f in df.schema.fields if f.name not in drop]
    out = T.StructType([*kept, *T._parse_datatype_string(fields).fields])
    arrow, names = to_arrow_schema(out), [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [safely(step, r) for r in part.to_pylist()]
                cols = [_as(part.column(part.schema.get_field_index(n)), arrow.field(n).type) for n in names]
                cols += [pa.array([r.get(f.name) for r in rows], arrow.field(f.name).type) for f in out.fields[len(kept) :]]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.mapInArrow(run, out)


def _rule(row: dict) -> Rule | None:
    r = row.get("rule")
    if not r:
        return None
    return Rule(r["bodies"] or [], r["noises"] or [], r["title"] or "", r["author"] or "", r["pub_time"] or "", r["reserved_nodes"] or [], bool(r["no_semantic_denoise"]), bool(r["body_use_rule_only"]))


def _page(row: dict, html: str = "html", light: bool = True) -> Page:
    return Page(row.get(html) or "", row.get("url") or "", _rule(row), light)


def _nodes(page: Page) -> list[dict]:
    out: list[dict] = []
    rows: dict[int, dict] = {0: {"pid": 0, "depth": -1}}
    for n in page.root.all():
        up = rows[n.parent.pid if n is not page.root else 0]
        rows[n.pid] = {"pid": n.pid, "parent": up["pid"], "depth": up["depth"] + 1, "tag": n.tag, "attrs": list(n.attrs.items()), "text": n.text, "tail": n.tail, "xpath": n.xpath, "last_pid": n.pid}
        out.append(rows[n.pid])
    for row in reversed(out):  # descendants come before their elements
        up = rows[row["parent"]]
        up["last_pid"] = max(up.get("last_pid", 0), row["last_pid"])
    return out


def dom_nodes(pages: DataFrame) -> DataFrame:
    """The pages with their repaired, pruned trees as arrays of nodes in document order."""
    return page_map(spread(pages), lambda r: {"nodes": _nodes(_page(r))}, f"nodes array<{NODE}>", ("html",))


class DomNodes:
    """The nodes of one page's repaired, pruned tree, for lateral joins in SQL."""

    def eval(self, html: str | None, url: str | None):
        try:
            nodes = _nodes(Page(html or "", url or ""))
        except Exception:  # noqa: BLE001  a page that nothing can be made of has no nodes
            return
        for n in nodes:
            yield n["pid"], n["parent"], n["last_pid"], n["depth"], n["tag"], dict(n["attrs"]), n["text"], n["tail"], n["xpath"]


def register_dom_nodes(spark: SparkSession, name: str = "dom_nodes") -> None:
    """Make ``dom_nodes(html, url)`` a table function of the session's SQL."""
    spark.udtf.register(name, F.udtf(DomNodes, returnType=NODE.removeprefix("struct<").removesuffix(">")))


def page_text(pages: DataFrame) -> DataFrame:
    return page_map(spread(pages), lambda r: {"text": raw_text(_page(r).root)}, "text string", ("html",))


def select(pages: DataFrame, path: str) -> DataFrame:
    """Numbers and texts of the elements that an xpath finds."""
    return page_map(spread(pages), lambda r: {"found": [{"pid": n.pid, "text": raw_text(n)} for n in _page(r).find(path)]}, "found array<struct<pid:int,text:string>>", ("html",))


def metadata(pages: DataFrame) -> DataFrame:
    """The pages with their article metadata; times are brought to normal form natively."""
    out = page_map(spread(pages), lambda r: {"meta": _page(r).meta()}, f"meta {META}", ("html",))
    return out.withColumn("meta", F.col("meta").withField("publish_time", normal_time(F.col("meta.publish_time"))))


def normal_time(c: Column) -> Column:
    return X.norm_time(F.when(X.is_epoch(c), X.epoch_time(c)).otherwise(c))


def cleaned(pages: DataFrame, steps: list[str]) -> DataFrame:
    """The pages' HTML after some of the cleaning passes, by name."""

    def run(row: dict) -> dict:
        page = _page(row)
        for name in steps:
            getattr(page, name)()
        return {"cleaned": page.to_html(), "text": raw_text(page.root)}

    return page_map(spread(pages), run, "cleaned string, text string", ("html",))


def segment(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Metadata, sentences, numbered HTML and images of each page; ``error`` says why a page has none."""

    def run(row: dict) -> dict:
        if not row.get("url") or not row.get("html"):
            return {"error": "empty url or html"}
        page = _page(row)
        meta = page.meta()
        try:
            page.pre_clean(strict)
        except PageError as e:
            return {"meta": meta, "error": str(e)}
        sents = page.sentences(meta["title"])
        if not sents:
            return {"meta": meta, "error": "no sentences"}
        page.mark_atoms(sents)
        page.format_nodes()
        return {"meta": meta, "sentences": sents, "segmented": page.to_html(), "images": list(page.images_with_pid().items())}

    out = page_map(spread(pages), run, SEGMENT, ("html",))
    return out.withColumn("meta", F.col("meta").withField("publish_time", normal_time(F.col("meta.publish_time"))))


def label(segmented: DataFrame, labeller: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sentences with labels. A labeller gets a sentence column and gives its label;
    without one every sentence is content."""
    give = labeller or (lambda s: F.lit(fixed.LABEL_CONTENT))
    return segmented.withColumn("sentences", F.transform("sentences", lambda s: s.withField("label", give(s))))


def label_request(segmented: DataFrame) -> DataFrame:
    """What a labelling service is asked: text, place, tags and a default label of each sentence."""
    info = lambda s, i: F.struct(i.alias("position"), s["text"].alias("text"), s["segment_id"].alias("segment_id"), s["tags"].alias("tags"), F.lit(fixed.LABEL_NOISE).alias("label"))
    return segmented.withColumn("request", F.to_json(F.struct("url", F.transform("sentences", info).alias("infos"))))


#: What a labelling service answers besides success (0), and what becomes of the page.
LABEL_ERRORS = {1001: "label service: bad request", 1002: "label service: model failed", 2001: "label service: overloaded"}


def apply_labels(segmented: DataFrame, answers: DataFrame) -> DataFrame:
    """Sentences with the labels that a service gave, in ``answers`` (url, code, labels by position).

    A code other than 0 or an unknown answer becomes the page's error; sentences
    without a label are noise.
    """
    told = answers.groupBy("url").agg(F.max_by(F.struct("code", "labels"), F.struct(-F.col("code"))).alias("_told"))
    rows = segmented.join(told, "url", "left")
    given = lambda s, i: s.withField("label", F.coalesce(F.get(F.col("_told.labels"), i), F.lit(fixed.LABEL_NOISE)))
    known = F.create_map(*(F.lit(x) for kv in LABEL_ERRORS.items() for x in kv))
    code = F.col("_told.code")
    wrong = F.when(code.isNull(), "label service: no answer").when(code != 0, F.coalesce(F.try_element_at(known, code), F.concat(F.lit("label service: code "), code.cast("string"))))
    rows = rows.withColumn("error", F.coalesce("error", wrong)).withColumn("sentences", F.when(code == 0, F.transform("sentences", given)).otherwise(F.col("sentences")))
    return rows.drop("_told")


def call_labeller(requests: DataFrame, ask: Callable[[list[str]], list[tuple[int, list[str] | None]]], batch: int = 64) -> DataFrame:
    """Answers (url, code, labels) of a service that takes batches of ``label_request`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                got = ask(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c for c, _ in got], pa.int32()), pa.array([x for _, x in got], pa.list_(pa.string()))], ["url", "code", "labels"])

    return requests.select("url", "request").mapInArrow(run, "url string, code int, labels array<string>")


def recover_meta(labelled: DataFrame, model: str | None = None) -> DataFrame:
    """Fill blank metadata from the model's answer, and the source from its label."""
    own = F.try_element_at(F.filter("sentences", lambda s: s["label"] == "source"), F.lit(1))["text"]
    meta = F.col("meta")
    for name, fallback in (("title", None), ("author", None), ("publish_time", None), ("content_source", own)):
        if not model and fallback is None:
            continue  # nothing to fill it from
        options = [F.nullif(meta[name], F.lit(""))]
        if model:
            options.append(F.nullif(F.col(model)[name], F.lit("")))
        if fallback is not None:
            options.append(fallback)
        meta = meta.withField(name, F.coalesce(*options, F.lit("")))
    return labelled.withColumn("meta", meta)


def distill(labelled: DataFrame) -> DataFrame:
    """Reader HTML, text, images and verdict of segmented and labelled pages."""

    def run(row: dict) -> dict:
        if not row.get("segmented"):
            return {"error": row.get("error")}
        rule, sents = _rule(row), row["sentences"]
        page = Page.__new__(Page)
        page.url, page.rule, page.html = row["url"], rule, row["segmented"]
        page.root = _reloaded(row["segmented"])
        page.last_pid = max((n.pid or 0 for n in page.root.all()), default=0)
        page._rename()
        if not (rule and rule.no_semantic_denoise):
            page.label_nodes(sents)
            page.label_subtrees(sents)
            page.beyond_canvas(sents)
        page.empty_tags()
        text, images = raw_text(page.root), page.images()
        return {"readable_html": page.to_html(row["meta"]), "text": text, "images": images, "error": row.get("error")}

    out = page_map(labelled, run, f"{DISTILL}, error string", ("images", "error"))
    labels = F.transform("sentences", lambda s: s["label"])
    worth = F.when(F.col("readable_html").isNull(), 3).otherwise(X.worth_type(F.col("meta.title"), F.col("text"), labels))
    return out.withColumn("worth_type", F.coalesce(worth, F.lit(3))).withColumn("worthless", F.col("worth_type") != 1)


def _reloaded(html: str):
    """The tree of an already numbered page."""
    from leafpress.operators.htmltree import parse

    root = parse(html)
    top = next((n for n in root.children if n.tag == "body"), root)
    for n in root.all():
        pid = n.attrs.get("position_id")
        n.pid = int(pid) if pid and pid.isdigit() else None
    top.parent = None
    return top


def parse(pages: DataFrame, labeller: Callable[[Column], Column] | None = None, strict: bool = False) -> DataFrame:
    """The whole way of a page: one row with metadata, reader HTML, text, images and verdict."""
    done = distill(recover_meta(label(segment(pages, strict), labeller)))
    keep = [c for c in pages.columns if c not in ("html", "rule", "rule_host")]
    meta = [F.col(f"meta.{a}").alias(b) for a, b in (("title", "title"), ("author", "author"), ("content_source", "content_source"), ("publish_time", "pub_time"), ("author_meta", "author_meta"), ("site_icon", "site_icon"), ("description", "description"), ("surface_image", "surface_image"))]
    return done.select(*keep, "text", "images", "readable_html", *meta, "worthless", "worth_type", "error")


def surviving_images(segmented: DataFrame, distilled: DataFrame) -> DataFrame:
    """Images of a segmented page that its reader HTML still shows."""
    had = segmented.select("url", F.explode("images").alias("image", "pid"))
    left = distilled.select("url", F.explode("images").alias("image"))
    return had.join(left.distinct(), ["url", "image"], "left_semi")


def need_browser(pages: DataFrame) -> DataFrame:
    """Pages to be fetched by a browser: the rule says so, or a post's text is missing."""

    def run(row: dict) -> dict:
        r = row.get("rule")
        if r and r["need_browser_crawl"]:
            return {"need_browser": True}
        if "mp.weixin.qq.com" not in (row.get("url") or ""):
            return {"need_browser": False}
        found = _page(row).find("//p[@id='js_text_desc']")
        return {"need_browser": bool(found) and len(raw_text(found[0]).replace(" ", "").encode()) < 10}

    return page_map(pages, run, "need_browser boolean", ("html",))
