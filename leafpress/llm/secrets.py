"""Secret scan with corpus-wide ownership frequency (native DataFrame functions only).

Pattern hits are kept as they are. Generic key-like strings are hashed and
counted over the corpus by distinct repositories (documents, copies of one text
once) and owners (sources): strings that are widely copied by both counts are
published examples; the others look like live credentials and are added as spans
of kind ``live``. Both bounds grow with the corpus (``needed``).

Defined cases: a null text is empty and has no spans; null sources are one
owner; repeated rows are reported each; very long texts are scanned whole;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.llm.staging import stage

# Fixed patterns: kind, pattern, group whose length counts, least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Maximal runs in which the least length is part of the pattern, with equal matches.
_RUNS = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
LIVE = r"[A-Za-z0-9+/_=-]{20,}"
LIVE_RANK, SALTS = 3, 16
#: An example has this many owners and texts, and this share of all; in small corpora a part of the texts.
LEAST, SHARE, PART = 3, 0.001, 0.1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str, block: int = 256) -> Column:
    """Array of (start, end, value) of a pattern's matches, in code points.

    The texts between the matches (``split``) and the matches themselves give
    running lengths, summed by blocks so that many matches stay cheap.
    """
    zero = F.lit(0)
    add = lambda a, x: a + x

    def place(parts: Column) -> Column:
        def sums(blocks: Column) -> Column:
            def one(match: Column, i: Column) -> Column:
                whole, rest = (i / block).cast("int"), F.pmod(i, F.lit(block)).cast("int")
                before = F.aggregate(F.slice(blocks, F.lit(1), whole), zero, add) + F.aggregate(F.slice(parts["both"], whole * block + 1, rest), zero, add)
                start = before + F.element_at(parts["gaps"], i + 1)
                return F.struct(start.alias("start"), (start + F.char_length(match)).alias("end"), match.alias("value"))

            return F.transform(parts["found"], one)

        last = (F.size(parts["found"]) / block).cast("int")
        blocks = F.transform(F.sequence(zero, last), lambda b: F.aggregate(F.slice(parts["both"], b * block + 1, F.lit(block)), zero, add))
        return let(blocks, sums)

    def measured(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
        return let(gaps, lambda g: F.struct(found.alias("found"), g.alias("gaps"), F.zip_with(F.slice(g, F.lit(1), F.size(found)), found, lambda a, m: a + F.char_length(m)).alias("both")))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), let(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), measured), place)).otherwise(none)


def _ranked(found: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    if group:
        found = F.filter(found, lambda m: F.char_length(F.regexp_extract(m["value"], pattern, group)) >= least)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))


def _spans(text: Column) -> Column:
    """All base spans as (start, rank, end), by start and then kind."""
    each = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        found = located(text, _RUNS.get(kind, pattern))
        each.append(_ranked(found, rank, pattern, group, least))
    return F.array_sort(F.concat(*each))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kinds = F.array(*(F.lit(k) for k, *_ in KINDS), F.lit("live"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def needed(texts: int, owners: int) -> tuple[float, float]:
    """Distinct texts and owners that an example has at least, in a corpus of so many."""
    return min(LEAST + SHARE * texts, PART * texts), max(LEAST, SHARE * owners)


def _distinct_counts(rows: DataFrame, *by: str) -> DataFrame:
    """How many texts and owners; nulls are an owner."""
    owner = F.struct("_owner")  # a struct of a null is no null
    return rows.groupBy(*by).agg(F.count_distinct("_text").alias("texts"), F.count_distinct(owner).alias("owners"))


def _marked() -> list[Column]:
    """A document's owner and text as they are counted."""
    return [F.col("source").alias("_owner"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text")]


def scan(docs: DataFrame, keep: list[str] | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, base and all spans (start, rank, end), kept columns.

    ``corpus``: all documents, where ``docs`` are only those that can have hits.
    """
    keep = keep or []
    text = F.coalesce(F.col("text"), F.lit(""))
    likely = F.filter(located(text, LIVE), lambda m: F.rlike(m["value"], F.lit("[0-9]")) & F.rlike(m["value"], F.lit("[A-Za-z]")))
    cands = F.transform(likely, lambda m: F.struct(m["start"].alias("start"), F.lit(LIVE_RANK).alias("rank"), m["end"].alias("end"), F.xxhash64(m["value"]).alias("hash")))
    rows = docs.select("doc_id", *_marked(), _spans(text).alias("base"), cands.alias("cands"), *keep)
    rows = stage(rows).withColumn("_row", F.monotonically_increasing_id())
    seen = rows.select("_row", "_owner", "_text", F.explode("cands").alias("c")).select("_row", "_owner", "_text", "c.*")
    whole = rows if corpus is None else corpus.select(*_marked())
    least_texts, least_owners = needed(*_distinct_counts(whole).first())
    counted = _distinct_counts(seen, "hash")
    live = counted.filter((F.col("texts") < least_texts) | (F.col("owners") < least_owners)).select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # A string that one owner repeats in many rows is spread over salts.
    hits = seen.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(live, ["hash", "salt"])
    added = hits.groupBy("_row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("live"))  # one document's spans
    out = rows.join(added, "_row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("live", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    return out.select("doc_id", "base", every.alias("spans"), *keep)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and the list of all spans."""
    found = scan(docs)
    count = lambda r: F.size(F.filter("base", lambda s: s["rank"] == r)).cast("long")
    counts = [count(r).alias(f"n_{k}") for r, (k, *_) in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every span of their secrets replaced by ``mask`` and ``n_chars`` to match.

    Overlapping and touching spans share one mask. Only documents with a hit are
    staged with their text; all others pass through one scan.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hit = F.lit(False)
    for pattern in (KINDS[0][1], *_RUNS.values(), LIVE):
        hit = hit | F.rlike(text, F.lit(pattern))
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")  # own names cannot clash
    found = scan(docs.filter(hit).select("doc_id", "source", "text", doc), ["text", "_doc"], docs)
    until = lambda i: F.coalesce(F.array_max(F.transform(F.slice("spans", F.lit(1), i), lambda s: s["end"])), F.lit(0))

    def piece(span: Column, i: Column) -> Column:
        kept = lambda done: F.when((i == 0) | (span["start"] > done), F.concat(F.substring("text", done + 1, span["start"] - done), F.lit(mask))).otherwise("")
        return let(until(i), kept)

    rest = let(until(F.size("spans")), lambda done: F.substring("text", done + 1, F.char_length("text") - done))
    masked = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(F.array_join(F.transform("spans", piece), ""), rest))
    found = found.select(masked.alias("text"), "_doc")
    new = {"text": F.col("text"), "n_chars": F.char_length("text")}
    found = found.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"_doc.`{c}`") for c in docs.columns))
    return docs.filter(~hit).unionByName(found)
