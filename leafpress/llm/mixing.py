"""Mixing sources to target weights by Pareto order sampling.

Every document of a source expects the same number of copies, target / size of
the source. The whole part is allotted outright; the fraction is the inclusion
probability of one copy more. Documents are ranked by their random odds divided
by their inclusion odds, and the source takes from the front of the ranking
until its words are nearest to the target.

Defined cases: a null text has size 0; a null source is a source of its own and
comes last; a document of size 0 takes 0; repeated rows are sampled alike, each
for itself; an empty table gives an empty table. Draws are hashed from the
document id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafpress.llm.sharding import draw
from leafpress.llm.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
CELLS = 4096
#: Sources up to this number are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): the total is shared by weight; shares over
    ``most`` times a source's size stop there and the excess is shared again.

    Sources are sorted by the share level at which they fill up. A source is
    full if that level lies under the level that the sources from it on would get.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double"))
    cap = F.col("source_size") * float(most)
    every = Window.partitionBy()
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("full_at", cap / F.col("weight")).withColumns({
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    per = per.withColumn("level", F.col("left") / F.col("open"))
    first = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", -F.col("open"), "level"))).over(every)
    per = per.withColumn("level", first["level"])
    return per.select("source", "source_size", F.least(cap, F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def _with_sources(df: DataFrame, per: DataFrame, small: bool) -> DataFrame:
    per = per.withColumnRenamed("source", "_source")
    return df.join(F.broadcast(per) if small else per, df["source"].eqNullSafe(per["_source"])).drop("_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (doc_id, source and ``keep``) with size, source_size, target,
    copies and taken = copies * size."""
    keep = keep or []
    sized = stage(docs.select("doc_id", "source", words(F.col("text")).alias("size"), *keep))
    per = stage(source_targets(sized, weights, most))
    small = per.count() <= BROADCAST_SOURCES
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(share + 1e-12), F.lit(most)).cast("double")
    per = per.withColumn("whole", whole).withColumn("part", F.when(whole >= most, 0.0).otherwise(F.greatest(share - whole, F.lit(0.0))))
    per = per.withColumn("need", F.when(F.col("part") > 0, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0))
    u = draw(F.col("doc_id"), seed)
    odds = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    ranked = _with_sources(sized, per, small).withColumn("_rank", F.when(F.col("part") > 0, odds / (1 + odds)).otherwise(1.0))
    ranked = ranked.withColumn("_cell", F.least(F.floor(F.col("_rank") * CELLS), F.lit(CELLS - 1)).cast("int"))
    # Words of each cell of a source's ranking, and the cell in which the need is met.
    cells = ranked.filter("part > 0").groupBy("source", "_cell", "need").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_upto", F.sum("_words").over(upto))
    edge = cells.filter("_upto >= need").groupBy("source").agg(F.min(F.struct("_cell", (F.col("_upto") - F.col("_words")).alias("_before"))).alias("_edge"))
    per = per.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    per = per.select("source", F.coalesce("_edge._cell", F.lit(CELLS)).alias("_edge"), F.coalesce("_edge._before", F.lit(0)).alias("_before"))
    ranked = _with_sources(ranked, per, small)
    at_edge = (F.col("part") > 0) & (F.col("_cell") == F.col("_edge"))
    inside = Window.partitionBy("source").orderBy("_rank", "doc_id", "size", *keep)
    before = F.col("_before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge_rows = ranked.filter(at_edge).withColumn("_b", before)
    edge_rows = edge_rows.withColumn("_more", ((F.col("_b") + F.col("size") - F.col("need")) <= (F.col("need") - F.col("_b"))).cast("int")).drop("_b")
    rest = ranked.filter(~at_edge).withColumn("_more", ((F.col("part") > 0) & (F.col("_cell") < F.col("_edge"))).cast("int"))
    copies = (F.col("whole") + F.col("_more")).cast("long")
    out = rest.unionByName(edge_rows).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as many times as the mix takes it. Of rows that share id,
    text and source one stands for all, with the copies of all."""
    check = F.xxhash64("text").alias("_check")
    taken = mix(docs.select("doc_id", "source", "text", check), keep=["_check"], **options).groupBy("doc_id", "source", "_check")
    taken = taken.agg(F.sum("copies").cast("int").alias("copies"), (F.count(F.lit(1)) > 1).alias("repeated")).filter("copies > 0")
    rows = docs.select(F.struct("*").alias("_doc"), check)  # own names cannot clash
    same = F.col("_doc.doc_id").eqNullSafe(F.col("doc_id")) & F.col("_doc.source").eqNullSafe(F.col("source")) & (rows["_check"] == taken["_check"])
    rows = rows.join(taken, same).drop(rows["_check"])
    one = rows.filter("repeated").groupBy("doc_id", "source", "_check").agg(F.min_by("_doc", F.xxhash64(F.to_json("_doc"))).alias("_doc"), F.first("copies").alias("copies"))
    rows = rows.filter("not repeated").select("_doc", "copies").unionByName(one.select("_doc", "copies"))
    return rows.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_doc.*")
