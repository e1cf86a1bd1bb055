"""Sharding by a hierarchical weighted hash tree (native DataFrame functions only).

A key descends region -> rack -> shard. At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from (key, child name); the smallest draw
wins. A child wins in proportion to its weight, and a changed weight moves keys
only into or out of that child. A shard added as a region of its own therefore
takes keys only into itself.

Defined cases: a null key hashes as the text ``null``; a null text counts as
empty; repeated rows get equal shards and slots of their own; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafpress.llm.staging import stage

#: 52 bits of an MD5 digest make one uniform draw.
_HEX, _RANGE = 13, float(1 << 52)


def draw(key: Column, name: Column | str) -> Column:
    """Uniform in (0, 1), decided by the key and a name alone."""
    name = F.lit(name) if isinstance(name, str) else name
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit("/"), name))
    return (F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") + 0.5) / _RANGE


def tree(shards: int, racks: int = 2, per_rack: int = 2, base: int = 8) -> dict[str, dict[str, dict[str, float]]]:
    """Region -> rack -> shard -> weight. The first ``base`` shards fill regions of
    ``racks * per_rack``; every shard beyond them is a region of its own."""
    out: dict[str, dict[str, dict[str, float]]] = {}
    for s in range(shards):
        region = f"g{s // (racks * per_rack)}" if s < base else f"x{s}"
        rack = f"{region}k{s % (racks * per_rack) // per_rack}"
        out.setdefault(region, {}).setdefault(rack, {})[str(s)] = 1.0
    return out


def _winner(key: Column, weights: dict[str, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct((-F.log(draw(key, n)) / F.lit(float(w))).alias("d"), F.lit(n).alias("n")) for n, w in weights.items()]
    return F.array_min(F.array(*draws))["n"]


def _pick(at: Column, options: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, col in options.items():
        out = F.when(at == name, col).otherwise(out)
    return out


def assign_shard(df: DataFrame, key: str, topology: dict, out: str) -> DataFrame:
    """Add the shard number that ``key`` reaches in ``topology`` as column ``out``."""
    k = F.col(key)
    weight = lambda node: sum(map(weight, node.values())) if isinstance(node, dict) else node
    region, rack = f"_{out}_region", f"_{out}_rack"
    df = df.withColumn(region, _winner(k, {r: weight(x) for r, x in topology.items()}))
    df = df.withColumn(rack, _pick(F.col(region), {r: _winner(k, {n: weight(y) for n, y in x.items()}) for r, x in topology.items()}))
    shard = _pick(F.col(rack), {n: _winner(k, y) for x in topology.values() for n, y in x.items()})
    return df.withColumn(out, shard.cast("int")).drop(region, rack)


def gapless(df: DataFrame, group: str, order: list[str], out: str, spread: int) -> DataFrame:
    """Number each group's rows from 0 without gaps or one task per group.

    Rows are spread over hashed cells of a group, counted per cell and numbered
    inside it; the cells' running totals give each cell its first number.
    """
    df = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(spread)))
    firsts = df.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(group, "_cell").orderBy(*order)
    df = df.withColumn("_at", F.row_number().over(inside) - 1)
    return df.join(firsts, [group, "_cell"]).withColumn(out, (F.col("_first") + F.col("_at")).cast("long")).drop("_first", "_at", "_cell")


def shard_documents(docs: DataFrame, shards: int = 8, rows_per_cell: int = 20_000) -> DataFrame:
    """Place documents by key: (doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    base = stage(assign_shard(assign_shard(base, "doc_id", tree(shards, base=shards), "shard"), "doc_id", tree(shards + 1, base=shards), "grown_shard"))
    spread = max(32, base.count() // (shards * rows_per_cell))
    base = gapless(base, "shard", ["doc_id", "text_crc32", "size"], "slot", spread)
    return base.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
