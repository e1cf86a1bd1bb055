"""Near-duplicate join: a MinHash LSH forest, then exact Jaccard on word 5-grams.

Each distinct set of shingles is one class, however many documents share it. A
class has a label in each of ``TREES`` tries: the bytes of ``DEEPEST`` MinHash
values, so that sorted labels are a trie and a prefix is a node of it. Classes
meet in the nodes of the shortest prefix, ``SHORTEST`` bytes. A node of over
``CROWD`` classes is taken at whole labels instead; but where a class has so many
crowded nodes that with whole labels it would meet a partner at the threshold
with less than ``RECALL``, its prefixes are shortened again, and with them those
of the nodes' other classes. So every class keeps the recall, by formula, and
only crowds that it can spare are cut.

In a node, classes are compared by whole signatures (all labels), and only those
that can be at the threshold are joined, as a spanning forest; the few nodes that
stay crowded are joined to one head. Joined classes make components, and every
pair of a component is verified on the whole shingle sets: small components many
at a time, large ones cut into blocks that meet pairwise, so that no task holds
more than two blocks and no pair is written out.

Defined cases: texts under five words are one shingle of all their words; texts
without words (nulls too) are never linked and form groups of their own;
repeated rows and ids are documents each; ties do not arise, as a pair counts if
5 * common >= 4 * all; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.llm import textnum as tn
from leafpress.llm.staging import stage

SHINGLE, TREES, DEEPEST = 5, 32, 8
#: Recall of a pair at the threshold, over all trees.
RECALL = 0.9999
#: Classes of a node that are compared with each other; more are a crowd.
CROWD = 128
#: Signature bytes that classes of a pair at the threshold share at least: the
#: threshold less five standard deviations of TREES * DEEPEST draws.
LIKELY = 0.8 - 5 * (0.8 * 0.2 / (TREES * DEEPEST)) ** 0.5
#: Classes of a component that are compared in one task, and of a block of a larger one.
TOGETHER, BLOCK = 1024, 512
#: A class with more than one of so many documents is hot, so there are at most so many hot ones.
HOT = 10_000
_NO_ID = (1 << 63) - 1


def shortest_prefix(similarity: float, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix at which a pair of this similarity meets with the recall, if all trees use it."""
    for depth in range(deepest, 1, -1):
        if 1 - (1 - similarity**depth) ** trees >= recall:
            return depth
    return 1


def spared_trees(similarity: float, short: int, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """In how many trees a class can use whole labels, and prefixes in the others, and keep the recall."""
    missed = lambda n: (1 - similarity**deepest) ** n * (1 - similarity**short) ** (trees - n)
    return max((n for n in range(trees + 1) if 1 - missed(n) >= recall), default=0)


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and each text's bounds in them."""
    n = len(off) - 1
    starts, ends, doc = tn.word_spans(raw, off)
    words = tn.word_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    grams = tn.window_hash(words, SHINGLE)
    of = doc[: len(grams)]
    inside = of == doc[SHINGLE - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    grams, of = grams[inside], of[inside]
    size = np.bincount(doc, minlength=n)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        at = np.searchsorted(doc, short)
        whole = tn.span_hash(words, at, size[short])
        grams, of = np.concatenate([grams, whole]), np.concatenate([of, short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    if len(grams):
        keep = np.ones(len(grams), dtype=bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
        grams, of = grams[keep], of[keep]
    return grams, np.searchsorted(of, np.arange(n + 1))


def class_keys(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set (0 for the empty one)."""
    sums = np.zeros(len(grams) + 1, dtype=np.uint64)
    np.cumsum(tn.mix64(grams), out=sums[1:])
    size = np.diff(bounds).astype(np.uint64)
    key = tn.mix64(sums[bounds[1:]] - sums[bounds[:-1]] + size * np.uint64(0xD1B54A32D192ED03))
    return np.where(size > 0, np.maximum(key, np.uint64(1)), np.uint64(0))


def labels(grams: np.ndarray, bounds: np.ndarray, trees: int = TREES, deepest: int = DEEPEST) -> np.ndarray:
    """Labels of every set with members, one of ``deepest`` bytes in every tree, the first value on top."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), trees), dtype=np.uint64)
    if not len(starts):
        return out
    draws = np.random.default_rng(20).integers(0, 1 << 32, size=(trees, deepest, 2), dtype=np.uint64).astype(np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    for t in range(trees):
        for d in range(deepest):
            values = short * (draws[t, d, 0] | np.uint32(1))
            values ^= values >> np.uint32(15)
            values *= draws[t, d, 1] | np.uint32(1)
            least = np.minimum.reduceat(values, starts).astype(np.uint64)
            out[:, t] |= (tn.mix64(least + np.uint64(1)) >> np.uint64(56)) << np.uint64(8 * (7 - d))
    return out


def common_pairs(rows: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows with a common shingle, and how many they have in common.

    Shingles of few rows list their pairs; those of many rows are multiplied as a
    dense matrix, column block by column block.
    """
    order = np.lexsort((rows, grams))
    rows, grams = rows[order], grams[order]
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(grams)))
    codes, counts = [], []
    few = (size > 1) & (size <= 24)
    for k in np.unique(size[few]):
        table = rows[at[few & (size == k)][:, None] + np.arange(k)]
        i, j = np.triu_indices(k, 1)
        code, c = np.unique((table[:, i] * n + table[:, j]).ravel(), return_counts=True)
        codes.append(code)
        counts.append(c)
    many = np.flatnonzero(size > 24)
    if len(many):
        used = np.unique(np.concatenate([rows[at[m] : at[m] + size[m]] for m in many]))
        place = np.zeros(n, dtype=np.int64)
        place[used] = np.arange(len(used))
        total = np.zeros((len(used), len(used)), dtype=np.float32)
        for k in range(0, len(many), 2048):
            part = many[k : k + 2048]
            dense = np.zeros((len(used), len(part)), dtype=np.float32)
            for c, m in enumerate(part):
                dense[place[rows[at[m] : at[m] + size[m]]], c] = 1
            total += dense @ dense.T
        i, j = np.nonzero(np.triu(total, 1))
        codes.append(used[i] * n + used[j])
        counts.append(total[i, j].astype(np.int64))
    if not codes:
        return (np.zeros(0, np.int64),) * 3
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    both = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
    return code // n, code % n, both


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number in each number's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of (a, b) edges.

    Minimum labels spread along the edges, to the nodes that labels name, and
    through labels of labels, so rounds grow with the logarithm of the component;
    each round is staged, and only whether labels changed reaches the driver.
    """
    both = stage(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        seen = both.join(of_b, "b").join(of_a, "a").filter("lb < la")
        # A smaller label is offered to the node and to the node that its label names.
        offers = seen.select(F.col("a").alias("node"), "lb").unionAll(seen.select(F.col("la").alias("node"), "lb"))
        offers = offers.groupBy("node").agg(F.min("lb").alias("near"))
        step = labels.join(offers, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels_new = stage(step.join(up, "label").select("node", "old", F.least("label", "up").alias("label")))
        changed = labels_new.filter("old != label").limit(1).count()
        labels = labels_new.select("node", "label")
        if not changed:
            return labels


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, check, key, labels): class of every document, and its label in every tree;
    ``check`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in tn.slices(batch, 1):
                grams, bounds = shingle_sets(raw, off)
                some = np.diff(bounds) > 0
                flat = np.concatenate([[0], np.cumsum(np.where(some, TREES, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(flat), pa.array(labels(grams, bounds).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(class_keys(grams, bounds).view(np.int64)), lists], ["doc_id", "check", "key", "labels"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("check")).mapInArrow(run, "doc_id long, check long, key long, labels array<long>")


def _in_nodes(rows: DataFrame, node: list[str]) -> DataFrame:
    """The rows whose node holds more than one class, with its size and its smallest key."""
    sizes = rows.groupBy(*node).agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("head")).filter("size > 1")
    return rows.join(sizes, node)


def met(classes: DataFrame, short: int, spared: int) -> DataFrame:
    """(key, tree, node, size, head): the nodes in which classes meet others."""
    rows = classes.select("key", F.posexplode("labels").alias("tree", "label"))
    rows = rows.withColumn("node", F.shiftrightunsigned("label", 8 * (DEEPEST - short)))
    rows = stage(_in_nodes(rows, ["tree", "node"]).withColumn("crowded", F.col("size") > CROWD))
    crowded = rows.filter("crowded")
    # Nodes of which some class has too many crowded ones keep their short prefix.
    pressed = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > spared).select("key")
    kept = crowded.join(pressed, "key", "left_semi").select("tree", "node").distinct().withColumn("_kept", F.lit(True))
    crowded = crowded.join(kept, ["tree", "node"], "left")
    whole = crowded.filter("_kept is null").select("key", "tree", F.col("label").alias("node"))
    whole = _in_nodes(whole, ["tree", "node"]).withColumn("tree", -1 - F.col("tree"))  # nodes of another length
    columns = ["key", "tree", "node", "size", "head"]
    return rows.filter("not crowded").select(*columns).unionByName(crowded.filter("_kept").select(*columns)).unionByName(whole.select(*columns))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between classes of a node that can be at the threshold, from rows sorted by node: a spanning forest."""
    left: pa.Table | None = None

    def edges(table: pa.Table) -> pa.RecordBatch:
        key, tree, node = (table[c].to_numpy() for c in ("key", "tree", "node"))
        signs = np.frombuffer(b"".join(table["sign"].to_pylist()), np.uint8).reshape(len(key), TREES * DEEPEST)
        start = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (node[1:] != node[:-1])]))
        size = np.diff(np.append(start, len(key)))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.unique(size[size > 1]):
            i, j = np.triu_indices(k, 1)
            of = start[size == k]
            for at in range(0, len(of), max(1, 40_000 // len(i))):
                first = of[at : at + max(1, 40_000 // len(i)), None]
                a, b = (first + i).ravel(), (first + j).ravel()
                near = (signs[a] == signs[b]).sum(axis=1) >= LIKELY * TREES * DEEPEST
                found.append((a[near], b[near]))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        label = connected(len(key), a, b)
        some = np.flatnonzero(label != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(key[label[some]])], ["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if left is None else pa.concat_tables([left, table])
        if not table.num_rows:
            continue
        # The last node may go on in the next batch.
        tree, node = table["tree"].to_numpy(), table["node"].to_numpy()
        cut = int(np.flatnonzero((tree != tree[-1]) | (node != node[-1]))[-1]) + 1 if (tree != tree[-1]).any() or (node != node[-1]).any() else 0
        left = table.slice(cut)
        if cut:
            yield edges(table.slice(0, cut).combine_chunks())
    if left is not None and left.num_rows:
        yield edges(left.combine_chunks())


def likely_edges(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) edges that connect the classes that can be at the threshold."""
    few, many = nodes.filter(F.col("size") <= CROWD), nodes.filter(F.col("size") > CROWD)
    sign = F.unhex(F.array_join(F.transform("labels", lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    signs = classes.select("key", sign.alias("sign"))
    rows = few.select("key", "tree", "node").join(signs, "key").repartition("tree", "node").sortWithinPartitions("tree", "node", "key")
    heads = many.filter("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    return contracted(rows.mapInArrow(_likely, "a long, b long").unionByName(heads))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components: a class is tied to the least of its partners, and that one to
    the others. Copies of one kind name few partners, so most edges are equal."""
    own = edges.groupBy("a").agg(F.collect_set("b").alias("all"))  # one a tree at most
    own = own.withColumn("least", F.array_min("all"))
    rest = own.select(F.col("least").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    return own.select("a", F.col("least").alias("b")).unionByName(rest).distinct()


def _verify(table: pa.Table) -> pa.Table:
    """Links and local groups of the classes in a cell; a class of several rows counts once."""
    table = table.combine_chunks()
    key, at = np.unique(table["key"].to_numpy(), return_index=True)
    comp, side, copies, rep = (table[c].to_numpy()[at] for c in ("comp", "side", "copies", "rep"))
    sets = [np.frombuffer(b, "<u8") for b in table["grams"].take(pa.array(at)).to_pylist()]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    rows = np.repeat(np.arange(len(key)), size)
    # Components share a cell but no shingle.
    grams = tn.mix64(np.concatenate(sets) + tn.mix64(comp.view(np.uint64).copy())[rows])
    i, j, both = common_pairs(rows, grams, len(key))
    near = 5 * both >= 4 * (size[i] + size[j] - both)
    across = table["second"][0].as_py()
    if across:
        near &= side[i] != side[j]
    i, j = i[near], j[near]
    links = np.bincount(i, weights=copies[j], minlength=len(key)) + np.bincount(j, weights=copies[i], minlength=len(key))
    order = np.lexsort((key, rep))  # groups are named by the smallest document
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.arange(len(key))
    label = order[connected(len(key), rank[i], rank[j])[rank]]
    cols = [key, links.astype(np.int64), key[label], rep[label], comp]
    return pa.table([pa.array(c) for c in cols], names=["key", "links", "label", "group", "comp"])


def join(docs: DataFrame, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """(doc_id, key, class_id, n_links): the document's group, named by its smallest
    id, and the number of documents at the similarity or above."""
    assert similarity == 0.8, "the exact test is written for 4/5"
    return _joined(docs, stage(signed(docs)), recall).drop("check", "group_key")


def _joined(docs: DataFrame, base: DataFrame, recall: float = RECALL) -> DataFrame:
    """The join, with each document's text hash and the key of its group's first class."""
    some_id = F.coalesce(F.col("doc_id"), F.lit(_NO_ID))
    classes = stage(base.filter("key != 0").groupBy("key").agg(F.min(some_id).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("labels").alias("labels")))
    short = shortest_prefix(0.8, recall)
    edges = likely_edges(classes, stage(met(classes, short, spared_trees(0.8, short, recall))))
    comps = components(edges).select(F.col("node").alias("key"), F.col("label").alias("comp"))
    sized = stage(comps.join(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("members")), "comp").join(classes.select("key", "rep", "copies"), "key"))
    links = _links(docs, sized, base)
    grouped = classes.select("key", "rep", "copies").join(links, "key", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    grouped = stage(grouped.select("key", "copies", F.coalesce("group", "rep").alias("group"), n_links.alias("n_links"), F.coalesce("label", "key").alias("group_key")))
    named = _by_class(base.select("doc_id", "check", "key"), grouped)
    group = F.when(F.col("key") == 0, F.col("doc_id")).otherwise(F.nullif(F.col("group"), F.lit(_NO_ID)))
    return named.select("doc_id", "check", "key", group.alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "group_key")


def _by_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows with their class's columns; the few hot classes are broadcast, so no task holds one whole."""
    values = [F.struct("group", "n_links", "group_key").alias("_class")]
    most = max(1000, rows.count() // HOT)
    hot = classes.filter(F.col("copies") > most).select("key", *values)
    rows = rows.join(F.broadcast(hot), "key", "left")  # at most HOT rows
    rest = rows.filter("_class is null").drop("_class").join(classes.filter(F.col("copies") <= most).select("key", *values), "key", "left")
    return rows.filter("_class is not null").unionByName(rest).select("*", "_class.*").drop("_class")


def _links(docs: DataFrame, sized: DataFrame, base: DataFrame) -> DataFrame:
    """(key, links, group, label) of the classes that met another; the label is the key of one class of the group."""
    cells = max(8, sized.count() // 4000)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    side = F.pmod(F.xxhash64("key"), blocks).cast("int")
    # A small component lies in one hashed cell; a block of a large one meets every block.
    small = sized.filter(F.col("members") <= TOGETHER).select("*", F.pmod(F.xxhash64("comp"), F.lit(cells)).cast("long").alias("cell"), F.lit(-1).alias("first"), F.lit(0).alias("second"), F.lit(0).alias("side"))
    large = sized.filter(F.col("members") > TOGETHER).withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    large = large.select(*sized.columns, F.col("comp").alias("cell"), low.alias("first"), F.when(low < high, high).otherwise(0).alias("second"), "side")
    wanted = small.unionByName(large)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in tn.slices(batch, 1):
                grams, bounds = shingle_sets(raw, off)
                key = class_keys(grams, bounds).view(np.int64)
                cut = [grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                out = pa.RecordBatch.from_arrays([pa.array(key), pa.array(cut, pa.binary()), part.column(2)], ["key", "grams", "want"])
                yield out.filter(pa.array(key == part.column(2).to_numpy()))

    # The text of one document of each class that met another.
    picked = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("rep"), "text")
    text = picked.join(sized.select("rep", F.col("key").alias("want")), "rep").select("rep", "text", "want")
    found = text.mapInArrow(sets, "key long, grams binary, want long").drop("want")
    rows = wanted.join(found, "key").select("cell", "first", "second", "side", "key", "comp", "copies", "rep", "grams")
    checked = stage(rows.groupBy("cell", "first", "second").applyInArrow(_verify, "key long, links long, label long, group long, comp long"))
    parts = checked.groupBy("key").agg(F.sum("links").alias("links"), F.min("group").alias("group"), F.min("label").alias("label"))
    crossing = large.select("key").distinct()
    if large.limit(1).count() == 0:
        return parts
    # Groups of large components span cells: their local groups are joined again.
    spans = checked.join(crossing, "key", "left_semi")
    over = components(spans.select(F.col("key").alias("a"), F.col("label").alias("b"))).select(F.col("node").alias("key"), F.col("label").alias("whole"))
    named = over.join(spans.groupBy("key").agg(F.min("group").alias("g")), "key").groupBy("whole").agg(F.min("g").alias("named"))
    over = over.join(named, "whole").select("key", "named", "whole")
    return parts.join(over, "key", "left").select("key", "links", F.coalesce("named", "group").alias("group"), F.coalesce("whole", "label").alias("label"))


def distinct(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Of each group one document, that with the smallest id (then text hash); of its
    repeated rows one. Documents without words all stay."""
    assert similarity == 0.8
    base = stage(signed(docs))
    found = _joined(docs, base).filter("key != 0")
    first = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "check")
    stay = found.groupBy("group_key").agg(F.min(first).alias("s")).select("s.*")
    same = base.groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "check").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    stay = stage(stay.join(same, ["id", "check"]))
    # Own names cannot clash.
    rows = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("check"), F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)).alias("words"))
    kept = rows.filter("words").join(stay, ["id", "check"])
    one = kept.filter("repeated").groupBy("id", "check").agg(F.min_by("_doc", F.xxhash64(F.to_json("_doc"))).alias("_doc"))
    return rows.filter("not words").select("_doc.*").unionByName(kept.filter("not repeated").select("_doc.*")).unionByName(one.select("_doc.*"))
