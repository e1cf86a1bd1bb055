"""The corpus pipeline from end to end, stage by stage against plain versions."""

import os
from collections import Counter, defaultdict

import brute
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, size string, `key` string, spans string, copies double"


def written(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def staged(spark, folder):
    """The documents after each stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        done = stage(spark, docs, folder)
        out[name] = (done.columns, done.collect())
        docs = spark.createDataFrame(out[name][1], done.schema)
    return out


def test_every_stage(spark, texts, tmp_path):
    key = "Zq9" + "x7Bd" * 7
    rows = rows_of(texts) + rows_of(texts)[:3]  # repeated rows
    rows += [(200, f"A {key} in a text of more than ten words that says little else.", "en", "a", 0, 1, "s", "k", "sp", 2.0), (201, None, None, None, None, None, None, None, None, None)]
    folder = written(spark, tmp_path, rows, [(0, 1, 0)])
    out = staged(spark, folder)
    columns = [f.split()[0].strip("`") for f in SCHEMA.split(", ")]
    assert all(out[name][0] == columns for name, _ in pipeline.STAGES[:-1])

    good = [r for r in out["quality_rules"][1]]
    assert Counter(r["doc_id"] for r in good) == Counter(r[0] for r in rows if not brute.base_counts(r[1])[-1])

    distinct = out["near_duplicates"][1]
    groups = brute.jaccard_groups({r["doc_id"]: r["text"] for r in good}.items())
    assert sorted(r["doc_id"] for r in distinct) == sorted({g for g, _ in groups.values()})

    masked = {r["doc_id"]: r["text"] for r in out["secret_scan"][1]}
    assert len(masked) == len(distinct) and key not in masked[200] and masked[200].startswith("A [secret] in")
    assert all(masked[r["doc_id"]] == r["text"] for r in distinct if "[secret]" not in masked[r["doc_id"]])

    mixed = out["source_mixing"][1]
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out["secret_scan"][1]:
        n = len(brute.words(r["text"]))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in mixed:
        taken[r["source"]] += len(brute.words(r["text"]))
    want = brute.targets(sizes)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    copies = Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 3

    pieces = out["best_fit_packing"][1]
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == copies
    used = Counter()
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096


def test_runs_agree_and_clean_up(spark, texts, tmp_path):
    folder = written(spark, tmp_path, rows_of(texts), [(0, 1, 0), (1, 0, 0)])
    shared = spark.conf.get("spark.checkpoint.dir")
    before = {x for x in os.listdir(shared) if x.startswith("pipeline-")}
    seen = [pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32") for _ in range(2)]
    assert sorted(map(tuple, seen[0].collect())) == sorted(map(tuple, seen[1].collect()))
    for x in {x for x in os.listdir(shared) if x.startswith("pipeline-")} - before:
        assert os.listdir(f"{shared}/{x}") in (["source_mixing"], [".source_mixing.crc", "source_mixing"])


def test_an_empty_table(spark, tmp_path):
    folder = written(spark, tmp_path, [], [])
    assert pipeline.run(spark, folder).collect() == []
    assert spark.read.parquet(f"{folder}/documents.parquet").agg(F.count(F.lit(1))).first()[0] == 0
