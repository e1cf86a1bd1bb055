import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafpress.llm import jaccard, language_model, mixing, neighbours, packing, quality, rounds, secrets, sharding, substrings, suffixes


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- packing --


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_word_encoder_equals_the_tokenizer(tokenizer, texts):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokenizer), packing.WordEncoder(tokenizer)
    for x in [*texts, "It's <|startoftext|> HERE <|STARTOFTEXT|>", "ΑΣ ΣΑΣ İx Å Å", "a b c\x1cd\x85e", "don't ,,, 12ab3 'tis ''s", "ﬁ ½ éé"]:
        assert e.text(x) == np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes(), x


def check_packing(rows, capacity):
    seen = defaultdict(list)
    for r in rows:
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in seen.values():
        places.sort()
        at = 0
        for offset, length in places:
            assert offset == at
            at += length
        assert at <= capacity
    return len(seen)


def test_pieces_and_places(docs, pairs, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    rows = packing.pack(docs, tokenizer, capacity=64).collect()
    check_packing(rows, 64)
    got = defaultdict(dict)
    for r in rows:
        got[r["doc_id"]][r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
    for doc, text in pairs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want = {k: (a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))}
        assert got[doc] == want


def test_plan_is_best_fit_decreasing():
    r = np.random.default_rng(0)
    for capacity in (7, 50, 64):
        lengths = r.integers(1, capacity + 1, 400).tolist()
        bins = []
        for x in sorted(lengths, reverse=True):
            fits = [b for b in bins if b[0] >= x]
            best = min(fits, key=lambda b: b[0]) if fits else None
            if best is None:
                bins.append([capacity - x])
            else:
                best[0] -= x
        plan = packing.best_fit_plan(dict(Counter(lengths)), capacity)
        used = set()
        for length, rank, first, per, offset in plan:
            stop = min([p[1] for p in plan if p[0] == length and p[1] > rank] + [lengths.count(length)])
            used |= {first + i // per for i in range(stop - rank)}
            assert offset + per * length <= capacity
        assert len(used) == len(bins)


def test_packing_odd_and_empty(odd, empty, tokenizer):
    rows = packing.pack(odd, tokenizer, capacity=64).collect()
    check_packing(rows, 64)
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
    assert packing.pack(empty, tokenizer).collect() == []


# -- substrings --


def test_substring_dedup(docs, pairs):
    want = brute.dedup_words(pairs)
    got = by_id(substrings.dedup(docs))
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == want
    assert sum(r["n_removed"] for r in got.values()) > 100
    assert all(sum(f["length"] for f in r["factors"]) == r["n_removed"] for r in got.values())


def test_substring_dedup_odd_and_empty(odd, empty):
    rows = substrings.dedup(odd).collect()
    assert len(rows) == odd.count()
    copies = sorted(r["n_removed"] for r in rows if r["doc_id"] == 1)
    n = max(r["n_words"] for r in rows if r["doc_id"] == 1)
    assert copies.count(n) >= 2 or n < 20
    assert substrings.dedup(empty).collect() == []


# -- quality --


def test_base_counts(docs, pairs, spark):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.judge(docs, labels))
    for doc, text in pairs:
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base_counts(text), doc
        assert r["kept"] == (not r["base_failed"])


def test_classifier_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.filter("doc_id % 3 <> 0")
    got = quality.judge(docs, learn).join(labels.filter("doc_id % 3 = 0"), "doc_id").select("good", "quality", "kept", "base_failed").collect()
    right = sum((r["good"] >= 0.5) == bool(r["quality"]) for r in got)
    assert right >= 0.9 * len(got)
    good = [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)


def test_quality_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (999, 0)], "doc_id long, quality int")
    assert quality.judge(odd, labels).count() == odd.count()
    assert quality.judge(empty, labels).collect() == []
    assert quality.judge(odd, labels.limit(0)).count() == odd.count()
    kept = quality.judge(odd, labels.limit(0), carry=True)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()


# -- nearest neighbours --


def vectors(spark, n=90, dim=8):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=dim)]) for i in range(n)]
    rows += [(n, [float("nan")] * dim), (n + 1, None), (n + 2, [0.0] * dim), (n + 3, [None] * dim), (n + 4, []), (n + 5, rows[7][1]), (n + 6, rows[7][1]), (None, rows[3][1]), (n + 7, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))


@pytest.mark.parametrize("block", [16, 4096])
def test_nearest(spark, block):
    rows, df = vectors(spark)
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df, df.filter("vec_id % 5 = 0"), block_rows=block).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    use = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    for q, v in use.items():
        if q % 5 == 0:
            want = sorted(((-float((v * c).sum()), i) for i, c in use.items() if i != q))[:20]
            assert [i for i, _ in got[q]] == [i for _, i in want]
            assert np.allclose([s for _, s in got[q]], [-d for d, _ in want], rtol=1e-12)
    assert set(got) <= set(use) | {95}


def test_nearest_carries_bounds_and_takes_long_vectors(spark, monkeypatch):
    """Many groups of blocks, each with a running bound; and vectors beyond exact float32 products."""
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(300)]
    rows += [(i, rows[i - 300][1]) for i in range(300, 330)]  # ties
    rows += [(1000 + i, [float(x) for x in r.normal(size=1500)]) for i in range(12)] + [(0, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "GROUP_BYTES", 1000)
    got = defaultdict(list)
    for x in sorted(neighbours.nearest(df, df.filter("vec_id % 50 = 0"), block_rows=40).collect(), key=lambda x: (x["query_id"], x["rank"])):
        got[x["query_id"]].append(x["vec_id"])
    plain = lambda a, b: sum(p * q for p, q in zip(a, b))
    asks = {q: min(v for i, v in rows if i == q) for q in range(0, 330, 50)} | {1000: rows[330][1]}
    for q, v in asks.items():
        want = sorted((-plain(v, c), i) for i, c in rows if i != q and len(c) == len(v))[:20]
        assert got[q] == [i for _, i in want]
    assert set(got) == set(asks)


def test_nearest_empty(spark):
    _, df = vectors(spark)
    assert neighbours.nearest(df.limit(0), df.limit(0)).collect() == []


# -- language model --


def test_base_scores(docs, pairs):
    import math
    import re

    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {d: [*brute.words(low(t)), None] for d, t in pairs}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    c = Counter(w for d, x in tokens.items() if not held[d] for w in x)
    n, v = sum(c.values()), len(c)
    got = by_id(language_model.score(docs))
    for d, x in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(x), sum(c[w] > 0 for w in x), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), rel_tol=1e-9)
        assert r["score"] <= 0


def test_held_out_scores_beat_the_base(spark, sf):
    rows = language_model.score(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_language_model_odd_and_empty(odd, empty):
    rows = language_model.score(odd).collect()
    assert len(rows) == odd.count() and all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert language_model.score(empty).collect() == []


# -- mixing --


def test_mix_meets_its_targets(docs, pairs):
    rows = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for d, t in pairs:
        sizes[source[d]] += len(brute.words(t))
    want = brute.targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 1, 1, 1], [5, 0, 7], [1, 2, 3, 4, 5, 6, 7, 1000, 1, 1], [0, 0]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute.targets({f"s{i}": n for i, n in enumerate(sizes)}) if sum(sizes) else dict.fromkeys(got, 0)
    assert got == pytest.approx(want)


def test_mixed_documents(odd, empty, docs):
    assert mixing.mix(empty).collect() == []
    assert mixing.mix(odd).count() == odd.count()
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert Counter(r["doc_id"] for r in rows.collect()) == {d: n for d, n in copies.items() if n}
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixed(odd).count() == mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert mixing.mixed(empty).collect() == []


# -- secrets --


def test_secrets(docs, pairs):
    got = by_id(secrets.report(docs))
    for d, t in pairs:
        r = got[d]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.secrets(t), d
        base = [s for s in r["spans"].split(",") if s and not s.startswith("live")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


def test_owners_decide(spark):
    rows = [(i, f"key Zx{'9aB' * 8} end", "abc"[i]) for i in range(3)] + [(10, f"key Yq{'8cD' * 8} end", "a"), (11, f"key Yq{'8cD' * 8} end", "a")]
    got = by_id(secrets.report(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert [got[i]["spans"] for i in (0, 1, 2)] == [""] * 3
    assert got[10]["spans"] == got[11]["spans"] == "live:4:30"


def test_many_matches(spark):
    text = "é token=abcdefgh," * 700
    (r,) = secrets.report(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")).collect()
    assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.secrets(text)


def test_redaction(docs, odd, empty, pairs):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    got = by_id(out)
    assert got[10]["text"] == 'say [secret]"; [secret] [secret] secret=abc'
    assert got[10]["n_chars"] == len(got[10]["text"])
    for d, t in pairs:
        if d not in (10, 11):
            assert got[d]["text"] == t
    assert secrets.redact(odd).count() == odd.count()
    assert secrets.redact(empty).collect() == secrets.report(empty).collect() == []


# -- near duplicates --


def test_jaccard_join(docs, pairs):
    want = brute.jaccard_groups(pairs)
    got = by_id(jaccard.join(docs))
    assert {d: (r["class_id"], r["n_links"]) for d, r in got.items()} == want
    assert want[3] == (2, 1) and want[5][0] == 4


def test_large_component(spark, monkeypatch):
    """A group over the block size is compared block by block."""
    monkeypatch.setattr(jaccard, "TOGETHER", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    base = [f"word{i}" for i in range(60)]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(5, 35)] + ["nothing alike here at all today"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(jaccard.join(df))
    assert {d: (r["class_id"], r["n_links"]) for d, r in got.items()} == brute.jaccard_groups(list(enumerate(texts)))


def test_recall_of_the_forest(spark):
    """Pairs just at the threshold, 0.80 to 0.82, are found."""
    import random

    r, rows, near = random.Random(5), [], 0
    for k in range(300):
        a = [f"x{k}_{i}" for i in range(r.randint(95, 104))]
        b = list(a)
        at = r.randrange(10, 40)
        b[at], b[at + 45] = "changed", "too"  # ten shingles of either go
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        x, y = brute.shingles(rows[-2][1]), brute.shingles(rows[-1][1])
        near += 0.8 <= len(x & y) / len(x | y) <= 0.82
    got = by_id(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")))
    found = sum(got[2 * k + 1]["class_id"] == 2 * k for k in range(300))
    assert near == 300 and found >= 299


def test_crowded_nodes_use_whole_labels_and_go_back(spark, monkeypatch):
    """Crowds are cut at whole labels where the recall allows it; links are the same."""
    monkeypatch.setattr(jaccard, "CROWD", 3)
    common = [f"c{i}" for i in range(70)]
    rows = [(i, " ".join([*common[:50], *(f"u{i}_{j}" for j in range(30))])) for i in range(40)]  # alike at 0.4
    rows += [(100 + i, " ".join([*common[20:], f"n{i}", *(f"z{j}" for j in range(60))])) for i in range(30)]  # near copies
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(jaccard.join(docs))
    assert {d: (r["class_id"], r["n_links"]) for d, r in got.items()} == brute.jaccard_groups(rows)
    classes = jaccard.signed(docs).withColumnRenamed("doc_id", "rep")
    short = jaccard.shortest_prefix(0.8)
    spared = jaccard.spared_trees(0.8, short)
    assert short < jaccard.DEEPEST and 0 < spared < jaccard.TREES
    nodes = jaccard.met(classes, short, spared)
    whole, kept = nodes.filter("tree < 0").count(), nodes.filter("tree >= 0 and size > 3").count()
    assert kept > 0  # the near copies are crowded everywhere
    assert whole + kept > 0 and jaccard.met(classes, short, jaccard.TREES).filter("tree < 0").count() >= whole


def test_jaccard_odd_and_empty(odd, empty, docs):
    rows = jaccard.join(odd).collect()
    assert len(rows) == odd.count()
    assert {r["n_links"] for r in rows if r["doc_id"] == 1} >= {2}
    assert jaccard.join(empty).collect() == []
    out = jaccard.distinct(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in out.select("doc_id").collect()} == {3, 5}
    left = jaccard.distinct(odd)
    assert left.columns == odd.columns
    # One row of each group, whatever ids repeat; those without words all stay.
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:20]) for r in left.collect())
    texts = {r["text"] for r in odd.collect()}
    groups = brute.jaccard_groups(list(enumerate(sorted(filter(None, texts)))))
    assert len(kept) == len({g for g, _ in groups.values()}) + sum(r["text"] is None for r in odd.collect())
    assert len(kept) == len(set(kept))
    assert jaccard.distinct(empty).collect() == []


# -- repeated substrings --


def test_suffix_levels(docs, pairs):
    got = by_id(suffixes.dedup(docs))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == brute.dedup_bytes(pairs)
    assert sum(r["n_removed"] > 0 for r in got.values()) > 4


@pytest.mark.parametrize("seed", range(4))
def test_suffix_levels_on_periodic_texts(spark, seed, monkeypatch):
    import random

    monkeypatch.setattr(rounds, "BLOCK_BYTES", 100)
    r = random.Random(seed)
    unit = ["".join(r.choices("ab", k=r.randint(1, 90))) for _ in range(4)]
    rows = [(i, "".join(r.choice(unit) * r.randint(1, 6) for _ in range(r.randint(1, 9)))) for i in range(12)]
    got = by_id(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for d, x in got.items()} == brute.dedup_bytes(rows)
    words = [(d, " ".join(t)) for d, t in rows]
    got = by_id(substrings.dedup(spark.createDataFrame(words, "doc_id long, text string")))
    assert {d: (x["n_words"], x["n_removed"], x["kept_sha256"]) for d, x in got.items()} == brute.dedup_words(words)


def test_suffixes_odd_and_empty(odd, empty):
    assert suffixes.dedup(odd).count() == odd.count()
    assert suffixes.dedup(empty).collect() == []


def test_level_family():
    family, r = rounds.LevelFamily(), np.random.default_rng(3)
    seen: Counter = Counter()
    for _ in range(20):
        keys = r.integers(0, 500, 60).astype(np.uint64)
        fresh = family.add(keys, np.zeros(60, dtype=bool))
        assert {int(k) for k in keys[fresh]} == {int(k) for k in keys} - set(seen)
        seen.update(int(k) for k in keys)
    every = np.arange(500, dtype=np.uint64)
    assert (family.marked(every) == [seen[k] > 1 for k in range(500)]).all()
    sizes = [len(level[0]) for level in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


# -- sharding --


def test_shards(docs, pairs):
    rows = by_id(sharding.shard_documents(docs))
    slots = defaultdict(list)
    for d, t in pairs:
        r = rows[d]
        assert (r["size"], r["text_crc32"], r["law"]) == (len((t or "").encode()) + 1, brute.crc(t), "key")
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_growth(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    out = sharding.assign_shard(sharding.assign_shard(ids, "doc_id", sharding.tree(8), "a"), "doc_id", sharding.tree(9), "b")
    n = {r["a"]: r["n"] for r in out.groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sorted(n) == list(range(8)) and all(abs(x - 2500) < 300 for x in n.values())
    assert out.filter("a <> b and b <> 8").count() == 0
    assert abs(out.filter("b = 8").count() - 20_000 / 9) < 300


def plain_shard(key, topology):
    """The descent by smallest weighted draws, in plain Python."""
    import math

    weight = lambda x: sum(map(weight, x.values())) if isinstance(x, dict) else x
    while isinstance(topology, dict):
        draws = []
        for name, child in topology.items():
            u = (int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16) + 0.5) / float(1 << 52)
            draws.append((-math.log(u) / weight(child), name))
        name = min(draws)[1] if len(draws) > 1 else next(iter(topology))
        topology = topology[name]
    return int(name)


def test_shards_follow_the_draws(spark):
    unequal = {"east": {"e1": {"0": 1.0, "1": 3.0}, "e2": {"2": 0.5}}, "west": {"w1": {"3": 2.0, "4": 0.25, "5": 1.0}}}
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    for topology in (unequal, sharding.tree(8), sharding.tree(11)):
        got = {r["doc_id"]: r["s"] for r in sharding.assign_shard(ids, "doc_id", topology, "s").collect()}
        assert got == {i: plain_shard(i, topology) for i in range(3000)}


def test_changed_weights_move_keys_of_their_subtree_only(spark):
    before = {"east": {"e1": {"0": 1.0, "1": 1.0}, "e2": {"2": 1.0, "3": 1.0}}, "west": {"w1": {"4": 2.0, "5": 2.0}}}
    after = {"east": {"e1": {"0": 0.5, "1": 1.5}, "e2": {"2": 1.0, "3": 1.0}}, "west": {"w1": {"4": 2.0, "5": 2.0}}}
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    moved = sharding.assign_shard(sharding.assign_shard(ids, "doc_id", before, "a"), "doc_id", after, "b")
    n = {(r["a"], r["b"]): r["count"] for r in moved.groupBy("a", "b").count().collect()}
    assert {k for k in n if k[0] != k[1]} == {(0, 1)}  # weights within a rack changed, its own did not
    share = {s: sum(v for k, v in n.items() if k[1] == s) / 40_000 for s in range(6)}
    assert all(abs(share[s] - w / 8) < 0.01 for s, w in zip(range(6), (0.5, 1.5, 1, 1, 2, 2)))
    heavier = {"east": {"e1": {"0": 1.0, "1": 1.0}, "e2": {"2": 1.0, "3": 1.0}}, "west": {"w1": {"4": 2.0, "5": 6.0}}}
    moved = sharding.assign_shard(sharding.assign_shard(ids, "doc_id", before, "a"), "doc_id", heavier, "b")
    pairs = {(r["a"], r["b"]) for r in moved.filter("a <> b").select("a", "b").distinct().collect()}
    assert pairs <= {(a, b) for a in (0, 1, 2, 3) for b in (4, 5)} | {(4, 5)}


def test_shards_of_a_long_text(spark):
    (r,) = sharding.shard_documents(spark.createDataFrame([(1, "é" * 3_000_000)], "doc_id long, text string")).collect()
    assert r["size"] == 6_000_001 and r["text_crc32"] == brute.crc("é" * 3_000_000)


def test_shards_odd_and_empty(odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == odd.count()
    assert sharding.shard_documents(empty).collect() == []
