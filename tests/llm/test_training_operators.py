"""Every operator of the subpackage on small tables: against brute force, and with nulls, ties, repeats and no rows."""

from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swarmscope.llm import ann, jaccard_join, lang_id, mixing, ngram_lm, packing, quality, sharding, token_files, vector_dedup
from swarmscope.llm.components import components
from swarmscope.llm.queries import remainder
from swarmscope.llm.storage import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat and the dog went over the old bridge to see what was there and then came home again in the evening".split()
DE = "die katze und der hund gingen über die alte brücke um zu sehen was dort war und kamen am abend wieder nach hause".split()


def sentence(words: list[str], seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(words, n))


def table() -> list[tuple]:
    rows = [(i, sentence(EN, i, 30 + i % 50), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, sentence(DE, i, 30 + i % 50), "de", "s0", 1) for i in range(40)]
    rows += [(200, rows[0][1], "en", "s1", 1), (201, rows[0][1], "en", "s1", 1)]
    rows += [(300, None, None, None, None), (301, "", "en", None, 0), (302, " \t\n ", "en", "s9", 3), (303, "Ünïcode 123 !!! 日本", None, "", 1)]
    rows += [(304, "x", "en", "s1", 1), (305, "word " * 9000, "en", "s2", 1), (306, "123 456", "en", "s2", 1)]
    rows += [(None, "no id here at all", "en", "s1", 1), (None, None, None, None, None), (307, "same row", "en", "s1", 1), (307, "same row", "en", "s1", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# sharding


def test_sharding_law_and_slots(docs, empty):
    for frame, n in ((docs, len(table())), (empty, 0)):
        out = sharding.shard(frame.withColumn("shard", F.lit("clash")), [F.col("doc_id"), F.col("text"), F.col("shard")], 16, block_rows=5).toPandas()
        assert len(out) == n
        sizes = out.groupby("shard")["slot"].apply(sorted)
        assert all(s == list(range(len(s))) for s in sizes)
        assert not n or max(map(len, sizes)) - min([*map(len, sizes), n // 16]) <= 1


def test_hypergeometric_draws():
    rng = np.random.default_rng(1)
    drawn = np.array([sharding.draw(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(drawn.mean() - 6) < 0.15 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    big = sharding.draw(rng, 10**11, 3 * 10**11, 10**6)
    assert abs(big - 250_000) < 10 * math.sqrt(10**6 * 3 / 16)
    m = sharding.matrix([5, 0, 11], [4, 4, 8], 3)
    assert m.sum(axis=1).tolist() == [5, 0, 11] and m.sum(axis=0).tolist() == [4, 4, 8]


def test_sharding_is_uniform(spark):
    rows = spark.range(400).toDF("doc_id")
    places = Counter()
    for seed in range(6):
        for r in sharding.shard(rows, [F.col("doc_id")], 4, seed).collect():
            places[r["doc_id"] < 200, r["shard"]] += 1
    assert all(abs(v - 300) < 75 for v in places.values())


# mixing


def targets(sizes: dict, weights=(3, 1, 2)) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        share = {s: (budget - sum(fixed.values())) * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing_targets_and_takes(docs):
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("size"), mixing.row_hash().alias("row_hash"))
    out = mixing.with_copies(sized, mixing.thresholds(sized)).toPandas()
    want = Counter()
    for r in table():
        want[r[3]] += len(words(r[1]))
    goal = targets(dict(want))
    assert len(out) == len(table())
    for source, rows in out.groupby(out["source"].where(out["source"].notna(), "<null>")):
        source = None if source == "<null>" else source
        assert rows["target"].iloc[0] == pytest.approx(goal[source])
        assert abs((rows["size"] * rows["mix_copies"]).sum() - goal[source]) <= rows["size"].max()
        assert rows["mix_copies"].between(0, 2).all()


def test_mixing_nests_and_repeats(docs, empty):
    a = mixing.mix_sources(docs, share=0.5).toPandas()
    assert a.equals(mixing.mix_sources(docs, share=0.5).toPandas().sort_index()) or sorted(map(str, a.values.tolist())) == sorted(map(str, mixing.mix_sources(docs, share=0.5).toPandas().values.tolist()))
    few, more = ({(r.doc_id, r.text) for r in mixing.mix_sources(docs, weights=(1, 1, 1), share=s).collect()} for s in (0.3, 0.6))
    assert few <= more
    assert mixing.mix_sources(empty).count() == 0


# packing


def test_packing_keeps_everything(docs, empty):
    out = packing.pack_documents(docs, mixing.word_count("text") + 1, group_pieces=40).toPandas()
    assert out["n_tokens"].sum() == sum(len(words(r[1])) + 1 for r in table())
    for _, s in out.groupby("sequence"):
        s = s.sort_values("offset")
        assert s["offset"].iloc[0] == 0 and (s["offset"].iloc[1:].values == (s["offset"] + s["n_tokens"]).iloc[:-1].values).all()
        held, length = s["n_tokens"].sum(), s["sequence_length"].iloc[0]
        assert length == min(c for c in packing.PERMITTED if c >= held)
    long = out[out["doc_id"] == 305].sort_values("piece")
    assert long["n_tokens"].sum() == 9001 and (long["start"].values == 4096 * np.arange(3)).all()
    assert packing.pack_documents(empty, mixing.word_count("text") + 1).count() == 0
    assert packing.sequences(packing.pack_documents(docs, mixing.word_count("text") + 1)).agg(F.sum("n_tokens")).first()[0] == out["n_tokens"].sum()


def test_packing_fit_and_choice():
    bins, offsets, sizes = packing.pack(np.array([900, 100, 60, 40]), (512, 1024), 64, 10**9)
    assert bins.tolist() == [0, 0, 1, 1] and offsets.tolist() == [0, 900, 0, 60] and sizes.tolist() == [1024, 512]
    # best fit: the bin with the least room that still holds the piece
    bins, _, _ = packing.pack(np.array([700, 600, 300]), (1024,), 0, 10**9)
    assert bins[2] == 0
    assert packing.pack(np.zeros(0, np.int64), (512,), 0, 1)[2].tolist() == []


# nearest neighbours and near-duplicate vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=300, dims=16):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dims))
    x[50:90] = x[:40] + 0.05 * rng.standard_normal((40, dims))
    x[90:110] = x[5]
    rows = [(i, [float(c) for c in v], i % 3 if i < 280 else None) for i, v in enumerate(x.astype(np.float32))]
    rows += [(1000, None, 1), (1001, [0.0] * dims, 1), (1002, [float("nan")] * dims, 1), (1003, [None] * dims, 1), (1004, [float("inf")] + [1.0] * (dims - 1), 1), (None, [1.0] * dims, 1), (1020, [], 1)]
    return spark.createDataFrame(rows, VECTORS), x.astype(np.float32).astype(float)


def test_nearest(spark):
    frame, x = vectors(spark)
    out = ann.nearest(frame.withColumn("score", F.lit(1)), F.col("vec_id") % 20 == 0, k=10).toPandas().sort_values(["query_id", "rank"])
    hits = 0
    for q, rows in out.groupby("query_id"):
        assert q % 20 == 0 and q < 300
        assert rows["rank"].tolist() == list(range(1, 11)) and q not in set(rows["vec_id"])
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        assert rows["score"].values == pytest.approx(s[rows["vec_id"].values])
        assert [*zip(-rows["score"], rows["vec_id"], strict=True)] == sorted(zip(-rows["score"], rows["vec_id"], strict=True))
        hits += len(set(np.lexsort((np.arange(300), -s))[:10]) & set(rows["vec_id"]))
    assert out["query_id"].nunique() == 15 and hits >= 0.9 * 150


def test_nearest_small_and_empty(spark):
    frame = spark.createDataFrame([(20 * i, [1.0 + i, -1.0], 0) for i in range(4)], VECTORS)
    out = ann.nearest(frame, F.lit(True)).toPandas()
    assert len(out) == 12  # all candidates, as they are fewer
    assert ann.nearest(frame.limit(0), F.lit(True)).count() == 0


def test_vector_dedup(spark):
    frame, x = vectors(spark)
    out = vector_dedup.link_vectors(frame, chunk=16).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(300) % 3
    linked = (u @ u.T >= 0.98) & (label[:, None] == label[None]) & (np.arange(300) < 280)[:, None] & (np.arange(300) < 280)
    np.fill_diagonal(linked, False)
    known = out[out["vec_id"] < 1000].sort_values("vec_id")
    assert known["n_links"].tolist() == linked.sum(axis=1).tolist()
    root = np.arange(300)
    for _ in range(300):
        root = np.array([min([root[i], *root[np.flatnonzero(linked[i])]]) for i in range(300)])
    assert known["component_id"].tolist() == root.tolist()
    assert len(out) == frame.count() and (out[out["vec_id"] >= 1000]["n_links"] == 0).all()
    assert (known["kept"] == (known["vec_id"] == known["component_id"])).all() and not out[out["vec_id"].isna()]["kept"].any()
    assert vector_dedup.link_vectors(frame.limit(0)).count() == 0


def test_needed_collisions_is_calibrated():
    n = vector_dedup.needed_collisions(21, 2.0, 0.999)
    rng = np.random.default_rng(0)
    assert ((np.abs(rng.standard_normal((200_000, 21))) <= 2).sum(axis=1) >= n).mean() >= 0.998


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {n: root(n) for n in parent if root(n) != n} == found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Jaccard join


def brute_components(rows: list[tuple], width: int, percent: int) -> dict:
    sets = {}
    for i, text, *_ in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return {i: (len(sets[i]), root[i]) for i in sets}


def near_copies() -> list[tuple]:
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(8, 150))))
        for _ in range(int(rng.integers(1, 30))):
            copy = list(base)
            for k in rng.integers(0, len(copy), int(rng.integers(0, max(2, len(copy) // 12)))):
                copy[k] = f"x{rng.integers(10**6)}"
            rows.append((n, (" " if n % 2 else "\n").join(copy).upper() if n % 5 == 0 else " ".join(copy), "en", "s", 1))
            n += 1
    return rows


def test_jaccard_join_bounds_the_memory_of_a_bucket():
    random, percent, buckets = np.random.default_rng(7), 80, 40
    order = jaccard_join.Order(5, percent, buckets, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sets = [np.unique(random.integers(0, 2**63, 2000, dtype=np.uint64)) for _ in range(1500)]
    sets[900] = np.unique(np.concatenate([sets[100][:1950], sets[900][:40]]))
    names = np.arange(len(sets)) * 10
    blobs: dict[int, list[bytes]] = {}
    for i in range(0, len(sets), 100):
        some = sets[i : i + 100]
        for bucket, blob in jaccard_join.postings(order, np.concatenate(some), np.cumsum([0] + [len(x) for x in some]), names[i : i + 100]):
            blobs.setdefault(bucket, []).append(blob)
    held = [sum(x.nbytes for blob in own for x in jaccard_join.unpacked(blob)) for own in blobs.values()]
    links = set()
    for own in blobs.values():
        tracemalloc.start()
        a, b, n, m = jaccard_join.may_link([pa.py_buffer(blob) for blob in own], percent)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        links |= {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
        assert set(n.tolist() + m.tolist()) <= {len(sets[100]), len(sets[900])}
        assert most < 1.5 * max(held)
    assert links == {(1000, 9000)}
    # sketches fill buckets too, the more of them the more buckets there are: a bucket of 1.5 million postings had over 200 MB
    texts, long = (2_600_000, 2_600_000 * 250, 256), (60_000, 60_000 * 9000, 16_000)
    many = jaccard_join.bucket_count([texts, long], percent, 1_500_000)
    postings = [sets * 0.21 * n / sets for sets, n, _ in (texts, long)]
    places = [sets * min(0.21 * n / sets, many) for sets, n, _ in (texts, long)]
    assert 16 * sum(postings) + places[0] * (16 + 64) + places[1] * (16 + 64 * 32) < 1.05 * many * 2**26
    assert jaccard_join.bucket_count([(100, 3000, 60)], percent, 1_500_000) == 1
    assert jaccard_join.bucket_count([], percent, 1_500_000) == 1


def test_jaccard_join_posts_what_may_meet(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(300)) for i in range(60)]
    texts[40] = texts[3].replace("w3x200 ", "")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    order = jaccard_join.order_of(jaccard_join.described_sets(frame, 5), 5, 80, 10**6, frame)
    sets = [jaccard_join.W.shingles(*next(jaccard_join.W.documents(pa.array([t])))[2:], 5)[0] for t in texts]
    posted = [x for _, blob in jaccard_join.postings(order, np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets]), np.arange(60)) for x in jaccard_join.unpacked(blob)[2].tolist()]
    twice = [x for x, n in Counter(posted).items() if n > 1]
    assert 40 < len(twice) and len(posted) < 2 * len(twice) + 0.1 * 60 * 60
    assert jaccard_join.root_links(frame, order).count() == 1
    out = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(frame, 5, 80).collect()}
    assert out == {i: 3 if i == 40 else i for i in range(60)}


@pytest.mark.parametrize(("width", "percent", "bucket_postings", "task_shingles"), [(4, 85, 700, 900), (4, 85, 10**6, 10**6), (5, 80, 5000, 300)])
def test_jaccard_join_is_exact(spark, width, percent, bucket_postings, task_shingles):
    rows = near_copies() + [r for r in table() if r[0] is not None and r[0] != 307]
    rows = [(10_000 + i if r in table() else r[0], *r[1:]) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(frame, width, percent, bucket_postings, task_shingles).collect()}
    assert out == brute_components(rows, width, percent)


def test_jaccard_join_edges(docs, empty):
    out = jaccard_join.jaccard_join(docs.withColumn("name", F.lit(1)).withColumn("n", F.lit(2))).toPandas()
    assert len(out) == len(table()) and out[out["doc_id"].isna()]["component_id"].isna().all()
    assert set(out[out["doc_id"].isin([0, 200, 201])]["component_id"]) == {0}
    assert set(out[out["doc_id"].isin([300, 301, 302])]["n_shingles"]) == {0}
    assert jaccard_join.jaccard_join(empty).count() == 0


def clouds(seed: int, groups: int, copies: int, edits: float) -> list[np.ndarray]:
    """Sets around some centres, at distances from nearly 0 to well beyond the linking distance."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = rng.integers(1, 2**63, int(rng.integers(20, 120)), dtype=np.uint64)
        for _ in range(copies):
            keep = centre[rng.random(len(centre)) > edits * rng.random()]
            out.append(np.unique(np.concatenate([keep, rng.integers(1, 2**63, int(edits * len(centre) * rng.random()) + 1, dtype=np.uint64)])))
    return out


def plain_groups(sets: list[np.ndarray], percent: int) -> list[int]:
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(x, sets[j]))
            if group[i] != group[j] and 100 * common >= percent * (len(x) + len(sets[j]) - common):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


@pytest.mark.parametrize(("seed", "copies", "edits", "percent"), [(1, 90, 0.1, 85), (2, 60, 0.3, 85), (3, 150, 0.2, 80), (4, 200, 0.15, 90)])
def test_region_join_is_exact(seed, copies, edits, percent):
    sets = clouds(seed, 3, copies, edits)
    x, y = jaccard_join.region_links(sets, np.zeros(len(sets), bool), percent)
    a, b = jaccard_join.forest(x, y)
    group = np.arange(len(sets))
    group[a] = b
    assert group.tolist() == plain_groups(sets, percent)
    assert len(x) == len(sets) - len(set(group.tolist()))  # a forest


def test_pivots_lose_no_link():
    sets = clouds(7, 6, 40, 0.3)
    own = jaccard_join.voronoi(sets, jaccard_join.Pivots.of(sets[::35]), 85)
    regions = [set(own.region[own.member == i].tolist()) for i in range(len(sets))]
    assert all(regions) and sum(map(len, regions)) < 4 * len(sets)
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(x, sets[j]))
            assert 100 * common < 85 * (len(x) + len(sets[j]) - common) or regions[i] & regions[j]


def test_groups_of_copies_have_linear_output(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1200):
        copy = list(base)
        copy[int(rng.integers(120))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    described = jaccard_join.described_sets(frame, 4)
    assert jaccard_join.root_links(frame, jaccard_join.order_of(described, 4, 85, 10**6)).count() < 1300
    out = jaccard_join.jaccard_join(frame, task_shingles=9000)
    assert {r["component_id"] for r in out.collect()} == {0}


@pytest.mark.parametrize("n", [300, 520, 3000, 60_000, 4_000_000])
def test_counts_never_understate_what_is_common(n):
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 2**63, n // 50).astype(np.uint64)]))
    sizes = np.array([len(a), len(b)])
    wide = jaccard_join.COUNTS << jaccard_join.class_of(sizes)
    flat = [np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) & (w - 1), minlength=w), 255).astype(np.uint8) for s, w in zip((a, b), wide, strict=True)]
    most = jaccard_join.Sketches(sizes, np.concatenate(flat)).common_at_most(np.array([0, 0]), np.array([1, 0]))
    assert most[0] >= len(np.intersect1d(a, b)) and most[1] >= len(a)


# classifiers


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(5)
    good = [(1000 + i, sentence(EN, i, 40), "en", "s", 1) for i in range(120)]
    bad = [(2000 + i, "".join(rng.choice(list("$%&#* "), 160)), "en", "s", 1) for i in range(60)]
    frame = spark.createDataFrame(good + bad + table(), DOCS)
    marks = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(None, 1), (1000, None), (77777, 0), (300, 1), (300, 0)], "doc_id long, quality int")
    voter = quality.fit(frame, marks, remainder(5) != 0)
    out = quality.score(frame.withColumn("quality_score", F.lit("clash")), voter).toPandas()
    assert len(out) == frame.count() and out["quality_score"].between(0, 1).all()
    assert (out[out["doc_id"].between(1000, 1119)]["quality_score"] >= 0.3).all()
    assert (out[out["doc_id"].between(2000, 2059)]["quality_score"] < 0.3).all()
    assert out[out["doc_id"].isin([300, 301])]["quality_score"].nunique() == 1
    assert quality.score(empty, voter).count() == 0
    untaught = quality.fit(empty, marks.limit(0), F.lit(True))
    assert set(quality.score(docs, untaught).toPandas()["quality_score"]) == {1.0}


def test_quality_votes_by_blocks_equal_single_votes():
    from pyarrow import array

    counts = np.concatenate([*quality.blocks(array([r[1] for r in table()]))])
    one = np.concatenate([c for r in table() for c in quality.blocks(array([r[1]], "string"))])
    assert (counts == one).all()


def ppm_bits(text: str, train: list[str]) -> float:
    """Code length under the counts of ``train``, one byte at a time."""
    counts = [Counter() for _ in range(4)]
    for t in train:
        b = b"\0\0\0" + t.encode()
        for i in range(3, len(b)):
            for k in range(4):
                counts[k][b[i - k : i], b[i]] += 1
    bits, b = 0.0, b"\0\0\0" + text.encode()
    for i in range(3, len(b)):
        for k in (3, 2, 1, 0):
            seen = {s: n for (c, s), n in counts[k].items() if c == b[i - k : i]}
            if b[i] in seen:
                bits -= math.log2(seen[b[i]] / (sum(seen.values()) + len(seen)))
                break
            if seen:
                bits -= math.log2(len(seen) / (sum(seen.values()) + len(seen)))
        else:
            bits += 8
    return bits


def test_language(docs, empty):
    trees = lang_id.fit(docs, F.lit(True))
    out = lang_id.predict(docs.withColumn("lang_score", F.lit(0)), trees).toPandas()
    real = out[out["doc_id"].between(0, 139)]
    assert len(out) == len(table()) and (real["lang"] == real["lang_pred"]).all() and (real["lang_score"] > 0.9).all()
    assert set(out[out["doc_id"].isin([300, 301, 302, 306])]["lang_pred"]) == {"und"} and set(out[out["doc_id"].isin([300, 301])]["lang_score"]) == {0.0}
    assert set(lang_id.predict(docs, lang_id.fit(empty, F.lit(True))).toPandas()["lang_pred"]) == {"und"}
    assert lang_id.predict(empty, trees).count() == 0


def test_code_lengths_are_exact():
    train = {"de": [" ".join(DE), "ßßß"], "en": [" ".join(EN), "zz"]}
    counted = []
    for lang in ("de", "en"):
        data = [np.frombuffer(t.encode(), np.uint8) for t in train[lang]]
        codes = np.concatenate([lang_id.grams(d, np.array([0, len(d)]))[0] for d in data])
        counted.append(tuple(x for x in np.unique(codes, return_counts=True)))
    trees = lang_id.Trees(["de", "en"], np.array([2.0, 2.0]), counted)
    for text in ("the old katze", "brücke 42 zzz", "日本", "q"):
        data = np.frombuffer(text.encode(), np.uint8)
        got = trees.bits(data, np.array([0, len(data)]))[0]
        assert got == pytest.approx([ppm_bits(text, train["de"]), ppm_bits(text, train["en"])], rel=1e-5)


# language model


def test_language_model(docs, empty):
    learns = remainder(7) != 2
    model = ngram_lm.fit(docs, learns, tokens_per_shard=700)
    assert model.shards > 3
    out = ngram_lm.score(docs.withColumn("score", F.lit("clash")), model).toPandas()
    train = [[*words(r[1]), None] for r in table() if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(t, t[1:], strict=False))
    three = Counter(p for t in train for p in zip(t, t[1:], t[2:], strict=False))
    n, v, d = sum(one.values()), len(one), ngram_lm.DISCOUNT
    after, kinds = Counter(), Counter()
    for c in (two, three):
        for gram, k in c.items():
            after[gram[:-1]] += k
            kinds[gram[:-1]] += 1

    def p(gram: tuple) -> float:
        if len(gram) == 1:
            return max(one[gram[0]] - d, 0) / n + d * v / n / (v + 1)
        if not after[gram[:-1]]:
            return p(gram[1:])
        seen = two[gram] if len(gram) == 2 else three[gram]
        return max(seen - d, 0) / after[gram[:-1]] + d * kinds[gram[:-1]] / after[gram[:-1]] * p(gram[1:])

    assert len(out) == len(table())
    by_text = out.assign(text=out["text"].where(out["text"].notna(), None)).set_index("doc_id")
    for r in table():
        if r[0] is None or r[0] in (305, 307):
            continue
        t = [*words(r[1]), None]
        row = by_text.loc[r[0]]
        assert row["n_tokens"] == len(t) and row["n_known"] == sum(one[w] > 0 for w in t)
        assert row["base_score"] == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t))
        exact = sum(math.log10(p(tuple(t[max(0, i - 2) : i + 1]))) for i in range(len(t)))
        assert abs(row["score"] - exact) <= 0.04 * len(t)
    nothing = ngram_lm.score(docs, ngram_lm.fit(empty, F.lit(True))).toPandas()
    assert (nothing["score"] == 0).all() and (nothing["base_score"] == 0).all()
    assert ngram_lm.score(empty, model).count() == 0


# token files

tokenizers = pytest.importorskip("public_tokenizers")


def test_token_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    manifest = token_files.write(docs, new_path(spark, "tokens"), tokenizers.path("byte_bpe_50k.json"), bytes_per_file=2000)
    assert manifest.count() > 3
    out = token_files.read(manifest).toPandas()
    ids = {}
    for r in table():
        ids.setdefault(r[0], []).append([*plain.encode(r[1] or "", add_special_tokens=False).ids, 2])
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    known = out[out["doc_id"].notna()].sort_values(["start"])
    assert known["doc_id"].is_monotonic_increasing and len(out) == len(table())
    assert (out.sort_values("start")["start"].diff().iloc[1:].values == out.sort_values("start")["n_tokens"].iloc[:-1].values).all()
    for i, rows in ids.items():
        got = out[out["doc_id"].isna()] if i is None else out[out["doc_id"] == i]
        assert sorted(got["ids_crc32"]) == sorted(map(crc, rows)) and sorted(got["n_tokens"]) == sorted(map(len, rows))
    assert token_files.read(token_files.write(empty, new_path(spark, "tokens"), tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_encoder_equals_the_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    texts = ["a  b", " lead", "trail ", "two\n\nlines", "tab\tx", "it's we'll\nI'm", "x\u2003y\u00a0z \u3000 w", "日本 語\nx", "<|endoftext|> a <|endoftext|>b", "\n", "  ", "a\x1cb c", "123 4five6\n789", "é́ e", "one", "a \nb", "!?\n?! ..", "", "x\u0085y", "naïve café\nÀ la"]
    texts += [t + " again " + t for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for by_space in (True, False):
        out = token_files.read(token_files.write(frame, new_path(spark, "tokens"), tokenizers.path("byte_bpe_50k.json"), by_space=by_space, stretches_per_file=7)).toPandas().sort_values("doc_id")
        want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert out["n_tokens"].tolist() == [len(x) for x in want]
        assert out["ids_crc32"].tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


def test_elias_fano():
    from swarmscope.llm.elias_fano import EliasFano, pack_bits, small, unpack_bits, unsmall

    rng = np.random.default_rng(6)
    for values in (np.zeros(0, int), np.array([0]), np.array([7, 7, 7]), np.sort(rng.integers(0, 10**12, 5000)), np.cumsum(rng.integers(0, 3, 70_000)), np.array([0, 2**40])):
        e = EliasFano.of(values, 64)
        assert (e.all() == values).all()
        some = rng.integers(0, len(values), 300) if len(values) else np.zeros(0, int)
        assert (e.get(some) == values[some]).all()
        assert not len(values) or e.low.nbytes + e.high.nbytes <= len(values) * (3 + max(1, math.ceil(math.log2(max(2, values[-1] / len(values)))))) / 8 + 32
    packed = rng.integers(0, 2**23, 70_001)
    assert (unpack_bits(pack_bits(packed, 23), 23, np.arange(70_001)) == packed).all()
    counts = rng.integers(0, 600, 1000)
    assert (unsmall({f"c.{k}": v for k, v in small(counts).items()}, "c") == counts).all()


def test_token_files_are_cut_by_bytes(spark):
    rows = [(i * 10**15 - 10**17, "one two " * (i % 7)) for i in range(200)] + [(5, f"text number {i} " * 20) for i in range(150)] + [(2**63 - 1, "last"), (-(2**63), "first")]
    rows += [(None, f"none {i} " * 30) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = token_files.write(frame, new_path(spark, "tokens"), tokenizers.path("byte_bpe_50k.json"), bytes_per_file=4000).toPandas()
    assert manifest["n_docs"].sum() == len(rows) and len(manifest) > 15
    # ids that repeat too often spread over several files, by text
    held = [token_files.TokenFile(token_files.read_bytes(p)) for p in manifest["path"]]
    assert sum(5 in h.doc_ids() for h in held) > 5 and manifest["null_ids"].sum() > 2
    assert manifest["n_ids"].max() < 4 * 4000
    ids = np.concatenate([h.doc_ids() for h, null in zip(held, manifest["null_ids"], strict=True) if not null])
    assert (np.sort(ids) == ids).all() and sorted(ids.tolist()) == sorted(i for i, _ in rows if i is not None)


def test_other_tokenizers_are_encoded_whole(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["It's a  test", "x", "", "naïve café\nÀ la"]
    out = token_files.read(token_files.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), new_path(spark, "tokens"), path)).toPandas().sort_values("doc_id")
    want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert out["ids_crc32"].tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
