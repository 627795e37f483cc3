import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecspark.functions import distance as D
from vecspark.operators import graph, ivf
from vecspark.operators import quantization as quant
from vecspark.operators import search as S
from vecspark.operators.search import batch_search, search, top_of_each
from vecspark.types import HnswConfig, InvalidDimension, InvalidPoint, SearchQuery

SCHEMA = "slot long, id string, vector array<float>, payload string"


def unit(i, dim):
    return [1.0 if j == i % dim else ((i * 7 + j * 13) % 100) * 0.001 for j in range(dim)]


def frame(spark, vectors):
    return spark.createDataFrame([(i, str(i), [float(x) for x in v], None) for i, v in enumerate(vectors)], SCHEMA)


def exact(vectors, q, metric):
    s = D.scores(metric, np.array([q]), np.array(vectors, np.float32))[0]
    return sorted(range(len(s)), key=lambda i: (-s[i], i))


def test_known_scores(spark):
    row = spark.range(1)
    of = lambda m, a, b: row.select(D.score(m, D.vector(a), D.vector(b))).first()[0]
    assert of("Euclid", [0, 0], [3, 4]) == pytest.approx(1 / 6)
    assert of("Manhattan", [1, 2, 3], [4, 5, 6]) == 0.25
    assert of("Dot", [1, 2, 3], [4, 5, 6]) == 32
    assert (of("Cosine", [1, 0], [1, 0]), of("Cosine", [1, 0], [0, 1]), of("Cosine", [1, 0], [-1, 0]), of("Cosine", [0, 0], [1, 1])) == (1, 0, -1, 0)


@pytest.mark.parametrize("metric", ["Cosine", "Euclid", "Dot", "Manhattan"])
def test_top_k_pages_and_batches_agree_with_a_full_ranking(spark, metric):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).astype(np.float32)
    points = frame(spark, vectors)
    want = [str(i) for i in exact(vectors, vectors[5], metric)]
    q = [float(x) for x in vectors[5]]
    pages = [r.id for o in (0, 25, 50) for r in search(points, SearchQuery(q, limit=25, offset=o, with_payload=False), metric, 8).collect()]
    assert pages == want
    asked = spark.createDataFrame([(5, q), (9, [float(x) for x in vectors[9]])], "qid long, vector array<float>")
    got = batch_search(points, asked, 7, metric, block=1).where("qid = 5").orderBy("rank").collect()
    assert [r.id for r in got] == want[:7]


def test_ties_keep_the_larger_slots_and_list_the_smaller_first(spark):
    points = frame(spark, [[1.0], [2.0], [1.0], [2.0], [1.0]])
    assert [r.id for r in search(points, SearchQuery([1.0], limit=3, with_payload=False), "Dot", 1).collect()] == ["1", "3", "4"]


def test_thresholds_count_and_bad_queries_fail(spark):
    points = frame(spark, [unit(i, 8) for i in range(10)])
    q = SearchQuery(unit(0, 8), limit=10, score_threshold=0.9, with_payload=False)
    assert {r.id for r in search(points, q, "Cosine", 8).collect()} == {"0", "8"}
    with pytest.raises(InvalidDimension):
        search(points, SearchQuery([1.0]), "Cosine", 8)
    with pytest.raises(InvalidPoint):
        search(points, SearchQuery([math.nan] * 8), "Cosine", 8)


def sample(n=400, dim=16):
    out = np.full((n, dim), -0.5)
    for i in range(n):
        out[i, (i // 50) % dim] = 1.0
        out[i] += [((i * 31 + j * 17) % 23) * 0.02 - 0.22 for j in range(dim)]
    return out.astype(np.float32)


def test_codes_reach_their_recall(spark):
    vectors = sample()
    points = frame(spark, vectors).cache()
    q = [float(x) for x in vectors[7]]
    truth = {r.id for r in search(points, SearchQuery(q, with_payload=False), "Cosine", 16).collect()}
    low, high = quant.scalar_range(points, 0.99, 16)
    values = quant.scalar_values(quant.scalar_codes(F.col("vector"), low, high), low, high)
    scalar = points.select("slot", "id", D.score("Cosine", values, D.vector(q)).alias("score"))
    own = quant.binary_words(D.vector(q), 16)
    binary = points.select("slot", "id", (-quant.hamming(quant.binary_words(F.col("vector"), 16), own)).cast("double").alias("score"))
    books = quant.product_codebooks(points, 4)
    product = quant.product_scores(quant.product_encode(points, books), books, q, "Cosine")
    for coarse, kind, more in ((scalar, "scalar", 2), (binary, "binary", 8), (product, "product", 5)):
        got = {r.id for r in quant.two_stage(coarse, points, q, "Cosine", 10, quant.coarse_width(kind, 10, 400, more)).collect()}
        assert len(truth & got) >= 8, kind


def test_binary_words_are_signs_for_any_dimension(spark):
    v = [1.0 if i % 3 == 0 else -1.0 for i in range(130)]
    words = spark.range(1).select(quant.binary_words(D.vector(v), 130)).first()[0]
    assert [words[i // 63] >> (i % 63) & 1 for i in range(130)] == [int(x > 0) for x in v]


def test_inverted_lists_find_blobs_and_drift(spark):
    vectors = [[(50.0 if i >= 15 else 0.0) + ((i % 7) * 0.1 + i * 0.003 if j == i % 8 else 0.0) for j in range(8)] for i in range(30)]
    points = frame(spark, vectors)
    centres = quant.kmeans(np.array(vectors), 4, 64)
    assigned = ivf.assign(points, centres, "Euclid").cache()
    near = ivf.probe(assigned, ivf.probe_order(vectors[20], centres, "Euclid"), 4)
    assert near.count() == 30
    mean = assigned.agg(F.avg("list_distance")).first()[0]
    assert ivf.drift(assigned, mean) == 0 and ivf.drift(assigned, mean / 2) == pytest.approx(1)


def test_graphs_find_what_an_exact_search_finds(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    points = frame(spark, vectors)
    config = HnswConfig(m=8, ef_construct=32)
    graphs = graph.build(points, "Euclid", config, shard=150).cache()
    hits = 0
    for i in range(0, 300, 60):
        got = graph.search(graphs, [float(x) for x in vectors[i]], "Euclid", config, 40).orderBy(F.desc("score")).limit(10).collect()
        hits += len({int(r.slot) for r in got} & set(exact(vectors, vectors[i], "Euclid")[:10]))
    assert hits >= 45
    allowed = points.where("slot % 2 = 0")
    assert all(r.slot % 2 == 0 for r in graph.search(graphs, [0.0] * 8, "Euclid", config, 20, allowed).collect())


@pytest.mark.parametrize("nprobe", [1, 3, 8])
def test_batches_probe_the_lists_that_single_searches_probe(spark, nprobe):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    centres = rng.normal(size=(8, 8))
    assigned = ivf.assign(frame(spark, vectors), centres, "Euclid").cache()
    queries = rng.normal(size=(20, 8))
    found = ivf.batch_probe(assigned, spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "qid long, vector array<double>"), centres, nprobe, 5, "Euclid")
    got = {i: [] for i in range(20)}
    for r in top_of_each(found, 5).orderBy("qid", "rank").collect():
        got[r.qid].append(r.slot)
    lists = {r.slot: r.list_id for r in assigned.select("slot", "list_id").collect()}
    for i, q in enumerate(queries):
        near = set(ivf.probe_order(q.tolist(), centres, "Euclid")[:nprobe])
        assert got[i] == [s for s in exact(vectors, q, "Euclid") if lists[s] in near][:5]


def test_links_are_counted_over_blocks_for_rows_of_all_classes(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 50)
    rng = np.random.default_rng(2)
    vectors = np.vstack([rng.normal(size=(210, 8)), np.zeros((1, 8))]).astype(np.float32)
    sizes = rng.integers(1, 5, len(vectors))
    classes = spark.createDataFrame([(i, [float(x) for x in v], int(n)) for i, (v, n) in enumerate(zip(vectors, sizes, strict=True))], "slot long, vector array<float>, size long")
    want = (D.scores("Cosine", vectors, vectors) >= 0.3) @ sizes
    assert dict(S.cosine_links(classes, 0.3).collect()) == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("metric", ["Cosine", "Euclid"])
def test_a_self_join_over_blocks_has_every_pair_both_ways(spark, monkeypatch, metric):
    monkeypatch.setattr(S, "ROWS", 16)
    monkeypatch.setattr(S, "CELLS", 200)
    vectors = np.random.default_rng(5).normal(size=(180, 8))
    vectors = np.vstack([vectors, vectors[:20], np.zeros((1, 8))])
    points = frame(spark, vectors)
    want = {tuple(r) for r in S.similarity_join(points, points.select(F.col("slot").alias("qid"), "vector"), 0.3, metric).collect() if str(r.qid) != r.id}
    for block in (45, 1000):
        found = [tuple(r) for r in S.similarity_self_join(points, 0.3, metric, block).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert len(want) > 40 and {(q, i) for q, i, _ in want} == {(int(i), str(q)) for q, i, _ in want}


def test_a_task_holds_few_scores_and_equal_vectors_have_equal_ones():
    rng = np.random.default_rng(6)
    one = rng.normal(size=(7, 64)).astype(np.float32)
    points = one[np.arange(10_001) % 7]
    flat = pa.array(points.ravel())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_001)), pa.array([str(i) for i in range(10_001)]), pa.ListArray.from_arrays(pa.array(np.arange(10_002, dtype=np.int32) * 64), flat)], ["slot", "id", "vector"])
    queries = rng.normal(size=(1024, 64))
    tracemalloc.start()
    found = pa.Table.from_batches(S.best_of(np.arange(1024), queries, 10, "Cosine", None)(iter([batch]))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    nearest = D.scores("Cosine", queries, one).argmax(1)
    for q, rows in found.groupby("qid"):
        assert sorted(rows.slot) == [i for i in range(10_001) if i % 7 == nearest[q]][-10:] and rows.score.nunique() == 1


def test_a_batch_search_gives_k_rows_of_a_task_in_memory_that_does_not_grow_with_its_points():
    rng = np.random.default_rng(9)
    queries = rng.normal(size=(2048, 64))

    def run(n):
        flat = pa.array(rng.normal(size=10_000 * 64).astype(np.float32))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(10_001, dtype=np.int32) * 64), flat)
        batches = (pa.RecordBatch.from_arrays([pa.array(np.arange(10_000) + i), pa.array([str(i + j) for j in range(10_000)]), vectors], ["slot", "id", "vector"]) for i in range(0, n, 10_000))
        tracemalloc.start()
        rows = sum(b.num_rows for b in S.best_of(np.arange(2048), queries, 3, "Cosine", None)(batches))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, peak

    (rows, peak), (more, later) = run(10_000), run(60_000)
    assert rows == more == 3 * 2048 and later < 1.2 * peak < 150 << 20


def test_rows_that_come_a_few_at_a_time_do_not_pile_up_as_tables():
    rng = np.random.default_rng(10)
    queries = rng.normal(size=(4, 64))
    best = S.Best(np.arange(4), queries, 2, "Cosine")
    rows = []
    for i in range(3000):
        x = rng.normal(size=(1, 64)).astype(np.float32)
        rows.append(x)
        best.see(pa.RecordBatch.from_arrays([pa.array([i]), pa.array([str(i)]), pa.array(list(x))], ["slot", "id", "vector"]))
        assert len(best.tables) <= 1100  # of about 7 KB
    found = pa.Table.from_batches(best.found()).to_pandas()
    s = D.scores("Cosine", queries, np.concatenate(rows))
    assert found.groupby("qid").slot.apply(list).tolist() == [r.argsort()[::-1][:2].tolist() for r in s]
    few = S.Best(np.arange(4), queries, 1, "Cosine", threshold=2.0)
    few.see(pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["0"]), pa.array(list(x))], ["slot", "id", "vector"]))
    assert not few.tables and not list(few.found())


def test_cosines_are_made_in_little_more_than_their_own_memory():
    rng = np.random.default_rng(11)
    points, queries = rng.normal(size=(4096, 64)), rng.normal(size=(256, 64))
    points[5] = queries[7] = 0
    tracemalloc.start()
    s = D.scores("Cosine", queries, points)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    q, x = (m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None] for m in (queries, points))
    assert np.allclose(s, q @ x.T) and not s[7].any() and not s[:, 5].any()
    assert peak < 3 * s.nbytes


@pytest.mark.parametrize("kind, width", [("binary", 300), ("scalar", 20), ("product", 200)])
def test_batches_by_codes_reach_their_recall_with_many_points(spark, kind, width):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(9000, 64)).astype(np.float32)
    points = frame(spark, vectors).coalesce(2)
    if kind == "product":
        known = {"books": quant.product_codebooks(points, 16)}
        coded = quant.product_encode(points, known["books"])
    elif kind == "scalar":
        known = {"low": -2.5, "high": 2.5}
        coded = points.withColumn("code", quant.scalar_codes(F.col("vector"), -2.5, 2.5))
    else:
        known = {"dim": 64}
        coded = points.withColumn("code", quant.binary_words(F.col("vector"), 64))
    asked = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(0, 9000, 450)], "qid long, vector array<float>")
    found = quant.batch_two_stage(coded, asked, known | {"kind": kind}, 10, width, "Cosine").collect()
    assert len(found) <= 2 * 10 * 20
    got = {(r.qid, r.slot) for r in found}
    assert sum((i, n) in got for i in range(0, 9000, 450) for n in exact(vectors, vectors[i], "Cosine")[:10]) >= 0.9 * 200


def test_batches_through_lists_and_graphs_give_k_rows_of_each_task(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    points = frame(spark, vectors).coalesce(1)
    asked = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(20)], "qid long, vector array<float>")
    centres = rng.normal(size=(8, 8))
    assert ivf.batch_probe(ivf.assign(points, centres, "Euclid"), asked, centres, 8, 5, "Euclid").count() == 20 * 5
    config = HnswConfig(m=8, ef_construct=16)
    graphs = graph.build(points, "Euclid", config, shard=200)
    assert graph.batch_search(graphs, asked, "Euclid", config, 40, 5).count() == 2 * 20 * 5
