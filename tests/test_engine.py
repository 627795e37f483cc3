import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecspark.engine import Engine
from vecspark.plans.filters import where
from vecspark.sources.store import number_in_order
from vecspark.streaming.ingest import search_queries, upsert_stream
from vecspark.types import AlreadyExists, CapacityExceeded, InvalidConfig, InvalidDimension, InvalidPoint, NotFound, SearchQuery


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "root"))


def versions():
    """Twelve points of two versions, colors, prices, tags and notes, and one without payload."""
    out = []
    for i in range(6):
        out.append((i, {"version": "v1", "color": "red" if i % 2 == 0 else "blue", "price": i * 10.0, "tags": ["hot", "new"] if i % 3 == 0 else ["cold"], "note": f"item-{i}"}))
    for i in range(10, 15):
        out.append((i, {"version": "v2", "color": "green", "price": 100.0 + i, "tags": ["hot"], "note": f"item-{i}"}))
    out.append((99, None))
    extra = dict(out[0][1], addresses=[{"city": "paris"}, {"city": "lyon"}], location={"lat": 48.8566, "lon": 2.3522})
    out.append((0, extra))
    return [{"id": i, "vector": [1.0, float(i), 0.0, 0.5], "payload": p} for i, p in out]


def test_writing_makes_no_frames_of_rows_that_start_python_workers(engine, spark, monkeypatch):
    make = type(spark).createDataFrame

    def from_arrow(self, data, *more, **named):
        assert isinstance(data, pa.Table)
        return make(self, data, *more, **named)

    monkeypatch.setattr(type(spark), "createDataFrame", from_arrow)
    engine.create_collection("c", {"dim": 2, "index": "Flat"})
    assert engine.points("c").count() == 0
    engine.upsert_dataframe("c", spark.range(50).select("id", F.array(F.col("id").cast("float"), F.lit(1.0)).alias("vector"), F.col("id").alias("seq")))
    assert [(r.id, r.slot) for r in engine.points("c").orderBy("slot").collect()] == [(str(i), i) for i in range(50)]
    assert number_in_order(engine.points("c").where("false"), 0).count() == 0


def test_counts_and_scrolls(engine):
    engine.create_collection("c", {"dim": 4, "index": "Flat"})
    engine.upsert_batch("c", versions())
    must = lambda *c: {"must": list(c)}
    wanted = [
        (must(where.match("version", "v1")), 6), (must(where.match("version", "v2")), 5), ({}, 12), (must(where.match("color", "red")), 3),
        (must(where.match_any("color", ["red", "green"])), 8), (must(where.range("price", gte=100)), 5), (must(where.is_null("missing")), 12), (must(where.has_id([0, 10])), 2),
        (must(where.values_count("tags", gte=2)), 2), (must(where.contains("note", "item-1")), 6), (must(where.starts_with("note", "item-1")), 6),
        (must(where.nested("addresses", must(where.match("city", "lyon")))), 1), (must(where.geo_radius("location", 48.8566, 2.3522, 1000)), 1), ({"must_not": [where.match("color", "red")]}, 9),
    ]
    for spec, n in wanted:
        assert engine.count_by_filter("c", spec) == n, spec
    pages, cursor = [], None
    while True:
        rows, cursor = engine.scroll_by_filter("c", must(where.match("version", "v2")), 2, cursor)
        if not rows:
            break
        pages += [r["id"] for r in rows]
    assert pages == ["10", "11", "12", "13", "14"]
    assert engine.scroll("c", 0)[0][0]["id"] == "0" and engine.scroll("c", 5, "nobody") == ([], None)
    assert [r.id for r in engine.scroll_stream("c", must(where.match("color", "red")))] == ["0", "2", "4"]


def test_changes_are_all_or_nothing_and_keep_slots(engine):
    engine.create_collection("c", {"dim": 2, "index": "Flat", "max_points": 3})
    engine.upsert_batch("c", [{"id": 1, "vector": [1, 0]}, {"id": "2", "vector": [0, 1], "payload": {"a": 1}}, {"id": "01", "vector": [0, 2], "payload": {"b": 2}}])
    assert engine.count("c") == 2 and engine.get("c", 1) == {"id": "1", "vector": [0.0, 2.0], "payload": {"b": 2}}
    for bad, error in (([1.0], InvalidDimension), ([1.0, float("inf")], InvalidPoint)):
        with pytest.raises(error):
            engine.upsert_batch("c", [{"id": 3, "vector": [1, 1]}, {"id": 4, "vector": bad}])
    with pytest.raises(CapacityExceeded):
        engine.upsert_batch("c", [{"id": i, "vector": [1, 1]} for i in range(5, 9)])
    assert engine.count("c") == 2 and engine.get("c", 3) is None
    engine.merge_payload("c", 2, {"c": None})
    engine.delete_payload_keys("c", 2, ["a"])
    assert engine.get("c", 2)["payload"] == {"c": None}
    slots = engine.slot_of("c", 1), engine.slot_of("c", 2)
    engine.upsert("c", 2, [5, 5])
    assert (engine.slot_of("c", 1), engine.slot_of("c", 2)) == slots and engine.get("c", 2)["payload"] is None
    with pytest.raises(InvalidPoint):
        engine.set_payload("c", 77, {})
    engine.delete("c", 77)
    engine.delete("c", 1)
    engine.upsert("c", 1, [7, 7])
    assert engine.slot_of("c", 1) > max(slots)
    assert engine.drain_pending("c") > 0 and engine.count("c") == 2 and engine.compact("c") == 2 and sorted((engine.slot_of("c", 1), engine.slot_of("c", 2))) == [0, 1]


def test_names_configs_and_missing_collections(engine):
    engine.create_collection("c", {"dim": 2})
    for bad in ("", ".", "a/b"):
        with pytest.raises(InvalidConfig):
            engine.create_collection(bad, {"dim": 2})
    with pytest.raises(AlreadyExists):
        engine.create_collection("c", {"dim": 2})
    with pytest.raises(InvalidConfig):
        engine.create_collection("d", {"dim": 2, "hnsw": {"m": 16, "ef_construct": 8}})
    with pytest.raises(InvalidConfig):
        engine.set_ivf_config("c", lists=4)
    with pytest.raises(NotFound):
        engine.count("nothing")
    engine.set_hnsw_config("c", m=8, ef_construct=20)
    assert engine.collection_config("c")["hnsw"]["m"] == 8
    engine.set_default_quantization_config(kind="binary")
    engine.create_collection("e", {"dim": 2})
    assert engine.collection_config("e")["quantization"]["kind"] == "binary"
    engine.delete_collection("c")
    assert engine.list_collections() == ["e"] and engine.health_check()["status"] == "ok"


def test_indexes_change_speed_only(engine, spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (F.sin(F.col("id") * (j + 1) * 0.37)).cast("float")).alias("vector"), F.concat(F.lit('{"price":'), F.col("id"), F.lit("}")).alias("payload"), F.col("id").alias("seq"))
    asked = SearchQuery([0.1, 0.5, -0.2, 0.3, 0.9, -0.4, 0.2, 0.0], filter={"must": [where.range("price", gte=150)]}, with_payload=False)
    results = []
    for name, config in (("flat", {"index": "Flat"}), ("ivf", {"index": "Ivf", "ivf": {"lists": 8, "min_build_points": 10, "default_nprobe": 2}}), ("hnsw", {"index": "Hnsw"}), ("codes", {"index": "Flat", "quantization": {"kind": "binary"}})):
        engine.create_collection(name, {"dim": 8, "metric": "Euclid", **config})
        engine.upsert_dataframe(name, rows, payload="payload")
        assert engine.build_index(name) == (name in ("ivf", "hnsw"))
        results.append([r.id for r in engine.search(name, asked).collect()])
        assert engine.has_quantization(name) == (name == "codes")
    assert len(results[0]) == 10 and [len(r) for r in results] == [10] * 4 and all(int(i) >= 150 for r in results for i in r)
    assert len(set(results[0]) & set(results[2])) >= 8
    engine.create_payload_index("flat", "price", "float")
    again = engine.search("flat", asked)
    assert [r.id for r in again.collect()] == results[0]
    assert "p_price" in again._jdf.queryExecution().toString() and engine.list_payload_indexes("flat") == {"price": "float"}
    with pytest.raises(AlreadyExists):
        engine.create_payload_index("flat", "price", "float")
    assert engine.delete_payload_index("flat", "price") and not engine.delete_payload_index("flat", "price")
    assert engine.index_drift("ivf") == pytest.approx(0, abs=1e-6)
    engine.delete("hnsw", 199)
    assert engine.needs_checkpoint("hnsw") and engine.stale_ratio("hnsw") == pytest.approx(1 / 200)
    assert "199" not in {r.id for r in engine.search("hnsw", asked).collect()}
    assert engine.repair_index("hnsw") and engine.has_index("hnsw") and not engine.repair_index("hnsw")
    assert "199" not in {r.id for r in engine.search("hnsw", asked).collect()}
    engine.drop_index("ivf")
    assert not engine.has_index("ivf") and engine.run_maintenance_sweep()["ivf"] in ([], ["vacuum"]) and engine.run_maintenance_sweep()["ivf"] == []


def test_promotion_and_snapshots(engine, tmp_path):
    engine.create_collection("live", {"dim": 2, "index": "Flat"})
    engine.upsert("live", 1, [1, 0], {"a": 1})
    engine.export_snapshot(str(tmp_path / "snap"))
    engine.create_collection("live.rebuild-7", {"dim": 2, "index": "Flat"})
    engine.upsert("live.rebuild-7", 2, [0, 1])
    assert engine.list_temp_collections("live") == ["live.rebuild-7"]
    engine.promote_temp_collection("live.rebuild-7", "live")
    assert engine.get("live", 2) and not engine.get("live", 1) and len(engine.list_old_backups("live")) == 1
    engine.restore_promote_backup("live")
    assert engine.get("live", 1) and engine.collection_names() == ["live"]
    engine.delete_collection("live")
    engine.import_snapshot(str(tmp_path / "snap"))
    assert engine.get("live", 1)["payload"] == {"a": 1}


def test_streams(engine, spark, tmp_path):
    engine.create_collection("c", {"dim": 2, "index": "Flat"})
    rows = spark.createDataFrame([(str(i), [float(i), 1.0], None) for i in range(6)], "id string, vector array<float>, payload string")
    rows.write.parquet(str(tmp_path / "in"))
    upsert_stream(engine, "c", spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "k1")).trigger(availableNow=True).start().awaitTermination()
    assert engine.count("c") == 6
    asked = spark.createDataFrame([(1, [5.0, 1.0])], "qid long, vector array<float>")
    asked.write.parquet(str(tmp_path / "q"))
    search_queries(engine, "c", spark.readStream.schema(asked.schema).parquet(str(tmp_path / "q")), 2, str(tmp_path / "out"), str(tmp_path / "k2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def waves(spark, n=200):
    """n points of eight elements, each with a price and a kind."""
    vector = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.sin(F.col("id") * (j + 1) * 0.37).cast("float"))
    payload = F.concat(F.lit('{"price":'), F.col("id"), F.lit(',"kind":"k'), F.col("id") % 5, F.lit('","tags":["t'), F.col("id") % 3, F.lit('"]}'))
    return spark.range(n).select(F.col("id").cast("string").alias("id"), vector.alias("vector"), payload.alias("payload"), F.col("id").alias("seq"))


ASKED = [0.1, 0.5, -0.2, 0.3, 0.9, -0.4, 0.2, 0.0]


@pytest.mark.parametrize("config", [{"index": "Ivf", "ivf": {"lists": 8, "min_build_points": 10, "default_nprobe": 8}}, {"index": "Flat", "quantization": {"kind": "scalar"}}, {"index": "Hnsw"}])
def test_changes_that_wait_are_searched_beside_the_index(engine, spark, config):
    for name, how in (("flat", {"index": "Flat"}), ("indexed", config)):
        engine.create_collection(name, {"dim": 8, "metric": "Euclid", **how})
        engine.upsert_dataframe(name, waves(spark), payload="payload")
        engine.build_index(name)
        engine.upsert_batch(name, [{"id": f"new{i}", "vector": [x + i / 100 for x in ASKED]} for i in range(3)])
        engine.upsert(name, 7, ASKED, {"price": 7})
        engine.delete_batch(name, ["new1", 8, 9])
    query = SearchQuery(ASKED, limit=12, with_payload=False, rescore=True, oversampling=30)
    rows = lambda name: [(r.id, round(r.score, 6)) for r in engine.search(name, query).collect()]
    want = rows("flat")
    assert want[:2] == [("new0", 1.0), ("7", 1.0)] or want[:2] == [("7", 1.0), ("new0", 1.0)]
    assert rows("indexed") == want and "search_exact_calls" not in engine.collection_metrics("indexed")
    batch = spark.createDataFrame([(1, ASKED)], "qid long, vector array<float>")
    got = engine.search_batch("indexed", batch, 12, nprobe=8, oversampling=30).orderBy("rank").collect()
    assert [(r.id, round(r.score, 6)) for r in got] == want
    assert engine.count("indexed") == engine.points("indexed").count() == 200
    assert engine.drain_pending("indexed") > 0 and rows("indexed") == want and engine.has_index("indexed") == (config["index"] != "Flat")


def test_index_columns_narrow_what_is_read(engine, spark):
    engine.create_collection("c", {"dim": 8, "index": "Flat"})
    engine.upsert_dataframe("c", waves(spark), payload="payload")
    for field, tag in (("price", "float"), ("kind", "keyword"), ("tags", "keyword")):
        engine.create_payload_index("c", field, tag)
    cases = [(where.match("kind", "k3"), 40, "EqualTo(p_kind,k3)"), (where.match_any("kind", ["k1", "k2"]), 80, "In(p_kind"), (where.range("price", gte=150), 50, "GreaterThanOrEqual(p_price,150"), (where.match("tags", "t1"), 67, "IsNotNull(m_tags)"), (where.has_id([3, "04", "none"]), 2, "In(id")]
    for condition, n, pushed in cases:
        found = engine.points_by_filter("c", {"must": [condition]})
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == n and pushed in plan[plan.index("PushedFilters") :], pushed
    store = engine._store("c")
    plan = store.with_ids(store.manifest(), ["7"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,7)" in plan and engine.get("c", "0007")["payload"]["price"] == 7


def test_transactions_writers_and_batches(engine, spark):
    for name in ("a", "b"):
        engine.create_collection(name, {"dim": 1, "index": "Flat", "max_points": 3})
    engine.apply_txn([{"op": "upsert", "collection": n, "id": i, "vector": [i]} for i in range(2) for n in ("a", "b")])
    before = engine.revision("a"), engine.revision("b")
    bad = [{"op": "upsert", "collection": "a", "id": 5, "vector": [1.0]}, *({"op": "upsert", "collection": "b", "id": i, "vector": [1.0]} for i in range(2, 5))]
    with pytest.raises(CapacityExceeded):
        engine.apply_txn(bad)
    assert (engine.revision("a"), engine.revision("b")) == before and engine.get("a", 5) is None
    engine.apply_txn([{"op": "delete", "collection": "a", "id": 0}, {"op": "upsert", "collection": "a", "id": 7, "vector": [7]}, {"op": "delete", "collection": "a", "id": 7}, {"op": "upsert", "collection": "a", "id": 0, "vector": [9]}])
    assert engine.count("a") == 2 and engine.get("a", 0)["vector"] == [9.0] and engine.get("a", 7) is None and engine.slot_of("a", 0) == 2
    late = engine._store("a").manifest()
    engine.delete("a", 1)
    assert not engine._store("a").commit(late) and engine.count("a") == 1
    rows = spark.createDataFrame([("5", [5.0])], "id string, vector array<float>")
    for epoch in (0, 1, 1, 0):
        engine.upsert_dataframe("a", rows, batch=("source", epoch))
    assert engine.collection_metrics("a")["upsert_calls"] == 6 and engine._store("a").manifest()["batches"] == {"source": 1}


def test_ids_are_one_whichever_way_they_come_in(engine, spark):
    from vecspark.types import normalise_id

    texts = ["7", "007", "+7", "0", "+000", "18446744073709551615", "018446744073709551615", "18446744073709551616", "+00000000000000000000012", "1.0", "-3", "", "x7", "+", "9" * 5000]
    engine.create_collection("c", {"dim": 1, "index": "Flat"})
    engine.upsert_dataframe("c", spark.createDataFrame([(t, [1.0]) for t in texts], "id string, vector array<float>"))
    assert {r.id for r in engine.points("c").select("id").collect()} == {normalise_id(t) for t in texts} and normalise_id(texts[6]) == texts[5]
    assert all(engine.get("c", t) for t in texts)


def test_many_changes_are_merged_and_folded(engine, spark, monkeypatch):
    from vecspark.sources import store as s

    engine.create_collection("c", {"dim": 1, "index": "Flat"})
    for i in range(18):
        engine.upsert("c", i % 5, [i])
    manifest = engine._store("c").manifest()
    assert len(manifest["changes"]) <= s.MERGED and {r.id: r.vector[0] for r in engine.points("c").collect()} == {str(i % 5): float(i) for i in range(13, 18)}
    monkeypatch.setattr(s, "FOLD_LEAST", 0)
    engine.upsert("c", 1, [99])
    assert not engine.needs_checkpoint("c") and engine.get("c", 1)["vector"] == [99.0] and engine.vacuum("c") and engine.count("c") == engine.points("c").count() == 5


def test_order_statistics_are_exact(spark):
    from vecspark.operators.quantization import order_statistics

    values = [((i * 7919) % 1000) / 7 for i in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    ranks = [0, 1, 14, 1500, 2985, 2999]
    assert order_statistics(frame, ranks) == [sorted(values)[r] for r in ranks]
