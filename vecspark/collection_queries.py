"""Queries over collections: reading, indexes with changes waiting, upkeep, snapshots, streams and errors.

Each makes its collection in a scratch folder. Where a query's answer is what the engine reports of itself, its SQL says what
that has to be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark import types as T
from vecspark.engine import Engine
from vecspark.operators import quantization as quant
from vecspark.plans.filters import where
from vecspark.queries import _HAS, _SCORE, DIM, batch_sql, collection, embeddings, knn_sql, points, query, vector_of
from vecspark.sources.files import scratch_folder
from vecspark.streaming.ingest import search_queries, upsert_stream
from vecspark.types import SearchQuery

IVF = {"index": "Ivf", "ivf": {"lists": 16, "min_build_points": 10}}
TURNED = "list_concat(embedding[2:], embedding[:1])"


def whole(engine: Engine, name: str = "c") -> DataFrame:
    """Every point by id: slot, a checksum of all elements of its vector, and its payload as text."""
    weighted = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return engine.points(name).select("id", "slot", F.round(weighted, 3).alias("checksum"), "payload")


_CHECKSUM = "round(list_sum(list_transform(range(1, 65), lambda i: {}[i]::DOUBLE * i)), 3)"
_PAYLOAD = """CASE WHEN n % 13 <> 0 THEN '{' || CASE n % 4 WHEN 0 THEN '"color":"red",' WHEN 1 THEN '"color":"blue",' WHEN 2 THEN '"color":"green",' ELSE '' END
 || CASE WHEN n % 7 = 0 THEN '"price":"on request",' ELSE '"price":' || (n * 0.5)::DECIMAL(18, 1)::VARCHAR || ',' END || '"label":' || label || ','
 || CASE n % 3 WHEN 0 THEN '"tags":["hot","new"],' WHEN 1 THEN '"tags":["cold"],' ELSE '"tags":[],' END
 || CASE WHEN n % 11 = 0 THEN '"note":null,' ELSE '"note":"item-' || n || '",' END || '"location":{"lat":' || (n % 180 - 90) || ',"lon":' || (n % 360 - 180) || '},'
 || CASE WHEN n % 2 = 0 THEN '"addresses":[{"city":"c' || n % 5 || '","zip":' || n % 10 || '},{"city":"lyon","zip":' || n % 100 || '}]' ELSE '"addresses":[]' END || '}' END"""
_WHOLE = f"SELECT n, n::VARCHAR AS id, n AS slot, {_CHECKSUM.format('embedding')} AS checksum, {_PAYLOAD} AS payload FROM (SELECT vec_id AS n, label, embedding FROM embeddings)"
_ROW = "SELECT id, slot, checksum, payload FROM"


def said(spark: SparkSession, **columns) -> DataFrame:
    """One row of what an engine reports."""
    kind = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {kind[type(v)]}" for k, v in columns.items()))


def error_of(act: Callable[[], object]) -> str:
    """The kind of error that act raises, or an empty text."""
    try:
        act()
    except T.VectorError as e:
        return type(e).__name__
    return ""


def turned(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    """Some points again, each vector turned by one element, their payloads as they were."""
    return points(spark, sf_dir).where(condition).select("id", F.concat(F.slice("vector", 2, DIM - 1), F.slice("vector", 1, 1)).alias("vector"), "payload", F.col("slot").alias("seq"))


# Reading


@query(f"SELECT id, slot, checksum, CASE WHEN n % 13 <> 0 AND n % 11 <> 0 THEN 'item-' || n END AS note FROM ({_WHOLE}) WHERE n IN (7, 13, 26)")
def get_point(spark, sf_dir):
    """get() and slot_of() of a few ids, as a caller writes them."""
    engine = collection(spark, sf_dir)
    engine.upsert_dataframe("c", points(spark, sf_dir).where("slot = 7").select("id", "vector", "payload"), payload="payload")
    rows = []
    for i in (7, 13, 26, 999_999_999):
        if got := engine.get("c", f"+00{i}"):
            rows.append((got["id"], engine.slot_of("c", i), round(sum(float(x) * (j + 1) for j, x in enumerate(got["vector"])), 3), (got["payload"] or {}).get("note")))
    return spark.createDataFrame(rows, "id string, slot long, checksum double, note string")


@query("SELECT vec_id::VARCHAR AS id FROM embeddings WHERE vec_id::VARCHAR > '20' ORDER BY 1 LIMIT 15")
def scroll_by_id(spark, sf_dir):
    """A page in the order of ids, as the form in memory has it."""
    rows, _ = collection(spark, sf_dir).scroll("c", 15, "20", with_payload=False, order="id")
    return spark.createDataFrame(rows, "id string")


@query(f"SELECT n::VARCHAR AS id FROM (SELECT vec_id AS n FROM embeddings) WHERE {_HAS} AND n % 4 = 0")
def scroll_stream(spark, sf_dir):
    """All points that a filter takes, as a stream of rows."""
    rows = collection(spark, sf_dir).scroll_by_filter_stream("c", {"must": [where.match("color", "red")]})
    return spark.createDataFrame([(r.id,) for r in rows], "id string")


@query(knn_sql("Cosine"))
def search_stream(spark, sf_dir):
    rows = collection(spark, sf_dir).search_stream("c", {"vector": vector_of(spark, sf_dir, 0), "with_payload": False})
    return spark.createDataFrame([(r.id, round(r.score, 6)) for r in rows], "id string, score double")


@query(knn_sql("Cosine", 7, threshold=0.05))
def search_vector(spark, sf_dir):
    found = collection(spark, sf_dir).search_vector("c", vector_of(spark, sf_dir, 0), 7, threshold=0.05)
    return found.select("id", F.round("score", 6).alias("score"))


@query(knn_sql("Cosine", 7))
def search_mode_k(spark, sf_dir):
    """A mode's k counts, whatever the limit."""
    found = collection(spark, sf_dir).search("c", {"vector": vector_of(spark, sf_dir, 0), "limit": 3, "k": 7, "ef_search": 50, "with_payload": False})
    return found.select("id", F.round("score", 6).alias("score"))


@query(batch_sql(k=10))
def search_batch_exact(spark, sf_dir):
    """Many queries at once against a collection."""
    asked = embeddings(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return collection(spark, sf_dir).search_batch("c", asked, 10).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Payload indexes


@query(f"SELECT n::VARCHAR AS id FROM (SELECT vec_id AS n FROM embeddings) WHERE {_HAS} AND n % 4 = 0")
def keyword_index_match(spark, sf_dir):
    """An equality over the column of a payload index."""
    engine = collection(spark, sf_dir)
    engine.create_payload_index("c", "color")
    return engine.points_by_filter("c", {"must": [where.match("color", "red")]}).select("id")


@query(f"SELECT n::VARCHAR AS id FROM (SELECT vec_id AS n FROM embeddings) WHERE {_HAS} AND n % 3 IN (0, 1) AND n % 4 IN (0, 2)")
def keyword_index_match_any(spark, sf_dir):
    """Equalities over an array's and a text's index."""
    engine = collection(spark, sf_dir)
    engine.create_payload_index("c", "tags")
    engine.create_payload_index("c", "color")
    return engine.points_by_filter("c", {"must": [where.match_any("tags", ["new", "cold"]), where.match_any("color", ["red", "green"])]}).select("id")


@query(f"SELECT n::VARCHAR AS id FROM (SELECT vec_id AS n FROM embeddings) WHERE {_HAS} AND n % 7 <> 0 AND (CASE WHEN n % 10 = 1 THEN 45 ELSE n * 0.5 END) BETWEEN 30 AND 90")
def payload_index_after_changes(spark, sf_dir):
    """A range over an index while changed points wait beside it."""
    engine = collection(spark, sf_dir)
    engine.create_payload_index("c", "price", "float")
    priced = points(spark, sf_dir).where("slot % 10 = 1 AND slot % 7 <> 0 AND slot % 13 <> 0").select("id", "vector", F.lit('{"price":45}').alias("payload"))
    engine.upsert_dataframe("c", priced, payload="payload")
    return engine.points_by_filter("c", {"must": [where.range("price", gte=30, lte=90)]}).select("id")


@query("SELECT * FROM (VALUES ('color', 'keyword'), ('price', 'float')) t(field, tag)")
def payload_index_catalogue(spark, sf_dir):
    engine = collection(spark, sf_dir)
    for field, tag in (("price", "float"), ("tags", "keyword"), ("color", " Keyword ")):
        engine.create_payload_index("c", field, tag)
    engine.delete_payload_index("c", "tags")
    return spark.createDataFrame(list(engine.list_payload_indexes("c").items()), "field string, tag string")


# Indexes with changes waiting


def _indexed(spark, sf_dir, **config) -> Engine:
    engine = collection(spark, sf_dir, **(config or IVF))
    engine.build_index("c")
    return engine


def _all_lists(spark, engine: Engine, sf_dir: str, **options) -> DataFrame:
    found = engine.search("c", SearchQuery(vector_of(spark, sf_dir, 0), nprobe=16, with_payload=False, **options))
    assert engine.has_index("c") and "search_exact_calls" not in engine.collection_metrics("c")
    return found.withColumn("score", F.round("score", 6))


def _state_knn(rows: str, k: int = 10) -> str:
    """The nearest of rows (n, embedding) to the first vector."""
    score = _SCORE["Cosine"].replace("a[", "e.embedding[").replace("b[", "q.embedding[")
    return f"SELECT id, round(score, 6) AS score FROM (SELECT e.id, e.n, {score} AS score FROM ({rows}) e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY score DESC, n LIMIT {k}"


@query(_state_knn("SELECT vec_id AS n, vec_id::VARCHAR AS id, embedding FROM embeddings UNION ALL SELECT 1000000 + vec_id, 'new' || vec_id, " + TURNED + " FROM embeddings WHERE vec_id % 3 = 0"))
def ivf_search_after_upsert(spark, sf_dir):
    """New points are found through a live index before it has them."""
    engine = _indexed(spark, sf_dir)
    engine.upsert_dataframe("c", turned(spark, sf_dir, "slot % 3 = 0").withColumn("id", F.concat(F.lit("new"), "id")), payload="payload")
    return _all_lists(spark, engine, sf_dir)


@query(_state_knn("SELECT vec_id AS n, vec_id::VARCHAR AS id, embedding FROM embeddings WHERE vec_id % 3 <> 0"))
def ivf_search_after_delete(spark, sf_dir):
    engine = _indexed(spark, sf_dir)
    engine.delete_dataframe("c", points(spark, sf_dir).where("slot % 3 = 0").select("id"))
    return _all_lists(spark, engine, sf_dir)


_OVERWRITTEN = f"SELECT vec_id AS n, vec_id::VARCHAR AS id, CASE WHEN vec_id % 3 = 0 THEN {TURNED} ELSE embedding END AS embedding FROM embeddings"


@query(_state_knn(_OVERWRITTEN))
def ivf_search_after_overwrite(spark, sf_dir):
    engine = _indexed(spark, sf_dir)
    engine.upsert_dataframe("c", turned(spark, sf_dir, "slot % 3 = 0"), payload="payload")
    return _all_lists(spark, engine, sf_dir)


@query(_state_knn(_OVERWRITTEN))
def drained_index_search(spark, sf_dir):
    """Waiting changes go into the base and its lists; the index stays."""
    engine = _indexed(spark, sf_dir)
    engine.upsert_dataframe("c", turned(spark, sf_dir, "slot % 3 = 0"), payload="payload")
    assert engine.stale_ratio("c") > 0 and engine.repair_index("c") and not engine.needs_checkpoint("c")
    return _all_lists(spark, engine, sf_dir)


@query(_state_knn(_OVERWRITTEN))
def quantized_search_after_overwrite(spark, sf_dir):
    """Changed points get their codes as the search goes; the rescored width takes in all points here."""
    engine = collection(spark, sf_dir, quantization={"kind": "scalar"})
    engine.build_quantization("c")
    engine.upsert_dataframe("c", turned(spark, sf_dir, "slot % 3 = 0"), payload="payload")
    found = engine.search("c", SearchQuery(vector_of(spark, sf_dir, 0), rescore=True, oversampling=20, with_payload=False))
    assert "search_quantized_calls" in engine.collection_metrics("c")
    return found.withColumn("score", F.round("score", 6))


@query(knn_sql("Cosine", 8, condition="n IN (3, 7, 12, 21, 33, 40, 41, 55)", threshold=-2.0))
def ivf_filtered_threshold(spark, sf_dir):
    """A filter with a threshold and a bound of probes: as many rows as the exact search gives."""
    engine = collection(spark, sf_dir, index="Ivf", ivf={"lists": 16, "min_build_points": 10, "default_nprobe": 1, "max_probes": 2})
    engine.build_index("c")
    asked = SearchQuery(vector_of(spark, sf_dir, 0), limit=8, filter={"must": [where.has_id([3, 7, 12, 21, 33, 40, 41, 55])]}, score_threshold=-2.0, with_payload=False)
    return engine.search("c", asked).withColumn("score", F.round("score", 6))


@query(knn_sql("Cosine", condition=f"{_HAS} AND n % 4 = 0 AND n % 5 = 0"))
def graph_filtered_search(spark, sf_dir):
    """A filter that few points pass: the walk widens, then the exact search takes over."""
    engine = _indexed(spark, sf_dir, index="Hnsw", hnsw={"m": 8, "ef_construct": 16, "ef_search": 10, "iterative_max_rounds": 2, "max_scan_tuples": 20})
    asked = SearchQuery(vector_of(spark, sf_dir, 0), filter={"must": [where.match("color", "red"), where.nested("addresses", {"must": [where.match("city", "c0")]})]}, with_payload=False)
    return engine.search("c", asked).withColumn("score", F.round("score", 6))


@query(f"SELECT 'exact' AS how, * FROM ({knn_sql('Cosine')}) UNION ALL SELECT 'ignore', * FROM ({knn_sql('Cosine')})")
def quantized_exact_and_ignore(spark, sf_dir):
    """Both ways around the codes."""
    engine = collection(spark, sf_dir, quantization={"kind": "binary"})
    engine.build_index("c")
    by = lambda how, **o: engine.search("c", SearchQuery(vector_of(spark, sf_dir, 0), with_payload=False, **o)).select(F.lit(how).alias("how"), "id", F.round("score", 6).alias("score"))
    return by("exact", exact=True).unionByName(by("ignore", ignore_quantization=True))


@query("SELECT * FROM (VALUES ('Flat', 'exact'), ('Hnsw', 'Hnsw'), ('Ivf', 'Ivf'), ('binary', 'quantized')) t(config, tier)")
def search_tiers(spark, sf_dir):
    """By which way a search goes, as the metrics tell."""
    rows, few = [], points(spark, sf_dir).where("slot % 4 = 0")
    for name, config in (("Flat", {}), ("Hnsw", {"index": "Hnsw", "hnsw": {"m": 4, "ef_construct": 8}}), ("Ivf", IVF), ("binary", {"quantization": {"kind": "binary"}})):
        engine = collection(spark, sf_dir, few, **config)
        engine.build_index("c")
        engine.search("c", SearchQuery(vector_of(spark, sf_dir, 0), with_payload=False)).collect()
        rows.append((name, next(k.split("_")[1] for k in engine.collection_metrics("c") if k.startswith("search_") and k.endswith("_calls"))))
    return spark.createDataFrame(rows, "config string, tier string")


# Recall of approximate searches, for all queries at once


_ASKED_SQL = "SELECT count(*) AS asked, true AS reached FROM embeddings WHERE vec_id % 50 = 0"


def recall(spark: SparkSession, sf_dir: str, engine: Engine, **options) -> DataFrame:
    """For all ids divisible by 50: how many were asked, and whether 0.9 of the exact ten nearest are found on average."""
    asked = embeddings(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    exact = engine.search_batch("c", asked, 10, exact=True).select("qid", "slot")
    near = engine.search_batch("c", asked, 10, **options).select("qid", "slot", F.lit(1).alias("hit"))
    return exact.join(near, ["qid", "slot"], "left").agg(F.countDistinct("qid").alias("asked"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("reached"))


@query(_ASKED_SQL)
def graph_knn_recall(spark, sf_dir):
    return recall(spark, sf_dir, _indexed(spark, sf_dir, index="Hnsw"), ef_search=100)


@query(_ASKED_SQL)
def pq_knn_recall(spark, sf_dir):
    engine = collection(spark, sf_dir, quantization={"kind": "product", "ratio": 16})
    engine.build_quantization("c")
    return recall(spark, sf_dir, engine, oversampling=20)


@query(_ASKED_SQL)
def scalar_knn_recall(spark, sf_dir):
    engine = collection(spark, sf_dir, quantization={"kind": "scalar"})
    engine.build_quantization("c")
    return recall(spark, sf_dir, engine)


@query(_ASKED_SQL)
def binary_knn_recall(spark, sf_dir):
    engine = collection(spark, sf_dir, quantization={"kind": "binary"})
    engine.build_quantization("c")
    return recall(spark, sf_dir, engine, oversampling=30)


@query(_ASKED_SQL)
def ivf_knn_recall(spark, sf_dir):
    """Lists nearest to each query, not all of them."""
    return recall(spark, sf_dir, _indexed(spark, sf_dir), nprobe=12)


@query(_ASKED_SQL)
def ivf_knn_recall_after_changes(spark, sf_dir):
    engine = _indexed(spark, sf_dir)
    engine.upsert_dataframe("c", turned(spark, sf_dir, "slot % 3 = 0"), payload="payload")
    engine.delete_dataframe("c", points(spark, sf_dir).where("slot % 3 = 1").select("id"))
    return recall(spark, sf_dir, engine, nprobe=12)


@query("SELECT 'Ivf' AS kind, count(*) AS built, false AS stale, false AS dropped FROM embeddings")
def index_info(spark, sf_dir):
    engine = _indexed(spark, sf_dir)
    told = engine.index_info("c")
    stale = engine.stale_ratio("c") > 0
    engine.drop_index("c")
    return said(spark, kind=told["kind"], built=told["built"], stale=stale, dropped=engine.has_index("c"))


# Codes and training


@query("SELECT * FROM (VALUES (64, 4, 64), (64, 16, 16), (64, 64, 4), (96, 32, 12), (100, 16, 25), (7, 4, 7)) t(dim, ratio, parts)")
def quantization_configs(spark, sf_dir):
    cases = [(64, 4), (64, 16), (64, 64), (96, 32), (100, 16), (7, 4)]
    return spark.createDataFrame([(d, r, T.QuantizationConfig("product", ratio=r).parts(d)) for d, r in cases], "dim int, ratio int, parts int")


@query("SELECT round(min(list_min(embedding))::DOUBLE, 6) AS low, round(max(list_max(embedding))::DOUBLE, 6) AS high FROM embeddings")
def scalar_full_range(spark, sf_dir):
    low, high = quant.scalar_range(points(spark, sf_dir), 1.0, DIM)
    return said(spark, low=round(low, 6), high=round(high, 6))


# Changes and upkeep


@query(f"SELECT 'InvalidDimension' AS error, id, slot, checksum, payload FROM ({_WHOLE})")
def apply_txn_rejected(spark, sf_dir):
    """One bad operation, and nothing of the transaction is done."""
    engine = collection(spark, sf_dir)
    ops = [{"op": "upsert", "collection": "c", "id": 1, "vector": [1.0] * DIM}, {"op": "delete", "collection": "c", "id": 2}, {"op": "upsert", "collection": "c", "id": 3, "vector": [1.0]}]
    error = error_of(lambda: engine.apply_txn(ops))
    return whole(engine).select(F.lit(error).alias("error"), "id", "slot", "checksum", "payload")


@query(f"SELECT vec_id::VARCHAR AS id, vec_id AS slot, {_CHECKSUM.format('(' + TURNED + ')')} AS checksum, NULL::VARCHAR AS payload FROM embeddings")
def upsert_many_batches(spark, sf_dir):
    """Every point again in ten batches, more than are merged at once; the index stays in use."""
    engine = _indexed(spark, sf_dir)
    for i in range(10):
        engine.upsert_dataframe("c", turned(spark, sf_dir, f"slot % 10 = {i}").drop("payload"))
    assert engine.has_index("c") and len(engine._store("c").manifest()["changes"]) < 8
    return whole(engine)


@query(f"{_ROW} ({_WHOLE}) UNION ALL SELECT name, (SELECT count(*) FROM embeddings) + place, 2080.0, NULL FROM (VALUES ('first', 0), ('second', 1)) t(name, place)")
def concurrent_writers(spark, sf_dir):
    """A writer whose state is no longer the newest does its change again on the newest one."""
    engine = collection(spark, sf_dir)
    store = engine._store("c")
    late = store.manifest()
    engine.upsert("c", "first", [1.0] * DIM)
    assert not store.commit(late)
    engine.upsert("c", "second", [1.0] * DIM)
    return whole(engine)


@query("SELECT 'CapacityExceeded' AS error, count(*) AS points FROM embeddings")
def capacity(spark, sf_dir):
    n = embeddings(spark, sf_dir).count()
    engine = collection(spark, sf_dir, max_points=n + 1)
    error = error_of(lambda: engine.upsert_batch("c", [{"id": f"x{i}", "vector": [0.0] * DIM} for i in range(2)]))
    return said(spark, error=error, points=engine.count("c"))


@query("SELECT count(*) AS folded, (SELECT count(*) FROM embeddings) AS points, false AS waits FROM embeddings WHERE vec_id % 5 = 0")
def checkpoint_folds(spark, sf_dir):
    engine = collection(spark, sf_dir)
    engine.checkpoint("c")
    engine.upsert_dataframe("c", turned(spark, sf_dir, "slot % 5 = 0"), payload="payload")
    folded = engine.checkpoint("c")
    return said(spark, folded=folded, points=engine.points("c").count(), waits=engine.needs_checkpoint("c"))


@query("SELECT 'compact,build,vacuum' AS acts, '' AS again, count(*) AS points FROM embeddings WHERE vec_id % 2 = 0")
def maintenance_sweep(spark, sf_dir):
    """Half of the points gone and no index: a sweep compacts, builds and clears up; the next has nothing to do but to clear up."""
    engine = collection(spark, sf_dir, index="Ivf", ivf={"lists": 4, "min_build_points": 10, "auto_promotion": True})
    engine.delete_dataframe("c", points(spark, sf_dir).where("slot % 2 = 1").select("id"))
    acts = engine.run_maintenance_sweep()["c"]
    again = [a for a in engine.run_maintenance_sweep()["c"] if a != "vacuum"]
    return said(spark, acts=",".join(acts), again=",".join(again), points=engine.points("c").count())


@query("SELECT * FROM (VALUES ('a'), ('b')) t(name)")
def catalogue(spark, sf_dir):
    """Collections after one was deleted; scratch collections don't count."""
    engine = Engine.open(spark, scratch_folder(spark, "collections"))
    with engine:
        for name in ("b", "a", "gone", "a.rebuild-1"):
            engine.create_collection(name, {"dim": 2})
        engine.delete_collection("gone")
        assert engine.list_temp_collections("a") == ["a.rebuild-1"] and not engine.collection_exists("gone")
        return spark.createDataFrame([(n,) for n in engine.collection_names()], "name string")


@query("SELECT count(*) * 320 AS bytes, 3::BIGINT AS changes, 'ok' AS status FROM embeddings")
def estimate_revision_health(spark, sf_dir):
    engine = collection(spark, sf_dir)
    before = engine.revision("c")
    for i in range(3):
        engine.set_payload_field("c", 1, "label", i)
    return said(spark, bytes=engine.memory_estimate("c"), changes=engine.revision("c") - before, status=engine.health_check()["status"])


@query("SELECT 3::BIGINT AS searches, 1::BIGINT AS upserts, 1::BIGINT AS deletes, true AS ordered, count(*) - 1 AS points FROM embeddings")
def metrics(spark, sf_dir):
    engine = collection(spark, sf_dir)
    for i in range(3):
        engine.search("c", SearchQuery(vector_of(spark, sf_dir, i), with_payload=False)).collect()
    engine.delete("c", 1)
    m = engine.collection_metrics("c")
    ordered = 0 < m["search_exact_p50"] <= m["search_exact_p95"] <= m["search_exact_p99"] and m["search_exact_p99"] * 2 > m["search_exact_seconds"] / 3
    return said(spark, searches=m["search_exact_calls"], upserts=m["upsert_calls"], deletes=m["delete_calls"], ordered=ordered, points=m["points"])


@query("SELECT * FROM (VALUES ('dimension', 'InvalidDimension', 5), ('infinite', 'NonFinite', 11), ('payload', 'InvalidPayload', 12), ('missing point', 'UnknownPoint', 13), ('name', 'InvalidName', 14), ('metric', 'UnsupportedMetric', 15), ('config', 'InvalidConfig', 4), ('exists', 'AlreadyExists', 3), ('not there', 'NotFound', 2), ('filter', 'FilterError', 8), ('operation', 'Misuse', 9), ('no id', 'InvalidId', 10), ('incomplete', 'Incomplete', 16), ('snapshot', 'CorruptData', 17)) t(what, kind, code)")
def typed_errors(spark, sf_dir):
    """Each kind of mistake and the error that tells it."""
    engine = collection(spark, sf_dir, points(spark, sf_dir).where("slot < 3"))
    engine.files.make("half")
    row = lambda **c: spark.createDataFrame([(c.get("id", "9"), c.get("vector", [0.0] * DIM), c.get("payload"))], "id string, vector array<float>, payload string")
    acts = {
        "dimension": lambda: engine.search("c", {"vector": [1.0]}),
        "infinite": lambda: engine.upsert("c", 1, [float("nan")] * DIM),
        "payload": lambda: engine.upsert_dataframe("c", row(payload="[1]"), payload="payload"),
        "missing point": lambda: engine.set_payload("c", 77, {}),
        "name": lambda: engine.create_collection("a/b"),
        "metric": lambda: engine.create_collection("x", {"dim": 2, "metric": "Hamming"}),
        "config": lambda: engine.create_collection("x", {"dim": 0}),
        "exists": lambda: engine.create_collection("c"),
        "not there": lambda: engine.count("nothing"),
        "filter": lambda: engine.count_by_filter("c", {"must": [{"field": "a", "condition": {"Range": None, "x": 1}, "more": 1}, {"field": "a"}]}),
        "operation": lambda: engine.apply_txn([{"op": "merge", "collection": "c", "id": 1}]),
        "no id": lambda: engine.upsert_dataframe("c", row(id=None), payload="payload"),
        "incomplete": lambda: engine.count("half"),
        "snapshot": lambda: engine.import_snapshot(scratch_folder(spark, "nothing")),
    }
    kinds = [(what, error_of(act)) for what, act in acts.items()]
    return spark.createDataFrame([(what, kind, getattr(T, kind).code) for what, kind in kinds], "what string, kind string, code int")


# Snapshots, promotion and streams


@query(f"{_ROW} ({_WHOLE}) WHERE n <> 5")
def snapshot_round_trip(spark, sf_dir):
    """Slots follow the order of ids in a snapshot, so points are numbered anew."""
    engine = collection(spark, sf_dir)
    engine.delete("c", 5)
    folder = scratch_folder(spark, "snapshot")
    engine.export_snapshot(folder)
    engine.delete_collection("c")
    engine.import_snapshot(folder)
    return whole(engine).withColumn("slot", F.col("id").cast("long"))


@query(f"SELECT 'live' AS what, id, checksum, payload FROM ({_WHOLE}) WHERE n % 2 = 0 UNION ALL SELECT 'restored', id, checksum, payload FROM ({_WHOLE})")
def promote_collection(spark, sf_dir):
    """A rebuilt collection takes the live one's name; the backup can be named and restored."""
    engine = collection(spark, sf_dir)
    engine.create_collection("c.rebuild-1", {"dim": DIM, "index": "Flat"})
    engine.upsert_dataframe("c.rebuild-1", points(spark, sf_dir).where("slot % 2 = 0").select("id", "vector", "payload", F.col("slot").alias("seq")), payload="payload")
    engine.promote_temp_collection("c.rebuild-1", "c")
    rows = whole(engine).select("id", "checksum", "payload").collect()
    engine.restore_promote_backup("c")
    live = spark.createDataFrame(rows, "id string, checksum double, payload string").select(F.lit("live").alias("what"), "*")
    return live.unionByName(whole(engine).select(F.lit("restored").alias("what"), "id", "checksum", "payload"))


def _streamed(spark, sf_dir, again: bool) -> Engine:
    engine = Engine(spark, scratch_folder(spark, "collections"))
    engine.create_collection("c", {"dim": DIM, "index": "Flat"})
    folder = scratch_folder(spark, "stream")
    rows = points(spark, sf_dir).select("id", "vector", "payload", F.col("slot").alias("seq"))
    rows.repartition(2).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    upsert_stream(engine, "c", stream, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if again:
        other = turned(spark, sf_dir, "slot % 2 = 0")
        engine.upsert_dataframe("c", other, payload="payload", batch=(f"{folder}/checkpoint", 0))
    return engine


@query(f"{_ROW} ({_WHOLE})")
def stream_ingest(spark, sf_dir):
    """Embeddings that come as a stream of files end up in the collection."""
    return whole(_streamed(spark, sf_dir, False))


@query(f"{_ROW} ({_WHOLE})")
def stream_replay(spark, sf_dir):
    """A micro-batch whose number has been written already changes nothing."""
    return whole(_streamed(spark, sf_dir, True))


@query(batch_sql(k=3))
def stream_search(spark, sf_dir):
    """A stream of queries against a collection."""
    engine, folder = collection(spark, sf_dir), scratch_folder(spark, "stream")
    asked = embeddings(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    asked.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(asked.schema).parquet(f"{folder}/in")
    search_queries(engine, "c", stream, 3, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))

