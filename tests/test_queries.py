"""The queries of the driver's entry against their SQL at the smallest scale, where the tables are there."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return str(v) if v is not None else None


@pytest.mark.parametrize("name", ["knn_cosine", "knn_batch", "knn_min_should", "filter_nested", "filter_match_any_typed", "upsert_overwrite", "apply_txn", "ivf_probe_n", "pq_encode", "filter_event_props"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = entry.queries()[name](spark, FOLDER)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(map(plain, r)) for r in got.select(*cols).collect()), key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 10


def test_similarity_self_join_counts_all_links(spark, tmp_path):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows.unionByName(rows.where("vec_id % 7 = 1").withColumn("vec_id", F.col("vec_id") + 1_000_001)).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in entry.queries()["duplicate_classes_by_embedding"](spark, str(tmp_path)).select("id", "class_id", "links").collect())
    assert got == sorted(con.sql(f"SELECT id, class_id, links FROM ({entry.oracle_sql()['duplicate_classes_by_embedding']})").fetchall())
    assert any(i != c for i, c, _ in got) and any(n for i, _, n in got if i % 50)


def same_as_sql(spark, folder, name, rows):
    """A query over embeddings of these rows (vec_id, embedding, label) against its SQL."""
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    cols = sorted(got.columns)
    found = sorted(tuple(r) for r in got.select(*cols).collect())
    assert found == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall())
    return found


def axes(*values):
    return [float(x) for x in values] + [0.0] * (64 - len(values))


def test_pairs_whose_score_is_rounded_up_to_the_floor_count(spark, tmp_path):
    rows = [(i, axes(s, math.sqrt(1 - s * s)) if i else axes(1), 0) for i, s in enumerate([1, 0.1999997, 0.199999, 0.2000001, 0.3])]
    assert [r[0] for r in same_as_sql(spark, tmp_path, "duplicate_docs_by_embedding", rows)] == ["1", "3", "4"]


def test_pairs_of_rows_with_any_ids_are_found_both_ways(spark, tmp_path):
    rows = [(1, axes(1), 0), (2, axes(1, 1), 0), (51, axes(1), 0), (100, axes(0, 0, 1), 0), (149, axes(0, 0, 0, 1), 0), (150, axes(0, 0, 0, 0.1999997, 0.97979596), 0)]
    found = same_as_sql(spark, tmp_path, "duplicate_docs_by_embedding", rows)
    assert {(qid, int(i)) for i, qid, _ in found} == {(1, 2), (2, 1), (1, 51), (51, 1), (2, 51), (51, 2), (149, 150), (150, 149)}


def test_filtered_graph_search_has_no_largest_id(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i * 1000, [float(x) for x in rng.normal(size=64)], i % 10) for i in range(60)]
    assert any(int(r[0]) >= 20_000 for r in same_as_sql(spark, tmp_path, "graph_filtered_search", rows))
