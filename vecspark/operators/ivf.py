"""Inverted lists: points are filed under their nearest centroid, and a search reads the lists nearest to its vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions import distance as D
from vecspark.operators.quantization import kmeans, nearest, sample_vectors
from vecspark.operators.search import CELLS, Best, in_blocks
from vecspark.types import IvfConfig


def _shaped(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows of length 1 for Cosine and Dot."""
    if metric not in ("Cosine", "Dot"):
        return x
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(norm == 0, x, x / np.where(norm == 0, 1, norm))


def train(points: DataFrame, config: IvfConfig, metric: str, live: int) -> np.ndarray:
    """Centroids of config.sample_limit vectors at most."""
    data = _shaped(sample_vectors(points, config.sample_limit), metric)
    centres = kmeans(data, min(config.lists_for(live), len(data)), config.kmeans_max_iter)
    return _shaped(centres, metric)


def assign(points: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    """points with list_id int and list_distance double. Of equally near lists the lowest counts. There are 4096 centroids at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("vector")
            own, far = nearest(_shaped(D.matrix(batch.column(at)).astype(np.float64), metric), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(np.sqrt(far))], [*batch.schema.names, "list_id", "list_distance"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{fields}, list_id int, list_distance double")


def nearest_lists(vectors: np.ndarray, centroids: np.ndarray, nprobe: int) -> np.ndarray:
    """The numbers of the nprobe lists nearest to each vector; of equally near ones the lowest. CELLS distances at a time."""
    out = np.empty((len(vectors), min(nprobe, len(centroids))), np.int64)
    norms = (centroids**2).sum(1)
    step = max(1, CELLS // len(centroids))
    for at in range(0, len(vectors), step):
        out[at : at + step] = np.argsort(norms - 2 * vectors[at : at + step] @ centroids.T, axis=1, kind="stable")[:, :nprobe]
    return out


def probe_order(query: list[float], centroids: np.ndarray, metric: str) -> list[int]:
    """The lists by distance from the query."""
    far = ((centroids - _shaped(np.array([query], np.float64), metric)) ** 2).sum(1)
    return np.argsort(far, kind="stable").tolist()


def probe(assigned: DataFrame, order: list[int], nprobe: int) -> DataFrame:
    """The points of the nearest lists; where points are partitioned by list_id, only their folders are read."""
    return assigned.where(F.col("list_id").isin(order[:nprobe]))


def batch_probe(assigned: DataFrame, queries: DataFrame, centroids: np.ndarray, nprobe: int, k: int, metric: str) -> DataFrame:
    """queries: qid long, vector. (qid, slot, id, score) of the k best points of each query in the lists nearest to it.

    A task scores the points of a list against the queries that probe it and keeps k rows for each query. Queries go out in
    blocks as in batch_search().
    """

    def near(qids: np.ndarray, vectors: np.ndarray):
        probes = nearest_lists(_shaped(vectors, metric), centroids, nprobe) if len(qids) else np.empty((0, 1), np.int64)
        order = np.argsort(probes.ravel(), kind="stable")
        asking, first = order // probes.shape[1], np.searchsorted(probes.ravel()[order], np.arange(len(centroids) + 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(qids, vectors, k, metric)
            for batch in batches:
                lists = batch.column(3).to_numpy()
                for i in np.unique(lists).tolist():
                    best.see(batch.filter(pa.array(lists == i)), asking[first[i] : first[i + 1]])
            yield from best.found()

        return run

    return in_blocks(assigned, queries, None, near, "list_id", k=k + nprobe)


def drift(assigned: DataFrame, baseline: float) -> float:
    """How much farther from their centroids points are than they were: 0 if not at all."""
    mean = assigned.agg(F.avg("list_distance")).first()[0]
    if mean is None:
        return 0.0
    if baseline <= 1e-9:
        return 0.0 if mean <= 1e-9 else 1e6
    return float(min(1e6, max(0.0, (mean - baseline) / baseline)))
