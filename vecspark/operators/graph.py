"""Navigable small-world graphs, one for each shard of the points, for batches of queries.

A shard of bounded size is built in one task and is one row of a table. A search loads each shard once for all queries of a
block, walks its graph for each and merges the best of all shards, so its quality doesn't depend on how many shards there are.
It reads what an exact search reads and saves scores only; inverted lists and codes are what saves reading.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.distance import scores
from vecspark.operators.search import in_blocks
from vecspark.types import HnswConfig

#: Points of a shard, about.
SHARD = 20_000
#: Queries whose results are held in a task at a time.
TOLD = 256


class Graph:
    """Links of the points 0 to n - 1 on layers; farther means a lower score."""

    def __init__(self, vectors: np.ndarray, metric: str, config: HnswConfig) -> None:
        self.vectors, self.metric, self.config = vectors, metric, config
        self.links: list[dict[int, list[int]]] = []
        self.entry = -1

    def far(self, query: np.ndarray, nodes: list[int]) -> np.ndarray:
        return -scores(self.metric, query[None], self.vectors[nodes])[0]

    def build(self, seed: int = 11) -> Graph:
        rng = np.random.default_rng(seed)
        scale = 1 / math.log(self.config.m)
        for node in range(len(self.vectors)):
            self._insert(node, min(32, int(-math.log(1 - rng.random()) * scale)))
        return self

    def _insert(self, node: int, level: int) -> None:
        top = len(self.links) - 1
        near = [self.entry] if self.entry >= 0 else []
        query = self.vectors[node]
        for layer in range(top, level, -1):
            near = [self._walk(query, near, layer, 1)[0][1]]
        for layer in range(min(top, level), -1, -1):
            found = self._walk(query, near, layer, self.config.ef_construct)
            chosen = self._spread(found, self.config.m)
            self.links[layer][node] = chosen
            most = self.config.m * (2 if layer == 0 else 1)
            for other in chosen:
                own = self.links[layer][other]
                own.append(node)
                if len(own) > most:
                    d = self.far(self.vectors[other], own)
                    self.links[layer][other] = self._spread(sorted(zip(d.tolist(), own, strict=True)), most)
            near = [x for _, x in found]
        for _ in range(top, level):
            self.links.append({node: []})
            self.entry = node

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near ones that are nearer to the point than to any chosen before; then the rest, until there are enough."""
        chosen: list[int] = []
        left = []
        for d, x in found:
            if len(chosen) == most:
                break
            if not chosen or (self.far(self.vectors[x], chosen) > d).all():
                chosen.append(x)
            else:
                left.append(x)
        return chosen + left[: most - len(chosen)]

    def _walk(self, query: np.ndarray, start: list[int], layer: int, width: int) -> list[tuple[float, int]]:
        """(distance, node) of up to `width` near nodes, nearest first."""
        seen = set(start)
        d = self.far(query, start).tolist()
        todo = list(zip(d, start, strict=True))
        heapq.heapify(todo)
        best = [(-x, n) for x, n in todo]
        heapq.heapify(best)
        while todo:
            far, node = heapq.heappop(todo)
            if len(best) >= width and far > -best[0][0]:
                break
            new = [x for x in self.links[layer].get(node, ()) if x not in seen]
            if not new:
                continue
            seen.update(new)
            for far, x in zip(self.far(query, new).tolist(), new, strict=True):
                if len(best) < width or far < -best[0][0]:
                    heapq.heappush(todo, (far, x))
                    heapq.heappush(best, (-far, x))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-x, n) for x, n in best)

    def search(self, query: np.ndarray, width: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        near = [self.entry]
        for layer in range(len(self.links) - 1, 0, -1):
            near = [self._walk(query, near, layer, 1)[0][1]]
        return self._walk(query, near, 0, width)


def build(points: DataFrame, metric: str, config: HnswConfig, shard: int = SHARD) -> DataFrame:
    """(shard, graph binary, slots array<long>, ids array<string>): a built graph for each shard of about `shard` points."""
    shards = max(1, math.ceil(points.count() / shard))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot")
        graph = Graph(np.stack(rows.vector.to_numpy()).astype(np.float32), metric, config).build()
        return pd.DataFrame({"shard": [rows.shard.iloc[0]], "graph": [pickle.dumps((graph.links, graph.entry, graph.vectors))], "slots": [rows.slot.tolist()], "ids": [rows.id.tolist()]})

    dealt = points.select(F.pmod(F.xxhash64("slot"), F.lit(shards)).cast("int").alias("shard"), "slot", "id", "vector")
    return dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(one, "shard int, graph binary, slots array<long>, ids array<string>")


def batch_search(graphs: DataFrame, queries: DataFrame, metric: str, config: HnswConfig, width: int, k: int | None = None) -> DataFrame:
    """queries: qid long, vector. (qid, slot, id, score) of up to `width` near points of each shard for each query, or the k best
    of them. A shard is loaded once for a block of queries, which go out as in the exact batch search; what is found for TOLD
    queries goes on at a time."""

    def near(qids: np.ndarray, vectors: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    links, entry, stored = pickle.loads(batch.column(2)[i].as_py())
                    graph = Graph(stored, metric, config)
                    graph.links, graph.entry = links, entry
                    slots, ids = batch.column(0)[i].values, batch.column(1)[i].values
                    for told in range(0, len(qids), TOLD):
                        found = [(q, n, -far) for q, v in zip(qids[told : told + TOLD].tolist(), vectors[told : told + TOLD], strict=True) for far, n in graph.search(v, width)[:k]]
                        at = pa.array([n for _, n, _ in found], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([q for q, *_ in found], pa.int64()), slots.take(at), ids.take(at), pa.array([s for *_, s in found], pa.float64())], ["qid", "slot", "id", "score"])

        return run

    shards = graphs.select(F.col("slots").alias("slot"), F.col("ids").alias("id"), F.col("graph").alias("vector"))
    return in_blocks(shards, queries, None, near)


def search(graphs: DataFrame, query: list[float], metric: str, config: HnswConfig, width: int, allowed: DataFrame | None = None) -> DataFrame:
    """(slot, id, score) of up to `width` near points of each shard. allowed: the slots that may be in the result."""
    asked = graphs.sparkSession.createDataFrame([(0, [float(x) for x in query])], "qid long, vector array<double>")
    found = batch_search(graphs, asked, metric, config, width).drop("qid")
    return found if allowed is None else found.join(allowed.select("slot"), "slot", "left_semi")
