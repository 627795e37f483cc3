"""Top-k similarity search over points (slot, id, vector, payload).

Ranking is by score. Of equal scores the larger slots make it into the top k, and the result lists the smaller slot first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from vecspark.functions import distance as D
from vecspark.functions.payload import select_keys
from vecspark.plans.filters import compile_filter
from vecspark.types import SearchQuery, check_vector


def filtered(points: DataFrame, spec, shadows: dict[str, Column] | None = None) -> DataFrame:
    return points.where(compile_filter(spec, F.col("payload"), F.col("id"), shadows)) if spec else points


def rank_scored(scored: DataFrame, k: int, offset: int = 0, threshold: float | None = None) -> DataFrame:
    """The rows k after the first `offset` by the `score` and `slot` of scored; two bounded heaps, no full sort."""
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    top = scored.orderBy(F.desc("score"), F.desc("slot")).limit(offset + k)
    return top.orderBy(F.desc("score"), F.asc("slot")).offset(offset).limit(k)


def search(points: DataFrame, query: SearchQuery, metric: str, dim: int, shadows: dict[str, Column] | None = None) -> DataFrame:
    """The exact result: id, score, and payload and vector if the query asks for them.

    Scores are ranked without payloads; those of the winners, as many as the query asks for, are fetched by their slots.
    """
    best = best_scored(filtered(points, query.filter, shadows), check_vector(query.vector, dim), query.wanted + query.offset, metric, query.threshold)
    return fetch(points, rank_scored(best, query.wanted, query.offset), query)


def best_scored(points: DataFrame, vector: list[float], k: int, metric: str, threshold: float | None = None) -> DataFrame:
    """(slot, id, score) of the k best points of each task, scored an Arrow batch at a time."""
    task = best_of(np.zeros(1, np.int64), np.array([vector], np.float64), k, metric, threshold)
    return points.select("slot", "id", "vector").mapInArrow(task, "qid long, slot long, id string, score double").drop("qid")


def fetch(points: DataFrame, winners: DataFrame, query: SearchQuery) -> DataFrame:
    if not query.wide:
        return winners.select("id", "score")
    found = projected(points.select("slot", *query.wide).join(F.broadcast(winners), "slot"), query)  # as many rows as asked for
    return found.orderBy(F.desc("score"), "slot").select("id", "score", *query.wide)


def projected(found: DataFrame, query: SearchQuery) -> DataFrame:
    """found with the keys of payloads that the query asks for."""
    if query.with_payload and (query.include is not None or query.exclude):
        return found.withColumn("payload", select_keys(F.col("payload"), query.include, query.exclude))
    return found


#: Bytes of queries, and of what is kept for them, that a pass over the points takes; queries that a pass takes at least.
PASS_BYTES, LEAST = 64 << 20, 1024
#: Points that are scored together, and scores that a task holds at a time at most.
ROWS, CELLS = 4096, 1 << 20
#: Bytes of a kept row, about, new rows that wait until the best are told from them, and rows that take what a table by itself does.
ROW_BYTES, WAITING, TABLE_ROWS = 64, 1 << 17, 128
#: What a score by matrix product may be off, for scores of up to 1.
SLACK = 1e-9


def batch_search(points: DataFrame, queries: DataFrame, k: int, metric: str, threshold: float | None = None, block: int | None = None) -> DataFrame:
    """queries: qid long, vector. Returns qid, id, slot, score, rank of the k best points for each query.

    A pass over the points takes `block` queries, by default as many as have PASS_BYTES with the rows that are kept for them.
    A task holds half of CELLS scores at a time and k rows for each query, so neither its memory nor what is shuffled grows with its
    points.
    """
    return top_of_each(in_blocks(points, queries, block, lambda qids, vectors: best_of(qids, vectors, k, metric, threshold), k=k), k)


def top_of_each(found: DataFrame, k: int) -> DataFrame:
    """The k best of each qid in found (qid, slot, id, score), with their rank."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("slot"))
    top = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "slot")))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """ROWS rows at a time."""
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def blocks(queries: np.ndarray, points: int, cells: int = CELLS) -> Iterator[np.ndarray]:
    """As many queries at a time as have so many scores (cells) with so many points."""
    step = max(1, cells // max(1, points))
    for at in range(0, len(queries), step):
        yield queries[at : at + step]


def at_least_kth(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row of scores, or -inf where there are no more than k."""
    return np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)


class Best:
    """The k best points of each query among those seen: by score, and of equal scores by slot, larger ones first.

    Matrix products tell which points may be among them; their scores are then summed from left to right, so equal vectors have
    equal scores wherever they stand.
    """

    def __init__(self, qids: np.ndarray, vectors: np.ndarray, k: int, metric: str, threshold: float | None = None) -> None:
        self.qids, self.vectors, self.k, self.metric = qids, vectors, k, metric
        self.floor = np.full(len(qids), -np.inf if threshold is None else threshold)
        self.tables: list[pa.Table] = []
        self.waiting = 0

    def see(self, batch: pa.RecordBatch, asking: np.ndarray | None = None, coarse: tuple[np.ndarray, str, int] | None = None) -> None:
        """Points (slot, id, vector) for the queries of the numbers `asking`, or for all. coarse: what stands for the vectors of
        a batch of ROWS points or fewer, a metric, and how many points that score best by them are scored by their vectors."""
        asking = np.arange(len(self.qids)) if asking is None else asking
        for points in pieces(batch):
            if not len(asking):
                return
            x = D.matrix(points.column(2)).astype(np.float64)
            near: list[tuple[np.ndarray, np.ndarray]] = []
            for some in blocks(asking, len(x), CELLS // 2):
                row, col = self._near(some, x, coarse)
                near.append((some[row], col))
                if sum(len(col) for _, col in near) > WAITING:
                    self._add(points, x, near)
                    near = []
            self._add(points, x, near)

    def _near(self, some: np.ndarray, x: np.ndarray, coarse: tuple[np.ndarray, str, int] | None) -> tuple[np.ndarray, np.ndarray]:
        """The places in `some`, and the points of x, that may be among the best."""
        if coarse:
            s = D.scores(coarse[1], self.vectors[some], coarse[0])
            return np.nonzero(s >= at_least_kth(s, coarse[2])[:, None])
        s = D.scores(self.metric, self.vectors[some], x)
        low, off = self.floor[some], SLACK * max(1.0, s.max(), -s.min())
        near = s >= (low - off)[:, None]
        if np.count_nonzero(near) > 4 * self.k * len(some):
            near &= s >= (at_least_kth(s, self.k) - off)[:, None]
        return np.nonzero(near)

    def _add(self, points: pa.RecordBatch, x: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if not near:
            return
        query, col = (np.concatenate(n) for n in zip(*near, strict=True))
        s = D.pair_scores(self.metric, self.vectors, x, query, col)
        good = s >= self.floor[query]
        if not good.any():
            return
        at = pa.array(col[good])
        self.tables.append(pa.table({"query": query[good], "slot": points.column(0).take(at), "id": points.column(1).take(at), "score": s[good]}))
        self.waiting += len(at) + TABLE_ROWS
        if self.waiting > WAITING:
            self._settle()

    def _settle(self) -> None:
        ranked = pa.concat_tables(self.tables).sort_by([("query", "ascending"), ("score", "descending"), ("slot", "descending")])
        query = ranked.column("query").to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, np.int64)
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        last = place == self.k - 1
        self.floor[query[last]] = ranked.column("score").to_numpy()[last]
        self.tables, self.waiting = [ranked.filter(pa.array(place < self.k)).combine_chunks()], 0

    def found(self) -> Iterator[pa.RecordBatch]:
        """(qid, slot, id, score)"""
        if self.tables:
            self._settle()
            kept = self.tables[0]
            yield from kept.set_column(0, "qid", pa.array(self.qids[kept.column("query").to_numpy()])).to_batches(max_chunksize=WAITING)


def best_of(qids: np.ndarray, vectors: np.ndarray, k: int, metric: str, threshold: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(qids, vectors, k, metric, threshold)
        for batch in batches:
            best.see(batch)
        yield from best.found()

    return run


def in_blocks(points: DataFrame, queries: DataFrame, block: int | None, task, *more: str, k: int = 0) -> DataFrame:
    """Points passed through task(qids, vectors) for each block of queries, which goes out with the tasks. k: how many rows a
    task keeps for a query."""
    told = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    block = block or max(LEAST, PASS_BYTES // (8 * (told.dim or 1) + ROW_BYTES * k))
    passes = max(1, -(-told.n // block))
    found = None
    for i in range(passes):
        some = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i)
        rows = some.select(F.col("qid").cast("long"), F.col("vector").cast("array<double>")).toArrow()  # about `block` queries
        vectors = np.array(rows.column(1).combine_chunks().flatten()).reshape(rows.num_rows, -1) if rows.num_rows else np.empty((0, 0))
        part = points.select("slot", "id", "vector", *more).mapInArrow(task(rows.column(0).to_numpy(), vectors), "qid long, slot long, id string, score double")
        found = part if found is None else found.unionByName(part)
    return found


def similarity_join(points: DataFrame, queries: DataFrame, floor: float, metric: str, block: int | None = None) -> DataFrame:
    """All (qid, id, score) with a score of floor or more; nothing is shuffled. Queries go out in blocks as in batch_search()."""

    def all_near(qids: np.ndarray, vectors: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in pieces(batch):
                    x = D.matrix(some.column(2)).astype(np.float64)
                    for asked in blocks(np.arange(len(qids)), len(x)):
                        s = D.scores(metric, vectors[asked], x)
                        row, col = np.nonzero(s >= floor - SLACK * max(1.0, s.max(), -s.min()))
                        exact = D.pair_scores(metric, vectors, x, asked[row], col)
                        good = exact >= floor
                        at = pa.array(col[good])
                        yield pa.RecordBatch.from_arrays([pa.array(qids[asked[row[good]]]), some.column(0).take(at), some.column(1).take(at), pa.array(exact[good])], ["qid", "slot", "id", "score"])

        return run

    return in_blocks(points, queries, block, all_near).select("qid", "id", "score")


#: Vectors that are compared with as many others in one group, where links are counted and where pairs are rows.
BLOCK, PAIR_BLOCK = 1 << 15, 1 << 13
#: Blocks that pairs are made of at least, so that many tasks share them, as long as a block has so many vectors.
SPREAD, SPREAD_ROWS = 12, 1024


def _pairs_of_blocks(rows: DataFrame, block: int, spread: int = 1) -> GroupedData:
    """rows (slot and more) in groups of every two blocks of about `block` rows: a and b, and whether a row is of the second.
    spread: how many blocks of SPREAD_ROWS there are at least."""
    told = rows.count()
    n = max(1, -(-told // block), min(spread, -(-told // SPREAD_ROWS)))
    own = F.pmod(F.xxhash64("slot"), F.lit(n)).cast("int").alias("own")
    sent = rows.select(*rows.columns, own, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    groups = sent.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"), *rows.columns)
    return groups.repartition(n * (n + 1) // 2, "a", "b").groupBy("a", "b")


def _sides(table: pa.Table) -> list[pa.Table]:
    """The two blocks of a group, or the only one."""
    second = table.column("second").to_numpy()
    return [table] if table.column("a")[0] == table.column("b")[0] else [table.filter(pa.array(m)) for m in (~second, second)]


def similarity_self_join(points: DataFrame, floor: float, metric: str, block: int = PAIR_BLOCK) -> DataFrame:
    """All (qid, id, score) of two points with a score of floor or more, both ways: the slot of one and the id of the other. Of
    points with equal slots there are no pairs.

    Every two blocks of points are a group, which is compared once for both sides and gives its pairs a part at a time.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(pa.Table.from_batches(batches))
        slots, ids = zip(*((t.column("slot").to_numpy(), t.column("id").combine_chunks()) for t in sides), strict=True)
        vectors = [np.asfortranarray(D.matrix(t.column("vector").combine_chunks()), np.float64) for t in sides]
        mine, theirs = 0, len(sides) - 1
        for at in range(0, len(slots[theirs]), ROWS):
            x = vectors[theirs][at : at + ROWS]
            for rows in blocks(np.arange(len(slots[mine])), len(x), CELLS // 2):
                if mine == theirs and rows[0] >= at + len(x):
                    break
                s = D.scores(metric, vectors[mine][rows], x)
                row, col = np.nonzero(s >= floor - SLACK * max(1.0, s.max(), -s.min()))
                row, col = rows[row], col + at
                if mine == theirs:
                    row, col = row[row < col], col[row < col]
                score = D.pair_scores(metric, vectors[mine], vectors[theirs], row, col)
                good = (score >= floor) & (slots[mine][row] != slots[theirs][col])
                row, col, score = row[good], col[good], pa.array(score[good])
                for a, one, b, other in ((mine, row, theirs, col), (theirs, col, mine, row)):
                    yield pa.RecordBatch.from_arrays([pa.array(slots[a][one]), ids[b].take(pa.array(other)), score], ["qid", "id", "score"])

    return _pairs_of_blocks(points.select("slot", "id", "vector"), block, SPREAD).applyInArrow(near, "qid long, id string, score double")


def cosine_links(classes: DataFrame, floor: float) -> DataFrame:
    """classes: slot long, vector, size long. Returns slot, and links long: the sizes of all classes whose vectors have a cosine
    of floor or more with its own, itself included.

    Every two blocks of about BLOCK classes are a group, which is compared once for both sides and gives a sum for each class.
    So pairs are neither moved nor kept: a vector is sent once for each block, and a group's size is bounded. Products of single
    precision decide all but what they bring near the floor.
    """

    def count(table: pa.Table) -> pa.Table:
        sides = _sides(table)
        slots, vectors, sizes = zip(*((t.column("slot").to_numpy(), D.matrix(t.column("vector").combine_chunks()), t.column("size").to_numpy()) for t in sides), strict=True)
        unit = [_unit(v) for v in vectors]
        links = [np.zeros(len(x)) for x in slots]
        off = 4 * vectors[0].shape[1] * np.finfo(np.float32).eps
        mine, theirs = 0, len(sides) - 1
        for at in range(0, len(slots[theirs]), ROWS):
            cols = slice(at, at + ROWS)
            x = vectors[theirs][cols].astype(np.float64)
            for rows in blocks(np.arange(len(slots[mine])), len(x)):
                s = unit[mine][rows] @ unit[theirs][cols].T
                near = (s >= floor - off).astype(np.float64)
                row, col = np.nonzero((s >= floor - off) & (s <= floor + off))
                near[row, col] = D.pair_scores("Cosine", vectors[mine], x, rows[row], col) >= floor
                links[mine][rows] += near @ sizes[theirs][cols]
                if mine != theirs:
                    links[theirs][cols] += sizes[mine][rows] @ near
        return pa.table({"slot": np.concatenate(slots), "links": np.concatenate(links).astype(np.int64)})

    counted = _pairs_of_blocks(classes.select("slot", "vector", F.col("size").cast("double").alias("size")), BLOCK).applyInArrow(count, "slot long, links long")
    return counted.groupBy("slot").agg(F.sum("links").alias("links"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows over their lengths in single precision; a zero vector stays."""
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    return (vectors / np.where(norm == 0, 1, norm)[:, None]).astype(np.float32)
