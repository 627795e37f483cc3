"""Scalar, binary and product codes of vectors, and two-stage search over them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import distance as D
from vecspark.operators.search import Best, in_blocks, pieces, rank_scored
from vecspark.sources.files import checkpointed

#: Vectors that codebooks are trained on, about, and rows that are held against all centres together.
MOST_VECTORS, ROWS = 10_000, 4096
OVERSAMPLE = {"scalar": 2.0, "binary": 4.0, "product": 3.0}


def order_statistics(values: DataFrame, ranks: list[int]) -> list:
    """The values in column x that stand at ranks (from 0) in their order: counts by value in ranges, of which one is looked into."""
    counts = checkpointed(values.groupBy("x").agg(F.count("*").alias("n")).repartitionByRange("x").withColumn("_part", F.spark_partition_id()))
    before, places = 0, {}
    for r in counts.groupBy("_part").agg(F.sum("n").alias("n")).orderBy("_part").collect():
        places |= {rank: (r["_part"], rank - before) for rank in ranks if before <= rank < before + r.n}
        before += r.n
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("x"))
    found = []
    for rank in ranks:
        part, at = places[rank]
        found.append(counts.where(F.col("_part") == part).withColumn("_upto", upto).where(F.col("_upto") > at).agg(F.min("x")).first()[0])
    return found


def scalar_range(points: DataFrame, quantile: float, dim: int) -> tuple[float, float]:
    """The order statistics of all elements between which values are coded."""
    if quantile >= 1:
        r = points.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
        return (float(r[0]), float(r[1])) if r[0] is not None else (0.0, 0.0)
    n = points.count() * dim
    if not n:
        return 0.0, 0.0
    low, high = order_statistics(points.select(F.explode("vector").alias("x")), [math.floor((1 - quantile) / 2 * n), min(n - 1, math.floor((1 + quantile) / 2 * n))])
    return float(low), float(high)


def scalar_codes(vector: Column, low: float, high: float) -> Column:
    """0 to 255 for each element."""
    scale = (high - low) / 255 if high - low >= 1e-9 else 1.0
    return F.transform(vector, lambda x: F.round((F.greatest(F.lit(low), F.least(F.lit(high), x.cast("double"))) - low) / scale).cast("short"))


def scalar_values(codes: Column, low: float, high: float) -> Column:
    scale = (high - low) / 255 if high - low >= 1e-9 else 1.0
    return F.transform(codes, lambda c: F.lit(low) + c.cast("double") * scale)


def binary_words(vector: Column, dim: int) -> Column:
    """Longs of 63 signs each, the first element in the lowest bit: set where an element is above 0."""
    word = lambda at: F.aggregate(F.sequence(F.lit(min(dim, at + 63) - 1), F.lit(at), F.lit(-1)), F.lit(0).cast("long"), lambda w, i: F.shiftleft(w, 1).bitwiseOR(F.when(F.get(vector, i) > 0, 1).otherwise(0).cast("long")))
    return F.array(*[word(at) for at in range(0, dim, 63)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def kmeans(data: np.ndarray, k: int, rounds: int, start: np.ndarray | None = None, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from `start`, or after k-means++ seeding, for a bounded sample. An empty cluster takes the farthest vector."""
    centres = start if start is not None else _seeded(data, k, np.random.default_rng(seed))
    for _ in range(rounds):
        own, far = nearest(data, centres)
        new = np.stack([data[own == i].mean(0) if (own == i).any() else data[far.argmax()] for i in range(k)])
        moved = np.sqrt(((new - centres) ** 2).sum(1)).sum() / k
        centres = new
        if moved < 1e-3:
            break
    return centres


def _seeded(data: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    chosen = [int(rng.integers(len(data)))]
    near = ((data - data[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = near.sum()
        chosen.append(int(rng.choice(len(data), p=near / total) if total > 0 else rng.integers(len(data))))
        near = np.minimum(near, ((data - data[chosen[-1]]) ** 2).sum(1))
    return data[chosen]


def nearest(data: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equals, and its squared distance; ROWS rows at a time."""
    own, near = np.empty(len(data), np.int64), np.empty(len(data))
    norms = (centres**2).sum(1)
    for at in range(0, len(data), ROWS):
        some = data[at : at + ROWS]
        far = np.maximum((some**2).sum(1)[:, None] - 2 * some @ centres.T + norms, 0)
        own[at : at + ROWS] = far.argmin(1)
        near[at : at + ROWS] = far[np.arange(len(some)), own[at : at + ROWS]]
    return own, near


def sample_vectors(points: DataFrame, most: int) -> np.ndarray:
    """About `most` vectors at most, those of the least hashes of their slots: the bound of what a model is fitted on."""
    n, top = points.count(), 1 << 40
    some = points.where(F.pmod(F.xxhash64("slot"), F.lit(top)) < round(min(1.0, most / max(1, n)) * top)) if n > most else points
    vectors = some.sort(F.xxhash64("slot"), "slot").select("vector").toArrow().column(0).combine_chunks()
    return np.asarray(vectors.flatten(), np.float32).reshape(len(vectors), -1).astype(np.float64) if len(vectors) else np.empty((0, 0))


def product_codebooks(points: DataFrame, parts: int) -> np.ndarray:
    """parts x 256 x (dim / parts) centres of a bounded sample; where there are fewer, the last one is repeated."""
    data = sample_vectors(points, MOST_VECTORS)
    k = min(256, max(1, len(data) // 4))
    rounds = 20 if len(data) < 2048 else 100
    books = []
    for part in np.split(data, parts, axis=1):
        centres = kmeans(part, k, rounds)
        books.append(np.vstack([centres, np.repeat(centres[-1:], 256 - k, axis=0)]))
    return np.stack(books)


def product_encode(points: DataFrame, books: np.ndarray) -> DataFrame:
    """points with code binary: a byte for each subspace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("vector") if at is None else at
            if not batch.num_rows:
                continue
            vectors = D.matrix(batch.column(at)).astype(np.float64)
            codes = np.stack([nearest(x, b)[0] for x, b in zip(np.split(vectors, len(books), axis=1), books, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "code"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{fields}, code binary")


def product_scores(coded: DataFrame, books: np.ndarray, query: list[float], metric: str) -> DataFrame:
    """(slot, id, score): the query against what the codes stand for, by one table of partial sums for each subspace."""
    q = np.split(np.array(query, np.float64), len(books))
    dots = np.stack([b @ x for b, x in zip(books, q, strict=True)])
    norms = (books**2).sum(2)
    l2 = np.stack([((b - x) ** 2).sum(1) for b, x in zip(books, q, strict=True)])
    l1 = np.stack([np.abs(b - x).sum(1) for b, x in zip(books, q, strict=True)])
    length = float(np.sqrt((np.array(query) ** 2).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.arange(len(books))
        for batch in batches:
            codes = np.array([list(c.as_py()) for c in batch.column(2)], np.int64).reshape(-1, len(books))
            total = lambda t, codes=codes: t[part, codes].sum(1)
            if metric == "Dot":
                s = total(dots)
            elif metric == "Cosine":
                norm = np.sqrt(total(norms)) * length
                s = np.where(norm == 0, 0.0, np.clip(total(dots) / np.where(norm == 0, 1, norm), -1, 1))
            else:
                s = 1 / (1 + np.sqrt(total(l2 if metric == "Euclid" else l1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["slot", "id", "score"])

    return coded.select("slot", "id", "code").mapInArrow(run, "slot long, id string, score double")


def coarse_width(kind: str, k: int, n: int, oversampling: float | None = None) -> int:
    return max(k, min(math.ceil(k * (oversampling or OVERSAMPLE[kind])), n))


def two_stage(coarse: DataFrame, points: DataFrame, query: list[float], metric: str, k: int, width: int, offset: int = 0, threshold: float | None = None) -> DataFrame:
    """The best `width` rows of coarse (slot, id, score), scored again from their vectors."""
    some = best_coarse(coarse, width)
    exact = points.join(F.broadcast(some), "slot").select("slot", "id", D.score(metric, F.col("vector"), D.vector(query)).alias("score"))
    return rank_scored(exact, k, offset, threshold)


def best_coarse(coarse: DataFrame, width: int) -> DataFrame:
    return coarse.orderBy(F.desc("score"), F.desc("slot")).limit(width).select("slot")


def stood_for(codes: pa.Array, known: dict) -> np.ndarray:
    """A row for each code: what scalar or product codes stand for, or the signs of binary ones."""
    if known["kind"] == "scalar":
        low, high = known["low"], known["high"]
        return low + D.matrix(codes).astype(np.float64) * ((high - low) / 255 if high - low >= 1e-9 else 1.0)
    if known["kind"] == "binary":
        words, dim = D.matrix(codes), np.arange(known["dim"])
        return ((words[:, dim // 63] >> (dim % 63)) & 1) * 2.0 - 1
    books = known["books"]
    numbers = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, len(books))
    return books[np.arange(len(books)), numbers].reshape(len(numbers), -1)


def batch_two_stage(coded: DataFrame, queries: DataFrame, known: dict, k: int, width: int, metric: str) -> DataFrame:
    """coded: slot, id, vector, code. (qid, slot, id, score) of the k best points of each task for each query.

    Of every ROWS points the `width` that come first by their codes are scored by their vectors, in the task that has both, so
    the share of points that is scored and with it the recall is the same at every size, and only k rows of each task go on.
    The products of a query and the signs of a point, for binary codes, order points as all metrics do, but for Manhattan, about.
    """
    known = known | {"books": np.array(known.get("books", []))}
    by = "Dot" if known["kind"] == "binary" else metric

    def near(qids: np.ndarray, vectors: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(qids, vectors, k, metric)
            for batch in batches:
                for points in pieces(batch):
                    best.see(points, coarse=(stood_for(points.column(3), known), by, width))
            yield from best.found()

        return run

    return in_blocks(coded, queries, None, near, "code", k=k)
