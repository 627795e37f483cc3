"""Benchmark decontamination: which test items stand in which documents, by containment of word shingles.

Items are partitioned by their number of shingles n, in classes from 2^c to 2^(c + 1) - 1. An item that is contained to t or
more lacks at most l(n) of its shingles, so of the k least of its shingle hashes (a bottom-k MinHash sketch) at least k - l(n)
are in the document. Each class has a k of its own, twice the largest l(n) in it and one, and is searched by itself: a document,
however long it is, is a candidate for an item once it has that many of the sketch. Candidates are verified on the exact
shingles. No pair over the threshold is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.common import byte_strings, pieces, table
from vecspark.llm.words import LETTERS, Words, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: Bytes of items that are searched for in one pass over the documents; more items make more passes.
BLOCK_BYTES = 16 << 20


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each shingle of words_of(), and how many each text has; the same wherever a shingle stands."""
    data = np.frombuffer(words.norm, np.uint8)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int((words.end - words.start).max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
        of = np.repeat(words.start, words.end - words.start)
        inside = np.flatnonzero(data != 32)
        values = (data[inside].astype(np.uint64) + np.uint64(1)) * power[inside - of]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        at = np.concatenate([[0], np.cumsum(words.end - words.start)])
        word = _mixed(sums[at[1:]] - sums[at[:-1]])
        first, last, number = words.shingles(size)
        out = np.zeros(len(first), np.uint64)
        for i in range(size):
            here = first + i <= last
            out[here] = _mixed(out[here] * np.uint64(0xD6E8FEB86659FD93) + word[(first + i)[here]])
    return out, number


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def lacking(n: int, threshold: float) -> int:
    """How many of n shingles a document can do without."""
    return n - int(np.ceil(n * threshold - 1e-9))


@dataclass(frozen=True)
class SizeClass:
    """The sketches of the items of one class: each hash, whose it is, and how many of an item's a document has to have."""

    sketch: np.ndarray
    owner: np.ndarray
    least: dict[int, int]

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """hashes: distinct ones of a document that are in any sketch of the class."""
        low, high = np.searchsorted(self.sketch, hashes), np.searchsorted(self.sketch, hashes, side="right")
        owners, hits = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(low, high, strict=True)]), return_counts=True)
        return {i for i, n in zip(owners.tolist(), hits.tolist(), strict=True) if n >= self.least[i]}


class Index:
    """The exact shingles of a block of items, and their sketches by class of size."""

    def __init__(self, items: list[tuple[str, str]], size: int, threshold: float) -> None:
        words = words_of([text.encode() for _, text in items], LETTERS)
        hashes, number = shingle_hashes(words, size)
        first, last, _ = words.shingles(size)
        ends = np.cumsum(number)
        self.ids, self.size, self.threshold = [i for i, _ in items], size, threshold
        self.shingles: list[set[bytes]] = []
        by_class: dict[int, list[tuple[int, np.ndarray, int]]] = {}
        for i, (a, b) in enumerate(zip(ends - number, ends, strict=True)):
            self.shingles.append({words.norm[words.start[x] : words.end[y]] for x, y in zip(first[a:b], last[a:b], strict=True)})
            if n := len(self.shingles[-1]):
                c = n.bit_length() - 1
                k = 2 * max(lacking(m, threshold) for m in range(1 << c, 2 << c)) + 1
                some = np.unique(hashes[a:b])[:k]
                by_class.setdefault(c, []).append((i, some, max(1, len(some) - lacking(n, threshold))))
        self.classes: list[SizeClass] = []
        for c in sorted(by_class):
            every = np.concatenate([some for _, some, _ in by_class[c]])
            owner = np.concatenate([np.full(len(some), i) for i, some, _ in by_class[c]])
            order = np.argsort(every, kind="stable")
            self.classes.append(SizeClass(every[order], owner[order], {i: least for i, _, least in by_class[c]}))
        self.any = np.unique(np.concatenate([c.sketch for c in self.classes])) if self.classes else np.empty(0, np.uint64)

    def search(self, words: Words, hashes: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
        """(document's place, item, shared shingles, the item's shingles) of all that reach the threshold."""
        hit = np.flatnonzero(among(hashes, self.any))
        if not len(hit):
            return
        first, last, _ = words.shingles(self.size)
        ends = np.cumsum(number)
        place = np.searchsorted(ends, hit, side="right")
        edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        for x, y in pairwise(edges.tolist()):
            doc, found, items = int(place[x]), np.unique(hashes[hit[x:y]]), set()
            for c in self.classes:
                own = found[among(found, c.sketch)]
                if len(own):
                    items |= c.candidates(own)
            if not items:
                continue
            a, b = ends[doc] - number[doc], ends[doc]
            own = {words.norm[x:y] for x, y in zip(words.start[first[a:b]].tolist(), words.end[last[a:b]].tolist(), strict=True)}
            for i in sorted(items):
                shared = sum(s in own for s in self.shingles[i])
                if shared >= self.threshold * len(self.shingles[i]) - 1e-9:
                    yield doc, self.ids[i], shared, len(self.shingles[i])


def among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Of each hash, whether it is in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id, shared, n_shingles, containment) of `threshold` or more.

    Words are runs of letters, digits and what isn't ASCII, A-Z in lower case, so punctuation doesn't matter. An item of fewer
    words than a shingle is one shingle, which a document has only if those are all its words; items without words, and nulls,
    are in no document. Repeated rows of either table give repeated pairs; equal items are searched for once. Items go out in
    blocks of bounded bytes, each for one pass over the documents, whose texts are never shuffled. Ids may be of any type.
    """
    documents, text_at = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), 1
    items = benchmark.select(F.col(item_id).alias("item_id"), F.sha2(F.col(text).cast("binary"), 256).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    texts = items.select("key", "text").dropDuplicates(["key"])
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    found = None
    for block in range(blocks):
        some = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in some.collect()])  # BLOCK_BYTES, about

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            if not shared.value:
                return
            index = Index(shared.value, size, threshold)
            for batch in pieces(batches, text_at):
                words = words_of(byte_strings(batch.column(text_at)), LETTERS)
                rows = list(index.search(words, *shingle_hashes(words, size)))
                if rows:
                    place, item, common, n = zip(*rows, strict=True)
                    common, n = np.array(common), np.array(n)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(item, pa.string()), pa.array(common, pa.int64()), pa.array(n, pa.int64()), pa.array(common / n)], ["doc_id", "key", "shared", "n_shingles", "containment"])

        part = documents.mapInArrow(run, T.StructType([documents.schema["doc_id"], *PAIR]))
        found = part if found is None else found.unionByName(part)
    return found.join(items.select("item_id", "key"), "key").select("doc_id", "item_id", "shared", "n_shingles", "containment")


PAIR = [T.StructField("key", T.StringType()), T.StructField("shared", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("containment", T.DoubleType())]


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """All pairs of a document and a test item that it contains to 0.8 or more."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shingles_sql(key: str, relation: str) -> str:
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS s FROM (SELECT {key}, {words} AS w FROM {relation}) WHERE len(w) > 0"


OP5_SQL = f"""
WITH items AS ({_shingles_sql("item_id", "benchmark")}), sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id)
SELECT doc_id, item_id, shared, n_shingles, shared / n_shingles AS containment
FROM (SELECT doc_id, item_id, count(*) AS shared FROM ({_shingles_sql("doc_id", "documents")}) JOIN items USING (s) GROUP BY ALL) JOIN sizes USING (item_id)
WHERE shared >= {THRESHOLD} * n_shingles - 1e-9
"""
