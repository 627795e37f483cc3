"""SimHash fingerprints, and near copies among them by covering locality-sensitive hashing.

For radius r there are 2^(r+1) - 1 tables. Each bit of a fingerprint has a vector of r + 1 bits; table v looks at the bits
whose vector has an odd number of ones in common with v. Up to r bits span too little to have ones in common with every v,
so two fingerprints within the radius agree in all bits that some table looks at: none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.common import byte_strings, checkpointed, free_name, pieces, table
from vecspark.llm.components import connected_components
from vecspark.llm.words import BY_SPACE, words_of

BITS, SEED = 64, 42
#: Fingerprints of one bucket that are compared in one task; more are dealt into blocks, each pair of blocks a task's work.
BLOCK = 2048


def fingerprint_texts(df: DataFrame, text: str = "text", shingle: int = 3, out: str = "fingerprint") -> DataFrame:
    """df with `out` long: bit i is set if bit i of XXH64 is in over half of the text's shingles, repeats included.

    Words are parted by ASCII white space, A-Z in lower case. Fewer words than a shingle's: the whole sequence is hashed;
    none, or a null: zero. A column of df named as `out` is replaced.
    """
    df = df.drop(out)
    column = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in pieces(batches, column):
            words = words_of(byte_strings(batch.column(column)), BY_SPACE)
            first, last, number = words.shingles(shingle)
            norm = words.norm
            h = np.array([digest(norm[a:b], SEED) for a, b in zip(words.start[first].tolist(), words.end[last].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_majority(h, number))], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def _majority(h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Of each group of number[i] hashes, the bits that over half of them have."""
    some = np.flatnonzero(number)
    out = np.zeros(len(number), np.int64)
    if len(some):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, (np.cumsum(number) - number)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * counts > number[some, None], axis=1, bitorder="little").view(np.int64).ravel()
    return out


def cover(radius: int) -> list[int]:
    """The masks, as signed longs. Two numbers that differ in `radius` bits at most agree under one of them."""
    wide = (1 << (radius + 1)) - 1
    vectors = [i % wide + 1 for i in range(BITS)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, wide + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def link_fingerprints(fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """fingerprints: one distinct column f long. Returns links (a, b) that connect what is within the radius.

    Not all pairs are given: of what is linked in one bucket, a spanning forest. A bucket of over BLOCK fingerprints is dealt
    into blocks by hash, and each pair of its blocks is compared by itself.
    """
    keys = fingerprints.select("f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(m)) for m in cover(radius)])).alias("t", "key"))
    sizes = keys.groupBy("t", "key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    own = F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = keys.join(sizes, ["t", "key"]).select("f", "t", "key", own.alias("own"), other.alias("other"))
    grouped = dealt.select("f", "own", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("group"))
    return grouped.repartition("group").sortWithinPartitions("group").select("group", "f").mapInArrow(_link_groups(radius), "a long, b long").distinct()


def _link_groups(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_g, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            g = np.concatenate([rest_g, batch.column(0).to_numpy()])
            f = np.concatenate([rest_f, batch.column(1).to_numpy()])
            cut = np.searchsorted(g, g[-1]) if len(g) else 0  # the last group may go on
            yield from _links(g[:cut], f[:cut], radius)
            rest_g, rest_f = g[cut:], f[cut:]
        yield from _links(rest_g, rest_f, radius)

    return run


def _links(g: np.ndarray, f: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each group's links; groups stand together in g."""
    if not len(g):
        return
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(begin, len(g)))
    near = lambda x, y: np.bitwise_count((x ^ y).view(np.uint64)) <= radius
    twos = begin[size == 2]
    a, b = f[twos], f[twos + 1]
    hit = near(a, b)
    found = [(a[hit], b[hit])]
    for at, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        own = np.unique(f[at : at + n])
        found += [(own[x], own[y]) for x, y in _forest(own, near)]
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _forest(own: np.ndarray, near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first through what is near: each one found is linked to one that it was found from."""
    left = np.arange(len(own))
    while len(left):
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            new = []
            for x in edge.tolist():
                hit = near(own[left], own[x])
                if hit.any():
                    got = left[hit]
                    left = left[~hit]
                    new.append(got)
                    yield np.full(len(got), x), got
            edge = np.concatenate(new) if new else np.empty(0, np.int64)


def near_duplicates(df: DataFrame, key: str = "doc_id", fingerprint: str = "fingerprint", radius: int = 3) -> DataFrame:
    """df with component_id: the smallest key that near fingerprints lead to, itself included.

    Equal fingerprints become one node first, so a large group of exact copies costs one row for each task. Fingerprints of
    zero are linked like any other. Null keys don't count as smallest; a component of null keys only has a null id.
    """
    df = df.drop("component_id")
    own = free_name(df, "_f")
    nodes = df.groupBy(F.col(fingerprint).alias("f")).agg(F.min(key).alias("least"))
    roots = connected_components(link_fingerprints(nodes.select("f"), radius))
    known = nodes.join(roots, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = known.join(least, "root").select(F.col("f").alias(own), "component_id")
    return df.join(ids, F.col(fingerprint) == F.col(own)).drop(own)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    prints = checkpointed(fingerprint_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint"))
    return near_duplicates(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
