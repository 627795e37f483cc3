"""Exact removal of repeated strings of a fixed length, by suffix sorting one bucket at a time.

Every string of WINDOW bytes holds an anchor: of its substrings of GRAM bytes the one of least hash, the leftmost of equals.
Equal strings have equal anchors at the same place, so the suffixes to be sorted fall into buckets by anchor, and only
buckets of an anchor that comes twice matter.

1. Anchors are counted. Of equal ones in one task a single row is sent, so a passage that all documents share costs a row
   for each task.
2. For each repeated anchor its surroundings are sent to its bucket, equal ones of a task once. The buckets of the most
   frequent anchors are split by more of what stands around them.
3. A bucket's suffixes are sorted by blocks: ranks of the suffixes at a difference cover's places are computed once, from
   right to left; any other suffix is sorted by its few bytes up to the next such place and the rank found there. Neighbours
   in this order that agree in WINDOW bytes are equal strings. Memory is bounded by the rows of a block of buckets.
4. Each string's first place goes back to its document; all other places in repeated buckets are removed.

Texts are shuffled once, by document. Equal whole texts are told apart first by their digest: a later copy of WINDOW bytes
or more goes as a whole, and the earliest one stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import checkpointed, flat, pieces, table

WINDOW, GRAM = 100, 32
#: Substrings in a window, and the widest surroundings of an anchor.
GRAMS = WINDOW - GRAM + 1
WIDE = GRAMS - 1 + WINDOW
#: A difference cover. Any two residues are brought into it by one shift.
COVER, MODULUS = (0, 1, 3), 7
#: Low bits of a sliding key that hold the place in a stretch, so the leftmost of equal hashes is least; a longer text's anchors
#: are found in stretches of that many bytes.
PLACE_BITS = 22
#: Anchors that a task gathers before it sends them, and rows that are sorted together.
GATHERED, SORTED = 1_000_000, 50_000
#: Anchors are counted by their hash in so many counters; one is hot if its counter has come so far.
COUNTERS, HOT = 1 << 21, 256
#: Runs of columns that a hot anchor's windows are sent in.
PARTS = 4
#: Keys of copies that are broadcast at most, 8 bytes each.
MOST_BROADCAST = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = _powers[base] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16) - 1, base, np.uint64))])
    return known[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_LETTER = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _sums(raw: np.ndarray) -> np.ndarray:
    """Of each beginning of raw, the sum by which any stretch is hashed."""
    return np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[raw] * _power(_BASE, len(raw)), dtype=np.uint64)])


def stretch_hashes(sums: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A hash of each raw[start:start + size], the same wherever it stands."""
    with np.errstate(over="ignore"):
        return _mixed((sums[start + size] - sums[start]) * _power(_INVERSE, len(sums))[start])


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of raw[i:i + GRAM] for each i."""
    sums = _sums(raw)
    with np.errstate(over="ignore"):
        return _mixed((sums[GRAM:] - sums[:-GRAM]) * _power(_INVERSE, len(raw) - GRAM + 1))


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """raw: texts one after the other, from at[i] to at[i + 1]. Returns text number, hash and packed place of each anchor.

    packed: its place in the text, then how far before it the first window stands that it is the anchor of, then how many do.
    Texts of over 2^PLACE_BITS bytes stand alone; where two stretches meet, an anchor's windows may be told in two parts.
    """
    most = 1 << PLACE_BITS
    if len(raw) <= most:
        return _anchors(raw, at)
    found = []
    for text, (a, b) in enumerate(pairwise(at.tolist())):
        for base in range(a, max(a + 1, b - WINDOW + 1), most - WINDOW + 1):
            some = raw[base : min(b, base + most)]
            _, h, packed = _anchors(some, np.array([0, len(some)]))
            found.append((np.full(len(h), text), h, packed + ((base - a) << 14)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(raw) < WINDOW:
        none = np.empty(0, np.int64)
        return none, none, none
    hashes = gram_hashes(raw)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(raw)) - at[text]
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (hashes & ~low) | (place[: len(hashes)].astype(np.uint64) & low)
    width = 1
    while 2 * width <= GRAMS:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: len(key) - (GRAMS - width)], key[GRAMS - width :])
    windows = np.flatnonzero(place[: len(key)] + WINDOW <= np.diff(at)[text[: len(key)]])
    own, of = key[windows], text[windows]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])]) if len(own) else np.empty(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(own)))
    anchor = (own[first] & low).astype(np.int64)
    before = anchor - place[windows[first]]
    return of[first], hashes[at[of[first]] + anchor].view(np.int64), anchor << 14 | before << 7 | count


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 14, packed >> 7 & 127, packed & 127


def _sorted_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rid, text) to hash, rid and packed of the anchors, GATHERED at a time or a little more, sorted by hash."""
    gathered: list[tuple[np.ndarray, ...]] = []

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, rid, packed = (np.concatenate(x) for x in zip(*gathered, strict=True))
        gathered.clear()
        order = np.argsort(h, kind="stable")
        return h[order], rid[order], packed[order]

    for batch in pieces(batches):
        text, h, packed = anchors(*flat(batch.column(1)))
        gathered.append((h, batch.column(0).to_numpy()[text], packed))
        if sum(len(x[0]) for x in gathered) >= GATHERED:
            yield flush()
    if gathered:
        yield flush()


def _send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) to (key, rid, packed): packed is doubled, and odd if the anchor came more than once in this task.

    Of equal anchors one row has the hash as its key; the others are known to be repeated and get a key that spreads them.
    """
    for h, rid, packed in _sorted_anchors(batches):
        same = h[1:] == h[:-1]
        again, repeated = np.concatenate([[False], same]), np.concatenate([[False], same]) | np.concatenate([same, [False]])
        with np.errstate(over="ignore"):
            spread = _mixed(rid.view(np.uint64) * np.uint64(_BASE) + packed.view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(again, spread, h)), pa.array(rid), pa.array(packed * 2 + repeated)], ["key", "rid", "packed"])


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) to (key, n) of the anchors that come twice or more in this task."""
    for h, _, _ in _sorted_anchors(batches):
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        n = np.diff(np.append(first, len(h)))
        yield pa.RecordBatch.from_arrays([pa.array(h[first[n > 1]]), pa.array(n[n > 1])], ["key", "n"])


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows, cut where the first column, which is sorted, changes."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= rows:
            whole = pa.Table.from_batches(kept)
            key = whole.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield whole.slice(0, cut)
            kept = whole.slice(cut).combine_chunks().to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def _keep_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_groups(batches, SORTED):
        key, rid, packed = (t.column(i).to_numpy() for i in range(3))
        same = key[1:] == key[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (packed % 2 == 1)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(rid[keep]), pa.array(packed[keep] >> 1)], ["rid", "packed"])


def _send_surroundings(hot: np.ndarray):
    """(rid, text, packed array, copy, ...) to (key, rid, packed, around): the bytes of all windows of each repeated anchor.

    The bucket of a hot anchor is split: its windows go in PARTS runs of columns, each keyed by what all windows of such a
    run have in common, so surroundings that differ there part ways. Equal ones of a task are sent once.
    """
    step = -(-GRAMS // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            batch = batch.filter(pc.and_(batch.column(2).is_valid(), batch.column(3).is_null()))
            if not batch.num_rows:
                continue
            raw, at = flat(batch.column(1))
            lists = batch.column(2)
            number = np.diff(lists.offsets.to_numpy())
            packed = lists.flatten().to_numpy()
            text = np.repeat(np.arange(len(number)), number)
            sums, (place, before, count) = _sums(raw), _unpacked(packed)
            key = stretch_hashes(sums, at[text] + place, GRAM).view(np.int64)
            counter = key % COUNTERS
            found = np.minimum(np.searchsorted(hot, counter), max(0, len(hot) - 1))
            is_hot = hot[found] == counter if len(hot) else np.zeros(len(key), bool)
            cold = np.flatnonzero(~is_hot)
            sent = [(cold, key[cold], before[cold], count[cold])]
            first = GRAMS - 1 - before
            for low in range(0, GRAMS, step) if is_hot.any() else ():
                high = min(low + step, GRAMS)  # columns low to high - 1
                start, end = np.maximum(first, low), np.minimum(first + count, high)
                own = np.flatnonzero(is_hot & (start < end))
                common = stretch_hashes(sums, at[text[own]] + place[own] - (GRAMS - 1) + high - 1, WINDOW - (high - 1 - low))
                sent.append((own, common.view(np.int64), GRAMS - 1 - start[own], (end - start)[own]))
            row, key, before, count = (np.concatenate(x) for x in zip(*sent, strict=True))
            rid, begin = batch.column(0).to_numpy()[text[row]], at[text[row]] + place[row] - before
            whole = raw.tobytes()
            around = [whole[a:b] for a, b in zip(begin.tolist(), (begin + count + WINDOW - 1).tolist(), strict=True)]
            least: dict[tuple, int] = {}
            order = np.lexsort((place[row], rid))
            for i in order[::-1].tolist():
                least[key[i], before[i], around[i]] = i
            some = np.fromiter(least.values(), np.int64, len(least))
            new = place[row] << 14 | before << 7 | count
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(rid[some]), pa.array(new[some]), pa.array([around[i] for i in some.tolist()], pa.binary())], ["key", "rid", "packed", "around"])

    return run


def _aligned(packed: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The surroundings as rows of WIDE bytes with the anchor at column GRAMS - 1; what is missing is 0."""
    _, before, _ = _unpacked(packed)
    size = np.diff(at)
    out = np.zeros((len(packed), WIDE), np.uint8)
    row = np.repeat(np.arange(len(packed)), size)
    out[row, np.arange(len(raw)) - at[row] + (GRAMS - 1 - before)[row]] = raw
    return out


def cover_ranks(rows: np.ndarray) -> dict[int, np.ndarray]:
    """For each column of the cover, the rank of every row's suffix that starts there, in the order of bytes."""
    ranks: dict[int, np.ndarray] = {}
    rank, after = np.zeros(len(rows), np.int64), rows.shape[1]
    for c in range(rows.shape[1] - 1, -1, -1):
        if c % MODULUS in COVER:
            rank = np.unique(_number(rows, c, after) * (len(rows) + 1) + rank, return_inverse=True)[1].astype(np.int64)
            ranks[c], after = rank, c
    return ranks


def _number(rows: np.ndarray, a: int, b: int) -> np.ndarray:
    """The bytes of columns a to b, a handful, as one number."""
    out = np.zeros(len(rows), np.int64)
    for c in range(a, b):
        out = out << 8 | rows[:, c]
    return out


def first_windows(key: np.ndarray, rid: np.ndarray, packed: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row and column, whether the window that starts there is its string's first place. key: the row's bucket."""
    place, before, count = _unpacked(packed)
    first = np.zeros((len(rows), GRAMS), bool)
    bucket = np.unique(key, return_inverse=True)[1].astype(np.int64)
    order_of_places = np.empty(len(rows), np.int64)
    order_of_places[np.lexsort((place, rid))] = np.arange(len(rows))
    ranks = cover_ranks(rows)
    begin = GRAMS - 1 - before
    for p in range(GRAMS):
        own = np.flatnonzero((begin <= p) & (p < begin + count))
        if not len(own):
            continue
        to = next(c for c in range(p, p + MODULUS) if c % MODULUS in COVER)
        tie = _number(rows[own], p, to) * len(rows) + ranks[to][own]  # at most 3 bytes and a rank
        order = np.lexsort((tie, bucket[own]))
        own, tie = own[order], tie[order]
        left, right = own[:-1], own[1:]
        new = bucket[left] != bucket[right]
        unsure = np.flatnonzero(~new & (tie[:-1] != tie[1:]))
        new[unsure] = (rows[left[unsure], p : p + WINDOW] != rows[right[unsure], p : p + WINDOW]).any(axis=1)
        starts = np.flatnonzero(np.concatenate([[True], new]))
        least = np.minimum.reduceat(order_of_places[own], starts)
        first[own, p] = order_of_places[own] == np.repeat(least, np.diff(np.append(starts, len(own))))
    return first


def _find_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rid, packed, around) sorted by key to (rid, start, end): runs of windows that are their string's first place."""
    for t in _whole_groups(batches, SORTED):
        t = t.combine_chunks()
        key, rid, packed = (t.column(i).to_numpy() for i in range(3))
        raw, at = flat(t.column(3).chunk(0))
        same = key[1:] == key[:-1]
        alone = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        place, before, count = _unpacked(packed[alone])
        yield _runs(rid[alone], place - before, place - before + count)
        many = np.flatnonzero(~alone)
        if len(many):
            keep = np.repeat(~alone, np.diff(at))
            ends = np.concatenate([[0], np.cumsum(np.diff(at)[many])])
            rows = _aligned(packed[many], raw[keep], ends)
            edge = np.diff(np.pad(first_windows(key[many], rid[many], packed[many], rows).astype(np.int8), ((0, 0), (1, 1))), axis=1)
            (row, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            base = (packed[many] >> 14)[row] - (GRAMS - 1)
            yield _runs(rid[many][row], base + start, base + end)


def _runs(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Runs of one text that touch or overlap become one."""
    order = np.lexsort((end, start, rid))
    rid, start, end = rid[order], start[order], end[order]
    far = np.maximum.accumulate(end + (np.unique(rid, return_inverse=True)[1].astype(np.int64) << 32)) & 0xFFFFFFFF if len(rid) else end
    new = np.concatenate([[True], (rid[1:] != rid[:-1]) | (start[1:] > far[:-1])])[: len(rid)]
    last = np.concatenate([new[1:], [True]])[: len(rid)]
    rid, start, end = rid[new], start[new], far[last]
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start << 32 | end)], ["rid", "run"])


def _cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the stretches."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def removed_bytes(n: int, packed: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which of a text's n bytes go. packed: its repeated anchors; runs: windows that are first places."""
    place, before, count = _unpacked(packed)
    windows = _cover(n, place - before, place - before + count)
    if len(runs):
        windows &= ~_cover(n, runs >> 32, runs & 0xFFFFFFFF)
    hit = np.flatnonzero(windows)
    return _cover(n, hit, hit + WINDOW)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text, packed array, copy, doc_id, runs array) to the spans that go and the text that stays."""
    for batch in pieces(batches):
        raw, at = flat(batch.column(1))
        copy = batch.column(3).to_pylist()
        out: list[tuple] = []
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            packed, runs = batch.column(2)[i].values, batch.column(5)[i].values
            own = raw[a:b]
            if copy[i] and b - a >= WINDOW:
                out.append((b - a, b"", [{"start": 0, "end": b - a}]))
            elif packed is None or not len(packed):
                out.append((b - a, own.tobytes(), []))
            else:
                gone = removed_bytes(b - a, packed.to_numpy(), runs.to_numpy() if runs is not None else np.empty(0, np.int64))
                edge = np.diff(np.pad(gone.astype(np.int8), 1))
                out.append((b - a, own[~gone].tobytes(), [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]))
        n, kept, spans = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "n_bytes", "kept", "spans"])


def _with_rid(rows: DataFrame) -> DataFrame:
    """rows with rid: the doc_id, or if ids are null or come again, a number in the order of id and digest."""
    ids = rows.select("doc_id")
    if ids.where(F.col("doc_id").isNull()).isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.withColumn("rid", F.col("doc_id").cast("long"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    ranged = rows.select("doc_id", digest.alias("digest")).distinct().repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    numbers = checkpointed(ranged.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.monotonically_increasing_id().alias("rid")))
    return rows.join(numbers, F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_digest"))).select("doc_id", "text", "rid")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns doc_id, n_bytes, kept binary (the bytes that stay) and spans, an array of (start, end) in bytes that go.

    A byte goes if it lies in a string of WINDOW bytes that also starts earlier: in a smaller doc_id, or before in the same
    text. Nulls are empty texts. Rows with the same doc_id stand in the order of their texts' digests; rows that agree in
    both are one text and have the same result. A null doc_id comes before all others. A task holds one text at a time and
    about 100 bytes for each of its bytes; a text may have up to 2^31 bytes.
    """
    rows = _with_rid(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    digests = rows.select("rid", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).distinct()
    least = digests.groupBy("digest").agg(F.min("rid").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = checkpointed(digests.join(least, "digest").where("rid <> first").select("rid", F.lit(True).alias("copy")))
    first_of_all = rows.where(F.octet_length("text") >= WINDOW).select("rid", "text")
    if copies.count() <= MOST_BROADCAST:  # else their anchors count as repeated ones, which costs more but changes nothing
        first_of_all = first_of_all.join(F.broadcast(copies.select("rid")), "rid", "left_anti")
    often = first_of_all.mapInArrow(_count_anchors, "key long, n long").groupBy(F.pmod("key", F.lit(COUNTERS)).alias("counter")).agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    hot = np.sort(often.select("counter").toArrow().column(0).to_numpy())  # COUNTERS at most
    sent = first_of_all.mapInArrow(_send_anchors, "key long, rid long, packed long")
    repeated = sent.repartition("key").sortWithinPartitions("key").mapInArrow(_keep_repeated, "rid long, packed long").groupBy("rid").agg(F.collect_list("packed").alias("packed"))
    # Both uses of `found` take all its columns, so that Spark shuffles the texts once for both.
    found = rows.join(repeated, "rid", "left").join(copies, "rid", "left").select("rid", "text", "packed", "copy", "doc_id")
    around = found.mapInArrow(_send_surroundings(hot), "key long, rid long, packed long, around binary")
    runs = around.repartition("key").sortWithinPartitions("key").mapInArrow(_find_first, "rid long, run long").groupBy("rid").agg(F.collect_list("run").alias("runs"))
    last = found.join(runs, "rid", "left")
    return last.mapInArrow(_finish, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, kept binary, spans array<struct<start: bigint, end: bigint>>")


def op1_suffixes(spark, sf_dir: str) -> DataFrame:
    """What goes of every document, and the digest of what stays."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
