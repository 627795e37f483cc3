"""Byte-pair encoding by dynamic programming over prefixes.

For each prefix of a piece there is exactly one token that can stand last in the prefix's encoding. An automaton of all
tokens gives those that end at each byte; a token is taken if it makes a compatible pair with the last token of the prefix
before it, that is if the merges would not join or cut the two otherwise. Following the back-pointers from the end gives the
ids. No merge is applied to a text.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecspark.llm.common import flat, pieces, table

#: Fixed value: the pattern by which byte-level vocabularies of this family split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of pieces and their ids that a worker remembers before it starts afresh, and pairs of tokens.
REMEMBERED, PAIRS = 64 << 20, 200_000
#: What a remembered piece costs beside its letters, about, and characters of a piece that isn't remembered.
ENTRY, SHORT = 200, 48
#: Characters of a text that are split at once, about.
PART = 1 << 16


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """A byte-level vocabulary in the tokenizers library's JSON; added tokens' strings in a text become their ids."""

    def __init__(self, definition: str) -> None:
        read = json.loads(definition)
        model = read["model"]
        back = {ord(c): b for b, c in byte_letters().items()}
        of = lambda s: s.translate(back)  # noqa: E731  to one letter below U+0100 for each byte
        ids = {of(s): i for s, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
        strings = {i: s.encode("latin-1") for s, i in ids.items()} | {i: s.encode() for s, i in self.added.items()}
        #: The bytes of each id, and its decimal digits with a comma behind.
        self.size = max(strings) + 1
        self.bytes = pa.array([strings.get(i, b"") for i in range(self.size)], pa.binary())
        self.digits = pa.array([f"{i},".encode() for i in range(self.size)], pa.binary())
        #: The rank of each merge of two ids, as left * size + right, and the merge that makes an id: rank, left, right.
        self.rank: dict[int, int] = {}
        self.made: list[tuple[int, int, int]] = [(-1, -1, -1)] * self.size
        into: dict[int, int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = (of(x) for x in (m.split(" ") if isinstance(m, str) else m))
            left, right = ids[a], ids[b]
            self.rank[left * self.size + right] = i
            into[left * self.size + right] = ids[a + b]
            if self.made[ids[a + b]][0] < 0:
                self.made[ids[a + b]] = (i, left, right)
        #: Tokens that the merges of their own bytes give; others never occur.
        self.own = {s: i for s, i in ids.items() if self._is_own([ids[c] for c in s], i, into)}
        self.ends = ahocorasick.Automaton()
        for s, i in self.own.items():
            self.ends.add_word(s, (len(s), i))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.room = REMEMBERED

    def patterns(self) -> tuple[regex.Pattern, regex.Pattern, regex.Pattern | None]:
        """What splits a text into pieces, a place where a text can be parted, and what cuts added tokens out."""
        added = "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))
        return regex.compile(PATTERN), regex.compile(r"\S(?= )"), regex.compile(f"({added})") if added else None

    def _is_own(self, parts: list[int], number: int, into: dict[int, int]) -> bool:
        """Whether merging parts, least rank first, gives the token; into: what each merge makes of two ids."""
        while len(parts) > 1:
            ranks = [self.rank.get(a * self.size + b, 1 << 60) for a, b in pairwise(parts)]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == 1 << 60:
                return False
            parts[at : at + 2] = [into[parts[at] * self.size + parts[at + 1]]]
        return parts == [number]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of left and right, one after the other, leave just these two.

        The history is walked back: the token that came about last is undone, and the two that meet at the border before
        that must not have a merge that comes earlier. Of equal merges the left one is first.
        """
        limit, rank, made, size = 1 << 60, self.rank, self.made, self.size
        while rank.get(left * size + right, limit) >= limit:
            (i, _, inner), (j, outer, _) = made[left], made[right]
            if i < 0 and j < 0:
                return True
            if i > j:
                limit, left = i, inner
            else:
                limit, right = j + 1, outer
        return False

    def piece(self, text: str) -> bytes:
        """The ids of one piece, whose bytes are letters below U+0100, as 32-bit numbers."""
        if (whole := self.own.get(text)) is not None:
            return array("i", [whole]).tobytes()
        last = [-1] * len(text) if len(text) < PART else array("i", [-1]) * len(text)
        lengths = last[:]
        pairs, size = self.pairs, self.size
        if len(pairs) > PAIRS:
            pairs.clear()
        for end, (n, token) in self.ends.iter(text):
            if last[end] < 0:
                at = end - n
                if at >= 0:
                    left = last[at]
                    if left < 0:
                        continue
                    pair = left * size + token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self.compatible(left, token)
                    if not fits:
                        continue
                last[end] = token
                lengths[end] = n
        ids, at = array("i"), len(text) - 1
        while at >= 0:
            ids.append(last[at])
            at -= lengths[at]
        ids.reverse()
        return ids.tobytes()

    def _pieces(self, parts: list[str]) -> bytes:
        known = self.known
        if self.room < 0:
            known.clear()
            self.room = REMEMBERED
        new = set(parts).difference(known)
        for x in new:
            known[x] = self.piece(x.encode().decode("latin-1"))
        ids = b"".join(map(known.__getitem__, parts))
        for x in new:
            if len(x) > SHORT:
                del known[x]
            else:
                self.room -= ENTRY + 2 * len(x)
        return ids

    def encode(self, text: str, patterns: tuple[regex.Pattern, regex.Pattern, regex.Pattern | None]) -> np.ndarray:
        """The ids of a whole text. It is split in parts that end before a space behind another character, where a piece
        always ends, so a long text's pieces are never in memory together."""
        split, border, cut = patterns
        out: list[bytes] = []
        for i, part in enumerate(cut.split(text) if cut else [text]):
            if i % 2:
                out.append(array("i", [self.added[part]]).tobytes())
                continue
            at = 0
            while at < len(part):
                found = border.search(part, at + PART) if at + PART < len(part) else None
                to = found.end() if found else len(part)
                out.append(self._pieces(split.findall(part if (at, to) == (0, len(part)) else part[at:to])))
                at = to
        return np.frombuffer(b"".join(out), np.int32)


def _joined(strings: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """For each run of ids that ends at one of ends, the strings of its ids in a row."""
    taken = strings.take(pa.array(ids))
    raw, at = flat(taken)
    return [raw[a:b].tobytes() for a, b in pairwise(at[ends].tolist())]


def decode_runs(codec: Codec, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The text of each run of ids in UTF-8; bytes that aren't UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace").encode() for x in _joined(codec.bytes, ids, ends)]


@lru_cache(maxsize=1)
def codec_of(definition: str) -> Codec:
    return Codec(definition)


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode_texts(df: DataFrame, path: str, text: str = "text", out: str | None = "ids", digests: bool = False) -> DataFrame:
    """df with `out`: the ids of each whole text as array<int>; a null or empty text has none. With digests, also n_tokens,
    ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of the text that the ids decode to), in the same pass;
    `out` may be None then.

    path: a vocabulary in the tokenizers library's JSON; its tables, of fixed size, go to the executors. Columns of df named
    as the new ones are replaced; all others stay.
    """
    fields = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in [out] if c] + DIGESTS * digests
    df = df.drop(*(f.name for f in fields))
    column = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(codec_of(_read(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        patterns = codec.patterns()
        for batch in pieces(batches, column):
            each = [codec.encode(x or "", patterns) for x in batch.column(column).to_pylist()]
            ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
            ids = np.concatenate(each)
            new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))] * bool(out)
            if digests:
                new += [pa.array(np.diff(ends).astype(np.int64)), _sha(x[:-1] for x in _joined(codec.digits, ids, ends)), _sha(decode_runs(codec, ids, ends))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def decode_ids(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with `out`: the text of the array of ids, empty for a null; a null id or one beyond the vocabulary fails."""
    df = df.drop(out)
    column = df.columns.index(ids)
    shared = df.sparkSession.sparkContext.broadcast(codec_of(_read(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(column)
            lengths = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = decode_runs(shared.value, runs.flatten().to_numpy(), np.cumsum([0, *lengths]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.decode() for x in texts], pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def _sha(texts: Iterable[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document encoded, and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, default_vocabulary(), out=None, digests=True).drop("text")
