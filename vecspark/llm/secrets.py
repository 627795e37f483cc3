"""Secret scans: all rules compiled into one deterministic automaton that reads each byte once.

It tells where matches of which rules end. Only then a rule's own two automata look at the stretch between bytes that none of
its matches reaches across: one reads it backwards and marks where matches start, the other follows the leftmost start to its
longest end, and so on behind that. These are the rule's leftmost matches that don't overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecspark.llm.automata import Scanner, Spans, compile_rules, compile_trees, longest, parse, scan
from vecspark.llm.common import byte_strings, pieces, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: bytes
    #: What stands before the secret itself in a match, which needs so many bytes to count.
    before: bytes = b""
    least: int = 0
    #: Bytes at a match's end that only have to follow it.
    trail: int = 0
    #: A beginning of every match that the automaton of all rules has instead, where the whole would square its states.
    opening: bytes = b""


_NAME = rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
BASE_RULES = (
    Rule("assign", _NAME + rb"[A-Za-z0-9+/_.=-]+", _NAME, 8),
    Rule("access", rb"AKIA[A-Z0-9]+", least=16),
    Rule("hex", rb"[0-9a-f]{32,}"),
)
_BEGIN, _END = rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", rb"-----END [A-Z ]*PRIVATE KEY-----"
#: What parts lines of a key: line ends, real or written, with indents, quotes and the like.
_GAP = rb"(?:\\+[rnt\s]|<br\s*/?>|[\s\"'>|#*+,;])+"
_HEADERS = rb"(?:" + _GAP + rb"[A-Za-z-]+:\x20[^\r\n\\]*)*"
#: Such a stretch with a line end in it.
_BREAK = rb"[\x20\t\"'>|#*+,;]*(?:[\r\n]|\\+[rn]|<br\s*/?>)" + _GAP.removesuffix(b"+") + b"*"
#: A private key up to its END; where END is missing, headers and lines of base64 that something else than a word follows; and BEGIN by itself.
MORE_RULES = (
    Rule("pem", _BEGIN + rb"(?:-?-?-?-?[^-])*" + _END, opening=_BEGIN),
    Rule("pem", _BEGIN + _HEADERS + rb"(?:" + _BREAK + rb"[A-Za-z0-9+/]+=*)+[\r\n\\\"'<]", trail=1, opening=_BEGIN),
    Rule("pem", _BEGIN),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("forge", rb"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", rb"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("payment", rb"[rs]k_live_[A-Za-z0-9]+", least=24),
)
RULES = BASE_RULES + MORE_RULES


class Finder:
    """find(data): all (kind number, start, end) in bytes, each rule's leftmost matches that don't overlap; of rules of one kind
    those that lie in no other."""

    def __init__(self, rules: tuple[Rule, ...], scanner: Scanner, spans: list[Spans]) -> None:
        self.rules, self.scanner, self.spans = rules, scanner, spans
        self.before = [compile_trees([parse(r.before)], anywhere=False) if r.before else None for r in rules]
        alone = [compile_rules([r.pattern]).resets for r in rules]
        self.resets = [re.compile(b"[" + b"".join(b"\\x%02x" % b for b in sorted(x)) + b"]") if x else None for x in alone]
        kinds = list(dict.fromkeys(r.kind for r in rules))
        self.kind = [kinds.index(r.kind) for r in rules]
        self.several = {k for k in self.kind if self.kind.count(k) > 1}

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        closed = data + b"\n"  # the end of a text ends its last line
        ends: dict[int, list[int]] = {}
        for end, bits in scan(closed, self.scanner):
            while bits:
                low = bits & -bits
                ends.setdefault(low.bit_length() - 1, []).append(end)
                bits ^= low
        found = {(self.kind[i], a, b) for i, own in ends.items() for a, b in self._spans(i, closed, own)}
        inside = {x for x in found if x[0] in self.several and any(y != x and y[0] == x[0] and y[1] <= x[1] and x[2] <= y[2] for y in found)}
        return sorted(found - inside, key=lambda x: (x[1], x[0], x[2]))

    def _spans(self, i: int, data: bytes, ends: list[int]) -> Iterator[tuple[int, int]]:
        rule, before, reset = self.rules[i], self.before[i], self.resets[i]
        cuts = [0, *(m.end() for m in reset.finditer(data)), len(data) + 1] if reset else [0, len(data) + 1]
        at, done = 0, -1
        for end in ends:
            while cuts[at + 1] < end:
                at += 1
            if at == done:
                continue
            done = at
            for a, b in self.spans[i].find(data, cuts[at], min(cuts[at + 1], len(data))):
                if b - (longest(before, data, a, b) if before else a) >= rule.least:
                    yield a, b - rule.trail


def _in_characters(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of bytes as spans of code points."""
    places, at, chars = {}, 0, 0
    for p in sorted({p for _, a, b in found for p in (a, b)}):
        chars += len(data[at:p].decode())
        at = p
        places[p] = chars
    return [(i, places[a], places[b]) for i, a, b in found]


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> tuple[Scanner, list[Spans]]:
    return compile_rules([r.opening or r.pattern for r in rules]), [Spans.of(r.pattern) for r in rules]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secrets") -> DataFrame:
    """df with `out`: an array of (kind, start, end) in code points, end exclusive, by start and then as the rules stand.

    A null or empty text has none. Spans of different kinds may overlap. A column of df named as `out` is replaced; all
    others stay as they are. Each text is scanned by itself, so the size of sources or groups of copies doesn't matter.
    """
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(compiled(rules))  # its size depends on the rules alone
    column = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(rules, *shared.value)
        kinds = list(dict.fromkeys(r.kind for r in rules))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in pieces(batches, column):
            spans = [[{"kind": kinds[i], "start": a, "end": b} for i, a, b in _in_characters(x, finder.find(x))] for x in byte_strings(batch.column(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, SPANS)]))


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, changed: str | None = None) -> DataFrame:
    """df with each stretch of text that secrets cover replaced by [REDACTED], in the pass that finds them. changed: a new column
    that tells whether a text was. Nulls and empty texts stay; a column of df with that name is replaced."""
    df = df.drop(changed) if changed else df
    shared = df.sparkSession.sparkContext.broadcast(compiled(rules))  # its size depends on the rules alone
    column = df.columns.index(text)
    fields = [*df.schema.fields, *(T.StructField(c, T.BooleanType()) for c in [changed] if c)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(rules, *shared.value)
        for batch in pieces(batches, column):
            old = batch.column(column)
            spans = [finder.find(x) for x in byte_strings(old)]
            new = [_cut(x.as_py(), own) for x, own in zip(old, spans, strict=True) if own]
            hit = pa.array([bool(own) for own in spans])
            texts = pc.replace_with_mask(old, hit, pa.array(new, old.type)) if new else old
            yield pa.RecordBatch.from_arrays([texts if i == column else c for i, c in enumerate(batch.columns)] + [hit] * bool(changed), [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))


def _cut(text: str, spans: list[tuple[int, int, int]]) -> str:
    """spans: (kind, start, end) in bytes."""
    data, out, at = text.encode(), [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if a >= at:
            out += [data[at:a], b"[REDACTED]"]
        at = max(at, b)
    return b"".join([*out, data[at:]]).decode()


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Spans of the base rules and of all rules in each whole document; a null text is empty."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [r.kind for r in BASE_RULES]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(s["kind"], s["start"], s["end"]) for s in x or ()] for x in batch.column(1).to_pylist()]
            base = [[s for s in x if s[0] in names] for x in rows]
            joined = lambda x: ",".join(f"{kind}:{a}:{b}" for kind, a, b in x)
            counts = [pa.array([sum(s[0] == n for s in x) for x in base], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x) for x in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.select("doc_id", "secrets").mapInArrow(digests, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
