"""Regular expressions over bytes as minimal deterministic automata in transition arrays.

A small reader makes a tree of each expression; a Thompson construction makes a nondeterministic automaton of one or more
trees; subset construction over classes of bytes and Moore's minimisation make the arrays. The same trees give three kinds of
automata: one of all rules for where matches end, and for each rule one that reads backwards for where matches start, and
one that follows a match from its start to its longest end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: States beyond which a rule set is refused: it would no longer fit a processor's cache.
MOST_STATES = 60_000
ALL = frozenset(range(256))
ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("f"): 12, ord("v"): 11}
SPACE = frozenset(b" \t\n\r\f\v")


@dataclass(frozen=True)
class Node:
    """kind: bytes (one of values), all (parts in a row), any (one of parts), or repeat (the one part, least to most times)."""

    kind: str
    values: frozenset[int] = frozenset()
    parts: tuple[Node, ...] = ()
    least: int = 0
    most: int | None = None

    def reverse(self) -> Node:
        parts = tuple(p.reverse() for p in self.parts)
        return Node(self.kind, self.values, parts[::-1] if self.kind == "all" else parts, self.least, self.most)


class _Reader:
    """Literals, escapes, sets, ., groups, (?i:...), alternatives, and the repeats ? * + {n} {n,} {n,m}; (?i) in front."""

    def __init__(self, text: bytes) -> None:
        self.fold = text.startswith(b"(?i)")
        self.text, self.at = text[4:] if self.fold else text, 0

    def read(self) -> Node:
        node = self.either()
        if self.at < len(self.text):
            raise ValueError(f"{self.text[self.at :]!r} can't be read")
        return node

    def next(self, *starts: bytes) -> bytes:
        for s in starts:
            if self.text.startswith(s, self.at):
                self.at += len(s)
                return s
        return b""

    def either(self) -> Node:
        parts = [self.sequence()]
        while self.next(b"|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Node("any", parts=tuple(parts))

    def sequence(self) -> Node:
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in b"|)":
            parts.append(self.repeated(self.one()))
        return Node("all", parts=tuple(parts))

    def repeated(self, node: Node) -> Node:
        sign = self.next(b"?", b"*", b"+", b"{")
        if not sign:
            return node
        if sign == b"{":
            end = self.text.index(b"}", self.at)
            low, comma, high = self.text[self.at : end].partition(b",")
            self.at = end + 1
            return Node("repeat", parts=(node,), least=int(low), most=int(high) if high else None if comma else int(low))
        return Node("repeat", parts=(node,), least=int(sign == b"+"), most=1 if sign == b"?" else None)

    def one(self) -> Node:
        if group := self.next(b"(?i:", b"(?:", b"("):
            fold, self.fold = self.fold, self.fold or group == b"(?i:"
            node = self.either()
            self.fold = fold
            if not self.next(b")"):
                raise ValueError("a group isn't closed")
            return node
        if self.next(b"["):
            return self.set()
        if self.next(b"."):
            return Node("bytes", ALL - {10})
        return self.bytes(self.byte())

    def bytes(self, values: frozenset[int]) -> Node:
        if self.fold:
            values |= {x for b in values if b < 128 for x in (ord(chr(b).lower()), ord(chr(b).upper()))}
        return Node("bytes", values)

    def byte(self) -> frozenset[int]:
        b = self.text[self.at]
        self.at += 1
        if b != ord("\\"):
            return frozenset({b})
        b = self.text[self.at]
        self.at += 1
        if b == ord("x"):
            self.at += 2
            return frozenset({int(self.text[self.at - 2 : self.at], 16)})
        return SPACE if b == ord("s") else frozenset({ESCAPES.get(b, b)})

    def set(self) -> Node:
        negated, found = bool(self.next(b"^")), set()
        while not (found and self.next(b"]")):
            low = self.byte()
            if self.text[self.at] == ord("-") and self.text[self.at + 1] != ord("]"):
                self.at += 1
                low = frozenset(range(min(low), max(self.byte()) + 1))
            found |= low
        values = self.bytes(frozenset(found)).values
        return Node("bytes", ALL - values if negated else values)


def parse(rule: bytes) -> Node:
    return _Reader(rule).read()


@dataclass(frozen=True)
class Scanner:
    """step[state + class]: the next state, both multiplied by the number of classes. States from `accepting` on end a match of the rules whose bits are in accepts[state]."""

    classes: bytes
    step: list[int]
    width: int
    start: int
    accepting: int
    accepts: dict[int, int]
    #: The state that nothing leads out of, or -1.
    dead: int
    #: Bytes after which every state is the start: no match reaches across them.
    resets: frozenset[int]


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def after(self, at: int) -> int:
        to = self.state()
        self.empty[at].append(to)
        return to

    def add(self, node: Node, at: int) -> int:
        """Adds node behind state `at`; returns the state that it ends in."""
        if node.kind == "bytes":
            to = self.state()
            self.moves[at].append((node.values, to))
            return to
        if node.kind == "all":
            for part in node.parts:
                at = self.add(part, at)
            return at
        if node.kind == "any":
            to = self.state()
            for part in node.parts:
                self.empty[self.add(part, self.after(at))].append(to)
            return to
        (inner,) = node.parts
        for _ in range(node.least):
            at = self.add(inner, at)
        if node.most is None:
            loop = self.after(at)
            self.empty[self.add(inner, loop)].append(loop)
            return self.after(loop)
        ends = [at]
        for _ in range(node.most - node.least):
            at = self.add(inner, self.after(at))
            ends.append(at)
        to = self.state()
        for x in ends:
            self.empty[x].append(to)
        return to

    def closures(self) -> list[frozenset[int]]:
        """For each state, those reached without a byte that have moves of their own or end a rule."""
        out = []
        for i in range(len(self.empty)):
            seen, todo = {i}, [i]
            while todo:
                for x in self.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            out.append(frozenset(x for x in seen if self.moves[x] or not self.empty[x]))
        return out

    def byte_classes(self) -> tuple[list[int], bytes]:
        """A byte for each class of bytes that no rule tells apart, and each byte's class."""
        sets = list({seen for moves in self.moves for seen, _ in moves})
        of: dict[tuple, int] = {}
        classes = bytes(of.setdefault(tuple(b in s for s in sets), len(of)) for b in range(256))
        return [classes.index(i) for i in range(len(of))], classes


def compile_trees(trees: list[Node], anywhere: bool) -> Scanner:
    """anywhere: a match may start at any byte; else only at the first."""
    nfa = _Nfa()
    root, ends = nfa.state(), {}
    for i, tree in enumerate(trees):
        ends[nfa.add(tree, nfa.after(root))] = 1 << i
    closed = nfa.closures()
    kinds, classes = nfa.byte_classes()
    again = closed[root] if anywhere else frozenset()
    number, todo, rows = {closed[root]: 0}, [closed[root]], []
    while todo:
        row = []
        moves = [m for x in todo.pop(0) for m in nfa.moves[x]]
        for kind in kinds:
            to = again.union(*(closed[t] for seen, t in moves if kind in seen))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
                if len(number) > MOST_STATES:
                    raise ValueError("these rules need too many states")
            row.append(number[to])
        rows.append(row)
    accepted = [sum({ends[x] for x in states if x in ends}) for states in number]
    return _packed(*_minimal(np.array(rows), np.array(accepted)), classes, len(kinds))


def _minimal(rows: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore: states are split by what they accept, then by the blocks they lead to, until nothing changes."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    first = np.unique(block, return_index=True)[1]
    order = np.argsort(accepts[first] > 0, kind="stable")  # accepting states last
    place = np.argsort(order)
    small = place[block[rows[first]]][order]
    return np.column_stack([small, np.full(len(small), place[block[0]])]), accepts[first][order]


def _packed(rows: np.ndarray, accepts: np.ndarray, classes: bytes, width: int) -> Scanner:
    start, step = int(rows[0, -1]), rows[:, :-1]
    back = {c for c in range(width) if (step[:, c] == start).all()}
    dead = np.flatnonzero((step == np.arange(len(step))[:, None]).all(1) & (accepts == 0))
    return Scanner(classes, (step * width).ravel().tolist(), width, start * width, int((accepts == 0).sum()) * width, {i * width: int(a) for i, a in enumerate(accepts) if a}, int(dead[0]) * width if len(dead) else -1, frozenset(b for b in range(256) if classes[b] in back))


def compile_rules(rules: list[bytes]) -> Scanner:
    """One automaton of all rules, whose matches may start anywhere."""
    return compile_trees([parse(r) for r in rules], anywhere=True)


def scan(data: bytes, scanner: Scanner) -> list[tuple[int, int]]:
    """Each (end, bits of rules): a match of those rules ends there, exclusive. One pass over the bytes for all rules."""
    step, state, accepting, accepts = scanner.step, scanner.start, scanner.accepting, scanner.accepts
    found = []
    for i, c in enumerate(data.translate(scanner.classes), 1):
        state = step[state + c]
        if state >= accepting:
            found.append((i, accepts[state]))
    return found


@dataclass(frozen=True)
class Spans:
    """One rule's automata: backwards from anywhere for starts, and onwards from a start for the longest end."""

    backwards: Scanner
    onwards: Scanner

    @classmethod
    def of(cls, rule: bytes) -> Spans:
        tree = parse(rule)
        return cls(compile_trees([tree.reverse()], anywhere=True), compile_trees([tree], anywhere=False))

    def find(self, data: bytes, low: int, high: int) -> list[tuple[int, int]]:
        """The leftmost matches in data[low:high] that don't overlap, each as long as can be."""
        out, at = [], low
        for end, _ in reversed(scan(data[low:high][::-1], self.backwards)):
            start = high - end
            if start >= at:
                at = self.longest(data, start, high)
                out.append((start, at))
        return out

    def longest(self, data: bytes, start: int, high: int) -> int:
        """The end of the longest match from start."""
        return longest(self.onwards, data, start, high)


def longest(scanner: Scanner, data: bytes, start: int, high: int) -> int:
    """The end of the longest match that starts there; -1 if none does."""
    step, state, found = scanner.step, scanner.start, start if scanner.start >= scanner.accepting else -1
    classes, accepting, dead = scanner.classes, scanner.accepting, scanner.dead
    for i in range(start, high):
        state = step[state + classes[data[i]]]
        if state >= accepting:
            found = i + 1
        elif state == dead:
            break
    return found
