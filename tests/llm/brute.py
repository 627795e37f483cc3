"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeats(docs, window=100):
    """docs: (doc_id, text), in order. (n_bytes, n_removed, n_spans, kept digest) of each."""
    seen, out = set(), []
    for _, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            s = data[p : p + window]
            if s in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def fingerprint(text, size=3):
    words = SPACED.findall(lower(text))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    """prints: {doc_id: fingerprint}. {doc_id: smallest doc_id reachable}."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def shingles(text, size=5):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def leaks(docs, items, threshold=0.8):
    out = set()
    for d, text in docs:
        own = shingles(text)
        for i, item in items:
            want = shingles(item)
            if want and len(own & want) >= threshold * len(want) - 1e-9:
                out.add((d, i, len(own & want), len(want)))
    return out


def shard(key, shards, weights=None):
    def cost(j):
        u = (int(hashlib.md5(f"{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return -math.log(u) / (weights[j] if weights else 1.0)

    return min(range(shards), key=cost)


SECRETS = (("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))


def secrets(text):
    found = [(k, m.start(), m.end()) for k, p, group, least in SECRETS for m in re.finditer(p, text or "") if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[1], [k for k, *_ in SECRETS].index(s[0])))


def all_secrets(text, rules):
    """Spans of all rules by their expressions, in code points; of a kind's own rules those that lie in no other."""
    data = (text or "").encode() + b"\n"
    kinds = list(dict.fromkeys(r.kind for r in rules))
    found = set()
    for r in rules:
        for m in re.finditer(r.pattern, data):
            if m.end() - (m.start() + re.match(r.before, m[0]).end()) >= r.least:
                found.add((kinds.index(r.kind), m.start(), m.end() - r.trail))
    several = {k for k in range(len(kinds)) if sum(r.kind == kinds[k] for r in rules) > 1}
    found = {x for x in found if x[0] not in several or not any(y != x and y[0] == x[0] and y[1] <= x[1] and x[2] <= y[2] for y in found)}
    chars = lambda n: len(data[:n].decode())
    return [(kinds[k], chars(a), chars(b)) for k, a, b in sorted(found, key=lambda x: (x[1], x[0], x[2]))]


def template(markup):
    """A template as an expression over words that have a space behind each."""
    out = []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
        out.append({"[[": "(?:", "]]": ")?"}.get(token) or (r"(?:[^ ]+ ){0,%s}" % token[2:-2] if token[0] == "{" else f"(?:{token}) "))
    return re.compile("".join(out))


def licenses(text, templates):
    """(label, start, end) in words: for each template and each end of a match of it, the latest start."""
    words = WORD.findall(lower(text))
    out = set()
    for t, (label, markup) in enumerate(templates):
        whole = template(markup)
        for end in range(1, len(words) + 1):
            for start in range(end - 1, -1, -1):
                if whole.fullmatch(" ".join(words[start:end]) + " "):
                    out.add((t, label, start, end))
                    break
    return sorted((label, start, end) for _, label, start, end in out)


def coverage(words, spans):
    return len({i for _, a, b in spans for i in range(a, b)}) / words if words else 0.0


def maximal_segments(scores):
    """(first, end, score) of the heaviest stretch, then those of what is left of it and right of it, in order."""

    def inside(low, high):
        best = None
        for a in range(low, high):
            total = 0.0
            for b in range(a, high):
                total += scores[b]
                if total > 0 and (best is None or total > best[2] + 1e-9):
                    best = (a, b + 1, total)
        return [*inside(low, best[0]), best, *inside(best[1], high)] if best else []

    return inside(0, len(scores))


class Toxicity:
    """Scores of texts after learning from (text, label) rows, both labels among them: counts of features once a text, log-odds
    with a prior, segments, expected numbers by chance, and a ridged logistic curve."""

    def __init__(self, rows, least=3, prior=10.0, lenient=0.4, other=-0.03):
        self.other = other
        counts, words, texts = ({}, {}), [0, 0], [0, 0]
        for text, label in rows:
            own = set(WORD.findall(lower(text)))
            words[label] += len(own)
            texts[label] += 1
            for f in {f for w in own for f in self.features(w)}:
                counts[label][f] = counts[label].get(f, 0) + 1
        clean, toxic = words
        every = {f: (counts[0].get(f, 0), counts[1].get(f, 0)) for f in counts[0].keys() | counts[1].keys()}
        every = {f: c for f, c in every.items() if sum(c) >= least}
        n = len(every) + sum(x >= least for x in (sum(words), sum(texts)))
        limit = math.sqrt(2 * math.log(max(2, n))) - lenient
        self.odds, self.rank = {}, {}
        for f, (c, t) in every.items():
            weight = prior / (toxic + clean) * (c + t) + 0.01
            odds = math.log((t + weight) / (toxic - t + 1)) - math.log((c + weight) / (clean - c + 1))
            likely = sum(k * math.log(k * (toxic + clean) / ((c + t) * whole)) for k, whole in ((t, toxic), (c, clean)) if k)
            if odds > 0 and math.sqrt(max(0.0, 2 * likely)) >= limit:
                self.odds[f], self.rank[f] = odds, math.sqrt(max(0.0, 2 * likely))
        line = [s for text, label in rows if not label for s in self.line(text)]
        mean = lambda a: sum(math.exp(a * s) for s in line) / max(1, len(line))
        low, high = 0.0, 1.0
        while any(s > 0 for s in line) and mean(1.0) > 1 and high - low > 1e-13:
            low, high = ((low + high) / 2, high) if mean((low + high) / 2) <= 1 else (low, (low + high) / 2)
        self.scale = max(0.2, low) if low else 1.0
        self.weights = [0.0] * 3
        x = [(1.0, *self.evidence(text)) for text, _ in rows]
        for _ in range(60):
            p = [self.curve(v) for v in x]
            gradient = [sum(v[k] * (y - q) for v, q, (_, y) in zip(x, p, rows)) - (1e-6, 1e-2, 1e-2)[k] * self.weights[k] for k in range(3)]
            hessian = [[sum(v[i] * v[j] * q * (1 - q) for v, q in zip(x, p)) + (i == j) * (1e-6, 1e-2, 1e-2)[i] for j in range(3)] for i in range(3)]
            self.weights = [w + d for w, d in zip(self.weights, solve(hessian, gradient))]

    @staticmethod
    def features(word):
        return [word, *(word[:k] + "*" for k in (4, 5, 6, 7) if len(word) >= k)]

    def line(self, text):
        out = []
        for w in WORD.findall(lower(text)):
            known = [f for f in self.features(w) if f in self.odds]
            out.append(self.odds[max(known, key=self.rank.__getitem__)] if known else self.other)
        return out

    def evidence(self, text):
        line = self.line(text)
        found = []
        for *_, s in maximal_segments(line):
            expected = len(line) * math.exp(-self.scale * s)
            found.append(-math.log(-math.expm1(-expected)) if expected > 1e-12 else self.scale * s - math.log(len(line)))
        return math.log1p(max(found, default=0.0)), math.log1p(sum(found))

    def curve(self, v):
        return 1 / (1 + math.exp(-sum(w * z for w, z in zip(self.weights, v))))

    def score(self, text):
        return self.curve((1.0, *self.evidence(text)))


def solve(a, b):
    """x of a x = b, by elimination."""
    rows = [[*r, v] for r, v in zip(a, b)]
    for i in range(len(rows)):
        top = max(range(i, len(rows)), key=lambda k: abs(rows[k][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for k in range(len(rows)):
            if k != i:
                rows[k] = [x - rows[k][i] / rows[i][i] * y for x, y in zip(rows[k], rows[i])]
    return [r[-1] / r[i] for i, r in enumerate(rows)]
