"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value statistics.

1. Of labelled texts, each word and its beginnings are counted by label, once a text. Log-odds with a Dirichlet prior (in
   proportion to the counts of both labels together) are kept where the likelihood ratio says that a feature is toxic.
2. A text's tokens score what their most significant feature has, all others a little below zero. One pass over the tokens
   finds every maximal scoring segment (the algorithm of Ruzzo and Tompa, linear in the number of tokens).
3. A segment of score S among n tokens has an expected number E = n exp(-lambda S) of such segments by chance; lambda is
   where the mean of exp(lambda s) over the tokens of clean texts is 1. -log(1 - exp(-E)) is the segment's evidence.
4. A logistic curve over the logarithms of the best and the summed evidence, fitted on the same labelled texts, gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.common import byte_strings, checkpointed, pieces, table
from vecspark.llm.words import LETTERS

#: Labelled texts that the model is fitted on at most, by hash of their keys; the statistics settle long before.
SAMPLE = 20_000
#: Lengths of beginnings in characters, the prior's weight, and the least count of a feature.
BEGINNINGS, PRIOR, LEAST = (4, 5, 6, 7), 10.0, 3
#: A feature is kept from so many standard deviations below the largest that chance gives among all features counted.
LENIENT = 0.4
#: Score of a token without a feature.
OTHER = -0.03
#: Evidence from which a segment is reported.
REPORTED = 3.0
#: Words and features that a worker keeps in memory before it starts afresh or hands them on.
REMEMBERED = 200_000


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    rank: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    weights: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def token(self, word: str) -> float:
        """The log-odds of the word's most significant feature; 0 if it has none."""
        known = [f for f in features(word) if f in self.odds]
        return self.odds[max(known, key=self.rank.__getitem__)] if known else 0.0

    def probability(self, best: float, total: float) -> float:
        z = self.weights[0] + self.weights[1] * math.log1p(best) + self.weights[2] * math.log1p(total)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.memo = model, {}

    def positives(self, text: bytes) -> tuple[int, list[tuple[int, float]]]:
        """How many tokens text has, and (place, score) of those above zero. Each occurrence scores by itself."""
        words = text.translate(LETTERS).split()
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        for w in set(words).difference(self.memo):
            self.memo[w] = self.model.token(w.decode())
        scores = np.fromiter(map(self.memo.__getitem__, words), float, len(words))
        at = np.flatnonzero(scores > 0)
        return len(words), list(zip(at.tolist(), scores[at].tolist(), strict=True))

    def segments(self, n: int, positives: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
        """(first token, end token exclusive, score) of all maximal scoring segments.

        Each candidate keeps where the next one to its left stands whose sum before it is less, so those between are never
        looked at again.
        """
        stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, end, the candidate to the left
        total, at = 0.0, 0
        for place, score in positives:
            total += OTHER * (place - at)
            before, first, j = total, place, len(stack) - 1
            total, at = total + score, place + 1
            while True:
                while j >= 0 and stack[j][0] >= before:
                    j = stack[j][4]
                if j < 0 or stack[j][1] >= total:
                    break
                before, _, first, _, left = stack[j]
                del stack[j:]
                j = left
            stack.append((before, total, first, at, j))
        return [(a, b, r - s) for s, r, a, b, _ in stack]

    def passages(self, text: bytes) -> list[tuple[int, int, float]]:
        """(first token, end token exclusive, evidence) of all maximal scoring segments."""
        n, positives = self.positives(text)
        return [(a, b, self.evidence(n, s)) for a, b, s in self.segments(n, positives)]

    def evidence(self, n: int, score: float) -> float:
        expected = n * math.exp(-min(700.0, self.model.scale * score))
        return -math.log(-math.expm1(-expected)) if expected > 1e-12 else self.model.scale * score - math.log(max(1, n))


def _sample(labels: DataFrame, key: str, label: str, size: int) -> DataFrame:
    return labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64("_key"), "_key").limit(size)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text", size: int = SAMPLE) -> Model:
    """A model of the labelled texts, `size` of them at most. Without both labels, it scores every text by its prior alone."""
    chosen = F.broadcast(_sample(labels, key, label, size))  # `size` rows at most
    rows = checkpointed(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(chosen, "_key").select("_label", "_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_label: list[Counter] = [Counter(), Counter()]

        def flush() -> pa.RecordBatch:
            names = list(by_label[0] | by_label[1])
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in by_label)], ["feature", "clean", "toxic"])
            for c in by_label:
                c.clear()
            return out

        for batch in pieces(batches):
            for y, x in zip(batch.column(0).to_pylist(), byte_strings(batch.column(1)), strict=True):
                words = {w.decode() for w in set(x.translate(LETTERS).split())}
                own = by_label[y > 0]
                own.update({f for w in words for f in features(w)})
                own[" "] += len(words)  # no word has a space
                own["  "] += 1
            if len(by_label[0]) + len(by_label[1]) > REMEMBERED:
                yield flush()
        yield flush()

    counts = rows.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = checkpointed(counts.where(F.col("clean") + F.col("toxic") >= LEAST))
    totals = {r.feature: (r.clean or 0, r.toxic or 0) for r in counts.where(F.col("feature").isin(" ", "  ")).collect()}
    (clean, toxic), texts = totals.get(" ", (0, 0)), totals.get("  ", (0, 0))
    if not clean or not toxic:
        share = (texts[1] + 0.5) / (sum(texts) + 1) if sum(texts) else 1e-9
        return Model(weights=(math.log(share / (1 - share)), 0.0, 0.0))
    t, c, both = F.col("toxic"), F.col("clean"), F.col("toxic") + F.col("clean")
    prior = F.lit(PRIOR / (toxic + clean)) * both + 0.01
    odds = F.log((t + prior) / (F.lit(toxic) - t + 1)) - F.log((c + prior) / (F.lit(clean) - c + 1))
    share = lambda seen, whole: F.when(seen > 0, seen * F.log(seen * (toxic + clean) / (both * whole))).otherwise(0.0)
    rank = F.sqrt(F.greatest(F.lit(0.0), 2 * (share(t, toxic) + share(c, clean))))
    kept = counts.where(~F.col("feature").isin(" ", "  ")).select("feature", odds.alias("odds"), rank.alias("rank")).where(F.col("odds") > 0)
    significant = math.sqrt(2 * math.log(max(2, counts.count()))) - LENIENT
    best = kept.where(F.col("rank") >= significant).collect()  # what a bounded number of texts can make significant
    model = Model({r.feature: r.odds for r in best}, {r.feature: r.rank for r in best})
    return _calibrated(model, rows)


def _calibrated(model: Model, rows: DataFrame) -> Model:
    """model with the scale and the logistic curve of the sampled rows.

    The driver sees counts by score, of which the model has a bounded number, then two numbers for each of the sampled texts.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, seen = Scorer(shared.value), Counter()
        for batch in pieces(batches):
            for y, x in zip(batch.column(0).to_pylist(), byte_strings(batch.column(1)), strict=True):
                if y <= 0:
                    n, positives = scorer.positives(x)
                    seen.update(s for _, s in positives)
                    seen[OTHER] += n - len(positives)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], ["score", "n"])

    seen = rows.mapInArrow(count, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).orderBy("score").collect()
    model.scale = _scale(np.array([r.score for r in seen]), np.array([float(r.n) for r in seen]))
    scaled = rows.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(scaled.value)
        for batch in pieces(batches):
            each = [scorer.passages(x) for x in byte_strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([best_of(x) for x in each], pa.float64()), pa.array([total_of(x) for x in each], pa.float64())], ["label", "best", "total"])

    told = np.array(sorted(map(tuple, rows.mapInArrow(weigh, "label int, best double, total double").collect())))
    model.weights = _logistic(np.column_stack([np.ones(len(told)), np.log1p(told[:, 1:])]), (told[:, 0] > 0).astype(float))
    return model


def _scale(score: np.ndarray, n: np.ndarray) -> float:
    """lambda: the positive root of mean(exp(lambda s)) = 1 over the tokens of clean texts; 1 if there is none up to 1."""
    mean = lambda a: (np.exp(a * score) * n).sum() / max(1.0, n.sum())
    if not (score > 0).any() or mean(1.0) <= 1:
        return 1.0
    low, high = 1e-3, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) <= 1 else (low, middle)
    return max(low, 0.2)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def best_of(passages: list[tuple[int, int, float]]) -> float:
    return max((e for *_, e in passages), default=0.0)


def total_of(passages: list[tuple[int, int, float]]) -> float:
    return math.fsum(e for *_, e in passages)


PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("evidence", T.DoubleType())]))


def score_texts(df: DataFrame, model: Model, text: str = "text", new: tuple[str, str] = ("toxicity", "toxic_passages")) -> DataFrame:
    """df with `new`: a score (0 to 1), and the toxic passages as an array of (start, end, evidence) in tokens, end exclusive.

    The passages are all segments with an evidence of REPORTED or more. An empty text or a null has none and the score of no
    evidence. Columns of df with these names are replaced.
    """
    df = df.drop(*new)
    column = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)  # what a bounded number of labelled texts gave

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
        for batch in pieces(batches, column):
            scores, passages = [], []
            for x in byte_strings(batch.column(column)):
                each = scorer.passages(x)
                scores.append(shared.value.probability(best_of(each), total_of(each)))
                passages.append([{"start": a, "end": b, "evidence": e} for a, b, e in each if e >= REPORTED])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, kind)], [*batch.schema.names, *new])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], PASSAGES)]))


def held_out(key: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the key as text is divisible by 5. A null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_for(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows of labels that aren't held out."""
    return fit(docs, labels.where(~held_out()))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole document's score; labels are learned from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, fit_for(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
