"""Toxic passages by maximum-scoring segments.

Words, their beginnings and their endings score the log-odds of toxic against other documents under
a Dirichlet prior, a word the best of its own where that is clear; other words score their own log-odds,
where these are known and below zero, and a little less than zero in any case. A linear scan finds every
maximal scoring segment. Under the other documents' word distribution
the best segments' scores follow an extreme-value law: its lambda solves sum p * exp(lambda * s) = 1,
its K is fitted, and the sum statistics of a document's best segments give a p-value, which a logistic
curve turns into a probability.

Learning takes at most ``TRAIN_ROWS`` labelled documents, the first in md5 order of those allowed:
word scores from about two thirds, the curve from the rest, so that it sees unseen documents.
Scoring covers all documents and whole texts. Null texts are empty and score as texts without words.
Null ids have no label and aren't held out. Repeated rows score alike; of rows that share an id, training
takes the one text that is least by its hash. Segments that tie stand by place. Columns of other names
pass through or are ignored. Without labels of both classes every score is 0. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import hash_order, ids_and_texts, map_arrow, materialise, slices

#: Labelled documents that training reads at most.
TRAIN_ROWS = 20_000
#: Characters of the beginnings and endings of longer words.
AFFIXES = (4, 5, 6)
#: Pseudo-documents of each class, spread over the features as all documents are.
PRIOR = 50.0
#: A feature's least log-likelihood ratio statistic, log-odds, toxic documents and share of them:
#: what only a few copies of a document have in common is no tendency.
CLEAR, LEAST_ODDS, LEAST_DOCS, LEAST_SHARE = 13.0, 2.5, 3, 0.015
MOST_ODDS = 8.0
#: What a word of no known tendency scores, and the least log-odds that add to it.
REST, LEAST_WORD = -0.05, -1.0
CUTOFF = 0.3
#: Words whose scores a worker remembers; beyond it, it starts anew.
REMEMBERED = 300_000

WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word, and as ^... and ...$ its beginnings and endings."""
    return [word, *("^" + word[:k] for k in AFFIXES if len(word) > k), *(word[-k:] + "$" for k in AFFIXES if len(word) > k)]


class Scores(dict):
    """Score of a word, above 0 only with a clear tendency; remembers what it has looked up."""

    def __init__(self, odds: dict[str, float], words: dict[str, float] | None = None):
        self.odds, self.words = odds, words or {}

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        clear = max(self.odds.get(f, 0.0) for f in features(word))
        score = self[word] = clear or REST + max(LEAST_WORD, self.words.get(word, 0.0))
        return score

    def __reduce__(self):
        return Scores, (self.odds, self.words)


@dataclass(frozen=True)
class Model:
    scores: Scores
    lam: float
    log_k: float
    curve: tuple[float, ...]

    def probability(self, text: str) -> float:
        if not self.curve:
            return 0.0
        found, n = best_sums(text, self.scores)
        return sigmoid(float(np.dot(self.curve, inputs(evidence(found, n, self.lam, self.log_k), n))))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def inputs(evidence: float, n: int) -> tuple[float, float, float]:
    return 1.0, min(evidence, 40.0) / 10, math.log1p(n) / 10


Hit = tuple[int, float, float]  # place and score of a word above zero, and the sum of all scores before it


def segments(hits: list[Hit]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, last word) of a text, in one pass.

    A stack holds candidates with the sums left and right of them; one that improves on an
    earlier candidate absorbs it.
    """
    stack: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    for place, score, before in hits:
        left, right, first = before, before + score, place
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= left:
                k -= 1
            if k < 0 or stack[k][1] >= right:
                break
            left, first = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((left, right, first, place))
    return [(right - left, first, end) for left, right, first, end in stack]


def hits_among(scores: Iterable[float]) -> tuple[list[Hit], float]:
    """The hits of a text's scores, and the sum of all."""
    hits, total = [], 0.0
    for place, score in enumerate(scores):
        if score > 0:
            hits.append((place, score, total))
        total += score
    return hits, total


def passages(text: str, model: Model, level: float = 0.05) -> list[tuple[int, int, float]]:
    """Significant toxic passages as (start, end, score), code points, end exclusive."""
    spans = [m.span() for m in WORD.finditer(text)]
    hits, _ = hits_among(model.scores[text[a:b].lower()] for a, b in spans)
    cost = model.log_k + math.log(max(len(spans), 1))
    return [(spans[a][0], spans[b][1], s) for s, a, b in segments(hits) if -math.expm1(-math.exp(min(50.0, cost - model.lam * s))) <= level]


def hits_of(text: str, scores: Scores) -> tuple[list[Hit], int, float]:
    """A text's hits, its number of words and the sum of their scores."""
    words = WORD.findall(text.lower())
    hits, total = hits_among(map(scores.__getitem__, words))
    return hits, len(words), total


def best_sums(text: str, scores: Scores) -> tuple[list[float], int]:
    """The segments' scores, best first, and the number of words."""
    hits, n, _ = hits_of(text, scores)
    return sorted((s for s, _, _ in segments(hits)), reverse=True), n


def evidence(found: list[float], n: int, lam: float, log_k: float) -> float:
    """Minus the log of the least p-value of the sums of the best 1, 2, ... segments."""
    best, total, log_fact, cost = 0.0, 0.0, 0.0, log_k + math.log(max(n, 1))
    for r, s in enumerate(found, 1):
        total += lam * s - cost
        log_fact += math.log(r)
        if total <= 0:
            break
        # the tail of the r-th sum statistic: exp(-x) x^(r-1) / (r! (r-1)!)
        best = max(best, total - (r - 1) * math.log(total) + log_fact + log_fact - math.log(r))
    return best


def bucket(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0))


def training_rows(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, toxic, part (0 for words, 1 for the curve) of the bounded sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    allowed = known.where(bucket(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = allowed.orderBy(hash_order(F.col("doc_id"))).limit(most)
    sample = sample.withColumn("part", F.when(bucket(F.col("doc_id")) == 3, 1).otherwise(0))
    rows = ids_and_texts(documents).join(F.broadcast(sample), "doc_id")  # at most ``most`` rows of three numbers
    return rows.groupBy("doc_id", "toxic", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def count_features(rows: DataFrame, known: set[str] | None = None) -> DataFrame:
    """feature, docs: in how many texts of ``rows`` each feature occurs, or each of the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            docs: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found = {f for w in set(WORD.findall((text or "").lower())) for f in features(w)}
                docs.update(found if known is None else found & known)
            yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64())], names=["feature", "docs"])

    return map_arrow(rows.select("text"), run, "feature string, docs long").groupBy("feature").agg(F.sum("docs").alias("docs"))


def feature_odds(rows: DataFrame, toxic_docs: int, other_docs: int) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of the features with a clear tendency to toxic documents; and of words that tend away.

    Only features of enough toxic documents are counted in the others: no other can be clear.
    """
    least = max(LEAST_DOCS, LEAST_SHARE * toxic_docs)
    in_toxic = {r["feature"]: r["docs"] for r in count_features(rows.where("toxic = 1")).where(F.col("docs") >= least).collect()}
    in_other = {r["feature"]: r["docs"] for r in count_features(rows.where("toxic = 0"), set(in_toxic)).collect()}
    total, found, words = toxic_docs + other_docs, {}, {}
    for feature, d1 in in_toxic.items():
        d0 = in_other.get(feature, 0)
        alpha = (d0 + d1) / total * PRIOR
        odds = math.log((d1 + alpha) / (toxic_docs + PRIOR - d1 - alpha + 1)) - math.log((d0 + alpha) / (other_docs + PRIOR - d0 - alpha + 1))
        clear = 2 * sum(d * math.log(d * total / ((d0 + d1) * n)) for d, n in ((d1, toxic_docs), (d0, other_docs)) if d)
        if clear >= CLEAR and odds >= LEAST_ODDS:
            found[feature] = min(odds, MOST_ODDS)
        elif odds < 0 and feature[0] != "^" and feature[-1] != "$":
            words[feature] = odds
    return found, words


def solve_lambda(counts: Counter, total: int, rest: float) -> float:
    """The positive root of sum p * exp(lambda * s) = 1; p from counts, other words score ``rest`` on average."""
    scores = sorted(counts.items())
    seen = sum(n for _, n in scores)
    if not seen or total <= seen:
        return 1.0
    mean = (sum(s * n for s, n in scores) + rest * (total - seen)) / total
    if mean >= 0:
        return 0.1
    low, high = 1e-6, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        value = sum(n / total * math.exp(min(700.0, mid * s)) for s, n in scores) + (1 - seen / total) * math.exp(mid * rest)
        low, high = (mid, high) if value < 1 else (low, mid)
    return low


def fit_curve(rows: list[tuple[float, int, int]], ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic weights of ``inputs`` by Newton steps."""
    x = np.array([inputs(e, n) for e, n, _ in rows])
    y = np.array([t for *_, t in rows], float)
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * eye, x.T @ (p - y) / len(y) + ridge * w)
    return tuple(w.tolist())


def train(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    rows = materialise(training_rows(documents, labels, most).select("text", "toxic", "part"))
    sizes = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    if not all(sizes.get((0, t)) for t in (0, 1)):
        return Model(Scores({}), 1.0, 0.0, ())
    scores = Scores(*feature_odds(rows.where("part = 0"), sizes[0, 1], sizes[0, 0]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [hits_of(t or "", scores) for t in batch.column(0).to_pylist()]
            hits = pa.array([[s for _, s, _ in h] for h, _, _ in found], pa.list_(pa.float64()))
            sums = pa.array([sorted((s for s, _, _ in segments(h)), reverse=True) for h, _, _ in found], pa.list_(pa.float64()))
            n, total = (pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), n, sums, hits, total], names=["toxic", "part", "n", "sums", "hits", "total"])

    # of at most ``most`` documents, the few words that score
    measured = sorted(tuple(r) for r in map_arrow(rows, measure, "toxic int, part int, n long, sums array<double>, hits array<double>, total double").collect())
    background = [row[2:] for row in measured if not row[0] and not row[1]]
    words, hit = sum(n for n, *_ in background), [s for _, _, hits, _ in background for s in hits]
    rest = (math.fsum(total for *_, total in background) - math.fsum(hit)) / max(1, words - len(hit))
    lam = solve_lambda(Counter(round(s, 3) for s in hit), words, rest)
    # the mean of a Gumbel variable is its location and Euler's constant
    tops = [lam * sums[0] - math.log(n) for n, sums, *_ in background if sums]
    log_k = max(math.log(1e-3), min(0.0, float(np.mean(tops)) - 0.5772)) if tops else math.log(0.1)
    curve = [row for row in measured if row[1]]
    if len({toxic for toxic, *_ in curve}) < 2:
        curve = measured
    return Model(scores, lam, log_k, fit_curve([(evidence(sums, n, lam, log_k), n, toxic) for toxic, _, n, sums, *_ in curve]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.probability(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = map_arrow(ids_and_texts(documents), run, "doc_id long, score double")
    return scored.select("doc_id", (bucket(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def detect(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, train(documents, labels))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that aren't predicted toxic, all columns."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kept = [model.value.probability(t or "") < CUTOFF for t in part.column(place).to_pylist()]
            yield part.filter(pa.array(kept, pa.bool_()))

    return map_arrow(documents, run, documents.schema)
