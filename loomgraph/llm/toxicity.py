"""Toxicity as ordered severity grades, by cumulative-link regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight a feature for all grades, one threshold between
neighbouring grades, thresholds in order. Features are a text's words in lower case and the first letters of its longer words
(which catch inflected and compounded forms); a feature's value is log2(1 + occurrences). The expected severity
is the sum of P(grade > k).

The model is fitted on SAMPLE labelled documents at most, those whose seeded hash is least. Counting features is left to
Spark; the driver gets the FEATURES most telling ones and, for the sample, their values.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import least_hashed, stored, tidy

#: The bound of the labelled sample, and of the features that are fitted.
SAMPLE, FEATURES = 8_000, 6_000
PREFIXES = (4, 5, 6)
#: A feature counts as telling from log odds of LEAST_ODDS on, LEAST_Z standard errors of them, in LEAST_DOCS documents at
#: least. Words that only differ in how common they are in one language or the other stay below.
LEAST_ODDS, LEAST_Z, LEAST_DOCS = 1.5, 3.5, 5
#: Documents of this expected severity or more are rejected.
REJECT = 0.25
_WORD = re.compile(r"[^\W\d_]+")
_STEP = 1 << 20


def word_counts(text: str | None) -> Counter:
    """The words of the whole text. Long texts are counted stretch by stretch."""
    text = (text or "").lower()
    if len(text) <= _STEP:
        return Counter(_WORD.findall(text))
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + _STEP
        while end < len(text) and text[end].isalpha():
            end += 1
        found.update(_WORD.findall(text[at:end]))
        at = end
    return found


def features(counts: Counter) -> Counter:
    found: Counter = Counter()
    for word, n in counts.items():
        found[word] += n
        for k in PREFIXES:
            if len(word) > k:
                found[word[:k] + "*"] += n
    return found


@dataclass
class SeverityModel:
    weights: dict[str, float]
    thresholds: list[float]

    def score(self, text: str | None) -> float:
        counts: dict[str, int] = {}
        weights = self.weights
        for word, n in word_counts(text).items():
            if word in weights:
                counts[word] = counts.get(word, 0) + n
            for k in PREFIXES:
                if len(word) > k and (start := word[:k] + "*") in weights:
                    counts[start] = counts.get(start, 0) + n
        return sum(weights[f] * math.log2(1 + n) for f, n in sorted(counts.items()))

    def above(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [1 / (1 + math.exp(min(700.0, max(-700.0, t - score)))) for t in self.thresholds]

    def severity(self, text: str | None) -> float:
        return sum(self.above(self.score(text)))


def fit_cumulative_link(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, penalty: float = 2e-3, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that minimise the mean negative log likelihood plus penalty * |w|^2.

    The features are sparse: value values[i] of feature columns[i] in example rows[i]. Adam over all examples.
    """
    n, top = len(grades), int(grades.max(initial=0))
    share = np.array([(grades <= k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(x), np.zeros_like(x)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-z.clip(-60, 60)))

    for step in range(1, steps + 1):
        w, gaps = x[:n_features], np.exp(x[n_features + 1 :])
        theta = x[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, weights=w[columns] * values, minlength=n)
        upper = np.where(grades < top, sigmoid(theta[np.minimum(grades, top - 1)] - score), 1.0)
        lower = np.where(grades > 0, sigmoid(theta[np.maximum(grades - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        by_score = (1 - upper - lower) / n
        by_theta = np.bincount(np.minimum(grades, top - 1), weights=-upper * (1 - upper) / p / n, minlength=top) + np.bincount(np.maximum(grades - 1, 0), weights=lower * (1 - lower) / p / n, minlength=top)
        by_weight = np.bincount(columns, weights=by_score[rows] * values, minlength=n_features) + 2 * penalty * w / max(1, n_features) ** 0.5
        later = np.cumsum(by_theta[::-1])[::-1]
        gradient = np.concatenate([by_weight, later[:1], later[1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        x -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return x[:n_features], x[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_features + 1 :]))])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str, sample: int, seed: int) -> DataFrame:
    """(id, toxic, text) of at most sample labelled documents. Rows with null ids, labels or texts teach nothing."""
    marks = labels.where(F.col(label_id_col).isNotNull() & F.col(label_col).isNotNull())
    marks = marks.groupBy(F.col(label_id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    chosen = least_hashed(marks, ["id"], sample, seed)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sampled = texts.join(F.broadcast(chosen), "id")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [least_shingle(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([*(batch.column(c) for c in ("id", "toxic", "text")), pa.array(least, pa.int64())], names=["id", "toxic", "text", "sketch"])

    sketched = sampled.select("id", "toxic", "text").mapInArrow(tidy(sketch), f"id {dict(sampled.dtypes)['id']}, toxic int, text string, sketch long")
    # Copies and most near copies of a text are no further evidence: they count once a label.
    first = sketched.groupBy("toxic", "sketch").agg(F.min(F.struct("id", "text")).alias("r"))  # the same on every run
    return stored(first.select("r.id", "toxic", "r.text"), "labelled")


def least_shingle(text: str) -> int:
    """The least hash of text's three-word shingles, which near copies mostly share."""
    words = text.lower().split()
    hashes = (xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2)))
    return min(hashes) - (1 << 63)


def telling_features(sampled: DataFrame, most: int) -> list[tuple[str, float]]:
    """(feature, z): the features whose log odds between toxic and other documents are surest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
                for f in features(word_counts(text.as_py())):
                    seen.setdefault(f, [0, 0])[toxic] += 1
            yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["feature", "clean", "toxic"])

    n = {r.toxic: r.n for r in sampled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return []
    sums = sampled.select("toxic", "text").mapInArrow(tidy(count), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    odds = F.log((F.col("t") + 0.5) / (n1 - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (n0 - F.col("c") + 0.5))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    ranked = sums.where(F.col("c") + F.col("t") >= LEAST_DOCS).select("feature", (odds / spread).alias("z"), odds.alias("odds"), "t", "c")
    ranked = ranked.where((F.abs("odds") >= LEAST_ODDS) & (F.abs("z") >= LEAST_Z))
    return [(r.feature, r.z) for r in ranked.orderBy(F.abs("z").desc(), "feature").limit(most).collect()]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic",
    sample: int = SAMPLE, most_features: int = FEATURES, seed: int = 5,
) -> SeverityModel:
    """Fits the grades 0 (not toxic), 1 and 2 from a 0/1 label.

    The label says only whether a document is toxic. Among toxic ones, those with more telling
    words than their median are grade 2. Without both labels in the sample nothing can be told, and every document's
    severity is 0.
    """
    sampled = labelled_sample(docs, labels, id_col, text_col, label_id_col, label_col, sample, seed)
    chosen = telling_features(sampled, most_features)
    index = {f: i for i, (f, _) in enumerate(chosen)}
    if not index:
        return SeverityModel({}, [700.0])
    positive = {f for f, z in chosen if z > 0}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, toxic, text in zip(batch.column("id"), batch.column("toxic").to_pylist(), batch.column("text")):
                counts = word_counts(text.as_py())
                found = {f: n for f, n in features(counts).items() if f in index}
                mentions = sum(n for f, n in found.items() if f in positive)
                rows.append((i.as_py(), toxic, mentions, [index[f] for f in found], [math.log2(1 + n) for n in found.values()]))
            kinds = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["id", "toxic", "mentions", "at", "value"])

    kind = dict(sampled.dtypes)["id"]
    made = sampled.mapInArrow(tidy(vectors), f"id {kind}, toxic int, mentions long, at array<int>, value array<double>")
    examples = sorted(made.collect(), key=lambda r: (r.id, r.mentions))  # bounded by sample
    toxic = np.array([r.toxic for r in examples])
    mentions = np.array([r.mentions for r in examples])
    grades = np.where(toxic > 0, 1 + (mentions > np.median(mentions[toxic > 0])), 0)
    grades = np.unique(grades, return_inverse=True)[1]
    rows = np.repeat(np.arange(len(examples)), [len(r.at) for r in examples])
    columns = np.array([i for r in examples for i in r.at], dtype=np.int64)
    values = np.array([v for r in examples for v in r.value])
    # Features enter in proportion to how sure they are, so that the penalty weighs on chance ones.
    scale = np.array([(z / LEAST_Z) ** 2 for _, z in chosen])
    weights, thresholds = fit_cumulative_link(rows, columns, values * scale[columns], grades, len(index))
    return SeverityModel({f: float(weights[i] * scale[i]) for f, i in index.items()}, thresholds.tolist())


def severities(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """doc_id, severity, grade (the likeliest by halves), rejected: a row for each row of docs.

    Null and empty texts have no feature and so the model's base severity, which does not reject. Null ids stay
    null. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            above = [model.above(model.score(t.as_py())) for t in batch.column("text")]
            severity = [sum(a) for a in above]
            grade = [sum(p >= 0.5 for p in a) for a in above]
            yield pa.record_batch([batch.column("doc_id"), pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array([s >= reject for s in severity], pa.bool_())], names=["doc_id", "severity", "grade", "rejected"])

    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return held.mapInArrow(tidy(score), f"doc_id {dict(held.dtypes)['doc_id']}, severity double, grade int, rejected boolean")


def accepted(docs: DataFrame, model: SeverityModel, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of docs below the severity that rejects, whole and with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array([model.severity(t.as_py()) < reject for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)
