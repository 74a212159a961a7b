"""Severity of toxic language by cumulative-link ordinal regression.

Features are hashed words and 5-byte word beginnings, as log counts.  From a
bounded sample of labelled documents all features associated with the label
(LEAST_ASSOCIATION standard errors) are taken; toxic documents are graded 1 to 3 by how many occurrences of strongly
associated words they have (the labels only say toxic or not).  One weight vector
is shared by the ordered thresholds: P(grade >= k) = sigmoid(w.x - t_k); the
result is the expected severity, sum of P(grade >= k).

Cases: null and empty texts have no features, and the severity of the thresholds
alone; null labels are left out; without both kinds of label every severity is 0;
repeated rows are rows of their own; further columns are ignored.

Scale: training takes at most ``MAX_LABELLED`` rows (least hash of doc_id), and with
them bounds what comes to the driver; scoring is one pass over
the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm import _common as c

#: Most labelled rows that a model is fitted on.
MAX_LABELLED = 12_000
#: Standard errors from which an association with the label is one.
LEAST_ASSOCIATION = 3.0
MIN_DOCS = 4
BEGINNING = 5
GRADES = 3
#: Occurrences of strong words from which a toxic document has grade 1, 2, 3.
GRADE_FROM = (0, 3, 6)

_INSIDE = c.alnum_words()
_VALUES = c.byte_values(fold_case=True, seed=71)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every feature occurrence."""
    starts, ends, first = c.words(data, offsets, _INSIDE)
    owner = c.owners(first)
    values = _VALUES[data]
    long = ends - starts > BEGINNING
    begun = c.span_hashes(values, starts[long], starts[long] + BEGINNING) ^ np.uint64(0x1234567)
    return np.r_[owner, owner[long]], np.r_[c.span_hashes(values, starts, ends), begun].view(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in c.text_slices(batches):
        row, hashed = features(data, offsets)
        order = np.lexsort((hashed, row))
        row, hashed = row[order], hashed[order]
        edge = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (hashed[1:] != hashed[:-1])]) if len(row) else np.zeros(0, np.int64)
        count = np.diff(np.r_[edge, len(row)])
        ids, toxic = (c.long_values(rows.column(i)) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids[row[edge]]), pa.array(toxic[row[edge]].astype(np.int64)), pa.array(hashed[edge]), pa.array(count)], names=["doc_id", "toxic", "feature", "n"])


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the rising thresholds."""

    feature: np.ndarray
    weight: np.ndarray
    threshold: np.ndarray

    def chances(self, row: np.ndarray, hashed: np.ndarray, rows: int) -> np.ndarray:
        """P(grade >= k) of each row, k = 1 .. GRADES."""
        if not len(self.threshold):
            return np.zeros((rows, GRADES))
        score = np.zeros(rows)
        if len(self.feature) and len(hashed):
            place = np.minimum(np.searchsorted(self.feature, hashed), len(self.feature) - 1)
            hit = self.feature[place] == hashed
            key, count = np.unique(row[hit] * len(self.feature) + place[hit], return_counts=True)
            score = np.bincount(key // len(self.feature), self.weight[key % len(self.feature)] * np.log1p(count), rows)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.threshold[None, :], -40, 40)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, steps: int = 1000, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative-link model by gradient descent (Adam)."""
    n = len(grade)
    above = np.stack([grade >= k for k in range(1, GRADES + 1)], 1).astype(float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    theta = np.r_[np.zeros(n_features), first[0], np.log(np.maximum(np.diff(first), 0.05))]  # gaps stay positive
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        cuts = theta[n_features] + np.r_[0, np.cumsum(gaps)]
        score = np.bincount(row, value * w[col], n)
        # likelihood of the grade: P(>= g) - P(>= g + 1)
        p = np.c_[np.ones(n), 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40))), np.zeros(n)]
        d = p * (1 - p)
        at = np.arange(n)
        lik = np.maximum(p[at, grade] - p[at, grade + 1], 1e-12)
        up, down = d[at, grade] / lik, d[at, grade + 1] / lik
        by_score = (up - down) / n
        by_cut = np.zeros(GRADES + 2)
        np.add.at(by_cut, grade, -up / n)
        np.add.at(by_cut, grade + 1, down / n)
        by_cut = by_cut[1:-1]
        grad = np.r_[np.bincount(col, value * by_score[row], n_features) - ridge * w, by_cut.sum(), [gaps[k] * by_cut[k + 1 :].sum() for k in range(GRADES - 1)]]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(theta[n_features + 1 :])
    return theta[:n_features], theta[n_features] + np.r_[0, np.cumsum(gaps)]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most MAX_LABELLED labelled documents."""
    spark = docs.sparkSession
    scratch = c.Scratch(spark, "toxicity")
    wanted = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text")
    counts = scratch.save(sample.mapInArrow(_counts, "doc_id long, toxic long, feature long, n long"), "counts")
    sizes = counts.groupBy("doc_id").agg(F.max("toxic").alias("t")).agg(F.sum("t"), F.count(F.lit(1))).first()
    bad, total = int(sizes[0] or 0), int(sizes[1])
    none = Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    if not bad or bad == total:
        scratch.drop("counts")
        return none
    # association: log odds of the document frequencies over their standard error
    both = counts.groupBy("feature").agg(F.sum("toxic").alias("x"), F.sum(1 - F.col("toxic")).alias("y")).where(F.col("x") + F.col("y") >= MIN_DOCS)
    odds = F.log((F.col("x") + 0.5) / (bad - F.col("x") + 0.5)) - F.log((F.col("y") + 0.5) / (total - bad - F.col("y") + 0.5))
    error = F.sqrt(1 / (F.col("x") + 0.5) + 1 / (F.col("y") + 0.5))
    best = both.withColumn("z", odds / error).where(F.abs("z") > LEAST_ASSOCIATION)
    table = best.select("feature", "z", odds.alias("odds")).toArrow().sort_by("feature")
    if not table.num_rows:
        scratch.drop("counts")
        return none
    feature, z, odd = (table.column(x).to_numpy() for x in ("feature", "z", "odds"))
    strong = (z > 3) & (odd > 3)
    found = counts.join(best.select("feature"), "feature", "left_semi").select("doc_id", "feature", F.col("n").cast("int").alias("n")).toArrow()
    labelled = counts.select("doc_id", "toxic").distinct().toArrow().sort_by("doc_id")
    ids, toxic = (labelled.column(x).to_numpy() for x in ("doc_id", "toxic"))
    row, col = np.searchsorted(ids, found.column("doc_id").to_numpy()).astype(np.int32), np.searchsorted(feature, found.column("feature").to_numpy()).astype(np.int32)
    n = found.column("n").to_numpy()
    del found, table, labelled
    hits = np.bincount(row, n * strong[col], len(ids))
    grade = np.where(toxic > 0, np.searchsorted(GRADE_FROM, hits, side="right"), 0)
    weight, threshold = fit_ordinal(row, col, np.log1p(n), grade, len(feature))
    scratch.drop("counts")
    return Model(feature, weight, threshold)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade, p_toxic, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in c.text_slices(batches):
            row, hashed = features(data, offsets)
            p = shared.value.chances(row, hashed, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, severity double, grade int, p_toxic double, toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return score(docs, train(docs, c.table(spark, sf_dir, "labels")))
