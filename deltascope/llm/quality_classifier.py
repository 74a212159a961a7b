"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on each document.  Expectation
maximisation over the counts of vote patterns (all documents; at most
3 ** voters patterns) estimates how often each voter votes so on good and on bad
documents, and the share of good ones.  The posterior of its pattern is a
document's soft label; a linear scorer over hashed words and word shapes is
trained on them and scores every document.

Cases: null and empty texts have no words, get the votes of their zero counts and
score by the bias and length feature alone; repeated rows count and are scored as
rows of their own; an empty table gives an empty result; further columns are
ignored.

Scale: one pass for votes, whose patterns are summed with map-side combine; the
scorer is fitted on at most ``MAX_TRAIN`` documents (least hash of doc_id); one
pass scores, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm import _common as c
from deltascope.llm.quality_rules import _per_row, measure

#: Most documents that the scorer is fitted on.
MAX_TRAIN = 5000
WORD_BUCKETS = 1 << 14
SHAPES = 8
#: Hashed words; pairs of first and last byte class, for new words and for those that repeat the one before; bands of length.
SHAPE_END = WORD_BUCKETS + 2 * SHAPES * SHAPES
DIMENSION = SHAPE_END + 16
KEEP_FROM = 0.5
ABSTAIN, BAD, GOOD = 0, 1, 2
VOTERS = ("length", "symbols", "repetition", "variety", "lines", "capitals", "word_length", "sentences", "word_ends")

_INSIDE = c.blank_words()
_VALUES = c.byte_values(fold_case=True, seed=81)


def _shape_of_bytes() -> np.ndarray:
    kind = np.full(256, 7, np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 0
    kind[list(b".!?")], kind[list(b",;:'\")(-")], kind[list(b"#*$%&|<>")] = 3, 4, 5
    return kind


_SHAPE = _shape_of_bytes()


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The votes of each voter on each row."""
    s = measure(data, offsets)
    n = s["n_words"]
    upper = _per_row((data >= 65) & (data <= 90), offsets)
    lower = _per_row((data >= 97) & (data <= 122) | (data >= 0xC0), offsets)
    starts, ends, first = c.words(data, offsets, _INSIDE)
    stops = _per_row_words(np.isin(data[ends - 1], list(b".!?")), first)
    plain = _per_row_words(np.isin(_SHAPE[data[ends - 1]], (0, 1, 2)), first)
    owner = c.owners(first)
    key = c.mix(c.span_hashes(_VALUES[data], starts, ends) + owner.astype(np.uint64))
    distinct = np.bincount(owner[np.unique(key, return_index=True)[1]], minlength=len(n))

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    return np.stack(
        [
            vote(n < 10, n >= 30),
            vote(10 * s["n_symbols"] > 2 * n, s["n_symbols"] * 50 <= n),
            vote(100 * s["n_repeat_words"] > 20 * n, 100 * s["n_repeat_words"] <= 5 * n),
            vote((10 * distinct < 3 * n) & (n < 1000), 10 * distinct >= 5 * n),
            vote(10 * s["n_dup_lines"] > 3 * s["n_lines"], (s["n_dup_lines"] == 0) & (s["n_lines"] > 1)),
            vote(10 * upper > 4 * (upper + lower), 10 * upper <= upper + lower),
            vote((s["word_chars"] < 2 * n) | (s["word_chars"] > 15 * n), (s["word_chars"] >= 3 * n) & (s["word_chars"] <= 10 * n)),
            vote((100 * stops < n) & (n >= 30), 100 * stops >= 3 * n),
            vote(10 * plain < 6 * n, 10 * plain >= 8 * n),
        ],
        1,
    )


def _per_row_words(flag: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flag)]
    return sums[first[1:]] - sums[first[:-1]]


def _pattern_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in c.text_slices(batches):
        pattern = votes(data, offsets) @ (3 ** np.arange(len(VOTERS)))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pattern, pa.int64())], names=["doc_id", "pattern"])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM: P(good | pattern), P(vote | class) as [class, voter, vote], and the share of good."""
    vote = patterns[:, None] // 3 ** np.arange(len(VOTERS)) % 3
    good = np.array([0.95, 0.3, 0.05])[np.minimum((vote == BAD).sum(1), 2)]  # the start, by bad votes
    for _ in range(rounds):
        share = float(np.clip((counts * good).sum() / counts.sum(), 0.01, 0.99))
        table = np.zeros((2, len(VOTERS), 3))
        for k, weight in enumerate((counts * (1 - good), counts * good)):
            for v in range(3):
                table[k, :, v] = (weight[:, None] * (vote == v)).sum(0) + 1
            table[k] /= table[k].sum(1, keepdims=True)
        log = np.log(table)
        score = np.log(share / (1 - share)) + (log[1][np.arange(len(VOTERS)), vote] - log[0][np.arange(len(VOTERS)), vote]).sum(1)
        good = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
    return good, table, share


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and shapes of all words, the first word of each row, and each row's band of length."""
    starts, ends, first = c.words(data, offsets, _INSIDE)
    full = c.span_hashes(_VALUES[data], starts, ends)
    word = (full % np.uint64(WORD_BUCKETS)).astype(np.int64)
    again = np.r_[False, full[1:] == full[:-1]] if len(full) else np.zeros(0, bool)
    again[first[first < len(full)]] = False
    shape = WORD_BUCKETS + _SHAPE[data[starts]].astype(np.int64) * SHAPES + _SHAPE[data[ends - 1]] + again * SHAPES * SHAPES
    band = SHAPE_END + np.minimum(np.floor(np.log2(np.diff(first) + 1)), 15).astype(np.int64)
    return word, shape, first, band


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in c.text_slices(batches):
        word, shape, first, band = hashed(data, offsets)
        cols, values = [], []
        for i in range(rows.num_rows):
            a, b = first[i], first[i + 1]
            key, count = np.unique(np.r_[word[a:b], shape[a:b]], return_counts=True)
            cols.append(np.r_[key, band[i]].tolist())
            values.append(np.r_[count / max(1, b - a), 1.0].tolist())
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(cols, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["doc_id", "cols", "vals"])


def fit(cols: list[np.ndarray], vals: list[np.ndarray], target: np.ndarray, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by full-batch Adam."""
    row = np.repeat(np.arange(len(cols)), [len(x) for x in cols])
    col, val = np.concatenate(cols).astype(np.int64), np.concatenate(vals).astype(float)
    theta = np.zeros(DIMENSION + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * theta[col], len(cols)) + theta[-1], -40, 40)))
        err = (target - p) / len(cols)
        grad = np.r_[np.bincount(col, val * err[row], DIMENSION), err.sum()] - 1e-6 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer."""
    spark = docs.sparkSession
    scratch = c.Scratch(spark, "classifier")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    patterns = scratch.save(texts.mapInArrow(_pattern_rows, "doc_id long, pattern long"), "patterns")
    counts = patterns.groupBy("pattern").count().toPandas().sort_values("pattern")
    if counts.empty:
        return np.zeros(DIMENSION), 0.0
    good, _, _ = estimate(counts["pattern"].to_numpy(), counts["count"].to_numpy().astype(float))
    posterior = dict(zip(counts["pattern"].tolist(), good.tolist(), strict=True))
    chosen = patterns.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("pattern").alias("pattern")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    chosen = scratch.save(chosen, "chosen")
    sample = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").mapInArrow(_train_rows, "doc_id long, cols array<int>, vals array<float>")
    rows = sample.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toPandas()
    target = rows["pattern"].map(posterior).to_numpy()
    scratch.drop("patterns", "chosen")
    if rows.empty:
        return np.zeros(DIMENSION), 0.0
    return fit([np.asarray(x) for x in rows["cols"]], [np.asarray(x) for x in rows["vals"]], target)


def score(docs: DataFrame, weight: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score (chance of good quality) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in c.text_slices(batches):
            w = shared.value
            word, shape, first, band = hashed(data, offsets)
            sums = np.r_[0, np.cumsum(w[word] + w[shape])]
            total = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first)) + w[band] + bias
            p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p), pa.array(p >= KEEP_FROM)], names=["doc_id", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return score(docs, *train(docs))
