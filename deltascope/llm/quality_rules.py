"""Quality rules per document, and verdicts on whole hosts.

A document fails the base when it has under ``MIN_WORDS`` words or when over
``MAX_REPEAT_PCT`` percent of its words stand in repeated 5-word windows.  On
top of that each host (``source``) is judged: the failures of every rule are
summed by host, the rates are shrunk towards an empirical beta prior (fitted by
moments over all hosts), and a host whose shrunk rate of any rule exceeds
``HOST_LIMIT`` is rejected with all its documents.

Cases: a null text has no words and fails; a null source belongs to no host and
is judged by the base alone; repeated rows are rows of their own; an empty table
gives an empty result; further columns are ignored.

Scale: one pass over the texts, then sums by host with map-side combine, so that
a host with a third of all rows is a few partial sums.  The verdicts are joined
on (host, salt), by broadcast only where Spark's size check allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltascope.llm import _common as c

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5
#: Shrunk rate of failures beyond which a host goes.
HOST_LIMIT = 0.6
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)
SALTS = 16
#: Bytes of text measured at a time.
SLICE_BYTES = 1 << 20

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
STATS_SCHEMA = ", ".join(f"{x} long" for x in STATS)


def _per_row(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _row_keys(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return c.mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The STATS of each row of a slice."""
    n = len(offsets) - 1
    inside = c.blank_words()
    starts, ends, first = c.words(data, offsets, inside)
    in_word = inside[data]
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    values = c.byte_values()[data]
    word = c.span_hashes(values, starts, ends)

    # lines: the text of each row, split at \n
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.r_[offsets[:-1], breaks + 1])
    row = np.searchsorted(offsets, breaks, side="right") - 1
    line_row = np.sort(np.r_[np.arange(n), row])
    line_end = np.sort(np.r_[offsets[1:], breaks])
    words_before = np.searchsorted(starts, np.r_[line_start, line_end]).reshape(2, -1)
    full = words_before[1] > words_before[0]
    line_hash = c.span_hashes(values, line_start[full], line_end[full])
    _, one = np.unique(_row_keys(line_hash, line_row[full]), return_index=True)
    with_word = np.bincount(line_row[full], minlength=n)
    distinct = np.bincount(line_row[full][one], minlength=n)

    # words inside 5-word windows that occur twice or more in the row
    gram, at = c.gram_hashes(word, first, WINDOW)
    owner = c.owners(first)
    cover = np.zeros(len(word) + 1, np.int64)
    if len(gram):
        _, back, count = np.unique(_row_keys(gram, owner[at]), return_inverse=True, return_counts=True)
        again = at[count[back] > 1]
        np.add.at(cover, again, 1)
        np.add.at(cover, again + WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": np.diff(first),
        "word_chars": _per_row(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(symbol[data], offsets),
        "n_lines": with_word,
        "n_dup_lines": with_word - distinct,
        "n_repeat_words": np.bincount(owner[repeated], minlength=n),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in c.text_slices(batches, limit=SLICE_BYTES):
        stats = measure(data, offsets)
        kept = [x for x in rows.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in kept), *(pa.array(stats[k].astype(np.int64)) for k in STATS)], names=[*kept, *STATS])


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, source and STATS of each document."""
    return c.map_arrow(docs.select("doc_id", "source", "text"), _measured, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, {STATS_SCHEMA}")


def rules() -> dict[str, Column]:
    """The rules whose failures are counted by host; integers only."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * n,
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    }


def base_failed() -> Column:
    return rules()["short"] | rules()["repetitive"]


def host_verdicts(stats: DataFrame) -> DataFrame:
    """source, n_docs, shrunk rate of each rule, host_rejected."""
    names = list(rules())
    hosts = stats.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(cond.cast("long")).alias(f"k_{x}") for x, cond in rules().items()))
    hosts = hosts.select("source", "n_docs", *(f"k_{x}" for x in names))
    prior = hosts.agg(*(f(F.col(f"k_{x}") / F.col("n_docs")).alias(f"{p}_{x}") for x in names for p, f in (("m", F.avg), ("v", F.var_pop)))).first()
    for x in names:
        mean, var = prior[f"m_{x}"] or 0.0, prior[f"v_{x}"] or 0.0
        weight = min(max(mean * (1 - mean) / var - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]) if var > 0 else PRIOR_WEIGHT[1]
        hosts = hosts.withColumn(f"rate_{x}", (F.col(f"k_{x}") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight)))
    rejected = F.greatest(*(F.col(f"rate_{x}") for x in names)) > HOST_LIMIT
    return hosts.select("source", "n_docs", *(f"rate_{x}" for x in names), rejected.alias("host_rejected"))


def judge(docs: DataFrame) -> DataFrame:
    """Each document's STATS, base_failed, its host's verdict, and kept."""
    scratch = c.Scratch(docs.sparkSession, "quality")
    stats = scratch.save(document_stats(docs), "stats")
    hosts = host_verdicts(stats).select("source", "host_rejected").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = stats.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(hosts, ["source", "salt"], "left").drop("salt")
    failed = base_failed()
    return joined.select("doc_id", "source", *STATS, failed.alias("base_failed"), F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"), (~failed & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns; texts aren't shuffled."""
    scratch = c.Scratch(docs.sparkSession, "quality")
    stats = scratch.save(document_stats(docs).drop("doc_id"), "stats")
    bad = scratch.save(host_verdicts(stats).where("host_rejected").select("source"), "bad")
    scratch.drop("stats")

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in c.text_slices(batches, limit=SLICE_BYTES):
            got = measure(data, offsets)
            fails = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PCT * got["n_words"])
            yield rows.filter(pa.array(~fails))

    passed = docs.mapInArrow(flagged, T.StructType(docs.schema.fields))
    parts = bad.select(F.col("source").alias("host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    # columns by their table, since documents may have any others
    here = (passed["source"] == parts["host"]) & (F.pmod(F.xxhash64(passed["doc_id"]), F.lit(SALTS)).cast("int") == parts["part"])
    return passed.join(parts, here, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(c.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORD = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH doc AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT doc_id, source, text, regexp_extract_all(text, '{_WORD}') AS w FROM doc),
win AS (SELECT doc_id, i, w[i:i + {WINDOW - 1}] AS g FROM tok, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i) s),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN twice USING (doc_id, g)) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM doc),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
stat AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n_lines, 0) AS n_lines, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM tok LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
flag AS (SELECT *, n_words < {MIN_WORDS} AS f1, 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS f2, 10 * n_symbols > 3 * n_words AS f3,
    10 * n_dup_lines > 3 * n_lines AS f4, word_chars < 2 * n_words OR word_chars > 20 * n_words AS f5 FROM stat),
host AS (SELECT source, rule, count(*) AS n, sum(fail::INT) AS k FROM (SELECT source, unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5]) AS fail FROM flag WHERE source IS NOT NULL) GROUP BY source, rule),
prior AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM host GROUP BY rule),
weight AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, {PRIOR_WEIGHT[0]}), {PRIOR_WEIGHT[1]}) ELSE {PRIOR_WEIGHT[1]} END AS s FROM prior),
bad AS (SELECT DISTINCT source FROM host JOIN weight USING (rule) WHERE (k + m * s) / (n + s) > {HOST_LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
  NOT (f1 OR f2) AND NOT coalesce(source IN (SELECT source FROM bad), false) AS kept
FROM flag
"""
