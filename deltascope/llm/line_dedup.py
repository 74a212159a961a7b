"""Line dedup by suffix ranks over sequences of line ids.

Blank lines aside, a document is a sequence of line ids.  Prefix doubling ranks
all suffixes that begin with a repeated line: level 0 ranks lines, level k + 1
ranks the pairs of level-k ranks 2**k lines apart, each time by a distributed
sort of the distinct pairs.  Two ranks of one level that overlap fix the first L
lines of a suffix, so they name its interval of longest common prefix L or more:
the suffixes that agree on L lines, side by side in the sorted order.  (The order
is kept as ranks, and the interval as that name; no row holds a neighbour.)

A run counts when it has ``MIN_WORDS`` words or more.  For every line the shortest
such run that begins there, and the shortest that ends there, are looked up: the
interval's first member (least doc_id, then position) keeps its lines and all
later members lose theirs.  Any longer repeated run is a union of these, so the
maximal runs are removed whole.  Doubling stops at the longest such run, since
deeper levels cannot change a decision.

Cases: null and empty texts have no lines and stay as they are; blank lines are
no part of a run and go only between two removed lines; a document that loses all
its lines goes (``keep_first``) or has an empty text (``dedupe``).  Rows with one doc_id
and different texts are documents of their own, the one with the lesser hash
first; rows equal in both are one document, and are cut alike.  Rows without a
doc_id come after all others.  Empty tables and further columns are fine.

Scale: each round is three shuffles of short rows, of repeated lines only; hot
lines and runs are counted with map-side combine and met in salted joins.  Texts
are shuffled once, to meet their removed lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltascope.llm import _common as c

MIN_WORDS = 10


def _windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the shortest runs of MIN_WORDS words from and up to each line."""
    sums = np.r_[0, np.cumsum(words)]
    n = len(words)
    ahead = np.searchsorted(sums, sums[:-1] + MIN_WORDS)  # first end with enough words
    start = np.flatnonzero(ahead <= n)
    back = np.searchsorted(sums, sums[1:] - MIN_WORDS, side="right") - 1  # last start with enough words
    end = np.flatnonzero(back >= 0)
    both = np.unique(np.r_[start * (n + 1) + ahead[start], back[end] * (n + 1) + end + 1])
    return both // (n + 1), both % (n + 1) - both // (n + 1)


_LINES = "doc_id long, row long, pos int, h1 long, h2 long, size int"


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that has a word (size 0), and one for each window (size > 0)."""
    inside = c.blank_words()
    one, two = c.byte_values(seed=41), c.byte_values(seed=42)
    for rows, data, offsets in c.text_slices(batches):
        ids, keys = c.long_values(rows.column(0)), c.long_values(rows.column(1))
        starts, ends, first = c.words(data, offsets, inside)
        breaks = np.flatnonzero(data == 10)
        line_start = np.sort(np.r_[offsets[:-1], breaks + 1])
        line_end = np.sort(np.r_[offsets[1:], breaks])
        line_row = np.sort(np.r_[np.arange(len(ids)), np.searchsorted(offsets, breaks, side="right") - 1])
        n_words = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
        full = n_words > 0
        begin, end, row, n_words = line_start[full], line_end[full], line_row[full], n_words[full]
        edge = np.searchsorted(row, np.arange(len(ids) + 1))
        pos = np.arange(len(row)) - edge[row]
        h1, h2 = (c.span_hashes(v[data], begin, end).astype(np.int64) for v in (one, two))
        at, size, of = [], [], []
        for i in range(len(ids)):
            if edge[i + 1] > edge[i]:
                s, n = _windows(n_words[edge[i] : edge[i + 1]])
                at.append(s)
                size.append(n)
                of.append(np.full(len(s), i))
        w = np.concatenate([np.zeros(0, np.int64), *of]).astype(np.int64)
        cols = {
            "doc_id": np.r_[ids[row], ids[w]],
            "row": np.r_[keys[row], keys[w]],
            "pos": np.r_[pos, np.concatenate([np.zeros(0, np.int64), *at])].astype(np.int32),
            "h1": np.r_[h1, np.zeros(len(w), np.int64)],
            "h2": np.r_[h2, np.zeros(len(w), np.int64)],
            "size": np.r_[np.zeros(len(row), np.int64), np.concatenate([np.zeros(0, np.int64), *size])].astype(np.int32),
        }
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})


def _ordered_ids(keys: DataFrame, by: list[str], n: int) -> DataFrame:
    """Adds ``rank``, rising with the distinct keys ``by``: a distributed sort."""
    return keys.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row and pos (among the lines with a word) of each line of a later copy."""
    spark = docs.sparkSession
    scratch = c.Scratch(spark, "lines")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(*c.keyed(), "text")
    rows = scratch.save(source.mapInArrow(_line_rows, _LINES), "rows")
    lines, windows = rows.where("size = 0").drop("size"), rows.where("size > 0").select(*c.ROW, "pos", "size")
    deepest = windows.agg(F.max("size")).first()[0] or 0

    # level 0: ids of repeated lines; any other line ends all common prefixes
    repeated = _ordered_ids(lines.groupBy("h1", "h2").count().where("count > 1").drop("count"), ["h1", "h2"], n)
    level = c.salted_join(lines, scratch.save(repeated, "ids0"), ["h1", "h2"], [*c.ROW, "pos"]).select(*c.ROW, "pos", "rank")
    levels = [scratch.save(level.distinct(), "level0")]  # equal rows are one
    step = 1
    while 2 * step <= deepest:
        here = levels[-1]
        ahead = here.select(*c.ROW, (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = here.withColumnRenamed("rank", "this").join(ahead, [*c.ROW, "pos"])
        ids = _ordered_ids(pairs.groupBy("this", "next").count().where("count > 1").drop("count"), ["this", "next"], n)
        k = len(levels)
        levels.append(scratch.save(c.salted_join(pairs, scratch.save(ids, f"ids{k}"), ["this", "next"], [*c.ROW, "pos"]).select(*c.ROW, "pos", "rank"), f"level{k}"))
        step *= 2

    # the interval of each window: its length and the two ranks that cover it
    later = None
    for k, ranks in enumerate(levels):
        own = windows.where((F.col("size") >= 1 << k) & (F.col("size") < 2 << k))
        own = own.join(ranks.withColumnRenamed("rank", "front"), [*c.ROW, "pos"])
        if k:
            tails = ranks.select(*c.ROW, F.col("pos").alias("tail"), F.col("rank").alias("back"))
            own = own.withColumn("tail", F.col("pos") + F.col("size") - (1 << k)).join(tails, [*c.ROW, "tail"])
        else:
            own = own.withColumn("back", F.col("front"))
        own = scratch.save(own.select(*c.ROW, "pos", "size", "front", "back"), f"windows{k}")
        key = ["size", "front", "back"]
        first = own.groupBy(*key).agg(F.min(F.struct(*c.ROW, "pos")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
        found = c.salted_join(own, first, key, [*c.ROW, "pos"]).where(F.struct(*c.ROW, "pos") != F.col("first")).select(*c.ROW, "pos", "size")
        later = found if later is None else later.unionByName(found)
    marks = scratch.save(later.select(*c.ROW, F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("pos")).distinct(), "marks")
    scratch.drop("rows", *(f"{x}{k}" for k in range(len(levels)) for x in ("ids", "level", "windows")))
    return marks


def _cut(drop_empty: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = c.blank_words()
        for batch in batches:
            at, gone = batch.schema.get_field_index("text"), batch.column(batch.num_columns - 1).to_pylist()
            texts, keep, counts = [], [], []
            for text, dead in zip(batch.column(at).to_pylist(), gone, strict=True):
                n = 0
                if dead:
                    text, n, left = _without(text, set(dead), inside)
                    keep.append(bool(left) or not drop_empty)
                else:
                    keep.append(True)
                texts.append(text)
                counts.append(n)
            cols = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            if not drop_empty:
                cols, names = [*cols, pa.array(counts, pa.int64())], [*names, "n_removed_lines"]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return run


def _without(text: str, dead: set[int], inside: np.ndarray) -> tuple[str, int, int]:
    """The text without its dead lines, how many went, and how many with a word are left."""
    out, held, pos, gone, left, after_dead = [], [], 0, 0, 0, False
    for line in text.split("\n"):
        if not line.strip(" \t\n\v\f\r"):
            held.append(line)
            continue
        if pos in dead:
            gone += 1
            if not after_dead:
                out += held
            after_dead = True
        else:
            out += [*held, line]
            left += 1
            after_dead = False
        held = []
        pos += 1
    return "\n".join([*out, *held]), gone, left


def _cut_documents(docs: DataFrame, drop_empty: bool) -> DataFrame:
    marks = removed_lines(docs).groupBy(*(F.col(x).alias(f"__{x}") for x in c.ROW)).agg(F.collect_list("pos").alias("__gone"))
    keyed = docs.select("*", *(x.alias(f"__{name}") for x, name in zip(c.keyed(), c.ROW, strict=True)))
    joined = keyed.join(marks, [f"__{x}" for x in c.ROW], "left").select(*docs.columns, "__gone")
    fields = list(docs.schema.fields)
    if not drop_empty:
        fields.append(T.StructField("n_removed_lines", T.LongType()))
    return joined.mapInArrow(_cut(drop_empty), T.StructType(fields))


def dedupe(docs: DataFrame) -> DataFrame:
    """All documents, their texts without later copies of runs, and n_removed_lines."""
    return _cut_documents(docs, drop_empty=False)


def keep_first(docs: DataFrame) -> DataFrame:
    """Documents without later copies of runs; one that loses every line goes."""
    return _cut_documents(docs, drop_empty=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(c.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_removed_lines", F.sha2("text", 256).alias("text_sha256"))


_WORD = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, sum(k) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS k FROM l) WHERE k > 0),
pairs AS (SELECT a.doc_id, a.pos AS a, b.pos AS b FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + {MIN_WORDS} WHERE b.upto - a.upto + a.k >= {MIN_WORDS}),
win AS (SELECT doc_id, a, min(b) AS b FROM pairs GROUP BY doc_id, a UNION SELECT doc_id, max(a) AS a, b FROM pairs GROUP BY doc_id, b),
run AS (SELECT win.doc_id, a, b, string_agg(line, chr(10) ORDER BY pos) AS lines FROM win JOIN w ON w.doc_id = win.doc_id AND pos BETWEEN a AND b GROUP BY win.doc_id, a, b),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lines ORDER BY doc_id, a) AS nth FROM run) WHERE nth > 1),
dead AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM later),
flag AS (SELECT w.doc_id, w.i, dead.pos IS NOT NULL AS gone FROM w LEFT JOIN dead USING (doc_id, pos)),
around AS (SELECT l.doc_id, l.i, line, gone, last_value(gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.i) AS before, first_value(gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM l LEFT JOIN flag ON flag.doc_id = l.doc_id AND flag.i = l.i),
rest AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(gone, before AND after, false)), '') AS text FROM around GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_removed_lines, CASE WHEN d.text IS NOT NULL THEN sha256(rest.text) END AS text_sha256 FROM documents d LEFT JOIN rest USING (doc_id)
"""
