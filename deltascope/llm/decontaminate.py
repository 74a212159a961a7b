"""Benchmark decontamination by winnowing.

Words are hashed, 5-word grams are combined from them, and of every 6
neighbouring grams (10 words) the smallest is selected as a fingerprint (the last
one of equals); equal 10-word spans select equal fingerprints, so no shared span
is missed.  Fingerprints of texts and of test items are joined, each extended to
the whole window by 128 bits over its words, and hit windows are merged to
spans.  An item of under 10 words is one window of its own length, with the gram
length that its size allows.

Cases: a null text or an item without words has no windows; an item without an
id hits words but adds no item; repeated items count once, repeated documents
are rows of their own; empty tables and further columns are fine.

Scale: texts are read once, and only windows whose fingerprint may occur in an
item leave their task, one row for each distinct window of a text.  "May occur" is
a bit table of a fixed size over the items' fingerprints: it is all that is
broadcast, and a fuller one only lets more rows through to the join.  Windows
that many texts share are met in a salted join.  ``drop_contaminated`` shuffles the
texts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm import _common as c

WINDOW = 10
GRAM = 5
#: Bits of the table of fingerprints (a power of two), and of one piece of it.
TABLE_BITS, PIECE_BITS = 26, 16

_INSIDE = c.alnum_words()
_ONE, _TWO = c.byte_values(fold_case=True, seed=31), c.byte_values(fold_case=True, seed=32)
_KEY = ["size", "print", "w1", "w2"]


def picks(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the ``size``-word windows, where each window's fingerprint is, and the grams there."""
    k = min(GRAM, size)
    gram, at = c.gram_hashes(word, first, k)
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = np.full(len(word), np.iinfo(np.uint64).max, np.uint64)
    full[at] = gram
    low, place = full[:n].copy(), np.arange(n)
    for j in range(1, size - k + 1):
        ahead = full[j : j + n]
        better = ahead <= low
        low[better] = ahead[better]
        place[better] = np.flatnonzero(better) + j
    owner = c.owners(first)
    start = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return start, place[start], full


def _spelt(word: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash over the words of each window."""
    scale = c.random_words(size, seed) | np.uint64(1)
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        total += word[at + j] * scale[j]
    return c.mix(total).view(np.int64)


def _bit(prints: np.ndarray, size: int | np.ndarray, table_bits: int) -> np.ndarray:
    return c.mix(prints + np.asarray(size, np.uint64)) >> np.uint64(64 - table_bits)


def _text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = c.words(data, offsets, _INSIDE)
    return c.span_hashes(_ONE[data], starts, ends), c.span_hashes(_TWO[data], starts, ends), first


# ---------------------------------------------------------------- test items


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of the items with their fingerprints."""
    for rows, data, offsets in c.text_slices(batches):
        one, two, first = _text_words(data, offsets)
        count = np.diff(first)
        for size in sorted(set(np.minimum(count, WINDOW).tolist()) - {0}):
            own = count >= WINDOW if size == WINDOW else count == size
            start, place, full = picks(one, first, size)
            item = np.searchsorted(first, start, side="right") - 1
            keep = own[item]
            start, place, item = start[keep], place[keep], item[keep]
            cols = [pa.array(np.full(len(start), size, np.int32)), pa.array(full[place].view(np.int64)), pa.array(_spelt(one, start, size, 1)), pa.array(_spelt(two, start, size, 2)), rows.column(0).take(pa.array(item))]
            yield pa.RecordBatch.from_arrays(cols, names=[*_KEY, "item_id"])


def item_windows(items: DataFrame, scratch: c.Scratch) -> DataFrame:
    """Each distinct window of the items once, with the sorted ids of its items."""
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    every = texts.mapInArrow(_item_rows, "size int, print long, w1 long, w2 long, item_id string")
    return scratch.save(every.groupBy(*_KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items")), "windows")


def _table_pieces(table_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << table_bits, bool)
        for batch in batches:
            size, prints = (batch.column(i).to_numpy() for i in (0, 1))
            bits[_bit(prints.view(np.uint64), size, table_bits)] = True
        pieces = np.packbits(bits).reshape(-1, 1 << (PIECE_BITS - 3))
        used = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([pieces[x].tobytes() for x in used], pa.binary())], names=["piece", "bits"])

    return run


def _union(table: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
    return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def print_table(windows: DataFrame, table_bits: int) -> np.ndarray:
    """The bit table of all fingerprints: 2**table_bits bits, whatever the items."""
    schema = "piece long, bits binary"
    pieces = windows.select("size", "print").mapInArrow(_table_pieces(table_bits), schema).groupBy("piece").applyInArrow(_union, schema)
    out = np.zeros((1 << (table_bits - PIECE_BITS), 1 << (PIECE_BITS - 3)), np.uint8)
    for row in pieces.collect():
        out[row.piece] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


# ---------------------------------------------------------------- documents

_FOUND = "doc_id long, row long, n_words long, size int, print long, w1 long, w2 long, starts array<int>"


def _candidates(sizes: list[int], table):
    """A row of size 0 for each document, and one for each distinct window that may be an item's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        table_bits = int(len(bits)).bit_length() + 2
        for rows, data, offsets in c.text_slices(batches):
            one, two, first = _text_words(data, offsets)
            doc, key, n = rows.column(0), rows.column(1), rows.num_rows
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([doc, key, pa.array(np.diff(first), pa.int64()), pa.array(np.zeros(n, np.int32)), none, none, none, pa.nulls(n, pa.list_(pa.int32()))], names=_NAMES)
            for size in sizes:
                start, place, full = picks(one, first, size)
                chosen, back = np.unique(place, return_inverse=True)
                bit = _bit(full[chosen], size, table_bits)
                may = (bits[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1 > 0
                keep = may[back]
                start, place = start[keep], place[keep]
                if not len(start):
                    continue
                of = np.searchsorted(first, start, side="right") - 1
                w1, w2 = _spelt(one, start, size, 1), _spelt(two, start, size, 2)
                order = np.lexsort((start, w2, w1, of))
                of, w1, w2, start, place = of[order], w1[order], w2[order], start[order], place[order]
                edge = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
                starts = pa.ListArray.from_arrays(pa.array(np.r_[edge, len(of)], pa.int32()), pa.array((start - first[of]).astype(np.int32)))
                at = pa.array(of[edge])
                cols = [doc.take(at), key.take(at), pa.nulls(len(edge), pa.int64()), pa.array(np.full(len(edge), size, np.int32)), pa.array(full[place[edge]].view(np.int64)), pa.array(w1[edge]), pa.array(w2[edge]), starts]
                yield pa.RecordBatch.from_arrays(cols, names=_NAMES)

    return run


_NAMES = [x.split(" ")[0] for x in _FOUND.split(", ")]


def _hits(docs: DataFrame, items: DataFrame, scratch: c.Scratch, table_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n_words) of each document, and its distinct windows that are an item's, with their items."""
    windows = item_windows(items, scratch)
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most WINDOW of them
    table = docs.sparkSession.sparkContext.broadcast(print_table(windows, table_bits))
    found = scratch.save(docs.select(*c.keyed(), "text").mapInArrow(_candidates(sizes, table), _FOUND), "found")
    hits = c.salted_join(found.where("size > 0").drop("n_words"), windows, _KEY, [*c.ROW, "w1"])
    return found.where("size = 0").select(*c.ROW, "n_words"), hits


def _merged(spans: str) -> str:
    """SQL: sorted spans without overlaps, from an array of [start, end) pairs."""
    last = "element_at(a, -1)"
    grown = f"array(array(element_at({last}, 1), greatest(element_at({last}, 2), x[1])))"
    return f"aggregate(array_sort({spans}), cast(array() AS array<array<bigint>>), (a, x) -> CASE WHEN size(a) > 0 AND element_at(element_at(a, -1), 2) >= x[0] THEN concat(slice(a, 1, size(a) - 1), {grown}) ELSE concat(a, array(x)) END)"


def scan(docs: DataFrame, items: DataFrame, table_bits: int = TABLE_BITS) -> DataFrame:
    """doc_id, n_words, spans of hit words [start, end), ids of the items that occur."""
    scratch = c.Scratch(docs.sparkSession, "decontaminate")
    own, hits = _hits(docs, items, scratch, table_bits)
    spans = F.expr("transform(starts, s -> array(cast(s AS bigint), cast(s + size AS bigint)))")
    by_row = hits.groupBy(*c.ROW).agg(F.array_distinct(F.flatten(F.collect_list(spans))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    by_row = by_row.withColumn("spans", F.expr(_merged("spans")))
    none = F.array().cast("array<array<bigint>>"), F.array().cast("array<string>")
    joined = own.join(by_row, c.ROW, "left")
    return joined.select(c.own_id(), "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, table_bits: int = TABLE_BITS) -> DataFrame:
    """The documents that no window of any item occurs in, with their own columns."""
    scratch = c.Scratch(docs.sparkSession, "decontaminate")
    _, hits = _hits(docs, items, scratch, table_bits)
    keys = [f"__{x}" for x in c.ROW]
    dirty = scratch.save(hits.select(*(F.col(x).alias(k) for x, k in zip(c.ROW, keys, strict=True))).distinct(), "dirty")
    scratch.drop("found", "windows")
    keyed = docs.select("*", *(x.alias(k) for x, k in zip(c.keyed(), keys, strict=True)))
    return keyed.join(dirty, keys, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x[1] - x[0])")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH item AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, w[i:i + least({WINDOW}, len(w)) - 1] AS g
       FROM item, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i) s WHERE len(w) > 0),
doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM doc, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) s),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN iw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
