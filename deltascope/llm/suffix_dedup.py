"""Removal of repeated 50-byte strings with two-stage sorted suffix arrays.

A byte goes when a ``LENGTH``-byte string over it also starts in a document with
a smaller doc_id.  Documents are dealt into blocks.  Three steps over them:

1. Anchors.  Each 50-byte window is named by the least hash of its 24-byte grams;
   equal windows have equal anchors.  Blocks exchange their distinct anchors and
   learn which occur elsewhere; only windows with such an anchor can repeat.
2. Suffix arrays.  A maximal stretch of windows with one anchor is a segment;
   segments travel by anchor, so that equal windows meet.  There the suffixes that
   are smaller than their successors are sorted directly, all others are induced
   from them by one ascending scan over the first-byte buckets, and neighbours in
   the array with a common prefix of 50 bytes or more are one class.  A segment
   goes home with the least document of each of its windows' classes.
3. Blocks find the places of their segments again, and cut out the bytes of every
   window whose class has a lesser document.

Cases: null is the empty text, and a text of under 50 bytes is kept whole; strings
repeated inside one document stay; rows that repeat a doc_id are rows of their own
and don't erase each other; a row without a doc_id counts as one after all
others and erases nothing; empty tables and further columns are fine.

Scale: one exchange of the texts serves all steps; anchors and segments are packed
per block and bucket, and places never leave their block: a passage that is
everywhere costs a block one entry, and equal segments of all blocks are sorted
once.  Arrays are built over chunks of whole anchors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm import _common as c

LENGTH = 50
GRAM = 24
WIDTH = LENGTH - GRAM + 1
#: Most windows of one segment; longer stretches are cut, with overlap.
SEGMENT_WINDOWS = 64
BLOCK_BYTES = 2 << 20
ANCHOR_BUCKET_BYTES = 32 << 20
SEGMENT_BUCKET_BYTES = 4 << 20
#: Bytes of segments in one suffix array (more only for a single anchor).
CHUNK_BYTES = 1 << 20
#: Bytes of rows whose windows are named at a time (more only for a single row).
PIECE_BYTES = 1 << 19

_ONE, _TWO = c.byte_values(seed=61), c.byte_values(seed=62)


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, bytes and offsets of a block in a fixed order, whatever order its rows came in."""
    table = table.select(["doc_id", "text"]).combine_chunks()
    doc = pc.fill_null(table.column("doc_id"), c.LAST).to_numpy()
    order = np.argsort(doc, kind="stable")
    if len(doc) and (doc[order][1:] == doc[order][:-1]).any():
        texts = table.column("text").to_pylist()
        order = np.array(sorted(range(len(doc)), key=lambda i: (doc[i], texts[i] or "")))
    column = table.column("text").take(pa.array(order))
    data, offsets = c.utf8(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return doc[order], data, offsets


def stretches(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Maximal stretches of windows with one anchor: anchor, row, first window, windows."""
    out, a = [], 0
    while a < len(offsets) - 1:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE_BYTES, side="right")) - 1)
        anchor, row, start, count = _stretches(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
        out.append((anchor, row + a, start + offsets[a], count))
        a = z
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3]


def _stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    grams = np.arange(len(data) - GRAM + 1)
    low = c.span_hashes(_ONE[data], grams, grams + GRAM)
    reach = 1
    while 2 * reach <= WIDTH:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < WIDTH:
        low = np.minimum(low[: n], low[WIDTH - reach : WIDTH - reach + n])
    row = np.searchsorted(offsets, np.arange(n), side="right") - 1
    fits = np.arange(n) + LENGTH <= offsets[row + 1]
    at = np.flatnonzero(fits)
    if not len(at):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    new = np.r_[True, (low[at][1:] != low[at][:-1]) | (row[at][1:] != row[at][:-1])]
    edge = np.flatnonzero(new)
    # least hashes crowd the low end of their range: mixed again, they fill the buckets evenly
    return c.mix(low[at[edge]]), row[at[edge]], at[edge], np.diff(np.r_[edge, len(at)])


def _six(values: np.ndarray) -> bytes:
    """The low six bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _by_bucket(anchors: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors ordered by (bucket, value), and their buckets."""
    anchors = np.unique(anchors)
    bucket = ((anchors >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)
    return anchors, bucket.astype(np.int64)


def _anchors(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, data, offsets = _block(table)
        anchors, bucket = _by_bucket(stretches(data, offsets)[0], buckets)
        edge = np.flatnonzero(np.r_[True, np.diff(bucket) != 0]) if len(bucket) else np.zeros(0, np.int64)
        stop = [*edge[1:].tolist(), len(bucket)]
        packed = [_six(anchors[a:b]) for a, b in zip(edge.tolist(), stop, strict=False)]
        return pa.table({"bucket": pa.array(bucket[edge], pa.int64()), "block": pa.array([key[0].as_py()] * len(packed), pa.int64()), "packed": c.binary_rows(packed)})

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """For each block's anchors of a bucket, in order, whether another block has it."""
    packed = table.column("packed").to_pylist()
    each = [_from_six(x) for x in packed]
    value = np.concatenate(each)
    order = np.argsort(value, kind="stable")
    same = np.r_[False, value[order][1:] == value[order][:-1], False]
    flag = np.empty(len(value), bool)
    flag[order] = same[1:] | same[:-1]
    bounds = np.cumsum([0, *map(len, each)])
    bits = [np.packbits(flag[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": c.binary_rows(bits)})


class Segments:
    """The segments of a block whose anchors are wanted, equal ones named once.

    ``order`` sorts the segments by bucket, anchor and content; ``new`` flags the
    first of equal ones there (a head).  Every step that asks gets the same heads.
    """

    def __init__(self, rows: pa.Table, buckets: int, wanted) -> None:
        self.doc, self.data, self.offsets = doc, data, offsets = _block(rows)
        anchor, row, start, count = stretches(data, offsets)
        keep = wanted(anchor, row, len(doc))
        anchor, row, start, count = anchor[keep], row[keep], start[keep], count[keep]
        pieces = -(-count // SEGMENT_WINDOWS)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.anchor, self.row = np.repeat(anchor, pieces), np.repeat(row, pieces)
        self.start, left = np.repeat(start, pieces) + nth * SEGMENT_WINDOWS, np.repeat(count, pieces) - nth * SEGMENT_WINDOWS
        self.count = np.minimum(left, SEGMENT_WINDOWS)
        self.end = self.start + self.count + LENGTH - 1
        self.h1, self.h2 = _span_pairs(data, offsets, self.row, self.start, self.end)
        self.to = (self.anchor % np.uint64(buckets)).astype(np.int64)
        self.order = o = np.lexsort((self.h2, self.h1, self.anchor, self.to))
        self.new = np.r_[True, (self.h1[o][1:] != self.h1[o][:-1]) | (self.h2[o][1:] != self.h2[o][:-1]) | (self.anchor[o][1:] != self.anchor[o][:-1])][: len(o)]
        self.heads = o[self.new]


def _span_pairs(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each span (spans in the order of their rows), a piece of the rows at a time."""
    out: list[list[np.ndarray]] = [[], []]
    a = 0
    while a < len(row):
        limit = offsets[row[a]] + PIECE_BYTES
        z = max(int(np.searchsorted(end, limit, side="right")), int(np.searchsorted(row, row[a], side="right")))
        lo, hi = int(start[a]), int(end[a:z].max())
        for values, hashes in zip((_ONE, _TWO), out, strict=True):
            hashes.append(c.span_hashes(values[data[lo:hi]], start[a:z] - lo, end[a:z] - lo))
        a = z
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out[0]]), np.concatenate([none, *out[1]])


def _segments(anchor_buckets: int, buckets: int):
    """By bucket: each distinct segment of a block, with its least document there."""

    def run(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        def wanted(anchor: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
            anchors, bucket = _by_bucket(anchor, anchor_buckets)
            flag = np.zeros(len(anchors), bool)
            for k, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist(), strict=True):
                a, b = np.searchsorted(bucket, [k, k + 1])
                flag[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8))[: b - a]
            place = np.searchsorted(anchors, anchor)
            # inside the block: anchors of two or more rows
            pairs = np.unique(place * np.int64(n + 1) + row)
            flag |= np.bincount(pairs // (n + 1), minlength=len(anchors)) > 1
            return flag[place] if len(place) else np.zeros(0, bool)

        own = Segments(rows, buckets, wanted)
        heads = own.heads
        least = np.minimum.reduceat(own.doc[own.row[own.order]], np.flatnonzero(own.new)) if len(heads) else np.zeros(0, np.int64)
        out: dict[str, list] = {x: [] for x in ("bucket", "block", "size", "blob", "meta")}
        edge = np.flatnonzero(np.r_[True, np.diff(own.to[heads]) != 0]) if len(heads) else []
        for a, b in zip(edge, [*edge[1:], len(heads)] if len(heads) else [], strict=True):
            h = heads[a:b]
            blob = b"".join([own.data[x:y].tobytes() for x, y in zip(own.start[h].tolist(), own.end[h].tolist(), strict=True)])
            meta = b"".join(np.ascontiguousarray(x).tobytes() for x in (own.anchor[h], own.h1[h], least[a:b].astype(np.int64), own.count[h].astype(np.uint8)))
            out["bucket"].append(int(own.to[h[0]]))
            out["block"].append(key[0].as_py())
            out["size"].append([len(h), len(blob)])
            out["blob"].append(_pack(blob))
            out["meta"].append(_pack(meta))
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "block": pa.array(out["block"], pa.int64()), "size": pa.array(out["size"], pa.list_(pa.int64())), "blob": c.binary_rows(out["blob"]), "meta": c.binary_rows(out["meta"])})

    return run


def _pack(raw: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(packed: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(packed, size, asbytes=True) if size else b""


# ---------------------------------------------------------------- suffix arrays


def suffix_array(text: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The windows of all segments in the order of their suffixes, by two-stage sorting.

    ``text`` holds the segments one after another; segment i begins at ``begin[i]``
    and has ``windows[i]`` windows, that is ``windows[i] + LENGTH - 1`` bytes.
    """
    n = len(text)
    size = windows + LENGTH - 1
    last = np.repeat(begin + size, size)  # end of each byte's segment
    # a suffix is small (smaller than its successor) if the next other byte is larger, or none follows
    change = np.flatnonzero(np.r_[text[1:] != text[:-1], True] | (np.arange(1, n + 1) == last)) + 1
    run_end = change[np.searchsorted(change, np.arange(n), side="right")]
    padded = np.r_[text, np.zeros(LENGTH + 16, np.uint8)]
    small = (run_end == last) | (padded[run_end] > text)
    # in scope: the windows, and what follows up to the first small suffix
    small_at = np.flatnonzero(small)
    stop = small_at[np.searchsorted(small_at, begin + windows)]
    mark = np.zeros(n + 1, np.int64)
    mark[begin] += 1
    mark[stop + 1] -= 1
    scope = np.cumsum(mark)[:n] > 0

    # stage one: sort the small suffixes directly, eight bytes at a time
    direct = np.flatnonzero(scope & small)
    words = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
    keys = [words[direct + o].astype(np.uint64) for o in (*range(0, LENGTH - 7, 8), LENGTH - 8)]
    direct = direct[np.lexsort(keys[::-1])]

    # stage two: scan the buckets of first bytes upwards; each placed suffix places its large predecessor
    first_of = np.zeros(n + 1, bool)
    first_of[begin] = True
    induced = scope & ~small
    byte = text[direct]
    split = np.searchsorted(byte, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def before(placed: np.ndarray) -> np.ndarray:
        placed = placed[~first_of[placed]] - 1
        return placed[induced[placed]]

    for b in range(256):
        bucket = []
        front = np.concatenate(waiting[b]) if waiting[b] else np.zeros(0, np.int64)
        waiting[b] = []
        while len(front):
            bucket.append(front)
            back = before(front)
            front = back[text[back] == b]
        bucket.append(direct[split[b] : split[b + 1]])
        placed = np.concatenate(bucket)
        if not len(placed):
            continue
        out.append(placed)
        back = before(placed)
        target = text[back]
        higher = target > b
        back, target = back[higher], target[higher]
        order = np.argsort(target, kind="stable")
        back, target = back[order], target[order]
        edge = np.flatnonzero(np.r_[True, np.diff(target) != 0]) if len(target) else []
        for x, y in zip(edge, [*edge[1:], len(target)] if len(target) else [], strict=True):
            waiting[target[x]].append(back[x:y])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(begin)), size)
    return order[order - begin[owner[order]] < windows[owner[order]]]


def same_as_before(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether a suffix and the one before it in the array share LENGTH bytes or more."""
    padded = np.r_[text, np.zeros(16, np.uint8)]
    words = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
    same = np.ones(max(len(order) - 1, 0), bool)
    for o in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        same &= words[order[1:] + o] == words[order[:-1] + o]
    return np.r_[False, same] if len(order) else np.zeros(0, bool)


def _floors(key: tuple, table: pa.Table) -> pa.Table:
    """For each block's segments of a bucket: the least document of each window's class, as runs."""
    meta, blobs, parts = [], [], []
    for (heads, raw), blob, packed in zip(*(table.column(x).to_pylist() for x in ("size", "blob", "meta")), strict=True):
        plain = _unpack(packed, 25 * heads)
        meta.append((*np.frombuffer(plain, np.uint64, 2 * heads).reshape(2, heads), np.frombuffer(plain, np.int64, heads, 16 * heads), np.frombuffer(plain, np.uint8, heads, 24 * heads).astype(np.int64)))
        blobs.append(np.frombuffer(_unpack(blob, raw), np.uint8))
        parts.append(heads)
    anchor, name, least, count = (np.concatenate(x) for x in zip(*meta, strict=True))
    text = np.concatenate(blobs)
    del meta, blobs
    # equal segments of all blocks (by anchor, size and 64 bits over the bytes) are one, with the least document of them all
    order = np.lexsort((count, name, anchor))
    new = np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (name[order][1:] != name[order][:-1]) | (count[order][1:] != count[order][:-1])]
    named = np.empty(len(order), np.int64)
    named[order] = np.cumsum(new) - 1
    edge = np.flatnonzero(new)
    at = np.r_[0, np.cumsum(count + LENGTH - 1)][order[edge]]
    own_anchor, own_least, own_count = anchor[order[edge]], np.minimum.reduceat(least[order], edge), count[order[edge]]
    size = own_count + LENGTH - 1
    first_window = np.r_[0, np.cumsum(own_count)]
    floor = np.zeros(first_window[-1], np.int64)  # for each window: the least document of its class
    group = np.flatnonzero(np.r_[True, np.diff(own_anchor) != 0])
    bytes_before = np.r_[0, np.cumsum(size)]
    a = 0
    while a < len(group):
        z = max(int(np.searchsorted(bytes_before[group], bytes_before[group[a]] + CHUNK_BYTES, side="right")), a + 1)
        lo, hi = group[a], group[z] if z < len(group) else len(size)
        a = z
        begin = bytes_before[lo:hi] - bytes_before[lo]
        piece = text[np.repeat(at[lo:hi] - begin, size[lo:hi]) + np.arange(bytes_before[hi] - bytes_before[lo])]
        windows = suffix_array(piece, begin, own_count[lo:hi])
        head = np.flatnonzero(~same_as_before(piece, windows))
        owner = np.searchsorted(begin, windows, side="right") - 1
        lowest = np.minimum.reduceat(own_least[lo:hi][owner], head)
        floor[first_window[lo + owner] + windows - begin[owner]] = np.repeat(lowest, np.diff(np.r_[head, len(windows)]))
    # runs of windows with one floor, for each distinct segment
    starts = np.r_[True, floor[1:] != floor[:-1]]
    starts[first_window[:-1]] = True
    run = np.flatnonzero(starts)
    of = np.searchsorted(first_window, run, side="right") - 1
    run_end, run_floor = np.r_[run[1:], len(floor)] - first_window[of], floor[run]
    runs = np.bincount(of, minlength=len(size))
    first_run = np.r_[0, np.cumsum(runs)]
    sizes, replies, lo = [], [], 0
    for heads in parts:
        own = named[lo : lo + heads]
        n = runs[own]
        which = np.repeat(first_run[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        replies.append(_pack(b"".join(np.ascontiguousarray(x).tobytes() for x in (anchor[lo : lo + heads], run_floor[which], n.astype(np.uint8), run_end[which].astype(np.uint8)))))
        sizes.append([heads, int(n.sum())])
        lo += heads
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "size": pa.array(sizes, pa.list_(pa.int64())), "floors": pa.array(replies, pa.binary())})


def _cut(buckets: int, outputs: tuple[str, ...]):
    def run(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        anchors, floors, counts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, (heads, n), packed in sorted(zip(*(replies.column(x).to_pylist() for x in ("bucket", "size", "floors")), strict=True), key=lambda x: x[0]):
            plain = _unpack(packed, 9 * (heads + n))
            anchors.append(np.frombuffer(plain, np.uint64, heads))
            floors.append(np.frombuffer(plain, np.int64, n, 8 * heads))
            counts.append(np.frombuffer(plain, np.uint8, heads, 8 * (heads + n)).astype(np.int64))
            ends.append(np.frombuffer(plain, np.uint8, n, 8 * (heads + n) + heads).astype(np.int64))
        asked, floor, n_runs, end = (np.concatenate(x) for x in (anchors, floors, counts, ends))
        asked = np.unique(asked)
        own = Segments(rows, buckets, lambda anchor, row, n: np.isin(anchor, asked))
        # the runs of each place's head; a run goes if its floor is below the place's document
        doc, data, offsets = own.doc, own.data, own.offsets
        head = np.cumsum(own.new) - 1
        n = n_runs[head]
        place = np.repeat(own.order, n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        which = np.repeat((np.cumsum(n_runs) - n_runs)[head], n) + nth
        dead = floor[which] < doc[own.row[place]]
        place, which, nth = place[dead], which[dead], nth[dead]
        begin = np.where(nth > 0, end[which - 1], 0)
        gone = np.zeros(len(data) + 1, np.int32)
        np.add.at(gone, own.start[place] + begin, 1)
        np.add.at(gone, own.start[place] + end[which] + LENGTH - 1, -1)
        dead = np.cumsum(gone)[:-1] > 0
        cols: dict[str, list] = {k: [] for k in _OUT}
        for i in range(len(doc)):
            a, b = offsets[i], offsets[i + 1]
            mine = dead[a:b]
            kept = data[a:b][~mine].tobytes()
            cols["doc_id"].append(int(doc[i]) if doc[i] != c.LAST else None)
            cols["n_bytes"].append(int(b - a))
            cols["n_removed"].append(int(mine.sum()))
            flips = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
            cols["n_spans"].append(len(flips) // 2)
            if "spans" in outputs:
                cols["spans"].append(flips.reshape(-1, 2).tolist())
            if "kept" in outputs:
                cols["kept"].append(kept)
            cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return pa.table({k: pa.array(cols[k], _OUT[k][1]) for k in ("doc_id", *outputs)})

    return run


_OUT = {
    "doc_id": ("long", pa.int64()),
    "n_bytes": ("long", pa.int64()),
    "n_removed": ("long", pa.int64()),
    "n_spans": ("long", pa.int64()),
    "spans": ("array<array<long>>", pa.list_(pa.list_(pa.int64()))),
    "kept": ("binary", pa.binary()),
    "kept_sha256": ("string", pa.string()),
}


def dedupe(docs: DataFrame, outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "spans", "kept")) -> DataFrame:
    """doc_id and the wanted ``outputs``: n_bytes, n_removed, n_spans, spans, kept, kept_sha256."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, anchor_buckets, buckets = (int(max(16, total // x)) for x in (BLOCK_BYTES, ANCHOR_BUCKET_BYTES, SEGMENT_BUCKET_BYTES))
    # All three steps group one child by one key, so Spark makes a single exchange of the texts.
    rows = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks).cast("long"))).groupBy("block")
    anchors = rows.applyInArrow(_anchors(anchor_buckets), "bucket long, block long, packed binary")
    replies = anchors.groupBy("bucket").applyInArrow(_shared, "block long, bucket long, bits binary")
    segments = rows.cogroup(replies.groupBy("block")).applyInArrow(_segments(anchor_buckets, buckets), "bucket long, block long, size array<long>, blob binary, meta binary")
    floors = segments.groupBy("bucket").applyInArrow(_floors, "block long, bucket long, size array<long>, floors binary")
    schema = ", ".join(f"{k} {_OUT[k][0]}" for k in ("doc_id", *outputs))
    return rows.cogroup(floors.groupBy("block")).applyInArrow(_cut(buckets, tuple(outputs)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(c.table(spark, sf_dir, "documents"), ("n_bytes", "n_removed", "n_spans", "kept_sha256"))


SQL = f"""
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS s FROM doc, LATERAL (SELECT unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS p) x),
least_doc AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, p FROM win JOIN least_doc USING (s) WHERE first < doc_id),
edge AS (SELECT *, p + {LENGTH} AS stop, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM hit),
numbered AS (SELECT *, sum((prev IS NULL OR p - prev > {LENGTH})::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edge),
span AS (SELECT doc_id, k, min(p) AS a, max(stop) AS b FROM numbered GROUP BY doc_id, k),
size AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM span),
piece AS (SELECT doc_id, since AS from_byte, substr(h, 2 * since + 1, 2 * (a - since)) AS x FROM cut JOIN doc USING (doc_id) UNION ALL SELECT doc_id, max(b), substr(any_value(h), 2 * max(b) + 1) FROM span JOIN doc USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY from_byte) AS h FROM piece GROUP BY doc_id)
SELECT doc_id, length(doc.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, doc.h))) AS kept_sha256
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
