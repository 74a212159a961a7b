"""Exact Jaccard join of documents on word shingles, and its components.

A document is the set of its distinct 4-word shingles (64-bit hashes, sorted); callers
may set another width and threshold.
Sizes fall in bands that widen by 1/0.85, so that two linked documents lie in one
band or in neighbours.  Within a band two linked sets differ in at most D
shingles; the hash range is cut into more than D parts, and so some parts surely
are equal in both.  (band, part, content) is a tile: only documents of one tile are
compared.  Of M parts that hold S equal ones surely, a set takes the M - S + 1 tiles
that come first in an order that all sets share (the most shingles first): the first of the equal ones has the S - 1
others after it, and so is taken in both sets.  Parts of a single shingle, which all texts with one
passage would share, and empty parts come last and are seldom taken; no link is lost.

In a tile the bit counts of hashed bitmaps bound the overlap from above, sizes
and bitmaps reject most pairs, and the rest are intersected exactly.

Equal sets are one node, named by a 64-bit hash, and tiles with the same members
are one list.  Each list first links its members with the one that meets others
in the most tiles (a star, never all pairs).  Where members stay in different
components, those of a short list (48 at most) are compared one by one; in longer lists sets meet by their rarest shingles: linked ones have a common shingle so
early in the order of rarity that enough follow it in both.  First neighbours among the
sets with the same rare shingle are tested, then, where that leaves components apart,
each set outside its list's largest one with all that have such a shingle in common and are of
another component.  So no link between components is missed, and neither a tight group of copies nor many
texts of one template that fall short of the threshold make all their pairs.

Cases: null and wordless texts are empty and linked with nothing; under that
many words the whole sequence is the one shingle; repeated rows and equal texts are
linked (100 % overlap); rows without a doc_id are members too, but give no component
its name (a component of such rows alone has none); where one row of each stays, rows
are told apart by id and text; an empty table gives an empty result; further columns are
ignored.

Scale: one pass over the texts makes everything but the exact sets.  Signatures
travel packed by bucket of tiles, as six bytes and a slot of their block; bitmaps
of documents that share a tile follow by node; the texts are shuffled for pairs
that pass the bitmaps.  Components come from min-label propagation with pointer
jumping, all in tables on shared storage.  Last joins deal a hot node or component
over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltascope.llm import _common as c

#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
SHINGLE = 4
#: Parts beyond those that linked sets may differ in, as a share of these; as many tiles of least content aren't taken.
SPARE = 5
BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket of tiles.
BUCKET_BYTES = 16 << 20

_INSIDE = c.blank_words()
_VALUES = c.byte_values(fold_case=True, seed=51)


def linked(both: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (a + b - both)


class Bands:
    """Size bands, and the parts of the hash range in each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]

    def most_differing(self, size: int) -> int:
        """The most shingles in which two linked sets of at most ``size`` can differ."""
        return 2 * size * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * 100 // self.percent)))
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """How many parts there are, and how many of them surely agree."""
        while len(self.low) < band + 2:
            self.of(self.low[-1])
        differ = self.most_differing(self.low[band + 1] - 1)
        spare = 1 + (2 + differ // SPARE if differ else 0)
        return differ + spare, spare


@lru_cache(8)
def bands(percent: int) -> Bands:
    return Bands(percent)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    starts, ends, first = c.words(data, offsets, _INSIDE)
    word = c.span_hashes(_VALUES[data], starts, ends)
    gram, at = c.gram_hashes(word, first, k)
    edge = np.searchsorted(at, first)
    out = []
    for i in range(len(offsets) - 1):
        n = first[i + 1] - first[i]
        if 0 < n < k:
            gram_i, _ = c.gram_hashes(word[first[i] : first[i + 1]], np.array([0, n]), int(n))
            out.append(gram_i)
        else:
            out.append(np.unique(gram[edge[i] : edge[i + 1]]))
    return out


def set_hash(s: np.ndarray) -> int:
    """The node of a set: a 64-bit hash of all its shingles."""
    return int(c.mix(c.mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).astype(np.int64)[0])


def tiles(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of the tiles that a set belongs to: of its parts those of the most shingles, enough to meet all linked sets."""
    cuts = bands(percent)
    band = cuts.of(len(s))
    mixed = c.mix(s + np.uint64(1))
    out = []
    for b in (band, band + 1):
        m, spare = cuts.parts(b)
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        tag = np.uint64(b) << np.uint64(40)
        sign = c.mix(np.add.reduceat(mixed, edge) + c.mix(part[edge] + tag))
        keep = m - spare + 1
        if len(edge) > keep:
            sign = sign[np.lexsort((sign, -np.diff(np.r_[edge, len(s)])))[:keep]]
        elif len(edge) < keep:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), part[edge])
            sign = np.r_[sign, np.sort(c.mix(c.mix(empty + tag) ^ np.uint64(0xA5A5A5A5)))[: keep - len(edge)]]
        out.append(sign)
    return np.concatenate(out)


def bitmap(s: np.ndarray) -> bytes:
    """Four bits a shingle or more, a power of two; halves fold onto each other."""
    size = 1 << max(6, int(4 * len(s) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def most_common(a: int, b: int, bits_a: bytes, bits_b: bytes) -> int:
    """An upper bound of the overlap of two sets, from their bitmaps."""
    x, y = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return (a + b - int(np.bitwise_count(x ^ y).sum())) // 2


# ---------------------------------------------------------------- stages over texts


#: Documents of a block whose sets differ; a signature names its set by a 16-bit slot of the block.
SLOTS = 1 << 16
#: Bytes of a signature on its way; equal ones of unequal parts only add candidates.
SIGN_BYTES = 6

_PACKED = "bucket long, block long, docs array<long>, rows array<long>, sizes array<long>, nodes array<long>, slots array<long>, slot_sizes array<long>, bits array<binary>, signs binary, places binary"
_FOUND = "kind int, doc_id long, row long, n long, node long, place long, list long, weight long, bits binary"
OWN, SLOT, LISTED = 0, 1, 2


def _narrow(sign: np.ndarray) -> bytes:
    return np.ascontiguousarray(sign).view(np.uint8).reshape(-1, 8)[:, :SIGN_BYTES].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SIGN_BYTES, 8), np.uint8)
    out[:, :SIGN_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SIGN_BYTES)
    return out.reshape(-1).view(np.uint64)


def _block_name(nodes: np.ndarray) -> int:
    """47 bits over the sets of a block: equal blocks may share it, as their slots are equal."""
    scale = c.mix(np.arange(1, len(nodes) + 1, dtype=np.uint64))
    return int(c.mix((c.mix(nodes.astype(np.uint64)) * (scale | np.uint64(1))).sum(dtype=np.uint64, keepdims=True))[0] >> np.uint64(17))


def _tile_rows(k: int, percent: int, buckets: int):
    """Blocks of documents: one row of sizes and nodes, and the signatures and slots by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((x, pa.list_(pa.int64())) for x in ("docs", "rows", "sizes", "nodes", "slots", "slot_sizes")), ("bits", pa.list_(pa.binary())), ("signs", pa.binary()), ("places", pa.binary())])
        docs: list[int | None] = []
        texts: list[int] = []
        sizes: list[int] = []
        nodes: list[int | None] = []
        slots: dict[int, int] = {}
        slot_sizes: list[int] = []
        bits: list[bytes] = []
        signs: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs, texts, sizes, nodes, slots, slot_sizes, bits, signs, held
            if docs:
                block = _block_name(np.fromiter(slots, np.int64, len(slots)))
                rows = [{"bucket": block % buckets, "block": block, "docs": docs, "rows": texts, "sizes": sizes, "nodes": nodes, "slots": list(slots), "slot_sizes": slot_sizes, "bits": bits}]
                if signs:
                    sign = np.concatenate(signs) >> np.uint64(64 - 8 * SIGN_BYTES)
                    place = np.repeat(np.arange(len(signs), dtype=np.uint16), [len(x) for x in signs])
                    bucket = (sign % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    sign, place, bucket = sign[order], place[order], bucket[order]
                    edge = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])
                    rows += [{"bucket": int(bucket[x]), "block": block, "signs": _narrow(sign[x:y]), "places": place[x:y].tobytes()} for x, y in zip(edge, np.r_[edge[1:], len(bucket)], strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema)
            docs, texts, sizes, nodes, slots, slot_sizes, bits, signs, held = [], [], [], [], {}, [], [], [], 0

        for rows, data, offsets in c.text_slices(batches):
            for doc, row, s in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), shingle_sets(data, offsets, k), strict=True):
                node = set_hash(s) if len(s) else None
                docs.append(doc)
                texts.append(row)
                sizes.append(len(s))
                nodes.append(node)
                if node is not None and node not in slots:
                    slots[node] = len(slots)
                    slot_sizes.append(len(s))
                    bits.append(bitmap(s))
                    signs.append(tiles(s, percent))
                if len(slots) == SLOTS:
                    yield from flush()
            held += len(data)
            if held >= BLOCK_BYTES:
                yield from flush()
        yield from flush()

    return run


def _tile_lists(table: pa.Table) -> pa.Table:
    """The documents and slots that came along, and the distinct member lists of the bucket's tiles.

    A list (two places or more) is named by a hash of its places and weighs as many
    tiles as have it, so that tiles with equal members cost one list.
    """
    none = np.zeros(0, np.int64)
    out = []
    for row in table.filter(pc.is_valid(table.column("docs"))).select(["block", "docs", "rows", "sizes", "nodes", "slots", "slot_sizes", "bits"]).to_pylist():
        out.append(_found(OWN, len(row["docs"]), doc_id=row["docs"], row=row["rows"], n=row["sizes"], node=row["nodes"]))
        out.append(_found(SLOT, len(row["slots"]), node=row["slots"], n=row["slot_sizes"], bits=row["bits"], place=(row["block"] << 16) + np.arange(len(row["slots"]))))
    packed = table.filter(pc.is_valid(table.column("signs"))).select(["block", "signs", "places"]).to_pylist()
    sign = np.concatenate([np.zeros(0, np.uint64), *(_wide(row["signs"]) for row in packed)])
    place = np.concatenate([none, *((row["block"] << 16) + np.frombuffer(row["places"], np.uint16).astype(np.int64) for row in packed)])
    del packed
    order = np.argsort(sign, kind="stable")
    sign, place = sign[order], place[order]
    same = np.r_[False, sign[1:] == sign[:-1], False]
    shared = same[1:] | same[:-1] if len(sign) else np.zeros(0, bool)
    sign, place = sign[shared], place[shared]
    order = np.lexsort((place, sign))
    sign, place = sign[order], place[order]
    if len(sign):
        new = np.r_[True, (sign[1:] != sign[:-1]) | (place[1:] != place[:-1])]
        sign, place = sign[new], place[new]
        edge = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
        size = np.diff(np.r_[edge, len(sign)])
        name = c.mix(np.add.reduceat(c.mix(place.astype(np.uint64)), edge) + size.astype(np.uint64)).astype(np.int64)
        name, at, weight = np.unique(name[size > 1], return_index=True, return_counts=True)
        edge, size = edge[size > 1][at], size[size > 1][at]
        spread = np.repeat(edge - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        out.append(_found(LISTED, len(spread), place=place[spread], list=np.repeat(name, size), weight=np.repeat(weight, size)))
    del sign, place, order, same, shared
    c.give_back()
    return pa.concat_tables([_found(OWN, 0), *out])


def _found(kind: int, rows: int, /, **columns) -> pa.Table:
    cols = {"kind": pa.array(np.full(rows, kind, np.int32))}
    for name in ("doc_id", "row", "n", "node", "place", "list", "weight", "bits"):
        kind_of = pa.binary() if name == "bits" else pa.int64()
        cols[name] = pa.array(columns[name], kind_of) if name in columns else pa.nulls(rows, kind_of)
    return pa.table(cols)


def _set_rows(k: int):
    """Node and hashes of the set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in c.text_slices(batches):
            sets = shingle_sets(data, offsets, k)
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), c.binary_rows([s.tobytes() for s in sets])], names=["id", "shingles"])

    return run


# ---------------------------------------------------------------- pairs


def _bounded(percent: int):
    """Keeps the pairs whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, xa, xb = (batch.column(i).to_pylist() for i in range(6))
            keep = [linked(min(m, n, most_common(m, n, x, y)), m, n, percent) for m, n, x, y in zip(na, nb, xa, xb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _intersected(percent: int):
    """Keeps the pairs whose sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                keep.append(linked(int((large[at] == small).sum()), len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Lists of up to so many members are compared member by member; longer ones meet by their rarest shingles.
SHORT_LIST = 48


def _across(percent: int):
    """Pairs of a short list in different components that sizes and bitmaps allow."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node, comp, n = (table.column(x).to_numpy() for x in ("node", "comp", "n"))
        bits = table.column("bits").to_pylist()
        pairs = set()
        for i in range(len(node)):
            near = np.flatnonzero((comp != comp[i]) & (np.arange(len(node)) > i) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            for j in near.tolist():
                both = min(int(n[i]), int(n[j]), most_common(int(n[i]), int(n[j]), bits[i], bits[j]))
                if linked(both, int(n[i]), int(n[j]), percent):
                    pairs.add((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))))
        found = sorted(pairs)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return run


#: Buckets of shingle hashes whose counts order the shingles of a set, and how many of them, the most
#: frequent ones, have a count: a fixed table.  Any order gives the same pairs; this one keeps them few.
COUNT_BITS = 16
COUNTED = 1 << 16


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's sets fall in each bucket."""
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        for x in batch.column(0):
            np.add.at(total, _bucket(np.frombuffer(x.as_py(), np.uint64)), 1)
    at = np.flatnonzero(total)
    yield pa.record_batch({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})


_RARE = "gram long, node long, comp long, rest boolean, n long, place long, held boolean"


def _rarest(percent: int, counts):
    """The rarest shingles of each set, with how many of it follow from there on.

    Two linked sets, each in the order of rarity, have their first common shingle so early in
    both that enough follow it.  The larger set asks with all that are early enough for any
    partner; ``held`` are those early enough for a partner that is no smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            for node, comp, rest, raw in zip(*(batch.column(i) for i in range(4)), strict=True):
                s = np.frombuffer(raw.as_py(), np.uint64)
                n = len(s)
                asks, holds = n + (-percent * n // 100) + 1, n + (-2 * percent * n // (100 + percent)) + 1
                first = s[np.lexsort((s, table[_bucket(s)]))[:asks]]
                k = len(first)
                yield pa.record_batch({
                    "gram": pa.array(first.view(np.int64)), "node": pa.array(np.full(k, node.as_py(), np.int64)), "comp": pa.array(np.full(k, comp.as_py(), np.int64)), "rest": pa.array(np.full(k, rest.as_py(), bool)),
                    "n": pa.array(np.full(k, n, np.int64)), "place": pa.array(n - np.arange(k)), "held": pa.array(np.arange(k) < holds),
                })

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that follow each other among those with the same rare shingle."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, node, comp = (batch.column(i).to_numpy() for i in range(3))
        if last is not None:
            gram, node, comp = (np.r_[x, y] for x, y in zip(last, (gram, node, comp), strict=True))
        pair = np.flatnonzero((gram[1:] == gram[:-1]) & (comp[1:] != comp[:-1]))
        a, b = node[pair], node[pair + 1]
        yield pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})
        last = gram[-1:], node[-1:], comp[-1:]


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def components(edges: DataFrame, scratch: c.Scratch, name: str) -> DataFrame:
    """(id, comp): the least id that each id of ``edges`` (a, b) reaches."""
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    label = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("id"), "comp"), f"{name}-0")
    step = 0
    while True:
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "id")
        one = label.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        of = label.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        jumped = one.join(of, "comp").select("id", F.least("comp", "up").alias("comp"), (F.least("comp", "up") != F.col("old")).alias("moved"))
        step += 1
        label_next = scratch.save(jumped, f"{name}-{step}")
        moved = label_next.where("moved").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        label = label_next.select("id", "comp")
        if not moved:
            scratch.drop(f"{name}-edges")
            return label


def _joined(comp: DataFrame, links: DataFrame, scratch: c.Scratch, name: str) -> DataFrame:
    """(id, comp) after further links: only the components that they join are walked again."""
    x, y = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    ends = links.join(x, "a", "left").join(y, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    ends = scratch.save(ends, f"{name}-ends")
    up = components(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch, name).toDF("comp", "up")
    alone = ends.select("a", "ca").union(ends.select("b", "cb")).toDF("id", "comp").where("id = comp").distinct().join(comp, "id", "left_anti")
    out = scratch.save(comp.unionByName(alone).join(up, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")), f"{name}-all")
    scratch.drop(f"{name}-ends")
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_intersected(percent), _PAIR)


def _across_components(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet known to be in one component."""
    x, y = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    joined = pairs.join(x, "a", "left").join(y, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each document, by shingles of ``k`` words."""
    return _placed(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("head", "doc_id").alias("component_id"))


def _placed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, row (a hash of its text), n and, unless the set is empty, comp (a node of the component) and head (its least doc_id) of each document."""
    spark = docs.sparkSession
    scratch = c.Scratch(spark, "ngrams")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(16, total // BUCKET_BYTES))

    packed = texts.mapInArrow(_tile_rows(k, percent, buckets), _PACKED)
    found = scratch.save(packed.groupBy("bucket").applyInArrow(_tile_lists, _FOUND), "found")
    scratch.release()
    own = found.where(F.col("kind") == OWN).select("doc_id", "row", "n", "node")
    slots = found.where(F.col("kind") == SLOT).select("place", "node").distinct()
    listed = found.where(F.col("kind") == LISTED).groupBy("list", "place").agg(F.sum("weight").alias("weight"))
    members = scratch.save(listed.join(slots, "place").groupBy("list", "node").agg(F.max("weight").alias("weight")), "members")

    # in each list a star around the member that meets others in the most tiles: an original, if there is one
    degree = members.groupBy("node").agg(F.sum("weight").alias("degree"))
    heads = members.join(degree, "node").groupBy("list").agg(F.max(F.struct("degree", "node"))["node"].alias("head"))
    rays = members.join(heads, "list").where("node <> head")
    stars = scratch.save(rays.groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg(F.sum("weight").alias("weight")), "stars")
    wanted = scratch.save(stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct(), "wanted")
    light = found.where(F.col("kind") == SLOT).join(wanted, "node", "left_semi").select(F.col("node").alias("id"), "n", "bits").dropDuplicates(["id"])
    light = scratch.save(light, "light", bucket_by="id")

    # stars: bitmaps first, then one exact test a document, then those still apart
    x, y = light.toDF("a", "na", "xa"), light.toDF("b", "nb", "xb")
    likely = stars.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_bounded(percent), _PAIR)
    likely = scratch.save(likely, "likely")
    scratch.release()
    sets = _sets_of(texts, own, likely, k)
    sets = scratch.save(sets, "sets", bucket_by="id")
    scratch.release()
    first = likely.join(stars, ["a", "b"]).groupBy("b").agg(F.max_by("a", F.struct("weight", "a")).alias("a")).select("a", "b")
    first = scratch.save(first, "first")
    links = scratch.save(_verified(first, sets, percent), "links0")
    comp = components(links, scratch, "comp0")
    scratch.release()
    rest = _across_components(likely.join(first, ["a", "b"], "left_anti"), comp)
    more = scratch.save(_verified(rest, sets, percent), "links1")
    if not more.isEmpty():
        comp = _joined(comp, more, scratch, "comp1")
    scratch.drop("sets", "likely", "first")  # not needed any more, and the largest tables
    scratch.release()

    # Lists whose members are still apart.  In short ones each member meets those of other components.
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    placed, apart = _apart(members, comp)
    rows = placed.join(apart.where(F.col("size") <= SHORT_LIST).select("list"), "list").join(light, F.col("node") == F.col("id")).select("list", "node", "comp", "n", "bits")
    pairs = scratch.save(rows.groupBy("list").applyInArrow(_across(percent), _PAIR).distinct().join(tested, ["a", "b"], "left_anti"), "pairs1")
    if not pairs.isEmpty():
        few = scratch.save(_sets_of(texts, own, pairs, k), "sets1", bucket_by="id")
        found_now = scratch.save(_verified(pairs, few, percent), "links2")
        scratch.drop("sets1")
        if not found_now.isEmpty():
            comp = _joined(comp, found_now, scratch, "comp2")
    scratch.release()

    # In longer ones a set first meets its neighbours among those with the same rare shingle, then each
    # one outside its list's largest component all that may be linked.
    moved = True
    for step, meet in ((2, _in_chains), (3, _by_rarest)):
        if moved:  # else the rows of the step before hold, with their components
            placed, apart = _apart(members, comp)
            nodes = placed.join(apart.where(F.col("size") > SHORT_LIST), "list").groupBy("node").agg(F.first("comp").alias("comp"), F.bool_or(F.col("comp") != F.col("largest")).alias("rest"))
            nodes = scratch.save(nodes, f"apart{step}")
            if nodes.isEmpty():
                break
            if step == 2:
                open_sets = scratch.save(_sets_of(texts, own, nodes.select(F.col("node").alias("a"), F.col("node").alias("b")), k), "sets2", bucket_by="id")
                counts = _shingle_counts(open_sets)
            # components meet the sets, a row each, never the many rows of their shingles
            scratch.drop("rare2")
            rare = scratch.save(_rare_rows(open_sets, nodes, percent, counts), f"rare{step}")
            moved = False
        pairs = scratch.save(meet(rare, percent), f"pairs{step}")
        if pairs.isEmpty():
            continue
        bounded = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_bounded(percent), _PAIR)
        found_now = scratch.save(_verified(bounded, open_sets, percent), f"links{step + 1}")
        if not found_now.isEmpty():
            comp = _joined(comp, found_now, scratch, f"comp{step + 1}")
            moved = True
        scratch.release()

    # the least doc_id of each component, by node; nodes of many copies are met in salted parts
    nodes = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(comp, F.col("node") == F.col("id"), "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    nodes = scratch.save(nodes, "nodes")
    joined = nodes.join(comp.select(F.col("id").alias("node")), "node", "left_semi")
    least = joined.groupBy("comp").agg(F.min("least").alias("head"))
    heads = scratch.save(c.salted_join(nodes, least, ["comp"], ["node"], "left").select("node", "comp", F.coalesce("head", "least").alias("head")), "heads")
    out = c.salted_join(own, heads, ["node"], ["doc_id"], "left").select("doc_id", "row", "n", "comp", "head")
    scratch.drop_tables()
    scratch.drop("members", "stars", "wanted", "light", "sets", "sets1", "sets2", "rare2", "rare3", "apart2", "apart3", "likely", "first", "pairs1", "pairs2", "pairs3", "links0", "links1", "links2", "links3", "links4", "nodes")
    scratch.release()
    return out


def _apart(members: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(list, node, comp) of all members, and (list, largest, size) of the lists of three and more that lie in several components."""
    placed = members.join(comp, F.col("node") == F.col("id"), "left").select("list", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = placed.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("n"))
    lists = sizes.groupBy("list").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"))
    return placed, lists.where("parts > 1 and size > 2").select("list", "largest", "size")


def _shingle_counts(sets: DataFrame):
    """How many shingles of the sets fall in each of the most frequent buckets, as a broadcast table of all buckets."""
    rows = sets.select("shingles").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    often = rows.where("n > 1").orderBy(F.desc("n"), "bucket").limit(COUNTED).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int32)
    counts[often.column("bucket").to_numpy()] = np.minimum(often.column("n").to_numpy(), (1 << 31) - 1)
    return sets.sparkSession.sparkContext.broadcast(counts)


def _rare_rows(sets: DataFrame, nodes: DataFrame, percent: int, counts) -> DataFrame:
    """A row for each of the rarest shingles of each of the nodes."""
    own = nodes.join(sets, F.col("node") == F.col("id")).select("node", "comp", "rest", "shingles")
    return own.mapInArrow(_rarest(percent, counts), _RARE)


def _in_chains(rare: DataFrame, percent: int) -> DataFrame:
    """As many pairs as there are held shingles at most."""
    n = int(rare.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["gram", "n", "node"]
    rows = rare.where("held").repartitionByRange(n, *order).sortWithinPartitions(*order)
    return rows.select("gram", "node", "comp").mapInArrow(_neighbours, _PAIR).distinct()


def _by_rarest(rare: DataFrame, percent: int) -> DataFrame:
    """All pairs across components with a common shingle after which enough follow in both."""
    held = rare.where("held").select("gram", *(F.col(x).alias(f"{x}_2") for x in ("node", "comp", "rest", "n", "place")))
    need = percent * (F.col("n") + F.col("n_2"))
    fits = (F.col("place") * (100 + percent) >= need) & (F.col("place_2") * (100 + percent) >= need) & (100 * F.col("n_2") >= percent * F.col("n"))
    fits &= (F.col("comp") != F.col("comp_2")) & ((F.col("n") > F.col("n_2")) | ((F.col("n") == F.col("n_2")) & (F.col("node") > F.col("node_2"))))
    # plain joins, of which Spark splits what is skewed: a salted one would send the held rows SALTS times
    met = [rare.where(x).join(held.where(y).drop("rest_2"), "gram").where(fits) for x, y in (("rest", "true"), ("not rest", "rest_2"))]
    pairs = met[0].unionByName(met[1])
    return pairs.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()


def _sets_of(texts: DataFrame, own: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The set of each node of the pairs, once, from the text of its least document.

    Rows without a doc_id can't be fetched by it: they bring their sets along.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = own.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    chosen = chosen.where("doc_id is not null").select("doc_id").distinct()
    rows = texts.join(chosen, "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))
    sets = rows.mapInArrow(_set_rows(k), "id long, shingles binary")
    return sets.join(wanted, F.col("id") == F.col("node"), "left_semi").dropDuplicates(["id"])


def keep_first(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each class, with its own columns: the least doc_id, then the least hash of a text.

    Rows without a doc_id come last in a class, but one stays where there are no others; of equal
    rows (id and text) one stays; rows with an empty set all stay.
    """
    found = _placed(docs, k, percent).withColumn("doc_id", F.coalesce("doc_id", F.lit(c.LAST)))
    first = found.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.*")
    scratch = c.Scratch(docs.sparkSession, "firsts")
    kept = scratch.save(first.unionByName(found.where("comp is null").select("doc_id", "row").distinct()).toDF("__doc", "__row"), "kept")
    again = found.where("comp is not null").groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row").toDF("__doc", "__row")
    again = scratch.save(again, "again")
    keys = ["__doc", "__row"]
    rows = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(c.LAST))).withColumn("__row", F.xxhash64("text"))
    rows = rows.join(kept, keys, "left_semi")
    if not again.isEmpty():  # repeated rows are rare, and only theirs are met by key
        rows = rows.join(again, keys, "left_anti").unionByName(rows.join(again, keys, "left_semi").dropDuplicates(keys))
    return rows.select(*(F.col(f"`{x}`") for x in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(c.table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM doc, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i) s WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT doc.doc_id, coalesce(max(n), 0) AS n_shingles, least(doc.doc_id, coalesce(min(reach.b), doc.doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN reach ON reach.a = doc.doc_id GROUP BY doc.doc_id
"""
