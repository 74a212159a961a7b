"""Hard negatives by distributed radix selection.

Scores are integer inner products of a query set (anchors) with all rows.  For each window
(an anchor and a score interval) the rows inside it are ordered by a key: how far the score
lies below the window's top, then the row's id.  To find the first k rows, every task counts
its rows by the highest digit of the key; the summed histogram tells in which bucket the
kth row lies; the next round counts inside that bucket by the next digit, first of the
score, then of the id.  A window is done when what lies up to its bucket is few rows.  Only
then are rows gathered: those before the bucket's end.

The first selection has one window an anchor over its own label (positives), the second one
window for each anchor and positive over the other labels (negatives).

Cases: rows with a null vec_id, a null label, a null vector or a null or non-finite component
take no part.  Components are held at +-2**23 after scaling, and a shorter vector goes on with
zeros.  "Other" rows are those with another vec_id; rows that repeat a vec_id count as rows,
but one anchor stands for each id (the least label, then the least vector).  Ties in score go
by vec_id, among rows equal in both any one stands for the other.  An anchor without another
row of its label, or a window without rows, gives nothing; an empty table gives an empty result.

Scale: vectors are packed once into blocks, read again by each pass and never shuffled; anchors
go to the tasks ``ANCHORS`` at a time, so what is broadcast has a fixed bound whatever the
table's size.  The shuffles carry counts by (window, digit), the gather at most ``FEW`` rows a
window and task.  A vector that a third of all rows share is ties: its rows are counted by the
digits of their ids, never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltascope.llm import _common as c

SCALE = 256
#: Components are held here, so that sums over up to 128 of them are exact as doubles.
MOST = 1 << 23
#: Rows of one block, and anchors of one pass.
BLOCK_ROWS = 4096
ANCHORS = 2048
#: Anchors that are scored at once.
SCORED = 128
#: Bits of one digit.
DIGIT = 8
#: A window with this many rows up to its bucket's end is gathered.
FEW = 64
_BLOCKS = "n int, dims int, ids binary, labels binary, vectors binary"


@dataclass
class Windows:
    """Open searches for the first ``k`` rows, ranked by (top - score, id)."""

    anchor: np.ndarray  # index into the chunk's anchors
    top: np.ndarray  # highest score inside
    low: np.ndarray  # lowest score inside
    same: bool  # rows of the anchor's label, or of others
    k: int
    ids: tuple[int, int]  # least and greatest id
    shift: np.ndarray = field(init=False)  # bits of the key below the known prefix
    prefix: np.ndarray = field(init=False)  # the key's known highest bits
    before: np.ndarray = field(init=False)  # rows before the prefix's bucket
    closed: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.anchor)
        self.id_bits = int(self.ids[1] - self.ids[0]).bit_length()
        wide = np.array([int(x).bit_length() for x in np.maximum(self.top - self.low, 0)], np.int64)
        self.shift = wide + self.id_bits
        self.prefix = [0] * n  # keys can have more than 64 bits
        self.before = np.zeros(n, np.int64)
        self.closed = self.top < self.low

    def digits(self, w: int) -> tuple[int, int]:
        """Bits below the next digit, and the digit's own; a digit never spans score and id."""
        shift = int(self.shift[w])
        size = min(DIGIT, shift - self.id_bits if shift > self.id_bits else shift)
        return shift - size, size


# ---------------------------------------------------------------- blocks


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to blocks of ids, labels and int32 vectors of one width."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        held.clear()
        for at in range(0, rows.num_rows, BLOCK_ROWS):
            part = rows.slice(at, BLOCK_ROWS).combine_chunks()
            lists = part.column("vector").combine_chunks()
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            dims = int(sizes.max())
            matrix = np.zeros((len(sizes), dims), np.int32)
            matrix[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            row = {"n": len(sizes), "dims": dims, "ids": part.column("vec_id").to_numpy().astype(np.int64).tobytes(), "labels": part.column("label").to_numpy().astype(np.int64).tobytes(), "vectors": matrix.tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())]))

    count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= BLOCK_ROWS:
            yield from flush()
            count = 0
    if held:
        yield from flush()


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors of each block, the vectors ``width`` wide."""
    for batch in batches:
        for row in batch.to_pylist():
            matrix = np.frombuffer(row["vectors"], np.int32).reshape(row["n"], row["dims"])
            if row["dims"] < width:
                matrix = np.pad(matrix, ((0, 0), (0, width - row["dims"])))
            yield np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), matrix


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles where no sum can reach 2**53, else as integers."""
    width = max(anchors.shape[1], 1)
    most = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows.astype(np.int64)).max(initial=0)) * width
    if most < 1 << 53:
        return np.rint(anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors.astype(np.int64) @ rows.T.astype(np.int64)


# ---------------------------------------------------------------- one pass


def _inside(w: Windows, i: int, score: np.ndarray, ids: np.ndarray, floor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are in window ``i`` and its known bucket, and their next digit (``floor``: bits below it)."""
    below = w.top[i] - score
    at = np.flatnonzero((below >= 0) & (score >= w.low[i]))
    below = below[at]
    known = int(w.prefix[i])
    if floor >= w.id_bits:  # a digit of the score
        bits = floor - w.id_bits
        keep = (below >> (bits + size)) == known
        return at[keep], (below[keep] >> bits) & ((1 << size) - 1)
    idle = w.id_bits - floor - size  # bits of the id that are known
    keep = below == known >> idle
    at = at[keep]
    place = ids[at] - w.ids[0]
    keep = (place >> (floor + size)) == known & ((1 << idle) - 1)
    return at[keep], (place[keep] >> floor) & ((1 << size) - 1)


def _each(w: Windows, chunk, batches: Iterator[pa.RecordBatch], wanted: np.ndarray):
    """(window, ids, scores) of the rows that a window may hold, block by block."""
    a_ids, a_labels, a_vectors = chunk
    order = wanted[np.argsort(w.anchor[wanted], kind="stable")]
    used, first = np.unique(w.anchor[order], return_index=True)
    for ids, labels, vectors in _blocks(batches, a_vectors.shape[1]):
        ends = [*first[1:], len(order)]
        for lo in range(0, len(used), SCORED):
            got = scores(a_vectors[used[lo : lo + SCORED]], vectors)
            for a, x, y, row in zip(used[lo:], first[lo:], ends[lo:], got):  # noqa: B905  as many as were scored
                at = np.flatnonzero(((labels == a_labels[a]) == w.same) & (ids != a_ids[a]))
                for i in order[x:y]:
                    yield i, ids[at], row[at]


def _histogram(state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, w = state.value
        counts: dict[int, np.ndarray] = {}
        plan = {int(i): w.digits(int(i)) for i in np.flatnonzero(~w.closed)}
        for i, ids, score in _each(w, chunk, batches, np.flatnonzero(~w.closed)):
            floor, size = plan[int(i)]
            _, digit = _inside(w, i, score, ids, floor, size)
            if len(digit):
                n = np.bincount(digit, minlength=1 << size)
                counts[int(i)] = counts[int(i)] + n if int(i) in counts else n
        for i, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.record_batch({"w": pa.array(np.full(len(at), i), pa.int32()), "digit": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    return run


def _gathered(state):
    """The rows of each window before its bucket's end, at most as many a task as are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, w = state.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, ids, score in _each(w, chunk, batches, np.flatnonzero(w.top >= w.low)):
            shift, known, i = int(w.shift[i]), int(w.prefix[i]), int(i)
            below = w.top[i] - score
            inside = (below >= 0) & (score >= w.low[i])
            if shift >= w.id_bits:
                keep = inside & ((below >> (shift - w.id_bits)) <= known)
            else:
                edge, part = known >> (w.id_bits - shift), known & ((1 << (w.id_bits - shift)) - 1)
                keep = inside & ((below < edge) | ((below == edge) & (((ids - w.ids[0]) >> shift) <= part)))
            if not keep.any():
                continue
            ids, score = ids[keep], score[keep]
            if i in best:
                ids, score = np.r_[best[i][0], ids], np.r_[best[i][1], score]
            order = np.lexsort((ids, -score))[: w.k]
            best[i] = ids[order], score[order]
        for i, (ids, score) in best.items():
            yield pa.record_batch({"w": pa.array(np.full(len(ids), i), pa.int32()), "id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def select(blocks: DataFrame, chunk, w: Windows) -> DataFrame:
    """w, rank, id, score: the first ``k`` rows of each window."""
    spark = blocks.sparkSession
    while not w.closed.all():
        state = spark.sparkContext.broadcast((chunk, w))
        counts = blocks.mapInArrow(_histogram(state), "w int, digit int, n long").groupBy("w", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("w").orderBy("digit"))
        need = spark.createDataFrame([(int(i), int(w.k - w.before[i])) for i in np.flatnonzero(~w.closed)], "w int, need long")
        reached = counts.withColumn("upto", upto).join(F.broadcast(need), "w")  # at most k x ANCHORS short rows
        last = reached.groupBy("w").agg(F.max("upto").alias("total"), F.min(F.when(F.col("upto") >= F.col("need"), F.struct("digit", "upto", "n"))).alias("x"))
        found = {r.w: r for r in last.collect()}  # a row a window of the chunk
        state.destroy()
        for i in np.flatnonzero(~w.closed).tolist():
            r = found.get(i)
            floor, size = w.digits(i)
            if r is None or r.x is None:  # fewer rows than wanted: all of them
                w.prefix[i] = (w.prefix[i] << size) | ((1 << size) - 1)
                w.shift[i] = floor
                w.closed[i] = True
                continue
            w.prefix[i] = (w.prefix[i] << size) | r.x.digit
            w.shift[i] = floor
            upto = w.before[i] + r.x.upto
            w.before[i] = upto - r.x.n
            w.closed[i] = upto <= FEW or floor == 0
    state = spark.sparkContext.broadcast((chunk, w))
    rows = blocks.mapInArrow(_gathered(state), "w int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= w.k)


# ---------------------------------------------------------------- the operator


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (integers) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(v.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector"))


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least_pct: int = 80) -> DataFrame:
    """Hard negatives of ``anchors`` among ``rows`` (both vec_id, label, vector of integers).

    For each anchor and each of its first positives: the first other-label rows whose score
    lies between ``least_pct`` percent of the positive's and the positive's itself.
    """
    spark = rows.sparkSession
    scratch = c.Scratch(spark, "negatives")
    blocks = scratch.save(rows.mapInArrow(_packed, _BLOCKS), "blocks")
    one = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.*")
    queries = scratch.save(one.orderBy("vec_id"), "anchors")
    edges = rows.agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"), F.max(F.size("vector")).alias("width")).first()
    largest = _largest(blocks)
    last, chunks = None, 0
    while edges.lo is not None:
        part = queries if last is None else queries.where(F.col("vec_id") > last)
        some = part.orderBy("vec_id").limit(ANCHORS).collect()  # a chunk of the query set
        if not some:
            break
        last = some[-1].vec_id
        vectors = np.zeros((len(some), edges.width), np.int32)
        for i, r in enumerate(some):
            vectors[i, : len(r.vector)] = r.vector
        chunk = np.array([r.vec_id for r in some], np.int64), np.array([r.label for r in some], np.int64), vectors
        n = np.arange(len(some))
        reach = np.abs(vectors.astype(np.int64)).sum(1) * largest
        own = select(blocks, chunk, Windows(n, reach, -reach, True, positives, (edges.lo, edges.hi))).collect()  # k rows an anchor
        own.sort(key=lambda r: (r.w, r.rank))
        if not own:
            continue
        top = np.array([r.score for r in own], np.int64)
        found = select(blocks, chunk, Windows(np.array([r.w for r in own]), top, -((-least_pct * top) // 100), False, negatives, (edges.lo, edges.hi)))
        pairs = spark.createDataFrame([(i, some[r.w].vec_id, r.id, r.score) for i, r in enumerate(own)], "w int, anchor_id long, positive_id long, positive_score long")
        rows_out = found.join(F.broadcast(pairs), "w").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        scratch.save(rows_out, f"found/chunk{chunks}")
        chunks += 1
    scratch.drop("anchors", "blocks")
    return spark.read.schema(_RESULT).parquet(f"{scratch.base}/found/*") if chunks else spark.createDataFrame([], _RESULT)


def _largest(blocks: DataFrame) -> int:
    """The greatest component there is, from one number a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max((int(np.abs(v).max(initial=0)) for _, _, v in _blocks(batches, 0)), default=0)
        yield pa.record_batch({"most": pa.array([most], pa.int64())})

    return int(blocks.mapInArrow(run, "most long").agg(F.max("most")).first()[0] or 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(c.table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where("vec_id % 100 = 0"))


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE same) WHERE rn <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same WHERE 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
