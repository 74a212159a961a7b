"""Byte-level BPE: every distinct word of the corpus is encoded once.

Texts are cut into pre-tokens, grouped in blocks of documents.  A block keeps
the sequence of its pre-tokens as indices into its own distinct words
(positions), and sends those words, packed by hash bucket, into one global
shuffle.  There each distinct word is encoded once by its merges; the ids go
back to the blocks that asked, and a block reassembles its documents by
position.  Decoding joins ids with the token-byte table.

Cases: a null or empty text has no ids and decodes to nothing; a pre-token of
any length is encoded whole; repeated rows give repeated results; an empty table gives an empty result.

Scale: both exchanges carry distinct words per block, not occurrences, so a
word that is everywhere costs one entry a block.  The only broadcast is the
vocabulary, whose size the file fixes.  A block is one row of about
``BLOCK_BYTES`` of text, so memory doesn't grow with the input.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm import _common as c

BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket of the shuffle of distinct words.
BUCKET_BYTES = 4 << 20
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


# ---------------------------------------------------------------- pre-tokens


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point: letter (L*), number (N*), white space or other."""
    kinds = np.zeros(0x110000, np.uint8)
    for x in range(0x110000):
        major = unicodedata.category(chr(x))[0]
        if major == "L":
            kinds[x] = LETTER
        elif major == "N":
            kinds[x] = NUMBER
    kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


def pretokens(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each pre-token, and the index of each row's first one.

    ``points`` are the code points of the rows, ``edges`` the rows' bounds.  The
    cuts are those of the pattern of public_tokenizers: contractions, runs of
    letters, numbers or other characters with at most one space before, and
    white space whose last character stays with what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(edges), np.int64)
    kind = char_classes()[points]
    head = np.zeros(n + 1, bool)  # first character of a row
    head[edges] = True
    head = head[:n]
    prev = np.r_[np.uint8(9), kind[:-1]]
    new_run = head | (kind != prev)
    tail = np.r_[head[1:], True]
    next_kind = np.r_[kind[1:], np.uint8(9)]
    space = kind == SPACE
    last_space = space & ~tail & (next_kind != SPACE)  # white space right before something else
    joins = last_space & (points == 32)
    start = new_run.copy()
    start |= last_space  # the last white space of a run stands alone or joins what follows
    after_join = np.r_[False, joins[:-1]] & ~head
    start[after_join] = False
    # contractions: an apostrophe alone at a match's start, then s t d m, re ve ll
    quote = np.flatnonzero((points == 39) & new_run & ~after_join & (next_kind == LETTER) & ~tail)
    if len(quote):
        padded = np.r_[points, np.uint32(0), np.uint32(0)]
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        two &= ~np.r_[tail, True, True][quote + 1]
        size = np.where(one, 1, np.where(two, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = quote + 1 + size
        inside = rest < n
        rest = rest[inside]
        start[rest[(kind[rest] == LETTER) & ~head[rest]]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, edges)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 rows, and the rows' bounds among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return points, heads[offsets]


# ---------------------------------------------------------------- merges


class Vocabulary:
    """The ranks of a tiktoken file, named by a digest of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.name = hashlib.sha256(repr(sorted(ranks.items(), key=lambda x: x[1])).encode()).hexdigest()


_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def word_encoder(vocabulary: Vocabulary) -> Callable[[str], list[int]]:
    """Ids of one pre-token; the pattern takes it whole, so only its merges are made."""
    if vocabulary.name not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        _ENCODERS.clear()
        _ENCODERS[vocabulary.name] = tiktoken.Encoding(vocabulary.name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}).encode_ordinary
    return _ENCODERS[vocabulary.name]


# ---------------------------------------------------------------- stages

_CODEC = "zstd"


def _pack(raw: bytes) -> bytes:
    return pa.Codec(_CODEC, 1).compress(raw, asbytes=True)


def _unpack(packed: bytes, size: int) -> bytes:
    return pa.Codec(_CODEC).decompress(packed, size, asbytes=True) if size else b""


SEQUENCES, WORDS = 0, 1
_BLOCK_SCHEMA = "key string, block string, kind int, bucket int, ids array<long>, counts array<long>, size long, packed binary"


def _block_rows(block: str, ids: list[int], starts: list[np.ndarray], texts: list[tuple], buckets: int) -> Iterator[dict]:
    one = np.concatenate([t[0] for t in texts])
    _, first, back = np.unique(one, return_index=True, return_inverse=True)
    two = np.concatenate([t[1] for t in texts])
    if not np.array_equal(two[first][back], two):  # two words share a 64-bit hash: tell them apart by both
        _, first, back = np.unique(np.stack([one, two]), axis=1, return_index=True, return_inverse=True)
    data = np.concatenate([t[2] for t in texts])
    shift = np.cumsum([0, *(len(t[2]) for t in texts)])
    begin = np.concatenate([t[3] + x for t, x in zip(texts, shift[:-1], strict=True)])[first]
    length = np.concatenate([t[4] - t[3] for t in texts])[first]
    bucket = (one[first] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sequence = place[back].astype(np.uint32 if len(first) > 65536 else np.uint16)
    counts = np.concatenate(starts)
    raw = sequence.tobytes()
    yield {"key": block, "block": block, "kind": SEQUENCES, "bucket": -1, "ids": ids, "counts": counts, "size": len(raw), "packed": _pack(raw)}
    begin, length, bucket = begin[order], length[order], bucket[order]
    to = np.r_[0, np.cumsum(length)]
    spelt = data[np.repeat(begin - to[:-1], length) + np.arange(to[-1])]
    bounds = [*np.flatnonzero(np.r_[True, np.diff(bucket) != 0]), len(order)] if len(order) else []  # none in a block of empty texts
    for lo, hi in zip(bounds, bounds[1:]):
        blob = spelt[to[lo] : to[hi]].tobytes()
        yield {"key": f"bucket {bucket[lo]}", "block": block, "kind": WORDS, "bucket": int(bucket[lo]), "ids": None, "counts": length[lo:hi], "size": len(blob), "packed": _pack(blob)}


def _cut(buckets: int):
    """Documents to blocks: one row of sequences, and a row of words for each bucket.

    A block is named by its rows, its task and its place there: equal blocks of two
    tasks stay apart, and a task that runs again gives the same names to the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("block", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("size", pa.int64()), ("packed", pa.binary())])
        one_values, two_values = c.byte_values(seed=21), c.byte_values(seed=22)
        ids: list[int] = []
        counts: list[np.ndarray] = []
        texts: list[tuple] = []
        held = blocks = 0
        part = TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, counts, texts, held, blocks
            if ids:
                content = hashlib.md5(repr(ids).encode())
                for t in texts:
                    content.update(t[2])
                name = f"{content.hexdigest()}-{part}-{blocks}"
                blocks += 1
                rows = list(_block_rows(name, ids, counts, texts, buckets))
                yield pa.RecordBatch.from_pylist(rows, schema)
            ids, counts, texts, held = [], [], [], 0

        for rows, data, offsets in c.text_slices(batches):
            points, edges = code_points(data, offsets)
            at, first = pretokens(points, edges)
            heads = np.flatnonzero((data & 0xC0) != 0x80)
            begin = heads[at]
            end = np.r_[begin[1:], len(data)] if len(begin) else begin
            texts.append((c.span_hashes(one_values[data], begin, end), c.span_hashes(two_values[data], begin, end), data, begin, end))
            counts.append(np.diff(first))
            ids += rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
            held += len(data)
            if held >= BLOCK_BYTES or len(ids) >= 100_000:
                yield from flush()
        yield from flush()

    return run


def _encoded(vocabulary: Broadcast):
    """For each bucket: every distinct word is encoded once; ids go back to its blocks."""

    def run(key: tuple, words: pa.Table) -> pa.Table:
        encode_word = word_encoder(vocabulary.value)
        known: dict[bytes, bytes] = {}
        out = []
        for row in words.filter(pc.equal(words.column("kind"), WORDS)).to_pylist():
            blob, at, ids = _unpack(row["packed"], row["size"]), 0, []
            for n in row["counts"]:
                word = blob[at : at + n]
                at += n
                got = known.get(word)
                if got is None:
                    got = known[word] = array("I", encode_word(word.decode())).tobytes()
                ids.append(got)
            raw = b"".join(ids)
            out.append({"key": row["block"], "bucket": row["bucket"], "lens": [len(x) >> 2 for x in ids], "size": len(raw), "packed": _pack(raw)})
        return pa.Table.from_pylist(out, pa.schema([("key", pa.string()), ("bucket", pa.int32()), ("lens", pa.list_(pa.int64())), ("size", pa.int64()), ("packed", pa.binary())]))

    return run


def _assembled(vocabulary: Broadcast, outputs: tuple[str, ...]):
    def run(key: tuple, sequences: pa.Table, words: pa.Table) -> pa.Table:
        by_id, names = _token_tables(vocabulary)
        lens, flat = [], []
        for n, size, packed in sorted_by_bucket(words):
            lens.append(n)
            flat += np.frombuffer(_unpack(packed, size), np.uint32).tolist()
        lens_all = np.concatenate(lens) if lens else np.zeros(0, np.int64)
        bounds = [0, *np.cumsum(lens_all).tolist()]
        shown, tokens = [names[i] for i in flat], [by_id[i] for i in flat]
        said = [" ".join(shown[a:b]) for a, b in zip(bounds, bounds[1:])]
        spelt = [b"".join(tokens[a:b]) for a, b in zip(bounds, bounds[1:])]
        cols: dict[str, list] = {k: [] for k in ("doc_id", *outputs)}
        for row in sequences.filter(pc.equal(sequences.column("kind"), SEQUENCES)).select(["ids", "counts", "size", "packed"]).to_pylist():
            raw = _unpack(row["packed"], row["size"])
            total = sum(row["counts"])
            seq = np.frombuffer(raw, np.uint16 if total and len(raw) == 2 * total else np.uint32)
            at = 0
            for doc, n in zip(row["ids"], row["counts"], strict=True):
                own = seq[at : at + n]
                at += n
                listed = own.tolist()
                cols["doc_id"].append(doc)
                if "n_tokens" in cols:
                    cols["n_tokens"].append(int(lens_all[own].sum()))
                if "ids_sha256" in cols:
                    cols["ids_sha256"].append(hashlib.sha256(" ".join([said[i] for i in listed]).encode()).hexdigest())
                if "decoded_sha256" in cols:
                    cols["decoded_sha256"].append(hashlib.sha256(b"".join([spelt[i] for i in listed])).hexdigest())
                if "ids" in cols:
                    cols["ids"].append([int(x) for i in listed for x in flat[bounds[i] : bounds[i + 1]]])
                if "decoded" in cols:
                    cols["decoded"].append(b"".join([spelt[i] for i in listed]))
        return pa.table({k: pa.array(v, _ARROW[k]) for k, v in cols.items()})

    return run


def sorted_by_bucket(words: pa.Table) -> list[tuple]:
    bucket = words.column("bucket").to_pylist()
    lens, size, packed = (words.column(x) for x in ("lens", "size", "packed"))
    return [(lens[i].values.to_numpy(), size[i].as_py(), packed[i].as_py()) for i in sorted(range(len(bucket)), key=bucket.__getitem__)]


_TABLES: dict[str, tuple[list[bytes], list[str]]] = {}


def _token_tables(vocabulary: Broadcast) -> tuple[list[bytes], list[str]]:
    """Bytes and decimal form of each id; a worker keeps the table of the last vocabulary."""
    key, ranks = vocabulary.value.name, vocabulary.value.ranks
    if key not in _TABLES:
        _TABLES.clear()
        size = max(ranks.values()) + 1
        spelt = [b""] * size
        for token, i in ranks.items():
            spelt[i] = token
        _TABLES[key] = spelt, [str(i) for i in range(size)]
    return _TABLES[key]


_SQL_TYPE = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "binary"}
_ARROW = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}


def encode(docs: DataFrame, vocabulary_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the wanted ``outputs``: n_tokens, ids, decoded, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, total // BUCKET_BYTES)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(load_ranks(vocabulary_path)))
    # Both groupings have one key column over one child, so Spark makes a single exchange of them.
    rows = source.mapInArrow(_cut(int(buckets)), _BLOCK_SCHEMA)
    ids = rows.groupBy("key").applyInArrow(_encoded(vocabulary), "key string, bucket int, lens array<long>, size long, packed binary")
    schema = ", ".join(["doc_id long", *(f"{k} {_SQL_TYPE[k]}" for k in outputs)])
    return rows.groupBy("key").cogroup(ids.groupBy("key")).applyInArrow(_assembled(vocabulary, tuple(outputs)), schema)


def digests(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Digest columns of encoding and decoding with the public 50k vocabulary."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode(docs, vocabulary_path, ("n_tokens", "ids_sha256", "decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(c.table(spark, sf_dir, "documents"))
