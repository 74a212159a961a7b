"""Token counts with a digest cache.

The cache is a Parquet table of (tokenizer, digest, n_tokens) in shared storage, partitioned
by ``tokenizer``: the digest of a tokenizer file and its library's version.  ``digest`` is the
SHA-256 of a text's normalised content, the form in which the tokenizer itself reads it.
Contents are made distinct, those that the cache knows go, the rest is encoded once each and
appended; then every document joins the cache by its digest.

Cases: a null or empty text has 0 bytes and 0 tokens; a text of any length is encoded whole;
repeated rows and equal texts are rows of their own with equal counts; a row without an id is
counted too; an empty table gives an empty result; further columns are ignored.  Two runs that
append the same content at once leave two equal rows, which reading merges.

Scale: equal contents meet in their task first, so one copied text is a row a task; the texts
are shuffled once, then only digests.  Documents of one digest are dealt over several tasks.
A task that runs again writes the same rows.  Only the tokenizer file is broadcast.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm import _common as c
from deltascope.llm import byte_bpe

#: A document of more tokens is over the limit.
LIMIT = 1024
#: Distinct words whose counts a worker remembers; beyond it starts anew.
REMEMBERED = 200_000
#: Words that the library encodes at once: what it returns for each is far larger than a count.
AT_ONCE = 2000
_SCHEMA = "digest binary, n_tokens long"


# ---------------------------------------------------------------- tokenizers


class TokenizerFile:
    """A .json (tokenizers) or .model (sentencepiece) file, read on the driver and shipped whole."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.raw = file.read()
        self.kind = "pieces" if path.endswith(".model") else "json"
        library = __import__("sentencepiece" if self.kind == "pieces" else "tokenizers")
        self.version = hashlib.sha256(f"{library.__name__} {library.__version__} ".encode() + self.raw).hexdigest()

    def load(self):
        if self.kind == "pieces":
            import sentencepiece

            return sentencepiece.SentencePieceProcessor(model_proto=self.raw)
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.raw.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def as_is(self) -> bool:
        """Whether the tokenizer reads a text as it stands."""
        return self.kind == "json" and self.load().normalizer is None

    def byte_level(self) -> bool:
        """Whether texts fall into the words that ``byte_bpe.pretokens`` cuts."""
        import json

        form = json.loads(self.raw)["pre_tokenizer"] if self.as_is() else None
        return form is not None and form["type"] == "ByteLevel" and form["use_regex"] and not form["add_prefix_space"]


@lru_cache(2)
def _loaded(version: str, file: TokenizerFile):
    return file.load()


def _specials(tokenizer) -> list[str]:
    return sorted((x.content for x in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)


def normaliser(file: TokenizerFile) -> Callable[[str], str]:
    """What the tokenizer reads of a text: special strings as they are, the rest in its normal form."""
    import re

    tokenizer = file.load()
    if file.kind == "pieces":
        return tokenizer.normalize
    form, found = tokenizer.normalizer, _specials(tokenizer)
    cut = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None

    def run(text: str) -> str:
        parts = cut.split(text) if cut else [text]
        return "".join(f"\0{x}\0" if i % 2 else form.normalize_str(x) for i, x in enumerate(parts))

    return run


# ---------------------------------------------------------------- counting


def _whole(tokenizer, texts: list[str]) -> list[int]:
    if hasattr(tokenizer, "encode_batch"):
        return [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return [len(x) for x in tokenizer.encode(texts, num_threads=1)]


@lru_cache(1)
def unassigned() -> np.ndarray:
    """Code points without a category here; a library with newer tables may know them as letters."""
    return np.fromiter((unicodedata.category(chr(x)) == "Cn" for x in range(0x110000)), bool, 0x110000)


class WordCounts:
    """Tokens of whole texts as sums over their words; the library encodes each distinct word."""

    def __init__(self, tokenizer):
        self.tokenizer, self.known = tokenizer, {}
        self.values = c.byte_values(seed=21), c.byte_values(seed=22)

    def _of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [x for x in words if x not in self.known]
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            self.known.update(zip(some, _whole(self.tokenizer, [x.decode() for x in some]), strict=True))
        return np.array([self.known[x] for x in words], np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and whether it holds characters that Python's tables don't know."""
        points, edges = byte_bpe.code_points(data, offsets)
        at, first = byte_bpe.pretokens(points, edges)
        if not len(at):
            return np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, bool)
        strange = np.r_[0, np.cumsum(unassigned()[points])][edges]
        begin = np.flatnonzero((data & 0xC0) != 0x80)[at]
        end = np.r_[begin[1:], len(data)]
        one, two = (c.span_hashes(values[data], begin, end) for values in self.values)
        _, place, back = np.unique(one, return_index=True, return_inverse=True)
        if not np.array_equal(two[place][back], two):
            _, place, back = np.unique(np.stack([one, two]), axis=1, return_index=True, return_inverse=True)
        raw = data.tobytes()
        counts = self._of([raw[a:b] for a, b in zip(begin[place].tolist(), end[place].tolist(), strict=True)])
        sums = np.r_[0, np.cumsum(counts[back])]
        return sums[first[1:]] - sums[first[:-1]], np.diff(strange) > 0


_COUNTERS: dict[str, WordCounts] = {}


def _counted(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark shares out the cores
        file: TokenizerFile = shared.value
        tokenizer = _loaded(file.version, file)
        by_words = file.byte_level()
        specials = [x.encode() for x in _specials(tokenizer)] if by_words else []
        if by_words and file.version not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[file.version] = WordCounts(tokenizer)
        for rows, data, offsets in c.text_slices(batches):
            if by_words:
                n, odd = _COUNTERS[file.version](data, offsets)
                raw = data.tobytes()
                for x in specials:  # the library cuts texts at special strings first
                    if x in raw:
                        odd |= [x in raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                at = np.flatnonzero(odd)
                n[at] = _whole(tokenizer, [raw[offsets[i] : offsets[i + 1]].decode() for i in at])
            else:
                n = np.array(_whole(tokenizer, [x or "" for x in rows.column("text").to_pylist()]), np.int64)
            yield pa.record_batch({"digest": rows.column("digest"), "n_tokens": pa.array(n, pa.int64())})

    return run


def _digested(docs: DataFrame, file: TokenizerFile, shared: Broadcast) -> DataFrame:
    """doc_id, n_bytes, digest and text of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    if file.as_is():
        return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = normaliser(shared.value)
        for part, _, _ in c.text_slices(batches):
            digests = [hashlib.sha256(form(x).encode()).digest() for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests, pa.binary())], [*part.schema.names, "digest"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, text string, digest binary")


# ---------------------------------------------------------------- the cache


class Cache:
    """Stored counts of one tokenizer version below ``path`` (shared storage)."""

    def __init__(self, spark: SparkSession, path: str, version: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/tokenizer={version}"

    def read(self) -> DataFrame:
        """digest, n_tokens: a row for each content that was counted."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(self.path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; new contents are added to the cache."""
    spark = docs.sparkSession
    file = TokenizerFile(tokenizer_path)
    shared = spark.sparkContext.broadcast(file)
    cache = Cache(spark, cache_path, file.version)
    rows = _digested(docs, file, shared)
    misses = rows.groupBy("digest").agg(F.first("text").alias("text")).join(cache.read(), "digest", "left_anti")
    cache.append(misses.mapInArrow(_counted(shared), _SCHEMA))
    found = c.salted_join(rows.drop("text"), cache.read(), ["digest"], ["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the public 50k vocabulary; each call starts a cache of its own, so that it does its whole work."""
    import public_tokenizers

    cache = c.Scratch(spark, "token-counts").base
    return count_tokens(c.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
