"""Literal search by an index of grams.

A gram is GRAM bytes of a lower-cased text.  The index is a table of grams with the files that have them,
a row for each gram of a piece of the texts, in buckets by gram and sorted by it inside.  A search reads
only the buckets of its grams, takes the files that have all of them, and looks for the literal in their texts alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltascope.operators import diff
from deltascope.operators.matching import GRAM
from deltascope.sources.tables import delete, shared_path

#: Bytes of text whose grams are gathered at once; a longer text is several pieces.
PIECE_BYTES = 4 << 20


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of each piece of the texts (file, bytes), and their files."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        _, at, raw = texts.buffers()
        if raw is None or not len(texts):
            continue
        edge, data = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(raw, np.uint8)
        for begin in range(int(edge[0]), int(edge[-1]) - GRAM + 1, PIECE_BYTES):
            n = min(PIECE_BYTES, int(edge[-1]) - GRAM + 1 - begin)
            row = np.repeat(np.arange(len(texts)), np.diff(np.clip(edge, begin, begin + n)))
            inside = np.arange(begin + GRAM, begin + GRAM + n) <= edge[row + 1]
            key = row.astype(np.uint64)
            for i in range(GRAM):
                key |= data[begin + i : begin + i + n].astype(np.uint64) << np.uint64(32 + 8 * (GRAM - 1 - i))
            key = np.sort(key[inside])  # np.unique hashes, which takes many times as long
            key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
            gram = (key >> np.uint64(32)).astype(np.int32)
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
            files = batch.column(0).take(pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.ListArray.from_arrays(pa.array(np.r_[first, len(gram)], pa.int32()), files)], names=["gram", "files"])


class Index:
    """Postings of ``files`` (file, text), in any case.  Usable in a ``with`` block, at whose end its table goes."""

    def __init__(self, files: DataFrame, buckets: int = 64):
        self.files, self.spark = files, files.sparkSession
        self.table, self.path = f"grams_{uuid.uuid4().hex}", shared_path(self.spark, "grams")
        schema = T.StructType([T.StructField("gram", T.IntegerType()), T.StructField("files", T.ArrayType(files.schema["file"].dataType))])
        rows = files.select("file", F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text")).mapInArrow(_postings, schema)
        # each task writes its own part of a bucket, so a gram that all files have is in no single task
        rows.write.bucketBy(buckets, "gram").sortBy("gram").option("path", self.path).format("parquet").saveAsTable(self.table)

    def __enter__(self) -> Index:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, self.path)

    def candidates(self, pattern: str) -> DataFrame | None:
        """(file) of the files that have all grams of the pattern; None if it is too short to have any."""
        low = pattern.lower().encode()
        wanted = sorted({int.from_bytes(low[i : i + GRAM], "big") for i in range(len(low) - GRAM + 1)})
        if not wanted:
            return None
        hits = self.spark.table(self.table).where(F.col("gram").isin(*wanted)).select("gram", F.explode("files").alias("file"))
        return hits.groupBy("file").agg(F.collect_set("gram").alias("grams")).where(F.size("grams") == len(wanted)).select("file")

    def grep(self, pattern: str, context: int = 0, case_sensitive: bool = False) -> DataFrame:
        """The hits of ``diff.grep``; texts of other files aren't searched."""
        likely = self.candidates(pattern)
        rows = self.files if likely is None else self.files.join(likely, "file", "left_semi")
        return diff.grep(rows, pattern, context, case_sensitive)


def index(files: DataFrame, buckets: int = 64) -> Index:
    return Index(files, buckets)
