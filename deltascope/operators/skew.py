"""Joins on keys of which a few may hold a large part of all rows, and of sides that grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks over which the rows of one key are dealt.
SALTS = 8


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are shuffled and merged.

    Files of few bytes may hold many rows, so a size limit alone lets such a side through the driver, once a join.
    """
    return side.hint("merge")


def salted(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` on ``keys``; the rows of a key are dealt over SALTS tasks by ``spread``."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return many.withColumn("salt__", salt).join(one.withColumn("salt__", parts), [*keys, "salt__"], how).drop("salt__")
