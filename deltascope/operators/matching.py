"""Joins on ends, ranges and parts of texts, with equi keys instead of comparing all pairs.

Each gives the pairs of distinct values that meet; rows join their own values afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.operators.skew import salted

GRAM = 3


# ---------------------------------------------------------------- ends


def _lengths(values: DataFrame, column: str) -> list[int]:
    """The lengths that occur: as many as the longest value has characters, at most."""
    return sorted(r[0] for r in values.select(F.length(column)).distinct().collect() if r[0])


def _having(long: DataFrame, short: DataFrame, keys: list[str], a: str, b: str, part) -> DataFrame:
    """(keys, a, b) where ``part`` of a, cut to the length of b, is b."""
    lengths = _lengths(short, b)
    cuts = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length(a))
    ends = long.select(*keys, a, F.explode(F.transform(cuts, lambda n: part(F.col(a), n))).alias(b))
    return salted(ends, short, [*keys, b], [a]).select(*keys, a, b)


def _meet(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, part) -> DataFrame:
    one, other = (df.select(*keys, x).where(F.coalesce(x, F.lit("")) != "").distinct() for df, x in ((left, a), (right, b)))
    return _having(one, other, keys, a, b, part).unionByName(_having(other, one, keys, b, a, part).select(*keys, a, b)).distinct()


def ends_meet(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Distinct (keys, a, b) where one of two texts is the end of the other; empty ones never."""
    return _meet(left, right, keys, a, b, lambda x, n: F.right(x, n))


def starts_meet(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Distinct (keys, a, b) where one of two texts is the start of the other; empty ones never."""
    return _meet(left, right, keys, a, b, lambda x, n: F.left(x, n))


# ---------------------------------------------------------------- ranges

#: Levels of the halving of the number line; places are below 2 to this power.
LEVELS = 40


def halves(low: Column, high: Column) -> Column:
    """The fewest aligned spans, as (level, nth of the level), that together are low .. high (not negative)."""
    low, end = low.cast("long"), high.cast("long") + 1

    def spans(level: Column) -> Column:
        size = F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2.0), level).cast("long")
        first, last = F.floor((low + size - 1) / size).cast("long"), F.floor(end / size).cast("long")
        inside = first < last
        return F.array(
            F.when(inside & (first % 2 == 1), F.struct(level.cast("int").alias("level"), first.alias("nth"))),
            F.when(inside & (last % 2 == 1), F.struct(level.cast("int").alias("level"), (last - 1).alias("nth"))),
        )

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), spans)), lambda x: x.isNotNull())


def points_in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    """Rows of ``points`` joined with the rows of ``ranges`` (of equal keys) that hold their place.

    A range is a few aligned spans, a place has one span a level, and both meet on equal
    spans, each pair once; so a long list in one file costs no more than what truly meets.
    """
    spans = ranges.where(F.col(low) <= F.col(high)).withColumn("span__", F.explode(halves(F.greatest(F.col(low), F.lit(0)), F.col(high))))
    levels = sorted(r[0] for r in spans.select("span__.level").distinct().collect())  # LEVELS at most
    here = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.shiftright(F.col(at).cast("long"), n).alias("nth")) for n in levels)).cast("array<struct<level:int,nth:bigint>>"))
    placed = points.where(F.col(at) >= 0).withColumn("span__", here)
    return placed.join(spans, [*keys, "span__"]).drop("span__")


def ranges_meet(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Rows of both whose ranges (low, high) have a place in common, each pair once.

    Either the right one begins inside the left one, or the left one begins inside the right one, after its begin.
    """
    right_in_left = points_in_ranges(right, left, keys, b[0], *a)
    after = right.withColumn("after__", F.col(b[0]) + 1)
    left_in_right = points_in_ranges(left, after, keys, a[0], "after__", b[1]).drop("after__")
    return right_in_left.where(F.col(b[0]) <= F.col(b[1])).unionByName(left_in_right.where(F.col(a[0]) <= F.col(a[1])))


# ---------------------------------------------------------------- parts of texts


def grams(x: Column, size: int = GRAM) -> Column:
    """The distinct runs of ``size`` characters of a text, in one pass over it; none if it is shorter."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(rf"(?s)(?=(.{{{size}}}))"), 1))


def parts_found(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """Distinct (keys, text, pattern) where the text contains the pattern.

    A pattern is looked up by the one of its grams that the fewest texts (of equal keys) have,
    and compared with those; one of less than GRAM characters by itself.
    """
    whole = texts.select(*keys, text).where(F.col(text).isNotNull()).distinct()
    sought = patterns.select(*keys, pattern).where(F.col(pattern).isNotNull()).distinct()
    posted = whole.select(*keys, text, F.explode(grams(F.col(text))).alias("gram"))
    often = posted.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = sought.select(*keys, pattern, F.explode(grams(F.col(pattern))).alias("gram"))
    rarest = asked.join(often, [*keys, "gram"], "left").groupBy(*keys, pattern).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    rarest = rarest.where("x.n > 0").select(*keys, pattern, F.col("x.gram").alias("gram"))
    long = salted(posted, rarest, [*keys, "gram"], [text]).where(F.contains(F.col(text), F.col(pattern)))
    short = sought.where(F.length(pattern) < GRAM)
    pieces = F.array_distinct(F.concat(F.array(F.lit("")), *(grams(F.col(text), n) for n in range(1, GRAM))))
    few = salted(whole.select(*keys, text, F.explode(pieces).alias(pattern)), short, [*keys, pattern], [text])
    return long.select(*keys, text, pattern).unionByName(few.select(*keys, text, pattern)).distinct()
