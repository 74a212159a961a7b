"""Classification of a change by its lines, and risk scores (DOUBLE, terms in a fixed order)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltascope.functions import predicates as p

# Weights of the risk score.
CLASS_WEIGHT = {"text": 0.0, "syntax": 0.08, "functional": 0.22, "text+syntax": 0.10, "text+functional": 0.22, "syntax+functional": 0.25, "text+syntax+functional": 0.28}
CHANGE_WEIGHT = {"deleted": 0.12, "modified": 0.08, "renamed": 0.04, "added": 0.02, "moved": 0.0}
LEVELS = (("critical", 0.7), ("high", 0.5), ("medium", 0.3))
TYPE_BONUS = {**dict.fromkeys(("class", "method", "function", "interface", "constructor", "export"), 0.4), "field": 0.2, **dict.fromkeys(("property", "chunk", "heading"), -0.3)}


def lookup(key: Column, values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def text_lines(text: Column) -> Column:
    """Lines without terminators; a final newline makes no further line."""
    return F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")


# The white space of Unicode.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE_SPACE))


def line_set(lines: Column) -> Column:
    return F.filter(F.transform(lines, stripped), lambda x: x != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def classify(before: Column, after: Column, structural: Column) -> Column:
    """The class of a change from its old and new text, by the lines only one side has."""
    sides = F.struct(line_set(text_lines(before)).alias("a"), line_set(text_lines(after)).alias("b"))
    differ = let(sides, lambda s: F.concat(F.array_except(s["a"], s["b"]), F.array_except(s["b"], s["a"])))
    kind = lambda x: F.when(p.is_comment(x), 1).when(p.is_signature(x), 2).otherwise(4)
    bits = F.aggregate(differ, F.lit(0), lambda seen, x: seen.bitwiseOR(kind(x)))
    empty = (F.coalesce(before, F.lit("")) == "") | (F.coalesce(after, F.lit("")) == "")
    reordered = F.when(stripped(before) != stripped(after), "functional").otherwise("text")
    by_bits = F.array(reordered, *map(F.lit, ("text", "syntax", "text+syntax", "functional", "text+functional", "syntax+functional", "text+syntax+functional")))
    return F.when(empty, "functional").when(p.is_cosmetic(structural), "text").otherwise(F.element_at(by_bits, bits + 1))


def risk_score(classification: Column, change: Column, public: Column, blast: Column, total: Column, dependents: Column, structural: Column) -> Column:
    score = lookup(classification, CLASS_WEIGHT) + lookup(change, CHANGE_WEIGHT)
    score = score + F.when(public, 0.12).otherwise(0.0)
    score = score + F.when((total > 0) & (blast > 0), F.sqrt(blast / total) * 0.30).otherwise(0.0)
    score = score + F.when(dependents > 0, F.log(1.0 + dependents) * 0.15).otherwise(0.0)
    return F.least(F.when(p.is_cosmetic(structural), score * 0.2).otherwise(score), F.lit(1.0))


def risk_level(score: Column) -> Column:
    out = F.lit("low")
    for name, least in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def triage_score(risk: Column, blast: Column, public: Column, kind: Column, change: Column, dependents: Column, size: Column) -> Column:
    """The order in which entities are shown to a reviewer."""
    score = risk + F.least(blast, F.lit(20)) * 0.02 + F.when(public, 0.4).otherwise(0.0) + lookup(kind, TYPE_BONUS)
    return score + F.when(change == "modified", 0.15).otherwise(0.0) + F.least(dependents, F.lit(10)) * 0.03 + F.least(size, F.lit(3000)) * 0.0001


def verdict(n: Column, critical: Column, high: Column, all_cosmetic: Column) -> Column:
    return F.when(critical > 0, "requires_careful_review").when(high > 0, "requires_review").when((n > 0) & all_cosmetic, "likely_approvable").otherwise("standard_review")
