"""Merging, de-duplicating, filtering and choosing review findings."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.functions import predicates as p
from deltascope.operators import matching

DEDUP_PREFIX = 80
MAX_VALIDATED, MAX_RAW, SHORTCUT = 7, 50, 2
NEAR_LINES = 20
# Words of a description that are no identifiers.
PLAIN_WORDS = frozenset("the and for not but with this that from are was were been being have has had does did will would could should may might can shall must need null undefined error function method class variable parameter return value type file line code issue bug check missing unused added removed changed instead when where which what there here also only".split())


def first_of_prefix(findings: DataFrame) -> DataFrame:
    """The first finding (by lens, position) of those whose texts begin alike."""
    same = Window.partitionBy("pr_id", F.left(F.lower("issue"), F.lit(DEDUP_PREFIX))).orderBy("lens_idx", "pos")
    return findings.withColumn("rn", F.row_number().over(same)).where("rn = 1").drop("rn")


def structural_filter(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Drops findings that name a code file outside the change; a change without files drops none."""
    bases = files.groupBy("pr_id").agg(F.collect_set(F.lower(F.substring_index("path", "/", -1))).alias("bases"))
    rows = findings.join(bases, "pr_id", "left")
    return rows.where(F.col("bases").isNull() | ~p.names_foreign_file(F.col("issue"), F.col("bases"))).drop("bases")


def capped(findings: DataFrame, limit: int = MAX_VALIDATED) -> DataFrame:
    """The first findings of each change, all where there are at most SHORTCUT.

    MAX_VALIDATED is the limit after a validation pass, MAX_RAW that without one.
    """
    own = Window.partitionBy("pr_id")
    rows = findings.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("rn", F.row_number().over(own.orderBy("lens_idx", "pos")))
    return rows.where((F.col("n") <= SHORTCUT) | (F.col("rn") <= limit)).drop("n", "rn")


def kept_indices(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """The candidates that 1-based answers name, in the answers' order; others are ignored."""
    numbered = candidates.withColumn("idx", F.row_number().over(Window.partitionBy("pr_id").orderBy("lens_idx", "pos")))
    chosen = answers.select("pr_id", F.posexplode("indices").alias("ord", "idx"))
    return chosen.join(numbered, ["pr_id", "idx"]).select("pr_id", "ord", "idx", "issue")


def confident(findings: DataFrame, least: int = 3) -> DataFrame:
    return findings.where(F.coalesce("confidence", F.lit(3)) >= least)


def per_change_cap(findings: DataFrame, limit: int = 15) -> DataFrame:
    """The most confident findings of each change."""
    rank = F.row_number().over(Window.partitionBy("pr_id").orderBy(F.desc("confidence"), "pos"))
    return findings.withColumn("rn", rank).where(F.col("rn") <= limit).drop("rn")


WORD = r"\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b"


def identifiers(text: str | None) -> set[str]:
    return set(re.findall(WORD, text or "", re.ASCII)) - PLAIN_WORDS


def identifier_column(text: Column) -> Column:
    """``identifiers`` as an expression, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), 0)), F.array(*map(F.lit, sorted(PLAIN_WORDS)))))


class Merged:
    """Findings of one file merged so far, in slots that lines, entities and identifiers lead to.

    A slot is found through postings instead of comparing with every slot: bands of
    lines as wide as the tolerance, the entity's name, and counts of shared words.
    """

    def __init__(self) -> None:
        self.slots: list[dict] = []
        self.bands: dict[int, set[int]] = defaultdict(set)
        self.entities: dict[str, set[int]] = defaultdict(set)
        self.words: dict[str, set[int]] = defaultdict(set)

    def _postings(self, row: dict) -> list[set[int]]:
        named = [self.entities[row["entity_name"]]] if row["entity_name"] else []
        return [self.bands[row["line"] // NEAR_LINES], *named, *(self.words[w] for w in identifiers(row["issue"]))]

    def _put(self, slot: int, row: dict) -> None:
        for posting in self._postings(row):
            posting.add(slot)

    def slot_of(self, row: dict) -> int | None:
        """The first slot that ``row`` belongs to, if any."""
        band = row["line"] // NEAR_LINES
        near = {x for k in (band - 1, band, band + 1) for x in self.bands[k] if abs(self.slots[x]["line"] - row["line"]) <= NEAR_LINES}
        same = self.entities[row["entity_name"]] if row["entity_name"] else set()
        shared = Counter(x for w in identifiers(row["issue"]) for x in self.words[w])
        return min(near | same | {x for x, n in shared.items() if n >= 2}, default=None)

    def add(self, row: dict) -> None:
        slot = self.slot_of(row)
        if slot is None:
            self.slots.append(row)
            self._put(len(self.slots) - 1, row)
        elif len(row["issue"]) > len(self.slots[slot]["issue"]):
            for posting in self._postings(self.slots[slot]):
                posting.discard(slot)
            self.slots[slot] = row
            self._put(slot, row)


def dedup_greedy(findings: DataFrame) -> DataFrame:
    """Findings of a change on one file, merged in the order of their lines.

    One joins the first kept finding that is within NEAR_LINES, of the same entity
    (``entity_name``, where the table has it) or shares two identifiers; the longer
    text of both stays.  A missing line counts as 0, a missing text as empty.
    """
    named = F.col("entity_name") if "entity_name" in findings.columns else F.lit(None)
    rows = findings.select("pr_id", "file", F.coalesce("line", F.lit(0)).alias("line"), "pos", F.coalesce("issue", F.lit("")).alias("issue"), F.coalesce(named.cast("string"), F.lit("")).alias("entity_name"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = Merged()
        for row in pdf.sort_values(["line", "pos"], kind="stable").to_dict("records"):
            merged.add(row)
        return pd.DataFrame(merged.slots, columns=list(pdf.columns))

    return rows.groupBy("pr_id", "file").applyInPandas(run, rows.schema)


def round_robin(entities: DataFrame, limit: int = 30) -> DataFrame:
    """Entities chosen by turns over files, best file first: turn, then the file's best rank."""
    turn = F.row_number().over(Window.partitionBy("pr_id", "file_path").orderBy(F.desc("risk_score"), "change_seq"))
    best = F.max("risk_score").over(Window.partitionBy("pr_id", "file_path"))
    first = F.min("change_seq").over(Window.partitionBy("pr_id", "file_path"))
    rows = entities.withColumns({"turn": turn, "best": best, "first": first})
    rank = F.row_number().over(Window.partitionBy("pr_id").orderBy("turn", F.desc("best"), "first"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).select("pr_id", "entity_id", "turn", "rank")


def turn_ranks(sizes: list[int], limit: int) -> list[tuple[int, int, int]]:
    """(queue, nth of it, rank) of the picks by turns over queues of these sizes.

    Turn t goes to queue t modulo the number of queues; a queue found empty leaves
    and the turn is played again among the rest, which shifts them.  Between two
    leavings each queue is served in an arithmetic progression of turns.
    """
    live, left, turn, out = list(range(len(sizes))), list(sizes), 0, []
    while live and turn < limit:
        step = len(live)
        first = {q: turn + (place - turn) % step for place, q in enumerate(live)}
        found_empty = {q: first[q] + step * left[q] for q in live}
        gone = min(live, key=found_empty.__getitem__)
        for q in live:
            for rank in range(first[q], min(found_empty[gone], limit), step):
                out.append((q, sizes[q] - left[q], rank))
                left[q] -= 1
        live.remove(gone)
        turn = found_empty[gone]
    return sorted(out, key=lambda x: x[2])


def round_robin_exact(entities: DataFrame, limit: int = 30) -> DataFrame:
    """pr_id, entity_id, rank by the historical turns, in which an empty file shifts the others.

    Python sees a row per file of a change (its size); entities meet their rank by
    file and place.
    """
    order = [F.desc("risk_score"), "change_seq"]
    rows = entities.withColumn("nth", F.row_number().over(Window.partitionBy("pr_id", "file_path").orderBy(*order)) - 1)
    files = rows.groupBy("pr_id", "file_path").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(-F.col("risk_score"), "change_seq")).alias("best"))
    files = files.select("pr_id", "file_path", F.least("size", F.lit(limit)).alias("size"), F.col("best.col1").alias("best"), F.col("best.change_seq").alias("seq"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["best", "seq"], kind="stable")
        names, change = pdf["file_path"].tolist(), pdf["pr_id"].iloc[0]
        return pd.DataFrame([(change, names[q], nth, rank + 1) for q, nth, rank in turn_ranks(pdf["size"].tolist(), limit)], columns=["pr_id", "file_path", "nth", "rank"])

    ranks = files.groupBy("pr_id").applyInPandas(run, f"pr_id {entities.schema['pr_id'].dataType.simpleString()}, file_path string, nth int, rank long")
    return rows.join(ranks, ["pr_id", "file_path", "nth"]).select("pr_id", "entity_id", "rank")


def fill_uncovered(chosen: DataFrame, low: DataFrame, slots: int | None = None) -> DataFrame:
    """The best low-risk entity of each file that nothing was chosen from; up to the slots left of each change."""
    rest = low.join(chosen.select("pr_id", "file_path").distinct(), ["pr_id", "file_path"], "left_anti")
    order = [F.desc("risk_score"), "change_seq"]
    best = rest.withColumn("rn", F.row_number().over(Window.partitionBy("pr_id", "file_path").orderBy(*order))).where("rn = 1")
    if slots is not None:
        taken = chosen.groupBy("pr_id").agg(F.count(F.lit(1)).alias("taken"))
        best = best.withColumn("place", F.row_number().over(Window.partitionBy("pr_id").orderBy(*order))).join(taken, "pr_id", "left")
        best = best.where(F.col("place") <= slots - F.coalesce("taken", F.lit(0)))
    return best.select("pr_id", "file_path", "entity_id")


SOURCE_EXTENSIONS = ("py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "c", "cpp", "cc", "h", "hpp", "cs", "rb", "php")
CONFIG_EXTENSIONS = ("json", "yml", "yaml", "toml", "xml", "md", "txt", "lock")


def gap_files(chunks: DataFrame, covered: DataFrame, limit: int = 5) -> DataFrame:
    """Files of a change that no finding covers: source first, larger first."""
    hit = matching.ends_meet(chunks, covered, ["pr_id"], "file", "path").select("pr_id", "file").distinct()
    rest = chunks.join(hit, ["pr_id", "file"], "left_anti").where("chunk_len > 50")
    ext = F.lower(F.substring_index("file", ".", -1))
    kind = F.when(ext.isin(*SOURCE_EXTENSIONS), 2).when(ext.isin(*CONFIG_EXTENSIONS), 0).otherwise(1)
    rank = F.row_number().over(Window.partitionBy("pr_id").orderBy(F.desc(kind), F.desc("chunk_len"), "file"))
    return rest.withColumn("rank", rank).where(F.col("rank") <= limit).select("pr_id", "file", "rank")


def code_changes(entities: DataFrame) -> DataFrame:
    """What a code triage looks at: entities modified, added or deleted."""
    return entities.where(F.col("change_type").isin("modified", "added", "deleted"))


def validation_context(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities with content whose name stands in the change's candidate issues, in any case; no chunks.

    The issues of a change are one text, as a name may only be found across them.
    """
    texts = candidates.groupBy("pr_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lens_idx", "pos", F.lower("issue").alias("x")))), lambda r: r["x"]), " ").alias("combined"))
    content = F.coalesce(F.nullif("before_content", F.lit("")), F.nullif("after_content", F.lit("")))
    named = (F.coalesce("entity_name", F.lit("")) != "") & (F.col("entity_type") != "chunk") & content.isNotNull()
    known = entities.where(named).withColumn("sought", F.lower("entity_name"))
    # a name can only be in a text that has all its grams; those of a text are few, however many names there are
    there = texts.select("pr_id", F.explode(matching.grams(F.col("combined"))).alias("gram"))
    asked = known.select("pr_id", "sought").distinct().withColumn("grams", matching.grams(F.col("sought")))
    n = asked.select("pr_id", "sought", F.explode("grams").alias("gram")).join(there, ["pr_id", "gram"]).groupBy("pr_id", "sought").agg(F.count(F.lit(1)).alias("n"))
    likely = asked.join(n, ["pr_id", "sought"], "left").where(F.coalesce("n", F.lit(0)) == F.size("grams")).select("pr_id", "sought")
    found = likely.join(texts, "pr_id").where(F.col("combined").contains(F.col("sought"))).select("pr_id", "sought")
    return known.join(found, ["pr_id", "sought"], "left_semi").drop("sought")
