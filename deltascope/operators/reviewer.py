"""Calls to a reviewer per entity, prompts, and what is written out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.functions import parsing
from deltascope.functions import predicates as p
from deltascope.operators import matching
from deltascope.operators.skew import SALTS
from deltascope.sources.tables import cut

LENSES = ("security", "correctness", "concurrency", "errors", "api", "performance", "general", "general-2", "general-3")
#: Characters of content shown for an entity, and names listed each way.
CONTENT_CHARS, LISTED = 2000, 10
SNIPPET_BUDGET = 15_000


def prompt(entities: DataFrame) -> Column:
    """The question about one entity: what changed, how risky, what depends on it, and its texts.

    Dependents (``dependents``: array of name and file, the first LISTED), ``before_content``
    and ``after_content`` are shown where the table has them.
    """
    c, has = F.col, entities.columns
    lines = [F.concat(F.lit(f"{x}: "), c(x).cast("string")) for x in ("entity_name", "entity_type", "file_path", "change_type", "classification", "risk_level", "blast_radius", "dependent_count")]
    if "is_public_api" in has:
        lines.append(F.when(c("is_public_api"), "public API: yes"))
    if "dependents" in has:
        names = F.transform(F.slice(F.coalesce("dependents", F.array().cast("array<struct<name:string,file:string>>")), 1, LISTED), lambda x: F.concat(F.lit("  "), x["name"], F.lit(" ("), x["file"], F.lit(")")))
        lines.append(F.when(F.size("dependents") > 0, F.concat(F.lit("dependents:\n"), F.array_join(names, "\n"))))
    lines += [F.concat(F.lit(f"{side}:\n```\n"), c(f"{side}_content"), F.lit("\n```")) for side in ("before", "after") if f"{side}_content" in has]
    return F.concat_ws("\n", *lines)


def review(entities: DataFrame, reviewer: Callable[[str], str]) -> DataFrame:
    """entity_id, answer, verdict: a call per entity, in batches of its partition; a failed call is skipped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text in zip(frame["entity_id"], frame["prompt"], strict=True):
                try:
                    out.append((key, reviewer(text)))
                except Exception:  # noqa: BLE001  the remote side may fail in any way
                    continue
            yield pd.DataFrame(out, columns=["entity_id", "answer"])

    answers = entities.select("entity_id", prompt(entities).alias("prompt")).mapInPandas(run, "entity_id string, answer string")
    return answers.withColumn("verdict", parsing.model_verdict(F.col("answer"))["verdict"])


def lens_calls(changes: DataFrame) -> DataFrame:
    """A row for each change and lens (nine fixed lenses)."""
    return changes.select("*", F.posexplode(F.array(*map(F.lit, LENSES))).alias("lens_idx", "lens"))


def verdict_counts(reviews: DataFrame) -> DataFrame:
    """Reviews by verdict, and their tokens where they are known."""
    tokens = [F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")] if "tokens" in reviews.columns else []
    return reviews.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), *tokens)


def validated(candidates: DataFrame, answers: DataFrame, limit: int = 7) -> DataFrame:
    """What a validation pass kept; a change whose pass failed keeps its first ``limit``."""
    ok = answers.select("pr_id").distinct()
    first = F.row_number().over(Window.partitionBy("pr_id").orderBy("lens_idx", "pos"))
    unvalidated = candidates.join(ok, "pr_id", "left_anti").withColumn("rn", first).where(F.col("rn") <= limit).select("pr_id", "issue")
    return answers.select("pr_id", "issue").unionByName(unvalidated)


def snippets(entities: DataFrame, budget: int = SNIPPET_BUDGET) -> DataFrame:
    """Of each change's ten first entities, those whose code fits the budget: one too large is skipped, not a stop."""
    rank = F.row_number().over(Window.partitionBy("pr_id").orderBy(F.desc("triage_score"), "change_seq"))
    rows = entities.withColumn("rank", rank).where("rank <= 10").groupBy("pr_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id", "size"))).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["size"] <= budget
        return F.when(fits, F.struct((a["used"] + x["size"]).cast("long").alias("used"), F.concat(a["kept"], F.array(x["entity_id"])).alias("kept"))).otherwise(a)

    kept = F.aggregate("xs", start, step)
    return rows.select("pr_id", F.posexplode(kept["kept"]).alias("ord", "entity_id"))


def entity_json(scored: DataFrame, least: str = "low") -> DataFrame:
    """The JSON of each entity that an API returns: two decimals, lower-case names, content cut.

    Content (CONTENT_CHARS characters) is left out of cosmetic changes; of dependents and
    dependencies (arrays of name and file) the first LISTED are given.  Columns
    that the table hasn't, and missing values, are left out.
    """
    has = scored.columns
    extra = [F.when(~p.is_cosmetic(F.col("structural_change")), F.left(x, F.lit(CONTENT_CHARS))).alias(x) for x in ("before_content", "after_content") if x in has]
    extra += [F.slice(x, 1, LISTED).alias(x) for x in ("dependents", "dependencies") if x in has]
    fields = F.struct("entity_name", "entity_type", "file_path", F.lower("change_type").alias("change_type"), "classification", F.format_string("%.2f", "risk_score").alias("risk_score"), "risk_level", "blast_radius", "dependent_count", "is_public_api", *extra)
    return scored.where(p.at_least(F.col("risk_rank"), least)).select("entity_id", F.to_json(fields).alias("json"))


def _longest(words: Column, limit: int) -> Column:
    return F.transform(F.slice(F.array_sort(F.transform(words, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1, limit), lambda s: s["x"])


# Words that tell nothing about a file.
COMMON_WORDS = ("self", "this", "None", "null", "true", "false", "return", "const", "static", "void", "string", "else", "break", "continue", "import", "from", "class", "function", "async", "await", "public", "private", "protected", "override")


def enrich_by_file(findings: DataFrame, entities: DataFrame, limit: int = 20) -> DataFrame:
    """Adds `` [ctx: ...]``: the longest identifiers and entity names of the files that a finding's path stands for.

    findings: pr_id, file, issue; entities: pr_id, file_path, entity_name, before_content,
    after_content.  Each file keeps its own ``limit`` longest words, gathered word by word, before
    files meet findings; of equally long ones the first in order.
    """
    code = F.coalesce(F.nullif("after_content", F.lit("")), F.nullif("before_content", F.lit("")), F.lit(""))
    found = F.filter(F.regexp_extract_all(code, F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]{3,}\b"), 0), lambda x: (F.upper(x) != x) & ~x.isin(*COMMON_WORDS))
    named = F.filter(F.array("entity_name"), lambda x: F.coalesce(x, F.lit("")) != "")
    own = ["pr_id", "file_path", "part"]
    words = entities.select("pr_id", "file_path", F.explode(F.array_union(found, named)).alias("word")).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(SALTS)))
    words = words.repartition(*own).distinct()  # by the keys of the ranks, so that they need no further shuffle
    words = words.withColumn("rn", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc(F.length("word")), "word"))).where(F.col("rn") <= limit)
    by_file = words.groupBy("pr_id", "file_path").agg(_longest(F.collect_list("word"), limit).alias("words"))  # of SALTS * limit words at most
    plain = lambda x: F.regexp_replace(F.translate(x, "\\", "/"), "^/+", "")
    # paths are read several times, and so written; the words of the files meet them once
    left = cut(findings.select("pr_id", "file").distinct().withColumn("a", plain(F.col("file"))))
    paths = cut(entities.select("pr_id", "file_path").distinct().withColumn("b", plain(F.col("file_path"))))
    met = matching.ends_meet(left, paths, ["pr_id"], "a", "b").join(left, ["pr_id", "a"]).join(paths, ["pr_id", "b"]).select("pr_id", "file", "file_path")
    best = met.join(by_file, ["pr_id", "file_path"]).groupBy("pr_id", "file").agg(_longest(F.array_distinct(F.flatten(F.collect_list("words"))), limit).alias("words"))
    text = F.concat(F.coalesce("issue", F.lit("")), F.lit(" [ctx: "), F.array_join("words", ", "), F.lit("]"))
    return findings.join(best, ["pr_id", "file"], "left").withColumn("issue", F.when(F.col("words").isNotNull(), text).otherwise(F.col("issue"))).select(*findings.columns)


def enrich(findings: DataFrame, entities: DataFrame, limit: int = 15) -> DataFrame:
    """Adds the longest identifiers of the entity that covers a finding's line (or starts within 20 of it).

    entities: file, start_line, end_line, ids.  Places meet ranges on aligned spans, so a long file is no all-pairs join.
    """
    known = entities.withColumns({"low": F.col("start_line") - 20, "high": F.greatest("end_line", F.col("start_line") + 20)})
    rows = matching.points_in_ranges(findings.select("file", "line", "pos"), known, ["file"], "line", "low", "high")
    outside = ~F.col("line").between(F.col("start_line"), F.col("end_line"))
    rows = rows.where(~outside | (F.abs(F.col("start_line") - F.col("line")) <= 20))
    best = rows.groupBy("pos").agg(F.min_by("ids", F.struct(outside, F.col("start_line"), F.col("end_line"))).alias("ids"))
    words = best.select("pos", F.array_join(_longest(F.col("ids"), limit), " ").alias("words"))
    return findings.join(words, "pos", "left").withColumn("issue", F.concat_ws(" ", "issue", "words")).drop("words")


def candidates(benchmark: DataFrame, findings: DataFrame) -> DataFrame:
    """url and its findings as one array, empty where there are none."""
    found = findings.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("issue").alias("text"), F.col("file").alias("path"), "line"))).alias("found"))
    none = F.array().cast("array<struct<pos:bigint,text:string,path:string,line:bigint>>")
    return benchmark.join(found, "url", "left").select("url", F.coalesce("found", none).alias("candidates"))


def remaining(benchmark: DataFrame, done: DataFrame) -> DataFrame:
    """What a resumed run still has to do."""
    return benchmark.join(done.select("url").distinct(), "url", "left_anti")


def run_summary(results: DataFrame) -> DataFrame:
    """ok, failed, findings and mean seconds of a run."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings"), F.avg(F.when(F.col("error").isNull(), F.col("seconds"))).alias("mean_seconds"))
