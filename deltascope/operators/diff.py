"""Unified diffs and text search as table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.functions import predicates as p

HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
# Weights by kind of file, multiplied where several apply.
PART_WEIGHTS = ((("test", "spec", "mock", "__test__", "fixture"), 0.3), ((".md", ".adoc", ".txt", ".rst", "changelog", "readme"), 0.2), ((".snap", ".lock", "package-lock", "yarn.lock"), 0.1), ((".json", ".yaml", ".yml", ".toml", ".xml"), 0.5))
SHOWN_MATCHES = 100


def number(text: Column, group: int, default: int) -> Column:
    found = F.regexp_extract(text, HEADER, group)
    return F.when(found == "", default).otherwise(F.coalesce(found.try_cast("long"), F.lit(0)))


def parse_patch(patches: DataFrame) -> DataFrame:
    """patch_id, hunk, pos, kind, old_line, new_line, content, commentable of each diff line."""
    rows = patches.select("patch_id", F.posexplode(F.split("patch", "\n")).alias("pos", "raw"))
    order = Window.partitionBy("patch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("raw").startswith("@@")
    rows = rows.withColumn("hunk", F.sum(head.cast("int")).over(order)).where("hunk > 0")
    in_hunk = Window.partitionBy("patch_id", "hunk").orderBy("pos")
    first = in_hunk.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("old0", F.first(F.when(head, number(F.col("raw"), 1, 0)), True).over(first)).withColumn("new0", F.first(F.when(head, number(F.col("raw"), 3, 0)), True).over(first))
    rows = rows.where(~head)
    sign = F.substring("raw", 1, 1)
    rows = rows.withColumn("kind", F.when(sign == "+", "add").when(sign == "-", "delete").otherwise("context"))
    before = in_hunk.rowsBetween(Window.unboundedPreceding, -1)
    old = F.col("old0") + F.coalesce(F.sum((F.col("kind") != "add").cast("long")).over(before), F.lit(0))
    new = F.col("new0") + F.coalesce(F.sum((F.col("kind") != "delete").cast("long")).over(before), F.lit(0))
    content = F.when((F.col("kind") != "context") | (sign == " "), F.expr("substr(raw, 2)")).otherwise(F.col("raw"))
    return rows.select("patch_id", "hunk", "pos", "kind", F.when(F.col("kind") != "add", old).alias("old_line"), F.when(F.col("kind") != "delete", new).alias("new_line"), content.alias("content"), (F.col("kind") != "delete").alias("commentable"))


def commentable_lines(parsed: DataFrame) -> DataFrame:
    """patch_id and the new lines that a comment can be put on, in order."""
    return parsed.where("commentable").groupBy("patch_id").agg(F.array_sort(F.collect_list("new_line")).alias("lines"))


def check_comments(comments: DataFrame, parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``problem``: null where the file is in the change and the line can be commented."""
    known = files.select(F.col("file"), F.col("patch_id"))
    lines = parsed.where("commentable").select("patch_id", F.col("new_line").alias("line")).distinct().withColumn("ok", F.lit(True))
    rows = comments.join(known, "file", "left").join(lines, ["patch_id", "line"], "left")
    problem = F.when(F.col("patch_id").isNull(), "file not in change").when(F.col("ok").isNull(), "line not in diff")
    return rows.select("comment_id", "file", "line", problem.alias("problem"))


def parse_raw_diff(diffs: DataFrame) -> DataFrame:
    """pr_id, file, patch: the hunks of each file; deleted files have none."""
    rows = diffs.select("pr_id", F.posexplode(F.split("diff", "\n")).alias("pos", "raw"))
    raw = F.col("raw")
    order = Window.partitionBy("pr_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    names = F.when(raw.startswith("+++ b/"), F.expr("substr(raw, 7)")).when(raw.startswith("diff --git ") | raw.startswith("+++ /dev/null"), "")
    rows = rows.withColumn("file", F.last(names, True).over(order))
    noise = p.starts_with(raw, ("diff --git ", "--- ", "+++ ", "index ", "new file", "deleted file", "old mode", "new mode", "similarity index", "rename ", "Binary "))
    rows = rows.where(F.coalesce(F.col("file"), F.lit("")) != "").where(~noise)
    return rows.groupBy("pr_id", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n").alias("patch"))


def diff_files(diffs: DataFrame) -> DataFrame:
    """pr_id and each distinct path named in a header, with its basename."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("diff", F.lit(r"(?m)^(?:\+\+\+ b|--- a)/(.+)$"), 1)))
    return diffs.select("pr_id", found.alias("path")).withColumn("base", F.substring_index("path", "/", -1))


def diff_parts(diffs: DataFrame) -> DataFrame:
    """pr_id, part_no, size, weight, path and text of each file's part of a diff."""
    rows = diffs.select("pr_id", F.posexplode(F.split("diff", "diff --git ")).alias("part_no", "part")).where(F.trim("part") != "")
    count = lambda x: F.size(F.split("part", x)) - 1
    adds = F.greatest(count(r"\n\+") - count(r"\n\+\+\+"), F.lit(0))
    dels = F.greatest(count(r"\n-") - count(r"\n---"), F.lit(0))
    weight = (adds + dels + F.least(adds, dels) * 2).cast("double")
    first = F.lower(F.split("part", "\n")[0])
    for names, factor in PART_WEIGHTS:
        weight = F.when(p.contains(first, names), weight * factor).otherwise(weight)
    path = F.regexp_extract(F.split("part", "\n")[0], r" b/(.+)$", 1)
    return rows.select("pr_id", "part_no", F.octet_length("part").alias("bytes"), weight.alias("weight"), path.alias("path"), "part")


def truncate_diff(diffs: DataFrame, limit: int) -> DataFrame:
    """The parts of most weight that fit, up to the first that doesn't."""
    parts = diff_parts(diffs)
    so_far = F.sum(F.col("bytes") + 11).over(Window.partitionBy("pr_id").orderBy(F.desc("weight"), "part_no").rowsBetween(Window.unboundedPreceding, 0))
    whole = diffs.select("pr_id", (F.octet_length("diff") <= limit).alias("whole"))
    return parts.withColumn("so_far", so_far).join(whole, "pr_id").where(F.col("whole") | (F.col("so_far") <= limit)).select("pr_id", "part_no", "weight")


def truncated_text(diffs: DataFrame, limit: int) -> DataFrame:
    """pr_id, kind, parts, text: a whole diff that fits, else its chosen parts, else its first ``limit`` bytes.

    The bytes end at a whole character.
    """
    chosen = truncate_diff(diffs, limit).join(diff_parts(diffs).select("pr_id", "part_no", "part"), ["pr_id", "part_no"])
    order = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "part_no", F.concat(F.lit("diff --git "), "part").alias("part"))))
    texts = chosen.groupBy("pr_id").agg(order.alias("xs")).select("pr_id", F.size("xs").cast("long").alias("parts"), F.array_join(F.transform("xs", lambda x: x["part"]), "").alias("joined"))
    rows = diffs.select("pr_id", "diff").join(texts, "pr_id", "left")
    fits = F.octet_length("diff") <= limit
    # a character cut in two is invalid at the end only, and goes
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.col("diff").cast("binary"), 1, limit).cast("string")), "\ufffd+$", "")
    kind = F.when(fits, "whole").when(F.col("joined").isNotNull(), "parts").otherwise("prefix")
    return rows.select("pr_id", kind.alias("kind"), F.coalesce("parts", F.lit(0)).alias("parts"), F.when(fits, F.col("diff")).otherwise(F.coalesce("joined", head)).alias("text"))


def grep(files: DataFrame, pattern: str, context: int = 0, case_sensitive: bool = False) -> DataFrame:
    """file, line (from 1), col (byte in the searched line), text, and lines around: literal search, first hit a line."""
    lines = files.select("file", F.split("text", "\n").alias("all"))
    rows = lines.select("file", "all", F.posexplode("all").alias("k", "text"))
    hay = F.col("text") if case_sensitive else F.lower("text")
    at = F.instr(hay, pattern if case_sensitive else pattern.lower())
    rows = rows.where(at > 0)
    before = F.slice("all", F.greatest(F.col("k") + 1 - context, F.lit(1)), F.least(F.col("k"), F.lit(context)))
    after = F.slice("all", F.col("k") + 2, F.lit(context))
    return rows.select("file", (F.col("k") + 1).cast("long").alias("line"), (F.octet_length(F.substring(hay, F.lit(1), at - 1)) + 1).cast("long").alias("col"), "text", F.array_join(before, "\n").alias("before"), F.array_join(after, "\n").alias("after"))


def grep_everywhere(change: DataFrame, fragments: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """Matches in a change's files, and in fragments of other files of the repository that are no noise.

    change: file, text.  fragments: file, fragment, text; their lines count from the
    fragment's first.
    """
    own = grep(change, pattern, case_sensitive=case_sensitive).select("file", "line", "col", "text")
    others = fragments.join(change.select("file").distinct(), "file", "left_anti").where(~p.is_noise(F.col("file")))
    key = F.struct("file", "fragment").alias("file")
    found = grep(others.select(key, "text"), pattern, case_sensitive=case_sensitive)
    return own.unionByName(found.select(F.col("file.file").alias("file"), "line", "col", "text"))


def first_matches(matches: DataFrame, limit: int = SHOWN_MATCHES) -> DataFrame:
    """The matches that are shown; the total is counted beside them."""
    return matches.orderBy("file", "line", "col").limit(limit)
