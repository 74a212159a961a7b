"""Parsing of review texts: model answers, reports, references, account values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status names of a hosted diff, and file states.
CHANGE_STATUS = {"ADDED": "added", "MODIFIED": "modified", "DELETED": "removed", "RENAMED": "renamed", "COPIED": "copied", "CHANGED": "changed"}
FILE_STATUS = {"added": "added", "removed": "deleted", "renamed": "renamed"}
#: Dollars for a million tokens in and out.
PRICE_IN, PRICE_OUT = 0.2, 15.0


def mapped(key: Column, values: dict[str, str], other: Column | str) -> Column:
    out = other if isinstance(other, Column) else F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def file_status(status: Column) -> Column:
    """added, deleted or renamed; anything else was modified."""
    return mapped(status, FILE_STATUS, "modified")


def scope(text: Column) -> Column:
    """kind, from, to of a diff scope: a working tree, a range a..b, or one commit."""
    parts = F.split(text, r"\.\.", 2)
    return F.when(text == "working", F.struct(F.lit("working").alias("kind"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to"))).when(text.contains(".."), F.struct(F.lit("range").alias("kind"), parts[0].alias("from"), parts[1].alias("to"))).otherwise(F.struct(F.lit("commit").alias("kind"), text.alias("from"), F.lit(None).cast("string").alias("to")))


def repo_parts(repo: Column) -> Column:
    """owner and name, cut at the first slash; null without one."""
    return F.when(repo.contains("/"), F.struct(F.regexp_extract(repo, "^([^/]*)/", 1).alias("owner"), F.regexp_extract(repo, "^[^/]*/(.*)$", 1).alias("name")))


def pull_request(url: Column) -> Column:
    """owner, repo and number of a pull request's address."""
    pattern = r"github\.com/([^/]+)/([^/]+)/pull/(\d+)"
    return F.when(url.rlike(pattern), F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_extract(url, pattern, 2).alias("repo"), F.regexp_extract(url, pattern, 3).cast("long").alias("number")))


def without_fences(text: Column) -> Column:
    """The inside of a fenced block, or the text itself, trimmed."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*\n?|\n?```$", ""))


def balanced_object(text: Column) -> Column:
    """The first {...} whose braces balance, quotes disregarded; null without one.

    Only the braces are walked; where the closing one stands follows from the pieces between them.
    """
    rest = F.regexp_extract(text, r"(?s)(\{.*)", 1)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        depth = a["depth"] + F.when(x == "{", 1).otherwise(-1)
        return F.struct((a["n"] + 1).alias("n"), depth.alias("depth"), F.when((a["end"] == 0) & (depth == 0), a["n"] + 1).otherwise(a["end"]).alias("end"))

    closing = F.aggregate(F.regexp_extract_all(rest, F.lit(r"[{}]"), 0), start, step)["end"]
    between = F.aggregate(F.slice(F.split(rest, r"[{}]"), F.lit(1), closing), F.lit(0), lambda n, x: n + F.length(x))
    return F.when((rest != "") & (closing > 0), F.substring(rest, F.lit(1), closing + between))


def summary_names(text: Column) -> Column:
    """Lower-case names of a summary "Name (level), Name (level)"."""
    return _names(F.split(text, ", "), r"^(.+?)\s*\(")


def risky_names(text: Column) -> Column:
    """Lower-case names of a list "type::Name (file) [level, score=x] | ..."."""
    return _names(F.split(text, r" \| "), r"^(?:\w+::)?(.+?)\s*\(")


def risky_files(text: Column) -> Column:
    """Lower-case files of the same list."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\(([^)]+\.\w+)\)"), 1), F.lower)))


def _names(parts: Column, pattern: str) -> Column:
    found = F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.regexp_extract(x, pattern, 1))))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def issues(text: Column) -> Column:
    """array<struct<issue, evidence, severity, file>> of a model's answer.

    ``issues`` may hold strings and objects; objects need a non-empty issue.  Text
    around the first object is ignored; an unreadable answer has no issues.
    """
    body = without_fences(text)
    whole = F.coalesce(F.get_json_object(body, "$.issues"), F.get_json_object(balanced_object(body), "$.issues"))
    items = F.coalesce(F.from_json(whole, "array<string>"), F.array().cast("array<string>"))
    row = lambda x: F.struct(F.coalesce(F.get_json_object(x, "$.issue"), F.when(~x.startswith("{"), x)).alias("issue"), F.get_json_object(x, "$.evidence").alias("evidence"), F.get_json_object(x, "$.severity").alias("severity"), F.get_json_object(x, "$.file").alias("file"))
    return F.filter(F.transform(items, row), lambda r: F.coalesce(r["issue"], F.lit("")) != "")


def findings(text: Column) -> Column:
    """array<struct<file, line, end_line, description, confidence>> of the outermost array in a text."""
    items = F.coalesce(F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), "array<string>"), F.array().cast("array<string>"))

    def row(x: Column) -> Column:
        get = lambda *names: F.coalesce(*(F.get_json_object(x, f"$.{n}") for n in names))
        number = lambda c, default: F.coalesce(c.try_cast("long"), F.lit(default))
        return F.struct(F.coalesce(get("file", "path"), F.lit("")).alias("file"), number(get("line", "from_line"), 0).alias("line"), number(get("end_line", "to_line"), 0).alias("end_line"), F.coalesce(get("description", "message"), F.lit("")).alias("description"), number(get("confidence"), 3).alias("confidence"))

    return F.transform(F.filter(items, lambda x: x.startswith("{")), row)


def report_blocks(text: Column) -> Column:
    """array<struct<file, line, end_line, description>> of a plain report: File:, Line:, Type:, Comment:."""
    blocks = F.filter(F.split(text, r"(?m)(?=^File:\s)"), lambda b: b.rlike(r"(?m)^File:\s*\S"))

    def row(b: Column) -> Column:
        line = F.coalesce(F.regexp_extract(b, r"(?m)^Line:\s*(\d+)", 1).try_cast("long"), F.lit(0))
        end = F.coalesce(F.regexp_extract(b, r"(?m)^Line:\s*\d+\s+to\s+(\d+)", 1).try_cast("long"), line)
        kind = F.trim(F.regexp_extract(b, r"(?m)^Type:\s*(.+)", 1))
        body = F.trim(F.regexp_extract(b, r"(?ms)^Comment:\s*\n(.+?)(?=\n\n\S|\nPrompt for AI|\nReview completed|\Z)", 1))
        body = F.left(F.split(body, "\n\n")[0], F.lit(500))
        return F.struct(F.trim(F.regexp_extract(b, r"(?m)^File:\s*(.+)", 1)).alias("file"), line.alias("line"), end.alias("end_line"), F.when(kind != "", F.concat(F.lit("["), kind, F.lit("] "), body)).otherwise(body).alias("description"))

    return F.transform(blocks, row)


def model_verdict(text: Column) -> Column:
    """verdict and summary of a model's answer; anything unreadable is a comment."""
    body = without_fences(text)
    return F.struct(F.coalesce(F.get_json_object(body, "$.verdict"), F.lit("comment")).alias("verdict"), F.coalesce(F.get_json_object(body, "$.summary"), F.left(text, F.lit(500))).alias("summary"))


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * PRICE_IN + tokens_out / 1e6 * PRICE_OUT


def short_number(n: Column) -> Column:
    """1.2K, 3.4M"""
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1e6, 1), F.lit("M"))).when(n >= 1000, F.concat(F.format_number(n / 1e3, 1), F.lit("K"))).otherwise(n.cast("string"))


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def key_prefix(key: Column) -> Column:
    return F.left(key, F.lit(13))


def decoded_content(base64: Column) -> Column:
    """Text of a file delivered as base64 with line breaks; null where it isn't."""
    return F.decode(F.unbase64(F.regexp_replace(base64, r"\s", "")), "UTF-8")


def clamp_lines(lines: Column, start: Column, end: Column) -> Column:
    """The commentable lines nearest to a range: the first from its start, the last up to its end."""
    first = F.coalesce(F.array_min(F.filter(lines, lambda x: x >= start)), F.array_max(lines))
    last = F.coalesce(F.array_max(F.filter(lines, lambda x: x <= end)), F.array_min(lines))
    return F.when(F.size(lines) > 0, F.struct(F.least(first, last).alias("start"), F.greatest(first, last).alias("end")))
