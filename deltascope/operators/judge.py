"""Judging findings against golden labels, and account statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.functions import predicates as p
from deltascope.operators import matching

# Identifier patterns, and words that are no identifiers.
IDENTIFIER_PATTERNS = (r"\b[A-Z][a-zA-Z0-9]+(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*\b", r"\b[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b", r"\b[a-z_][a-z0-9_]+\b")
#: The same word boundaries in any Java version and in Python: letters and digits of any script belong to words.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
QUOTED_PATTERNS = (r"`([^`]+)`", r"'([^']+)'")
STOP_WORDS = tuple(
    """the this that with from will can may should could would not but and for has have been being are was were because
    when then than also which where here there into only instead without between during using after before other method
    function class variable parameter returns called calling always never still just like some any all each both same
    different new old first second last however since further consider original issue bug error test check code value
    data type name key result string list null none true false set get add remove create update delete find make
    call run use missing incorrect wrong logic potential existing current causes causing rather whether these those such
    what does how its might already directly immediately properly correctly actually specific possible required expected
    necessary even""".split()
)


def identifiers(text: Column) -> Column:
    """Distinct likely code identifiers of a text, of three characters or more."""
    words = [_BEFORE + x.removeprefix(r"\b").removesuffix(r"\b") + _AFTER for x in IDENTIFIER_PATTERNS]
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(x), 0) for x in words), *(F.regexp_extract_all(text, F.lit(x), 1) for x in QUOTED_PATTERNS)))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 3) & ~F.array_contains(stop, F.lower(x))))


def lower_set(xs: Column) -> Column:
    return F.array_distinct(F.transform(xs, F.lower))


def judge_by_path(golden: DataFrame, findings: DataFrame) -> DataFrame:
    """gold_id, verdict: the first finding on the golden file decides by lines, then identifiers.

    A finding's ``entity_name`` is one of its identifiers, and ``end_line`` ends its
    range, where the table has them.

    Only the first finding of each file of a change matters, so each path is one row; paths of
    which one ends like the other meet on whole ends.
    """
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"\\", "/"), "^/+", "")
    has = lambda name, other: F.col(name) if name in findings.columns else other
    end = F.coalesce(F.nullif(has("end_line", F.lit(None).cast("long")), F.lit(0)), "line")
    f = findings.where(F.col("file") != "").select("pr_id", plain(F.col("file")).alias("f_file"), "pos", F.struct(F.col("line").alias("f_line"), end.alias("f_end"), F.col("issue").alias("f_issue"), has("entity_name", F.lit(None).cast("string")).alias("f_entity")).alias("f"))
    f = f.groupBy("pr_id", "f_file").agg(F.min("pos").alias("pos"), F.min_by("f", "pos").alias("f"))
    g = golden.where(F.col("path") != "").withColumn("g_file", plain(F.col("path")))
    meet = matching.ends_meet(g, f, ["pr_id"], "g_file", "f_file")
    # a path of separators only is the end of any
    bare = lambda df, x: df.where(F.col(x) == "").select("pr_id", x).distinct()
    meet = meet.unionByName(bare(g, "g_file").join(f.select("pr_id", "f_file"), "pr_id")).unionByName(bare(f, "f_file").join(g.select("pr_id", "g_file").distinct(), "pr_id").where("g_file <> ''"))
    best = meet.join(f, ["pr_id", "f_file"]).groupBy("pr_id", "g_file").agg(F.min_by("f", "pos").alias("f"))
    first = g.join(best, ["pr_id", "g_file"]).select("gold_id", F.struct("from_line", "to_line", "f.f_line", "f.f_end", "note", "f.f_issue", "f.f_entity").alias("x"))
    lines = p.lines_overlap(F.col("x.from_line"), F.col("x.to_line"), F.col("x.f_line"), F.col("x.f_end"))
    named = F.when(F.coalesce("x.f_entity", F.lit("")) != "", F.array(F.lower("x.f_entity"))).otherwise(F.array().cast("array<string>"))
    idents = F.arrays_overlap(lower_set(identifiers(F.col("x.note"))), F.concat(lower_set(identifiers(F.col("x.f_issue"))), named))
    found = first.select("gold_id", F.when(lines | F.coalesce(idents, F.lit(False)), "match").otherwise("partial").alias("verdict"))
    return golden.select("gold_id", "severity").join(found, "gold_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("miss")))


def judge_by_identifiers(golden: DataFrame, findings: DataFrame) -> DataFrame:
    """gold_id, verdict: match if any finding of the change shares an identifier, whatever its file."""
    words = lambda df, text, key: df.select(key, "pr_id", F.explode(lower_set(identifiers(F.col(text)))).alias("word"))
    shared = words(golden, "note", "gold_id").join(words(findings, "issue", "pos").select("pr_id", "word").distinct(), ["pr_id", "word"], "left_semi").select("gold_id").distinct()
    return golden.select("gold_id").join(shared.withColumn("hit", F.lit(True)), "gold_id", "left").select("gold_id", F.when(F.col("hit"), "match").otherwise("miss").alias("verdict"))


def judge_by_names(golden: DataFrame, entities: DataFrame) -> DataFrame:
    """gold_id, verdict from names alone: high-risk names, then all names, then high-risk paths.

    entities has one row per change: hc_names, all_names, hc_files (lower case), hc_count, entity_count.
    """
    ids = golden.select("gold_id", "pr_id", F.explode(lower_set(identifiers(F.col("note")))).alias("id"))
    names = entities.select("pr_id", F.explode(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in ("hc_names", "all_names")))).alias("name"))
    paths = entities.select("pr_id", F.explode("hc_files").alias("name"))
    in_names = matching.parts_found(names, ids, ["pr_id"], "name", "id").select("pr_id", "id")
    of_names = matching.parts_found(ids, names, ["pr_id"], "id", "name").select("pr_id", "id")
    in_paths = matching.parts_found(paths, ids, ["pr_id"], "name", "id").select("pr_id", "id")
    met = in_names.unionByName(of_names).withColumn("hit", F.lit(2)).unionByName(in_paths.withColumn("hit", F.lit(1))).groupBy("pr_id", "id").agg(F.max("hit").alias("hit"))
    best = ids.join(met, ["pr_id", "id"]).groupBy("gold_id").agg(F.max("hit").alias("hit"))
    rows = golden.select("gold_id", "pr_id").join(entities.select("pr_id", "entity_count"), "pr_id", "left").join(best, "gold_id", "left")
    verdict = F.when(F.col("hit") == 2, "match").when(F.col("hit") == 1, "partial").when(F.coalesce("entity_count", F.lit(0)) == 0, "miss").otherwise("partial")
    return rows.select("gold_id", verdict.alias("verdict"))


def apply_overrides(judged: DataFrame, overrides: DataFrame) -> DataFrame:
    """Verdicts set by hand take precedence."""
    own = overrides.select("gold_id", F.col("verdict").alias("by_hand"))
    return judged.join(own, "gold_id", "left").withColumn("verdict", F.coalesce("by_hand", "verdict")).drop("by_hand")


def metrics(judged: DataFrame, n_findings: DataFrame, *keys: str) -> DataFrame:
    """Strict and lenient recall, precision (which can exceed 1) and F1."""
    match, partial = F.count_if(F.col("verdict") == "match"), F.count_if(F.col("verdict") == "partial")
    rows = judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), match.alias("matches"), partial.alias("partials"))
    rows = rows.join(n_findings, list(keys), "left") if keys else rows.join(n_findings, how="cross")
    recall = F.when(F.col("n") > 0, F.col("matches") / F.col("n")).otherwise(0.0)
    lenient = F.when(F.col("n") > 0, (F.col("matches") + F.col("partials")) / F.col("n")).otherwise(0.0)
    precision = F.when(F.col("findings") > 0, F.col("matches") / F.col("findings")).otherwise(0.0)
    rows = rows.withColumns({"recall": recall, "lenient_recall": lenient, "precision": precision})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.select(*keys, "n", "matches", "partials", *(F.round(x, 6).alias(x) for x in ("recall", "lenient_recall", "precision")), F.round(f1, 6).alias("f1"))


def recent(reviews: DataFrame, user_id: int, limit: int = 20) -> DataFrame:
    return reviews.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("review_id")).limit(limit)


def newest_per_user(reviews: DataFrame, limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("review_id")))
    return reviews.withColumn("rn", rank).where(F.col("rn") <= limit).drop("rn")


def usage(reviews: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests, tokens of the 100 newest reviews, cost and last activity of each user."""
    tokens = newest_per_user(reviews, 100).groupBy("user_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.max("created_at").alias("last_activity"))
    requests = keys.groupBy("user_id").agg(F.sum("request_count").alias("requests"))
    cost = F.round(F.col("input_tokens") / 1e6 * 0.2 + F.col("output_tokens") / 1e6 * 15, 6)
    return requests.join(tokens, "user_id", "left").select("user_id", "requests", F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), F.coalesce(cost, F.lit(0.0)).alias("cost"), F.col("last_activity").cast("string").alias("last_activity"))


def with_errors(judged: DataFrame, failed: DataFrame) -> DataFrame:
    """Golden rows of a change that could not be run are errors; they stay in every denominator."""
    down = failed.select("pr_id").distinct().withColumn("down", F.lit(True))
    return judged.join(down, "pr_id", "left").withColumn("verdict", F.when(F.col("down"), "error").otherwise(F.col("verdict"))).drop("down")


def breakdowns(judged: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n, matches, strict recall in percent; ``high_critical`` is the part with those severities.

    One pass by grouping sets, one for each dimension.  Missing values are no group.
    """
    hc = F.when(F.col("severity").isin("critical", "high"), F.lit("yes"))
    names = [*dimensions, "high_critical"]
    rows = judged.withColumn("high_critical", hc).select("verdict", *(F.col(x).cast("string").alias(x) for x in names))
    sets = rows.groupingSets([[x] for x in names], *names)
    counts = sets.agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "match").alias("matches"))
    # the set of the i-th dimension has all bits but its own
    every = (1 << len(names)) - 1
    own = {x: every ^ (1 << (len(names) - 1 - i)) for i, x in enumerate(names)}
    pick = lambda of: F.coalesce(*(F.when(F.col("gid") == own[x], of(x)) for x in names))
    out = counts.select(pick(F.lit).alias("dimension"), pick(F.col).alias("value"), "n", "matches")
    return out.where("value IS NOT NULL").withColumn("recall", F.round(F.col("matches") / F.col("n") * 100, 6))


def findings_once(rows: DataFrame) -> DataFrame:
    """Findings of all changes, each (repo, pr) counted by its last row."""
    last = rows.groupBy("repo", "pr_id").agg(F.max_by("finding_count", "row_num").alias("finding_count"))
    return last.agg(F.coalesce(F.sum("finding_count"), F.lit(0)).alias("findings"), F.count(F.lit(1)).alias("changes"))


def keys_of(keys: DataFrame, user_id: int) -> DataFrame:
    """A user's keys in use, newest first."""
    return keys.where((F.col("user_id") == user_id) & ~F.col("revoked")).orderBy(F.desc("created_at"), F.desc("key_id"))


def review_of(reviews: DataFrame, review_id: int, user_id: int) -> DataFrame:
    """One review by id, for its owner only; no row otherwise."""
    return reviews.where((F.col("review_id") == review_id) & (F.col("user_id") == user_id))


def token_totals(calls: DataFrame) -> DataFrame:
    """Tokens in and out of each job over the calls that came back, validation included."""
    done = calls.where("ok")
    return done.groupBy("job_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("calls"))
