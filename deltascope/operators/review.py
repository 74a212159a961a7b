"""One review of a change: from changed files to scored, ranked and grouped entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.functions import scoring as s
from deltascope.operators import extract, graph, symbols, triage
from deltascope.operators.skew import merged
from deltascope.sources.tables import cut

COLUMNS = ["entity_id", "entity_name", "entity_type", "file_path", "change_type", "classification", "risk_score", "risk_level", "risk_rank", "blast_radius", "dependent_count", "dependency_count", "is_public_api", "structural_change", "group_id", "group_label", "review_rank", "start_line", "end_line", "before_content", "after_content"]


def classified(changed: DataFrame) -> DataFrame:
    """Adds the class of each change, from its old and new text."""
    return changed.withColumn("classification", s.classify(F.col("before_content"), F.col("after_content"), F.col("structural_change")))


def review_entities(changed: DataFrame, edges: DataFrame | None = None, total: int = 0) -> DataFrame:
    """Reviews of changed entities, riskiest first: class, graph signals, public API, score, level, group.

    ``changed`` is what ``extract.changed_entities`` gives; ``edges`` (src, dst) and ``total`` are the graph of
    the whole repository.  ``changed`` is read once.  Without a graph, scores rest on class, kind of change and publicity alone.
    """
    spark = changed.sparkSession
    if edges is None:
        edges = spark.range(0).selectExpr("string(id) AS src", "string(id) AS dst")
    edges = cut(edges)
    # what stands in the texts is read once; they stay behind and meet their entities by row number at the end
    read = {"change_seq": F.struct("file_path", "start_line", "entity_id"), "is_public_api": triage.public(changed), "row__": F.monotonically_increasing_id()}
    rows = cut(classified(changed).withColumns(read))
    texts = rows.select("row__", "before_content", "after_content")
    rows = cut(triage.score(rows.drop("before_content", "after_content"), edges, total))
    ranked = triage.ranked(rows)
    ranked = cut(ranked)
    members = graph.components(ranked, graph.changed_edges(edges, ranked))
    groups = graph.groups(ranked, members).select("component", "group_id", F.col("label").alias("group_label"))
    placed = ranked.join(merged(members), "entity_id").join(merged(groups), "component").join(merged(texts), "row__", "left")
    return placed.select(*COLUMNS).orderBy("review_rank")


def review_change(files: DataFrame, edges: DataFrame | None = None, total: int = 0, extractor: extract.Extractor = extract.outline) -> DataFrame:
    """Reviews of the entities that differ between the two sides of ``files`` (file_path, before_content, after_content).

    A file that the extractor fails on is an error: without it, the review would seem whole.
    """
    return review_entities(extract.changed_entities(files, extractor, skip_failed=False), edges, total)


def review_repository(files: DataFrame, repository: DataFrame, extractor: extract.Extractor = extract.outline) -> DataFrame:
    """``review_change`` against the graph of all files (file_path, content) of the repository after the change.

    Start and end lines are those of the graph, 0 for entities that it doesn't have.
    """
    known = cut(extract.entities(repository, extractor))
    edges = cut(symbols.scoped_edges(known, symbols.imports(repository)).select("src", "dst"))
    reviews = review_change(files, edges, known.count(), extractor)
    return graph.with_lines(reviews.drop("start_line", "end_line"), known).select(*COLUMNS).orderBy("review_rank")
