"""Operators on the dependency graph: edges (src, dst), src depends on dst.

The loops work on short rows, cut lineage by reliable checkpoints each round and
stop on counts; nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltascope.functions import predicates as p
from deltascope.operators.skew import SALTS, merged
from deltascope.sources.tables import contained, cut, global_rank

#: Transitive dependents are counted up to this many.
BLAST_CAP = 10_000


def dependents(edges: DataFrame) -> DataFrame:
    """entity_id, dependent_count: direct dependents of each entity."""
    return edges.groupBy(F.col("dst").alias("entity_id")).agg(F.count(F.lit(1)).alias("dependent_count"))


def dependencies(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("entity_id")).agg(F.count(F.lit(1)).alias("dependency_count"))


def changed_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with both ends changed.  Give ``edges`` as a table (``cut``), else the tests move down into what makes them."""
    ids = changes.select("entity_id").distinct()
    return edges.join(merged(ids.withColumnRenamed("entity_id", "src")), "src", "left_semi").join(merged(ids.withColumnRenamed("entity_id", "dst")), "dst", "left_semi").select("src", "dst")


#: Least hashes of its reach that each node keeps: fewer are the whole reach.
SKETCH = 64


@contained
def blast_radius(edges: DataFrame, changes: DataFrame, cap: int = BLAST_CAP, k: int = SKETCH) -> DataFrame:
    """entity_id, blast_radius: distinct transitive dependents, the start excluded, capped.

    Every node gathers the ``k`` least hashes of what it reaches, from its neighbours, until
    nothing changes: the rows are ``k`` a node at most, cycles or not.  Where there are fewer than ``k``,
    they are the whole reach.  Only the rest is counted one by one, and there cycles are one
    node each, and what reaches something over the cap is over it too (see ``_large``).
    """
    named = edges.select("src", "dst").where("src <> dst").distinct()
    step = cut(named.select(F.xxhash64("dst").alias("at"), F.xxhash64("src").alias("next")))
    origins = cut(changes.select("entity_id").distinct().select("entity_id", F.xxhash64("entity_id").alias("node")))
    sketch = _sketches(step, k)
    sizes = cut(sketch.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    counts = sizes.where(F.col("n") < k)
    big = sizes.where(F.col("n") >= k).select("node")
    if not big.isEmpty():
        counts = counts.unionByName(_large(step, sketch, cut(big), origins, cap, k))
    return origins.join(merged(counts), "node").select("entity_id", F.least("n", F.lit(cap)).alias("blast_radius"))


def _sketches(step: DataFrame, k: int) -> DataFrame:
    """(node, item): the ``k`` least nodes by hash that each node reaches, itself not among them."""
    least = F.row_number().over(Window.partitionBy("node").orderBy("item"))
    kept = fresh = cut(step.select(F.col("at").alias("node"), F.col("next").alias("item")).distinct().withColumn("rank", least).where(F.col("rank") <= k).select("node", "item"))
    while not fresh.isEmpty():
        come = fresh.select(F.col("node").alias("next"), "item").join(merged(step), "next").select(F.col("at").alias("node"), "item").where("node <> item").distinct()
        both = come.withColumn("new", F.lit(1)).unionByName(kept.withColumn("new", F.lit(0))).groupBy("node", "item").agg(F.min("new").alias("new"))
        step_on = cut(both.withColumn("rank", least).where(F.col("rank") <= k).select("node", "item", "new"))
        kept, fresh = step_on.select("node", "item"), step_on.where("new = 1").select("node", "item")
    return kept


def _spread(start: DataFrame, step: DataFrame) -> DataFrame:
    """(node): all that ``start`` (node) reaches over ``step`` (at, next), itself included; a row a node."""
    seen = fresh = cut(start.select("node").distinct())
    while not fresh.isEmpty():
        fresh = cut(fresh.join(step, F.col("node") == F.col("at")).select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(fresh)
    return seen


def _cycles(step: DataFrame, sketch: DataFrame, big: DataFrame, k: int) -> DataFrame:
    """(node, comp): the large nodes, those of one cycle under the name of one of them.

    Nodes of a cycle reach the same, so their sketches (with themselves) are equal; in each set of nodes with
    one sketch, those that its least node reaches and that reach it are a cycle.  Others keep their own name.
    """
    own = sketch.join(big, "node", "left_semi").unionByName(big.select("node", F.col("node").alias("item")))
    same = own.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("item")), 1, k).alias("items")).select("node", F.xxhash64("items").alias("mark"))
    same = cut(same)
    pivots = cut(same.groupBy("mark").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", "node"))
    a, b = same.select(F.col("node").alias("at"), F.col("mark").alias("x")), same.select(F.col("node").alias("next"), F.col("mark").alias("y"))
    inside = cut(step.join(a, "at").join(b, "next").where("x = y").select("at", "next"))
    forward = _spread(pivots, inside)
    backward = _spread(pivots, inside.select(F.col("next").alias("at"), F.col("at").alias("next")))
    ring = forward.join(backward, "node", "left_semi").join(same, "node").join(pivots.select("mark", F.col("node").alias("comp")), "mark").select("node", "comp")
    return cut(big.join(ring, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))


def _large(step: DataFrame, sketch: DataFrame, big: DataFrame, origins: DataFrame, cap: int, k: int) -> DataFrame:
    """(node, n): the reach of the large nodes, at least ``cap`` where it is that much.

    Each cycle is one place with a size.  A sketch also tells about how much a place reaches:
    of those that seem to pass the cap, the last ones on the way (with none such behind them) are
    walked first, and what leads to a place found full is full without a walk.
    """
    comp = _cycles(step, sketch, big, k)
    of = lambda df, x: df.join(comp.select(F.col("node").alias(x), F.col("comp").alias("c")), x, "left").withColumn(x, F.coalesce("c", x)).drop("c")
    paths = cut(of(of(step, "at"), "next").where("at <> next").distinct())
    size = cut(comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).select(F.col("comp").alias("item"), "size"))
    # the k-th least of n even hashes stands at about k / n of the range
    last = sketch.join(big, "node", "left_semi").groupBy("node").agg(F.max("item").alias("top"))
    share = (F.col("top") / F.lit(2.0**64)) + 0.5
    seems = cut(last.join(comp, "node").groupBy("comp").agg(F.max(F.lit(float(k - 1)) / share).alias("about")).select(F.col("comp").alias("node"), (F.col("about") >= cap).alias("wide")))
    wanted = cut(comp.join(origins.select("node"), "node", "left_semi").select(F.col("comp").alias("node")).distinct())
    back = paths.select(F.col("next").alias("at"), F.col("at").alias("next"))
    full = cut(seems.where("false").select("node"))
    found = cut(seems.where("false").select("node", F.lit(0).cast("long").alias("n")))
    todo = cut(seems.where("wide").select("node"))
    while not todo.isEmpty():
        ahead = paths.join(todo.select(F.col("node").alias("next")), "next", "left_semi").select(F.col("at").alias("node"))
        first = todo.join(ahead, "node", "left_anti")
        first = cut(todo if first.isEmpty() else first)  # a cycle of places: all of them
        walked = _walk(first, paths, size, full, cap)
        full = cut(_spread(full.unionByName(walked.where(F.col("n") >= cap).select("node")), back))
        found = cut(found.unionByName(walked))
        todo = cut(todo.join(full, "node", "left_anti").join(found, "node", "left_anti"))
    rest = cut(wanted.join(full, "node", "left_anti").join(found, "node", "left_anti"))
    known = found.join(full, "node", "left_anti").unionByName(_walk(rest, paths, size, full, cap)).unionByName(full.select("node", F.lit(cap).cast("long").alias("n")))
    one = known.groupBy("node").agg(F.max("n").alias("n")).select(F.col("node").alias("comp"), "n")
    return comp.join(one, "comp").select("node", "n")


def _walk(starts: DataFrame, paths: DataFrame, size: DataFrame, full: DataFrame, cap: int) -> DataFrame:
    """(node, n): how much each start reaches, itself not counted; a start leaves the walk at the cap or where it meets a full place."""
    count = F.sum(F.coalesce("size", F.lit(1))).alias("n")
    reached = fresh = cut(starts.select("node", F.col("node").alias("item")))
    over = cut(starts.where("false").select("node"))
    while True:
        near = fresh.join(paths, F.col("item") == F.col("at")).select("node", F.col("next").alias("item")).distinct().join(reached, ["node", "item"], "left_anti")
        fresh = cut(near)
        if fresh.isEmpty():
            break
        reached = reached.unionByName(fresh)
        met = fresh.join(full.select(F.col("node").alias("item")), "item", "left_semi").select("node")
        much = reached.join(size, "item", "left").groupBy("node").agg(count).where(F.col("n") > cap).select("node")
        over = cut(over.unionByName(met.unionByName(much)).distinct())
        fresh = fresh.join(over, "node", "left_anti")
    n = reached.join(size, "item", "left").groupBy("node").agg(count).join(over.withColumn("over", F.lit(True)), "node", "left")
    return cut(n.select("node", F.when(F.col("over"), F.greatest(F.col("n") - 1, F.lit(cap))).otherwise(F.col("n") - 1).alias("n")))


@contained
def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """entity_id, component: the least id connected with it, directions ignored.

    Min-label propagation with pointer jumping: rounds grow with the logarithm of
    the longest path.
    """
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct())
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")))
    while True:
        near = both.join(merged(label.select(F.col("a").alias("b"), "c")), "b").groupBy("a").agg(F.min("c").alias("near"))
        low = label.join(merged(near), "a").select("a", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        for _ in range(2):  # two jumps a round, over the labels known at its beginning
            up = label.select(F.col("a").alias("c"), F.col("c").alias("up"))
            low = low.join(merged(up), "c").select("a", "old", F.least("c", "up").alias("c"))
        new = cut(low)
        moved = not new.where("c <> old").isEmpty()
        label = new.select("a", "c")
        if not moved:
            break
    own = nodes.select("entity_id").distinct()
    return own.join(merged(label), F.col("entity_id") == F.col("a"), "left").select("entity_id", F.coalesce("c", "entity_id").alias("component"))


def groups(reviews: DataFrame, membership: DataFrame) -> DataFrame:
    """component, group_id, label, size: independent groups of changes, largest first.

    The label is the only member's name, else the folder (or raw prefix) all paths
    share, else the number of entities.  Least and greatest path give the prefix.
    """
    rows = reviews.join(merged(membership), "entity_id")
    agg = rows.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("review_rank", "entity_name")).alias("first"), F.min("file_path").alias("lo"), F.max("file_path").alias("hi"))
    shorter = F.least(F.length("lo"), F.length("hi"))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda k: F.substring("lo", k, F.lit(1)) != F.substring("hi", k, F.lit(1)))
    prefix = F.substring("lo", F.lit(1), F.least(F.coalesce(F.array_min(differ) - 1, shorter), shorter))
    cut_at = F.when(prefix.contains("/"), F.regexp_extract(prefix, "^(.*/)", 1)).otherwise(prefix)
    label = F.when(F.col("size") == 1, F.col("first.entity_name")).when(cut_at != "", cut_at).otherwise(F.concat(F.col("size").cast("string"), F.lit(" entities")))
    named = agg.select("component", "size", label.alias("label"), F.col("first.review_rank").alias("rank"))
    return global_rank(named, [F.desc("size"), "rank"], "number").select("component", (F.col("number") - 1).alias("group_id"), "label", "size")


def neighbours(edges: DataFrame, entities: DataFrame, incoming: bool, limit: int | None = None) -> DataFrame:
    """entity_id and its neighbours as an array of (name, file), by name: dependents if ``incoming``, else dependencies.

    With a ``limit`` only that many are gathered of each entity, first in each of SALTS parts of it,
    so that a hub is a short row and no task ranks all its edges.
    """
    here, there = ("dst", "src") if incoming else ("src", "dst")
    other = entities.select(F.col("entity_id").alias(there), F.col("entity_name").alias("name"), F.col("file_path").alias("file"))
    rows = edges.select("src", "dst").distinct().join(other, there)
    if limit is not None:
        rows = rows.withColumn("part", F.pmod(F.xxhash64(there), F.lit(SALTS)))
        for own in ([here, "part"], [here]):
            rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*own).orderBy("name", "file", there))).where(F.col("rn") <= limit)
    return rows.groupBy(F.col(here).alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct("name", "file"))).alias("neighbours"))


def with_lines(changes: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds start_line and end_line of the entity in the graph; 0 where it isn't there."""
    lines = entities.groupBy("entity_id").agg(F.min("start_line").alias("start_line"), F.min_by("end_line", "start_line").alias("end_line"))
    rows = changes.join(lines, "entity_id", "left")
    return rows.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("start_line", "end_line")})


def find(reviews: DataFrame, name: str, path_suffix: str = "") -> DataFrame:
    """The first entity of that name in review order, in a file that ends so; no row if there is none."""
    rows = reviews.where((F.col("entity_name") == name) & F.col("file_path").endswith(path_suffix))
    return rows.orderBy(F.desc("risk_score"), "change_seq").limit(1)


def lookup(entities: DataFrame, name: str, path_part: str = "") -> DataFrame:
    """Entities of that name, or members of it, in files whose path contains ``path_part``."""
    return entities.where(p.named(F.col("entity_name"), name) & F.col("file_path").contains(path_part))


def references(entities: DataFrame) -> DataFrame:
    """(src, dst): entities whose content has another one's name as a word; the edges of a graph.

    Words meet names by an equi join; a name borne by several entities leads to
    the one with the least id.
    """
    names = entities.where(F.coalesce("entity_name", F.lit("")) != "").groupBy(F.col("entity_name").alias("word")).agg(F.min("entity_id").alias("dst"))
    words = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0)))
    return entities.select(F.col("entity_id").alias("src"), words.alias("word")).join(names, "word").where("src <> dst").select("src", "dst").distinct()
