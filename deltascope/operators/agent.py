"""An agent that challenges candidate findings with lookups, and the cache of its last result.

``challenge_all`` runs the agents of many changes at once: each round asks all that are still open, in
their tasks, and answers all their lookups by joins.  ``challenge`` is the same for one change at the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltascope.operators import diff, graph
from deltascope.sources.tables import contained, cut

STEPS, MANY, MANY_STEPS = 25, 20, 50
LISTED, SHOWN = 15, 20


class Tools:
    """Lookups on one change: entities (with content), edges, files."""

    def __init__(self, entities: DataFrame, edges: DataFrame, files: DataFrame):
        self.entities, self.edges, self.files = entities, edges, files

    def entity(self, name: str, file: str = "") -> str:
        rows = graph.lookup(self.entities, name, file).orderBy("file_path", "entity_name").limit(LISTED).collect()
        return "\n\n".join(f"{r.entity_name} ({r.file_path})\n{(r.content or '')[:2000]}" for r in rows) or "not found"

    def dependents(self, name: str) -> str:
        return self._around(name, incoming=True)

    def dependencies(self, name: str) -> str:
        return self._around(name, incoming=False)

    def search(self, pattern: str) -> str:
        rows = diff.first_matches(diff.grep(self.files, pattern), SHOWN).collect()
        return "\n".join(f"{r.file}:{r.line}:{r.text}" for r in rows) or "no matches"

    def file(self, path: str) -> str:
        row = self.files.where(F.col("file").contains(path)).orderBy("file").first()
        return (row.text or "")[:3000] if row else "not found"

    def _around(self, name: str, incoming: bool) -> str:
        ids = graph.lookup(self.entities, name).select("entity_id")
        rows = graph.neighbours(self.edges, self.entities, incoming, LISTED).join(ids, "entity_id", "left_semi").orderBy("entity_id").collect()
        return "\n".join(f"{x['name']} ({x['file']})" for r in rows for x in r.neighbours) or "none"


def parse_step(text: str) -> dict:
    """One JSON object: {"tool": name, "args": {...}} or {"keep": [1, 2]}; anything else is no step."""
    try:
        step = json.loads(text[text.index("{") : text.rindex("}") + 1])
    except ValueError:
        return {}
    return step if isinstance(step, dict) else {}


def challenge(candidates: list[str], ask: Callable[[list[str]], str], tools: Tools) -> list[str]:
    """The candidates that the agent keeps, in its order; all of them if it fails or never answers."""
    said = ["\n".join(f"{i}. {x}" for i, x in enumerate(candidates, 1))]
    try:
        for _ in range(MANY_STEPS if len(candidates) > MANY else STEPS):
            step = parse_step(ask(said))
            if "keep" in step:
                return [candidates[i - 1] for i in step["keep"] if isinstance(i, int) and 1 <= i <= len(candidates)]
            name = step.get("tool")
            known = name in ("entity", "dependents", "dependencies", "search", "file")
            said.append(getattr(tools, name)(**step.get("args", {})) if known else "unknown step")
    except Exception:  # noqa: BLE001  the remote side may fail in any way
        return candidates
    return candidates


# ---------------------------------------------------------------- many changes at once

TOOLS = ("entity", "dependents", "dependencies", "search", "file")
_OPEN = "pr_id {}, candidates array<string>, said array<string>, tool string, name string, file string, keep array<long>, failed boolean"


def _asked(ask: Callable[[list[str]], str], schema: str):
    """One step of each open agent: a lookup, or what it keeps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for pr, candidates, said in zip(frame["pr_id"], frame["candidates"], frame["said"], strict=True):
                step, failed = {}, False
                try:
                    step = parse_step(ask(list(said)))
                except Exception:  # noqa: BLE001  the remote side may fail in any way
                    failed = True
                args = step.get("args") if isinstance(step.get("args"), dict) else {}
                keep = [i for i in step["keep"] if isinstance(i, int) and not isinstance(i, bool) and 1 <= i <= len(candidates)] if isinstance(step.get("keep"), list) else None
                name = next((str(args[x]) for x in ("name", "pattern", "path") if x in args), "")
                rows.append((pr, list(candidates), list(said), str(step.get("tool", "")), name, str(args.get("file", "")), keep, failed))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in schema.split(", ")])

    return run


def _listed(rows: DataFrame, order: list[str], limit: int, text) -> DataFrame:
    """pr_id, answer: the first rows of each change as lines."""
    nth = F.row_number().over(Window.partitionBy("pr_id").orderBy(*order))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= limit)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("nth", text.alias("text")))), lambda x: x["text"])
    return few.groupBy("pr_id").agg(lines.alias("lines"))


def _answers(asked: DataFrame, entities: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """pr_id, answer of every lookup, by joins on the change and on whole names."""
    join = lambda x, sep: x.select("pr_id", F.array_join("lines", sep).alias("answer"))
    wanted = lambda *tools: asked.where(F.col("tool").isin(*tools)).select("pr_id", "tool", F.col("name").alias("wanted"), F.col("file").alias("part"))
    # an entity answers to its name and to each end of it after :: or .
    parts = F.split("entity_name", r"::|\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.element_at(F.regexp_extract_all("entity_name", F.concat(F.lit(r"((?:[^:.]+(?:::|\.)){"), (F.size(parts) - n).cast("string"), F.lit(r"}[^:.]+)$")), 1), 1))
    known = entities.withColumn("wanted", F.explode(F.array_distinct(F.concat(F.array("entity_name"), F.filter(ends, lambda x: x.isNotNull())))))
    met = known.join(wanted("entity", "dependents", "dependencies"), ["pr_id", "wanted"])
    shown = met.where("tool = 'entity'").where(F.col("file_path").contains(F.col("part")))
    text = F.concat("entity_name", F.lit(" ("), "file_path", F.lit(")\n"), F.left(F.coalesce("content", F.lit("")), F.lit(2000)))
    out = [join(_listed(shown, ["file_path", "entity_name"], LISTED, text), "\n\n")]
    for tool, here, there in (("dependents", "dst", "src"), ("dependencies", "src", "dst")):
        ids = met.where(F.col("tool") == tool).select("pr_id", F.col("entity_id").alias(here))
        other = entities.select("pr_id", F.col("entity_id").alias(there), F.col("entity_name").alias("near"), F.col("file_path").alias("near_file"))
        rows = edges.join(ids, ["pr_id", here]).join(other, ["pr_id", there]).select("pr_id", here, "near", "near_file").distinct()
        out.append(join(_listed(rows, ["near", "near_file", here], LISTED, F.concat("near", F.lit(" ("), "near_file", F.lit(")"))), "\n"))
    texts = files.join(wanted("search"), "pr_id").where(F.contains(F.lower("text"), F.lower("wanted")))
    lines = texts.select("pr_id", "file", "wanted", F.posexplode(F.split("text", "\n")).alias("k", "line")).where(F.contains(F.lower("line"), F.lower("wanted")))
    out.append(join(_listed(lines, ["file", "k"], SHOWN, F.concat("file", F.lit(":"), (F.col("k") + 1).cast("string"), F.lit(":"), "line")), "\n"))
    found = files.join(wanted("file"), "pr_id").where(F.col("file").contains(F.col("wanted")))
    out.append(found.groupBy("pr_id").agg(F.left(F.coalesce(F.min_by("text", "file"), F.lit("")), F.lit(3000)).alias("answer")))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    none = F.when(F.col("tool").isin("entity", "file"), "not found").when(F.col("tool") == "search", "no matches").when(F.col("tool").isin(*TOOLS), "none").otherwise("unknown step")
    return asked.select("pr_id", "tool").join(rows, "pr_id", "left").select("pr_id", F.coalesce("answer", none).alias("answer"))


@contained
def challenge_all(changes: DataFrame, ask: Callable[[list[str]], str], entities: DataFrame, edges: DataFrame, files: DataFrame, steps: int = STEPS, many_steps: int = MANY_STEPS) -> DataFrame:
    """pr_id, kept (texts in the agent's order), steps: what the agents of all changes keep.

    changes: pr_id, candidates; entities: pr_id, entity_id, entity_name, file_path, content;
    edges: pr_id, src, dst; files: pr_id, file, text.  An agent that fails or never answers keeps all its
    candidates.  One that has more than MANY of them has more steps.
    """
    kind = changes.schema["pr_id"].dataType.simpleString()
    schema = _OPEN.format(kind)
    first = F.array_join(F.transform("candidates", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    left = cut(changes.select("pr_id", "candidates").withColumn("said", F.array(first)))
    done = []
    for n in range(1, max(steps, many_steps) + 1):
        asked = cut(left.mapInPandas(_asked(ask, schema), schema))
        last = n >= F.when(F.size("candidates") > MANY, many_steps).otherwise(steps)
        ends = F.col("keep").isNotNull() | F.col("failed") | last
        kept = F.when(F.col("keep").isNotNull(), F.transform("keep", lambda i: F.element_at("candidates", i.cast("int")))).otherwise(F.col("candidates"))
        done.append(asked.where(ends).select("pr_id", kept.alias("kept"), F.lit(n).alias("steps")))
        going = asked.where(~ends)
        if going.isEmpty():
            break
        left = cut(going.join(_answers(going, entities, edges, files), "pr_id").select("pr_id", "candidates", F.concat("said", F.array("answer")).alias("said")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


class LastResult:
    """The result of the last (repo, target): asked for again it isn't computed again."""

    def __init__(self) -> None:
        self.key: tuple[str, str] | None = None
        self.rows: DataFrame | None = None

    def get(self, repo: str, target: str, compute: Callable[[], DataFrame]) -> DataFrame:
        if self.key != (repo, target):
            if self.rows is not None:
                self.rows.unpersist()
            self.key, self.rows = (repo, target), compute().persist()
        return self.rows
