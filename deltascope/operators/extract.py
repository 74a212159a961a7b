"""Entities of changed files: a hook for any extractor, and a plain outline as the default.

An extractor takes (path, text) and returns the entities of one file as
(name, kind, first line, last line, text).  It runs per row in ``mapInPandas``;
both sides of a file are compared there, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltascope.functions import lexing

Entity = tuple[str, str, int, int, str]
Extractor = Callable[[str, str], list[Entity]]
SCHEMA = "entity_id string, entity_name string, entity_type string, file_path string, change_type string, start_line long, end_line long, before_content string, after_content string, structural_change boolean, body_hash string"
#: Words that open an entity, and its kind.
OPENERS = {"def": "function", "fn": "function", "func": "function", "function": "function", "class": "class", "struct": "struct", "enum": "enum", "trait": "trait", "interface": "interface"}
_OPENING = re.compile(rf"^\s*(?:(?:pub(?:\([a-z]+\))?|export|default|async|static|public|private)\s+)*({'|'.join(OPENERS)})\s+([A-Za-z_][A-Za-z0-9_]*)")


def outline(path: str, text: str) -> list[Entity]:
    """Entities by their opening lines; one lasts up to the next of the same or lesser indentation.

    Nested ones are named by their owner: ``Owner::name``.
    """
    lines = text.split("\n")
    open_at: list[tuple[int, str, str, int]] = []  # indentation, name, kind, first line
    out: list[Entity] = []

    def close(depth: int, end: int) -> None:
        while open_at and open_at[-1][0] >= depth:
            _, name, kind, first = open_at.pop()
            last = end
            while last > first and not lines[last - 1].strip():
                last -= 1
            out.append((name, kind, first, last, "\n".join(lines[first - 1 : last])))

    for i, line in enumerate(lines, 1):
        found = _OPENING.match(line)
        if found:
            depth = len(line) - len(line.lstrip())
            close(depth, i - 1)
            owner = f"{open_at[-1][1]}::" if open_at else ""
            open_at.append((depth, owner + found[2], OPENERS[found[1]], i))
    close(-1, len(lines))
    return sorted(out, key=lambda e: (e[2], -e[3]))


#: Token shingles that an entity under a new name shares with the old one, of all that either has.
RENAMED_FROM = 0.6


class _Side:
    """One side of an entity; its tokens, and what renames are seen by, are made when they are asked for."""

    def __init__(self, entity: Entity, path: str):
        self.entity, self.path = entity, path

    @cached_property
    def tokens(self) -> list[str]:
        return lexing.tokens(self.entity[4], self.path)

    @cached_property
    def body(self) -> set:
        """Shingles of the tokens, the own name left out."""
        own = self.entity[0].split("::")[-1]
        return lexing.shingles(["\1" if x == own else x for x in self.tokens])

    def alike(self, other: _Side) -> float:
        both = len(self.body & other.body)
        return both / (len(self.body) + len(other.body) - both) if both else 0.0


def _most_alike(old: list[_Side], new: list[_Side], least: float) -> list[tuple[_Side, _Side]]:
    """Pairs of an old and a new side, the most alike first; each is in one pair at most.

    Only sides that share a shingle meet, through an index of the old ones.
    """
    index: dict[tuple, list[int]] = defaultdict(list)
    for i, x in enumerate(old):
        for part in x.body:
            index[part].append(i)
    found = []
    for j, y in enumerate(new):
        shared = Counter(i for part in y.body for i in index.get(part, ()))
        found += [(-both / (len(old[i].body) + len(y.body) - both), i, j) for i, both in shared.items()]
    pairs, gone, come = [], set(), set()
    for score, i, j in sorted(found):
        if -score >= least and i not in gone and j not in come:
            pairs.append((old[i], new[j]))
            gone.add(i)
            come.add(j)
    return pairs


def _pairs(old: list[_Side], new: list[_Side]) -> Iterator[tuple[_Side | None, _Side | None, bool]]:
    """(old, new, renamed): entities of one name and kind meet by equal text, likeness, then order; the rest by likeness."""
    by_name: dict[tuple, tuple[list[_Side], list[_Side]]] = defaultdict(lambda: ([], []))
    for at, sides in enumerate((old, new)):
        for x in sides:
            by_name[x.entity[:2]][at].append(x)
    gone: dict[str, list[_Side]] = defaultdict(list)
    come: dict[str, list[_Side]] = defaultdict(list)
    for (_, kind), (before, after) in by_name.items():
        for y in list(after):
            x = next((x for x in before if x.entity[4] == y.entity[4]), None)
            if x:
                before.remove(x), after.remove(y)
                yield x, y, False
        for x, y in _most_alike(before, after, 0.0) if len(before) > 1 or len(after) > 1 else []:
            before.remove(x), after.remove(y)
            yield x, y, False
        same = min(len(before), len(after))
        yield from ((x, y, False) for x, y in zip(before[:same], after[:same], strict=True))
        gone[kind] += before[same:]
        come[kind] += after[same:]
    for kind in {**come, **gone}:
        pairs = _most_alike(gone[kind], come[kind], RENAMED_FROM)
        yield from ((x, y, True) for x, y in pairs)
        taken = {id(side) for pair in pairs for side in pair}
        yield from ((None, y, False) for y in come[kind] if id(y) not in taken)
        yield from ((x, None, False) for x in gone[kind] if id(x) not in taken)


def _ids(path: str, sides: list[_Side]) -> dict[int, str]:
    """file::kind::name of each entity; further ones of a name and kind are numbered."""
    seen: Counter = Counter()
    out = {}
    for x in sides:
        seen[x.entity[:2]] += 1
        n = seen[x.entity[:2]]
        out[id(x)] = f"{path}::{x.entity[1]}::{x.entity[0]}" + (f"#{n}" if n > 1 else "")
    return out


def compare(path: str, before: str | None, after: str | None, extractor: Extractor, old_path: str | None = None) -> list[tuple]:
    """The entities that differ between two texts of a file; equal ones in a moved file are moved.

    A change is structural if the tokens differ: comments and white space don't count, what
    stands in strings does.
    """
    old = [_Side(e, old_path or path) for e in (extractor(old_path or path, before) if before else [])]
    new = [_Side(e, path) for e in (extractor(path, after) if after else [])]
    ids = _ids(path, new) | _ids(path, old)
    rows = []
    for x, y, renamed in _pairs(old, new):
        if y is None:
            e = x.entity
            rows.append((ids[id(x)], e[0], e[1], path, "deleted", e[2], e[3], e[4], None, None, lexing.token_hash(x.tokens)))
            continue
        e, change = y.entity, "renamed" if renamed else "modified" if x else "added"
        if x and x.entity[4] == e[4] and not renamed:
            if not old_path or old_path == path:
                continue
            change = "moved"
        rows.append((ids[id(y)], e[0], e[1], path, change, e[2], e[3], x.entity[4] if x else None, e[4], x.tokens != y.tokens if x else None, lexing.token_hash(y.tokens)))
    return sorted(rows, key=lambda r: (r[4] == "deleted", r[5], r[0]))


def moved_between(changed: DataFrame, keys: list[str]) -> DataFrame:
    """Entities deleted in one file and added with the same name, kind and tokens in another of the same change: moved.

    ``keys`` name a change.  Equal entities are paired in the order of their files.
    """
    same = [*keys, "entity_type", "entity_name", "body_hash"]
    nth = F.row_number().over(Window.partitionBy(*same, "change_type").orderBy("file_path", "start_line"))
    turn = changed.where(F.col("change_type").isin("added", "deleted")).withColumn("nth", nth)
    gone = turn.where("change_type = 'deleted'").select(*same, "nth", F.col("entity_id").alias("from_id"), F.col("before_content").alias("old_content"))
    come = turn.where("change_type = 'added'").select(*same, "nth", "entity_id")
    pairs = gone.join(come, [*same, "nth"]).select(*keys, "entity_id", "from_id", "old_content")
    rest = changed.join(pairs.select(*keys, F.col("from_id").alias("entity_id"), F.lit(True).alias("left")), [*keys, "entity_id"], "left").where(~(F.coalesce("left", F.lit(False)) & (F.col("change_type") == "deleted"))).drop("left")
    rows = rest.join(pairs.drop("from_id"), [*keys, "entity_id"], "left")
    here = F.col("old_content").isNotNull() & (F.col("change_type") == "added")
    rows = rows.withColumns({"before_content": F.when(here, F.col("old_content")).otherwise(F.col("before_content")), "structural_change": F.when(here, F.lit(False)).otherwise(F.col("structural_change")), "change_type": F.when(here, "moved").otherwise(F.col("change_type"))})
    return rows.select(*changed.columns)


def _mapped(files: DataFrame, columns: list[str], keys: list[str], schema: str, rows_of: Callable[[dict], list[tuple]], skip: bool) -> DataFrame:
    """``rows_of`` each file in ``mapInPandas``, with its keys before them; a file it fails on stops the job, or with ``skip`` has no rows."""
    kinds = {x: files.schema[x].dataType.simpleString() for x in keys}
    names = [*keys, *(x.split(" ")[0] for x in schema.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                try:
                    rows += [(*(row[x] for x in keys), *made) for made in rows_of(row)]
                except Exception as e:  # noqa: BLE001  extractors are foreign code
                    if not skip:  # Spark's messages leave causes out
                        at = ", ".join(f"{x}={row[x]!r}" for x in (*keys, "file_path"))
                        raise RuntimeError(f"no entities could be taken from {at}: {e!r}") from e
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({x: "int64" for x in ("start_line", "end_line")} | ({"structural_change": "object"} if "structural_change" in names else {}))

    return files.select(*keys, *columns).mapInPandas(run, ", ".join([*(f"`{x}` {k}" for x, k in kinds.items()), schema]))


def changed_entities(files: DataFrame, extractor: Extractor = outline, keys: list[str] | None = None, skip_failed: bool | None = None) -> DataFrame:
    """The changed entities of ``files`` (file_path, before_content, after_content, and old_file_path if moved).

    ``keys`` are columns that name the change a file belongs to; they stay.  A file that fails stops the
    job with an error that names it, since without rows it would look unchanged.  With ``skip_failed``, the
    default for an extractor other than the outline, it has no entities; reviews never skip.
    """
    skip = extractor is not outline if skip_failed is None else skip_failed
    columns = ["file_path", "before_content", "after_content", *(["old_file_path"] if "old_file_path" in files.columns else [])]
    return _mapped(files, columns, keys or [], SCHEMA, lambda row: compare(row["file_path"] or "", row["before_content"], row["after_content"], extractor, row.get("old_file_path")), skip)


def entities(files: DataFrame, extractor: Extractor = outline, keys: list[str] | None = None) -> DataFrame:
    """All entities of ``files`` (file_path, content): what a dependency graph is made of.  A file that fails stops the job."""

    def of(row: dict) -> list[tuple]:
        path = row["file_path"] or ""
        sides = [_Side(e, path) for e in extractor(path, row["content"] or "")]
        ids = _ids(path, sides)
        return [(ids[id(x)], x.entity[0], x.entity[1], path, x.entity[2], x.entity[3], x.entity[4], sorted({t for t in x.tokens if _WORD.fullmatch(t)})) for x in sides]

    return _mapped(files, ["file_path", "content"], keys or [], "entity_id string, entity_name string, entity_type string, file_path string, start_line long, end_line long, content string, words array<string>", of, False)


_WORD = re.compile(r"[^\W\d]\w*")
