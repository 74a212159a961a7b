"""A data source over a repository that was written out with ``git fast-export``.

    spark.dataSource.register(ExportSource)
    spark.read.format("history_export").option("path", file).load()

Rows are those of a history table (seq, sha, file_path, old_file_path, status, before_content,
after_content): one for each file that a commit touches, against its first parent.  ``history.changed_files``
takes scopes of it.  The file must be where driver and executors can read it.

The driver walks the stream once, from command to command, and skips all contents by their stated
length; it keeps which content each path has on the branches that still go on.  Partitions are runs of
commits, and a task reads the contents that its rows need.  Filters on ``sha`` and ``file_path``
(equal, in) drop rows before partitions are made.  With ``--show-original-ids`` a commit's name is its
hash, else its mark.  Content that isn't text is null.  ``spark.sql.python.filterPushdown.enabled`` must be on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "seq long, sha string, file_path string, old_file_path string, status string, before_content string, after_content string"
#: Commits of one partition, unless the option ``commits`` says otherwise.
COMMITS = 500

Place = tuple[int, int]  # where a content begins, and its length


@dataclass
class Touched:
    seq: int
    sha: str
    path: str
    old_path: str | None
    status: str
    before: Place | None
    after: Place | None


class Part(InputPartition):
    def __init__(self, rows: list[Touched]):
        self.rows = rows


def path_of(raw: bytes) -> str:
    """A path of the stream; quoted ones have C escapes."""
    if raw.startswith(b'"') and raw.endswith(b'"'):
        plain = {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"a": b"\a", b"b": b"\b", b"f": b"\f", b"v": b"\v"}
        raw = re.sub(rb"\\([0-7]{3}|.)", lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else plain.get(m[1], m[1]), raw[1:-1])
    return raw.decode("utf-8", "replace")


def two_paths(raw: bytes) -> tuple[str, str]:
    """The old and the new path of a rename or copy."""
    found = re.match(rb'("(?:[^"\\]|\\.)*"|[^ ]+) (.*)$', raw, re.S)
    return path_of(found[1]), path_of(found[2])


class Walk:
    """One pass over the commands of a stream."""

    def __init__(self, path: str):
        self.path = path

    def commands(self) -> Iterator[tuple[bytes, bytes, Place | None]]:
        """(word, rest, place) of each command; for data the place of its content, which isn't read."""
        with open(self.path, "rb") as file:
            while line := file.readline():
                word, _, rest = line.rstrip(b"\n").partition(b" ")
                if word == b"data":
                    if rest.startswith(b"<<"):
                        begin, size, end = file.tell(), 0, rest[2:] + b"\n"
                        while (text := file.readline()) and text != end:
                            size += len(text)
                        yield word, b"", (begin, size)
                        continue
                    place = file.tell(), int(rest)
                    file.seek(place[1], 1)
                    yield word, b"", place
                elif word:
                    yield word, rest, None

    def touched(self) -> Iterator[Touched]:
        children = Counter(rest for word, rest, _ in self.commands() if word == b"from")
        heads: dict[bytes, bytes] = {}  # last commit of each branch
        trees: dict[bytes, dict[str, Place]] = {}  # by commit, as long as a child may come
        blobs: dict[bytes, Place] = {}
        mode = mark = ref = parent = inline = None
        name, seq, tree, rows = "", 0, {}, {}

        def note(path: str, after: Place | None, old_path: str | None = None, before: Place | None = None) -> None:
            nonlocal rows
            first = rows[path].before if path in rows else before if old_path else tree.get(path)
            old_path = rows[path].old_path if path in rows and not old_path else old_path
            status = "removed" if after is None else "renamed" if old_path else "added" if first is None else "changed"
            rows[path] = Touched(seq, name, path, old_path, status, first, after)

        def finish() -> Iterator[Touched]:
            nonlocal mode, rows
            if mode == b"commit":
                begin()
                yield from (r for r in rows.values() if r.before != r.after or r.old_path)
                if mark:
                    trees[mark] = tree
                heads[ref] = mark
            mode, rows = None, {}

        started = False

        def begin() -> None:
            """The tree of the first parent: its own if no other child needs it, else a copy."""
            nonlocal tree, started, seq
            if started:
                return
            started = True
            seq += 1
            source = parent if parent is not None else heads.get(ref) if children.get(heads.get(ref)) is None else None
            if source in trees:
                children[source] -= 1
                tree = trees.pop(source) if children[source] <= 0 else dict(trees[source])
            else:
                tree = {}

        for word, rest, place in self.commands():
            if word in (b"blob", b"commit", b"reset", b"tag", b"done"):
                yield from finish()
                mode, mark, parent, started, ref, name = word, None, None, False, rest, ""
            elif word == b"mark":
                mark = rest
                name = name or rest.decode()
            elif word == b"original-oid":
                name = rest.decode()
            elif word == b"data" and mode == b"blob":
                blobs[mark] = place
            elif word == b"data" and inline is not None:
                path, inline = inline, None
                note(path, place)
                tree[path] = place
            elif mode == b"commit" and word == b"from":
                parent = rest
            elif mode == b"commit" and word in (b"M", b"D", b"R", b"C", b"deleteall"):
                begin()
                if word == b"M":
                    kind, ref_, raw = rest.split(b" ", 2)
                    if kind in (b"160000", b"040000"):
                        continue
                    if ref_ == b"inline":
                        inline = path_of(raw)
                        continue
                    path = path_of(raw)
                    note(path, blobs.get(ref_))
                    tree[path] = blobs.get(ref_)
                elif word == b"deleteall":
                    for path in list(tree):
                        note(path, None)
                    tree.clear()
                elif word == b"D":
                    path = path_of(rest)
                    for known in [x for x in tree if x == path or x.startswith(f"{path}/")] if path not in tree else [path]:
                        note(known, None)
                        del tree[known]
                else:
                    old, new = two_paths(rest)
                    pairs = [(old, new)] if old in tree else [(x, new + x[len(old) :]) for x in tree if x.startswith(f"{old}/")]
                    for x, y in pairs:
                        content = tree[x] if word == b"C" else tree.pop(x)
                        note(y, content, *((x, content) if word == b"R" else ()))
                        tree[y] = content
        yield from finish()


class ExportReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("commits", COMMITS))
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for x in filters:
            values = {x.value} if isinstance(x, EqualTo) else set(x.value) if isinstance(x, In) else None
            column = x.attribute[0] if values is not None and len(x.attribute) == 1 else None
            if column in ("sha", "file_path"):
                self.only[column] = self.only.get(column, values) & values
            else:
                yield x

    def partitions(self) -> list[Part]:
        parts: list[list[Touched]] = []
        seen: dict[int, int] = {}
        for row in Walk(self.path).touched():
            if row.sha in self.only.get("sha", (row.sha,)) and row.path in self.only.get("file_path", (row.path,)):
                at = seen.setdefault(row.seq, len(seen)) // self.size
                if at == len(parts):
                    parts.append([])
                parts[at].append(row)
        return [Part(x) for x in parts]

    def read(self, partition: Part) -> Iterator[tuple]:
        with open(self.path, "rb") as file:

            def content(place: Place | None) -> str | None:
                if place is None:
                    return None
                file.seek(place[0])
                raw = file.read(place[1])
                try:
                    return None if b"\0" in raw else raw.decode()
                except UnicodeDecodeError:
                    return None

            for r in partition.rows:
                yield r.seq, r.sha, r.path, r.old_path, r.status, content(r.before), content(r.after)


class ExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "history_export"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExportReader:
        return ExportReader(self.options)
