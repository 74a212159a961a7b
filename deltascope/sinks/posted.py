"""A sink that sends each review to a host once, also when tasks or whole writes run again.

    spark.dataSource.register(PostedSink)
    payloads.write.format("review_posts").option("client", "package.module:Client").option("log", path).mode("append").save()

Rows are repo, number, payload.  A payload is known by a key, the SHA-256 of its repository,
number and text.  The client is a class made with the options; it has ``posted(repo, number)``, the keys that the host
has already, and ``post(repo, number, payload, key)``, which must leave the key where
``posted`` finds it (a hidden mark in the review's text, say).  A task asks before it
posts: what an earlier attempt sent is found there and not sent again.

After all tasks ``commit`` writes one line of totals to ``log``; a failed write leaves none, and its totals are
in a line of its own.  A post that fails doesn't stop the others; what failed is in the totals, and the
write fails at its end if ``fail_on_error`` is set.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MARK = "<!-- review {} -->"


def payload_key(repo: str, number: int, payload: str) -> str:
    return hashlib.sha256(f"{repo}\0{number}\0{payload}".encode()).hexdigest()


def marked(payload: str, key: str) -> str:
    """A payload whose review carries its key in a comment that readers don't see."""
    body = json.loads(payload)
    return json.dumps(body | {"body": f"{body.get('body') or ''}{MARK.format(key)}"})


@dataclass
class Sent(WriterCommitMessage):
    sent: int = 0
    known: int = 0
    failed: list[tuple[str, int, str]] = field(default_factory=list)


class PostedWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.log, self.strict = options.get("log"), str(options.get("fail_on_error", "false")).lower() == "true"

    def client(self):
        module, name = self.options["client"].split(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def write(self, iterator: Iterator) -> Sent:
        client, out = self.client(), Sent()
        there: dict[tuple[str, int], set[str]] = {}
        for row in iterator:
            repo, number, payload = row["repo"], int(row["number"]), row["payload"]
            key = payload_key(repo, number, payload)
            try:
                if (repo, number) not in there:
                    there = {(repo, number): set(client.posted(repo, number))}  # of one review at a time
                if key in there[repo, number]:
                    out.known += 1
                    continue
                client.post(repo, number, payload, key)
                there[repo, number].add(key)
                out.sent += 1
            except Exception as e:  # noqa: BLE001  the remote side may fail in any way
                out.failed.append((repo, number, str(e)))
        if out.failed and self.strict:
            raise RuntimeError(f"{len(out.failed)} reviews weren't sent: {out.failed[:3]}")
        return out

    def commit(self, messages: list[Sent | None]) -> None:
        self._note("committed", messages)

    def abort(self, messages: list[Sent | None]) -> None:
        self._note("aborted", messages)

    def _note(self, state: str, messages: list[Sent | None]) -> None:
        """One file for each write, complete or absent."""
        if not self.log:
            return
        done = [m for m in messages if m is not None]
        line = {"state": state, "at": time.time(), "tasks": len(done), "sent": sum(m.sent for m in done), "known": sum(m.known for m in done), "failed": [x for m in done for x in m.failed][:100]}
        os.makedirs(self.log, exist_ok=True)
        name = f"{self.log}/{uuid.uuid4().hex}"
        with open(f"{name}.part", "w", encoding="utf-8") as file:
            json.dump(line, file)
        os.replace(f"{name}.part", f"{name}.json")


class PostedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "review_posts"

    def schema(self) -> str:
        return "repo string, number long, payload string"

    def writer(self, schema, overwrite: bool) -> PostedWriter:
        return PostedWriter(self.options)
