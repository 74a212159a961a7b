"""A data source for the API of a code host: pull requests, their files, raw diffs, contents, code search.

    spark.dataSource.register(HostSource)
    spark.read.format("review_host").option("kind", "files").option("requests", "o/r#12,o/r#13").option("fixture", path).load()

``requests`` names what is asked, one partition each: repo#number for ``pulls``,
``files`` and ``diff``; repo@ref:path for ``contents``; repo?words or
repo?words&prefix for ``search``.  Answers come from ``url`` (with ``token``), or offline from
a folder ``fixture`` in which each answer is a file named after its request.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "pulls": "repo string, number long, title string, body string, state string, additions long, deletions long, changed_files long, head_ref string, base_ref string, head_sha string, base_sha string",
    "files": "repo string, number long, filename string, status string, additions long, deletions long, patch string",
    "diff": "repo string, number long, diff string",
    "contents": "repo string, ref string, path string, content string",
    "search": "repo string, file string, fragment int, text string",
}
#: Hits that a search takes, and files on one page.
SEARCH_HITS, PAGE = 100, 100


class Request(InputPartition):
    def __init__(self, text: str):
        self.text = text


class HostError(RuntimeError):
    """The host refused or failed."""


def file_name(request: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "-", request).strip("-")


class Client:
    """Answers as text, from the network or from files."""

    def __init__(self, options: dict):
        self.fixture, self.url, self.token = options.get("fixture"), options.get("url", "https://api.github.com"), options.get("token")

    def get(self, path: str, accept: str = "application/json") -> str:
        if self.fixture:
            try:
                with open(f"{self.fixture}/{file_name(path)}", encoding="utf-8") as file:
                    return file.read()
            except FileNotFoundError as e:
                raise HostError(path) from e
        import urllib.request

        headers = {"Accept": accept} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.url}/{path}", headers=headers), timeout=60) as answer:  # noqa: S310
                return answer.read().decode()
        except OSError as e:
            raise HostError(f"{path}: {e}") from e


class HostReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.kind = options, options.get("kind", "pulls")

    def partitions(self) -> list[Request]:
        return [Request(x.strip()) for x in self.options.get("requests", "").split(",") if x.strip()]

    def read(self, partition: Request) -> Iterator[tuple]:
        return getattr(self, f"_{self.kind}")(Client(self.options), partition.text)

    def _pulls(self, client: Client, text: str) -> Iterator[tuple]:
        repo, number = text.split("#")
        x = json.loads(client.get(f"repos/{repo}/pulls/{number}"))
        head, base = x.get("head") or {}, x.get("base") or {}
        yield repo, int(number), x.get("title") or "", x.get("body"), x.get("state") or "", *(int(x.get(k) or 0) for k in ("additions", "deletions", "changed_files")), head.get("ref") or "", base.get("ref") or "", head.get("sha") or "", base.get("sha") or ""

    def _files(self, client: Client, text: str) -> Iterator[tuple]:
        """All pages, one after another: the next one is asked for until one isn't full."""
        repo, number = text.split("#")
        page = 1
        while True:
            rows = json.loads(client.get(f"repos/{repo}/pulls/{number}/files?per_page={PAGE}&page={page}"))
            for x in rows:
                yield repo, int(number), x["filename"], x.get("status") or "modified", int(x.get("additions") or 0), int(x.get("deletions") or 0), x.get("patch")
            if len(rows) < PAGE:
                return
            page += 1

    def _diff(self, client: Client, text: str) -> Iterator[tuple]:
        repo, number = text.split("#")
        yield repo, int(number), client.get(f"repos/{repo}/pulls/{number}.diff", "application/vnd.github.v3.diff")

    def _contents(self, client: Client, text: str) -> Iterator[tuple]:
        """A file that can't be delivered or decoded gives no row."""
        repo, rest = text.split("@", 1)
        ref, path = rest.split(":", 1)
        try:
            x = json.loads(client.get(f"repos/{repo}/contents/{path}?ref={ref}"))
            yield repo, ref, path, base64.b64decode(x["content"]).decode()
        except (HostError, ValueError, KeyError, TypeError):
            return

    def _search(self, client: Client, text: str) -> Iterator[tuple]:
        repo, words = text.split("?", 1)
        words, _, prefix = words.partition("&")
        from urllib.parse import quote

        q = f"{words} repo:{repo}" + (f" path:{prefix}" if prefix else "")
        x = json.loads(client.get(f"search/code?q={quote(q)}&per_page={SEARCH_HITS}", "application/vnd.github.text-match+json"))
        for item in x.get("items", [])[:SEARCH_HITS]:
            for i, hit in enumerate(item.get("text_matches") or []):
                yield repo, item["path"], i, hit.get("fragment") or ""


class HostSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "review_host"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "pulls")]

    def reader(self, schema) -> HostReader:
        return HostReader(dict(self.options))
