"""The reader of exported repositories, by hand-written streams and by real ones where git is there."""

import shutil
import subprocess

import pytest

from deltascope.operators import review
from deltascope.sources import exported, history

STREAM = """blob
mark :1
data 4
one

blob
mark :2
data 4
two

reset refs/heads/main
commit refs/heads/main
mark :10
original-oid aaa
author A <a> 1 +0000
committer A <a> 1 +0000
data 6
M 100 x
M 100644 :1 a.txt
M 100644 :1 dir/b.txt
M 100755 inline "sp\\303\\244t \\"q\\".txt"
data 3
abc
commit refs/heads/main
mark :11
original-oid bbb
committer A <a> 1 +0000
data 0
from :10
M 100644 :2 a.txt
D dir
M 160000 cccc module
commit refs/heads/side
mark :12
original-oid ccc
committer A <a> 1 +0000
data 0
from :10
R a.txt c.txt
C c.txt d.txt
commit refs/heads/main
mark :13
original-oid ddd
committer A <a> 1 +0000
data 0
from :11
merge :12
M 100644 :1 c.txt
deleteall
M 100644 :1 a.txt
commit refs/heads/other
mark :14
committer A <a> 1 +0000
data <<END
words
END
M 100644 inline bin
data 3
a\0b
done
"""


@pytest.fixture(autouse=True)
def pushdown(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def load(spark, path, **options):
    spark.dataSource.register(exported.ExportSource)
    return spark.read.format("history_export").options(path=str(path), **options).load()


def test_rows_of_a_stream(spark, tmp_path):
    path = tmp_path / "export"
    path.write_bytes(STREAM.encode())
    rows = load(spark, path, commits=2).collect()
    got = {(r.sha, r.file_path): (r.seq, r.status, r.old_file_path, r.before_content, r.after_content) for r in rows}
    assert len(got) == len(rows)
    assert got == {
        ("aaa", "a.txt"): (1, "added", None, None, "one\n"),
        ("aaa", "dir/b.txt"): (1, "added", None, None, "one\n"),
        ("aaa", 'spät "q".txt'): (1, "added", None, None, "abc"),
        ("bbb", "a.txt"): (2, "changed", None, "one\n", "two\n"),
        ("bbb", "dir/b.txt"): (2, "removed", None, "one\n", None),
        ("ccc", "c.txt"): (3, "renamed", "a.txt", "one\n", "one\n"),
        ("ccc", "d.txt"): (3, "added", None, None, "one\n"),
        ("ddd", "a.txt"): (4, "changed", None, "two\n", "one\n"),
        ("ddd", 'spät "q".txt'): (4, "removed", None, "abc", None),
        (":14", "bin"): (5, "added", None, None, None),
    }


def test_scopes_and_pushed_filters(spark, tmp_path):
    path = tmp_path / "export"
    path.write_bytes(STREAM.encode())
    rows = load(spark, path)
    assert sorted((r.file_path, r.status) for r in history.changed_files(rows, "bbb").collect()) == [("a.txt", "modified"), ("dir/b.txt", "deleted")]
    assert {r.file_path for r in history.changed_files(rows, "aaa..bbb").collect()} == {"a.txt", "dir/b.txt"}
    assert history.changed_files(rows, "working").count() == 0
    some = load(spark, path).where("sha = 'bbb' AND file_path IN ('a.txt', 'zzz')")
    assert [(r.sha, r.file_path) for r in some.collect()] == [("bbb", "a.txt")]
    plans = [some._jdf.queryExecution().analyzed().toString(), some._jdf.queryExecution().executedPlan().toString()]
    assert "zzz" in plans[0] and "bbb" in plans[0]
    assert "zzz" not in plans[1] and "= bbb" not in plans[1]  # the source has taken both
    reader = exported.ExportReader({"path": str(path)})
    left = list(reader.pushFilters([exported.EqualTo(("sha",), "bbb"), exported.In(("sha",), ("bbb", "ccc")), exported.EqualTo(("status",), "added")]))
    assert [x.attribute for x in left] == [("status",)] and sum(len(p.rows) for p in reader.partitions()) == 2


@pytest.mark.skipif(not shutil.which("git"), reason="needs git")
def test_a_real_repository_is_reviewed(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()

    def git(*args):
        return subprocess.run(["git", "-c", "user.name=T", "-c", "user.email=t@example.org", "-C", str(repo), *args], check=True, capture_output=True).stdout.decode()

    git("init", "-q")
    (repo / "main.rs").write_text("")
    git("add", "-A"), git("commit", "-qm", "init")
    (repo / "main.rs").write_text('fn hello() {\n    println!("hello");\n}\n')
    git("add", "-A"), git("commit", "-qm", "add hello")
    (tmp_path / "export").write_bytes(subprocess.run(["git", "-C", str(repo), "fast-export", "--show-original-ids", "--all"], check=True, capture_output=True).stdout)
    head = git("rev-parse", "HEAD").strip()
    files = history.changed_files(load(spark, tmp_path / "export"), head)
    [row] = review.review_change(files).collect()
    assert (row.entity_name, row.change_type, row.classification) == ("hello", "added", "functional")
