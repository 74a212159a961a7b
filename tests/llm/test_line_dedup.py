import random

from deltascope.llm import line_dedup as d


def brute(docs):
    """Lines covered by a run of MIN_WORDS words or more that also begins earlier."""
    seqs = [(i, [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]) for i, t in sorted(docs)]
    gone = set()
    starts = {}
    for i, lines in seqs:
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b].split())
                if n >= d.MIN_WORDS:
                    if tuple(lines[a : b + 1]) in starts:
                        gone |= {(i, x) for x in range(a, b + 1)}
                    starts.setdefault(tuple(lines[a : b + 1]), (i, a))
    return gone


def test_removed_lines_are_those_of_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.choice([1, 2, 3, 4, 12]))) for _ in range(25)]
    for _ in range(3):
        docs = [(i, "\n".join(rng.choice([*pool, "", " "]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
        docs += [(100 + i, docs[i % 5][1]) for i in range(20)] + [(200, None), (201, "")]
        rng.shuffle(docs)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert {(r.doc_id, r.pos) for r in d.removed_lines(df).collect()} == brute(docs)


def test_repeated_and_missing_ids(spark):
    run = "\n".join(f"line {i} of a long run that goes on" for i in range(24))
    rows = [(2, run)] * 4 + [(2, "precious unique first line of ten words and then some\nsecond")] * 2 + [(None, run + "\nend"), (None, "own words of a row without any id at all here"), (9, run)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = d.removed_lines(df)
    assert marks.count() == 48 and {r.doc_id for r in marks.collect()} == {9, d.c.LAST}
    got = sorted(((r.doc_id or 99), r.text, r.n_removed_lines) for r in d.dedupe(df).collect())
    assert got == sorted([(2, run, 0)] * 4 + [(2, rows[4][1], 0)] * 2 + [(99, "end", 24), (99, rows[7][1], 0), (9, "", 24)])


def test_a_very_long_text_and_clashing_columns(spark):
    long = "\n".join(f"w{i}" for i in range(30000))
    rows = [(1, long, 1, 2, 3), (2, "x\n" + long, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int, rank int, size int")
    got = {r.doc_id: r for r in d.dedupe(df).collect()}
    assert got[1].text == long and got[2].text == "x" and got[2].n_removed_lines == 30000 and got[2].rank == 2


def test_texts_lose_later_copies_only(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, f"a b\n{long}\n\nc", 7), (2, f"x\n\n{long}", 7), (3, f"short\n{long}\n\n{long}\nend", 7), (4, long, 7), (5, None, 7), (6, "", 7), (7, "a b\nc", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int")
    got = {r.doc_id: (r.text, r.n_removed_lines, r.pos) for r in d.dedupe(df).collect()}
    assert got[1] == (f"a b\n{long}\n\nc", 0, 7) and got[7] == ("a b\nc", 0, 7)
    assert got[2] == ("x\n", 1, 7) and got[3] == ("short\nend", 2, 7) and got[4] == ("", 1, 7)
    assert got[5] == (None, 0, 7) and got[6] == ("", 0, 7)
    kept = d.keep_first(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 5, 6, 7}
    assert d.dedupe(df.limit(0)).count() == 0
