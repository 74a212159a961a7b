import random

import corpus_pipeline

def make(spark, path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, "\n".join(text(rng.randint(12, 40)) for _ in range(4)), "en", f"src{i % 3}", 0) for i in range(60)]
    line = text(15)
    docs[5] = (5, docs[5][1] + "\n" + line, "en", "src0", 0)
    docs[6] = (6, docs[6][1] + "\n" + line, "en", "src0", 0)
    near = docs[7][1].split(" ")
    near[20] = "other"
    near = " ".join(near).replace("\n", " ")
    docs += [(100, docs[0][1], "en", "src1", 0), (101, near, "en", "src1", 0), (102, docs[7][1].replace("\n", " "), "en", "src1", 0), (103, "short", "en", None, 0), (104, None, "en", "src1", 0)]
    item = text(14)
    docs.append((105, text(30) + " " + item + " " + text(30), "en", "src2", 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return line


def test_stages_carry_out_their_decisions(spark, tmp_path):
    line = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [{r.doc_id for r in docs.collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        seen.append({r.doc_id for r in docs.collect()})
        if i == 1:
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert line in texts[5] and line not in texts[6]
    gone = [a - b for a, b in zip(seen, seen[1:])]
    assert gone[0] == {103, 104} and gone[1] == {100} and gone[2] == {101, 102} and gone[3] == {105} and not gone[4]
    ran = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {tuple(r) for r in docs.collect()}


def test_near_duplicate_stage_takes_five_words_at_four_fifths(spark, tmp_path):
    base = [f"w{i}" for i in range(100)]
    near = base[:40] + [f"x{i}" for i in range(6)] + base[46:]  # 86/106 of 5-word shingles, 88/106 of 4-word ones
    apart = [f"y{i}" for i in range(100)]
    far = apart[:40] + [f"z{i}" for i in range(7)] + apart[47:]  # 85/107
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate((base, near, apart, far))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    assert sorted(r.doc_id for r in stage(spark, df, str(tmp_path)).collect()) == [0, 2, 3]


def test_stages_take_odd_tables(spark, tmp_path):
    """Other columns with clashing names, rows without an id, repeated rows, null texts, and no rows at all."""
    make(spark, str(tmp_path))
    text = " ".join(f"w{i}" for i in range(40))
    schema = "doc_id long, text string, source string, __part int, row long, n_words long, part int, line long, component_id long, keep boolean"
    rows = [(1, text, "s", 1, 2, 3, 4, 5, 6, True)] * 3 + [(None, text + " more", None, 1, 2, 3, 4, 5, 6, True)] * 2 + [(2, None, "s", 1, 2, 3, 4, 5, 6, True), (3, "", None, 1, 2, 3, 4, 5, 6, True), (4, "\n".join(f"v{i} u{i}" for i in range(30)), "s", 1, 2, 3, 4, 5, 6, True)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        many = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [x.split(" ")[0] for x in schema.split(", ")], name
        left = docs.collect()
        assert sorted((r.doc_id or 0) for r in left) == ([1, 4] if many else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(left)
