import itertools
import random
import re

import numpy as np
import pytest

from deltascope.llm import ngram_join as j


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= j.PERCENT * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 9, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = [x.upper() for x in text]
            docs.append("  ".join(text) + rng.choice(["", "\n", "\t"]))
    # a chain: each links only with its neighbours
    base = [f"c{i}" for i in range(240)]
    for k in range(8):
        docs.append(" ".join(f"x{i}" if i < 12 * k else w for i, w in enumerate(base)))
    docs += ["", None, "  \n", "one", "One", "a b c", "a b"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", range(2))
def test_classes_are_those_of_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, node int").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.classes(df).collect()} == brute(docs)


def test_keep_first_and_odd_tables(spark):
    df = spark.createDataFrame([(5, "a b c d e", "x"), (3, "A b c d e", "x"), (9, None, "x"), (10, None, "x"), (3, "A b c d e", "x")], "doc_id long, text string, n string")
    kept = j.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 9, 10]
    assert j.classes(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    alone, shared = " ".join(f"n{i}" for i in range(40)), [f"s{i}" for i in range(80)]
    near = " ".join(["other", *shared[1:]])
    rows = [(None, alone), (None, " ".join(shared)), (7, near), (7, alone + " more of it"), (8, "far off all the rest"), (8, "quite another text of this id"), (None, None), (None, None)]
    rows += [(9, "row given four times over")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id or 0), r.text or "") for r in j.keep_first(df).collect())
    assert kept == sorted([(0, ""), (0, ""), (7, near), (7, alone + " more of it"), (8, "far off all the rest"), (8, "quite another text of this id"), (9, "row given four times over")])
    assert j.keep_first(df.limit(0)).count() == 0


def test_linked_sets_share_a_tile():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop, add = rng.integers(0, n // 12 + 1, 2)
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if len(b) and j.linked(both, len(a), len(b)):
            assert len(np.intersect1d(j.tiles(a), j.tiles(b)))
            assert j.most_common(len(a), len(b), j.bitmap(a), j.bitmap(b)) >= both


def test_sets_that_differ_in_as_many_parts_as_can_be_share_a_tile():
    rng = np.random.default_rng(3)
    for percent, n in itertools.product((80, 85), (2, 7, 20, 60, 150, 420, 1100)):
        cuts = j.bands(percent)
        for band in (cuts.of(n), cuts.of(n) + 1):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            m, _ = cuts.parts(band)
            part = ((a >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            fullest = sorted(np.unique(part), key=lambda x: -int((part == x).sum()))
            gone = [int(np.flatnonzero(part == x)[0]) for x in fullest]  # one of each part, those of the strongest tiles first
            for k in range(len(gone), 0, -1):
                b = np.delete(a, gone[:k])
                if len(b) and j.linked(len(b), len(a), len(b), percent):
                    assert len(np.intersect1d(j.tiles(a, percent), j.tiles(b, percent)))
                    break


def test_a_shared_passage_brings_few_sets_together():
    """A tile of one shingle that all texts with a passage have would be a list of all of them."""
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 1 << 63, 24).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(np.r_[passage, rng.integers(0, 1 << 63, 270).astype(np.uint64) * np.uint64(2)]) for _ in range(1000)]
    _, n = np.unique(np.concatenate([j.tiles(s, 80) for s in sets]), return_counts=True)
    assert n[n > 1].sum() < 4 * len(sets)  # over 9 a set when every part was a tile


def test_other_widths_and_thresholds(spark):
    docs = corpus(5)
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower()) for i, t in docs}
    sets = {i: {tuple(w[x : x + 5]) for x in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            x, y = sorted((comp[a], comp[b]))
            comp = {i: x if v == y else v for i, v in comp.items()}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.classes(df, k=5, percent=80).collect()} == {i: (len(s), comp[i]) for i, s in sets.items()}


@pytest.mark.parametrize("order", [1, -1])
def test_span_hashes_do_not_depend_on_pieces(order):
    rng = np.random.default_rng(4)
    size = 3 * j.c.PIECE_BYTES
    data = rng.integers(97, 123, size).astype(np.uint8)
    values = j.c.byte_values()[data]
    starts = np.sort(rng.integers(0, size, 400))[::order]
    ends = np.minimum(size, starts + np.where(rng.random(400) < 0.01, j.c.PIECE_BYTES + 9, rng.integers(0, 60, 400)))
    got = j.c.span_hashes(values, starts, ends)
    alone = [j.c.span_hashes(values[a:b], np.array([0]), np.array([b - a]))[0] for a, b in zip(starts, ends, strict=True)]
    assert got.tolist() == [int(x) for x in alone]
    assert len(j.c.span_hashes(values, starts[:0], ends[:0])) == 0


def letters(n, own, seed=7):
    """Texts of one template that fall just short of the threshold among each other."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(403)]
    out = []
    for i in range(n):
        at = rng.randrange(0, 360)
        out.append(" ".join(template[:at] + [f"o{i}x{k}" for k in range(own)] + template[at:]))
    return out


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables of pairs that a run writes."""
    rows = {}
    save = j.c.Scratch.save

    def counted(self, df, name, bucket_by=None):
        out = save(self, df, name, bucket_by)
        if name.startswith(("pairs", "likely", "first")):
            rows[name] = out.count()
        return out

    monkeypatch.setattr(j.c.Scratch, "save", counted)
    return rows


def test_letters_of_one_template_do_not_make_all_pairs(spark, written):
    texts = letters(1500, 38)
    texts += [t.replace("t100 ", "changed ") for t in texts[:40]]  # each linked with its original
    got = {r.doc_id: r.component_id for r in j.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i if i < 1500 else i - 1500 for i in range(1540)}
    assert sum(written.values()) < 20 * len(texts), written


def test_large_classes_with_two_centres(spark, written):
    """Each class is linked through its centres only; members of one differ from those of the other."""
    rng = random.Random(3)
    one = [f"a{i}" for i in range(200)]
    two = one[:100] + [f"b{i}" for i in range(5)] + one[105:]  # linked with the first
    texts = []
    for base in (one, two):
        texts.append(" ".join(base))
        for i in range(250):
            own = list(base)
            own[rng.randrange(20, 90)] = f"n{i}"
            texts.append(" ".join(own))
    assert {r.component_id for r in j.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()} == {0}
    assert sum(written.values()) < 40 * len(texts), written


def test_near_misses_and_links_equal_brute_force(spark):
    rng = random.Random(11)
    template = [f"t{i}" for i in range(120)]
    docs = []
    for i in range(260):
        text = list(template)
        for at in rng.sample(range(120), rng.randint(0, 6)):
            text[at] = f"v{rng.randrange(12)}"
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.classes(df).collect()} == brute(docs)


def test_a_very_long_text_and_a_class_of_many_copies(spark):
    rng = random.Random(2)
    long = " ".join(f"l{rng.randrange(50_000)}" for _ in range(200_000))
    rows = [(i, "the same forty words " * 10) for i in range(3000)] + [(5000, long), (5001, long.replace("l7 ", "x ")), (5002, "alone")]
    got = {r.doc_id: r.component_id for r in j.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {**dict.fromkeys(range(3000), 0), 5000: 5000, 5001: 5000, 5002: 5002}


def joins_by_node(spark, run):
    """How many rows the inner joins by node made during ``run``."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()

    def ids():
        bus.waitUntilEmpty()
        found = store.executionsList()
        return {found.apply(i).executionId() for i in range(found.size())}

    known = ids()
    run()
    total = 0
    for at in ids() - known:
        nodes, values = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for node in map(nodes.apply, range(nodes.size())):
            if re.search(r"Join \[node#\d+L\], \[node#\d+L\], Inner", node.desc()):
                kept = map(node.metrics().apply, range(node.metrics().size()))
                total += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in kept if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return total


@pytest.mark.parametrize("links_among_neighbours", [False, True])
def test_components_do_not_meet_each_rare_shingle(spark, monkeypatch, links_among_neighbours):
    """The joins by node make a row for each member of a list, not one for each of its rare shingles too."""
    made, save = {}, j.c.Scratch.save

    def counted(self, df, name, bucket_by=None):
        out = save(self, df, name, bucket_by)
        made[name] = out.count()
        return out

    monkeypatch.setattr(j.c.Scratch, "save", counted)
    texts = letters(100, 38)
    monkeypatch.setattr(j, "SHORT_LIST", 2)
    if links_among_neighbours:  # then components change before the last step
        rng = random.Random(11)
        for _ in range(80):
            text = [f"u{x}" for x in range(120)]
            for at in rng.sample(range(120), rng.randint(1, 2)):
                text[at] = f"v{rng.randrange(3)}"
            texts.append(" ".join(text))
    docs, got = list(enumerate(texts)), {}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = joins_by_node(spark, lambda: got.update((r.doc_id, (r.n_shingles, r.component_id)) for r in j.classes(df).collect()))
    assert got == brute(docs)
    assert "pairs3" in made and bool(made.get("links3")) == links_among_neighbours
    assert 0 < rows <= made["members"], (rows, made["members"])
