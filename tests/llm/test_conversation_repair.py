import hashlib
import random
import re
import zlib
from itertools import product

from deltascope.llm import conversation_repair as r

LEGAL = re.compile(r"(s?(ua)+)?")
WHITE = "\t\n\x0b\x0c\r "


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append(r.BLANK if not bare else r.REPEATED if (role, text) in seen else r.CUT_OFF if bare[-1] not in ".!?" else r.FINE)
        seen.add((role, text))
    return out


def all_repairs(rows):
    """Every script of up to one insertion before each row and two at the end: (cost, letters, turns)."""
    kinds = faults(rows)
    gap = [[], ["user"], ["assistant"]]
    end = gap + [[a, b] for a in ("user", "assistant") for b in ("user", "assistant")]
    for edits in product("KuaD", repeat=len(rows)):
        if any(e != "D" and k in (r.BLANK, r.REPEATED) for e, k in zip(edits, kinds)):
            continue
        for inserts in product(*[gap] * len(rows), end):
            cost, letters, made = 0, "", []
            for (role, text), edit, kind, before in zip(rows, edits, kinds, inserts):
                cost += 3 * len(before)
                letters += "I" * len(before)
                made += [(x, "") for x in before]
                cost += {"K": 0, "D": 4}.get(edit, 3) + (3 if kind == r.CUT_OFF and edit != "D" else 0)
                letters += edit if edit in "KD" else "R"
                made += [] if edit == "D" else [(role if edit == "K" else r.NAMES[edit], text)]
            cost += 3 * len(inserts[-1])
            made += [(x, "") for x in inserts[-1]]
            initials = [x[:1] or "?" for x, _ in made]
            if LEGAL.fullmatch("".join(initials)):
                yield cost, letters + "I" * len(inserts[-1]), made


def brute(rows):
    cost, audit, made = min(all_repairs(rows), key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()


def short(rows):
    return [(role[:1], kind, 1) for (role, _), kind in zip(rows, faults(rows))]


def best(rows):
    cost, last, [(start, end)] = r.through([r._piece([{"conv": "", "conv_id": 1, "role": a, "text": b, "kind": k, "copies": 1, "turn": 0} for (a, b), k in zip(rows, faults(rows))], 0, 0, True)]) if rows else (0, "-", [("-", "-")])
    edits = r.ways(short(rows), start)[end][1] + "I" * r.CLOSING[last]
    made = [f"{a}:{b}" for e, a, b in r.emitted([(a, b, k, 1) for (a, b), k in zip(rows, faults(rows))], edits, start) if e != "D"]
    return cost, edits, hashlib.sha256("\n".join(made).encode()).hexdigest()


def some_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "unknown"]), rng.choice(["A.", "B!", "C", " ", "", "D?\n", "E x"])) for _ in range(n)]


def test_cheapest_and_least_of_all_scripts():
    rng = random.Random(5)
    for case in range(140):
        rows = some_rows(rng, case % 4)
        assert best(rows) == brute(rows), rows
    for rows in ([("user", "A."), ("user", "B."), ("assistant", "C."), ("assistant", "D.")], [("assistant", "A."), ("system", "B."), ("user", "C")], [("system", "A.")] * 1, [("system", "s."), ("user", "A."), ("system", "t."), ("assistant", "B.")]):
        assert best(rows) == brute(rows), rows


def test_pieces_give_the_way_of_the_whole():
    rng = random.Random(9)
    for _ in range(200):
        rows = [{"conv": "1", "conv_id": 1, "role": rng.choice(["user", "assistant", "system", "x"]), "text": "", "kind": rng.choice([0, 0, 0, 1, 2, 3]), "copies": rng.choice([0, 1, 1, 1, 3]), "turn": None} for _ in range(rng.randrange(1, 40))]
        whole = r.through([r._piece(rows, 0, 0, True)])
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(5))})
        pieces = [r._piece(rows[a:b], 0, i, i == 0 and rng.random() < 0.5) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        cost, last, path = r.through(pieces)
        letters = ""
        for (a, b), (start, end) in zip(zip(cuts, cuts[1:]), path):
            letters += r.ways([(x["role"][:1], x["kind"], x["copies"]) for x in rows[a:b]], start)[end][1]
        single = r.ways([(x["role"][:1], x["kind"], x["copies"]) for x in rows], "-")[whole[2][0][1]][1]
        assert (cost, letters, last) == (whole[0], single, whole[1])


def plain_report(rows):
    """conv_id -> report, for rows (conv_id, turn, role, text) that are damaged here."""
    text = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {x[0] for x in rows}:
        after = []
        for _, turn, role, said in (x for x in rows if x[0] == conv):
            role, said = text(role), text(said)
            fate = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
            if fate == 0:
                continue
            said = "" if fate == 1 else re.sub("[.!?]", "", said) if fate == 2 else said
            after += [((turn is not None, turn or 0), "user" if fate == 4 else role, said)] * (2 if fate == 3 else 1)
        after.sort()
        pairs = [(a, b) for _, a, b in after]
        turns = [t for (there, t), _, _ in after if there]
        kinds = faults(pairs)
        initials = [a[:1] for a, _ in pairs]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            kinds.count(r.BLANK), kinds.count(r.REPEATED), kinds.count(r.CUT_OFF),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            *best(pairs),
        )
    return out


def as_dict(df):
    rows = df.collect()
    out = {x[0]: tuple(x)[1:] for x in rows}
    assert len(out) == len(rows)
    return out


def test_query_over_all_conversations(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(r.query(spark, data)) == plain_report(rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice([None, "user", "assistant", "system", "", "tool"]), rng.choice([None, "", "A.", "B", "C!", " \n", "é" * 70_000])) for _ in range(120)]
    rows += [(6, 0, "user", "only")] * 3
    df = spark.createDataFrame([(*x, 0, "z") for x in rows], "conv_id long, turn long, role string, text string, copies long, at string").repartition(5)
    assert as_dict(r.report(r.damaged(df), "times")) == plain_report(rows)
    assert r.report(df.limit(0)).count() == 0


def test_a_dropped_conversation_stays_as_a_row(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    [row] = r.report(r.damaged(df), "times").collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_long_conversation(spark):
    rng = random.Random(8)
    rows = [(1, i // 2, rng.choice(["user", "assistant"]), rng.choice(["A.", f"B {i % 900}.", f"C {i}"])) for i in range(5000)] + [(2, 0, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = as_dict(r.report(df))
    pairs = [(a, b) for _, _, a, b in sorted(x for x in rows if x[0] == 1)]
    assert got[1][5:] == best(pairs)
    turns = r.repaired_turns(df).where("conv_id = 1").orderBy("turn").collect()
    assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in turns).encode()).hexdigest() == got[1][7]
    assert [x.turn for x in turns] == list(range(len(turns)))
    assert "".join(x.edit for x in turns) == got[1][6].replace("D", "")
