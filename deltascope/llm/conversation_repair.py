"""Repair of the turn structure of conversations at least cost.

The roles of a repaired conversation begin, after one optional system turn, with the user
and alternate, and the assistant has the last word: initials ``(s?(ua)+)?``.  Edits: keep (K,
0), rerole to user or assistant (R, 3), delete (D, 4) and insert an empty turn (I, 3); a
truncated turn that stays adds 3, blank and repeated turns must go.

Method: a dynamic program over the turns that stay.  The gap between two of them costs the
turns deleted there (a difference of prefix sums) and the turns inserted there (fixed by the
pair of roles).  So the best way to end with a turn in a role is a minimum over four running
minima, one for each last role, of cost less the prefix sum.  Ties go to the ASCII-least
string of edits; all ways to the same turn have as many letters other than I and end with one,
so comparing what there is so far is comparing the whole.

Long conversations are cut into pieces.  A piece gives, for each role before it and each last
role after it, the cost and the order of the edit strings; from these short rows alone the
way through all pieces is chosen, and each piece then writes its part of it.

Cases: a null role, text, conv_id or turn is one space where it is text (a null conv_id is a
conversation of its own; null turns come first and count for no gap).  Rows of one turn follow
each other by role, then text; equal rows are copies of which the later ones are repeated.  A
role of another first letter, or an empty one, can't be kept.  Empty and very long texts are
whole texts; an empty table gives an empty result; further columns are ignored.

Scale: rows are sorted over all tasks by (conversation, turn, role, text), so a conversation
with a third of all rows is many pieces in many tasks; equal rows are counted, not carried.
Repeated texts meet in a salted join.  One task reads the short rows of a conversation's
pieces, and its pieces one after the other for the SHA-256, which can't be taken in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm import _common as c

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of one piece, and bytes of its texts.
PIECE_ROWS = 512
PIECE_BYTES = 1 << 20
FINE, CUT_OFF, BLANK, REPEATED = range(4)
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
#: Last roles: none yet, system, user, assistant.
STATES = "-sua"
#: Turns to insert between a last role and the next one.
NEEDED = {("-", "s"): 0, ("-", "u"): 0, ("-", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
#: Turns to insert at the end.
CLOSING = {"-": 0, "s": 2, "u": 1, "a": 0}
_WHITE = "\t\n\x0b\x0c\r "
_FIRST = -(1 << 63)

Best = dict[str, tuple[int, str]]


# ---------------------------------------------------------------- the dynamic program


def ways(rows: list[tuple[str, int, int]], start: str) -> Best:
    """For each last role: cost and edits of the best way through ``rows`` (role's first letter, kind, copies)."""
    best: Best = {start: (0, "")}  # cost less the deletions so far
    gone = 0  # cost of deleting all rows so far
    for initial, kind, copies in rows:
        if not copies:
            continue
        ends: Best = {}
        if kind <= CUT_OFF:
            own = TRUNCATED if kind == CUT_OFF else 0
            for role in "sua":
                if role != initial and role == "s":
                    continue
                price, letter = (own, "K") if role == initial else (own + REROLE, "R")
                found = [(cost + gone + INSERT * NEEDED[last, role] + price, edits + "I" * NEEDED[last, role] + letter) for last, (cost, edits) in best.items() if (last, role) in NEEDED]
                if found:
                    ends[role] = min(found)
            gone += DELETE
            best = {last: (cost, edits + "D") for last, (cost, edits) in best.items()}
            for role, (cost, edits) in ends.items():
                best[role] = min(best.get(role, (cost - gone, edits)), (cost - gone, edits))
            copies -= 1
        gone += DELETE * copies
        best = {last: (cost, edits + "D" * copies) for last, (cost, edits) in best.items()}
    return {last: (cost + gone, edits) for last, (cost, edits) in best.items()}


def through(pieces: list[dict]) -> tuple[int, str, list[tuple[str, str]]]:
    """Least cost, last role, and (role before, last role) of each piece on the best way."""
    at = {"-": (0, 0)}  # cost, and place among the edit strings so far
    back = []
    for piece in pieces:
        step = {}
        for start, end, cost, order in zip(piece["starts"], piece["ends"], piece["costs"], piece["orders"], strict=True):
            if start in at:
                way = (at[start][0] + cost, at[start][1], order, start)
                step[end] = min(step.get(end, way), way)
        back.append({end: way[3] for end, way in step.items()})
        placed = {end: i for i, end in enumerate(sorted(step, key=lambda x: step[x][1:3]))}
        at = {end: (way[0], placed[end]) for end, way in step.items()}
    cost, _, last = min((cost + INSERT * CLOSING[x], place, x) for x, (cost, place) in at.items())
    path, end = [], last
    for step in reversed(back):
        path.append((step[end], end))
        end = step[end]
    return cost, last, path[::-1]


def emitted(rows: list[tuple[str, str, int, int]], edits: str, last: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each edit on ``rows`` (role, text, kind, copies), from the last role before them."""
    source = ((role, text) for role, text, _, copies in rows for _ in range(copies))
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(source)
        if edit == "K":
            last = role[0]
        elif edit != "D":
            last = "a" if last == "u" else "u"
            role = NAMES[last]
        yield edit, role, text


# ---------------------------------------------------------------- rows


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of conversation and turn, with how often each stands there (0: dropped)."""
    conv, turn, role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn", "role", "text"))
    fate = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    spoilt = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"), spoilt.alias("text"), times.alias("times"))


def _kind(text: Column, repeated: Column) -> Column:
    bare = F.rtrim(text, F.lit(_WHITE))
    return F.when(bare == "", BLANK).when(repeated, REPEATED).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT_OFF).otherwise(FINE)


def _judged(rows: DataFrame, times: str | None) -> DataFrame:
    """One row for equal rows of a turn: conv, conv_id, turn, at, role, text, copies, kind."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text"))
    n = F.col(times).cast("long") if times else F.lit(1).cast("long")
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(n > 0, role).otherwise("").alias("role"), F.when(n > 0, text).otherwise("").alias("text"), n.alias("copies"))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    said = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    plain = plain.select("*", conv.alias("conv"), F.coalesce("turn", F.lit(_FIRST)).alias("at"), said.alias("said"))
    once = plain.groupBy("conv", "at", "said").agg(F.sum("copies").alias("copies"), *(F.first(x).alias(x) for x in ("conv_id", "turn", "role", "text")))
    firsts = plain.where("copies > 0").groupBy("conv", "said").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at")).where("first_at < last_at").select("conv", "said", "first_at")
    known = c.salted_join(once, firsts, ["conv", "said"], ["at"], "left")
    return known.select("conv", "conv_id", "turn", "at", "role", "text", "copies", _kind(F.col("text"), F.coalesce(F.col("at") > F.col("first_at"), F.lit(False))).alias("kind"))


# ---------------------------------------------------------------- pieces

_SUMMARY = "conv string, conv_id long, part int, no long, starts array<string>, ends array<string>, costs array<long>, orders array<int>, blank long, repeated long, truncated long, illegal long, first string, last string, least long, most long, turns long, first_turn long, last_turn long"
_PIECES = f"{_SUMMARY}, roles array<string>, texts array<string>, kinds array<int>, copies array<long>"
_NUMBERS = pa.list_(pa.int64())
_ARROW = pa.schema(
    [("conv", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("starts", pa.list_(pa.string())), ("ends", pa.list_(pa.string())), ("costs", _NUMBERS), ("orders", pa.list_(pa.int32()))]
    + [(x, pa.int64()) for x in ("blank", "repeated", "truncated", "illegal")]
    + [("first", pa.string()), ("last", pa.string())]
    + [(x, pa.int64()) for x in ("least", "most", "turns", "first_turn", "last_turn")]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("kinds", pa.list_(pa.int32())), ("copies", _NUMBERS)]
)


def _piece(rows: list[dict], part: int, no: int, alone: bool) -> dict:
    """The summary of consecutive rows of a conversation; ``alone`` if none of its rows precede in this task."""
    there = [r for r in rows if r["copies"]]
    short = [(r["role"][:1], r["kind"], r["copies"]) for r in there]
    starts, ends, costs, orders = [], [], [], []
    for start in "-" if alone else STATES:
        found = ways(short, start)
        order = sorted(found, key=lambda x: found[x][1])
        for end, (cost, _) in found.items():
            starts.append(start), ends.append(end), costs.append(cost), orders.append(order.index(end))
    initials = [x for x, _, _ in short]
    turns = [r["turn"] for r in there if r["turn"] is not None]  # in order
    return {
        "conv": rows[0]["conv"], "conv_id": rows[0]["conv_id"], "part": part, "no": no, "starts": starts, "ends": ends, "costs": costs, "orders": orders,
        "blank": sum(n for _, kind, n in short if kind == BLANK),
        "repeated": sum(n - (kind != REPEATED) for _, kind, n in short if kind != BLANK),
        "truncated": sum(kind == CUT_OFF for _, kind, _ in short),
        "illegal": sum(n - 1 for _, _, n in short) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
        "least": min(turns, default=None), "most": max(turns, default=None), "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "roles": [r["role"] for r in there], "texts": [r["text"] for r in there], "kinds": [r["kind"] for r in there], "copies": [r["copies"] for r in there],
    }


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to pieces, numbered in their order."""
    part, no = TaskContext.get().partitionId(), 0
    held: list[dict] = []
    size, alone = 0, False  # a task's first conversation may have begun in the task before

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal no, size
        if held:
            yield pa.RecordBatch.from_pylist([_piece(held, part, no, alone)], _ARROW)
            no += 1
            size = 0
            held.clear()

    for rows, _, _ in c.text_slices(batches):
        for row in rows.to_pylist():
            if held and row["conv"] != held[-1]["conv"]:
                yield from flush()
                alone = True
            elif held and (len(held) >= PIECE_ROWS or size + len(row["text"]) > PIECE_BYTES):
                yield from flush()
                alone = False
            held.append(row)
            size += len(row["text"])
    yield from flush()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[dict]]:
    """The rows of each conversation, one conversation after the other."""
    rows = (row for batch in batches for i in range(0, batch.num_rows, 64) for row in batch.slice(i, 64).to_pylist())
    for _, own in groupby(rows, key=lambda r: r["conv"]):
        yield own


_CHOSEN = "conv string, part int, no long, start string, end string, closing int, cost long, gaps long, blank long, repeated long, truncated long, illegal long"


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way through the pieces of each conversation; its totals stand at the last piece."""
    schema = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("no", pa.int64()), ("start", pa.string()), ("end", pa.string()), ("closing", pa.int32())] + [(x, pa.int64()) for x in ("cost", "gaps", "blank", "repeated", "truncated", "illegal")])
    out: list[dict] = []
    for own in _runs(batches):
        pieces = list(own)
        cost, last, path = through(pieces)
        out += [{"conv": p["conv"], "part": p["part"], "no": p["no"], "start": a, "end": b} for p, (a, b) in zip(pieces, path, strict=True)]
        filled = [p for p in pieces if p["first"] is not None]
        joints = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(filled, filled[1:]))
        dated = [p for p in pieces if p["turns"]]
        distinct = sum(p["turns"] for p in dated) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:]))
        gaps = max(p["most"] for p in dated) - min(p["least"] for p in dated) + 1 - distinct if dated else 0
        sums = {x: sum(p[x] for p in pieces) for x in ("blank", "repeated", "truncated", "illegal")}
        out[-1] |= {"closing": CLOSING[last], "cost": cost, "gaps": gaps} | sums | {"illegal": sums["illegal"] + joints}
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _written(pieces: Iterator[dict]) -> Iterator[tuple[dict, str, Iterator[tuple[str, str, str]]]]:
    """Each piece with its part of the edits, and what they make of its rows."""
    for p in pieces:
        rows = list(zip(p["roles"], p["texts"], p["kinds"], p["copies"], strict=True))
        edits = ways([(role[:1], kind, n) for role, _, kind, n in rows], p["start"])[p["end"]][1]
        edits += "I" * (p["closing"] or 0)
        yield p, edits, emitted(rows, edits, p["start"])


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in _runs(batches):
        digest, audit, begun = hashlib.sha256(), [], False
        for p, edits, made in _written(own):
            audit.append(edits)
            for edit, role, text in made:
                if edit != "D":
                    digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([p["conv_id"]], pa.int64()), **{x: pa.array([p[y]], pa.int64()) for x, y in (("gaps", "gaps"), ("blank", "blank"), ("duplicate", "repeated"), ("truncated", "truncated"), ("illegal", "illegal"), ("cost", "cost"))}, "audit": ["".join(audit)], "repaired_sha256": [digest.hexdigest()]})


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    for own in _runs(batches):
        n = 0
        for p, _, made in _written(own):
            rows = []
            for edit, role, text in made:
                if edit != "D":
                    rows.append({"conv_id": p["conv_id"], "turn": n, "role": role, "text": text, "edit": edit})
                    n += 1
            yield pa.RecordBatch.from_pylist(rows, schema)


# ---------------------------------------------------------------- the operator


def _repaired(rows: DataFrame, times: str | None, write: Callable, schema: str) -> DataFrame:
    spark = rows.sparkSession
    scratch = c.Scratch(spark, "conversations")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "at", "role", "text"]
    sorted_rows = _judged(rows, times).repartitionByRange(n, *order).sortWithinPartitions(*order)
    pieces = scratch.save(sorted_rows.mapInArrow(_cut, _PIECES), "pieces")
    together = lambda df: df.repartition(n, "conv").sortWithinPartitions("conv", "part", "no")
    chosen = together(pieces.select([x.split(" ")[0] for x in _SUMMARY.split(", ")])).mapInArrow(_choose, _CHOSEN)
    chosen = chosen.select("conv", "part", "no", "start", "end", "closing", "cost", "gaps", "blank", "repeated", "truncated", "illegal")
    whole = pieces.select("conv", "conv_id", "part", "no", "roles", "texts", "kinds", "copies").join(chosen, ["conv", "part", "no"])
    return together(whole).mapInArrow(write, schema)


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(rows: DataFrame, times: str | None = None) -> DataFrame:
    """A row for each conversation: its faults, the cost and string of the edits, and a digest of the repaired turns.

    ``rows`` has conv_id, turn, role, text; ``times`` may name a column that says how often a
    row stands there (0: it only names its conversation).
    """
    return _repaired(rows, times, _reports, _REPORT)


def repaired_turns(rows: DataFrame, times: str | None = None) -> DataFrame:
    """conv_id, turn (from 0), role, text and edit of every turn of the repaired conversations."""
    return _repaired(rows, times, _turns, "conv_id long, turn long, role string, text string, edit string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damaged(c.table(spark, sf_dir, "conversations")), "times")
