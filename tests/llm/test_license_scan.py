import math
import re

import numpy as np

from deltascope.llm import license_scan as s


def words_of(text):
    """Words of letters, digits and dots; a dot belongs to a word only before a digit."""
    out, word = [], ""
    text = text.lower()
    for i, ch in enumerate(text):
        inside = ch in "0123456789abcdefghijklmnopqrstuvwxyz" or ch == "." and text[i + 1 : i + 2].isdigit()
        if inside:
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


def parts_of(text):
    """(paragraph, part, text), walking the lines."""
    out, block, number, lines = [], [], 0, (text or "").split("\n")
    for i, line in enumerate(lines):
        if line.strip(" \t\r") or i == 0 and not block:
            block.append(line)
        ends = not line.strip(" \t\r") or re.search(r"[.!?:;][\"')\]]{0,2}[ \t\r]*$", line) or i == len(lines) - 1
        if ends and block:
            if any(x.strip() for x in block):
                out.append((number, 0, " ".join(block)))
                out += [(number, k, x) for k, x in enumerate(block, 1)] if len(block) > 1 else []
                number += 1
            block = []
    return out


def brute(text):
    """(family, chance, found) of each part that has an n-gram of the model."""
    weights, bias, temperature = s.model()
    templates = [(f, set(words_of(x))) for f, xs in s.TEMPLATES.items() for x in xs]
    known = set(weights) | {w for _, t in templates for w in t}
    out = {}
    for paragraph, part, line in parts_of(text):
        words = words_of(line)
        grams = set(words) | {f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1)}
        if not grams & known:
            continue
        scores = []
        for k in range(len(s.FAMILIES)):
            scores.append((bias[k] + sum(weights[g][k] for g in grams if g in weights)) / temperature)
        total = sum(math.exp(x - max(scores)) for x in scores)
        family = s.FAMILIES[scores.index(max(scores))]
        covered = any(f == family and len(t & set(words)) / len(t) >= s.LEAST_COVER for f, t in templates)
        out[paragraph, part] = (family, 1 / total, family != s.UNKNOWN and 1 / total >= s.LEAST_CHANCE and covered)
    return out


TEXTS = ["Released under the MIT License.\nprose of a public house", "Licensed under the Apache License, Version 2.0.", "a b c\n\nLicensed under CC BY-NC 4.0.\nAll rights reserved.", None, "", "the", "Released under the MIT License.",
         "Some file\nThis file is licensed\nunder the GNU General\nPublic License, version 3.\nAnd more prose.", "\n\n \nMIT license\n\n", "word " * 30000 + "\nreleased under the mit license", "Licensed under v2.0 of the\nMozilla Public License."]


def test_parts_are_those_of_brute_force(spark):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 5, "x"), (None, TEXTS[1], 5, "x")], "doc_id long, text string, row int, family string")
    rows = s.paragraphs(df.where("doc_id is not null")).collect()
    order = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.paragraph)):
        order.setdefault(r.doc_id, {}).setdefault(r.paragraph, None)
    got = {(r.doc_id, r.paragraph, r.part): (r.family, r.chance, r.found) for r in rows}
    for i, t in enumerate(TEXTS):
        want = list(brute(t).items())
        mine = sorted((p, part, v) for (d, p, part), v in got.items() if d == i)
        assert len(mine) == len(want), (i, mine, want)
        for (_, part, (family, chance, found)), ((_, want_part), (f, c, ok)) in zip(mine, sorted(want), strict=True):
            assert part == want_part and family == f and abs(chance - c) < 1e-9 and found == ok, (i, part)
    found = {(r.doc_id, r.paragraph, r.part) for r in s.paragraphs(df.where("doc_id is not null"), findable=True).where("found").collect()}
    assert found == {k for k, v in got.items() if v[2]}
    scanned = s.scan(df).collect()
    assert len(scanned) == len(TEXTS) + 2 and {r.family for r in scanned if r.doc_id is None} == {"apache-2.0"}
    best = {r.doc_id: (r.family, r.n_notices, r.families) for r in scanned}
    assert best[0] == ("mit", 1, "mit") and best[2][1:] == (2, "cc-by-nc,proprietary") and best[3] == best[4] == best[5] == ("none", 0, "")
    assert best[7][0] == "gpl" and best[9][0] == "mit"
    assert s.scan(df.limit(0)).count() == 0


HELD = [
    ("mit", "The source code of this page is released under the MIT License; see LICENSE."), ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")."), ("gpl", "Licensed under the GNU General Public License version 3."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."), ("cc-by", "Our lessons are licensed under CC BY 4.0 since 2019."), ("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("mpl", "subject to the terms of the Mozilla Public License, v. 2.0. Version 2.0"), ("proprietary", "(c) 2021 Somebody. All rights reserved."), ("public-domain", "Released into the public domain."), ("agpl", "Licensed under the GNU Affero General Public License, version 3."), ("bsd", "licensed under the BSD 3-clause license"),
    *((s.UNKNOWN, x) for x in ("The minister apologised to the public on live television.", "Her new album was released last Friday and sold well.", "Under the bridge there is a small cafe with four tables.", "Der Zug nach Hamburg hat heute leider Verspätung.", "Two thirds of the members voted for the change of the rules.", "Copying machines were expensive in the seventies.", "General terms and opening hours can be found below.", "The file was closed after the inquiry found no fault.", "A free copy of the magazine was given to any person who asked.", "The attribution of the painting is disputed.")),
]


def test_paragraphs_that_no_generator_made():
    weights, bias, temperature = s.model()
    sure = right = 0
    for family, text in HELD:
        z = (bias + sum((weights[g] for g in s._grams(s._tokens(text)) if g in weights), np.zeros(len(s.FAMILIES)))) / temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        right += s.FAMILIES[int(np.argmax(p))] == family
        sure += float(p.max())
    assert right >= len(HELD) - 1
    assert abs(sure / len(HELD) - right / len(HELD)) < 0.15  # as sure as it is right
    assert len(weights) > 100 and all(w.any() for w in weights.values())


def test_held_out_families():
    weights, bias, _ = s.model()
    texts, labels = s._examples(9, 30)
    right = 0
    for t, y in zip(texts, labels, strict=True):
        right += int(np.argmax(bias + sum((weights[g] for g in t if g in weights), np.zeros(len(s.FAMILIES))))) == y
    assert right / len(texts) > 0.97


def test_a_found_paragraph_has_an_anchor():
    for xs in s.TEMPLATES.values():
        for x in xs:
            words = set(words_of(x))
            rest = words - set(s.anchors())
            assert len(rest) < s.LEAST_COVER * len(words)
