"""Licence statements against ungated rules and pairwise containment."""

from __future__ import annotations

import random
import re
from re import _parser

import pytest
from pyspark.sql import functions as F

from creatorlens.llm import catalog, common, license_scan
from creatorlens.llm.license_rules import KINDS, PHRASES, Rule, rules

RULES = rules()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sample(expression, rng):
    """A text that the expression matches."""

    def made(tree):
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                out += next(chr(x[1][0] if str(x[0]) == "RANGE" else x[1]) if str(x[0]) != "NEGATE" else "x" for x in arg)
            elif name == "NOT_LITERAL":
                out += "x"
            elif name == "BRANCH":
                out += made(rng.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += made(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(made(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
            else:
                raise AssertionError(name)
        return out

    return made(_parser.parse(expression))


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    joined = " ".join(words)
    hits = []
    for n, rule in enumerate([*RULES, *(Rule(label, "phrase", frozenset(), re.escape(p)) for label, p in PHRASES)]):
        for m in re.finditer(f"(?<![^ ])(?:{rule.expression})(?![^ ])", joined):
            start = joined[: m.start()].count(" ")
            hits.append((list(KINDS).index(rule.kind), n, start, start + m[0].count(" ") + 1, rule.label, rule.kind))

    def better(a, b):
        return a[2] <= b[2] and a[3] >= b[3] and (a[0], b[2] - b[3] if a[2:4] == b[2:4] else a[2] - a[3], a[1]) < (b[0], b[2] - b[3], b[1])

    stay = [h for h in hits if not any(better(o, h) for o in hits if o is not h)]
    base = []
    for label, phrase in PHRASES:
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(base), sorted((h[2], h[3], h[4], h[5]) for h in stay), max((KINDS[h[5]] for h in stay), default=0.0)


def texts():
    rng = random.Random(9)
    statements = [sample(r.expression, rng) for r in RULES]
    out = [
        None, "", " \n", "LICENSED under the Apache License, Version 2.0. All RIGHTS\treserved!", "cc by cc by CC-BY-NC-SA 4.0 général public license",
        "GNU Lesser General Public License version 3 or later, gnu  general public license", "SPDX-License-Identifier: GPL-3.0-or-later",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this Software", "Tous droits réservés. Nonsense mit licenses apaches",
        "word " * 5000 + "MIT License " * 200, "x" * 50000, ("lorem " * 30000) + "mozilla public license 2.0 " + "ipsum " * 30000,
    ]
    for _ in range(120):
        parts = [rng.choice(statements).title() for _ in range(rng.randint(1, 4))]
        out.append(rng.choice([" ", "\n", ", "]).join(["the"] * rng.randint(0, 3) + parts + ["end."] * rng.randint(0, 2)))
    return out


def test_rules_are_many_and_gated():
    assert len(RULES) > 300 and len({(r.kind, r.label, r.expression) for r in RULES}) == len(RULES)
    rng = random.Random(1)
    for r in RULES:
        for _ in range(6):
            text = sample(r.expression, rng)
            assert re.fullmatch(r.expression, text) and r.gate <= set(text.split()), (r, text)
            assert text == " ".join(WORD.findall(text.translate(LOWER)))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i) for i, t in enumerate(texts())] + [(3, "all rights reserved", 0), (3, "all rights reserved", 0), (None, "cc by", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, found long").withColumns({"score": F.lit("s"), "base": F.lit("b"), "_text2": F.lit(1)})


def test_statements_by_brute_force(docs):
    got = license_scan.scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        found = (r.n_words, sorted((b.start, b.label) for b in r.base), sorted((f.start, f.stop, f.label, f.kind) for f in r.found), r.score)
        assert found == brute(r.text), r.text[:200]


def test_own_rules_and_no_rows(spark, docs):
    own = [Rule("a", "text", frozenset(["x"]), "x y"), Rule("b", "text", frozenset(["x"]), "x y z"), Rule("c", "tag", frozenset(["y"]), "w x y z"), Rule("d", "name", frozenset(["y"]), "y")]
    got = license_scan.scan(spark.createDataFrame([("w x y z y",)], "text string"), own, []).first()
    assert [(f.label, f.start, f.stop) for f in got.found] == [("c", 0, 4), ("b", 1, 4), ("d", 4, 5)] and not got.base and got.score == 1.0
    assert license_scan.scan(docs.where("false")).count() == 0


def test_query_over_the_table(spark, sf):
    got = {r.doc_id: r for r in catalog.op11_licenses(spark, sf).collect()}
    rows = common.table(spark, sf, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        n, base, stay, score = brute(r.text)
        g = got[r.doc_id]
        starts = [s for s, _ in base]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.score) == (n, len(base), min(starts, default=None), max(starts, default=None), score)
        assert g.base_labels == ",".join(sorted({b for _, b in base}))
        assert g.labels == ",".join(sorted({b for _, b in base} | {s[2] for s in stay}))
    assert any("apache" in g.labels for g in got.values())
