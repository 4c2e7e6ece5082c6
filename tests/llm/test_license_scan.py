import re

import pytest

from tokenloom.llm.license_scan import BASE, GATES, LEVELS, MADE, license_scan, rules


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
    norm = " " + " ".join(words) + " " if words else " "
    places = sorted((i, label) for p, label in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    found = []
    for n, (label, _, priority, confidence, expression) in enumerate(rules()):
        found += [(m.start(), -m.end(), priority, n, label, confidence) for m in re.finditer(expression, norm)]
    kept = []
    for d in sorted(found):
        if not any(e[0] <= d[0] and e[1] <= d[1] and e[2] <= d[2] and (e[:4] < d[:4]) for e in found if e is not d):
            kept.append(d)
    labels = {label for _, label in places}
    score = max([d[5] for d in kept], default=0.5 if places else 0.0)
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(labels)), ",".join(sorted(labels | {d[4] for d in kept})), max(score, 0.5 if places else 0.0)


def found(df):
    return [tuple(r) for r in df.select("doc_id", "text", *[c for c in MADE if c != "detections"]).collect()]


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License)", "CC BY 4.0; cc-by-sa 3.0 and CC BY-NC-ND", "GNU General Public License v3, general public license", "ALL RIGHTS RESERVED all rights reserved",
    "SPDX-License-Identifier: MIT\nPermission is hereby granted, free of charge, to any person obtaining a copy", "released into the public domain. public domain!", "MIT license MIT License mit licence", "bsd 3 clause",
    "3-Clause BSD License, new BSD license", "lesser general public license 2.1 or library general public license", "copyright (c) 2019 2020 some. No rights reserved", "cc by cc by cc by", "accby cc byx", "é cc by é", None, "", "...", "wtfpl",
    "Creative Commons Attribution-ShareAlike 4.0 International Public License version 4.0", "free software", "licensed under the terms of the Mozilla Public License version 2.0 and MPL-2.0",
]


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, " / ".join(t or "" for t in TEXTS)), (101, " ".join((t or "") * 2 for t in TEXTS[::-1]))]
    for r in found(license_scan(spark.createDataFrame(rows, "doc_id long, text string"))):
        assert r[2:] == brute(r[1]), r


def test_long_texts_are_scanned_whole(spark, monkeypatch):
    """Many detections in one text, in pieces of any size, and runs of years of any length."""
    from tokenloom.llm import license_scan as module

    filler = "plain words that say nothing of the kind at all".split()
    texts = [" ".join(" ".join(filler[: k % 9]) + " " + (TEXTS[k % len(TEXTS)] or "") for k in range(start, start + 60)) for start in range(0, 40, 5)]
    texts += ["x " * n + "copyright" + " 1999" * 200 + " all rights reserved" + " y" * n for n in (3, 3900, 4090, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = license_scan(df).select("doc_id", "detections").collect()
    for size in (2, 7):
        monkeypatch.setattr(module, "PIECE", size)
        assert sorted(license_scan(df).select("doc_id", "detections").collect()) == sorted(whole)
    assert max(len(r.detections) for r in whole) > 50
    for r in found(license_scan(df)):
        assert r[2:] == brute(r[1])
    years = {r.doc_id: [d for d in r.detections if d.label == "copyright"] for r in whole}
    assert all(len(years[i]) == 1 and years[i][0].end - years[i][0].start == len("copyright") + 200 * 5 for i in range(8, 12))


def test_very_many_detections_in_one_text(spark):
    r = license_scan(spark.createDataFrame([(1, "all rights reserved, CC BY 4.0. " * 30_000)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, len(r.detections), r.first_word, r.last_word) == (210_000, 60_000, 60_000, 0, 209_996 + 0)


def test_odd_rows(docs, empty, clashing):
    for r in found(license_scan(clashing)):
        assert r[2:] == brute(r[1])
    assert license_scan(clashing).count() == docs.count() and license_scan(empty).collect() == []
    assert sorted(license_scan(clashing).columns) == sorted({*clashing.columns, *MADE})


def test_rules_are_hundreds_and_gated():
    assert len(rules()) > 300 and all(0 <= p < LEVELS for _, _, p, _, _ in rules())
    for _, keyword, _, _, expression in rules():
        re.compile(expression)
        assert keyword == keyword.lower()


@pytest.mark.parametrize("rule", range(0, 397, 3))
def test_no_gate_hides_a_rule(rule):
    """A text made from the rule itself passes the gates and has the rule's keyword."""
    _, keyword, _, _, expression = rules()[rule]
    text = expression.removeprefix("(?<= )(?:").removesuffix(")(?= )")
    while (flat := re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)?\)\??", r"\1", text)) != text:
        text = flat
    text = " " + re.sub(r"\[cs\]", "s", re.sub(r"\[0-9\]\{4\}\+?", "2020", text)).replace(" ?", " ").replace("?", "").replace("+", "") + " "
    text = re.sub(" +", " ", text)
    assert re.search(expression, text), text
    assert keyword in text and any(g in text for g in GATES), text


def forms(expression):
    """Texts that the expression matches: each choice in it (optional part, alternative, letter of a class) both ways, with the others first and last."""
    from re import _parser as parser

    def render(items, choose):
        out = ""
        for op, arg in items:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "IN":
                letters = [chr(c) for o, v in arg for c in (range(v[0], v[1] + 1) if str(o) == "RANGE" else [v])]
                out += letters[choose(len(letters))]
            elif kind == "BRANCH":
                out += render(arg[1][choose(len(arg[1]))], choose)
            elif kind == "SUBPATTERN":
                out += render(arg[3], choose)
            elif kind == "MAX_REPEAT":
                low, high, body = arg
                for _ in range(low + choose(2) if high > low else low):
                    out += render(body, choose)
            else:
                assert kind == "ASSERT", kind
        return out

    tree, found = list(parser.parse(expression)), set()
    for last in (False, True):
        sizes = []

        def base(n, sizes=sizes, last=last):
            sizes.append(n)
            return n - 1 if last else 0

        found.add(render(tree, base))
        for at, n in enumerate(sizes):
            for other in range(n):
                count = iter(range(10**6))
                found.add(render(tree, lambda n, at=at, other=other, last=last, count=count: other if next(count) == at else n - 1 if last else 0))
    return found


@pytest.mark.parametrize("part", range(8))
def test_no_form_of_a_rule_is_hidden(part):
    """Every rule, with both forms of each optional part: a text of it passes the gates and has the rule's keyword."""
    assert len(rules()) > 500
    for _, keyword, _, _, expression in rules()[part::8]:
        for form in forms(expression):
            text = f" {form} "
            assert re.search(expression, text), (expression, text)
            assert keyword in text and any(g in text for g in GATES), (keyword, text)


def test_fused_and_singular_words(spark):
    texts = {"Licensed under GPLv3": "gpl-3", "gnu gpl2": "gpl-2", "GPLv2 only": "gpl-2", "X is a registered trademark of Y": "trademark", "trademarks of Y": "trademark", "for noncommercial use only": "noncommercial"}
    rows = list(enumerate(texts))
    got = found(license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r[1]: r[-2] for r in got} == texts
    for r in got:
        assert r[2:] == brute(r[1]), r
