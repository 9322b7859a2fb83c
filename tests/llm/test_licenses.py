import random
import re
from re import _parser as parser

import oracle

from factloom.llm import licenses, queries


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = queries.queries()["op2_license_scan"](spark, sf)
    assert oracle.compare(df, oracle.connect(sf), queries.oracle_sql()["op2_license_scan"]) is None


def test_rules():
    rules = licenses.rules()
    assert len(rules) > 300 and [r.order for r in rules] == list(range(len(rules)))
    for rule in rules:
        re.compile(rule.pattern)


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spaced, found = " " + "  ".join(words) + " ", []
    for rule in licenses.rules():
        for m in re.finditer(rule.pattern, spaced):
            first = spaced[: m.start()].count(" ") // 2
            found.append((first, first + m[0].count(" ") // 2 - 1, rule))
    kept = []
    for a, z, rule in found:
        mine = (a, -z, rule.priority, rule.order)
        inside = any(
            x <= a and z <= y and r.priority <= rule.priority and (x, -y, r.priority, r.order) < mine for x, y, r in found
        )
        if rule.base or not inside:
            kept.append(rule)
    base = [(a, r.label) for a, _, r in found if r.base]
    return (
        len(words), len(base), min((a for a, _ in base), default=None), max((a for a, _ in base), default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted({r.label for r in kept})),
        max((licenses.CONFIDENCE[r.priority] for r in kept), default=0.0),
    )


def test_against_brute_force(spark, documents, odd):
    texts = [
        "MIT License\nMit  license, the MIT-license", "Licensed under the Apache License, Version 2.0. apache license",
        "This work is licensed under the GNU General Public License, version 3. general public\tlicense",
        "SPDX-License-Identifier: BSD-3-Clause and GPL-3.0-or-later", "mit licenses are not a license", "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy MIT license", "the unlicense License mit",
        "É mit license é", "license", "mit license " * 500, "",
    ]
    for docs in (documents(list(enumerate(texts))), odd):
        rows = docs.select("doc_id", "text").collect()
        got = licenses.scan_licenses(docs).drop("doc_id").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(r.text)) for r in rows)
    out = {r.doc_id: r for r in licenses.scan_licenses(documents(list(enumerate(texts)))).collect()}
    assert (out[0].n_base, out[0].first_word, out[0].last_word, out[0].base_labels) == (3, 0, 5, "mit")
    assert out[1].base_labels == "apache" and "apache-2.0" in out[1].labels.split(",")
    assert licenses.scan_licenses(documents([])).collect() == []


def test_no_python_in_the_plan(spark, documents):
    plan = licenses.scan_licenses(documents([(1, "mit license")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!ToRow)", plan)


PHRASES = [
    "Released under the GNU GPL v3.", "Distributed under the Apache 2.0", "Creative Commons Attribution 4.0", "CC0 1.0 Universal",
    "Altered source versions must be plainly marked as such", "merchantability, fitness for a particular purpose and noninfringement",
    "Common Development and Distribution License", "European Union Public Licence 1.2", "Open Software License 3.0",
    "Q Public License", "Expat License", "GNU Library General Public License", "Creative Commons Zero", "CC Zero",
    "You may not use this file except in compliance with the License.", "Do what the fuck you want to public license",
    "This license is copied below, and is also available with a FAQ", "Creative Commons Attribution-ShareAlike 4.0",
]


def test_phrases_without_the_usual_words(spark, documents):
    docs = documents([*enumerate(PHRASES), (99, "no such words")])
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(docs).collect()}
    for i, text in enumerate(PHRASES):
        assert got[i] == brute(text) and got[i][5], text
    assert got[99] == brute("no such words") and not got[99][5]


def test_every_match_holds_an_implied_word():
    draw = random.Random(8)

    def sample(tree):
        out = ""
        for kind, value in tree:
            if kind is parser.LITERAL:
                out += chr(value)
            elif kind is parser.IN:
                out += chr(draw.choice(value)[1])
            elif kind is parser.SUBPATTERN:
                out += sample(value[3])
            elif kind is parser.BRANCH:
                out += sample(draw.choice(value[1]))
            else:
                assert kind is parser.MAX_REPEAT
                out += "".join(sample(value[2]) for _ in range(draw.randint(value[0], value[1])))
        return out

    for rule in licenses.rules():
        tree = parser.parse(rule.pattern)
        for _ in range(30):
            text = sample(tree)
            assert re.fullmatch(rule.pattern, text) and set(licenses.implied_words(rule)) & set(text.split()), (rule, text)
            assert licenses.implied_text(rule) in text, (rule, text)


def test_texts_without_a_word_of_a_rule_are_not_cut(spark, documents):
    plan = licenses.detect(documents([(1, "mit license")]))._jdf.queryExecution().optimizedPlan().toString()
    cut = [line for line in plan.splitlines() if "translate(" in line]
    assert len(cut) == 1 and "Generate inline(transform(filter(" in cut[0]


def test_words_of_rules_at_odd_places(spark, documents):
    texts = [
        "MIT LICENSE", "mitt license", "xmit license", "🙂mit license", "mit🙂 license", "mit license🙂", "-mit-license-", "é mit\x00license",
        "mıt license", "GNU GENERAL PUBLIC LICENſE", "apacheK license 2.0", "\n\n mit", "0", " ", "- 0 -", "ccby 4.0 cc by 4.0",
        "creativecommons.org/licenses/by/4.0", "commons creative commons attribution 4.0 common public license 1.0", " " * 300_000,
    ]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(documents(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute(text), text
