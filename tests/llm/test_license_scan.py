import random
import re

import pytest

from tests.llm.corpora import frame, mixed, odd
from tidemark.llm.license_scan import BASE, ROOTS, rules, scan

RULES = rules()
TOKENS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLANTED = [
    ("Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
    ("GNU General Public License version 2 or (at your option) any later version", {"gpl", "gpl-2.0-or-later"}),
    ("Released under the MIT License.", {"mit"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}),
    ("CC BY cc by CC\nBY", {"cc-by"}),
    ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0-or-later"}),
    ("Mozilla Public License 2.0", {"mpl", "mpl-2.0"}),
    ("summit license, ccby, apachelicense, gnu general public licenses", set()),
    ("public domain", {"public-domain"}),
]


def base(text):
    words = TOKENS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def corpus():
    rng = random.Random(2)
    rows = mixed() + odd()
    for i in range(60):
        parts = [rng.choice(PLANTED)[0] for _ in range(rng.randrange(1, 4))]
        rows.append((1000 + i, f"\n{'x ' * rng.randrange(5)}".join(parts), "en", "s", 0))
    return [*rows, (2000, "mit license " * 20_000, "en", "s", 0)]


@pytest.mark.parametrize("rows", [corpus(), []])
def test_base_against_brute_force(spark, rows):
    got = scan(frame(spark, rows, clash=True)).collect()
    seen = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str)
    assert seen == sorted(((r[0], *base(r[1])) for r in rows), key=str)
    for r in got:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert (r["score"] > 0) == bool(r["labels"]) and r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))


def detections(text):
    """Every match of every rule as an interval, and of these the ones that lie in no other one, all against all, in Python."""
    text = re.sub(r"(?i)(gpl\S{0,6}[0-9])\+", r"\1 or later", text or "")
    t = " " + " ".join(TOKENS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))) + " "
    found = [(m.start(1), m.end(1), i) for i, (_, _, _, pattern) in enumerate(RULES) for m in re.finditer(pattern, t)]
    kept = set()
    for a, b, i in found:
        if not any(x <= a and b <= y and (y - x > b - a or j < i) for x, y, j in found):
            kept.add(i)
    return kept


def expected(text):
    kept, labels = detections(text), set(filter(None, base(text)[4].split(",")))
    miss = 0.5 ** len(labels)
    for i in kept:
        miss *= 1 - RULES[i][2]
    return ",".join(sorted(labels | {RULES[i][0] for i in kept})), miss


def pieces_of_rules(seed):
    """Texts of words that the rules are made of, so that rules meet, contain and overlap one another."""
    rng = random.Random(seed)
    parts = "gnu general public license version 2 0 1 or later lesser gpl lgpl agpl v2 v3 only with the classpath exception licensed under mit apache software bsd 3 clause creative commons attribution cc by sa 4 nc mozilla released the terms of in public domain copyright 2020 foo".split()
    return [(i, rng.choice((" ", "-", ", ")).join(rng.choice(parts) for _ in range(rng.randrange(3, 60))), "en", "s", 0) for i in range(300)]


@pytest.mark.parametrize("rows", [corpus()[:-1], pieces_of_rules(1), pieces_of_rules(2)])
def test_labels_and_score_against_brute_force(spark, rows):
    seen = sorted(((r["doc_id"], r["labels"], round(r["score"], 9)) for r in scan(frame(spark, rows)).collect()), key=str)
    want = sorted(((r[0], label, round(1 - miss, 9)) for r in rows for label, miss in [expected(r[1])]), key=str)
    assert seen == want


NAMED = [
    ("GNU Lesser General Public License version 2.1", "lgpl-2.1"),
    ("GPL-3.0-or-later", "gpl-3.0-or-later"),
    ("licensed under GPL-2.0+", "gpl-2.0-or-later"),
    ("GNU General Public License version 2 with the Classpath Exception", "gpl,gpl-2.0-with-classpath-exception"),
    ("LGPL v2.1 only", "lgpl-2.1"),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("GNU General Public License version 2 or (at your option) any later version", "gpl,gpl-2.0-or-later"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("Mozilla Public License 2.0", "mpl-2.0"),
    ("summit license, ccby, apachelicense, gnu general public licenses", ""),
]


def test_named_cases(spark):
    got = {r["doc_id"]: r["labels"] for r in scan(frame(spark, [(i, t, "en", "s", 0) for i, (t, _) in enumerate(NAMED)])).collect()}
    assert [got[i] for i in range(len(NAMED))] == [label for _, label in NAMED]


def test_the_prefilter_loses_nothing():
    assert len(RULES) > 300
    for _, keyword, _, pattern in RULES:
        # without what is optional or one of several, the pattern still has the keyword, and the keyword a root
        needed = re.sub(r"\(\?:[^()]*\)\??", " ", pattern[2:-6])
        assert keyword.strip() in re.sub(r"\[cs\](?!\?)", "", needed) or keyword.strip() in needed, (keyword, needed)
        assert any(root in keyword for root in ROOTS), keyword


def test_plan_has_no_python(spark):
    assert "Python" not in scan(frame(spark, corpus()[:5]).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()


def test_names_in_any_script_and_spellings(spark):
    texts = ["licensed under égalité", "Licenced under the Foo terms", "Licenced under the terms of 日本", "FreeBSD License", "a freebsd style licence", "licensed under the MIT License", "licensed under"]
    got = {r["doc_id"]: r["labels"] for r in scan(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == ["license-unknown"] * 3 + ["bsd"] * 2 + ["mit", ""]
