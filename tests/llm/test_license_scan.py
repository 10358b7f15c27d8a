import random
import re
from re import _constants as C
from re import _parser

import pyarrow.parquet as pq

from quarrylens.llm import license_rules
from quarrylens.llm import license_scan as X

from ..conftest import SF

DOCS = "doc_id long, text string, lang string, labels string, score int"
RULES = X.Rules(license_rules.parsed())


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))


def brute(text):
    """n_words, n_base, first_word, last_word, base_labels, and all detections by trying every rule at every word."""
    words = brute_words(text)
    places = [(i, label) for phrase, label in license_rules.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    joined = " ".join(words)
    found = []
    for order, (label, priority, _, expression) in enumerate(license_rules.parsed()):
        for m in re.finditer(r"(?<![^ ])(?:" + expression + r")(?![^ ])", joined):
            found.append((-priority, m.start() - m.end(), m.start(), order, m.end(), label))
    kept = []
    for f in sorted(found):
        if not any(k[2] <= f[2] and f[4] <= k[4] for k in kept):
            kept.append(f)
    at = [i for i, _ in places]
    base = {x for _, x in places}
    score = max([-f[0] for f in kept] + [X.BASE_PRIORITY] * bool(places), default=0) / 100
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {f[5] for f in kept})), score


def sample(parsed, r):
    """A random match of a parsed expression."""
    out = ""
    for op, arg in parsed:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.IN:
            out += sample([r.choice(arg)], r) if arg[0][0] is not C.CATEGORY else "x"
        elif op is C.RANGE:
            out += chr(r.randint(*arg))
        elif op is C.ANY or op is C.CATEGORY:
            out += "x"
        elif op is C.SUBPATTERN:
            out += sample(arg[3], r)
        elif op is C.BRANCH:
            out += sample(r.choice(arg[1]), r)
        elif op is C.MAX_REPEAT:
            out += "".join(sample(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 1))))
        else:
            raise ValueError(op)
    return out


def test_every_match_holds_its_keyword_and_is_found():
    assert len(RULES.rules) > 250
    r = random.Random(1)
    for i, (label, priority, keyword, expression) in enumerate(RULES.rules):
        assert 0 < priority <= 100
        for _ in range(40):
            text = sample(_parser.parse(expression), r)
            assert keyword in text.split(), (expression, text)
            words = X.text_words(f"a {text} b")
            assert i in {m[2] for m in RULES.matches(words, b" ".join(words))}


def test_against_brute_force(spark):
    r = random.Random(2)
    texts = [x["text"] for x in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    names = [sample(_parser.parse(x[3]), r) for x in RULES.rules] + [p for p, _ in license_rules.BASE] * 5
    for _ in range(150):
        parts = [r.choice(names) if r.random() < 0.4 else r.choice(["Das", "mit", "é", "über", "license", "cc", "by", "or later", "2.0", "K"]) for _ in range(r.randrange(12))]
        texts.append(r.choice([" ", "-", "\n* ", "\u2009 "]).join(p.upper() if r.random() < 0.2 else p for p in parts))
    texts += [None, "", "...", "MIT License", "mitlicense", "MIT-LICENSE, The Apache License 2.0. CC-BY: apache license", "GNU General\n * Public License, version 3"]
    docs = spark.createDataFrame([(i, t, "en", "clash", 1) for i, t in enumerate(texts)], DOCS)
    got = X.scan_licenses(docs.repartition(3), keep_columns=["doc_id"]).collect()
    assert len(got) == len(texts)
    for row in got:
        assert tuple(row)[1:-1] == brute(texts[row.doc_id]), texts[row.doc_id]


def labels(text):
    return [d.label for d in X.scan_text(text, RULES)[2]]


def test_priority_and_containment():
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("GNU General Public License v2.0 or any later version") == ["gpl-2.0-or-later"]
    assert labels("GNU Lesser General Public License v2.1") == ["lgpl-2.1"]
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3-clause"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("either the MIT license or the Apache License 2.0") == ["mit", "apache-2.0"]
    assert labels("Er kam mit der Lizenz und ging mit uns, by the way: permission denied, all rights.") == []
    rules = [("a", 50, "x", "x y"), ("b", 50, "y", "y z"), ("c", 40, "z", "w x y z"), ("d", 50, "x", "x y"), ("e", 30, "y", "y")]
    ready = X.Rules(rules)
    assert [d.label for d in X.scan_text("W x y z", ready)[2]] == ["c", "a", "b"]  # c is longer but weaker, and contains; d ties with a


def test_defined_cases(spark):
    assert X.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
    long = "wort " * 300_000 + "MIT License " * 20_000
    rows = X.scan_licenses(spark.createDataFrame([(1, long, "de", "clash", 1), (1, long, "de", "clash", 1), (None, None, None, None, None)], DOCS))
    assert rows.columns == ["doc_id", "text", "lang", "labels", "score", "n_words", "n_base", "first_word", "last_word", "base_labels", "_labels", "_score", "detections"]
    got = rows.collect()
    assert [(x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x._labels) for x in got if x.doc_id] == [(340_000, 20_000, 300_000, 339_998, "mit", "mit")] * 2
    assert [(x.n_words, x.n_base, x.first_word, x._labels, x._score) for x in got if x.doc_id is None] == [(0, 0, None, "", 0.0)]
