"""op11: base columns against a plain scan of word lists, the rules against a plain pass in Python."""

import math
import re

from pyspark.sql import functions as F

from piisieve.llm import licenses
from piisieve.llm.queries import QUERIES

NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    folded = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in NOT_WORD.split(folded) if w]


def plain_scan(text):
    words = plain_words(text)
    starts, base = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    numbered = " " + " ".join(f"{i}:{w}" for i, w in enumerate(words)) + " "
    found = []
    for rule_id, label, keyword, regex, priority in licenses.rules():
        if keyword in words:
            for m in re.finditer(licenses.numbered_pattern(regex), numbered):
                start = int(m.group(0).split(":")[0])
                found.append((start, -(start + len(m.group(0).split(" "))), priority, rule_id, label))
    kept, reach = [], {}
    for start, minus_end, priority, rule_id, label in sorted(found):
        if any(p <= priority and end >= -minus_end for p, end in reach.items()):
            continue
        kept.append((label, licenses.WEIGHTS[priority]))
        reach[priority] = max(reach.get(priority, -1), -minus_end)
    # A detection is also covered by one of a smaller priority number that reaches as far.
    score = 1 - math.prod(1 - w for _, w in kept)
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
        "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {label for label, _ in kept})), "score": score,
    }


SAMPLES = [
    None, "", "   ", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. All rights reserved. cc by", "Licensed under the Apache License, Version 2.0.",
    "Copyright (c) 2021 ACME. GNU Lesser General Public License v2.1 SPDX-License-Identifier: MIT",
    "CC BY cc by CC-BY-SA 3.0 Creative Commons Attribution-ShareAlike 4.0 International general public license",
    "Wir sind mit dem Ergebnis zufrieden.", "all rights reserved " * 3000, "mozilla public license 2.0 © 2020 2021",
    "GNU GPL v3 and the gpl; BSD 3-Clause; new BSD; the unlicense; public domain",
]


def compare(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, labels int, score string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _, _ in rows:
        want, row = plain_scan(text), got[doc_id]
        for key, value in want.items():
            if key == "score":
                assert math.isclose(row[key], value, abs_tol=1e-9), (text, key)
            else:
                assert row[key] == value, (text, key, row[key], value)


def test_license_rules_against_a_plain_pass(spark):
    compare(spark, [(i, t, 1, "x") for i, t in enumerate(SAMPLES)])


def test_license_rules_on_documents(spark, sf_texts):
    compare(spark, [(i, t, 1, "x") for i, t in sf_texts.items()])


def test_license_labels(spark):
    rows = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "doc_id long, text string")).collect()
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[3] == "gpl,gpl-3.0"  # the family rule lies inside the versioned one
    assert labels[4] == "cc-by,cc-by-nc-4.0,reserved"
    assert labels[6] == "copyright,gpl,lgpl-2.1,mit"
    assert labels[8] == ""  # German "mit" is no license
    assert {r.doc_id: r.score for r in rows}[0] == 0.0


def test_license_query_and_empty_table(spark, sf_dir, empty):
    out = QUERIES["op11_license_scans"](spark, sf_dir)
    assert out.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert out.where(F.col("labels").contains("apache-2.0")).count() > 0
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(empty.select("doc_id", "text", "label")).columns[0] == "doc_id"


def test_rules_are_many_and_keyword_gated():
    table = licenses.rules()
    assert len(table) >= 200
    for _, _, keyword, regex, _ in table:
        assert keyword in regex or keyword == "spdx" or keyword in ("©",), regex
