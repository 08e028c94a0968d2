import random
import re

from quarry.llm.licenses import NOTICES, TEMPLATES, scan_licenses
from quarry.llm.queries import op9_license_scan
from tests.llm.conftest import SF


def plain(texts):
    """(id, license) whose template has at least 0.8 of its five-word shingles within one run of its length."""
    found = set()
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for name, own in TEMPLATES.items():
        for t in own:
            w = split(t)
            want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            size = 1 << max(0, (len(w) - 5).bit_length())
            for i, text in texts.items():
                v = split(text)
                have = [tuple(v[k : k + 5]) for k in range(len(v) - 4)]
                for k in range(len(have)):
                    if want and len(want & set(have[k : k + size])) >= 0.8 * len(want):
                        found.add((i, name))
    return found


def test_against_plain_windows(spark, docs):
    rng = random.Random(3)
    texts = {r.doc_id: r.text for r in docs.limit(120).collect()}
    for n, (name, own) in enumerate(TEMPLATES.items()):
        for k, t in enumerate(own):
            words = t.upper().split()
            if k % 2:
                words[rng.randrange(len(words))] = "changed"
            host = texts[(n * 7 + k) % 100].split()
            at = rng.randrange(len(host) + 1)
            texts[1000 + 10 * n + k] = " ".join(host[:at] + words + host[at:])
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = scan_licenses(table).collect()
    got = {(r.doc_id, r.license) for r in out}
    assert plain(texts) <= got
    assert all(r.containment >= 0.8 and r.first_word <= r.last_word for r in out)
    planted = {i for i, _ in got}
    assert not {i for i in planted if i < 1000 and "icense" not in texts[i]}


def test_hard_rows(spark, hard, empty):
    assert scan_licenses(hard).count() == 0 and scan_licenses(empty).count() == 0
    notice = "Released under the MIT License."
    rows = [(1, notice), (1, notice), (2, None), (None, notice), (3, "word " * 20000 + notice)]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license, r.first_word) for r in out) == [("1", "MIT", 0), ("3", "MIT", 20000), ("None", "MIT", 0)]
    assert scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates={"x": ["too short"]}).count() == 0


#: The license lines planted in the given documents.
PLANTED = {
    "All rights reserved.": "proprietary",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
}


def test_every_license_line_in_the_documents_is_found(spark, docs):
    want = {(r.doc_id, name) for r in docs.collect() for line, name in PLANTED.items() if line in (r.text or "")}
    got = {(r.doc_id, r.license) for r in op9_license_scan(spark, SF).collect()}
    assert got == want and {"proprietary"} < {name for _, name in want}


def test_notices_and_other_license_families(spark):
    texts = {
        1: ("Copyright 2020 A. All Rights\nReserved", {"proprietary"}),
        2: ("all rights were reserved, and rights reserved", set()),
        3: ("you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free "
            "Software Foundation; either version 2.1 of the License, or later", {"LGPL-2.1"}),
        4: ("GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007\n\n Copyright", {"AGPL-3.0"}),
        5: ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", {"GPL-2.0"}),
        6: ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.", {"ISC"}),
        7: ("This is free and unencumbered software released into the public domain.", {"Unlicense"}),
        8: ("This program is made available under the terms of the Eclipse Public License 2.0 which", {"EPL-2.0"}),
        9: ("Creative Commons Legal Code\n\nCC0 1.0 Universal\n", {"CC0-1.0"}),
        11: ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
             "License", set()),  # the end of a GPL-3.0 notice is neither of the other two
        12: ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n", {"LGPL-3.0"}),
        13: ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n", {"GPL-3.0"}),
        10: ("all rights reserved " * 3, {"proprietary"}),
    }
    table = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    out = scan_licenses(table, notices=NOTICES).collect()
    assert {(r.doc_id, r.license) for r in out} == {(i, n) for i, (_, names) in texts.items() for n in names}
    places = {r.doc_id: (r.first_word, r.last_word, r.containment, r.windows) for r in out}
    assert places[1] == (3, 5, 1.0, 1) and places[10] == (0, 8, 1.0, 3)
    only = scan_licenses(table, templates={}, notices=NOTICES).collect()
    assert {r.doc_id for r in only} == {1, 10}


def test_rows_that_share_an_id_are_searched_on_their_own(spark):
    notice = TEMPLATES["MIT"][2].split()
    half = len(notice) // 2
    rows = [(None, " ".join(notice[:half])), (None, " ".join(notice[half:])), (1, " ".join(notice[:half])), (1, " ".join(notice[half:]))]
    assert scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    rows += [(1, " ".join(notice)), (1, "another text")]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license) for r in out] == [(1, "MIT")]


def test_clauses_of_full_texts(spark):
    rows = [(i, f"before all this {t} and after") for i, (_, t) in enumerate(BODY)]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in out} == {(i, name) for i, (name, _) in enumerate(BODY)}


BODY = [(name, t) for name, own in TEMPLATES.items() for t in own if "AS IS" in t]
