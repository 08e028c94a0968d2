"""License scan in DataFrame operations only: MinHash bands over overlapping windows, then containment.

Templates and texts are sequences of five-word shingles.  A template whose shingles fit a stride of
2^c words belongs to class c; windows of class c are two strides long and overlap by one, so every
occurrence of the template lies within one window.  A window is sketched by BANDS minimum hashes, one a
band, and retrieves the templates of its class that share one.  Shingles that are in no template can
never be a shared minimum and are left out of the windows, which keeps the windows of ordinary text empty.
Retrieved pairs are verified by the exact share of the template's shingles in the window.

With containment of at least 0.8 at least a fifth of a window's places are the template's, so the chance
to miss it is below 0.8^BANDS; a whole template that fills its stride is missed with 0.5^BANDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 48

#: Short notices and opening passages of common public licenses.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
        "Released under the BSD License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC-BY-ND-4.0": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
    ],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced"],
    "GPL-2.0": [
        "terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "GNU General Public License, version 2",
    ],
    "LGPL-2.1": [
        "terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "GNU Lesser General Public License, version 2.1",
    ],
    "LGPL-3.0": [
        "terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU Lesser General Public License, version 3",
    ],
    "AGPL-3.0": [
        "terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU Affero General Public License, version 3",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "Licensed under the ISC License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to",
        "Creative Commons Legal Code CC0 1.0 Universal",
        "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "EPL-2.0": [
        "made available under the terms of the Eclipse Public License 2.0",
        "made available under the terms of the Eclipse Public License v2.0",
        "Eclipse Public License - v 2.0",
    ],
}
# clauses that stand in the body of full texts
TEMPLATES["MIT"] += [
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
]
TEMPLATES["BSD"] += [
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
]
TEMPLATES["Apache-2.0"] += [
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
]
TEMPLATES["ISC"] += [
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS",
]
# titles, by which full texts are found too; the GNU ones above are titles as well as notices
TEMPLATES["Apache-2.0"] += ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"]
TEMPLATES["GPL-3.0"] += ["GNU General Public License, version 3"]
TEMPLATES["MPL-2.0"] += ["Mozilla Public License Version 2.0"]

#: Notices too short for a shingle; their words are looked for as they are.
NOTICES = {
    "proprietary": ["All rights reserved."],
    "MIT": ["The MIT License", "SPDX-License-Identifier: MIT"],
    "ISC": ["The ISC License", "SPDX-License-Identifier: ISC"],
    "Apache-2.0": ["Apache License 2.0"],
    "Unlicense": ["SPDX-License-Identifier: Unlicense"],
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingle_at(hashes: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _places(n: Column, size: int) -> Column:
    """0..n-size, or nothing for a shorter sequence."""
    return F.when(n >= size, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def template_table(spark: SparkSession, templates: dict[str, list[str]], size: int = SHINGLE) -> DataFrame:
    """template, license, class, n (distinct shingles) and items of each text of at least ``size`` words."""
    rows = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, ts in sorted(templates.items()) for t in ts)]
    table = spark.createDataFrame(rows, "template int, license string, text string").select(
        "template", "license", _hashes(words(F.col("text"))).alias("h")
    )
    places = _places(F.size("h"), size)
    table = table.select(
        "template",
        "license",
        F.get("h", F.lit(0)).alias("first"),
        F.transform(places, lambda i: _shingle_at(F.col("h"), i, size)).alias("all"),
        F.transform(places, lambda i: F.get(F.col("h"), i)).alias("starts"),
    ).filter(F.size("all") > 0)
    return table.select(
        "template",
        "license",
        F.ceil(F.log2(F.size("all").cast("double"))).cast("int").alias("class"),
        F.array_distinct("all").alias("items"),
        "starts",
    )


def _band_values(item: Column, bands: int) -> list[Column]:
    return [F.min(F.xxhash64(item, F.lit(b))).alias(f"b{b}") for b in range(bands)]


def _banded(rows: DataFrame, bands: int, *keep: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"b{b}").alias("value")) for b in range(bands)])
    return rows.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.band", "x.value")


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, list[str]] = TEMPLATES,
    size: int = SHINGLE,
    containment: float = CONTAINMENT,
    bands: int = BANDS,
    notices: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row per document and license found: doc_id, license, containment, first_word, last_word, windows.

    containment is that of the best template and window, words are counted from 0 and the range spans the
    license's shingles in all matching windows.  A template of fewer than ``size`` words is never found; a
    notice is found where all its words follow each other, each place a window and containment 1.  Null, empty and short texts hold none.  Texts are scanned whole.  Repeated rows (one id and text) are
    one row; other rows that share an id, or have none, are searched on their own and reported together.  An empty table gives an empty result; other columns are
    ignored.  The template table is a parameter of fixed size, so its broadcast doesn't grow with the data.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates, size)
    known = table.select("template", "license", "class", "items", "starts").collect()  # the parameter itself
    items = sorted({x for r in known for x in r["items"]})
    starts = sorted({x for r in known for x in r["starts"]})
    classes = sorted({r["class"] for r in known})
    empty = "doc_id long, license string, containment double, first_word long, last_word long, windows long"
    if not items and not notices:
        return spark.createDataFrame([], empty)

    hashed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("own"), _hashes(words(F.col(text_col))).alias("h")
    )
    exact = _notice_places(hashed, notices) if notices else None
    if not items:
        return _per_license(exact)
    # the lambda binds the hashes once; only words that begin a template shingle are hashed further
    found = F.flatten(
        F.transform(
            F.array("h"),
            lambda h: F.filter(
                F.transform(
                    F.filter(_places(F.size(h), size), lambda i: F.get(h, i).isin(starts)),
                    lambda i: F.struct(i.alias("at"), _shingle_at(h, i, size).alias("item")),
                ),
                lambda x: x["item"].isin(items),
            ),
        )
    )
    places = hashed.select("doc_id", "own", F.explode(found).alias("x")).select("doc_id", "own", "x.at", "x.item")
    # each place is in the window that its stride begins and in the one before
    windows = F.flatten(
        F.array(
            *[
                F.array(
                    F.struct(F.lit(c).alias("class"), F.floor(F.col("at") / (1 << c)).alias("window")),
                    F.struct(F.lit(c).alias("class"), (F.floor(F.col("at") / (1 << c)) - 1).alias("window")),
                )
                for c in classes
            ]
        )
    )
    rows = places.select("doc_id", "own", "at", "item", F.explode(windows).alias("w")).select(
        "doc_id", "own", "at", "item", "w.class", "w.window"
    )
    # a window has at most two strides of places, so its lists are bounded by the longest template
    sketched = rows.groupBy("doc_id", "own", "class", "window").agg(
        *_band_values(F.col("item"), bands), F.collect_set(F.struct("item", "at")).alias("places")
    )
    per_template = table.select("template", "license", "class", F.explode("items").alias("item"))
    template_sketch = per_template.groupBy("template", "license", "class").agg(
        *_band_values(F.col("item"), bands), F.collect_set("item").alias("items")
    )
    probes = _banded(sketched, bands, "doc_id", "own", "class", "window", "places")
    targets = _banded(template_sketch, bands, "template", "license", "class", "items")
    pairs = probes.join(F.broadcast(targets), ["class", "band", "value"])
    inside = F.filter("places", lambda p: F.array_contains(F.col("items"), p["item"]))
    share = F.size(F.array_distinct(F.transform(inside, lambda p: p["item"]))) / F.size("items")
    checked = pairs.select(
        "doc_id",
        "own",
        "license",
        "class",
        "window",
        share.alias("containment"),
        F.array_min(F.transform(inside, lambda p: p["at"])).alias("first"),
        (F.array_max(F.transform(inside, lambda p: p["at"])) + size - 1).alias("last"),
    ).filter(F.col("containment") >= containment)
    return _per_license(checked.unionByName(exact) if notices else checked)


def _notice_places(hashed: DataFrame, notices: dict[str, list[str]]) -> DataFrame:
    """Rows as those of checked windows, one for every place at which all words of a notice follow each other.

    The class is the notice's negative number of words, which no template has.
    """
    rows = [(name, text) for name, texts in sorted(notices.items()) for text in texts]
    table = hashed.sparkSession.createDataFrame(rows, "license string, text string").select(
        "license", _hashes(words(F.col("text"))).alias("h")
    )
    wanted: dict[tuple[str, int], list[list[int]]] = {}
    for r in table.collect():  # the parameter itself
        if r["h"]:
            wanted.setdefault((r["license"], len(r["h"])), []).append(r["h"])
    found = F.flatten(
        F.array(
            *[
                F.transform(
                    F.filter(_places(F.size("h"), n), lambda i: _follow(F.col("h"), i, own)),
                    lambda i: F.struct(F.lit(name).alias("license"), i.alias("at"), F.lit(n).alias("n")),
                )
                for (name, n), own in wanted.items()
            ]
        )
    )
    places = hashed.select("doc_id", "own", F.explode(found).alias("x"))
    return places.select(
        "doc_id",
        "own",
        "x.license",
        (-F.col("x.n")).alias("class"),
        F.col("x.at").cast("long").alias("window"),
        F.lit(1.0).alias("containment"),
        F.col("x.at").alias("first"),
        (F.col("x.at") + F.col("x.n") - 1).alias("last"),
    )


def _follow(hashes: Column, i: Column, sequences: list[list[int]]) -> Column:
    """Whether one of the sequences stands at place i."""
    found = F.lit(False)
    for s in sequences:
        same = F.lit(True)
        for k, x in enumerate(s):
            same = same & (F.get(hashes, i + k) == F.lit(x))
        found = found | same
    return found


def _per_license(checked: DataFrame) -> DataFrame:
    return checked.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        F.count_distinct("own", "class", "window").alias("windows"),
    )
