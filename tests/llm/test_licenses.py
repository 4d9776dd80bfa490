import re

import pytest
from pyspark.sql import functions as F

from polyscene.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.decode().split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(make, messy):
    texts = messy + ["Released under the MIT License.", "mit license mit license, MIT-license", "submit license", "MIT\nLICENSE Apache license general public license", "mitlicense"]
    got = licenses.scan_documents(make(texts).withColumn("labels", F.lit(1))).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t)
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice."""
THIRD = " 3. Neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software"
GNU = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {} as published by
# the Free Software Foundation, either version {} of the License, or"""
SAMPLES = [
    (MIT, "mit"),
    (BSD, "bsd-2-clause"),
    (BSD + THIRD, "bsd-3-clause"),
    (BSD + " All advertising materials mentioning features or use of this software must display the following acknowledgement: x." + THIRD, "bsd-4-clause"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", "isc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0bsd"),
    ('// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.', "apache-2.0"),
    (GNU.format("General Public License", 3), "gpl-3.0"),
    (GNU.format("General Public License", 2), "gpl-2.0"),
    (GNU.format("Lesser General Public License", "2.1"), "lgpl-2.1"),
    (GNU.format("Lesser General Public License", 3), "lgpl-3.0"),
    (GNU.format("Affero General Public License", 3), "agpl-3.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0.", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software", "zlib"),
    ("Distributed under the Boost Software License, Version 1.0.", "bsl-1.0"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
    ("SPDX-License-Identifier:MIT", "mit"),
    ("SPDX-License-Identifier: (GPL-2.0-or-later)", "gpl-2.0"),
    ("SPDX-License-Identifier: Apache-2.0.", "apache-2.0"),
    ("Apache License, v2.0", "apache-2.0"),
    ("License:MIT License", "mit"),
    ("Expat License, PSF License", "mit,python-2.0"),
    ("GNU Library General Public License", "lgpl"),
    ("Licensed under the GNU Affero General Public License v3", "agpl-3.0"),
    ("This work is licensed under the GNU General Public\n License, version 3.", "gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("see https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
    ("a driving licence for the bus", ""),
    ("mit der zeit", ""),
]


@pytest.mark.parametrize(("text", "labels"), SAMPLES)
def test_signatures(text, labels):
    table = licenses.rules()
    found = licenses.detections(text.lower(), table)
    assert ",".join(sorted({x for _, _, x, _ in found})) == labels
    assert found == licenses.detections(text.lower(), table, gated=False)


def test_stronger_kinds_contain_weaker_ones():
    table = licenses.rules()
    assert [r.rank for r in table] == sorted(r.rank for r in table)
    inside = "released under the mit license"
    assert [(a, b, r.kind) for a, b, _, r in licenses.detections(inside, table)] == [(0, len(inside), "grant")]
    twice = licenses.detections(f"mit license {inside} mit license", table)
    assert [r.kind for _, _, _, r in twice] == ["name", "grant", "name"]
    a = licenses.Rule("a", ("x",), "name", re.compile("x y"), 0)
    b = licenses.Rule("b", ("x",), "name", re.compile("x y|y"), 1)
    c = licenses.Rule("c", ("y",), "text", re.compile("y z"), 2)
    assert [x for _, _, x, _ in licenses.detections("x y z", [c, a, b])] == ["a", "c"]  # a tie goes to the earlier; crossing intervals stay


def test_long_texts_and_odd_rows(spark):
    rows = [(1, (BSD + " ") * 3000, 1), (2, "license " * 100000, 2), (2, "license " * 100000, 2), (None, None, 3), (3, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `score.x` int").withColumn("labels", F.lit(1))
    got = [(r["doc_id"], r["labels"], r["score"]) for r in licenses.scan_documents(docs).collect()]
    assert got.count((2, "", 0.0)) == 2 and (None, "", 0.0) in got and (1, "bsd-2-clause", 1.0) in got


def test_empty(empty):
    assert licenses.scan_documents(empty).count() == 0
