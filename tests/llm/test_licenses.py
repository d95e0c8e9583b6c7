import math
import os
import re
import textwrap
from collections import Counter

import duckdb
import pytest

from textmill.llm import licenses, queries

SF = "/root/testdata/sf0.01"


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.op2_licenses(spark, SF)
    want = con.execute(f"select {', '.join(got.columns)} from ({licenses.ORACLE}) order by doc_id").fetchall()
    rows = [tuple(r) for r in got.orderBy("doc_id").collect()]
    assert rows == want and {r[2] for r in rows} >= {"Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0", None}


def test_inheritance_and_hard_rows(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        (1, "a/LICENSE", mit, 1), (2, "a/b/c/x.py", "code", 2), (3, "a/b/LICENSE", apache, 3), (4, "a/y.py", "code", 4),
        (5, "a/b/c/z.py", f"line\n# {mit}\nmore words follow here", 5), (6, "d/q.py", None, 6), (7, "a/b/e/f/g.py", "", 7), (8, None, "text", 8),
        (9, "top.py", "x " * 100000, 9), (9, "top.py", "x " * 100000, 9), (None, "a/n.py", "code", 1), (11, "ab/n.py", "code", 1),
    ]
    got = {r.file_id: r for r in licenses.scan(spark.createDataFrame(files, "file_id long, path string, text string, license int")).collect()}
    assert {k: r.license for k, r in got.items()} == {1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0", 4: "MIT", 5: "MIT", 6: None, 7: "Apache-2.0", 8: None, 9: None, None: "MIT", 11: None}
    assert got[2].inherited_from == "a/b" and got[5].inherited_from is None and got[1].is_license_file and not got[5].is_license_file
    assert got[1].own_score == pytest.approx(1.0) and 0.6 <= got[5].own_score <= 1
    empty = spark.createDataFrame([], "file_id long, path string, text string")
    assert licenses.scan(empty).count() == 0


def test_each_template_is_its_own_best(spark):
    files = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(licenses.TEMPLATES)], "file_id int, text string")
    got = {r.file_id: r for r in licenses.scores(files).where("lines = 0").collect()}
    assert all(got[i].license == name and got[i].score == 1.0 for i, (name, _) in enumerate(licenses.TEMPLATES))


def test_cue_words_lose_nothing(spark):
    """Lines without the usual words reach the threshold all the same."""
    lines = ["This work is under the GNU General Public, version 3.", "This is free and unencumbered software.", "Apache 2.0", "GNU Affero General Public, version 3", "SPDX-License-Identifier: MIT", "nothing of the kind here", "4.0"]
    got = {r.file_id: r for r in licenses.scan(spark.createDataFrame([(i, f"d/{i}", x) for i, x in enumerate(lines)], "file_id int, path string, text string")).collect()}
    assert [got[i].own_license for i in range(7)] == ["GPL-3.0", "Unlicense", "Apache-2.0", "AGPL-3.0", "MIT", None, None]


def plain_score(unit, k):
    """Cosine of a text and a template, by hand."""
    terms = lambda t: Counter(x for x in re.findall("[a-z]+|[0-9]+", t.lower()) if x not in licenses.STOP)
    counts = [terms(t) for _, t in licenses.TEMPLATES]
    df = Counter(t for c in counts for t in c)
    weigh = lambda c: {t: n * (math.log((1 + len(counts)) / (1 + df[t])) + 1) * (0.5 if t.isdigit() else 1) for t, n in c.items()}
    a, b = weigh(terms(unit)), weigh(counts[k])
    return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


SYSTEM = "/usr/share/common-licenses"


def test_licence_files_and_headers(spark):
    """Whole licence texts are licence files, headers over several lines give their file's licence, and files below
    inherit from the nearest directory above them."""
    texts = {name: "\n\n".join(textwrap.wrap(t, 70)) for name, t in licenses.TEXTS if name in ("MIT", "BSD-3-Clause", "ISC")}
    header = "# Licensed under the Apache License, Version 2.0 (the\n# \"License\"); you may not use this file except in\n# compliance with the License.\nimport os\n" + "x = compute(y, z)\n" * 50
    files = [
        ("a/LICENSE", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + texts["MIT"]), ("a/b/c/d/e/f.py", "code"), ("a/b/LICENSE.txt", "Copyright 2021 X. All rights reserved.\n" + texts["BSD-3-Clause"]),
        ("a/x.py", "code"), ("a/bb/y.py", "code"), ("z/q.py", header), ("z/r.py", "code"), ("i/LICENSE", texts["ISC"]), ("i/j/k.c", ""),
    ]
    files += [(f"s{i}/LICENSE", open(f"{SYSTEM}/{name}").read()) for i, name in enumerate(("Apache-2.0", "GPL-2", "GPL-3", "MPL-2.0", "LGPL-3", "BSD", "CC0-1.0")) if os.path.exists(f"{SYSTEM}/{name}")]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "file_id int, path string, text string")).collect()}
    assert {p: got[p].license for p, _ in files[:9]} == {"a/LICENSE": "MIT", "a/b/c/d/e/f.py": "BSD-3-Clause", "a/b/LICENSE.txt": "BSD-3-Clause", "a/x.py": "MIT", "a/bb/y.py": "MIT", "z/q.py": "Apache-2.0", "z/r.py": None, "i/LICENSE": "ISC", "i/j/k.c": "ISC"}
    assert got["a/b/c/d/e/f.py"].inherited_from == "a/b" and got["a/bb/y.py"].inherited_from == "a" and got["z/q.py"].inherited_from is None
    assert all(got[p].is_license_file == p.split("/")[-1].startswith("LICENSE") for p in got)
    assert [got[f"s{i}/LICENSE"].license for i in range(len(files) - 9)] == ["Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "LGPL-3.0", "BSD-3-Clause", "CC0-1.0"][: len(files) - 9]
    whole = {r.file_id: r for r in licenses.scores(spark.createDataFrame([(i, f[1]) for i, f in enumerate(files)], "file_id int, text string")).where("lines = 0").collect()}
    for i in (0, 2, 5):
        assert whole[i].score == pytest.approx(max(plain_score(files[i][1], k) for k in range(len(licenses.TEMPLATES))), abs=2e-6)
