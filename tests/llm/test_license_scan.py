from __future__ import annotations

from ledgerline.llm import license_scan as scan

SCHEMA = "doc_id long, path string, text string, dir string, row_no string, term string, best string"

FILES = [
    (1, "p/LICENSE", scan.TEMPLATES["MIT"]),
    (2, "p/a/b/code.py", "x = 1\n"),
    (3, "p/a/LICENSE.txt", "intro\n" + scan.TEMPLATES["Apache-2.0"] + "\nmore"),
    (4, "p/a/own.py", "# " + scan.TEMPLATES["GPL-3.0"] + "\ncode"),
    (5, "p/c.py", None),
    (6, "q/c.py", ""),
    (7, "COPYING", "nothing about it"),
    (8, None, "license words only in passing, as many others use them every day of the year"),
    (9, "p/a/own.py", "code\n" * 20_000 + "Licensed under CC BY-NC 4.0."),
    (10, "pa/x.py", "the directory above is not p"),
]


def files(spark):
    return spark.createDataFrame([(*f, "d", "r", "t", "b") for f in FILES], SCHEMA)


def test_own_and_inherited(spark):
    got = {r["doc_id"]: r for r in scan.scan_licences(spark, files(spark), ["doc_id", "path"]).collect()}
    assert {i: r["own_licence"] for i, r in got.items()} == {
        1: "MIT", 2: None, 3: "Apache-2.0", 4: "GPL-3.0", 5: None, 6: None, 7: None, 8: None, 9: "CC-BY-NC-4.0", 10: None,
    }
    assert {i: r["licence"] for i, r in got.items()} == {
        1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0", 4: "GPL-3.0", 5: "MIT", 6: None, 7: None, 8: None, 9: "CC-BY-NC-4.0", 10: None,
    }
    assert got[2]["inherited_from"] == "p/a" and got[5]["inherited_from"] == "p"


def test_root_licence_reaches_everything(spark):
    rows = [(20, "LICENSE", scan.TEMPLATES["MIT"], "", "", "", ""), (21, "x/y/z.py", "", "", "", "", "")]
    got = {r["doc_id"]: r["licence"] for r in scan.scan_licences(spark, spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert got == {20: "MIT", 21: "MIT"}


def test_every_template_finds_itself(spark):
    rows = [(i, f"f{i}", t, "", "", "", "") for i, t in enumerate(scan.TEMPLATES.values())]
    got = {r["doc_id"]: r["own_licence"] for r in scan.scan_licences(spark, spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert got == dict(enumerate(scan.TEMPLATES))


def test_empty_table(spark):
    assert scan.scan_licences(spark, files(spark).limit(0), ["doc_id"]).count() == 0


def test_bodies_headers_titles_and_spdx_lines(spark):
    owner = "Copyright (c) 2020, Foo Bar. All rights reserved.\n\n"
    bodies = {f.name[:-4]: f.read_text() for f in scan.LICENCE_TEXTS.glob("*.txt")}
    assert set(bodies) == {"Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MIT", "MPL-2.0"}
    cases = [(n, f"{n}/LICENSE", owner + t) for n, t in bodies.items()]
    cases += [(n, "x.c", "".join(f"# {x}\n" for x in ["Copyright 2020 Foo", *t.split(". ")]) + "\nint main;\n") for n, t in scan.NOTICES if len(t) > 200]
    cases += [(n, "t.md", f"intro\n\n{t}\n\nmore") for n, t in scan.NOTICES if len(t) < 100]
    cases += [("MIT", "a.c", "// SPDX-License-Identifier: MIT\nint a;"), ("Apache-2.0", "b.c", "# SPDX-License-Identifier: Apache-2.0\nx = 1")]
    cases += [("GPL-2.0", "c.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint c;")]
    rows = [(i, p, t, "", "", "", "") for i, (_, p, t) in enumerate(cases)]
    got = {r["doc_id"]: r["own_licence"] for r in scan.scan_licences(spark, spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert got == {i: n for i, (n, _, _) in enumerate(cases)}
