from lodestone.llm.layout import layout_stats, strip_banner, unwritten_files

HAND = "import os\n\n\ndef load(path):\n    with open(path) as f:\n        return f.read()\n\n\ndef store(path, text):\n    # written by hand, do not edit lightly\n    with open(path, 'w') as f:\n        f.write(text)\n"


def kinds(path, text):
    return layout_stats(path, text)["kinds"]


def test_kinds():
    assert kinds("a.py", HAND) == [] and kinds("a.py", None) == [] and kinds("a.py", "") == []
    assert kinds("a.py", "# Code generated by x. DO NOT EDIT.\n" + HAND) == ["generated"]
    assert kinds("a.py", HAND + "M = '@generated do not edit'\n") == []
    assert kinds("a.js", "".join(f"function f{i}(a,b){{return a&&b?a.c(b):{i}}}" for i in range(80))) == ["minified"]
    assert "data" in kinds("a.py", "W = [\n" + "".join("    0.123, -4.5, 6.75, 8.125, 9.5,\n" for _ in range(60)) + "]\n")
    assert kinds("third_party/x/a.py", HAND) == ["vendored"] and kinds("src/vendors/a.py", HAND) == []
    assert kinds("a.py", HAND + "T = {" + ", ".join(f"'k{i}': {i}" for i in range(12)) + "}\n") == []
    assert "generated" in kinds("a.js", "".join(f"export function op_{i:03}(c, b) {{\n  return c.call({i}, '/x', b);\n}}\n\n" for i in range(20)))


def test_banner_blank_lines_and_space_do_not_matter():
    assert strip_banner("/*! x v1 */\n// y\na = 1;\n\n b()") == strip_banner("a=1;\nb()")


def test_operator(spark):
    lib = "def alpha(x):\n    return x + 1\n\n\ndef beta(y):\n    return alpha(y) * 2\n"
    a = spark.createDataFrame([("r", "src/c.py", "# lib 1.0\n\n" + lib.replace("\n\n\n", "\n"), "k"), ("r", "src/h.py", HAND, "k"), ("r", "src/h.py", HAND, "k"), ("r", "n.py", None, "k"), (None, "x.py", lib, "k")], "repo_root string, relpath string, source_text string, kinds string")
    c = spark.createDataFrame([("r", "src/only.py::file", "src/only.py", "# @generated\nx = 1\n"), ("r", "src/only.py::1", "src/only.py", "x = 1"), ("r", "src/h.py::file", "src/h.py", "# @generated\n")], "repo_root string, chunk_id string, relpath string, text string")
    f = spark.createDataFrame([("r", "vendor/z.py"), ("r", "src/h.py"), ("r", "plain.py")], "repo_root string, relpath string")
    t = spark.createDataFrame([("python", lib)], "language string, file_text string")
    got = {(r.relpath, tuple(r.kinds)) for r in unwritten_files(a, c, f, t).collect()}
    assert got == {("src/c.py", ("vendored",)), ("src/only.py", ("generated",)), ("vendor/z.py", ("vendored",))}
    assert unwritten_files(a.limit(0), c.limit(0), f.limit(0), t).count() == 0


def test_docstring_banner_does_not_hide_a_copy(spark):
    lib = 'import api.span\n\n\ndef alpha(x):\n    return x + 1\n\n\ndef beta(y):\n    return alpha(y) * 2\n'
    known = '"""vikmol 7.9.9 - released under the MIT licence."""\n"""Fold spans."""\n' + lib
    copies = {"none.py": '"""Fold spans."""\n' + lib, "changed.py": "﻿# -- vikmol 8, ISC\n'''Fold\nspans.'''\n\n" + lib, "same.py": known.replace("\n\n\n", "\n")}
    a = spark.createDataFrame([("r", "src/" + k, v) for k, v in copies.items()] + [("r", "src/h.py", '"""Fold spans."""\n' + HAND)], "repo_root string, relpath string, source_text string")
    c = spark.createDataFrame([], "repo_root string, chunk_id string, relpath string, text string")
    t = spark.createDataFrame([("python", known)], "language string, file_text string")
    got = {r.relpath for r in unwritten_files(a, c, c.select("repo_root", "relpath"), t).where("array_contains(kinds, 'vendored')").collect()}
    assert got == {"src/none.py", "src/changed.py", "src/same.py"}


def test_banners_of_unlisted_libraries():
    for banner in ('"""molmol 3.6.1 - released under the MIT licence."""\n', "# molmol 3.2.0\n# Copyright (c) the molmol contributors\n# SPDX-License-Identifier: MIT\n", "#!/usr/bin/env python\n'''molmol 3.2.0 (ISC)\n'''\n", "/*! molmol v3.2.0 | (c) molmol contributors | MIT */\n", "# -- molmol release 4.1.2, BSD-3-Clause\n"):
        assert kinds("src/a.py", banner + HAND) == ["vendored"], banner
    for banner in ('"""Needs molmol 3.6.1, under the MIT licence."""\n', "# molmol 3.2.0 must be installed\n# Copyright (c) us\n", "# Copyright (c) us\n'''molmol 3.2.0'''\n", "# Licence: MIT\nV = '''molmol 3.2.0'''\n", '"""molmol 3.6.1"""\n'):
        assert kinds("src/a.py", banner + HAND) == [], banner


def test_files_known_by_symbol_chunks_only(spark):
    a = spark.createDataFrame([("r", "src/h.py", HAND)], "repo_root string, relpath string, source_text string")
    rows = [("r", "vendor/v.py::f", "vendor/v.py", "x = 1"), ("r", "src/g.py::f", "src/g.py", "# @generated\nx = 1\n"), ("r", "src/n.py::file", "src/n.py", None), ("r", "src/n.py::f", "src/n.py", "# @generated\n"), ("r", "vendor/i.py", "vendor/i.py", None)]
    rows += [("r", "src/h.py::f", "src/h.py", "# @generated\n"), ("r", "src/o.py::file", "src/o.py", HAND), ("r", "src/o.py::f", "src/o.py", "# @generated\n")]
    c = spark.createDataFrame(rows, "repo_root string, chunk_id string, relpath string, text string")
    t = spark.createDataFrame([], "language string, file_text string")
    assert {r.relpath for r in unwritten_files(a, c, c.select("repo_root", "relpath").limit(0), t).collect()} == {"vendor/v.py", "src/g.py", "src/n.py", "vendor/i.py"}


def test_marks_behind_long_heads_and_folders_of_ones_own():
    licence = "".join(f"# {a} {b} of a text\n" for a in ("whoever", "holder", "notice", "copy", "terms", "party") for b in ("grants", "keeps", "bears", "claims", "waives", "holds", "gives"))
    assert kinds("a.py", licence + "# Code generated by x. DO NOT EDIT.\n" + HAND) == ["generated"]
    assert kinds("a.js", "'use strict';\n/*\n" + " long\n" * 30 + " @generated\n*/\nlet a = 1;\n") == ["generated"]
    assert kinds("a.py", licence + '"""Tells how to mark code as generated by tools."""\n' + HAND) == []
    assert kinds("a.py", "# molmol 3.2.0\n" + licence + "# SPDX-License-Identifier: MIT\n" + HAND) == ["vendored"]
    assert kinds("external/reader.py", HAND) == [] and kinds("src/deps/reader.py", None) == [] and kinds("external/zlib/reader.py", HAND) == ["vendored"]


def test_short_known_sources_and_small_data(spark):
    assert strip_banner("# only a banner\n") == "" and layout_stats("a.py", "# only a banner\n")["digest"] is None
    a = spark.createDataFrame([("r", "src/a.py", "# x\nf = 1\n")], "repo_root string, relpath string, source_text string")
    c = spark.createDataFrame([], "repo_root string, chunk_id string, relpath string, text string")
    t = spark.createDataFrame([("python", "f=1")], "language string, file_text string")
    assert [tuple(r) for r in unwritten_files(a, c, c.select("repo_root", "relpath"), t).collect()] == [("r", "src/a.py", ["vendored"])]
    assert kinds("a.py", "P = (\n" + "".join(f'    "{"Ab3+" * 16}"\n' for _ in range(12)) + ")\n")[-1] == "data" and kinds("a.py", f'KEY = "{"Ab3+" * 16}"\n') == []
