from datetime import datetime as D

import pytest

from kbspark.llm import generated as G

HAND = "//! Counts leases that are still held.\n\nuse crate::lease::Lease;\n\n/// Leases of one worker.\npub fn held(all: &[Lease], worker: u64) -> usize {\n    all.iter().filter(|x| x.worker == worker && !x.done).count()\n}\n\nconst SIZES: [usize; 4] = [8, 16, 32, 64];\n"
LONG = "".join(f"// remark number {w} about the queue and its workers\nfn step_{w}(queue: &mut Queue) {{ queue.push(Job::new(\"{w}\", {i})); }}\n" for i, w in enumerate(("alpha", "bravo", "charlie", "delta", "echo", "foxtrot")))


@pytest.mark.parametrize(
    "path,text,kind",
    [
        ("src/a.rs", HAND, None),
        ("src/a.rs", "// Code generated by mill from a.idl. DO NOT EDIT.\n" + HAND, "generated"),
        ("src/a.rs", "// @generated by weave -- changes will be lost\n" + HAND, "generated"),
        ("src/a.rs", HAND + "// <auto-generated> weave 1.2.3 </auto-generated>\n", "generated"),
        ("src/a.rs", HAND + 'const HEADER: &str = "Code generated by mill. DO NOT EDIT.";\n', None),
        ("src/a.rs", HAND + "// the row that was generated by the sweeper is checked here, do not edit it twice\n", None),
        ("src/a.py", "# Esta saída foi gerada por mill; não edite.\nx = 1\n", "generated"),
        ("src/a.go", "// Diese Datei wurde von mill erzeugt und wird beim Bauen überschrieben.\npackage a\n", "generated"),
        ("src/a.rs", "/* This file is part of the libzip library, version 2.1.0. */\n" + HAND, "third_party"),
        ("src/a.rs", "// Copyright 2023 the proj contributors\n// SPDX-License-Identifier: MIT\n" + HAND, None),
        ("src/a.js", "var a=1;" + "function f(a,b){return a>b?f(a-1,b):b<<2};" * 60, "minified"),
        ("src/a.rs", "pub static A: &[f32] = &[\n" + "    -0.371475, 0.202459, 0.111402, -0.746804,\n" * 40 + "];\n", "data"),
        ("src/a.py", "B = (\n" + "    'Nu6nq3yZRJQ9Qop101n1LcFaLaHMR8k3Q9aJ76vEpbVrZEVl'\n" * 30 + ")\n", "data"),
        ("src/a.ts", "".join(f"export interface Op{i} {{ path: '/v1/{i}'; reply: S{i}; }}\n" for i in range(30)), "generated"),
        ("m.js.map", '{"version":3,"sources":["a.js"],"mappings":"AAAA"}', "map"),
        ("x.txt", "# This file is automatically @generated by Cargo.\n[[package]]\nname = 'a'\n", "generated"),
        (None, HAND, None),
    ],
)
def test_content(path, text, kind):
    assert G.content_class(text, path, "proj") == kind


def rows(spark, *files):
    data = [(i, p, path, text, D(2024, 1, 1 + i % 20), None, "x", "x") for i, (p, path, text) in enumerate(files)]
    return spark.createDataFrame(data, "file_id long, project string, rel_path string, content string, received_at timestamp, deleted_at timestamp, kind string, sketch string")


def found(spark, *files):
    return {r.file_id: r.kind for r in G.find_unwritten(rows(spark, *files)).collect()}


def test_paths_and_copies(spark):
    patched = LONG.replace("queue.push", "queue.add", 1)
    got = found(spark, ("p", "vendor\\lib\\q.rs", LONG), ("q", "src/q.rs", patched), ("q", "src/own.rs", HAND), ("q", "./a//b.min.js", "x = 1"), ("q", "Cargo.lock", "x = 1"), ("q", "vendor_tools/x.rs", HAND), ("q", None, HAND), ("q", "e.rs", ""), ("q", "n.rs", None), ("q", "w.rs", " \n"), (None, "src/r.rs", LONG))
    assert got == {0: "third_party", 1: "copy", 3: "generated", 4: "generated", 10: "copy"}


def test_attribute_files(spark):
    attrs = "# c\n*.rs linguist-generated\nsrc/keep.rs -linguist-generated\nlib/** linguist-vendored=true\n"
    got = found(
        spark,
        ("p", ".gitattributes", attrs), ("p", "sub/.gitattributes", "*.rs linguist-generated=false\ndeep/*.rs linguist-generated\n"),
        ("p", "src/a.rs", HAND), ("p", "src/keep.rs", HAND), ("p", "sub/b.rs", HAND), ("p", "sub/deep/c.rs", HAND), ("p", "lib/x/y.py", "def f():\n    return 1\n"), ("q", "src/a.rs", HAND), ("p", "src/z.py", "def g():\n    return 2\n"),
    )
    assert got == {2: "declared", 5: "declared", 6: "declared"}


def test_newest_attribute_file_counts(spark):
    got = found(spark, ("p", ".gitattributes", "*.rs linguist-generated"), ("p", "a.rs", HAND), ("p", ".gitattributes", "*.go linguist-generated"))
    assert got == {}


def test_names_are_mined_from_declared_repositories(spark):
    declared = [("p", ".gitattributes", "weird/** linguist-generated\n")] + [("p", f"weird/f{i}.rs", HAND + f"// {i}\n") for i in range(25)]
    got = found(spark, *declared, ("q", "weird/g.rs", HAND), ("q", "src/g.rs", HAND))
    assert got.get(26) == "generated" and 27 not in got


def test_empty(spark):
    assert found(spark, ("p", "a.rs", None)) == {}
    assert G.find_unwritten(rows(spark, ("p", "a", "b")).limit(0)).count() == 0


def test_globs():
    import re

    from kbspark.functions.globs import glob_regex

    cases = [("*.go", "a/b.go", True), ("*.go", "b.gox", False), ("a/*.go", "a/b.go", True), ("a/*.go", "x/a/b.go", False), ("a/**", "a/b/c", True), ("**/x", "a/b/x", True), ("/x", "x", True), ("f?.c", "fo.c", True), ("[!a].c", "b.c", True), ("[!a].c", "a.c", False), ("a.b", "axb", False)]
    assert [bool(re.search(glob_regex(p), x)) for p, x, _ in cases] == [w for *_, w in cases]


def test_an_excerpt_of_a_large_vendored_file(spark):
    big = [f"let step_{i} = queue.push(Job::new(\"{i * 7919 % 1009}\", worker));" for i in range(1000)]
    own = [f"let mine_{i} = table.read(Row::at({i * 31 % 997}, \"owner\"));" for i in range(300)]
    got = found(spark, ("p", "vendor/lib/q.txt", "\n".join(big)), ("q", "doc/part.txt", "\n".join(big[400:600])), ("q", "doc/mixed.txt", "\n".join(own + big[:200])), ("q", "doc/own.txt", "\n".join(own)))
    assert got == {0: "third_party", 1: "copy"}


PERMISSION = """MIT License

Copyright (c) 2023 the proj contributors

Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to
the following conditions:

The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM THE SOFTWARE.""".splitlines()
HEADERS = {"lines": "".join(f"// {x}\n" for x in PERMISSION), "stars": "/*\n" + "".join(f" * {x}\n" for x in PERMISSION) + " */\n", "block": "/*\n" + "\n".join(PERMISSION) + "\n{}*/\n"}


@pytest.mark.parametrize("header", HEADERS)
def test_marker_or_notice_after_a_long_header(header):
    for text, kind in (("Code generated by mill from a.idl. DO NOT EDIT.", "generated"), ("This file is part of the libzip library, version 2.1.0.", "third_party")):
        h = HEADERS[header]
        t = h.replace("{}", text + "\n") if header == "block" else h + f"// {text}\n"
        assert G.content_class(t + HAND, "src/a.rs", "proj") == kind
        assert G.content_class(h.replace("{}", "") + HAND, "src/a.rs", "proj") is None


def test_comments_between_code():
    body = HAND * 4
    assert G.content_class(body + "// Code generated by mill from a.idl. DO NOT EDIT.\n" + LONG, "src/a.rs", "proj") == "generated"
    assert G.content_class(body + "// the loop below was adapted from libzip 2.1\n" + LONG, "src/a.rs", "proj") is None
    assert G.content_class('x = 1\n"""\nCode generated by mill. DO NOT EDIT.\n"""\ny = 2\n', "a.py", "proj") is None


def test_lock_marks_after_a_long_beginning():
    head = "{\n" + "".join(f'  "field{i}": "{"x" * 40}",\n' for i in range(80))
    assert G.content_class(head + '  "lockfileVersion": 3\n}\n', "deps.json", "proj") == "lock"


def test_patterns_are_mined_from_contents_of_several_repositories(spark):
    made = "// Code generated by mill from a.idl. DO NOT EDIT.\n" + HAND
    known = [(f"p{i % 4}", f"weird/f{i}.stub.rs", made) for i in range(24)]
    one = [("p9", f"single/f{i}.rs", made) for i in range(24)]
    df = rows(spark, *known, *one, ("q", "weird/g.rs", HAND), ("q", "src/h.stub.rs", HAND), ("q", "src/k.rs", HAND), ("q", "single/m.rs", HAND), ("q", "vendor/n.rs", LONG))
    got = {r.file_id: (r.kind, r.evidence) for r in G.find_unwritten(df).collect()}
    assert got[0] == ("generated", "content") and got[48] == got[49] == ("generated", "mined") and 50 not in got and 51 not in got and got[52] == ("third_party", "usual")
