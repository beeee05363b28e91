"""Definitions in ten languages."""

from __future__ import annotations

import pytest

from contextframe.sources.symbols import scan, symbols

SAMPLES = {
    "rust": ("/// Adds.\npub fn add(a: i32) -> i32 {\n    let s = \"}\"; // }\n    a\n}\nstruct P { x: i32 }\nimpl P {\n    pub fn new() -> P { P { x: 1 } }\n    fn hide(&self) {}\n}\nconst MAX: u32 = 3;\n", [("add", "function", None, 2, 5, "public"), ("P", "struct", None, 6, 6, "private"), ("new", "method", "P", 8, 8, "public"), ("hide", "method", "P", 9, 9, "private"), ("MAX", "const", None, 11, 11, "private")]),
    "typescript": ("export class View {\n  private draw(x: number): void {\n    if (x) { return; }\n  }\n  show() { }\n}\nexport const run = async (a: string) => {\n  a;\n};\ninterface Props { a: string }\nfunction help() {}\n", [("View", "class", None, 1, 6, "public"), ("draw", "method", "View", 2, 4, "private"), ("show", "method", "View", 5, 5, "public"), ("run", "function", None, 7, 9, "public"), ("Props", "interface", None, 10, 10, "private"), ("help", "function", None, 11, 11, "private")]),
    "go": ("type Server struct {\n\tname string\n}\nfunc (s *Server) Start() error {\n\treturn nil\n}\nfunc helper() {}\ntype Reader interface {\n}\n", [("Server", "struct", None, 1, 3, "public"), ("Start", "method", None, 4, 6, "public"), ("helper", "function", None, 7, 7, "private"), ("Reader", "interface", None, 8, 9, "public")]),
    "php": ("<?php\nclass User {\n    private function secret() { return 1; }\n    public static function make() {}\n}\nfunction top() {}\n", [("User", "class", None, 2, 5, "public"), ("secret", "method", "User", 3, 3, "private"), ("make", "method", "User", 4, 4, "public"), ("top", "function", None, 6, 6, "public")]),
    "swift": ("struct P {\n    private func a() {}\n    init(x: Int) { }\n}\nprotocol Q {}\nfunc free() {\n}\n", [("P", "struct", None, 1, 4, "public"), ("a", "method", "P", 2, 2, "private"), ("init", "method", "P", 3, 3, "public"), ("Q", "protocol", None, 5, 5, "public"), ("free", "function", None, 6, 7, "public")]),
    "java": ("public class A {\n    private int x;\n    public A() { x = 1; }\n    protected String name(int y) throws E {\n        for (;;) { }\n    }\n}\ninterface B { }\n", [("A", "class", None, 1, 7, "public"), ("A", "method", "A", 3, 3, "public"), ("name", "method", "A", 4, 6, "protected"), ("B", "interface", None, 8, 8, "public")]),
    "c": ("#include <a.h>\nstruct node {\n  int v;\n};\nstatic int add(int a, int b) {\n  return a + b;\n}\ntypedef unsigned int uint;\n", [("node", "struct", None, 2, 4, None), ("add", "function", None, 5, 7, None), ("uint", "type", None, 8, 8, None)]),
    "cpp": ("namespace n {\nclass Box {\n  int hidden() { return 1; }\npublic:\n  Box() {}\n  int get() const { return 2; }\n};\n}\nint main() { return 0; }\n", [("n", "namespace", None, 1, 8, "public"), ("Box", "class", None, 2, 7, "public"), ("hidden", "method", "Box", 3, 3, "private"), ("Box", "method", "Box", 5, 5, "public"), ("get", "method", "Box", 6, 6, "public"), ("main", "function", None, 9, 9, "public")]),
}


@pytest.mark.parametrize("lang", sorted(SAMPLES))
def test_definitions(lang):
    source, expected = SAMPLES[lang]
    assert [(r[0], r[1], r[2], r[4], r[5], r[7]) for r in scan(source, lang)] == expected


def test_doc_comment():
    assert scan(SAMPLES["rust"][0], "rust")[0][6] == "Adds."


@pytest.mark.parametrize("source", ["", "}", "{{{", "fn", "class {", "\"unclosed", "/* open", "x" * 10_000])
def test_broken_source(source):
    for lang in SAMPLES:
        scan(source, lang)


def test_table(spark):
    rows = [("a.rs", SAMPLES["rust"][0]), ("b.py", "class C:\n    def _m(self):\n        pass\n"), ("c.txt", "fn x() {}"), ("d.go", None), ("e.java", ""), ("bad.py", "def (")]
    found = [(r.path, r.name, r.kind, r.parent, r.visibility) for r in symbols(spark.createDataFrame(rows, "path string, content string")).collect()]
    assert ("b.py", "_m", "method", "C", "private") in found and {p for p, *_ in found} == {"a.rs", "b.py"}
