import ast
import warnings
from datetime import datetime

import pytest
from conftest import rows

from orefield.llm.syntax import broken_files, broken_rates, fault

VALID = {
    "typescript": [
        'import { a, type B } from "./x.js";\nexport const f = async <T>(x: string[], y?: Record<string, any>): Promise<T | null> => {\n  if (!x) return null;\n  const s = `a${x.map((v) => `${v}}`).join(",")}b`;\n  for (const v of x) { if (v === "}") continue; }\n  return (x as any) ?? y!;\n};\n',
        "/* } */ export abstract class A<T> extends B implements C {\n  private readonly x = /[)}\\]]+$/g;\n  static async m(): Promise<void> { try { await 1; } catch { } finally { } }\n  get y(): number { return this.x ? 1 : 2; }\n}\nexport interface I { a?: string; b: { open: string } }\nenum E { A = 1, B }\nexport type U = 'a' | 'b';\n",
        "// only a comment <<<<<<< \n", "const t = `\n=======\n`;\n", "/*\n<<<<<<< HEAD\n*/\n", "",
        "export default function () { switch (1) { case 1: break; default: return; } }\nexport * from './y';\n",
    ],
    "javascript": ["const o = { a: 1, 'b': [1, 2,], c() { return a ? b : c; }, ...d };\nlet x = o.a / 2 / 3;\nexport { x as y };\n", "if (a) b(); else c();\nwhile (x > 1 && !y.done) { x.shift(); }\n#!x".replace("#!x", "")],
    "python": ["def f(a, *, b=1, **k):\n    '''doc\n=======\n'''\n    return [x for x in a if x not in b] if a else {\n        'k': f\"{a!r}\",\n    }\n", "@dec\nclass A:\n    x: int = 1\n    async def g(self): pass\n\ntry:\n    pass\nexcept (A, B) as e:\n    raise C from e\nelse:\n    pass\n", "x = (1 +\n     2)\nprint('a' 'b')\nlambda: 0\nif x: pass\n"],
    "go": ['// c\npackage main\n\nimport (\n\t"fmt"\n\tf "x/y"\n)\n\ntype T struct {\n\ta, b int `json:"a"`\n}\n\nfunc (t *T) M(xs []string, m map[string]int) (int, error) {\n\tfor _, x := range xs {\n\t\tif x == "}" {\n\t\t\tcontinue\n\t\t}\n\t}\n\tfmt.Println(\'{\', `raw\n=======\n`)\n\tdefer func() { _ = m }()\n\treturn 1, nil\n}\n'],
    "rust": ["//! d\nuse std::collections::HashMap;\n\n#[derive(Debug)]\npub struct A<'a> { x: &'a [u8] }\n\nimpl<'a> A<'a> {\n    pub fn f(&self, c: char) -> Result<&'a [u8], String> {\n        /* a /* { */ b */\n        let v: Vec<usize> = (0..5).filter(|i| i % 2 == 0).collect();\n        let r = r#\"raw { \" (\"#;\n        if c == '{' || c == '\\'' { return Err(format!(\"{}\", r)); }\n        match v.len() { 0 => {}, 1 | 2 => println!(\"x\"), _ => () }\n        Ok(self.x)\n    }\n}\n"],
    "php": ["<?php\n# it's (\nnamespace A\\B;\nuse C;\n\nfinal class D extends E implements F\n{\n    private array $x = ['a' => 1];\n    public function g(array $y, ?int $z = null): ?string {\n        try { $y->h(); } catch (\\Throwable $e) { throw new \\RuntimeException(\"{[( $e\"); }\n        $t = <<<TXT\n=======\n{ (\nTXT;\n        foreach ($y as $k => $v) { if ($k === ')') continue; }\n        return $z ?? 'it\\'s';\n    }\n}\n", "<html><p>it's text</p></html>\n", "<p>\n<?php if ($a): ?>\nx ( {\n<?php endif; ?>\n"],
}
BROKEN = {
    "typescript": ["export function f(a: string) {\n  return a", "const x = ", "<<<<<<< HEAD\nconst a = 1;\n=======\n", "import { a } from './x", "The scanner isn't frozen by the cursor.", "<!DOCTYPE html>\n<html></html>", "# x\ndef f(a):\n    return a\n", "package main\n\nfunc A() {}\n", "const a = &quot;x&quot;;\n", "}\n", "export ", "const s = `a${b}", "f(a, b;", "const a: number;"],
    "javascript": ["function f(a: string[]) { return a; }", "interface A { b: string }", "const a = 1 as any;", "function f() {", "x = 'a\n'"],
    "python": ["def f(:\n", "def f():\n", "    x = 1\n", "try:\n    pass\n", "x = 'a\n", "return in\n", "with open(x) as h\n", "=======\nx = 1\n", "class A:\n    def f(self):\n        pass\n  x = 1\n", "print 1 2\n", "x = (1,\n", '"""a'],
    "go": ["func A() {}\n", "package x\n\nfunc A() {\n", "package x\n\nThe cursor is frozen.\n", "package x\n\nimport &quot;fmt&quot;\n", "package x\n=======\n", "package x\nvar a = `b\n"],
    "rust": ["fn f() {", "pub fn f() -> ", "let x = 1;\nfoo bar", "use a::b", "fn f() { println!(&quot;x&quot;); }", "fn f() { let x = r#\"a\"; }", "/* a /* b */", "const a = require('b')\n"],
    "php": ["<?php\nfunction f( {", "<?php\n$x = 'a", "<?php\n$x = 1", "<?php\nclass A\n{\n", "<?php\n$x-&gt;y();\n", "<?php\n<<<<<<< HEAD\n$x = 1;\n", "<?php\n$x = <<<TXT\nabc\n", "<?php\nnamespace A"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid_sources(language, text):
    for variant in (text, text.replace("\n", "\r\n"), "\ufeff" + text):
        assert fault(variant, language) is None


@pytest.mark.parametrize("language,text", [(k, t) for k, v in BROKEN.items() for t in v])
def test_broken_sources(language, text):
    assert fault(text, language) is not None


def test_python_agrees_with_its_own_parser():
    source = VALID["python"][0] + VALID["python"][1]
    lines = source.split("\n")
    for n in range(len(lines)):
        for part in ("\n".join(lines[:n]) + "\n", "\n".join(lines[n:]) + "\n"):
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(part)
                ok = True
            except SyntaxError:
                ok = False
            assert (fault(part, "python") is None) == ok, part


def test_unknown_languages_and_blanks():
    assert fault("((((", "cobol") is None and fault(None, "go") is None and fault(" \n", "go") is None and fault("x", None) is None


def test_files_keep_the_latest_capture(spark):
    new, old = datetime(2025, 2, 1), datetime(2025, 1, 1)
    data = [("r", "c", "a.py", None, "def f(:\n", new, new), ("r", "c", "a.py", None, "x = 1\n", old, new), ("r", "c", "b.py", "PYTHON", "x = 1\n", new, new), ("r", "c", "b.py", "go", "def f(:\n", old, old), ("r", "c", "c.txt", None, "(((", new, new), (None, "c", "d.ts", "", "f(", new, new), ("r", "c", "e.go", "go", None, new, new)]
    df = spark.createDataFrame([(*r, "clash") for r in data + data[:1]], "repository string, commit_hash string, file string, language string, content string, captured_at timestamp, loaded_at timestamp, fault string")
    assert rows(broken_files(df).select("repository", "file", "language")) == [("r", "a.py", "python"), (None, "d.ts", "typescript")]
    rates = {(r.repository, r.language, r.level): (r.files, r.broken, r.rate) for r in broken_rates(df).collect()}
    assert rates["r", "python", 0] == (2, 1, 0.5) and rates[None, None, 3] == (5, 2, 0.5)  # c.txt isn't judged
    assert broken_files(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,broken", [("1 = x", True), ("f(a=1, b)", True), ("f(b, a=1)", False), ("f(a=1, *b, **c)", False), ("def f(a=1, b): pass", True), ("def f(a=1, *, b): pass", False), ("def f(a, /, b=1): pass", False), ("g(f(a=1), b)", False), ("x = (1, y)", False), ("f(a == 1, b)", False), ("f(key=lambda a, b: a, c=1)", False), ("f(a=1,)", False)])
def test_python_targets_and_arguments(text, broken):
    import ast

    assert (fault(text, "python") is not None) == broken
    if broken:
        with pytest.raises(SyntaxError):
            ast.parse(text)
    else:
        ast.parse(text)


def test_languages_without_a_lexer_are_not_judged(spark):
    data = [("r", "c", "a.rb", "ruby", "def x"), ("r", "c", "b.py", None, "x = ("), ("r", "c", "c.py", "Python", "x = 1"), ("r", "c", "d", None, "?")]
    frame = spark.createDataFrame([(*d, datetime(2025, 1, 1), datetime(2025, 1, 1)) for d in data], "repository string, commit_hash string, file string, language string, content string, captured_at timestamp, loaded_at timestamp")
    found = {(r.repository, r.language, r.level): (r.files, r.unjudged, r.broken, r.rate) for r in broken_rates(frame).collect()}
    assert found["r", None, 1] == (4, 2, 1, 0.5) and found["r", "ruby", 0] == (1, 1, 0, None) and found["r", "python", 0] == (2, 0, 1, 0.5)


@pytest.mark.parametrize("text,broken", [("def f(a, b=(1, 2), /): pass", False), ("class A:\n    async def f(self, a, /, *, b): pass", False), ("def f(/, a): pass", True), ("f(a, /, b)", True), ("x = (a, /, b)", True)])
def test_python_parameters_by_place_only(text, broken):
    import ast

    assert (fault(text, "python") is not None) == broken
    try:
        ast.parse(text)
    except SyntaxError:
        assert broken
    else:
        assert not broken
