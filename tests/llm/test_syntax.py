import ast
import tomllib
import warnings

import pytest

from lodestone.llm.derivative import Engine
from lodestone.llm.lexers import check_js, check_python, check_toml
from lodestone.llm.syntax import syntax_flags

VALID_JS = [
    "", "let a = 1\nlet b = a;\n/re/.test(b)", "async function f() { for await (const x of y) { await x } }", "const {a, b: [c = 1, ...d], ...e} = f;", "x = a ? b : c => d", "`a${`b${c}`}d`", "if (a) /x[/]y/g.exec(b)\nelse c++",
    "class A extends B { static #p = 1; get x() { return this.#p } static { f() } async *g() { yield* h } [k]() {} }", "export default class {}\nimport d, * as n from 'm'\nexport { d as default, n as 'x y' }", "label: for (;;) { continue label }",
    "return_ = 1; ({ get: 1, set: 2, async: 3, get a() { return 1 } })", "do x(); while (y) z()", "a?.b?.[c]?.(d) ?? e", "#!/usr/bin/env node\nf()", "module.exports = { type: 1 }", "a = b\n++c", "var x = function* () { yield\n1 }", "[a, b] = [b, a]; ({ a, b } = c)",
]
BAD_JS = [
    "let a = ;", "function f( {", "{ \"a\": 1, \"b\": 2 }", "<!doctype html>", "<<<<<<< HEAD\na\n=======\n", "if (a &amp;&amp; b) { }", "const x", "interface A { b: string }", "return 1", "const a: number = 1", "'abc\n'", "`abc", "/* abc", "a b", "f(1, 2", "import x from", "await_ = await 1 2",
    "class { }", "1 = x", "def f(x):\n    return x", "break", "function f() { await x }",
]


@pytest.mark.parametrize("text", VALID_JS)
def test_valid_javascript(text):
    assert check_js(text)[0] is None, check_js(text)
    assert check_js(text.replace("\n", "\r\n"))[0] is None


@pytest.mark.parametrize("text", BAD_JS)
def test_invalid_javascript(text):
    assert check_js(text)[0] is not None


def test_typescript():
    good = ["interface A<T> extends B { readonly a?: string; m<U>(x: U): void\n [k: string]: any }", "const f = <T,>(x: T): x is T => true", "let a = b as unknown as Map<string, Array<Set<number>>>;", "export type X = keyof typeof y | { [K in keyof T]-?: T[K] }", "abstract class A<T> implements B { constructor(private readonly x: number, y?: string) { super() } abstract m(): void; z!: number }",
            "enum E { A = 1, B }", "declare module 'x' { export function f(a: number): string }", "function f(this: A, ...r: string[]): asserts x is B {}", "a >> b; c >= d; e >>>= f; g < h", "import type { A } from './a'; export type { A }", "let t: [a: string, b?: number, ...rest: boolean[]] = x!", "type C = A extends infer U ? `x${U & string}` : never"]
    for text in good:
        assert check_js(text, True)[0] is None, (text, check_js(text, True))
    for text in ["interface A { b: }", "let a: = 1", "type = ", "enum { A }"]:
        assert check_js(text, True)[0] is not None, text


PY = [
    "", "x = 1", "print 'a'", "def f(a, /, b=1, *c, d, **e): pass", "def f(a=1, b): pass", "f(a for a in b)", "f(a, b for b in c)", "f(a=1, b)", "x: int = 1", "f() = 1", "a, *b = c", "f'{a!r:>{w}}' f'{{}}'", "f'{a'", "match x:\n case [1, *_] | {'a': b, **c} if d: pass\n", "match = 1; case = match",
    "if x:\npass", "if x:\n\ty\n        z", "  x", "try:\n x\nfinally:\n y", "try:\n x\n", "async def f():\n async with a as b, c: await d\n return [x async for x in y]", "type X[T] = list[T]", "class A[T: int](B, metaclass=C): x: int", "lambda *a, b=1: (yield)", "x = 0777", "1abc", "1if x else 2", "é = 1", "“a”", "a \\\n + b", "'abc", "'''abc",
    "with (open(a) as b, c): pass", "del a, b[0]", "del f()", "global x; nonlocal y", "@a.b(c)\nclass D: pass", "while x: break\nelse: y", "return 1", "from . import (a, b as c,)", "from a import *", "not a in b", "a if b else", "{**a, 'b': 1}", "{a: b for c in d}", "[*a, *b]", "x[1:2, ::3, ...]", "a := 1", "(a := 1)", "for x in *a, b: pass", "except_ = 1", "raise A from B", "assert x, y", "def f() -> int: ...",
    "lambda a=1, b: 0", "lambda *: 0", "lambda *a, *b: 0", "lambda **k, a: 0", "lambda /: 0", "lambda a, /, b=1, *, c, **d: 0", "lambda a, /: 0", "class A(x for x in y): pass", "class A(*b, c=d): pass", "f'{a!z}'", "f'{a! r}'", "f'{a!r}' rf'\\d{b}'", "'a' b'c'", "b'a' rb'c'", "'a' f'b'", "b'a' f'b'", "b'é'", "'é'",
    r"'\x4'", r"'\x41'", r"b'\x4'", r"r'\x4'", r"'\u12'", r"b'\u12'", r"'\U00110000'", r"'\N{BULLET}'", r"'\N{NO SUCH}'", r"f'\N{BULLET}{a}'", r"f'\x4{a}'", r"f'\{a}'", r"rf'\x{a}'", "x = {\n    'a': 1,\n}.get(1)\ny", "x = f(\n  1,\n)[0]", "def f(a\n, b): pass", "(" * 150 + ")" * 150, "(" * 250 + "1" + ")" * 250,
]


@pytest.mark.parametrize("text", PY)
def test_python_agrees_with_the_interpreter(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            valid = True
        except SyntaxError:
            valid = False
    assert (check_python(text)[0] is None) == valid, check_python(text)


def test_verdict_names_token_and_truncation():
    assert check_python("def f():\n    return (1,\n")[0] == "truncated"
    assert check_python("x = 1\ny = = 2\n") == ("token", 2, "=")
    assert check_js("let a = 1;\nlet = 2;\n")[:2] == ("token", 2)
    assert check_js("function f() {\n")[0] == "truncated"


def test_toml():
    good = ["", "a = 1", "[a.b]\nc = [1, 2,\n # x\n 3]\nd = {e = 1, f.g = 'x'}", "t = 1979-05-27T07:32:00Z\nl = 07:32:00\nf = 1e6\nh = 0xFF\ni = -inf", 'x = """a\n"b" \\\n c"""', "[[p]]\n'q r' = true", "1979-05-27 = 3", "a = [{b = 1}, [2]]"]
    bad = ["a = ", "a = [1, 2", "a = 01", "[a", "a b = 1", "a = 1 b = 2", "= 1", 'a = "x\n"', "a = {b = 1,}", "{}", "<<<<<<< HEAD", "a = yes"]
    assert [t for t in good if check_toml(t)[0]] == [] and [t for t in bad if not check_toml(t)[0]] == []


def test_toml_keys_and_tables_are_defined_once():
    good = ["a.b = 1\na.c = 2", "[a.b]\n[a]\nc = 1", "[[a]]\nx = 1\n[[a]]\nx = 1", "[a.b.c]\n[a]\nb.d = 1", "a = {b = 1}\n[c]\nb = 1", "[[a]]\n[a.b]\n[[a]]\n[a.b]"]
    bad = ["a = 1\na = 2", "a = 1\n\"a\" = 2", "[a]\n[a]", "a.b = 1\n[a]", "a = {b = 1}\na.c = 2", "a = 1\n[a.b]", "[a]\n[[a]]", "a = {b = 1, b = 2}", "[a.b]\nc = 1\n[a]\nb.c = 2", "a = []\n[[a]]", "a = {b.c = 1, b = 2}"]
    for text in good + bad:
        try:
            tomllib.loads(text)
            valid = True
        except tomllib.TOMLDecodeError:
            valid = False
        assert valid == (text in good) == (check_toml(text)[0] is None), text


def test_left_recursion_and_empty_languages():
    e = Engine("e: e '+' NUM | e '(' e ')' | NUM", "e")
    code = lambda *names: [e.kinds[n] << 2 for n in names]
    assert e.run(code("NUM", "+", "NUM", "(", "NUM", "+", "NUM", ")"))[0] == -1 and e.accepts(e.run(code("NUM", "+", "NUM"))[1])
    assert e.run(code("NUM", "NUM"))[0] == 1 and e.run(code("+"))[0] == 0 and not e.accepts(e.run(code("NUM", "+"))[1])
    endless = Engine("e: e '+' NUM", "e")
    assert endless.run([endless.kinds["NUM"] << 2])[0] == 0
    hidden = Engine("e: o e '+' NUM | NUM\no: [ '-' ]", "e")
    assert hidden.accepts(hidden.run([hidden.kinds[n] << 2 for n in ("-", "NUM", "+", "NUM", "+", "NUM")])[1])


@pytest.mark.parametrize("text", ["x = " + "(" * 5000 + "1" + ")" * 5000, "if (a) " * 5000 + "b()", "x = " + "[{a: " * 4000 + "1" + "}]" * 4000, "x = " + "`${" * 3000 + "1" + "}`" * 3000])
def test_deep_nesting_ends_no_job(text):
    assert check_js(text)[0] is None and check_js(text[:-1])[0] == "truncated" or text.endswith("b()")
    assert check_python("x = " + "(" * 5000)[0] == "lexical" and check_python("x = " + "not " * 20_000 + "y")[0] is None


def test_operator_nulls_unknown_and_extra_columns(spark):
    rows = [(1, "r", "a.py", "x =", "z"), (2, "r", "a.PY", "x = 1", "z"), (3, None, "b.css", "x =", "z"), (4, "r", None, "x =", "z"), (5, "r", "c.js", None, "z"), (6, "r", "d.js", "", "z"), (7, "r", "e.ts", "let a = ;" + " " * 200_000, "z")]
    df = spark.createDataFrame(rows, "file_no long, repo_root string, relpath string, source_text string, verdict string")
    got = {r.file_no: r.verdict for r in syntax_flags(df).collect()}
    assert set(got) == {1, 2, 5, 6, 7} and {k for k, v in got.items() if v} == {1, 7}
    assert syntax_flags(df.limit(0)).count() == 0
