import pytest

from millrace.llm import lexers, syntax

JS_GOOD = [
    "", "import { a as b } from './x.js';\nimport c, { d } from 'e';\nexport { b };\n", "const f = async (x) => {\n  await g({ a: 'b', n: 1 });\n  return x;\n};\n",
    "export class K extends L {\n  static n = 1;\n  async m(a, b = 2) {\n    if (!a) {\n      throw new Error('}');\n    }\n    return this.n;\n  }\n}\n",
    "const t = `\n<<<<<<< a ${ { b: `c` }.b }\n`;\nlet r = s.replace(/[({]x\\/y/g, \"\");\n", "for (const x of [1, 2].map((n) => n * 7)) { y?.z(...x) }\n", "a = b ? 'c' : 'd'\nfoo()\n[1, 2].forEach(f)",
    "// <<<<<<< HEAD\n/* def f(: */\nexport default function (q) { switch (q) { case 1: break; default: go(); } }\n", "try { a() } catch (e) { b() } finally { c() }", "[1, {\"a\": null}]",
]
JS_BAD = [
    "const x = {\n", "function f( {", "export class", "const d", "if (a", "const f = (x) =>", "<<<<<<< HEAD\nlet a = 1;\n=======\nlet a = 2;\n>>>>>>> b\n", '{\n  "a": 1,\n  "b": [2]\n}\n',
    "<!doctype html>\n<html></html>\n", "def f(x):\n    return x\n", "# Title\n\nSome text here.\n", "const s = 'abc\n", "let t = `abc", "import { a } from", "/* open", "foo(]", "return }", "const a = 1 2;", "class A { m() { return 1; }",
]
PY_BAD = [
    "def f(:\n    pass\n", "def f():\n", "class A:\n    def f(self):\n        return (1,\n", "try:\n    x = 1\ny = 2\n", "x = 1\n    y = 2\n", "if x:\npass\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n",
    "x = [1, 2\n", "x = 'abc\n", '"""open', "# T\nSome plain text here.\n", "const a = 1;\n", '{"a": null, "b" 1}\n', "x = 09\n", "@dec\n", "from .a ", "if x:\n        y\n    z\n", "elif x:\n    pass\n", "x = {a = 1}\n",
]
PY_GOOD = [
    "", "# only a comment\n", "x: int = 1\n", "async def f(a, *b, c=1, **d) -> dict[str, int]:\n    async with a as b:\n        return [x async for x in b if x]\n",
    "try:\n    pass\nexcept (A, B) as e:\n    raise C from e\nelse:\n    pass\nfinally:\n    pass\n", 'x = """\ndef broken(:\n<<<<<<< HEAD\n"""\n', "f = lambda x, *y: x if y else -x\n", "print(f'{x!r:>{w}}', end='')\nx = a[1:2, ::3]\nwhile a and b < 3: a = a.b()\n",
    "@d\nclass A(B, metaclass=C):\n    '''Doc'''\n    def f(self): ...\n\n\n\nx = y \\\n    + 1\n", "for i, (a, b) in enumerate(c):\n    continue\nelse:\n    pass\n", "match x:\n    case 1: pass\n", "import a.b as c, d\nfrom . import e\nfrom ..f import (g, h as i,)\nassert a, 'b'\n",
]


MORE_PY_BAD = [
    "1 = x\n", "f() = 1\n", "None = 1\n", "True = f\n", "a + b = c\n", "x = y = 1 = z\n", "(a) + b = 1\n", "f(a=1, b)\n", "f(**k, a)\n", "f(**k, *a)\n", "def f(a=1, b): pass\n", "def f(**k, a): pass\n", "class A(x=1, B): pass\n",
    "if x = 1: pass\n", "while x = 1: pass\n", "return x = 1\n", "del f()\n", "del 1\n", "a: int: str\n", "x = b'\u00e9'\n", "try:\n    pass\nexcept E, e:\n    pass\n", "raise E, 'x'\n", "x = a if b\n", "for f() in x: pass\n", "for 1 in x: pass\n",
    "global a.b\n", "x += y += 1\n", "a, b += 1\n", "f() += 1\n", "import a.b as c.d\n", "from a import b.c\n", "with open(x) as f = 1: pass\n", "assert x = 1\n", "x = = 1\n", "x ++\n", "print 'x'\n", "exec 'x'\n", "class A:\nx = 1\n", "else:\n    pass\n", "x = (1, 2\ny = 3\n", "def f(a, a=):\n    pass\n", "lambda x: = 1\n",
]
MORE_PY_GOOD = [
    "x += 1; y -= f(2); z = a if b else c\n", "def f[T](a, /, b=1, *, c, d=2, **k) -> int: ...\n", "class A[T](B): x: int = 1\n", "match x:\n    case [a, *b] if a > 1: pass\n    case {'k': v, **rest}: pass\n    case A(x=1) | None: pass\n    case -1: pass\n    case _:\n        y = 1\n",
    "type X = int | str\n", "match = 1\ncase = match(1)\ntype(x)\nmatch.case[1] = 2\n", "f(a, *b, c, k=1, *d, **e, g=2)\n", "f(x for x in y if x)\n", "f(a=lambda x=1: x, b=2)\n", "print(*a, sep='')\nprint(a, b=1)\n", "a.b[c].d, (e, *g) = h = yield_ = 1\n", "x: dict[str, int]\n", "(a): int = 1\n",
    "for i, (a, b) in c: pass\n", "for x[0] in y: pass\n", "del a, b[0], (c, d)\n", "async def f():\n    async with a as b, c: pass\n    await x\n    return [y async for y in z]\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise\nfinally: x = 1\n", "lambda *a, **k: (a, k)\n", "x = yield\n".replace("x = yield", "def f():\n    x = yield 1\n    y = yield from z\n    yield"),
    "assert (x := 1), 'm'\nif (y := f(x)) == 1: pass\n", "return_ = not x\n@a.b(c=1)\n@d\nclass E: ...\n", "x = 1 if a else 2 if b else 3\n", "d = {**a, 'b': 1, **c}\ns = {*a, 1}\n", "x = a[1:2, ..., ::3]\nx[:] = []\n", "from . import (a, b as c,)\nfrom ...d import *\n", "nonlocal_ = 1\ndef f():\n    global a, b\n", "x = f'{a!r:>{w}} {{}} {b[\"k\"]}'\n",
]
TOML_BAD = [
    "a = 1\na = 2\n", "[t]\nx = 1\nx = 2\n", "[t]\n[t]\n", "[a.b]\n[a.b]\n", "a.b = 1\na.b = 2\n", "x = {a = 1, a = 2}\n", "'a' = 1\na = 2\n", "d = 2021-13-01\n", "d = 2021-02-30\n", "t = 25:00:00\n", "d = 2021-01-01T10:61:00Z\n", "d = 2023-02-29\n",
]
TOML_GOOD = [
    "a = 1\n[b]\na = 1\n[c]\na = 1\n", "[[x]]\na = 1\n[[x]]\na = 2\n", "[[x]]\n[x.y]\na = 1\n[[x]]\n[x.y]\na = 1\n", "a.b = 1\na.c = 2\nb.a = 1\n", "x = [{a = 1}, {a = 1}]\ny = {a = {a = 1}, b = 2}\n", "d = 2024-02-29\nt = 23:59:59.5\no = 2021-01-01T00:00:00-07:00\nl = 2021-01-01 10:00:00\n",
    "[a]\n[a.b]\n[a.b.c]\n", "'a.b' = 1\na.b = 2\n", "a = [\n 1, 2, # c\n]\nb = 'a = 1'\n",
]
MORE_JS_GOOD = [
    "class A extends f({}) {}\n", "class A { static { init(); } static x = 1; 'a'() {} 1() {} get b() { return 1; } async *c() {} }\n", "label: { break label; }\n", "const f = function* () { yield 1; };\n", "import x from './a.json' with { type: 'json' };\n", "const o = { 'a'() {}, 1: 2, async b() {}, get c() { return 1; }, [d]: e, f, ...g };\n",
    "a?.b?.[c]?.(d);\nx = y ? z : w ? 1 : 2;\n", "if (a) b(); else if (c) d(); else { e(); }\n", "try { a(); } catch { b(); }\ntry { a(); } finally { c(); }\n", "const { a, b: [c] = [], ...d } = e;\n", "const f = async (a, { b } = {}) => { await g(a); };\nasync function h() {}\nasync(1);\n", "for (const [k, v] of Object.entries(o)) { if (k) continue; else break; }\n",
    "let s = `a ${b ? `c` : 'd'} e`;\n", "do { x++; } while (x < 3);\n", "switch (a) { case 1: { b(); break; } case 'c': default: d(); }\n", "export default class {}\nexport * as q from 'r';\nexport { a as b };\n", "const r = /[/\\]]+/g.test(x) / 2;\n", "x ??= y ** 2;\n(a, b);\n!function () {}();\n",
]
MORE_JS_BAD = [
    "foo(); else { bar(); }\n", "if (x) { a(); } catch (e) { b(); }\n", "let v = a ? b;\n", "try { a(); }\n", "1 = 2;\n", "'a' = b;\n", "a?.b = 1;\n", "const x = ;\n", "f(a b);\n", "let 1x = 2;\n", "class { a() {} \n", "return x y;\n", "for (let i = 0; i < 3; i++ { }\n", "x = { a: 1, b 2 };\n", "export { a, b\n", "import a b from 'c';\n", "function (a) { }\n".replace("function (a)", "function f(a"), "a => { b\n", "var a = [1, 2;\n", "if a { b(); }\n",
]


def found(spark, files, extra=True):
    rows = [(i, path, text, "clash") for i, path, text in files]
    df = spark.createDataFrame(rows, "file_id long, file_path string, source string, uid string")
    return {r.file_id for r in syntax.unparsable_files(df.union(df) if extra else df).collect()}


@pytest.mark.parametrize(("name", "good", "bad"), [
    ("x.mjs", JS_GOOD + MORE_JS_GOOD, JS_BAD + MORE_JS_BAD), ("x.PY", PY_GOOD + MORE_PY_GOOD, PY_BAD + MORE_PY_BAD), ("y.toml", TOML_GOOD, TOML_BAD),
    ("x.json", ['{"a": [1, -2.5e3, true, null, "\\u00e9"], "b": {}}', " [] ", '"s"'], ["", "{", '{"a": 1,}', "{'a': 1}", '{"a" 1}', "[1 2]", '{"a": 1} x', "[1}", '{"a": tru}', '{1: 2}', '"open']),
    ("x.toml", ["", "# c\n[a.b]\nx = 1\ny = [\n  'p', # q\n  \"r\",\n]\nz = { k = 2021-01-01 }\n[[c]]\n\"q\" = '''\n=====\n'''\n"], ["x = ", "x = [1", "[a", "x = y", "x 1", "<<<<<<< HEAD\n", "x = 'abc\n", "Text of words\n"]),
])
def test_languages(spark, name, good, bad):
    files = [(i, name, t) for i, t in enumerate(good)] + [(100 + i, name, t) for i, t in enumerate(bad)]
    got = found(spark, files)
    assert {i for i in got if i < 100} == set(), [good[i] for i in got if i < 100]
    assert got == {100 + i for i in range(len(bad))}, [bad[i] for i in range(len(bad)) if 100 + i not in got]


def test_other_rows(spark):
    long = "x = [\n" + "  1,\n" * 20_000
    assert found(spark, [(1, "a.py", None), (2, None, "def ("), (3, "a.txt", "def ("), (None, "a.py", "def ("), (4, "b.Js", long), (5, "b.py", long + "]\n")]) == {4}
    assert found(spark, [(1, "a.py", "def (")], False) == {1}
    df = spark.createDataFrame([], "file_id long, file_path string, source string")
    assert syntax.unparsable_files(df).count() == 0


def test_rates(spark):
    files = spark.createDataFrame([(1, "o/r", "a.py", "x = ("), (2, "O/R.git", "b.py", "x = 1"), (3, None, "c.json", "{")], "file_id long, repo string, file_path string, source string")
    moves = spark.createDataFrame([], "old_repo string, new_repo string")
    symbols = spark.createDataFrame([(2, "wrong"), (1, "")], "file_id long, parse_error string")
    got = {(r.repo, r.language): (r.n_files, r.n_broken, r.n_reported) for r in syntax.parse_rates(files, moves, symbols).collect()}
    assert got == {("o/r", "python"): (2, 1, 1), ("?", "json"): (1, 1, 0)}


def test_permitted_pairs_are_few():
    assert 1000 < len(lexers.permitted_pairs()) < 120_000


def test_the_standard_library_is_not_suspected(spark):
    """Real files that parse; six of some 220 use strings nested in strings, which the lexer doesn't follow."""
    import ast
    import glob
    import json as package

    folder = package.__file__.rsplit("/", 2)[0]
    files = [(i, path, open(path, encoding="utf-8", errors="replace").read()) for i, path in enumerate(sorted(glob.glob(f"{folder}/[a-m]*.py")))]
    files = [f for f in files if len(f[2]) < 60_000]
    for f in files:
        ast.parse(f[2])
    df = spark.createDataFrame(files, "file_id long, file_path string, source string").repartition(8)
    names = {r.file_id for r in syntax.unparsable_files(df).collect()}
    assert len(files) > 40 and len(names) <= 2, [files[i][1] for i in names]
