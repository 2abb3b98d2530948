"""Forms of real files that a recogniser easily takes for errors, and errors close to them."""

import ast
import sysconfig
from pathlib import Path

import pyarrow as pa
import pytest

from codequarry.llm import parse

VALID = {
    "javascript": [
        "#!/usr/bin/env node\nrun('//');\n", "if (x) /a\"b/.test(y);\n", "while (f(a)) /[/]/.exec(b)\n", "m(/* x */ /[-]+'/);", "x = a / b / c;\n", "s.replace(/\\$1/, n.min)",
        "s.replace(/a\\*b'/, '')", "class A {\n  #a\n  #b = {}\n  #c = new Map()\n  has(o) { return #a in o }\n}\n", "if (a) b = {c: 1}\nelse if (d) b = 2\nelse\n  return {e: 3}\n",
        "export * as ns from 'x';\nexport * from 'y'\n", "async function f() { await using x = g(); using y = h(); using = 1 }", "class A { accessor x = 1; accessor() {} }",
        "class A {\n  [x] = () => {}\n  [y] () {}\n}", "const a = `${f({a: {b: {c: {d: `${1}`}}}})}`\n", "if (a)\n{\n  b()\n}\nelse\n{\n  c()\n}\n",
    ],
    "typescript": [
        "export function f(x: unknown): asserts x;\n", "export type * from './a';\nexport type * as t from './b';\n", "declare module 'm' {\n  global {\n    var x: number\n  }\n}\n",
        "interface A {\n  a: Record<string, number>\n  b: number\n}\n", "type K<T> = T extends `${infer A}-${infer B}` ? A : never;\n", "let x: typeof import('a').default\nlet y: import('b').C<D>\n",
        "class A {\n  @once\n  get(): void {}\n  @log()\n  x = 1;\n}\n", "declare class A {\n  constructor (a: string)\n  b (): Array<C>\n  d (): E | undefined\n  [Symbol.iterator]: () => F<G>\n}\n",
        "declare function f(h: H): Record<string, string>\n\nexport declare function g(): void\n", "let ok = a >\n  b\n",
    ],
    "python": [
        "x = f'{f'{1}'}'\n", "x = f\"{a[\"b\"]:{w}}\" f'{\n  y  # why\n}'\n", "match p:\n    case A(x=1, y=B() as c) | {'k': [1, *r], **s}:\n        pass\n    case -1 | 2.5 + 3j | a.b | (_, str()):\n        pass\n",
        "x = rf'\\{y}' '\\N{DASH}'\n", "# it's f'\nx = f'{z!r:>10}'\n",
    ],
    "java": ["open module a.b {\n  requires transitive c.d;\n  exports a.b to e, f.g;\n  provides X with Y, Z;\n}\n"],
    "yaml": [
        " a: b\n c:\n   - d\n", "- env:\n    A: b\n  run: |\n    it's \"odd\n  c: 'd'\n", "- - a\n  - b\n- - c\n", "a: plain text\n  that runs on, - `too`\n  # remark\nb: 1\n",
        "? - a\n  - b\n: - c\n", "a: [b, 'c: d', {e: f}, # remark\n  g]\nh: {i: [], j: \"k\n  l\"}\n", "a: &x !t\n  b: *y\nc: >-\n  text: [\n\n  more\n--- # next\nd\n", "\"a\": b\n'c' : d\n", "a:\n- b\n- c: d\n  e: f\n",
    ],
    "properties": ["a=b\\u00e9\\\\\n c : \\\n  d\\n\n", "x=C\\:\\\\path\n" + "y=" + "u" * 200 + "\\u0041\n"],
}
INVALID = {
    "javascript": ["if (x) /a/.test(y;\n", "class A { #a #b }\n", "let s = 'a\n';", "#!/x\nfoo(\n", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x\n"],
    "typescript": ["function f(x): asserts x is\n", "interface A { a: Record<string, number b: c }\n", "foo {\n}\n"],
    "python": ["x = f'{f'{1}''\n", "x = f'{a\n'\n", "match p:\n    case A(x=1 as):\n        pass\n", "f(a as b)\n"],
    "java": ["module a { requires ; }\n"],
    "yaml": ["a: b\n  c: d\n", "a: 'b\n", "a: [b\nc: d\n", "a:\n    b: 1\n  c: 2\n", "a: b: c\n", "- a\nb: c\n", "a: @b\n", "a: \"b\" c\n"],
    "properties": ["a=\\u00g1\n", "a=\\\\\\u12\n"],
}


def judged(lang, texts):
    return parse.valid(pa.array(texts), lang).tolist()


@pytest.mark.parametrize("lang", VALID)
def test_forms(lang):
    assert [t for t, ok in zip(VALID[lang], judged(lang, VALID[lang]), strict=True) if not ok] == []
    assert [t for t, ok in zip(INVALID[lang], judged(lang, INVALID[lang]), strict=True) if ok] == []


def test_library_files_parse():
    files = sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[:160]
    texts = [f.read_text("utf-8") for f in files]
    for t in texts:
        ast.parse(t)
    assert [f.name for f, ok in zip(files, judged("python", texts), strict=True) if not ok] == []
