import ast
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.llm import lexmask, parse
from codequarry.llm.gll import Grammar


def spans(text, lang):
    s = lexmask.spans(pa.array([text]), lang)
    b = bytes(s.data)
    return [(int(k), b[lo:hi].decode()) for k, lo, hi in zip(s.kind, s.lo, s.hi)]


C, S, R, K, T = lexmask.COMMENT, lexmask.STRING, lexmask.REGEX, lexmask.KEY, lexmask.TEMPLATE


@pytest.mark.parametrize(
    "lang, text, want",
    [
        ("python", 'x = "a\\"b" # c\n"""d "q" """ + \'\'\'z\'\'\'', [(S, '"a\\"b"'), (C, "# c"), (S, '"""d "q" """'), (S, "'''z'''")]),
        ("go", "a /*/ b */ c /**/ `raw\\` '\\''", [(C, "/*/ b */"), (C, "/**/"), (S, "`raw\\`"), (S, "'\\''")]),
        ("javascript", 'a / b; /[/"]\\//.test(x) // c\nreturn /x/', [(R, '/[/"]\\//'), (C, "// c"), (R, "/x/")]),
        ("javascript", "`a${ {b:`q`}.x }c`", [(T, "`a$"), (T, "`q`"), (T, "c`")]),
        ("java", '"""\na "b"\n""" + \'"\'', [(S, '"""\na "b"\n"""'), (S, "'\"'")]),
        ("json", '{"a": "b\\\\"}', [(S, '"a"'), (S, '"b\\\\"')]),
        ("python", "", []),
    ],
)
def test_spans(lang, text, want):
    assert spans(text, lang) == want


def test_broken_and_unknown():
    s = lexmask.spans(pa.array(['"open\nx', "/* open", "ok", None]), "java")
    assert list(s.broken) == [True, True, False, False]
    assert lexmask.language_of("a\\B.PY") == "python" and lexmask.language_of(None) == "" and lexmask.language_of("x") == ""


def test_batches_do_not_leak_into_each_other():
    texts = ["a /", "/ b", "'x", "y'", "// c", "d"]
    alone = [spans(t, "javascript") for t in texts]
    s = lexmask.spans(pa.array(texts), "javascript")
    b = bytes(s.data)
    together = [[(int(k), b[lo:hi].decode()) for f, k, lo, hi in zip(s.file, s.kind, s.lo, s.hi) if f == i] for i in range(len(texts))]
    assert together == alone


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\"'#\\x", max_size=60))
def test_python_strings_and_comments_agree_with_tokenize(text):
    """Where the text tokenises, the automaton sees the same literals and comments."""
    import io
    import tokenize

    try:
        toks = list(tokenize.generate_tokens(io.StringIO(text).readline))
        ast.parse(text)
    except (SyntaxError, tokenize.TokenError, ValueError):
        return
    want = [t.string for t in toks if t.type in (tokenize.STRING, tokenize.COMMENT)]
    got = [x for _, x in spans(text, "python")]
    assert [w.lstrip("bB") for w in want] == got


def test_gll_handles_ambiguity_and_left_recursion():
    g = Grammar("E = E '+' E | 'n' | 'n' '?'\nL = L 'a' | 'a'\nN =\nO = 'x'? EOF", lambda w: w)
    one = lambda c: (c,)
    assert g.accepted("n+n+n+n", ["E", "L", "N"], one) == {"E"}
    assert g.accepted("aaaa", ["E", "L"], one) == {"L"}
    assert g.accepted("", ["N", "L", "O"], one) == {"O"}


def ok(lang, *texts):
    return list(parse.valid(pa.array(list(texts)), lang))


VALID = {
    "python": ["", "\ufeffx = 1\r\n", "def f(a, *b, c=1, **d) -> int:\n    return [x for x in a if x]\n", "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nfinally:\n    f'{x}'\n", "@d\nclass K(A, m=B):\n    x: int = 3\n    async def g(self):\n        await h()\n", "if a:\n    pass\nelif b: c()\nelse:\n    d = {**e, 'k': 1}\nwith a as b, c:\n    x[1:2, ...] += (y := 3)\n", "match x:\n    case [1, *_] if y:\n        pass\n", "print 'old'\n", "x = (1,\n  2)\n", "for i, j in z:\n\tlambda: 0\n"],
    "go": ["package p\n", "package p\nimport (\n\t\"a\"\n\tx \"b\"\n)\nfunc (t *T[K]) M(a, b int, c ...string) (int, error) {\n\tif err := f(); err != nil {\n\t\treturn 0, err\n\t} else {\n\t}\n\tfor i := range 10 {\n\t\tx[i]++\n\t}\n\tswitch v := y.(type) {\n\tcase int, string:\n\t\tgo func() {}()\n\tdefault:\n\t}\n\tm := map[string][]int{\"a\": {1, 2}}\n\tselect {\n\tcase c <- 1:\n\t}\n\treturn 1, nil\n}\ntype I interface {\n\tA() error\n}\nvar (\n\tq = 1\n)\n"],
    "java": ["", "package a.b;\nimport static c.D.*;\n@A(x = 1)\npublic class K<T extends L> extends M implements N {\n  private static final int[] X = {1, 2};\n  K() { super(); }\n  <R> R m(List<Map<String, R>> a, int... b) throws E {\n    for (var x : a) if (x) y(); else z();\n    try (var q = w()) { } catch (A | B e) { } finally { }\n    int r = switch (s) { case 1 -> 2; default -> { yield 3; } };\n    return (R) a.stream().map(R::new).filter(v -> v > 1).get();\n  }\n}\nenum Z { A(1), B { void f() {} }; int g; }\ninterface I { void f(); }\nrecord P(int x) { }\n"],
    "javascript": ["", "import a, {b as c} from 'd'\nexport default class K extends A {\n  #x = 1\n  static async *m(a, {b, c = 1}, ...d) { yield* z }\n  get q() { return this.#x }\n}\nconst f = async (x) => ({...x, [k]: 1, m() {}})\nlet y = a ? b : c\nfor (const k of z) { if (k) continue\n else break }\nlabel: while (1) { switch (x) { case 1: y(); default: } }\nvar s = `a${b + `c${d}`}e`, re = /[/]x/g.test(y)\na?.b?.[c] ?? d\n", "x = function () {}\ny = 1\n"],
    "typescript": ["interface A<T> extends B { readonly x?: number; f(a: string): void\n [k: string]: any }\ntype U = 'a' | { b: C[] } | ((x: number) => void)\nexport abstract class K<T> implements A<T> {\n  constructor(private readonly x: number, y?: string) { super() }\n  protected async m<R>(a: Array<R>): Promise<R | undefined> { return a as unknown as R }\n}\nenum E { A = 1, B }\nconst n = x!.y satisfies Z\nfunction isA(x: any): x is A { return true }\n"],
    "json": ["", '{"a": [1, -2.5e3, true, null, {"b": "c\\n"}]}', "[]"],
    "yaml": ["", "a: 1\nb:\n  - c: d\n    e: 'f''g'\n  - h\ni: |\n  text: : {\n   more\nj: [1, {k: l}]\n# end\n", "- a\n- b: c\n", "k:\n- x\n- y\nz: \"q\"\n"],
    "properties": ["", "a=b\n! c\nd : e\\\n f\nx\\u0041=1\n"],
}
INVALID = {
    "python": ["def f(:\n    pass\n", "if a:\npass\n", "x = (1, 2\n", "return return\n", "  x = 1\n y = 2\n", "<<<<<<< a\nx = 1\n=======\n", "'open\n", "else:\n    pass\n", "try:\n    pass\nx = 1\n", "x = [1)\n", "a b\n"],
    "go": ["func f() {}\n", "package p\nfunc f( {\n}\n", "package p\nfunc f() {\n\tx := \n}\n", "package p\nclass A {}\n", "package p\nfunc f() {}\n)\n"],
    "java": ["class K {", "class K { void m() { int x = ; } }", "package p\nfunc f() {}\n", "class K { void m() { x() } }", "const a = (b) => {};"],
    "javascript": ["function f( {}", "const x = ;", "def f(x):\n    return x\n", "a b c", "<!DOCTYPE html>\n<html></html>", "class A { int x; }", "x = [1, 2", "<<<<<<< ours\nx\n=======\ny\n>>>>>>> theirs\n"],
    "typescript": ["def f(x):\n    return x\n", "const x: = 1", "class K { private int f(int x) { return x; } }"],
    "json": ['{"a": }', '{"a": 1,}', '{"a" 1}', '[1 2]', '{"a": "x\ny"}', "{'a': 1}"],
    "yaml": ["a: 1\n<<<<<<< x\nb: 2\n=======\nc: 3\n", "a: 'b\nc: d\n", "a: [1, 2\n", "a:\n  - b\n c: d\n", "a: b: c\n"],
    "properties": ["a=\\u12\n"],
}


@pytest.mark.parametrize("lang", VALID)
def test_valid_files(lang):
    assert ok(lang, *VALID[lang]) == [True] * len(VALID[lang])


@pytest.mark.parametrize("lang", INVALID)
def test_invalid_files(lang):
    assert ok(lang, *INVALID[lang]) == [False] * len(INVALID[lang])


def test_python_agrees_with_the_interpreter_on_mutations():
    rnd = random.Random(5)
    base = VALID["python"][2] + VALID["python"][3] + VALID["python"][5]
    texts = []
    for _ in range(150):
        i = rnd.randrange(len(base))
        texts.append(base[:i] + rnd.choice(["", "(", ")", ":", "x", " ", "\n", "=", "]"]) + base[i + rnd.randrange(2):])
    for t, got in zip(texts, ok("python", *texts), strict=True):
        try:
            compile(t, "t", "exec", ast.PyCF_ONLY_AST)
            want = True
        except SyntaxError as e:
            # What is no matter of grammar: bounds of targets, keyword order and the like.
            if not any(x in str(e.msg) for x in ("invalid syntax", "never closed", "unmatched", "indent", "does not match", "expected", "unterminated")):
                continue
            want = False
        if want:
            assert got, t


def test_long_and_deep_texts():
    deep = "x = " + "(" * 60 + "1" + ")" * 60 + "\n"
    long = "x = [" + "1, " * 50_000 + "]\n"
    assert ok("python", deep, long, deep[:-2]) == [True, True, False]


def test_very_deep_nesting_is_linear():
    n = 20_000
    assert ok("json", "[" * n + "]" * n, "[" * n + "]" * (n - 1), "[" * n + "}" * n) == [True, False, False]
