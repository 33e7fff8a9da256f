"""p2: the recogniser, the grammars, and the operator."""

import ast
import random

import pytest

from codestrata.llm import gll, syntax
from codestrata.llm.gll import EOF, Grammar, recognise

GOOD = {
    "py": ["", "x = 1\n", "def f(a, /, b, *, c=1, **k) -> int:\n    return [i async for i in a if i] or {**k}\n", "match x:\n    case {'a': [1, *_], **r} if r: pass\n    case C(x=1) | None: pass\n",
           "class A[T](B, metaclass=M):\n    x: int = 0\n    @d(1)\n    async def f(self): await g(); yield\n", "with (open(a) as b, c): pass\n", "f'{x!r:>{w}} {y=}'\n", "lambda *a, b=1: (yield)\n", "try:\n  pass\nexcept* E as e:\n  raise\nelse:\n  x = y = *z, 1\n", "type X[T] = list[T]\n", "print(x for x in y)\nx[1:2, ::3]\ndel a, b[0]\n"],
    "js": ["", "#!/usr/bin/env node\nlet x = a / b / /re[/]g/.test(c)\n", "export default async function* f({a = 1, ...b}, [c]) { for await (const x of y) yield* x }", "import d, * as n from 'm'; export {a as b} from './x'\nlabel: for (;;) break label", "const o = {get a() { return 1 }, async *[b]() {}, 'c': 1, d}; a?.b?.[c]?.(d) ?? e",
           "`a${`b${c}`}d`\nvar s = tag`x`", "class A extends (B, C) { #p = 1; static { this.x } get y() { return #p in this } }", "if (a) b\nelse c\ndo x(); while (y)\nreturn_ = 1", "x = a ? (b) : (c, d) => ({e})", "with (a) b", "export const f = async x => { await x }"],
    "jsx": ["const a = <div className=\"x\" {...p}>{x > 1 && <b/>} text &amp; <A.B c={<i/>}></A.B></div>;", "f(<></>, a < b)"],
    "ts": ["interface A<T extends B = C> extends D { readonly [k: string]: number; m?(x: T): void; new (a: 1): A<T>; }", "type F<T> = T extends (infer U)[] ? { [K in keyof U]?: U[K] } : `a${string}`", "abstract class X<T> implements Y { private constructor(public a?: number, ...b: string[]) { super() } abstract m(): void; declare x: string; static #y!: number }",
           "enum E { A = 1, B }\ndeclare module 'x' { export function f(a: number): string; }\nexport type { T } from './t'", "function f(this: A, x: unknown): asserts x is string\nfunction f<T>(x: T): x is T { return x as any }", "const x = <T,>(a: T) => a!; let y = f<Map<string, Array<number>>>(z) satisfies Q", "let v = <any>w", "let z: [a: number, b?: string] | undefined = a < b ? c : d"],
    "tsx": ["const f = <T,>(p: P<T>) => <div<string> a={1}>{p.x as any}</div>;", "export function A({ a }: { a: number }) { return <>{a}</> }"],
    "rs": ["", "fn f<'a, T: Into<Vec<Vec<i64>>> + ?Sized>(x: &'a mut T) -> impl Fn(u8) -> Option<T> where T: 'a { x.y::<u8>()?; loop { break 'a'; } }", "#![allow(x)]\nuse a::{self, b::*, c as _};\npub(crate) mod m { #[derive(A)] pub struct S<const N: usize>(pub u8, [u8; N]); }", "impl<T> !Send for S<T> {}\nmacro_rules! m { ($x:expr) => { $x + 1 }; }",
           "fn g() { if let Some(x @ 1..=5) | None = y && z { } else if a == B { c } match x { Foo { a, .. } => 1, &(ref b, _) if b => {} | _ => panic!(\"x\") , } }".replace("{} | _", "{} _"), "fn h() { let r = r#\"a\"b\"#; let c = move |a: u8, (b, _)| -> u8 { a }; for i in 0..n { *p += 1; } x = a as u8 < b; }", "/* a /* nested */ b */ const X: &str = \"\\u{1F600}\"; enum E { A = 1, B(u8), C { d: u8 } }", "async fn k() { z.await?; unsafe { &raw const a } ; let else_ = 1; let Some(q) = w else { return }; }"],
    "go": ["package a\n", "package a\nimport (\n\t\"fmt\"\n\tb \"x/y\"\n)\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\tfor i, v := range m { if v, ok := m[i]; !ok { continue } }\n\tswitch x := y.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect { case <-c: case d <- 1: }\n\treturn map[string][]int{\"a\": {1}}[k][1:2], nil\n}\n",
           "package a\ntype (\n\tA struct { B; *c.D; e, f int `json:\"e\"` }\n\tI interface { ~int | string; M(x int) error }\n)\nconst (\n\tX = iota\n\tY\n)\nvar f = func() {}\nfunc G[K comparable, V any](m map[K]V) { go func() { defer x() }(); L: for { break L }; G[int, string](nil); p := &T{a: 1}; if a == (T{}) { } ; var ch chan<- int; _ = ch }\n"],
}
BAD = {
    "py": ["def f(:\n", "x = (1\n", "if x:\npass\n", "<<<<<<< HEAD\nx = 1\n=======\n", "import { a } from 'b';\n", "x = 'abc\n", "class A\n    pass\n", "f(a b)\n"],
    "js": ["function f( {", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "def f(x):\n    return x\n", "let x: number = 1;", "const a = <div/>;", "foo(a[b, c)\n", "x = `a${b`", "class A { constructor( { }", "a b"],
    "jsx": ["const a = <div></span>;", "<a>", "let x: T = 1"], "ts": ["const a = <div/>;", "interface A { x: number", "function f(a: ) {}", "package main\nfunc main() {}\n"], "tsx": ["const x = <a><b></a>;", "type A = {"],
    "rs": ["fn f( { }", "fn f() { let x = ; }", "import x from 'y';", "struct S { a: u8", "fn f() { <<<<<<< HEAD\n }", "let x = 1;", "fn f() { x y }"],
    "go": ["", "func main() {}\n", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nfunc f() { return 1 2 }\n", "package a\nvar s = \"abc\n", "use std::io;\n"],
}


@pytest.mark.parametrize("language", GOOD)
def test_valid_sources_parse(language):
    for text in GOOD[language]:
        assert syntax.parses(language, text), text
        assert syntax.parses(language, text.replace("\n", "\r\n")), text
        assert syntax.parses(language, "\ufeff" + text), text


@pytest.mark.parametrize("language", BAD)
def test_broken_sources_are_rejected(language):
    for text in BAD[language]:
        if text or language != "go":
            assert not syntax.parses(language, text), text


def test_python_grammar_agrees_with_the_language():
    """Random cuts and swaps of lines: the grammar decides as Python's own parser does."""
    rng = random.Random(5)
    base = "\n".join(t.rstrip("\n") for t in GOOD["py"] if "await" not in t) + "\n"
    words = base.split(" ")
    for _ in range(300):
        cut = words[:]
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(cut))
            cut[i] = rng.choice(["", cut[rng.randrange(len(cut))]])
        text = " ".join(cut)
        try:
            ast.parse(text)
            want = True
        except SyntaxError:
            want = False
        assert syntax.parses("py", text) == want, text


def test_ambiguous_and_left_recursive_grammars():
    g = Grammar("Many = Many Many | 'a' ; Sum = Sum '+' One | One ; One = 'n' ;", ["Many", "Sum"])
    assert recognise(g, ["a"] * 25 + [EOF], ["Many", "Sum"]) == {"Many"}
    assert recognise(g, ["n", "+", "n", "+", "n", EOF], ["Many", "Sum"]) == {"Sum"}
    assert recognise(g, ["n", "+", EOF], ["Many", "Sum"]) == set()
    palindrome = Grammar("Pal = 'a' Pal 'a' | 'b' Pal 'b' | 'a' | 'b' ;", ["Pal"])
    assert recognise(palindrome, [*"abbabba", EOF], ["Pal"]) and not recognise(palindrome, [*"abbabbb", EOF], ["Pal"])


def test_long_and_deep_sources():
    assert syntax.parses("js", "x = [" + "1, " * 60_000 + "];")
    assert syntax.parses("js", "x = " + "(" * 3000 + "1" + ")" * 3000)
    assert not syntax.parses("js", "x = " + "(" * 3000 + "1" + ")" * 2999)


SCHEMA = "file_id long, scan_id long, repo string, rel_path string, language string, bytes long, content binary, errors long, missing long, digest string, kind int"


def rows(*files):
    return [(i, 1, r, p, lang, 1, c, None, None, "clash", 7) for i, r, p, lang, c in files]


def test_operator(spark):
    files = rows((1, "r", "a.py", "Python", b"x = (\n"), (2, "r", "b.pyi", "Python", b"x = 1\n"), (3, "r", "c.py", None, b"x = (\n"), (4, "r", "d.js", "JavaScript", b"x = (\n"), (5, "r", "e.js", "JavaScript", None),
                 (6, "r", "f.rs", "Rust", b"\xff\xfe"), (7, "r", "README", None, b"x = ("), (8, None, "g.MJS", "JavaScript", b""), (9, "r", None, None, b"x"), (1, "r", "a.py", "Python", b"x = (\n"))
    df = spark.createDataFrame(files, SCHEMA)
    assert sorted(r.file_id for r in syntax.broken_files(df).collect()) == [1, 1, 3, 4, 6]
    rates = {(r.repo, r.language): (r.files, r.broken, r.rate) for r in syntax.broken_rates(df).collect()}
    assert rates["r", "Python"] == (3, 2, 2 / 3) and rates["r", None] == (1, 1, 1.0) and rates[None, "JavaScript"] == (1, 0, 0.0)
    assert syntax.broken_files(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_of_imports_are_names_elsewhere():
    for language in ("js", "ts", "tsx", "jsx"):
        for text in ("const x = require('y');\nmodule.exports = { require, assert: x.assert };", "assert(z); let using = 1; using = require / 2 / using; x = assert / 2 / using / 3", "function f(assert, using) { return require.resolve(assert) }"):
            assert syntax.parses(language, text), (language, text)
    assert syntax.parses("js", "using x = f()") and syntax.parses("ts", "import x = require('y')")


def test_python_targets_and_order_of_arguments():
    for text in ("1 = x\n", "f() = 1\n", "a + b = c\n", "x, y += 1\n", "for 1 in x: pass\n", "f(a=1, b)\n", "f(**a, *b)\n", "def f(a=1, b): pass\n", "def f(a, *): pass\n", "lambda a=1, b: 0\n"):
        assert not syntax.parses("py", text), text
    for text in ("a.b, *c[1] = (d, [e]) = x\n", "(x) += 1\n", "f(a)[0].b = 'c'.d = 1\n", "f(a=1, *b, **c, d=2)\n", "f(*a, b, c=1)\n", "def f(a, b=1, /, c=2, *d, e, g=1, **k): pass\n", "lambda a, /, b=1, *, c, **k: 0\n", "with a as (b, c[0]): pass\n", "for i, *j in k: pass\n", "f(x for x in y)\n", "x.y: int = 1\n"):
        assert syntax.parses("py", text), text


def test_what_looks_right_to_a_looser_grammar():
    bad = {
        "py": ["f(x for x in y, 1)\n", "x = 0777\n", "del f()\n", "del 1\n", "(a, b) += 1\n", "class A(x for x in y): pass\n", "[a]: int = 1\n", "a := 1\n", "[x for 1 in y]\n", "x: int: str = 3\n"],
        "js": ["const x", "for (const x;;) {}", "1 = 2", "a ?? b || c", "a => {}()", "08n", "1__0", "a + b = c", "a?.b = 1", "x++ = 1", "a = 1 = 2", "for (a of b, c) {}"],
        "rs": ["fn f() { a < b < c; }", "fn f() { a == b == c; }", "fn f() { match x { 1 => 2 3 => 4 } }", "fn f() { let x = 5 }"],
        "go": ["package a\nfunc f() { 1 := 2 }", "package a\nfunc f() { defer x }", "package a\nfunc f() { a, b }", "package a\nfunc f() { f() := 1 }"],
        "ts": ["1 = 2", "a ?? b && c"],
    }
    good = {
        "py": ["del (a, b), [c], d.e, f[0]\n", "a.b: int = 1\n", "(a): int = 1\n", "x = 0_0, 00, 0.07\n", "(y := f(x)), [z := 1]\n", "match x := 1, 2:\n    case _: pass\n"],
        "js": ["a = b = c ? d = 1 : e => f", "a || b && c; (a ?? b) || c", "[a, b] = [b, a]; ({a, b} = c)", "(a) = 1; this.x.y = super.z = 1", "new A().b = 1; f()[0] += 2", "x = 1_000n + 0x1_f + 1.5e1_0 + .5", "async x => await x", "for (const x of a, b);".replace(", b", ""), "a.b ||= c ?? d; x = y => ({}).z"],
        "ts": ["declare const x: number;", "a!.b! = 1; (x as any).y = <T>z", "const f: (a: T) => U = a => b as U"],
        "rs": ["fn f() { if let Some(x) = y && a < b { } let z = (a < b) == c; match x { 1 => {} 2 => 3, _ => 4 } }"],
        "go": ["package a\nfunc f() { a, b := 1, 2; a, b = b, a; defer func() {}(); go a.b[c](d); x++; <-c; select { case v, ok := <-c: } }"],
    }
    for language, texts in bad.items():
        for text in texts:
            assert not syntax.parses(language, text), (language, text)
    for language, texts in good.items():
        for text in texts:
            assert syntax.parses(language, text), (language, text)


def mutations(language, rng, count):
    """Token lists of the sources above, most with a token or two lost, put in or swapped."""
    lists = [t for text in GOOD[language] + BAD[language] if (t := syntax.LANGUAGES[language][3](text)) and len(t) > 1]
    for _ in range(count):
        *body, end = rng.choice(lists)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(body) + 1)
            body[i : i + rng.randrange(2)] = rng.choice([[], [rng.choice(rng.choice(lists)[:-1])]])
        yield [*body, end]


@pytest.mark.parametrize("language", GOOD)
def test_shared_steps_agree_with_the_stack_graph(language, monkeypatch):
    """Parts of any size, joined and forgotten at any place, give what the graph gives, node by node."""
    rng, graph, starts = random.Random(7), gll.walk_graph, list(syntax.LANGUAGES[language][2])
    walked = []
    monkeypatch.setattr(gll, "walk_graph", lambda *a: walked.append(a) or graph(*a))
    for sizes in ({}, {"HIGH": 2, "KEPT": 1, "ROOM": 20, "SLICE": 5}, {"HIGH": 3, "KEPT": 2, "MOST": 6, "HIGHEST": 9}):
        for name, value in sizes.items():
            monkeypatch.setattr(gll.Parts, name, value)
        grammar = Grammar(syntax.LANGUAGES[language][0], starts, frozenset(syntax.LANGUAGES[language][1]))
        for tokens in mutations(language, rng, 150):
            assert recognise(grammar, tokens, starts) == graph(grammar, tokens, starts), tokens
        assert sizes or not walked  # plain sources need no graph


def test_like_statements_are_worked_out_once(monkeypatch):
    """What costs time, the steps worked out, does not grow with the text; before, each call of a rule made nodes of its own."""
    monkeypatch.setattr(gll, "walk_graph", None)
    work = []
    after = gll.Parts.after
    monkeypatch.setattr(gll.Parts, "after", lambda *a: work.append(a) or after(*a))
    for language, line in (("js", "x.y(a, {b: [c, 1]}).z = (d) => { return e[f] };\n"), ("py", "x.y(a, {b: [c, 1]}).z = lambda d: e[f]\n"), ("rs", "fn f(a: B<C>) -> D { e.f(&g)?; match h { I(j) => k, _ => {} } }\n")):
        syntax.grammar_of(language)._parts.clear()
        assert syntax.parses(language, line * 3)
        few = len(work)
        assert syntax.parses(language, line.replace("(a", "(other") * 3000) and not syntax.parses(language, line * 3000 + "(") and len(work) < few + 20
        work.clear()


def test_ambiguous_grammars_leave_the_shared_steps():
    g = Grammar("Many = Many Many | 'a' ; Pal = 'a' Pal 'a' | 'b' Pal 'b' | 'a' | 'b' ;", ["Many", "Pal"])
    assert recognise(g, ["a"] * 25 + [EOF], ["Many", "Pal"]) == {"Many", "Pal"}
    long = ["a", "b"] * 60
    assert recognise(g, [*long, "a", *reversed(long), EOF], ["Pal"]) == {"Pal"} and not recognise(g, [*long, "a", *long, EOF], ["Pal"])


def test_what_follows_a_comment_or_ends_nowhere():
    """An odd character or an open string behind a comment stays one, though a later comment or string would end it; a zero byte breaks a source, not the task."""
    for language, text in (("js", "x = 1 /* a */ § /* b */\n"), ("ts", "x /* a */ 'b\n/* c */\n"), ("go", "package a /* a */ § /* b */\n"), ("go", "package a\nvar x = 1 // `\n§ // `\n"),
                           ("rs", "m! { a /* b */ § /* c */ }\n"), ("rs", "m! { r###\" }\nm! { \" }\n"), ("rs", "m! { /* /* */ }\n"), ("py", "x = '\0'\n"), ("py", "x = 1\n# a\0\n"), ("js", "a\0"), ("go", "package a\0"), ("rs", "\0")):
        assert not syntax.parses(language, text), (language, text)
    for language, text in (("js", "x = 1 /* a */ / 2 /* b */\n"), ("go", "package a /* a\n */ var x = 1 /* b */ // `\n"), ("rs", "m! { a /* b /* c */ d */ r###\" \"## \"### br####\"\"#### }\n/* /* */ /**/ */ fn f() { x /***/ ; /*/ */ }\n")):
        assert syntax.parses(language, text), (language, text)


def test_lexemes_that_are_kept_depend_on_nothing_before():
    """Words behind dots, numbers with odd ends, slashes and brackets are told anew after others that look alike."""
    ecma = syntax.lexers.ecma
    for _ in range(2):
        assert ecma("a.if; if\n.if ?. if") == ["NAME", ".", "NAME", ";", "if", "\n.", "NAME", "?.", "NAME", "<eof>"]
        assert ecma("a = 0; b = 0x") is None and ecma("a = 0; b = 0") == ["NAME", "=", "NUM", ";", "NAME", "=", "NUM", "<eof>"]
        assert ecma("if (a) /b/; (a) /b/ {} /c/")[4:] == ["REGEX", ";", "(", "NAME", ")", "/", "NAME", "/", "{", "}", "/", "NAME", "/", "<eof>"]
        assert ecma("`${{}}${`a`}`\n`b`") == ["TPL_HEAD", "{", "}", "TPL_MID", "TPL", "TPL_TAIL", "\nTPL", "<eof>"]
    assert syntax.lexers.go("package a\nx := 1 /* b\n */ y /* c */ z") == ["package", "NAME", ";", "NAME", ":=", "NUM", ";", "NAME", "NAME", ";", "<eof>"]
    assert syntax.lexers.rust("b'a' 'a r#if if rb br\"x\" 1..2 1.0f64") == ["CHAR", "LIFETIME", "NAME", "if", "NAME", "STR", "NUM", "..", "NUM", "NUM", "<eof>"]
