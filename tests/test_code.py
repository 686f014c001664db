"""Parsers, extraction, windows and context, on small files of each language."""

import random
import time

import pytest

from loomcut.lang import LANGUAGES, Source, parse
from loomcut.operators import chunker as C
from loomcut.operators.entities import delimiter, extract, unquote

PY = '''"""Module."""
import os.path as p, sys
from typing import Optional


@deco(1)
class Store(Base):
    """Keeps things.

      indented
    """

    async def run(self, a: int = 3, *b) -> Optional[int]:
        def inner():
            return 1
        return inner()


def top(a,
        b):
    pass
'''
TS = '''import D, { A, type B as C } from "./m";
import * as ns from 'n';
import "side";
export { A as Q };
/** Doc of f. */
export async function f<T>(a: string, b?: { x: number }): Promise<Array<T>> { return a as any; }
/** Keeps.
 *  - more
 */
abstract class Kept<T> extends Q<T> implements I {
  private x: number = 1;
  constructor(private a: string) { super(); }
  get v(): number { return this.x / 2 / 1; }
  abstract no(): void;
}
interface I extends J { a: string; m(x: number): void }
type U<T = string> = { [k: string]: T } | null;
enum E { A = 1, B }
const g = (x: number) => { function deep() { return /[/"]/g; } };
'''
RS = '''use std::collections::{HashMap, HashSet as HS};
use crate::a::*;
/// Doc.
/// Two.
pub struct S<'a> { a: &'a str }
impl<'a> Tr for S<'a> { fn f(&self) -> i32 { match x { 1 => 2, _ => { 3 } } } }
trait Tr { fn f(&self) -> i32; fn g(&self) {} }
'''
GO = '''package main

import (
	"fmt"
	x "a/b/c"
)

// Doc of T.
type T struct {
	A int `json:"a"`
}

// F does.
func F(a int) (int, error) {
	for i := 0; i < 3; i++ {
		fmt.Println(i)
	}
	return 0, nil
}

func (t *T) M() {}
'''
JAVA = '''package a.b;
import java.util.List;
import java.util.*;
/** Doc. */
public class A<T> extends B {
    private int x = 1;
    /** Makes. */
    public A(int a) { this.x = a; }
    @Override public <K> List<K> m(final int a) throws X { Runnable r = () -> { }; return null; }
    enum In { P, Q; void z() {} }
}
'''
FILES = {"a.py": PY, "b.ts": TS, "c.rs": RS, "d.go": GO, "e.java": JAVA, "f.js": 'import R from "react"\nexport const a = 1\nclass P { #p = 1; m(a) { return `x${a}` } }\nfunction* gen() { yield* x }\n'}


def found(path):
    return [(e.type, e.name, e.signature, e.docstring, e.parent, e.source) for e in C.entities_of(path, FILES[path])[0]]


def test_python_entities():
    got = found("a.py")
    assert [g[:2] for g in got] == [("import", "p"), ("import", "sys"), ("import", "typing"), ("import", "Optional"), ("class", "Store"), ("function", "run"), ("function", "inner"), ("function", "top")]
    assert got[4][3] == "Keeps things.\n\n      indented" and got[5][2] == "async def run(self, a: int = 3, *b) -> Optional[int]"
    assert got[5][4] == "Store" and got[6][4] == "run" and got[7][2] == "def top(a, b)"


def test_typescript_entities():
    got = found("b.ts")
    assert [g[:2] for g in got] == [
        ("import", "D"), ("import", "A"), ("import", "C"), ("import", "ns"), ("import", "side"), ("export", "<anonymous>"), ("function", "f"), ("class", "Kept"), ("method", "constructor"), ("method", "v"),
        ("interface", "I"), ("type", "U"), ("enum", "E"), ("function", "deep"),
    ]
    assert got[6][2] == "async function f<T>(a: string, b?: { x: number }): Promise<Array<T>>" and got[6][3] is None  # its comment is the export's sibling
    assert got[7][3] == "Keeps.\n - more" and got[11][2] == "type U<T" and got[0][5] == "./m"


def test_rust_entities():
    got = found("c.rs")
    assert [g[:2] for g in got] == [("import", "HashMap"), ("import", "HS"), ("import", "*"), ("type", "S"), ("class", "Tr"), ("function", "f"), ("interface", "Tr"), ("function", "g")]
    assert got[3][3] == "Doc.\nTwo." and got[5][2] == "fn f(&self) -> i32"


def test_go_entities():
    got = found("d.go")
    assert [g[:2] for g in got] == [("import", "<anonymous>"), ("import", "fmt"), ("import", "x"), ("type", "T"), ("function", "F"), ("method", "M")]
    assert got[2][5] == "fmt" and got[3][3] is None and got[4][3] == "F does."


def test_java_entities():
    got = found("e.java")
    assert [g[:2] for g in got] == [("import", "List"), ("import", "util"), ("class", "A"), ("type", "A"), ("method", "m"), ("enum", "In"), ("enum", "P"), ("enum", "Q"), ("method", "z")]
    assert got[2][3] == "Doc." and got[3][3] == "Makes." and got[4][2] == "@Override public <K> List<K> m(final int a) throws X"


def test_javascript_entities():
    assert [g[:2] for g in found("f.js")] == [("import", "R"), ("export", "<anonymous>"), ("class", "P"), ("method", "m"), ("function", "gen")]


def test_node_type_walk():
    got = C.entities_of("b.ts", TS, mode="node_types")[0]
    assert [e.type for e in got].count("import") == 5 and ("method", "v", "Kept") not in [(e.type, e.name, e.parent) for e in got]
    assert {e.parent for e in C.entities_of("a.py", PY, mode="node_types")[0] if e.name == "run"} == {"Store"}


@pytest.mark.parametrize("path", FILES)
@pytest.mark.parametrize("size", [20, 60, 200, 1500])
def test_chunks_are_the_code(path, size):
    code = FILES[path]
    chunks = C.chunk(path, code, C.Options(max_chunk_size=size, overlap_lines=2, compat="exact"))
    at = 0
    for i, c in enumerate(chunks):
        a, b = c["byte_range"]["start"], c["byte_range"]["end"]
        assert c["text"] == code[a:b] and a >= at and c["index"] == i and c["total_chunks"] == len(chunks)
        assert c["line_range"] == {"start": code[:a].count("\n"), "end": code[:b].count("\n")}
        at = b
        for side in ("before", "after"):
            d = [s["distance"] for s in c["context"]["siblings"] if s["position"] == side]
            assert d == sorted(d) and len(d) <= 3
    strip = lambda s: "".join(s.split())
    assert strip("".join(c["text"] for c in chunks)) == strip(code)
    assert [c["total_chunks"] for c in C.stream(path, code)] == [-1] * len(C.chunk(path, code))


def test_empty_unsupported_and_override():
    assert C.chunk("a.py", "") == [] and C.chunk("a.py", " \n\t") == []
    with pytest.raises(C.UnsupportedLanguage, match="Unsupported file type: a.rb"):
        C.chunk("a.rb", "x")
    assert C.chunk("a.txt", "def f(): pass", C.Options(language="python"))[0]["context"]["entities"][0]["name"] == "f"
    assert C.detect("a.b/c") is None and C.detect("x.PY") is None and C.detect("x.mts") == "typescript"


def test_leaf_split():
    code = 'x = """' + "\n".join("word " * 20 for _ in range(6)) + '"""\n'
    exact = C.chunk("a.py", code, C.Options(max_chunk_size=100, compat="exact"))
    assert "".join(c["text"] for c in exact if '"""' in c["text"] or "word" in c["text"]).count("word") == 120
    repeated = C.chunk("a.py", code, C.Options(max_chunk_size=100))
    assert sum(c["text"].count("word") for c in repeated) > 120  # whole lines, of which neighbours share one


def test_context_modes():
    o = C.Options(max_chunk_size=60, filter_imports=True)
    with_imports = [c for c in C.chunk("a.py", PY, o) if c["context"]["imports"]]
    assert {i["name"] for c in with_imports for i in c["context"]["imports"]} <= {"p", "sys", "typing", "Optional"}
    none = C.chunk("a.py", PY, C.Options(context_mode="none", overlap_lines=0))[0]
    assert none["context"]["filepath"] is None and none["contextualized_text"] == none["text"]
    assert all(not c["context"]["siblings"] for c in C.chunk("a.py", PY, C.Options(max_chunk_size=60, sibling_detail="none")))


def test_format():
    ctx = {"filepath": "x/a/b/c.ts", "scope": [{"name": "m"}, {"name": "K"}], "entities": [{"type": "method", "signature": "m()"}, {"type": "import", "signature": "i"}], "imports": [{"name": f"i{k}"} for k in range(12)], "siblings": [{"name": "p", "position": "before"}, {"name": "q", "position": "after"}]}
    assert C.format_chunk_with_context("T", ctx, "o") == "# a/b/c.ts\n# Scope: K > m\n# Defines: m()\n# Uses: i0, i1, i2, i3, i4, i5, i6, i7, i8, i9\n# After: p\n# Before: q\n\n# ...\no\n# ---\nT"


def test_utf16_offsets():
    code = 's = "🎉🎉"\nt = 1\n'
    c = C.chunk("a.py", code, C.Options(max_chunk_size=8, overlap_lines=0))[-1]
    assert code.encode("utf-16-le")[c["byte_range"]["start"] * 2 : c["byte_range"]["end"] * 2].decode("utf-16-le") == c["text"]
    assert C.Counts("function hello() { return 42; }").nws[-1] == 26 and C.Counts("ab cd").nws == [0, 1, 2, 2, 3, 4]


def test_errors():
    bad = "\n".join(f"function b{i}( {{" for i in range(5))
    message = parse(bad, "typescript")[1].message
    assert "more" in message and message.startswith("MISSING at line 5, column ")
    assert parse("a)\n", "javascript")[1].message == "ERROR at line 1, column 2"
    assert C.chunk("a.ts", bad)[0]["context"]["parse_error"]["recoverable"]
    assert parse("x = 1\n", "python")[1] is None


@pytest.mark.parametrize("path", FILES)
def test_malformed_code_never_raises(path):
    r = random.Random(1)
    for _ in range(60):
        s = list(FILES[path])
        for _ in range(r.randint(1, 8)):
            i = r.randrange(len(s))
            s[i : i + r.randint(0, 2)] = r.choice("(){}[]<>\"'`;:,=@#/\\\n \tx")
        code = "".join(s)
        C.chunk(path, code, C.Options(max_chunk_size=50))
        root = parse(code, C.detect(path))[0]
        for n in root.walk():
            at = n.start
            for c in n.children:
                assert at <= c.start and c.end <= n.end and c.parent is n
                at = c.end


@pytest.mark.parametrize("language", LANGUAGES)
@pytest.mark.parametrize("code", ["(" * 2000, "{" * 2000, "if (a) {" * 300, "if(a){}else " * 500, "a=>{" * 300, "\x00\x01", "/*", "'", '"""'])
def test_deep_and_odd_code(language, code):
    root, _ = parse(code, language)
    extract(root, Source(code), language)


def test_small_pieces():
    assert delimiter("f(a: {x}) {", "{") == 10 and delimiter("a<b> {", "{") == 5 and delimiter("'{' {", "{") == 4 and delimiter("x", "{") == -1
    assert unquote('"a"') == "a" and unquote("'a\"") == "'a\""


JSX = [
    ("javascript", "function A() { return <p>don't</p>; } function B() {}", ["A", "B"]),
    ("javascript", "const x = () => <li>http://x.y // and `</li>;\nfunction B() {}", ["B"]),
    ("javascript", "const x = ok && <a.b:c d-e='>' f={'}'} {...g}><>{/* it's */}</></a.b:c>\nclass K {}", ["K"]),
    ("typescript", "const f = <T,>(x: T) => x; const g = <T extends U>(x: T): T => x; function h<T>(a: Array<Array<T>>) {}", ["h"]),
    ("typescript", "const y = <any>window; const f = <T>(x: T) => { return x }; class K { m(): Set<string> { return null } }", ["K", "m"]),
    ("typescript", "function A() { return <List<string> a={1} render={() => { function inner() {} return <b>it's</b> }} />; }", ["A", "inner"]),
    ("javascript", "if (a < b) { c = d > e; } function B() { return a <b && c> d }", ["B"]),
]


@pytest.mark.parametrize("language,code,names", JSX)
def test_jsx(language, code, names):
    root, error = parse(code, language)
    assert error is None
    assert [e.name for e in extract(root, Source(code), language)] == names


def test_markup_that_never_ends_is_tried_once():
    import time

    began = time.perf_counter()
    for code in ("x = <a>{ y = " * 400, "x = <T>(a: T) => { y = " * 400, "x = <a b={" * 400):
        parse(code, "typescript")
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("language,code,n", [
    ("javascript", "function a() {" * 1500 + "}" * 1500, 1500), ("typescript", "class A { m() { return [" + "[" * 3000 + "]" * 3000 + "] } }", 2),
    ("java", "class A {" * 1500 + "}" * 1500, 1500), ("rust", "mod a {" * 1000 + "fn f() {}" + "}" * 1000, None), ("go", "package p\nfunc f() {" + "{" * 3000 + "}" * 3000 + "}", None),
])
def test_nesting_is_as_deep_as_the_code(language, code, n):
    root, error = parse(code, language)
    found = extract(root, Source(code), language)
    assert error is None and (n is None or len(found) == n)
    assert sum(1 for x in root.walk() if not x.children) >= len(code.split("{")) - 1


def _functions(n):
    return "\n".join(f'function f{i:08d}() {{\n  return "aaaaaaaaaaaaaaaaaaaa";\n}}' for i in range(n)) + "\n"


def _template(language, n):
    from loomcut.plans.sourcecode import TEMPLATES

    t = TEMPLATES[language]
    lines = [*t.head, *(x.replace("{s}", str(s)) for s in range(n) for x in t.method), *t.tail]
    return "\n".join(x.replace("{n}", "3").replace("{r}", "1").replace("{s}", "0") for x in lines) + "\n"


GROWTH = {
    "chunk_code_scopes": lambda n: C.chunk("a.java", _template("java", n), C.Options(max_chunk_size=95)),
    "chunk_context": lambda n: C.chunk("a.js", _functions(n), C.Options(max_chunk_size=60)),
    "merged_windows": lambda n: C.chunk("a.js", "class N {\n" + _functions(n).replace("function f", "f") + "}\n", C.Options(max_chunk_size=140)),
    "node_walk_rust": lambda n: C.entities_of("a.rs", _template("rust", n), None, "nodes"),
    "entities_go": lambda n: C.entities_of("a.go", _template("go", n)),
    "tree_windows": lambda n: C.chunk("a.js", _functions(n), C.Options(max_chunk_size=120)),
    "entities_rust": lambda n: C.entities_of("a.rs", _template("rust", n)),
    "batch_progress": lambda n: C.chunk("a.go", _template("go", n)),
    "option_merge": lambda n: C.chunk("a.txt", _functions(n), C.Options(max_chunk_size=60, language="javascript")),
    "chunk_code_batch": lambda n: C.chunk("a.go", _template("go", n), C.Options(max_chunk_size=2**31 - 1)),
}


@pytest.mark.parametrize("name", GROWTH)
def test_a_long_file_costs_in_proportion(name):
    """Eight times the declarations take about eight times the work; looking at all others for each took up to 64 times."""

    def seconds(n):
        began = time.process_time()
        GROWTH[name](n)
        return time.process_time() - began

    assert min(seconds(4000) for _ in range(2)) < 20 * min(seconds(500) for _ in range(3))
