import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftscan.functions.tags import VOCABULARY
from weftscan.operators import regex_scan
from weftscan.operators.extract import scan as scan_column
from weftscan.operators.lexicons import SCANNERS, names_module, scan
from weftscan.operators.walker.walk import GRAMMARS, segments

ALPHABETS = {
    "example": "ab1 '\"/*`\\\n", "go": "ab1 '\"/*`\\\n", "java": "ab1 '\"/*\\\n", "c-cpp": "ab1. '\"/*\\\n()!RuL8", "csharp": "ab '\"/*@${}\\\n", "python": "rbf '\"#{}\\\n",
    "ruby": "ab '\"#{}/%w[]<~=\\\n`?", "rust": "rbc '\"/*#!\\\n", "typescript": "ab '\"/*`${}\\\n()", "php": "ab '\"/*<?>#{$\n",
}


def own(family, text):
    """(text, last tag) of all segments but code."""
    return [(s[2], s[5][-1]) for s in scan(family, text) if s[5] != ("code",)]


@pytest.mark.parametrize("family", [f for f in SCANNERS if f != "ruby"])
def test_segments_cover_the_text(family):
    @settings(max_examples=250, deadline=None)
    @given(st.text(alphabet=ALPHABETS[family], max_size=40))
    def check(text):
        found = scan(family, text)
        assert "".join(text[s[0] : s[1]] for s in found) == text
        assert {t for s in found for t in s[5]} <= set(VOCABULARY[family])
        for s in found:
            assert s[3] is None or s[3] == text[s[0] : s[1]]

    check()


@settings(max_examples=250, deadline=None)
@given(st.text(alphabet=ALPHABETS["ruby"], max_size=40))
def test_ruby_is_total(text):
    found = scan("ruby", text)
    assert not text or found[-1][1] == len(text)
    assert {t for s in found for t in s[5]} <= set(VOCABULARY["ruby"])


@pytest.mark.parametrize("family", regex_scan.FAMILIES)
def test_patterns_agree_with_the_state_machine(spark, family):
    import random

    rng = random.Random(7)
    pool = list(ALPHABETS[family]) + ["//", "/*", "*/", '"""', "///", "//!", 'R"x(', ')x"', "1'0"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(800)] + ["", "a" * 5000 + "// x", "\U0001f600 // \U0001f600"]
    df = spark.createDataFrame([(t,) for t in texts], "content string").select("content", regex_scan.scan(F.col("content"), family).alias("s"))
    for r in df.collect():
        assert [(x.start, x.end, x.text, x.raw_text, x.map, tuple(x.tags)) for x in r.s] == scan(family, r.content), r.content


def test_c_family():
    assert own("c-cpp", "int n = 1'000; char c = 'x'; a.1'0") == [("x", "string.singleQuote"), ("0", "string.singleQuote")]
    assert own("c-cpp", 'u8R"d(a)")d" xR"(b)"') == [('a)"', "string.raw"), ("(b)", "string.doubleQuote")]
    assert own("c-cpp", "/// d\n//! e\n//// f\n/**/ /***/ /** g */") == [("d", "comment.line.doc"), ("e", "comment.line.doc"), ("// f", "comment.line"), ("", "comment.block"), ("", "comment.block.doc"), ("g", "comment.block.doc")]
    assert own("example", "'// no' /**/") == [("", "comment.block.doc")]
    began = time.time()
    found = scan("c-cpp", "x = " + "1'" * 100_000 + "1; // the end")
    assert found[-1][2] == "the end" and time.time() - began < 2


def test_csharp():
    assert own("csharp", '$"a{ f("b") /* c */ }d{{e}}"') == [("a", "string.interpolated"), ("b", "string.doubleQuote"), ("c", "comment.block"), ("d{{e}}", "string.interpolated")]
    assert own("csharp", '@"a""b" @"""c""" $$"""d"""') == [('a""b', "string.verbatim"), ("c", "string.raw"), ("d", "string.interpolated")]
    assert own("csharp", '$@"x""{1}y"') == [('x""', "string.interpolated"), ("y", "string.interpolated")]
    assert scan("csharp", '"""a""""')[-1][2] == ""  # the surplus quote opens a string


def test_python():
    assert own("python", "rb'\\'' f\"{a['b']}c{{\" Fr'''x{1:>{w}}y'''") == [("\\'", "string.raw"), ("b", "string.singleQuote"), ("c{{", "string.interpolated"), ("x", "string.interpolated"), ("y", "string.interpolated")]
    assert own("python", "xr'a' # c\r\n'''d\ne''' 'open") == [("a", "string.singleQuote"), ("c\r", "comment.line"), ("d\ne", "string.tripleQuote"), ("open", "string.singleQuote")]


def test_rust():
    assert own("rust", "/* a /* b */ c */ '\"' 'a r##\"x\"#y\"## br\"z\" cr\"w\" barc\"v\"") == [("a /* b */ c", "comment.block"), ('x"#y', "string.raw"), ("z", "string.byte.raw"), ("w", "string.c.raw"), ("v", "string")]
    assert own("rust", "/*! in */ //! l") == [("in", "comment.block.doc"), ("l", "comment.line.doc")]


def test_go_and_java():
    assert own("go", "`a\\` \"b\\\"\" '\\'' /** d */") == [("a\\", "string.raw"), ('b\\"', "string.doubleQuote"), ("\\'", "string.singleQuote"), ("d", "comment.block.doc")]
    assert own("java", '"""\n a"" b""" "" "c') == [('\n a"" b', "string.textBlock"), ("", "string.doubleQuote"), ("c", "string.doubleQuote")]


def test_php():
    assert own("php", "<b><?php // a ?>c<?= \"{$d['e']} f\" # g\n?>h<?xml 'i'") == [("<b>", "html"), ("a ", "comment.line"), ("c", "html"), ("{$d['e']} f", "string.doubleQuote"), ("g", "comment.line"), ("h", "html"), ("i", "string.singleQuote")]
    assert own("php", "<?php <<<'E'\nx\n  E; <<<E\ny\nEX\nE;") == [("x\n", "string.nowdoc"), ("y\nEX\n", "string.heredoc")]
    assert own("php", "<?php #[A]\n<<< $a;") == []


def test_ruby():
    assert own("ruby", "<<~A\n x #{b + 'c'} y\n A\n'd'") == [(" x ", "string.heredoc"), ("c", "string.singleQuote"), (" y\n", "string.heredoc"), ("d", "string.singleQuote")]
    assert own("ruby", "a = b / c; d = \"e\"; f =~ /'/; g 'h'") == [("e", "string.doubleQuote"), ("h", "string.singleQuote")]
    assert own("ruby", "=begin x\nbody\n=end tail\n%w[it's (a)]; ?' `l #{m}`") == [("body\n", "comment.block"), ("l ", "string.backtick")]
    assert own("ruby", "x << 'a'\r\ny <<-'Q'\r\n z\r\n Q\r\n'b'")[-1] == ("b", "string.singleQuote")


def test_typescript():
    assert own("typescript", "import x from './y'; require( \"z\" ); 'w'") == [("./y", "module.specifier.literal"), ("z", "module.specifier.literal"), ("w", "string.singleQuote")]
    assert own("typescript", "a = /[\"'/]/g; b / 'c'; new RegExp('d' // e\n, \"f\"); `g${ `h` }i`") == [("c", "string.singleQuote"), ("e", "comment.line"), ("g", "string.templateLiteral"), ("h", "string.templateLiteral"), ("i", "string.templateLiteral")]


def test_deep_nesting_needs_no_recursion():
    depth = 5000
    assert own("typescript", "`a${" * depth)[-1] == ("a", "string.templateLiteral")
    assert len(own("python", "f'{" * depth)) == 0


def test_python_and_native_columns_give_the_same_rows(spark):
    df = spark.createDataFrame([("// a\n'b'",), (None,), ("",)], "content string")
    rows = df.select(scan_column(F.col("content"), "go").alias("n"), scan_column(F.col("content"), "go", native=False).alias("p")).collect()
    assert [r.n for r in rows] == [r.p for r in rows]
    assert rows[1].n is None and rows[2].n == []


# -- the walker ---------------------------------------------------------------------------------------------------


def kinds(grammar, text):
    return [(s[2], s[5][-1].removeprefix("identifier.")) for s in segments(grammar, text) if s[5] != ("code",)]


def test_imports_and_what_they_hide():
    text = "import { expl } from './e.js';\nimport { expl as mine } from './e.js';\nimport d, * as ns from 'pkg';\nexport { expl } from './e.js';\nexport { expl as out };\nexpl.a(); mine.b.c; ns.e(); d();\nimport('./f.js'); import('g');"
    found = kinds("typescript", text)
    assert [x for x in found if x[1] in ("importBinding", "exportBinding")] == [("mine", "importBinding"), ("d", "importBinding"), ("ns", "importBinding"), ("out", "exportBinding")]
    assert [x[0] for x in found if x[1] == "variable"] == ["mine", "ns", "d"]
    assert not [x for x in found if x[1] == "property"]
    assert [x[0] for x in found if x[1] == "module.specifier.literal"] == ["./e.js"] * 3 + ["./f.js"]


def test_parameters_and_blocks_shadow():
    text = "import { expl } from './e.js';\nfunction f(expl) { return expl.one(); }\nfunction g(expl = 1) { return expl.two(); }\nfunction h() { const expl = 1; return expl.three; }\nexpl.four();"
    found = kinds("javascript", text)
    assert [x[0] for x in found if x[1] == "property"] == ["one", "two", "three"]
    assert sum(x[0] == "expl" for x in found) == 6


def test_bindings_of_import_calls_are_external():
    found = kinds("typescript", "const a = await import('p'); a.x(1); const b = require('q'); b.y; const c = require('r').z; c.w")
    assert [x[0] for x in found if x[1] == "property"] == ["z", "w"]


def test_kinds_of_names():
    found = dict(kinds("typescript", "class Greeter<T> { #p = 1; say(x: Foo.Bar): string { return x!; } }\ninterface I { k: T; m(): void } l: for (;;) { break l }\nconst { s, q: r } = o; enum E { A }"))
    assert found["Greeter"] == found["Bar"] == found["I"] == "type" and found["Foo"] == "variable"
    assert found["#p"] == "privateProperty" and found["say"] == found["k"] == found["q"] == found["A"] == "property"
    assert found["s"] == "shorthandProperty" and found["l"] == "label" and found["r"] == "variable"
    assert dict(kinds("javascript", "class A {} const r = a < b > (c);"))["A"] == "variable"
    assert ("b", "variable") in kinds("javascript", "const r = a < b > (c);")
    assert ("f", "variable") in kinds("typescript", "f<string>(x)")


def test_markup():
    found = kinds("tsx", "const x = <p className=\"a\">Caf&eacute; {y}<B.C/> </p>;")
    assert ("Café ", "jsx.text") in found and ("className", "property") in found and ("C", "property") in found
    assert not any(k == "jsx.text" for _, k in kinds("typescript", "const x = <div>hello world</div>;"))
    assert ("hello world", "jsx.text") in kinds("javascript", "function G() { return <div>hello world</div>; }")
    raw = "<p>Caf&eacute; na&#239;ve &#x2014; &amp; &bogus; text</p>"
    run = next(s for s in segments("tsx", raw) if s[5][-1] == "jsx.text")
    assert run[4] == [3, 3, 8, 1, 3, 3, 6, 1, 3, 3, 8, 1, 1, 1, 5, 1, 1, 1, 7, 7, 5, 5]


def test_literals_are_decoded():
    found = [s for s in segments("typescript", 'const s = "caf\\u00e9 \\n end"; "";`a\\n${b}c`') if "string" in s[5]]
    assert (found[0][2], found[0][4]) == ("café \n end", [1, 0, 3, 3, 6, 1, 1, 1, 2, 1, 4, 4, 1, 0])
    assert found[1][4] == [1, 0, 1, 0]
    assert [(s[2], s[3]) for s in found[2:]] == [("a\n", "a\\n"), ("c", "c")]


@pytest.mark.parametrize("grammar", GRAMMARS)
def test_the_walker_is_total(grammar):
    words = ["a", "b ", "(", ")", "{", "}", "[", "]", "<", ">", "=>", "=", '"s"', "`u${", "}", "`", "/", "//c\n", "/*d*/", ",", ";", ":", "?", ".", "class ", "import ", "export ", "const ", "type ", "<p>", "</p>", "&amp;", "@", "#p", "as ", "...", "async "]

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(words), max_size=25).map("".join))
    def check(text):
        found = segments(grammar, text)
        assert "".join(text[s[0] : s[1]] for s in found) == text
        assert {t for s in found for t in s[5]} <= set(VOCABULARY["syntax-tree"])

    check()


@pytest.mark.parametrize("opening, closing", [("f(", ")"), ("[", "]"), ("{", "}"), ("!", ""), ("typeof ", "")])
def test_nesting_does_not_end_the_walk(opening, closing):
    """Ten times the levels that once lost the rest of a file."""
    text = f"x = {opening * 30_000}'in'{closing * 30_000}\nconst after = 'text' // note\n"
    found = [s[2] for s in segments("typescript", text)]
    assert [t for t in found if t in ("after", "text", "note")] == ["after", "text", "note"]


def test_module_words():
    yes = ["import ", "from\t", "import(", "require \n( ", "x;from ", "import" + " " * 100 + "("]
    no = ["", "(", "xfrom ", "$import", "require ", "from(", "importer(", "from" * 9 + "x "]
    assert all(names_module(t + "'a'", len(t)) for t in yes)
    assert not any(names_module(t + "'a'", len(t)) for t in no)
