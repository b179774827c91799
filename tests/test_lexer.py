from echofold.functions import lexer as L


def words(source):
    return [t[0] for t in L.lex(source).tokens]


def test_strings_and_interpolation():
    x = L.lex('let a = "x\\(f(b) + 1)y"\n')
    assert [t[0] for t in x.tokens] == ["let", "a", "=", '"', "x", "\\", "(", "f", "(", "b", ")", "+", "1", ")", "y", '"']
    assert [t[1] for t in x.tokens][3:5] == [L.UNKNOWN, L.LITERAL]
    assert words('""') == ['"', "", '"']
    assert words('#"a\\(b)\\#(c)"#') == ["#", '"', "a\\(b)", "\\", "#", "(", "c", ")", '"', "#"]
    assert words('"""\na\nb\n"""') == ['"""', "\n", "a\n", "b\n", '"""']


def test_comments_and_positions():
    x = L.lex("/* a /* b */ c */ é x // end\n  y")
    assert [t[0] for t in x.tokens] == ["é", "x", "y"]
    assert x.tokens[1][2:] == (1, 22) and x.tokens[2][2:] == (2, 3)
    assert x.comments == [(1, "/* a /* b */ c */"), (1, "// end")]


def test_operators():
    assert words("a??b") == ["a", "??", "b"]
    assert words("x?.y!") == ["x", "?", ".", "y", "!"]
    assert words("f<A<B>>(c)") [-5:] == [">", ">", "(", "c", ")"] or words("f<A<B>>(c)")[-4:] == [">>", "(", "c", ")"]
    assert words("0..<n") == ["0", "..<", "n"]
    assert words("f(&x)") == ["f", "(", "&", "x", ")"]


def test_boundaries():
    src = "import A\n@objc\nfinal class K {\n  let q = 1\n}\nlet s = 1 +\n  2\nfoo\n  .bar()\n#if X\nfunc a() {}\nfunc b() {}\n#endif\nvar t = 2; var u = 3\n"
    x = L.lex(src)
    assert [x.tokens[b][0] for b in x.boundaries] == ["import", "@", "let", "foo", "#if", "var", "var"]


def test_normalization():
    n = L.normalized
    assert n(L.IDENTIFIER, "$0") == "$PARAM" and n(L.IDENTIFIER, "$") == "$PARAM"
    assert n(L.IDENTIFIER, "foo") == "$ID" and n(L.IDENTIFIER, "String") == "String"
    assert n(L.LITERAL, "42 apples") == "$NUM" and n(L.LITERAL, "-x") == "$NUM" and n(L.LITERAL, ".foo") == "$NUM"
    assert n(L.LITERAL, "") == "$STR" and n(L.LITERAL, "abc") == "$STR" and n(L.LITERAL, '"1') == "$STR"
    assert n(L.KEYWORD, "let") == "let"
    assert n(L.IDENTIFIER, "foo", names=False) == "foo" and n(L.LITERAL, "4", literals=False) == "4"


def test_location_directive():
    assert L.lex("x\n \t#sourceLocation(file: 1)").located
    assert L.lex('"a\n#sourceLocation"').located
    assert not L.lex("x #sourceLocation").located


def test_directives():
    d = L.directive
    assert d("// @ef:accept -- reviewed", 3) == {"line": 3, "kind": "accept", "rules": [], "reason": "reviewed"}
    assert d("/* @echofold:accept:next exact-clone,near-clone */", 1)["rules"] == ["exact-clone", "near-clone"]
    assert d("// @ef:disable all", 1)["rules"] == []
    assert d("// @ef:accept:this bogus", 1) is None
    assert d("// @ef:accept bogus exact-clone", 1)["rules"] == ["exact-clone"]
    assert d("/// @ef:accept", 1) is None and d("/** @ef:accept */", 1) is None and d("// ef:accept", 1) is None
    assert d("// @ef:frobnicate", 1) is None


def test_any_text_is_accepted():
    for s in ("", "\"", "\"\\(", "/* ", "`", "#\"", "'''", "}}}}", "﻿\0", "a\\", "0x", "1.2.3", "/x", "\"\"\"\n"):
        x = L.lex(s)
        assert len(x.tokens) == len(x.ends)


def test_snippets():
    body = "\n".join(f"    let v{i} = {i}" for i in range(6))
    src = f"struct S {{\n  /// doc\n  public func f(a: Int) -> Int {{\n{body}\n  }}\n  func g() {{ 1 }}\n  init() {{\n{body}\n  }}\n}}\n"
    got = L.snippets(src)
    assert [(s["first"], s["last"]) for s in got] == [(3, 10), (12, 19)]
    assert "/// doc" in got[0]["code"] and got[0]["tokens"] == len(got[0]["code"]) // 4
