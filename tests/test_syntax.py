import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions.lexers import lex
from quillspan.functions.trees import parse, walk
from quillspan.operators import extract
from quillspan.sources import files


@pytest.mark.parametrize(
    "language,text,fault",
    [
        ("ruby", "def f\n  x = <<~SQL\n    it's (\n  SQL\n  y\nend", None), ("ruby", "def f\n  s =~ /[\"']/\n  1\nend", None), ("ruby", 'def f(a)\n  "x #{a ? "y" : \'z\'} w"\nend', None), ("ruby", "def f\n  %w[a b].each do |x|\n    puts x / 2\n  end\nend", None),
        ("ruby", "def f(x) = x + 1\n", None), ("ruby", "def f\n  a / b / c\nend", None), ("ruby", "def f\n  while x do\n    y\n  end\n  x << Y\nend", None), ("rust", "fn f() { /* a /* b */ ( */ }", None), ("rust", "fn f() { /* a /* b */ }", "unterminated_literal"),
        ("cpp", "#error can't\nint f() { return 1; }", None), ("cpp", "#ifdef A\nvoid f() {\n#else\nvoid g() {\n#endif\n}\n", None), ("javascript", "f(x) {\n return /[\"']/.test(x);\n}", None), ("javascript", 'f(x) { return `a ${x ? `b` : "c"} d`; }', None),
        ("javascript", "f() { let a = b / c; let d = e / g; }", None), ("javascript", "f() { return `a ${b}; }", "unterminated_literal"), ("php", "<?php\nfunction f() { # it's\n return \"a\nb\"; }", None), ("php", "<p>it's</p>\n<?php f(); ?>\nisn't", None),
        ("csharp", 'class A { string s = @"a ""b"" \\"; }', None), ("python", "def f():\n    return '''it's ('''", None), ("go", "func f() {\n", "premature_end"), ("java", "int f() { return a[1); }", "unbalanced"), ("go", "", None),
    ],
)
def test_faults(language, text, fault):
    assert lex(text, language).fault == fault


def test_tokens_cover_the_text():
    r = random.Random(5)
    for language in ("java", "ruby", "typescript", "rust", "python", "cpp", "php", "go"):
        for _ in range(200):
            text = "".join(r.choice(["def f\n", "end\n", "{", "}", "(", ")", '"a"', "'", "`", "x = 1;", "# c\n", "// d\n", "/* e */", "\n", " ", "<<~A\n", "A\n", "${", "#{", "if x\n", "é"]) for _ in range(r.randint(0, 30)))
            lexed, at = lex(text, language), 0
            for _, start, stop in lexed.tokens:
                assert start >= at or text[start:stop].startswith(("{", "#{", "${")) or stop >= at
                at = max(at, stop)
            assert at <= len(text) and all(0 <= k < len(lexed.tokens) and 0 <= v < len(lexed.tokens) for k, v in lexed.pair.items())
            parse(text, language)


@pytest.mark.parametrize(
    "language,text,want",
    [
        ("java", "/** Doc. */\n@Override\npublic <T> List<T> f(int a,\n    Map<String, T> b) throws X {\n  if (a) { g(); }\n  return new R() { void h() { } };\n}", [("method", "f", "/** Doc. */"), ("method", "h", None)]),
        ("java", "public interface A {\n  int f(int a);\n}\nrecord P(int x) { }\nenum E { A, B }", [("interface", "A", None), ("method", "f", None), ("class", "P", None), ("enum", "E", None)]),
        ("rust", "/// Says.\n#[inline]\npub(crate) async fn f<'a>(x: &'a str) -> R<'a> where T: X {\n  let s = S { a: 1 };\n}\nimpl<T: X> Tr for S<T> { fn g(&self) {} }\npub const N: usize = 3;", [("function", "f", "/// Says."), ("impl", "Tr", None), ("function", "g", None), ("const", "N", None)]),
        ("go", "// Doc one.\n// Doc two.\nfunc (r *R) F(a int) (int, error) {\n\tx := T{1}\n\treturn x, nil\n}\n\n// far\n\ntype T struct {\n\ta int\n}\ntype N int\n", [("method", "F", "// Doc one.\n// Doc two."), ("type", "T", None), ("type", "N", None)]),
        ("typescript", "export default class A<T> extends B {\n  @Input() x: number = 1\n  constructor(private a: string) { super() }\n  get y(): number { return 1 }\n  f = (a) => { return a }\n}\nexport type U = { a: string }\nfunction g() {\n  if (x) { h() }\n}", [("class", "A", None), ("method", "constructor", None), ("method", "y", None), ("type", "U", None), ("function", "g", None)]),
        ("cpp", "template <typename T>\nT A<T>::f(const T& a) const {\n  return a;\n}\nA::A(int x) : a(x), b{x} {\n}\nnamespace n {\nclass B : public A {\npublic:\n  virtual ~B() { }\n  bool operator==(const B& o) const { return true; }\n};\n}\ntypedef struct { int a; } P;\nusing Q = int;", [("function", "A<T>::f", None), ("function", "A::A", None), ("impl", "n", None), ("class", "B", None), ("function", "~B", None), ("function", "operator==", None), ("type", "P", None), ("type", "Q", None)]),
        ("csharp", "namespace N {\n/// <summary>Doc</summary>\npublic class A : B {\n  public int X { get; set; }\n  public async Task<int> F(int a) => a;\n  void G() { }\n}\n}", [("impl", "N", None), ("class", "A", "/// <summary>Doc</summary>"), ("const", "X", None), ("method", "F", None), ("method", "G", None)]),
        ("php", "<?php\n/** Doc. */\nabstract class A {\n  public static function f(array $a): int { return g($a); }\n}\nfunction h() { }", [("class", "A", "/** Doc. */"), ("method", "f", None), ("function", "h", None)]),
        ("ruby", "module M\n  # Doc.\n  def self.f(a = {}, *b)\n    a.each do |x|\n      y if x\n    end\n  end\n\n  # far\n\n  def g? = true\nend", [("impl", "M", None), ("method", "f", "# Doc."), ("method", "g?", None)]),
        ("python", "@wraps(a)\nasync def f(x,\n            y):\n    'Doc.'\n    def g():\n        pass\n\nclass A:\n    pass\n", [("function", "f", "'Doc.'"), ("function", "g", None), ("class", "A", None)]),
        ("python", "def f(x):\n    '''Doc.'''\n    return (x\n\ndef g():\n    pass", [("function", "f", "'''Doc.'''"), ("function", "g", None)]),
        ("javascript", "x = 1; // only this", []),
    ],
)
def test_trees(language, text, want):
    got = [(n.kind, n.name, text[n.doc[0] : n.doc[1]] if n.doc else None) for n, _ in walk(parse(text, language))]
    assert got == want


def test_ranges_are_exact():
    text = "// c\n\nfunc A() {\n\tif x {\n\t}\n}\n\nfunc B() { /* } */ }\n"
    nodes = [n for n, _ in walk(parse(text, "go"))]
    assert [text[n.start : n.stop] for n in nodes] == ["func A() {\n\tif x {\n\t}\n}", "func B() { /* } */ }"]
    indented = "    def f(self):\n        '''é'''\n        return 1"
    node = parse(indented, "python")[0]
    assert indented[node.start : node.stop] == indented.strip() and indented[node.doc[0] : node.doc[1]] == "'''é'''"


def test_calls_and_signatures(spark):
    code = "class A {\n  @Get(path = \"x\")\n  String f(int a,\n      int b) {\n    // skip()\n    util.run(a);\n    new Box(b);\n    print(\"call()\");\n    return f(a, b);\n  }\n}\n"
    unit = {r["name"]: r for r in extract.extract(spark.createDataFrame([("r", "A.java", code)], "repo string, file string, content string")).collect()}
    assert unit["f"]["signature"] == '@Get(path = "x") String f(int a, int b)'
    assert [tuple(c) for c in unit["f"]["calls"]] == [("Get", None, 2), ("run", "util", 6), ("Box", None, 7)] and unit["f"]["refs"] == ["Box", "Get", "run"]
    assert (unit["f"]["start_line"], unit["f"]["end_line"]) == (2, 10)


def test_assembled_files_keep_their_lines(spark):
    data = [(1, "r", "a.rs", 3, 5, "/// Doc", "fn a() {\n    b();\n}"), (2, "r", "a.rs", 8, 12, None, "impl S {\n    fn c() {\n        d();\n    }\n}"), (3, "r", "a.rs", 9, 11, None, "fn c() {\n        d();\n    }"), (4, "r", "a.rs", None, None, None, "x"), (5, "r", None, 1, 1, None, "x"), (6, "r", "b.py", 1, 1, None, None)]
    units = spark.createDataFrame(data, "unit_id long, repo string, file string, start_line int, end_line int, doc_comment string, full_text string")
    found = extract.extract(extract.assembled(units)).select("name", "start_line", "end_line", "doc_comment").collect()
    assert sorted(map(tuple, found)) == [("S", 8, 12, None), ("a", 3, 5, "/// Doc"), ("c", 9, 11, None)]
    assert extract.assembled(units.where("unit_id > 9")).count() == 0


@pytest.mark.parametrize(
    "rule,path,hit",
    [("*.log", "a/b.log", True), ("/gen", "gen/a.py", True), ("/gen", "x/gen/a.py", False), ("gen/", "x/gen/a.py", True), ("gen/", "x/gen", False), ("a/**/z.py", "a/b/c/z.py", True), ("a/**/z.py", "a/z.py", True), ("doc/*.txt", "doc/x/y.txt", False), ("# no", "# no", False), ("[ab].py", "b.py", True), ("[!ab].py", "b.py", False), ("out/**", "out/x/y", True)],
)
def test_ignore_rules(rule, path, hit):
    import re

    form = files.glob_regex(rule)
    assert bool(form and re.search(form, path)) == hit


def test_ignored_by_rules_of_folders(spark):
    paths = spark.createDataFrame([("r", p) for p in ("a.log", "src/a.log", "src/keep.log", "src/gen/x.py", "b.py")] + [("s", "a.log"), ("r", None)], "repo string, path string")
    rules = spark.createDataFrame([("r", "", 1, "*.log"), ("r", "src", 1, "gen/"), ("r", "src/", 2, "!keep.log"), ("r", "src", 3, None), ("r", "", 2, "# c")], "repo string, folder string, n int, pattern string")
    assert sorted((r["repo"], r["path"]) for r in files.ignored_by_rules(paths, rules).where("ignored").collect()) == [("r", "a.log"), ("r", "src/a.log"), ("r", "src/gen/x.py")]
    assert files.ignored_by_rules(paths, rules.where("n > 9")).where("ignored").count() == 0


def test_scan_statistics(spark):
    data = [("r", "a.py", b"x = 1"), ("r", "a.py", b"x = 1"), ("r", "node_modules/b.js", b"1"), ("r", "m.rs", b"GGUF12"), ("r", "n.rs", b"a\0b"), ("r", "o.png", None), ("r", "p.txt", b"x"), ("r", "q.py", b"\xff\xfe"), ("r", None, b"x"), ("r", "gen/z.py", b"1")]
    got = files.scan_statistics(spark.createDataFrame(data, "repo string, path string, content binary"), ["gen/"]).first()
    assert tuple(got) == ("r", 2, 3, 2, 1, 9, "gen/z.py,m.rs,n.rs,node_modules/b.js,o.png")
    assert files.outcomes(spark.createDataFrame([], "repo string, path string, content binary"), []).select(F.count("*")).first()[0] == 0
