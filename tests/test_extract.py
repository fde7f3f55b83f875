import time

from pyspark.sql import functions as F

from tagweave.extract import bodies
from tagweave.extract import registry as R
from tagweave.plans.corpus import SNIPPETS


def found(lang):
    path, code = SNIPPETS[lang]
    return list(R.extractor_of(lang)(code, path))


def test_cpp_golden_snippet():
    code = "int add(int a, int b) {\n  return a + b;\n}\n\nclass Calculator {\npublic:\n  int multiply(int x, int y) {\n    return x * y;\n  }\n};\n"
    got = [(r[0], r[1], r[3], r[4]) for r in R.extractor_of("cpp")(code, "x.cpp")]
    assert got == [("add", "function", None, 1), ("Calculator", "class", 5, None), ("multiply", "function", None, 7)]


def test_cpp_members_headers_and_noise():
    code = '#define X {\n// int no();\nnamespace a { struct S : T { void f(int) const; static int g(); private: ~S(); }; }\nconst char* name() { return "{"; }\nint S::h() noexcept { if (x) { y(); } else if (z) {} return 0; }\n'
    got = [(r[0], r[2]) for r in R.extractor_of("cpp")(code, "x.cpp")]
    assert [g[0] for g in got] == ["S", "S::f", "S::g", "S::~S", "name", "S::h"]
    assert dict(got)["S::f"].split() == "void S::f(int) const".split()
    assert [r[3] for r in R.extractor_of("cpp")("int f() {}", "x.h")] == [1]


def test_python_lines_count_before_leading_blank_lines():
    got = [(r[0], r[3]) for r in found("python")]
    assert got[:2] == [("A", 1), ("A.top", 3)]
    assert "@cached" in found("python")[2][2]


def test_every_language_finds_its_symbols():
    ids = {lang: [r[0] for r in found(lang)] for lang in SNIPPETS}
    assert ids["java"] == ["demo.net.HttpClient", "demo.net.HttpClient.open"]
    assert ids["go"] == ["srv.Server", "srv.Server.Serve"]
    assert ids["ruby"] == ["User", "User::find", "User::name"]
    assert ids["php"] == ["App\\Data\\Repo", "count"]
    assert ids["js"] == ["TagStore", "loadTags", "pick"]
    assert found("go")[1][2] == "func (s *Server) Serve(addr string) error"
    assert list(R.extractor_of("js")("<script>export default { }</script>", "a/Box.vue")) == [("Box", "class", "Vue Component: Box", 1, None)]


def test_rust_csharp_and_bash_golden_rows():
    assert [r[:4] for r in found("rust")] == [("Reader", "class", "pub struct Reader", 1), ("Kind", "class", "enum Kind", 2), ("read_all", "function", "pub async fn read_all<T>(r: T) -> usize", 3)]
    assert [r[:4] for r in found("csharp")] == [("Acme.Core.Job", "class", "public class Job : IJob", 2), ("Run", "function", "public async Task Run(int n)", 3)]
    assert [r[:4] for r in found("bash")] == [("push_all", "function", "function push_all()", 2), ("clean", "function", "clean()", 5)]


def test_white_space_of_patterns_is_that_of_the_source_language():
    got = [r[0] for r in R.extractor_of("rust")("pub\u00a0struct\u3000Wide;\n", "x.rs")]
    assert got == ["Wide"]


def test_guards_and_registry():
    assert list(R.extractor_of("cpp")("int f() {}\0", "x.cpp")) == []
    assert [r[0] for r in R.extractor_of("python")("def f():\n  pass\0", "x.py")] == ["f"]
    assert R.language_of("a/b.HPP") == "cpp" and R.language_of("x.unknown") is None
    R.register("toy", ("toy",), lambda code, path: iter([("x", "function", "x", 1, None)]))
    assert R.language_of("a.toy") == "toy" and list(R.extractor_of("toy")("", ""))[0][0] == "x"
    R.EXTRACTORS.pop("toy")
    R.EXTENSIONS.pop("toy")


def test_bodies():
    code = SNIPPETS["cpp"][1]
    assert bodies.implementation("cpp", code, "void Calculator::reset()const") == "void Calculator::reset() const { if (ok) { run(); } }"
    assert bodies.implementation("java", SNIPPETS["java"][1], "public int open(String url)") == "{\n        return 1;\n    }"
    assert bodies.implementation("go", SNIPPETS["go"][1], "func(s*Server)Serve(addr string)error").startswith("{")
    assert bodies.implementation("python", SNIPPETS["python"][1], "def top()") == "pass"
    assert bodies.implementation("ruby", "class A\n  def go\n    run\n  end\nend", "def go()") == "run"
    assert bodies.implementation("bash", SNIPPETS["bash"][1], "clean()") == "rm -r x"
    assert bodies.implementation("bash", "f() { unclosed", "f()") == " unclosed"
    assert bodies.implementation("js", "x", "function no()") is None


def test_udtf(spark):
    R.register_functions(spark)
    spark.createDataFrame([("x.py", "python", "def f():\n  pass\n")], "p string, l string, c string").createOrReplaceTempView("src")
    assert spark.sql("select s.raw_id, s.decl_line from src, lateral extract_symbols(l, p, c) s").collect() == [("f", 1)]


def test_size_guard_holds_for_cpp_only(spark):
    pad = "# pad pad pad pad pad pad pad pad pad\n" * 60_000
    code = {"python": f"{pad}class A:\n    @cached\n    def f(self):\n        pass\n", "js": "function f() {}\n" + "// pad pad pad pad\n" * 150_000, "cpp": "int f() {}\n" + "// pad pad pad pad\n" * 150_000}
    files = spark.createDataFrame([(f"a.{x}", x, c) for x, c in code.items()], "rel_path string, lang string, content string")
    rows = R.extract(files)
    assert "content" not in rows.columns and "snippet" in rows.columns
    got = {(r.lang, r.raw_id, r.decl_line) for r in rows.collect()}
    assert got == {("python", "A", 60_001), ("python", "A.f", 60_003), ("js", "f", 1)}


def test_bodies_belong_to_their_own_declaration():
    code = "class A:\n    def __init__(self):\n        self.a = 1\n\n\n\n\n\nclass B:\n    # note\n    def __init__(self):\n        self.b = 2\n# end\n\nx = 1\n"
    assert [r[-1] for r in R.with_snippets("python", code, "x.py") if r[1] == "function"] == ["self.a = 1", "self.b = 2\n# end"]
    code = "struct A { void f(); };\nint g(int);\nvoid A::f() { one(); }\nnamespace n { int g(int x) { return '}'; } }\nint g(char) { return 2; }\n"
    got = [(r[0], r[-1]) for r in R.with_snippets("cpp", code, "x.cpp")]
    assert got == [
        ("A", None), ("A::f", "void A::f() { one(); }"), ("g", "namespace n { int g(int x) { return '}'; }"), ("A::f", "void A::f() { one(); }"), ("g", "namespace n { int g(int x) { return '}'; }"), ("g", "int g(char) { return 2; }"),
    ]
    assert [r[-1] for r in R.with_snippets("rust", "struct A;\nfn f() { 1 }\n", "x.rs")] == [None, "{ 1 }"]
    assert [r[-1] for r in R.with_snippets("js", "const f = (a) => { return 1; };\nconst g = (a) => a;\nfunction h() {", "x.js")] == ["{", "{ return 1; }", None]
    assert [r[-1] for r in R.with_snippets("ruby", "def a\n  1\nend\n\n  def b\n    if x\n    end\n  end\n", "x.rb")] == ["1", "if x\n    end"]
    assert [r[-1] for r in R.with_snippets("bash", "f() {\n a; }\nfunction g() {\n b\n", "x.sh")] == ["a;", "\n b\n"]


def test_owners_by_the_plain_pattern():
    """The first type whose brace is still open, or the last one indented less, against a search of the whole prefix."""
    import random
    import re

    from tagweave.extract import patterns

    rng = random.Random(11)
    plain = re.compile(patterns.white(r"(?:class|interface)\s+(\w+)[^{]*\{[^}]*$"), re.A)
    for _ in range(300):
        code = "".join(rng.choice(["class A%d " % rng.randint(0, 9), "interface B ", "{", "}", "\n", " x;"]) for _ in range(rng.randint(1, 25)))
        for at in range(0, len(code) + 1, 3):
            found = plain.search(code[:at])
            assert patterns._java_owner(code, at) == (found[1] if found else ""), (code, at)
        lines = "".join(" " * rng.randint(0, 4) + rng.choice(["class A%d:\n" % rng.randint(0, 9), "pass\n"]) for _ in range(12))
        types = [(m.end(), len(m[1]), m[2]) for m in patterns._ENCLOSING["python"].finditer(lines)]
        for at in range(0, len(lines), 5):
            for width in range(5):
                assert patterns.enclosing("python", lines, at, " " * width) == next((n for e, s, n in reversed(types) if e <= at and s < width), "")


def test_extraction_time_grows_with_the_file():
    import time

    made = {
        "x.cpp": "".join(f"int fn{i}(int a) {{\n  if (a) {{ return {i}; }}\n  return a;\n}}\n" for i in range(4000)),
        "x.py": "".join(f"class C{i}:\n    def f{i}(self):\n        return {i}\n" for i in range(4000)),
        "x.java": "".join(f"class C{i} {{\n  public int f{i}(int a) {{\n    return a;\n  }}\n}}\n" for i in range(4000)),
    }
    for path, code in made.items():
        began = time.process_time()
        assert len(list(R.with_snippets(R.language_of(path), code, path))) >= 4000
        assert time.process_time() - began < 2  # by searching the file for each symbol: 6 to 13 seconds


def test_many_small_files_share_batches_and_keep_their_columns(spark):
    """A file costs what its parsing costs (a frame for each file took 6 ms), and other columns pass as they are."""
    big = (1 << 53) + 1  # is rounded in a column of floats, which nulls make of integers
    name = F.col("id").cast("string")
    text = F.concat(F.lit("package gen;\nclass P"), name, F.lit(" {\n}\n"))
    files = spark.range(0, 6000, 1, 1).select(F.concat(name, F.lit(".java")).alias("rel_path"), F.lit("java").alias("lang"), text.alias("content"), F.when(F.col("id") % 2 == 0, F.col("id") + big).alias("n"))
    began = time.monotonic()
    rows = R.extract(files).collect()
    assert time.monotonic() - began < 20
    assert sorted((r.rel_path, r.raw_id, r.n) for r in rows) == sorted((f"{i}.java", f"gen.P{i}", i + big if i % 2 == 0 else None) for i in range(6000))


def test_symbols_of_one_file_come_in_several_batches(spark):
    line = "    x = 1  # " + "y" * 100_000
    code = "".join(f"def f{i}():\n{line}\n" for i in range(50))
    files = spark.createDataFrame([("a.py", "python", code), ("b.py", "python", None), ("c.py", "python", "x = 1\n"), ("d.py", "python", "def g():\n    pass\n")], "rel_path string, lang string, content string").coalesce(1)
    rows = [(r.rel_path, r.raw_id, r.pos, r.snippet) for r in R.extract(files).collect()]
    assert rows == [*(("a.py", f"f{i}", i, line.strip()) for i in range(50)), ("d.py", "g", 0, "pass")]
