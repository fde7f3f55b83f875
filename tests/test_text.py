"""Golden rows and a plain model of the text functions."""

import re

import pytest
from pyspark.sql import functions as F

from tagweave.functions import text as X
from tagweave.functions.vocabulary import HARD_ALIASES, STOP_WORDS


def values(spark, fn, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def model(tag):
    t = tag.strip().lower()
    if len(t) < 2:
        return None
    u = re.sub(r"^_|_$", "", re.sub("_+", "_", re.sub(r"[\s\-.]+", "_", t)))
    cjk = "一-鿿"
    for a, b in ((cjk, cjk), ("a-z0-9", cjk), (cjk, "a-z0-9")):
        u = re.sub(f"([{a}])_+([{b}])", r"\1\2", u)
    u = re.sub(f"[^a-z0-9_{cjk}]", "", u)
    if len(u) < 2 or u in STOP_WORDS or u == "constructor":
        return None
    return HARD_ALIASES.get(u, u)


GOLDEN = {
    "  HTTP-Client.v2 ": "http_client_v2", "Get": None, "str": "string", "string": None, "db": "database", "数据_库": "database", "json 解析": "json解析", "解析 json_x": "解析json_x",
    "var": None, "func": "function", "a": None, "C++": None, "constructor": None, "src::name": "srcname", "环检测": "环检测", "__init__": None, "REST": "rest_api", "缓 存 策略": "缓存_策略",
}


def test_index_tag(spark):
    assert values(spark, X.index_tag, GOLDEN) == list(GOLDEN.values())
    assert [model(t) for t in GOLDEN] == list(GOLDEN.values())


def test_index_tag_model(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet="aB9_-. 数据库x:é", max_size=8), min_size=40, max_size=40))
    def check(tags):
        assert values(spark, X.index_tag, tags) == [model(t) for t in tags]

    check()


def test_tag_lists(spark):
    df = spark.sql("select array('Str', 'get', 'DB', 'database', '') t")
    assert df.select(X.index_tags(F.col("t"))).first()[0] == ["string", "database"]
    assert df.select(X.unified_tags(F.col("t"), F.lit(None).cast("array<string>"), F.array(F.lit(" db ")))).first()[0] == ["str", "get", "db", "database"]


def test_split_and_signatures(spark):
    assert values(spark, X.split_camel, ["RectItem", "addLine", "HTTPServer", "parse_json-file", "a1B2", ""]) == [["Rect", "Item"], ["add", "Line"], ["HTTPServer"], ["parse", "json", "file"], ["a1", "B2"], []]
    assert values(spark, X.normalize_signature, ["int  add( int a , int b )", "def f(a, b) -> int", "class Foo : public Bar", "std::vector<int> * p"]) == ["int add(int a,int b)", "def f(a,b)->int", "class Foo:public Bar", "std::vector<int>*p"]


def test_tag_matches(spark):
    cases = [("dag", "dag_sort", False), ("dag", "dag", True), ("json", "json_parse", True), ("json_parse", "json", True), ("cache", "caching", False), ("", "x", False)]
    got = spark.createDataFrame(cases, "q string, t string, w boolean").select(X.tag_matches(F.col("q"), F.col("t")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)


def test_trivial_bodies(spark):
    bodies = ["{}", "{ return; }", "{ return nullptr; }", "{ return m_x; }", "{ return x; }", "{ return f(x); }", "", None, "{ a(); }"]
    assert values(spark, X.trivial_brief, bodies) == [X.NOTHING] * 3 + [X.MEMBER, X.SIMPLE, None, None, None, None]


def test_hints(spark):
    assert values(spark, X.module_hint, ["a.py", "src/lib/x.py", "a/b/c/x.py", "app/net/x.go"]) == [".", "x", "b/c", "net"]
    assert values(spark, X.module_hint_cpp, ["src/geo/a.cpp", "x/src/net.cpp", "lib/a.cpp"]) == ["geo", "net", "lib"]
    assert values(spark, X.slugify, ["Net Work!", "数据", ""]) == ["net_work", "", ""]
    assert values(spark, X.title_from_id, ["net", ""]) == ["Net", "Core"]


def test_model_answers(spark):
    answers = ['x {"groups": {"a": ["b", "b", " c "], "e": []}} y', '{"mappings": {"p": "q", "r": "q"}}', '{"k": ["v"]}', "none", '{"groups": {}}']
    got = values(spark, X.aggregation_groups, answers)
    assert got[0] == {"a": ["b", "c"]} and sorted(got[1]["q"]) == ["p", "r"] and got[2] == {"k": ["v"]} and got[3] is None and got[4] is None
    assert values(spark, X.model_tags, ["A, b c；D", "数据_库", "one two", "x", ""]) == [["a", "b", "c", "d"], ["数据", "库"], ["one", "two"], ["x"], []]


@pytest.mark.parametrize("n", [10, 250])
def test_truncated(spark, n):
    code = "\n".join(f"line {i}" for i in range(n))
    got = values(spark, X.truncated, [code])[0]
    assert got == code if n == 10 else got.split("\n").count(X.TRUNCATED) == 2 and len(got.split("\n")) == 200
