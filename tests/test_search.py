from tagweave.operators import search as S
from tagweave.operators import tags as T


def test_parsers():
    assert S.parse_groups(["a|b", "!c", "-d|e", "", "!"]) == ([["a", "b"]], [["c"], ["d", "e"]])
    assert S.parse_keywords("Foo #Bar  baz #") == (["foo", "baz"], ["bar"])
    assert S.merge_groups([["a", "b"], ["c"], ["b", "c"]]) == [["a", "b", "c"]]
    assert S.merge_groups([["a"], ["b"]]) == [["a"], ["b"]]
    assert S.auto_query("", "  ", "x.py") == "x.py"


def test_grouped_search_rules(spark):
    edges = spark.createDataFrame([("s1", "json_parse"), ("s1", "dag"), ("s2", "dag_sort"), ("s2", "json"), ("s3", "JSON"), ("s3", "dag"), ("s3", "old")], "symbol_id string, tag string")
    got = {(r.symbol_id, r.match_count, r.score) for r in S.grouped_search(edges, [["json"], ["dag"]], [["old"]]).collect()}
    assert got == {("s1", 2, 2)}
    scores = spark.createDataFrame([("json_parse", 5)], "tag string, score long")
    assert S.grouped_search(edges, [["json"]], [], scores).filter("symbol_id = 's1'").first().score == 6


def test_alias_expansion_is_one_hop(spark):
    table = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "b")], "raw string, canonical string")
    assert S.expand_groups([["a"]], table) == [["a", "b", "x"]]
    assert S.normalized_groups(spark, [["HTTP Client", "get"]], "index") == [["http_client"]]


def test_keyword_weights(spark):
    rows = spark.createDataFrame([("m::net", "net", "a/net.c", "int net()", "net net", ["net"], ["network"], [])], "symbol_id string, module string, file_path string, signature string, brief string, base array<string>, semantic array<string>, custom array<string>")
    assert S.keyword_search(rows, "net").first().score == 2 + 3 + 1 + 1 + 4 + 1 + 4
    assert S.keyword_search(rows, "net", legacy_weights=True).first().score == 2 + 3 + 1 + 1 + 1 + 4
    assert S.keyword_search(rows, "#absent").isEmpty()
    assert S.keyword_search(rows, "zzz").isEmpty()
    assert "Available APIs" in S.api_prompt(S.keyword_search(rows, "net"), "x = 1").first().prompt


def test_markdown_keeps_zero_scores(spark):
    docs = spark.createDataFrame([("a.md", "# Net\nnet net"), ("b.md", "other"), ("c.md", None)], "path string, content string")
    got = {r.path: (r.title, r.score) for r in S.markdown_search(docs.na.fill(""), "net").collect()}
    assert got == {"a.md": ("Net", 3 + 3), "b.md": ("b.md", 0), "c.md": ("c.md", 0)}


def test_nearest_ties(spark):
    symbols = spark.createDataFrame([("f", "a", 1, 9, 0), ("f", "b", 5, None, 1), ("f", "n", None, None, 2)], "file_path string, symbol_id string, decl_line int, impl_line int, seq int")
    cursors = spark.createDataFrame([("f", 7), ("g", 1)], "file_path string, line int")
    assert [(r.symbol_id, r.distance) for r in S.nearest_symbols(cursors, symbols).collect()] == [("a", 2)]


def test_alias_chains_and_cycles(spark):
    table = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "e")], "raw string, canonical string")
    assert {r.raw for r in T.without_cycles(table).collect()} == {"d"}
    tags = spark.createDataFrame([("a",), ("d",), ("z",)], "tag string")
    assert {(r.tag, r.canonical) for r in T.resolve_aliases(tags, table).collect()} == {("a", "c"), ("d", "e"), ("z", "z")}


def test_clusters_keep_every_symbol(spark):
    rows = [(f"s{i}", "net", [], ["net"]) for i in range(3)] + [("p", "net", [], []), ("q", "net", [], ["rare"])]
    df = spark.createDataFrame(rows, "symbol_id string, hint string, base array<string>, semantic array<string>")
    got = {r.symbol_id: (r.cluster_id, r.kind) for r in T.clusters(df).collect()}
    assert got == {"s0": ("net", "tag"), "s1": ("net", "tag"), "s2": ("net", "tag"), "p": ("net", "path"), "q": ("net", "path")}


def test_edit_logs_fold_like_single_edits(spark):
    edges = spark.createDataFrame([("s", "a", "base", 0), ("s", "b", "semantic", 1)], "symbol_id string, tag string, tag_type string, pos int")
    log = spark.createDataFrame([(1, "s", "remove", "a", "base"), (2, "s", "add", " C ", "custom"), (3, "s", "add", "a", "base"), (4, "s", "remove", "b", "semantic")], "seq long, symbol_id string, op string, value string, tag_type string")
    after = T.folded_edits(edges, log)
    assert {(r.tag, r.tag_type) for r in after.collect()} == {("a", "base"), ("c", "custom")}
    index = T.folded_index(edges, after, T.index_scores(T.index_counts(edges), spark.createDataFrame([("semantic", "b", 4)], "tag_type string, tag string, score long")))
    assert {(r.tag_type, r.tag, r["count"], r.score) for r in index.collect()} == {("base", "a", 1, 0), ("custom", "c", 1, 0), ("semantic", "b", 0, 4)}
