"""Joins by pieces, search by postings and the as-of join, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tagweave.operators import postings, search, substring

LETTERS = "abcé中😀"


def matches(q, t):
    if not q or not t:
        return False
    return q == t if min(len(q), len(t)) <= 3 else q in t or t in q


@pytest.fixture(scope="module")
def words():
    rng = random.Random(21)
    tags = sorted({"".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 9))) for _ in range(150)})
    terms = sorted({*rng.sample(tags, 20), *(t[1:] for t in tags[:40]), *(t[:-1] for t in tags[40:80]), *(a + b for a, b in zip(tags, tags[60:], strict=False)), ""})
    return terms, tags


def test_tag_pairs_equal_the_nested_loop(spark, words):
    terms, tags = words
    pairs = substring.tag_pairs(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(t,) for t in tags], "tag string"))
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == {(q, t) for q in terms for t in tags if matches(q, t)}
    plan = pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_many_queries_equal_one_by_one(spark, words):
    terms, tags = words
    rng = random.Random(22)
    edges = [(f"s{i}", t) for i in range(40) for t in rng.sample(tags, 4)]
    queries = [(q, g, rng.choice(terms), False) for q in range(60) for g in range(rng.randint(1, 2)) for _ in range(2)]
    queries += [(q, 7, rng.choice(tags), True) for q in range(0, 60, 5)] + [(99, 0, tags[3], True)]
    scores = {t: len(t) for t in tags[::3]}
    frame = spark.createDataFrame(edges, "symbol_id string, tag string")
    got = {(r.query_id, r.symbol_id): (r.match_count, r.score) for r in substring.grouped_search_many(frame, spark.createDataFrame(queries, "query_id int, grp int, term string, negative boolean"), spark.createDataFrame(list(scores.items()), "tag string, score int")).collect()}
    want, by_symbol = {}, {}
    for s, t in edges:
        by_symbol.setdefault(s, set()).add(t)
    for q in {x[0] for x in queries}:
        groups = {}
        for _, g, term, negative in (x for x in queries if x[0] == q):
            groups.setdefault((negative, g), set()).add(term)
        for s, own in by_symbol.items():
            hit = {g: {t for t in own for term in terms_ if matches(term, t)} for (negative, g), terms_ in groups.items() if not negative}
            bad = any(matches(term, t) for (negative, _), terms_ in groups.items() if negative for term in terms_ for t in own)
            if hit and all(hit.values()) and not bad:
                met = set.union(*hit.values())
                want[q, s] = (len(hit), sum(1 + scores.get(t, 0) for t in met))
    assert got == want


def test_many_queries_deal_out_met_tags_only(spark):
    edges = spark.createDataFrame([("a", "Cache"), ("a", "cache"), ("a", "cache"), ("b", "other")], "symbol_id string, tag string")
    found = substring.grouped_search_many(edges, spark.createDataFrame([(1, 0, "cache", False)], "query_id int, grp int, term string, negative boolean"))
    assert [tuple(r) for r in found.collect()] == [(1, "a", 1, 1)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_suggestions_of_many(spark, words):
    terms, tags = words
    counts = {t: 1 + len(t) % 4 for t in tags}
    rows = substring.suggestions_many(spark.createDataFrame(list(counts.items()), "tag string, count long"), spark.createDataFrame([(t,) for t in terms], "query string"), 3).collect()
    got = {q: [r.tag for r in sorted(rows, key=lambda r: r["rank"]) if r["query"] == q] for q in {r["query"] for r in rows}}
    want = {q: sorted((t for t in tags if q in t), key=lambda t: (-counts[t], t.encode()))[:3] for q in terms if q}
    assert got == {q: w for q, w in want.items() if w}


SYMBOLS = "symbol_id string, module string, file_path string, signature string, brief string, base array<string>, semantic array<string>, custom array<string>"


def test_search_by_postings_equals_the_scan(spark, tmp_path):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 7)))
    rows = [(f"m::{word()}{i}", word(), f"src/{word()}.c", f"int {word()}({word()})", " ".join(word() for _ in range(rng.randint(0, 9))), [word() for _ in range(2)], [word()], []) for i in range(120)] + [("x", None, None, None, None, None, ["ab"], None)]
    symbols = spark.createDataFrame(rows, SYMBOLS)
    path = str(tmp_path / "index")
    postings.write_postings(symbols, "symbol_id", postings.symbol_fields(symbols), path)
    tag = rows[5][6][0]
    for query in ("abc", "ab", "a", "src int", f"bcd #{tag}", f"#{tag}", "zzz", "dcb ca abcd"):
        want = sorted((r.symbol_id, r.score) for r in search.keyword_search(symbols, query).collect())
        assert sorted((r.symbol_id, r.score) for r in postings.keyword_indexed(symbols, path, query).collect()) == want, query
        top = [(r.symbol_id, r.score) for r in search.top(search.keyword_search(symbols, query), 5, "symbol_id").collect()]
        assert [(r.symbol_id, r.score) for r in postings.top_indexed(symbols, path, query, 5, "symbol_id").collect()] == top, query
    # a query reads the folders of its grams only
    files = postings.holders(spark, path, "abcd", "symbol_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in files and "folder" in files.split("PartitionFilters: [")[1][:60]


def test_markdown_by_postings(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "# Cache tools\ncache, Cache"), ("b.md", "nothing"), ("cache.md", "x"), ("d.md", "")], "path string, content string")
    path = str(tmp_path / "index")
    postings.write_postings(docs, "path", {"content": F.col("content"), "path": F.col("path")}, path)
    for query in ("cache", "CA", "q", "nothing"):
        want = sorted(tuple(r) for r in search.markdown_search(docs, query, min_score=1).collect())
        assert sorted(tuple(r) for r in postings.markdown_indexed(docs, path, query).collect()) == want


def test_nearest_symbols_of_many_cursors_in_one_file(spark):
    rng = random.Random(24)
    symbols = [("big", rng.randint(1, 300_000) if i % 5 else None, rng.randint(1, 300_000) if i % 3 else None, i, f"s{i}") for i in range(400)] + [("small", 7, 7, 0, "one"), ("small", 7, None, 1, "two"), ("none", None, None, 2, "x")]
    frame = spark.createDataFrame(symbols, "file_path string, decl_line int, impl_line int, seq int, symbol_id string")
    cursors = spark.range(100_000).select(F.lit("big").alias("file_path"), (F.col("id") * 3 + 1).cast("int").alias("line")).unionByName(spark.createDataFrame([("small", 1), ("small", 7), ("small", 50_000), ("none", 3), ("gone", 1)], "file_path string, line int"))
    found = search.nearest_symbols(cursors, frame)
    got = {(r.file_path, r.line): (r.distance, r.symbol_id) for r in found.collect()}
    assert len(got) == 100_003 and got["small", 1] == (6, "one") and got["small", 50_000] == (49_993, "one")
    spots = [(x, seq, s) for f, d, i, seq, s in symbols if f == "big" for x in (d, i) if x is not None]
    for line in rng.sample(range(1, 300_000, 3), 200):
        d, _, s = min((abs(x - line), seq, s) for x, seq, s in spots)
        assert got["big", line] == (d, s)
    assert not [j for j in found._jdf.queryExecution().toString().split("\n") if "Join" in j and "block" not in j]


def test_a_gram_is_a_row_for_each_block_and_not_for_each_document(spark):
    texts = ["cache line", "Cache", "ab", "a", "", None, "x\U0001f600yz\U0001f600", "缓存ab"] * 50
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "path string, content string").coalesce(1)
    rows = postings.postings(docs, "path", {"content": F.col("content")}).collect()
    idents = {r.block: r.idents for r in rows if r.gram is None}
    got = {(idents[r.block][i], r.gram) for r in rows if r.gram is not None for i in r.places}
    pieces = lambda t: {t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else {t} - {""}
    assert got == {(f"d{i}", g) for i, t in enumerate(texts) for g in pieces((t or "").lower())}
    assert len([r for r in rows if r.gram == "cac"]) == len(idents) == 1
