"""Build and update jobs over a small tree."""

import json

import pytest
from pyspark.sql import functions as F

from tagweave.plans import index as I
from tagweave.plans.config import BuildConfig
from tagweave.plans.corpus import SNIPPETS
from tagweave.sources import files, ignore, markdown, routing
from tagweave.sources.store import Store
from tagweave.streaming import updates


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, code in (SNIPPETS[lang] for lang in ("cpp", "python", "bash")):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(code)
    (root / "pkg" / "__init__.py").write_text("def boot():\n    return x\n")
    (root / "skip").mkdir()
    (root / "skip" / "no.py").write_text("def no(): pass\n")
    (root / ".gitignore").write_text("skip/\n# note\n")
    return root


def test_listing(tree):
    paths = files.list_files(str(tree))
    assert "pkg/__init__.py" in paths and not any(p.startswith("skip") for p in paths)
    assert files.scanner(["cpp"])(str(tree)) == ["src/geo/calc.cpp"]
    assert ignore.is_ignored("a/node_modules/x.js", ()) and not ignore.is_ignored("keep.log", ("*.log", "!keep.log"))


def test_build_update_and_reuse(spark, tree, tmp_path):
    out, asked = str(tmp_path / "index"), str(tmp_path / "asked")

    def client(module, signature, snippet):
        with open(asked, "a") as f:
            f.write(signature + "\n")
        return 'Here: {"brief": "does it", "tags": ["Json", "parsing"]}'

    config = BuildConfig(export_json=True)
    I.build(spark, str(tree), out, client, lambda prompt: '{"groups": {"parser": ["parsing"]}}', config)
    first = routing.load_tables(spark, f"{out}/tables")
    ids = {r.symbol_id: r for r in first.symbols.collect()}
    assert any(i.endswith("::A.top") for i in ids)
    assert any(i.endswith("Calculator::reset") for i in ids)
    assert {r.tag for r in first.edges.filter("tag_type = 'semantic'").collect()} >= {"json", "parser"}
    assert {(r.raw, r.canonical) for r in first.aliases.collect()} == {("parsing", "parser")}
    calls = open(asked).read().count("\n")
    assert calls > 0
    assert I.update(spark, str(tree), out, client, config=config) is False

    doc = json.load(open(f"{out}/routing.json"))
    assert doc["schemaVersion"] == 4 and set(doc["symbols"]) == set(ids)
    again = routing.load_routing(spark, f"{out}/routing.json")
    assert again.symbols.count() == len(ids)
    assert {(r.tag_type, r.tag, r["count"]) for r in again.tag_index.collect()} == {(r.tag_type, r.tag, r["count"]) for r in first.tag_index.collect()}

    run = tree / "pkg/tools/run.py"
    run.write_text(run.read_text().replace("pass", "go(1)"))
    (tree / "bin/deploy.sh").unlink()
    open(asked, "w").close()
    assert I.update(spark, str(tree), out, client) is True
    assert not (tmp_path / "index" / "routing.json").exists()
    assert open(asked).read().splitlines() == ["def top()"]
    left = routing.load_tables(spark, f"{out}/tables").symbols
    assert left.filter("file_path like '%.sh'").isEmpty() and left.count() == len(ids) - 2


def rows_of(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_untouched_symbols_are_not_worked_on_again(spark, tmp_path):
    root, out = tmp_path / "tree", str(tmp_path / "index")
    root.mkdir()
    (root / "a.py").write_text("def one():\n    return 1\n")
    (root / "b.py").write_text("def two():\n    return 2\n")
    I.build(spark, str(root), out)
    # what a snapshot holds of an unchanged file is what the next one has, so that file's symbols weren't made again
    store = Store(spark, out)
    now = store.snapshot()
    draft = store.next(now, now.version)
    draft.put("symbols", store.read(now, "symbols").withColumn("signature", F.replace("signature", F.lit("one"), F.lit("uno"))))
    draft.commit()
    (root / "b.py").write_text("def two():\n    return 3\n")
    assert I.update(spark, str(root), out) is True
    assert {r.signature for r in routing.load_tables(spark, out).symbols.collect()} == {"def uno()", "def two()"}


def test_update_equals_a_full_build_and_keeps_files(spark, tmp_path):
    root, out = tmp_path / "tree", str(tmp_path / "index")
    root.mkdir()
    words = ["cache", "parse", "render", "socket", "matrix", "index", "token", "query"]
    for i in range(24):
        (root / f"m{i:02}").mkdir()
        (root / f"m{i:02}" / f"{words[i % 8]}_{i}.py").write_text("".join(f"def {w}_{words[(i + k) % 8]}_{i}(a):\n    return a + {k}\n" for k, w in enumerate(words[:5])))
    (root / "m00" / "twin.h").write_text("int shared(int a);\n")
    (root / "m00" / "twin.cpp").write_text("int shared(int a) { return a * 2 + a; }\n")
    I.build(spark, str(root), out)
    store = Store(spark, out)
    steps = [
        lambda: (root / "m05" / "index_5.py").write_text("def cache_index_5(a):\n    return a + 100\ndef brand_new_symbol():\n    return 1\n"),
        lambda: (root / "m00" / "twin.cpp").unlink(),  # the declaration takes its place
        lambda: (root / "m03" / "added_file.py").write_text("def added_symbol():\n    return 5\n"),
    ]
    for k, step in enumerate(steps):
        before = store.snapshot()
        step()
        assert I.update(spark, str(root), out) is True
        after = store.snapshot()
        fresh = str(tmp_path / f"fresh{k}")
        I.build(spark, str(root), fresh)
        one, other = routing.load_tables(spark, out), routing.load_tables(spark, fresh)
        for name in ("symbols", "edges", "tag_index", "aliases", "categories"):
            assert rows_of(getattr(one, name)) == rows_of(getattr(other, name)), (k, name)
        for name in ("extracted", "edges", "meta"):
            kept = sum(after.parts[name].get(b) == p for b, p in before.parts[name].items())
            assert kept >= len(before.parts[name]) - 6, (k, name)
        assert rows_of(store.read(after, "extracted")) == rows_of(Store(spark, fresh).read(Store(spark, fresh).snapshot(), "extracted"))


def test_logs_are_folded_once(spark, tmp_path):
    root, out, log, uses = tmp_path / "tree", str(tmp_path / "index"), str(tmp_path / "log"), str(tmp_path / "uses")
    root.mkdir()
    (root / "cache.py").write_text("def load_cache():\n    return 1\n")
    I.build(spark, str(root), out)
    symbol = routing.load_tables(spark, f"{out}/tables").symbols.first().symbol_id
    edits = "symbol_id string, op string, value string, tag_type string, seq long"
    I.append_log(spark.createDataFrame([(symbol, "add", "mine", "custom", 1)], edits), log)
    I.append_log(spark.createDataFrame([(symbol, "brief", "new words", None, 2), (symbol, "add", "gone", "custom", 3), (symbol, "remove", "gone", "custom", 4)], edits), log)
    I.append_log(spark.createDataFrame([("mine",), ("mine",)], "tag string"), uses)
    before = routing.load_tables(spark, out).edges.count()
    I.apply_logs(spark, out, log, spark.read.parquet(uses))
    now = routing.load_tables(spark, out)
    assert now.symbols.first().brief == "new words" and now.edges.count() == before + 1
    assert [(r["count"], r.score) for r in now.tag_index.filter("tag = 'mine'").collect()] == [(1, 2)]
    assert now.tag_index.filter("tag = 'gone'").isEmpty()
    number = Store(spark, out).snapshot().number
    I.apply_logs(spark, out, log, uses)  # the same files
    assert Store(spark, out).snapshot().number == number
    I.append_log(spark.createDataFrame([("mine",)], "tag string"), uses)
    I.apply_logs(spark, out, log, uses)
    I.apply_logs(spark, out, spark.read.parquet(log), spark.read.parquet(uses))
    assert routing.load_tables(spark, out).tag_index.filter("tag = 'mine'").first().score == 3
    (root / "cache.py").write_text("def load_cache():\n    return 2\n")
    I.update(spark, str(root), out)
    I.apply_logs(spark, out, log, uses)  # updates keep the names of folded files
    assert routing.load_tables(spark, out).tag_index.filter("tag = 'mine'").first().score == 3
    with pytest.raises(Exception):
        I.apply_logs(spark, out, usage=spark.createDataFrame([("mine",)], "tag string"))


def test_a_failed_publish_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root, out, uses = tmp_path / "tree", str(tmp_path / "index"), str(tmp_path / "uses")
    root.mkdir()
    (root / "cache.py").write_text("def load_cache():\n    return 1\n")
    I.build(spark, str(root), out)
    before = rows_of(routing.load_tables(spark, out).tag_index)
    I.append_log(spark.createDataFrame([("cache",)], "tag string"), uses)
    from tagweave.sources import store

    commit = store.Draft.commit
    monkeypatch.setattr(store.Draft, "commit", lambda self, folded=None: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        I.apply_logs(spark, out, usage=uses)
    assert rows_of(routing.load_tables(spark, out).tag_index) == before
    monkeypatch.setattr(store.Draft, "commit", commit)
    I.apply_logs(spark, out, usage=uses)  # nothing of the log is lost
    assert routing.load_tables(spark, out).tag_index.filter("tag = 'cache' and score = 1").count() == 1
    one, other = (Store(spark, out).next(Store(spark, out).snapshot(), 9) for _ in range(2))
    one.commit()
    with pytest.raises(Exception):
        other.commit()
    assert len(Store(spark, out).numbers()) == store.KEEP


def test_old_documents_are_migrated(spark, tmp_path):
    path = str(tmp_path / "old.json")
    symbol = {"module": "m", "declHash": "h", "tagsBase": ["a"], "tagsSemantic": ["b"], "signature": "int f()"}
    json.dump({"tagIndex": {"b": {"count": 9, "score": 7}}, "symbols": {"m::f": symbol}}, open(path, "w"))
    index = routing.load_routing(spark, path)
    assert {(r.tag_type, r.tag, r["count"], r.score) for r in index.tag_index.collect()} == {("base", "a", 1, 0), ("semantic", "b", 1, 7)}
    json.dump({"schemaVersion": 9}, open(path, "w"))
    with pytest.raises(ValueError):
        routing.load_routing(spark, path)
    assert routing.load_routing(spark, str(tmp_path / "none.json")).symbols.isEmpty()
    assert routing.load_meta(spark, str(tmp_path / "none")).isEmpty()


def test_markdown_round_trip(spark):
    rows = spark.createDataFrame([("net", "net::f", "function", "int f()", "ab1", "cd2", "n.c", ["x"], ["y", "z"], "does f"), ("net", "net::C", "class", "class C", "ab3", None, None, [], [], "")], "module string, symbol_id string, kind string, signature string, decl_hash string, impl_hash string, file_path string, base array<string>, semantic array<string>, brief string")
    docs = markdown.render_modules(rows).withColumnRenamed("module", "path")
    got = {r.id: r for r in markdown.parse_entries(docs).collect()}
    assert (got["net::f"].section, got["net::f"].signature, got["net::f"].impl, got["net::f"].tags_sem, got["net::f"].brief) == ("Functions", "int f()", "cd2", ["y", "z"], "does f")
    assert got["net::C"].section == "Classes" and got["net::C"].file is None
    assert markdown.skill_docs(spark.createDataFrame([("a/b.cpp",)], "rel_path string")).first().doc_path == "domains/a/b_api.md"


def test_usage_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "log")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "seq long, tag string").write.parquet(folder)
    query = updates.running_scores(updates.usage_stream(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("scores").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.tag, r.score) for r in spark.table("scores").collect()} == {("a", 2), ("b", 1)}


def test_calls_in_flight_are_bounded_and_in_order(spark):
    import threading
    import time

    from tagweave.plans import client
    from tagweave.plans.config import EnrichConfig
    from tagweave.plans.enrich import with_briefs

    now, most, lock, tries = [0], [0], threading.Lock(), {}

    def call(i):
        def run():
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
                tries[i] = tries.get(i, 0) + 1
            time.sleep(0.002 * (7 - i % 7))
            with lock:
                now[0] -= 1
            if i % 10 == 3 and tries[i] < 2 or i == 25:
                raise OSError("busy")
            return str(i)

        return run

    got = list(client.in_flight(map(call, range(40)), 3, retries=1, pause=0.001))
    assert got == [None if i == 25 else str(i) for i in range(40)] and 1 < most[0] <= 3 and tries[3] == 2 and tries[25] == 2
    assert list(client.in_flight([], 3)) == []
    tasks = spark.createDataFrame([("m", f"f{i}(x)", "a = 1; b(a); c(b);") for i in range(30)], "module string, signature string, snippet string").coalesce(1)
    rows = with_briefs(tasks, lambda m, s, b: '{"brief": "is %s", "tags": ["x"]}' % s if "7" not in s else 1 / 0, EnrichConfig(retries=0, concurrency=5)).collect()
    assert {(r.signature, r.brief, r.brief_status) for r in rows} == {(f"f{i}(x)", f"f{i}(x)" if "7" in str(i) else f"is f{i}(x)", "fallback" if "7" in str(i) else "model") for i in range(30)}


def test_http_client():
    import http.server
    import threading

    from tagweave.plans.client import http_client
    from tagweave.plans.config import EnrichConfig

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"choices": [{"message": {"content": "fine"}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = http_client(EnrichConfig(base_url=f"http://127.0.0.1:{server.server_port}/v1/", model="m1", temperature=7), "key")
    assert ask("net", "int f()", "return 1;") == "fine"
    server.shutdown()
    path, key, body = seen[0]
    assert path == "/v1/chat/completions" and key == "Bearer key" and body["model"] == "m1" and body["temperature"] == 1.0
    assert "int f()" in body["messages"][0]["content"] and "return 1;" in body["messages"][0]["content"]


def test_progress_counts_without_further_actions(spark, tmp_path):
    root, out = tmp_path / "tree", str(tmp_path / "index")
    root.mkdir()
    (root / "a.py").write_text("def one():\n    return 1\n\ndef two():\n    return 2\n")
    (root / "b.py").write_text("def three():\n    return 3\n")
    seen = {}
    I.build(spark, str(root), out, progress=lambda stage, counts: seen.update({stage: counts}))
    index = routing.load_tables(spark, out)
    assert list(seen) == ["extracted", "candidates", "symbols", "edges"]
    assert seen["extracted"] == {"rows": 3, "files": 2} and seen["symbols"]["rows"] == index.symbols.count() == 3 and seen["edges"]["rows"] == index.edges.count()


def test_merged_groups_equal_the_driver_version(spark):
    import random

    from tagweave.operators import search, tags

    rng = random.Random(31)
    for size in (6, 40):
        groups = {g: {f"t{rng.randint(0, size * 2)}" for _ in range(rng.randint(1, 3))} for g in range(size)} | {1000 + i: {f"c{i}", f"c{i + 1}"} for i in range(size)}
        rows = tags.merged_groups(spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "grp int, term string")).collect()
        got = {}
        for r in rows:
            got.setdefault(r.merged, set()).add(r.term)
        assert sorted(sorted(x) for x in got.values()) == sorted(search.merge_groups([sorted(x) for x in groups.values()]))
        assert {r.merged for r in rows} <= set(groups) and all(r.merged <= r.grp for r in rows)


def test_orders_of_documents_and_of_the_graph(spark):
    from tagweave.operators import search, tags

    docs = spark.createDataFrame([("b.md", "x x"), ("a.md", "none"), ("c.md", "# x\nx"), ("d.md", "x x")], "path string, content string")
    assert [r.path for r in search.ranked_docs(search.markdown_search(docs, "x")).collect()] == ["c.md", "b.md", "d.md", "a.md"]
    edges = spark.createDataFrame([("s1", "b", "base"), ("s2", "b", "semantic"), ("s1", "a", "base"), ("s3", "c", "base"), ("s4", "c", "base")], "symbol_id string, tag string, tag_type string")
    assert [(r.tag, r["count"]) for r in tags.ranked_nodes(edges).collect()] == [("b", 2), ("c", 2), ("a", 1)]
