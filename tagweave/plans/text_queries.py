"""Text, change and extraction queries over the driver's tables, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..extract import registry as R
from ..functions import text as X
from ..functions.vocabulary import HARD_ALIASES, STOP_WORDS
from ..operators import changes as C
from ..sources import ignore
from . import bindings as B
from .corpus import GENERATED

BODIES = ["{}", "{ return; }", "{ return nullptr; }", "{ return m_x; }", "{ return x; }", "{ return f(x); }", "{ /* none */ }", "int f() { return this->size; } // end", "{ x = 1; return x; }", "{ return a.b; } # tail"]
IDS = ["RectItem", "addLine", "HTTPServer", "parse_json-file", "a1B2"]
SIGNATURES = ["int  add( int a , int b )", "def f(a, b) -> int", "class Foo : public Bar", "std::vector<int> * p"]
CJK = ["数据_库", "json 解析", "环检测", "缓 存 策略", "解析 json_x"]
RULES = ("*.log", "/build/", "fr/", "!fr/8*", "# note")


def tag_normalize(spark, d):
    words = B.words(spark, d).union(spark.createDataFrame([(t,) for t in CJK], "tag string"))
    return words.select("tag", X.index_tag(F.col("tag")).alias("normalized")).distinct()


def camel_split(spark, d):
    names = spark.createDataFrame([(x,) for x in IDS], "name string").union(B.read(spark, d, "part").select("p_type")).union(B.read(spark, d, "customer").select("c_name")).distinct()
    return names.select("name", F.array_join(X.split_camel(F.col("name")), "|").alias("parts"))


def signatures(spark, d):
    rows = spark.createDataFrame([(x,) for x in SIGNATURES], "signature string").union(B.read(spark, d, "part").select("p_name").distinct())
    return rows.select("signature", X.normalize_signature(F.col("signature")).alias("normalized"), X.hash_signature(F.col("signature")).alias("hash"))


def file_hashes(spark, d):
    return B.files_now(spark, d).select("rel_path", "hash", F.lit("").alias("skill_doc"))


def change_detect(spark, d):
    return C.changed_files(B.files_now(spark, d), B.files_before(spark, d))


def reuse_split(spark, d):
    row = lambda df: df.select(F.col("rel_path").alias("symbol_id"), F.col("rel_path").alias("file_path"), F.sha1("rel_path").alias("decl_hash"), F.col("hash").alias("impl_hash"))
    now, before = B.files_now(spark, d), B.files_before(spark, d)
    return C.split_reuse(row(now), row(before), C.changed_files(now, before)).select("symbol_id", "reuse")


def candidate_dedup(spark, d):
    lines = B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_orderkey").alias("symbol_key"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("priority"), F.col("l_linenumber").alias("qualifier_depth"))
    return C.dedup_candidates(lines, "symbol_key", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def decl_impl_merge(spark, d):
    orders = B.read(spark, d, "orders").select(F.col("o_orderpriority").alias("module"), F.col("o_custkey").cast("string").alias("raw_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey").cast("int")).alias("decl_line"), F.when(F.col("o_orderkey") % 2 > 0, F.col("o_orderkey").cast("int")).alias("impl_line"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("signature"), F.col("o_orderkey").alias("seq"))
    return C.merge_declarations(orders)


def script_extract(spark, d):
    return B.read(spark, d, "pages").select("page_id", X.script_body(F.col("html")).alias("script"))


#: A body for each part, as an expression that Spark and the oracle share.
PART_BODY = "CASE WHEN p_size < 12 THEN '{ return m_' || replace(p_name, ' ', '_') || '; }' WHEN p_size < 24 THEN '{ return ' || replace(p_name, ' ', '.') || p_partkey || '; } // ' || p_type WHEN p_size < 36 THEN '{ /* ' || p_name || p_partkey || ' */ }' ELSE '{ x = ' || p_size || '; return ' || replace(p_name, ' ', '(') || '); }' END"


def trivial(spark, d):
    rows = spark.createDataFrame([(x,) for x in BODIES], "body string").union(B.read(spark, d, "part").select(F.expr(PART_BODY))).distinct()
    return rows.select("body", F.trim(X.strip_comments(F.col("body"))).alias("bare"), X.trivial_brief(F.col("body")).alias("brief"))


def truncate(spark, d):
    return B.read(spark, d, "documents").select("doc_id", F.sha1(X.truncated(F.col("text"), 8, 900)).alias("digest"))


def lenient_json(spark, d):
    answer = F.concat(F.lit('Sure: {"groups": {"kind": ["'), "event_type", F.lit('", " '), F.col("user_id").cast("string"), F.lit('"]}} done'))
    rows = B.read(spark, d, "events").select("event_id", X.aggregation_groups(answer).alias("g"))
    return rows.select("event_id", F.element_at(F.map_keys("g"), 1).alias("category"), F.array_join(F.element_at(F.map_values("g"), 1), "|").alias("tags"))


def ignore_filter(spark, d):
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), "/$", "")
    return B.read(spark, d, "pages").select("page_id", path.alias("path")).filter(~ignore.ignored(F.col("path"), RULES))


def extracted(lang):
    def run(spark, d):
        """Symbols of one source file for each part, with their snippets."""
        ext, code, _ = GENERATED[lang]
        # parts are few bytes each, so one task may read them all; their files are dealt over the cluster
        part = B.read(spark, d, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
        text = F.replace(F.replace(F.lit(code), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{z}"), F.col("p_size").cast("string"))
        files = part.select(F.concat(F.lit("gen/part"), F.col("p_partkey").cast("string"), F.lit(f".{ext}")).alias("rel_path"), F.lit(lang).alias("lang"), text.alias("content"))
        return R.extract(files).select("rel_path", "raw_id", "kind", "signature", "decl_line", "impl_line", "snippet")

    return run


def _symbols_sql(lang: str) -> str:
    """The symbols that corpus.GENERATED names, for each part."""
    ext, _, rows = GENERATED[lang]
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    values = ", ".join(f"({', '.join(map(cell, r))})" for r in rows)
    fill = lambda c: f"replace(replace({c}, '{{k}}', p_partkey::VARCHAR), '{{z}}', p_size::VARCHAR) AS {c}"
    return f"SELECT 'gen/part' || p_partkey || '.{ext}' AS rel_path, {fill('raw_id')}, kind, {fill('signature')}, decl_line::INT AS decl_line, impl_line::INT AS impl_line, {fill('snippet')} FROM part, (VALUES {values}) s(raw_id, kind, signature, decl_line, impl_line, snippet)"


QUERIES = {
    "tag_normalize": tag_normalize,
    "camel_split": camel_split,
    "signature_normalize_hash": signatures,
    "file_hash_meta": file_hashes,
    "change_detect": change_detect,
    "reuse_split": reuse_split,
    "candidate_dedup": candidate_dedup,
    "decl_impl_merge": decl_impl_merge,
    "script_extract": script_extract,
    "trivial_brief": trivial,
    "truncate_text": truncate,
    "lenient_json": lenient_json,
    "ignore_filter": ignore_filter,
} | {f"symbols_{lang}": extracted(lang) for lang in GENERATED}


def _quoted(values) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


_LIST = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ", 'constructor']"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in HARD_ALIASES.items()) + "}"
_PREV = "p AS (SELECT source || '/' || doc_id AS rel_path, CASE WHEN doc_id % 7 = 0 THEN sha1('old') ELSE sha1(coalesce(text, '')) END AS hash FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'gone/1', '0'), n AS (SELECT source || '/' || doc_id AS rel_path, sha1(coalesce(text, '')) AS hash FROM documents)"
SQL = {
    "tag_normalize": f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_\\-]+')) AS tag FROM documents UNION VALUES {_quoted(CJK)}),
a AS (SELECT tag, regexp_replace(regexp_replace(regexp_replace(lower(trim(tag)), '[\\s\\-.]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS u FROM w),
b AS (SELECT tag, regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '([一-鿿])_+([一-鿿])', '\\1\\2', 'g'), '([a-z0-9])_+([一-鿿])', '\\1\\2', 'g'), '([一-鿿])_+([a-z0-9])', '\\1\\2', 'g'), '[^a-z0-9_一-鿿]', '', 'g') AS u FROM a)
SELECT tag, CASE WHEN length(trim(tag)) >= 2 AND length(u) >= 2 AND NOT list_contains({_LIST}, u) AND length(coalesce({_MAP}[u], u)) >= 2 THEN coalesce({_MAP}[u], u) END AS normalized FROM b""",
    "camel_split": f"WITH n(name) AS (VALUES {_quoted(IDS)} UNION SELECT p_type FROM part UNION SELECT c_name FROM customer) SELECT name, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-\\s]+', ' ', 'g'), ' '), lambda x: x <> ''), '|') AS parts FROM n",
    "signature_normalize_hash": f"WITH s(signature) AS (VALUES {_quoted(SIGNATURES)} UNION SELECT p_name FROM part), t AS (SELECT signature, trim(regexp_replace(regexp_replace(signature, '\\s+', ' ', 'g'), ' *([(),*&<>:=]) *', '\\1', 'g')) AS normalized FROM s) SELECT signature, normalized, sha1(normalized) AS hash FROM t",
    "file_hash_meta": "SELECT source || '/' || doc_id AS rel_path, sha1(coalesce(text, '')) AS hash, '' AS skill_doc FROM documents",
    "change_detect": f"WITH {_PREV} SELECT coalesce(n.rel_path, p.rel_path) AS rel_path, CASE WHEN p.rel_path IS NULL THEN 'added' WHEN n.rel_path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM n FULL JOIN p ON n.rel_path = p.rel_path WHERE n.hash IS DISTINCT FROM p.hash",
    "reuse_split": f"WITH {_PREV} SELECT n.rel_path AS symbol_id, coalesce(n.hash = p.hash, false) AS reuse FROM n LEFT JOIN p ON n.rel_path = p.rel_path",
    "candidate_dedup": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'A')::INT, l_linenumber DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1",
    "decl_impl_merge": "SELECT o_orderpriority AS module, o_custkey::VARCHAR AS raw_id, min(o_orderkey) FILTER (o_orderkey % 3 > 0)::INT AS decl_line, min(o_orderkey) FILTER (o_orderkey % 2 > 0)::INT AS impl_line, 's' || coalesce(min(o_orderkey) FILTER (o_orderkey % 3 > 0), min(o_orderkey)) AS signature FROM orders GROUP BY ALL",
    "script_extract": "SELECT page_id, CASE WHEN regexp_matches(html, '<script[^>]*>[\\s\\S]*?</script>') THEN regexp_extract(html, '<script[^>]*>([\\s\\S]*?)</script>', 1) ELSE html END AS script FROM pages",
    "trivial_brief": f"""WITH b(body) AS (VALUES {_quoted(BODIES)} UNION SELECT {PART_BODY} FROM part), c AS (SELECT body, trim(regexp_replace(regexp_replace(regexp_replace(body, '/\\*[\\s\\S]*?\\*/', ' ', 'g'), '(?m)//.*$', ' ', 'g'), '(?m)#.*$', ' ', 'g')) AS bare,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(body, '\\{{([\\s\\S]*)\\}}', 1), '/\\*[\\s\\S]*?\\*/', ' ', 'g'), '(?m)//.*$', ' ', 'g'), '(?m)#.*$', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM b),
v AS (SELECT *, trim(regexp_replace(regexp_replace(x, '^return ', ''), '; *$', '')) AS e FROM c)
SELECT body, bare, CASE WHEN x = '' OR regexp_matches(x, '^return *;? *$') OR regexp_matches(x, '^return *(nullptr|null|none|nil|undefined) *;? *$') THEN '空返回' WHEN x LIKE 'return %' AND e <> '' AND NOT regexp_matches(replace(e, '->', ''), '[^A-Za-z0-9_$.]') THEN CASE WHEN contains(e, 'this.') OR contains(e, 'this->') OR regexp_matches(e, '^(_|m_)[A-Za-z0-9_]+$') THEN '返回成员变量' ELSE '简单返回' END END AS brief FROM v""",
    "truncate_text": """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS r FROM documents), a AS (SELECT doc_id, text, r, len(r) AS n, greatest(3, len(r) - 3) AS tail FROM l),
b AS (SELECT doc_id, CASE WHEN n > 8 THEN array_to_string(list_concat(list_concat(list_concat(r[1:2], ['// ... truncated ...']), list_concat(r[greatest(2, least(greatest((n - 1) // 2, 2), tail - 1)) + 1 : greatest(2, least(greatest((n - 1) // 2, 2), tail - 1)) + 1], ['// ... truncated ...'])), r[tail + 1 :]), chr(10)) ELSE text END AS t FROM a),
c AS (SELECT doc_id, t, length(t) AS n, greatest((length(t) - 171) // 2, 342) AS mid FROM b),
m AS (SELECT chr(10) || '// ... truncated ...' || chr(10) AS k)
SELECT doc_id, sha1(CASE WHEN n > 900 THEN left(t, 342) || k || substr(t, mid + 1, 171) || k || substr(t, greatest(mid + 171, n - 343) + 1) ELSE t END) AS digest FROM c, m""",
    "lenient_json": "SELECT event_id, 'kind' AS category, CASE WHEN event_type = user_id::VARCHAR THEN event_type ELSE event_type || '|' || user_id END AS tags FROM events",
    "ignore_filter": "SELECT page_id, path FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/$', '') AS path FROM pages) WHERE CASE WHEN regexp_matches(path, '^fr/8[^/]*(/|$)') THEN true WHEN regexp_matches(path, '(^|/)fr/') THEN false WHEN regexp_matches(path, '^build/') THEN false WHEN regexp_matches(path, '(^|/)[^/]*\\.log(/|$)') THEN false WHEN regexp_matches(path, '(^|/)node_modules(/|$)') THEN false ELSE true END",
} | {f"symbols_{lang}": _symbols_sql(lang) for lang in GENERATED}
