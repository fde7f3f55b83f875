"""Queries of the smaller functions over the driver's tables, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import changes as C
from ..operators import search as S
from ..operators import tags as T
from ..sources import markdown as M
from . import bindings as B
from .search_queries import GROUPS, NEGATIVE, _grouped_sql


def path_fields(spark, d):
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), "/$", "")
    p = F.col("path")
    rows = B.read(spark, d, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", X.extension_of(p).alias("ext"), X.extension_priority(p).alias("priority"), X.module_name(p).alias("module"), X.slugify(p).alias("slug"), X.title_from_id(p).alias("title"), X.normalize_path(F.concat(F.lit("./"), p)).alias("normal"))


def display_lines(spark, d):
    lines = B.read(spark, d, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_suppkey", X.display_line(F.col("l_linenumber") % 3, F.col("l_partkey")).alias("line"))


def symbol_keys(spark, d):
    part = B.read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("hint"), F.replace(F.col("p_name"), F.lit(" "), F.lit("::")).alias("raw"))
    hint, raw = F.col("hint"), F.col("raw")
    return part.select("p_partkey", X.symbol_key(hint, raw).alias("key"), X.symbol_id(hint, raw).alias("id"), X.qualifier_depth(raw).alias("depth"))


def word_splits(spark, d):
    names = B.read(spark, d, "customer").select(F.concat_ws("_", "c_name", "c_mktsegment").alias("name")).union(B.read(spark, d, "part").select(F.concat_ws("-", "p_brand", "p_type"))).distinct()
    name = F.col("name")
    return names.select("name", F.array_join(X.split_snake(name), "|").alias("snake"), F.array_join(X.split_camel_plain(name), "|").alias("plain"), F.array_join(X.tokens(X.split_snake(name), 4, ("small", "brand#11")), "|").alias("tokens"))


def labels_of(spark, d):
    docs = B.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", X.label(F.col("text")).alias("label"), X.preview(F.col("text"), 30).alias("preview"), X.occurrences(F.col("text"), F.lit("en")).alias("n"))


def hashes_of(spark, d):
    part = B.read(spark, d, "part")
    return part.select("p_partkey", X.impl_hash(F.col("p_name"), F.col("p_type")).alias("impl_hash"))


def score_map(spark, d):
    kind = F.element_at(X.strings("base", "semantic", "custom"), (F.col("l_linenumber") % 3 + 1).cast("int"))
    index = B.read(spark, d, "lineitem").groupBy(F.lower("l_returnflag").alias("tag"), kind.alias("tag_type")).agg(F.sum("l_suppkey").alias("score"))
    return S.score_map(index)


def search_report(spark, d):
    """Search, order and printed lines in one."""
    scores = B.usage(spark, d).groupBy("tag").agg(F.count("*").alias("score"))
    return S.printed(S.ranked(S.grouped_search(B.edges(spark, d), GROUPS, NEGATIVE, scores)).limit(10))


def single_tag(spark, d):
    return S.single_tag(B.symbols(spark, d), "Blue").select("symbol_id")


def single_tag_first(spark, d):
    return S.single_tag(B.symbols(spark, d), "red", 20).select("symbol_id")


def auto_prompt(spark, d):
    return S.auto_prompt(B.symbols(spark, d), "x = 1", selection=" ", line="red bolt brand")


def _lines_as_stored(spark, d):
    """Order lines with their place in the files: line numbers repeat within an order, and of equal ones the first that is read counts, as in SQL."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    return B.read(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("seq"), *place)


def first_rows(spark, d):
    return C.first_of(_lines_as_stored(spark, d), "l_orderkey", "seq", "file", "row").drop("file", "row")


def last_rows(spark, d):
    return C.last_of(_lines_as_stored(spark, d), "l_orderkey", "seq", "file", "row").drop("file", "row")


def impacted_modules(spark, d):
    now = B.files_now(spark, d)
    symbols = now.select(F.col("rel_path").alias("file_path"), F.substring_index("rel_path", "/", 1).alias("module"))
    return C.impacted_modules(symbols, C.changed_files(now, B.files_before(spark, d)))


def entry_merge(spark, d):
    part = B.read(spark, d, "part")
    row = lambda key: part.select(F.col("p_partkey").alias("id"), F.sha1(key.cast("string")).alias("hash"), F.col("p_name").alias("signature"), F.lit("new").alias("brief"))
    old = row(F.col("p_size")).withColumn("brief", F.col("signature")).filter("id % 4 <> 0")
    return M.merge_entries(old, row(F.when(F.col("p_partkey") % 3 == 0, F.lit(-1)).otherwise(F.col("p_size"))))


def alias_groups(spark, d):
    cust = B.read(spark, d, "customer").select(F.concat_ws("_", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("raw"), F.lower("c_mktsegment").alias("canonical"))
    return T.alias_groups(cust).select("canonical", F.array_join("raws", ",").alias("raws"))


def group_aliases(spark, d):
    nations = B.read(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_set(F.lower("n_name")).alias("names"))
    return T.groups_to_aliases(nations.select(F.create_map(F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")), "names").alias("groups")))


def usage_index(spark, d):
    """The tag index with usage added to the first type that has the tag."""
    edges = B.edges(spark, d)
    index = T.index_counts(edges).withColumn("score", F.lit(0).cast("long"))
    return T.bumped_index(index, B.usage(spark, d))


def brief_fold(spark, d):
    symbols = B.symbols(spark, d).select("symbol_id", "brief")
    lines = B.read(spark, d, "lineitem").filter("l_linenumber = 1")
    log = lines.select(F.col("l_partkey").alias("symbol_id"), F.lit("brief").alias("op"), F.concat(F.lit("b"), F.col("l_orderkey").cast("string")).alias("value"), F.col("l_orderkey").alias("seq"))
    return T.folded_briefs(symbols, log)


def edit_index(spark, d):
    """Counts of the tag index after every third edge went."""
    edges = B.edges(spark, d)
    index = T.index_counts(edges).withColumn("score", F.col("count"))
    return T.folded_index(edges, edges.filter("symbol_id % 3 <> 0"), index)


def graph_rows(spark, d):
    return T.graph_items(B.edges(spark, d))


def graph_counts(spark, d):
    return T.graph_nodes(B.edges(spark, d))


def normalization_counts(spark, d):
    return T.normalization_counts(B.symbols(spark, d))


QUERIES = {
    "path_fields": path_fields, "display_lines": display_lines, "symbol_keys": symbol_keys, "word_splits": word_splits, "labels_of": labels_of, "hashes_of": hashes_of, "score_map": score_map, "search_report": search_report, "single_tag": single_tag,
    "single_tag_first": single_tag_first, "auto_prompt": auto_prompt, "first_rows": first_rows, "last_rows": last_rows, "impacted_modules": impacted_modules, "entry_merge": entry_merge, "alias_groups": alias_groups, "group_aliases": group_aliases, "usage_index": usage_index,
    "brief_fold": brief_fold, "edit_index": edit_index, "graph_rows": graph_rows, "graph_counts": graph_counts, "normalization_counts": normalization_counts,
}

_TAGS = "(SELECT p_partkey AS symbol_id, unnest(string_split(lower(p_name), ' ')) AS tag, 'base' AS tag_type FROM part UNION ALL SELECT p_partkey, lower(p_type), 'semantic' FROM part)"
_INDEX = f"(SELECT tag_type, tag, count(*) AS n FROM {_TAGS} GROUP BY tag_type, tag)"
_SINGLE = "SELECT p_partkey AS symbol_id FROM part WHERE len(list_filter(list_append(string_split(lower(p_name), ' '), lower(p_type)), lambda t: contains(t, '{q}') OR contains('{q}', t))) > 0"


def _auto_sql() -> str:
    words = "red", "bolt", "brand"
    tags = "list_append(string_split(lower(p_name), ' '), lower(p_type))"
    has = lambda c, w, k: f"CASE WHEN contains(lower({c}), '{w}') THEN {k} ELSE 0 END"
    count = lambda c, w: f"(length({c}) - length(replace(lower({c}), '{w}', ''))) // {len(w)}"
    one = lambda w: " + ".join([has("p_brand", w, 2), has("p_partkey::VARCHAR", w, 3), has("p_brand || '/' || p_type", w, 1), has("p_name", w, 1), has("p_type", w, 4), f"CASE WHEN len(list_filter(string_split(lower(p_name), ' '), lambda t: contains(t, '{w}'))) > 0 THEN 1 ELSE 0 END", f"2 * {count("p_name || ' ' || p_type", w)}"])
    score = " + ".join(map(one, words))
    return f"""WITH hits AS (SELECT p_partkey, p_name, p_type, p_brand, {score} AS score FROM part), best AS (SELECT * FROM hits WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 8)
SELECT 'Available APIs:' || chr(10) || string_agg('- ' || p_name || ' [' || p_brand || '] ' || p_name || ' ' || p_type, chr(10) ORDER BY score DESC, p_partkey) || chr(10) || chr(10) || 'Code:' || chr(10) || 'x = 1' AS prompt FROM best"""


def _normal_sql() -> str:
    from ..functions.vocabulary import HARD_ALIASES, STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    names = ", ".join(f"('{k}', '{v}')" for k, v in HARD_ALIASES.items())
    return f"""WITH a(raw, canonical) AS (VALUES {names}), t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(tag, '[ .\\-]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS u FROM {_TAGS}),
v AS (SELECT *, regexp_replace(u, '[^a-z0-9_]', '', 'g') AS w FROM t), n AS (SELECT DISTINCT symbol_id, tag_type, coalesce(canonical, w) AS tag FROM v LEFT JOIN a ON raw = w WHERE length(v.tag) >= 2 AND length(w) >= 2 AND w NOT IN ({stop}) AND w <> 'constructor' AND length(coalesce(canonical, w)) >= 2)
SELECT (SELECT count(*) FROM {_TAGS} WHERE tag_type = 'base') AS raw_base, (SELECT count(*) FROM part) AS raw_semantic, count(*) FILTER (tag_type = 'semantic') AS semantic, count(*) AS total, count(DISTINCT tag) FILTER (tag_type = 'semantic') AS distinct_semantic, count(DISTINCT tag) AS distinct_total FROM n"""


SQL = {
    "path_fields": r"""SELECT page_id, ext, CASE WHEN ext IN ('cpp', 'cc', 'cxx', 'c') THEN 0 ELSE 1 END AS priority, coalesce(nullif(regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '^(.+)\.[^.]*$', '\1'), ''), 'core') AS module,
  regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, CASE WHEN path = '' THEN 'Core' ELSE upper(path[1]) || path[2:] END AS title, path AS normal
  FROM (SELECT *, lower(regexp_extract(path, '\.([^./\\]+)$', 1)) AS ext FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/$', '') AS path FROM pages))""",
    "display_lines": "SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(nullif(l_linenumber % 3, 0), l_partkey) AS line FROM lineitem",
    "symbol_keys": "SELECT p_partkey, p_brand || '::' || array_to_string(ws[greatest(len(ws) - 1, 1):], '::') AS key, p_brand || '::' || array_to_string(ws, '::') AS id, len(ws) AS depth FROM (SELECT *, string_split(p_name, ' ') AS ws FROM part)",
    "word_splits": r"""WITH n AS (SELECT DISTINCT name FROM (SELECT c_name || '_' || c_mktsegment AS name FROM customer UNION ALL SELECT p_brand || '-' || p_type FROM part)),
  s AS (SELECT name, list_filter(regexp_split_to_array(name, '[_\-]+'), lambda x: x <> '') AS snake, list_filter(regexp_split_to_array(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[_\-]+'), lambda x: trim(x) <> '') AS plain FROM n)
  SELECT name, array_to_string(snake, '|') AS snake, array_to_string(plain, '|') AS plain, array_to_string(list_filter(list_transform(snake, lambda x: lower(trim(x))), lambda x: length(x) >= 4 AND x NOT IN ('small', 'brand#11')), '|') AS tokens FROM s""",
    "labels_of": "SELECT doc_id, CASE WHEN length(t) > 14 THEN left(t, 12) || '…' ELSE t END AS label, left(t, 30) AS preview, ((length(t) - length(replace(t, 'en', ''))) // 2)::INT AS n FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "hashes_of": "SELECT p_partkey, sha1(p_name || chr(10) || p_type) AS impl_hash FROM part",
    "score_map": "SELECT tag, arg_max(score, r)::BIGINT AS score FROM (SELECT lower(l_returnflag) AS tag, l_linenumber % 3 AS r, sum(l_suppkey) AS score FROM lineitem GROUP BY ALL) GROUP BY tag",
    "search_report": f"SELECT symbol_id || ' (matches ' || match_count || ', score ' || score || ')' AS line FROM ({_grouped_sql(GROUPS, NEGATIVE, True)}) ORDER BY score DESC, match_count DESC, symbol_id LIMIT 10",
    "single_tag": _SINGLE.format(q="blue"),
    "single_tag_first": _SINGLE.format(q="red") + " ORDER BY 1 LIMIT 20",
    "auto_prompt": _auto_sql(),
    "first_rows": "SELECT l_orderkey, arg_min(l_partkey, l_linenumber) AS l_partkey, min(l_linenumber) AS seq FROM lineitem GROUP BY l_orderkey",
    "last_rows": "SELECT l_orderkey, arg_max(l_partkey, l_linenumber) AS l_partkey, min(l_linenumber) AS seq FROM lineitem GROUP BY l_orderkey",
    "impacted_modules": "SELECT DISTINCT source AS module FROM documents WHERE doc_id % 10 = 0 OR (doc_id % 7 = 0 AND coalesce(text, '') <> 'old')",
    "entry_merge": "SELECT p_partkey AS id, sha1(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_size END::VARCHAR) AS hash, p_name AS signature, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 THEN p_name ELSE 'new' END AS brief FROM part",
    "alias_groups": "SELECT lower(c_mktsegment) AS canonical, array_to_string(list_sort(list_distinct(list(lower(c_mktsegment) || '_' || c_nationkey))), ',') AS raws FROM customer GROUP BY 1",
    "group_aliases": "SELECT DISTINCT lower(n_name) AS raw, 'region_' || n_regionkey AS canonical FROM nation",
    "usage_index": f"""SELECT tag_type, tag, n AS count, (CASE WHEN tag_type = first THEN coalesce(bump, 0) ELSE 0 END)::BIGINT AS score FROM (SELECT *, min(tag_type) OVER (PARTITION BY tag) AS first FROM {_INDEX})
  LEFT JOIN (SELECT ['blue', 'new', 'cold', 'red', 'large', 'small', 'hot', 'old'][user_id % 8 + 1] AS tag, count(*) AS bump FROM events GROUP BY 1) USING (tag)""",
    "brief_fold": "SELECT p_partkey AS symbol_id, coalesce(b, p_name || ' ' || p_type) AS brief FROM part LEFT JOIN (SELECT l_partkey, 'b' || max(l_orderkey) AS b FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_partkey = p_partkey",
    "edit_index": f"SELECT tag_type, tag, coalesce(m, 0) AS count, n AS score FROM {_INDEX} LEFT JOIN (SELECT tag_type, tag, count(*) AS m FROM {_TAGS} WHERE symbol_id % 3 <> 0 GROUP BY 1, 2) USING (tag_type, tag)",
    "graph_rows": f"SELECT DISTINCT tag, symbol_id FROM {_TAGS}",
    "graph_counts": f"SELECT tag, min(tag_type) AS tag_type, count(DISTINCT symbol_id) AS count FROM {_TAGS} GROUP BY tag",
    "normalization_counts": _normal_sql(),
}
