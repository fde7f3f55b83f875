"""Search queries over the driver's tables, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from . import bindings as B

GROUPS, NEGATIVE = S.parse_groups(["widget|gizmo", "red|blue", "!promo"])
ALIASES = [("gadget", "gizmo"), ("thing", "gizmo"), ("crimson", "red")]
QUERY = "red bolt brand #economy"


def grouped(spark, d):
    return S.grouped_search(B.edges(spark, d), S.normalized_groups(spark, GROUPS))


def exclude(spark, d):
    return S.grouped_search(B.edges(spark, d), GROUPS, NEGATIVE)


def alias(spark, d):
    table = spark.createDataFrame(ALIASES, "raw string, canonical string")
    return S.grouped_search(B.edges(spark, d), S.expand_groups([["gadget"], ["crimson", "blue"]], table))


def scored(spark, d):
    scores = B.usage(spark, d).groupBy("tag").agg(F.count("*").alias("score"))
    return S.grouped_search(B.edges(spark, d), GROUPS, NEGATIVE, scores)


def keyword(spark, d):
    return S.keyword_search(B.symbols(spark, d), QUERY).select("symbol_id", "score")


def keyword_topn(spark, d):
    return S.top(S.keyword_search(B.symbols(spark, d), QUERY).select("symbol_id", "score"), 8, "symbol_id")


def markdown(spark, d):
    docs = B.read(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return S.markdown_search(docs, "tion")


def nearest(spark, d):
    """Orders as files, their lines as symbols (number and quantity as lines), the customer's key as the cursor."""
    lines = B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").cast("int").alias("decl_line"), F.col("l_quantity").cast("int").alias("impl_line"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.col("l_partkey").alias("symbol_id"))
    cursors = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("file_path"), (F.col("o_custkey") % 50).cast("int").alias("line"))
    return S.nearest_symbols(cursors, lines)


def suggest(spark, d):
    counts = B.edges(spark, d).groupBy("tag").agg(F.count("*").alias("count"))
    return S.suggestions(counts, "o")


QUERIES = {
    "tag_search_grouped": grouped,
    "tag_search_exclude": exclude,
    "tag_search_alias": alias,
    "tag_search_scored": scored,
    "keyword_search": keyword,
    "keyword_topn": keyword_topn,
    "markdown_search": markdown,
    "nearest_symbol": nearest,
    "tag_suggest": suggest,
}

TAGS = "tags AS (SELECT p_partkey AS symbol_id, unnest(string_split(lower(p_name), ' ')) AS tag FROM part UNION SELECT p_partkey, lower(p_type) FROM part)"
MATCH = "CASE WHEN least(length(q.t), length(tags.tag)) <= 3 THEN q.t = tags.tag ELSE contains(tags.tag, q.t) OR contains(q.t, tags.tag) END"


def _values(groups) -> str:
    return ", ".join(f"({i}, '{t}')" for i, g in enumerate(groups) for t in g)


def _grouped_sql(groups, negative=(), usage: bool = False) -> str:
    bad = f"WHERE NOT EXISTS (SELECT 1 FROM tags JOIN (VALUES {_values(negative)}) q(g, t) ON {MATCH} WHERE tags.symbol_id = m.symbol_id)" if negative else ""
    use = "LEFT JOIN u USING (tag)" if usage else ""
    more = ", u AS (SELECT ['blue','new','cold','red','large','small','hot','old'][user_id % 8 + 1] AS tag, count(*) AS s FROM events GROUP BY 1)" if usage else ""
    return f"""WITH {TAGS}, q(g, t) AS (VALUES {_values(groups)}){more},
m AS (SELECT tags.symbol_id, tags.tag, q.g FROM tags JOIN q ON {MATCH}),
h AS (SELECT symbol_id, count(DISTINCT g) AS match_count FROM m {bad} GROUP BY symbol_id HAVING count(DISTINCT g) = {len(groups)})
SELECT symbol_id, match_count, sum(1{' + coalesce(s, 0)' if usage else ''})::BIGINT AS score FROM h JOIN (SELECT DISTINCT symbol_id, tag FROM m) USING (symbol_id) {use} GROUP BY ALL"""


def _keyword_sql() -> str:
    words, required = S.parse_keywords(QUERY)
    part = lambda w: f"2 * contains(lower(p_brand), '{w}')::INT + 3 * contains(p_partkey::VARCHAR, '{w}')::INT + contains(lower(p_brand || '/' || p_type), '{w}')::INT + contains(lower(p_name), '{w}')::INT + 4 * contains(lower(p_type), '{w}')::INT + (len(list_filter(string_split(lower(p_name), ' '), lambda x: contains(x, '{w}'))) > 0)::INT + 2 * ((length(p_name || ' ' || p_type) - length(replace(lower(p_name || ' ' || p_type), '{w}', ''))) // {len(w)})"
    return f"SELECT p_partkey AS symbol_id, ({' + '.join(map(part, words))} + {5 * len(required)})::INT AS score FROM part WHERE list_contains(list_append(string_split(lower(p_name), ' '), lower(p_type)), '{required[0]}')"


SQL = {
    "tag_search_grouped": _grouped_sql(GROUPS),
    "tag_search_exclude": _grouped_sql(GROUPS, NEGATIVE),
    "tag_search_alias": _grouped_sql([["gadget", "gizmo", "thing"], ["blue", "crimson", "red"]]),
    "tag_search_scored": _grouped_sql(GROUPS, NEGATIVE, True),
    "keyword_search": _keyword_sql(),
    "keyword_topn": f"SELECT * FROM ({_keyword_sql()}) ORDER BY score DESC, symbol_id LIMIT 8",
    "markdown_search": """SELECT path, CASE WHEN starts_with(line, '# ') THEN trim(line[3:]) ELSE path END AS title, left(content, 240) AS preview,
  (3 * contains(lower(CASE WHEN starts_with(line, '# ') THEN trim(line[3:]) ELSE path END), 'tion')::INT + (length(content) - length(replace(lower(content), 'tion', ''))) // 4)::INT AS score
  FROM (SELECT source || '/' || doc_id AS path, text AS content, string_split(text, chr(10))[1] AS line FROM documents)""",
    "nearest_symbol": """SELECT file_path, line, symbol_id, distance FROM (SELECT o_orderkey AS file_path, (o_custkey % 50)::INT AS line, l_partkey AS symbol_id, least(abs(l_linenumber - o_custkey % 50), abs(l_quantity::INT - o_custkey % 50))::INT AS distance,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY least(abs(l_linenumber - o_custkey % 50), abs(l_quantity::INT - o_custkey % 50)), l_linenumber, l_partkey, l_suppkey) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE r = 1""",
    "tag_suggest": "SELECT tag, count(*) AS count FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS tag FROM part UNION ALL SELECT lower(p_type) FROM part) WHERE contains(tag, 'o') GROUP BY tag ORDER BY count DESC, tag LIMIT 8",
}
