"""Tag-table queries over the driver's tables, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tags as T
from . import bindings as B

CHAIN = [("widget", "device"), ("device", "apparatus"), ("gizmo", "gadget"), ("gadget", "tool"), ("tool", "gadget"), ("red", "colour"), ("hop0", "hop1"), *[(f"hop{i}", f"hop{i + 1}") for i in range(1, 13)]]
KNOWN = ["widget", "red", "promo"]


def _aliases(spark):
    return spark.createDataFrame(CHAIN, "raw string, canonical string")


def _categories(spark):
    return spark.createDataFrame([(t, 0) for t in (*KNOWN, "unused")], "tag string, count long")


def index_counts(spark, d):
    return T.index_counts(B.edges(spark, d))


def index_scores(spark, d):
    scores = T.usage_scores(B.usage(spark, d)).withColumn("tag_type", F.lit("base"))
    return T.index_scores(T.index_counts(B.edges(spark, d)), scores)


def graph(spark, d):
    return T.graph(B.edges(spark, d)).withColumn("items", F.array_join("items", ","))


def drilldown(spark, d):
    return T.drill_down(B.edges(spark, d), ["red", "widget"]).withColumn("tags", F.array_join("tags", ","))


def type_counts(spark, d):
    return T.type_counts(B.edges(spark, d))


def frequency(spark, d):
    return T.frequency(B.symbols(spark, d).withColumn("semantic", F.when(F.col("symbol_id") % 2 == 0, F.col("semantic"))))


def primary(spark, d):
    return T.primary_tags(B.symbols(spark, d).withColumn("semantic", F.when(F.col("symbol_id") % 2 == 0, F.col("semantic"))))


def cluster_by_tag(spark, d):
    return T.clusters(B.symbols(spark, d).drop("semantic").withColumn("semantic", X.strings()), by_path_from=1 << 30)


def cluster_by_path(spark, d):
    return T.clusters(B.symbols(spark, d), by_path_from=0)


def unknown(spark, d):
    return T.unknown_tags(B.edges(spark, d), _aliases(spark), _categories(spark))


def resolve(spark, d):
    return T.resolve_aliases(B.edges(spark, d).select("tag").union(_aliases(spark).select("raw")), _aliases(spark))


def cycles(spark, d):
    """Suppliers lead to the supplier with their nation's number, and so in circles; customers join them; parts lead to their size, which leads nowhere."""
    supplier = B.read(spark, d, "supplier").selectExpr("concat('s', s_suppkey) raw", "concat('s', s_nationkey) canonical")
    customer = B.read(spark, d, "customer").selectExpr("concat('c', c_custkey) raw", "concat('s', c_nationkey) canonical")
    part = B.read(spark, d, "part").selectExpr("concat('p', p_partkey) raw", "concat('z', p_size) canonical")
    return T.cyclic_aliases(_aliases(spark).select("raw", "canonical").union(supplier).union(customer).union(part))


def category_counts(spark, d):
    tags = B.edges(spark, d)
    return T.category_counts(T.with_categories(_categories(spark), tags), tags)


def alias_cleanup(spark, d):
    tags = B.edges(spark, d)
    table = spark.createDataFrame([("crimson", "red"), ("nothing", "unused"), ("offer", "promo")], "raw string, canonical string")
    return T.used_only(T.category_counts(_categories(spark), tags), table)[1]


def metadata_merge(spark, d):
    counts = B.edges(spark, d).groupBy("tag").agg(F.count("*").alias("count"))
    return T.merge_maps(counts, spark.createDataFrame([("red", 1), ("fresh", 2)], "tag string, count long"), "tag", "count")


def semantic_filter(spark, d):
    s = B.symbols(spark, d).withColumn("all", F.concat("base", "semantic", F.array(F.lit("service"), F.lit("io"), F.lower("signature"))))
    low = X.low_info_tags(F.slice("base", 1, 1), F.col("file_path"), F.lit("unit"))
    return s.select("symbol_id", F.array_join(X.semantic_tags(F.col("all"), low), ",").alias("tags"))


def tag_diff(spark, d):
    before = B.edges(spark, d)
    after = before.filter("not (tag = 'red' and symbol_id % 3 = 0)").withColumn("tag_type", F.when(F.col("tag") == "promo", "custom").otherwise(F.col("tag_type")))
    return T.tag_diff(before, after)


def edit_fold(spark, d):
    """Events as edits of users' tags: errors remove, other events add; the edge is (user, event type)."""
    log = B.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("symbol_id"), F.when(F.col("value") > 20, "remove").otherwise("add").alias("op"), F.col("event_type").alias("value"), F.lit("custom").alias("tag_type"))
    start = spark.createDataFrame([("7", "click", "custom", 0), ("-1", "kept", "base", 0)], "symbol_id string, tag string, tag_type string, pos int")
    return T.folded_edits(start, log).select("symbol_id", "tag", "tag_type")


def usage_fold(spark, d):
    index = T.index_scores(T.index_counts(B.edges(spark, d)), spark.createDataFrame([("base", "red", 5)], "tag_type string, tag string, score long"))
    return T.bumped_index(index, B.usage(spark, d))


def batch_assign(spark, d):
    return T.batches(B.words(spark, d))


def bubble(spark, d):
    return T.bubble_sizes(B.edges(spark, d).groupBy("tag").agg(F.count("*").alias("count")))


QUERIES = {
    "tag_index_counts": index_counts,
    "tag_index_scores": index_scores,
    "tag_graph": graph,
    "tag_drilldown": drilldown,
    "tag_type_counts": type_counts,
    "tag_frequency": frequency,
    "primary_tag": primary,
    "cluster_by_tag": cluster_by_tag,
    "cluster_by_path": cluster_by_path,
    "unknown_tags": unknown,
    "alias_resolve": resolve,
    "alias_cycles": cycles,
    "category_counts": category_counts,
    "alias_cleanup": alias_cleanup,
    "metadata_merge": metadata_merge,
    "semantic_filter": semantic_filter,
    "tag_diff": tag_diff,
    "tag_edit_fold": edit_fold,
    "usage_fold": usage_fold,
    "batch_assign": batch_assign,
    "bubble_scale": bubble,
}

EDGES = "e AS (SELECT p_partkey AS symbol_id, unnest(string_split(lower(p_name), ' ')) AS tag, 'base' AS tag_type, generate_subscripts(string_split(lower(p_name), ' '), 1) - 1 AS pos FROM part UNION ALL SELECT p_partkey, lower(p_type), 'semantic', 0 FROM part)"
USAGE = "u AS (SELECT ['blue','new','cold','red','large','small','hot','old'][user_id % 8 + 1] AS tag, count(*) AS s FROM events GROUP BY 1)"
AL = "al(raw, canonical) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CHAIN) + ")"
CAT = "cat(tag) AS (VALUES ('widget'), ('red'), ('promo'), ('unused'))"
TYPE = "CASE min(CASE tag_type WHEN 'base' THEN 0 WHEN 'semantic' THEN 1 ELSE 2 END) WHEN 0 THEN 'base' WHEN 1 THEN 'semantic' ELSE 'custom' END"
SRC = "src AS (SELECT symbol_id, tag, pos FROM e WHERE CASE WHEN symbol_id % 2 = 0 THEN tag_type = 'semantic' ELSE tag_type = 'base' END)"

SQL = {
    "tag_index_counts": f"WITH {EDGES} SELECT tag_type, tag, count(*) AS count FROM e GROUP BY ALL",
    "tag_index_scores": f"WITH {EDGES}, {USAGE} SELECT tag_type, tag, count(*) AS count, coalesce(any_value(CASE WHEN tag_type = 'base' THEN s END), 0)::BIGINT AS score FROM e LEFT JOIN u USING (tag) GROUP BY tag_type, tag",
    "tag_graph": f"WITH {EDGES} SELECT tag, {TYPE} AS tag_type, count(DISTINCT symbol_id) AS count, array_to_string(list_sort(list(DISTINCT symbol_id)), ',') AS items FROM e GROUP BY tag",
    "tag_drilldown": f"WITH {EDGES}, g AS (SELECT symbol_id, list_sort(list(DISTINCT tag)) AS ts FROM e GROUP BY symbol_id) SELECT symbol_id, array_to_string(ts, ',') AS tags FROM g WHERE list_has_all(ts, ['red', 'widget'])",
    "tag_type_counts": f"WITH {EDGES}, t AS (SELECT tag, {TYPE} AS y FROM e GROUP BY tag) SELECT count(*) AS total, count(*) FILTER (y = 'base') AS base, count(*) FILTER (y = 'semantic') AS semantic, count(*) FILTER (y = 'custom') AS custom FROM t",
    "tag_frequency": f"WITH {EDGES}, {SRC} SELECT tag, count(*) AS count FROM src GROUP BY tag",
    "primary_tag": f"WITH {EDGES}, {SRC}, f AS (SELECT tag, count(*) AS n FROM src GROUP BY tag) SELECT symbol_id, tag FROM (SELECT symbol_id, tag, row_number() OVER (PARTITION BY symbol_id ORDER BY n DESC, pos) AS r FROM src JOIN f USING (tag)) WHERE r = 1",
    "cluster_by_tag": f"""WITH {EDGES}, b AS (SELECT * FROM e WHERE tag_type = 'base'), f AS (SELECT tag, count(*) AS n FROM b GROUP BY tag),
p AS (SELECT symbol_id, tag FROM (SELECT symbol_id, tag, row_number() OVER (PARTITION BY symbol_id ORDER BY n DESC, pos) AS r FROM b JOIN f USING (tag)) WHERE r = 1),
c AS (SELECT symbol_id, tag, count(*) OVER (PARTITION BY tag) >= 3 AS big, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS path FROM p JOIN part ON p_partkey = symbol_id)
SELECT symbol_id, CASE WHEN big THEN tag ELSE path END AS cluster_id, CASE WHEN big THEN 'tag' ELSE 'path' END AS kind, upper((CASE WHEN big THEN tag ELSE path END)[1]) || (CASE WHEN big THEN tag ELSE path END)[2:] AS title FROM c""",
    "cluster_by_path": "SELECT p_partkey AS symbol_id, s AS cluster_id, 'path' AS kind, upper(s[1]) || s[2:] AS title FROM (SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM part)",
    "unknown_tags": f"WITH {EDGES}, {AL}, {CAT} SELECT DISTINCT tag FROM e WHERE tag NOT IN (SELECT raw FROM al UNION SELECT canonical FROM al UNION SELECT tag FROM cat)",
    "alias_resolve": f"WITH RECURSIVE {EDGES}, {AL}, r(tag, canonical, path, n) AS (SELECT tag, tag, [tag], 0 FROM (SELECT tag FROM e UNION SELECT raw FROM al) UNION ALL SELECT r.tag, al.canonical, list_append(path, al.canonical), n + 1 FROM r JOIN al ON al.raw = r.canonical WHERE n < 10 AND NOT list_contains(path, al.canonical)) SELECT tag, arg_max(canonical, n) AS canonical FROM r GROUP BY tag",
    "alias_cycles": f"WITH RECURSIVE {AL.replace('al(', 'a0(', 1)}, al AS (SELECT * FROM a0 UNION ALL SELECT 's' || s_suppkey, 's' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 's' || c_nationkey FROM customer UNION ALL SELECT 'p' || p_partkey, 'z' || p_size FROM part), r(raw, c, n) AS (SELECT raw, canonical, 1 FROM al UNION ALL SELECT r.raw, al.canonical, n + 1 FROM r JOIN al ON al.raw = r.c WHERE n < 64) SELECT DISTINCT raw FROM r WHERE n = 64",
    "category_counts": f"WITH {EDGES}, {CAT} SELECT tag, count(symbol_id) AS count FROM (SELECT tag FROM cat UNION SELECT tag FROM e) LEFT JOIN e USING (tag) GROUP BY tag",
    "alias_cleanup": "SELECT * FROM (VALUES ('crimson', 'red'), ('nothing', 'unused'), ('offer', 'promo')) a(raw, canonical) WHERE canonical IN (SELECT unnest(string_split(lower(p_name), ' ')) FROM part UNION SELECT lower(p_type) FROM part)",
    "metadata_merge": f"WITH {EDGES} SELECT coalesce(o.tag, n.tag) AS tag, coalesce(n.count, o.count)::BIGINT AS count FROM (SELECT tag, count(*) AS count FROM e GROUP BY tag) o FULL JOIN (VALUES ('red', 1), ('fresh', 2)) n(tag, count) ON o.tag = n.tag",
    "semantic_filter": """WITH s AS (SELECT p_partkey AS symbol_id, list_concat(string_split(lower(p_name), ' '), [lower(p_type), 'service', 'io', lower(p_name)]) AS t,
list_concat([string_split(lower(p_name), ' ')[1]], list_concat([lower(p_brand), lower(p_type)], ['unit'])) AS low FROM part)
SELECT symbol_id, array_to_string(list_filter(t, lambda x, i: length(x) >= 3 AND NOT list_contains(low, x) AND x <> 'service' AND list_position(t, x) = i), ',') AS tags FROM s""",
    "tag_diff": f"""WITH {EDGES}, a AS (SELECT symbol_id, tag, CASE WHEN tag = 'promo' THEN 'custom' ELSE tag_type END AS tag_type FROM e WHERE NOT (tag = 'red' AND symbol_id % 3 = 0))
SELECT coalesce(e.symbol_id, a.symbol_id) AS symbol_id, coalesce(e.tag, a.tag) AS tag, coalesce(e.tag_type, a.tag_type) AS tag_type, CASE WHEN a.tag IS NULL THEN 'remove' ELSE 'add' END AS op FROM e FULL JOIN a ON e.symbol_id = a.symbol_id AND e.tag = a.tag AND e.tag_type = a.tag_type WHERE e.tag IS NULL OR a.tag IS NULL""",
    "tag_edit_fold": """WITH l AS (SELECT user_id::VARCHAR AS symbol_id, event_type AS tag, 'custom' AS tag_type, arg_max(value <= 20, event_id) AS adds FROM events GROUP BY ALL),
s(symbol_id, tag, tag_type) AS (VALUES ('7', 'click', 'custom'), ('-1', 'kept', 'base'))
SELECT coalesce(l.symbol_id, s.symbol_id) AS symbol_id, coalesce(l.tag, s.tag) AS tag, coalesce(l.tag_type, s.tag_type) AS tag_type FROM l FULL JOIN s ON l.symbol_id = s.symbol_id AND l.tag = s.tag AND l.tag_type = s.tag_type WHERE coalesce(adds, true)""",
    "usage_fold": f"WITH {EDGES}, {USAGE}, c AS (SELECT tag_type, tag, count(*) AS count, min(tag_type) OVER (PARTITION BY tag) AS first FROM e GROUP BY tag_type, tag) SELECT c.tag_type, c.tag, c.count, (CASE WHEN c.tag_type = 'base' AND c.tag = 'red' THEN 5 ELSE 0 END + CASE WHEN c.tag_type = first THEN coalesce(s, 0) ELSE 0 END)::BIGINT AS score FROM c LEFT JOIN u USING (tag)",
    "batch_assign": "SELECT tag, ((row_number() OVER (ORDER BY tag) - 1) // 100)::BIGINT AS batch FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_\\-]+')) AS tag FROM documents)",
    "bubble_scale": f"WITH {EDGES}, c AS (SELECT tag, count(*) AS count FROM e GROUP BY tag) SELECT tag, count, round(70 + pow(CASE WHEN min(count) OVER () = max(count) OVER () THEN 0.5 ELSE (count - min(count) OVER ()) / (max(count) OVER () - min(count) OVER ()) END, 1.15) * 120, 6) AS diameter FROM c",
}
