"""Tables of queries against tables of tags: words of documents are tags, the documents are the symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import postings as P
from ..operators import substring as U
from ..settle import scratch_path
from . import bindings as B
from . import search_queries as Q


def _words(c: str):
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9_\-]+)"), F.lit(1))


def _edges(spark, d):
    """(symbol_id, tag): the distinct words of each row; rows of one doc_id may repeat them."""
    return B.read(spark, d, "documents").select(F.col("doc_id").alias("symbol_id"), F.explode(F.array_distinct(_words("text"))).alias("tag"))


def _queries(spark, d):
    """Each benchmark item asks for its first three words as groups, and excludes documents with `licensed`."""
    items = B.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(_words("text"), 1, 3).alias("w"))
    asked = items.select("query_id", F.posexplode("w").alias("grp", "term")).withColumn("negative", F.lit(False))
    return asked.unionByName(items.select("query_id", F.lit(9).alias("grp"), F.lit("licensed").alias("term"), F.lit(True).alias("negative")))


def search_many(spark, d):
    return U.grouped_search_many(_edges(spark, d), _queries(spark, d))


def suggest_many(spark, d):
    """The words of all benchmark items as what was typed so far, without their last letter."""
    counts = _edges(spark, d).distinct().groupBy("tag").agg(F.count("*").alias("count"))
    typed = B.read(spark, d, "benchmark").select(F.explode(_words("text")).alias("w")).select(F.expr("left(w, length(w) - 1)").alias("query"))
    return U.suggestions_many(counts, typed)


def _index(spark, rows, ident, fields) -> str:
    path = scratch_path(spark)
    P.write_postings(rows, ident, fields, path)
    return path


def _dealt(spark, symbols):
    """Symbols are few bytes each, so one task may read them all; they are dealt over the cluster for the work on their texts."""
    return symbols.repartition(4 * spark.sparkContext.defaultParallelism)


def keyword_indexed(spark, d):
    symbols = B.symbols(spark, d)
    return P.keyword_indexed(symbols, _index(spark, _dealt(spark, symbols), "symbol_id", P.symbol_fields(symbols)), Q.QUERY).select("symbol_id", "score")


def keyword_topn_indexed(spark, d):
    symbols = B.symbols(spark, d)
    return P.top_indexed(symbols, _index(spark, _dealt(spark, symbols), "symbol_id", P.symbol_fields(symbols)), Q.QUERY, 8, "symbol_id").select("symbol_id", "score")


def markdown_indexed(spark, d):
    docs = B.read(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return P.markdown_indexed(docs, _index(spark, docs, "path", {"content": F.col("content"), "path": F.col("path")}), "tionth")


QUERIES = {"tag_search_many": search_many, "tag_suggest_many": suggest_many, "keyword_indexed": keyword_indexed, "keyword_topn_indexed": keyword_topn_indexed, "markdown_indexed": markdown_indexed}

_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\\-]+')"
SQL = {
    "keyword_indexed": Q.SQL["keyword_search"],
    "keyword_topn_indexed": Q.SQL["keyword_topn"],
    "markdown_indexed": f"SELECT * FROM ({Q.SQL['markdown_search'].replace('tion', 'tionth').replace('// 4', '// 6')}) WHERE score > 0",
    "tag_search_many": f"""WITH e AS (SELECT DISTINCT doc_id AS symbol_id, unnest({_WORDS}) AS tag FROM documents),
i AS (SELECT item_id AS query_id, {_WORDS}[1:3] AS w FROM benchmark),
q AS (SELECT query_id, generate_subscripts(w, 1) - 1 AS grp, unnest(w) AS term, false AS negative FROM i UNION SELECT query_id, 9, 'licensed', true FROM i),
t AS (SELECT DISTINCT tag FROM e),
m AS (SELECT term, tag FROM (SELECT DISTINCT term FROM q) JOIN t ON CASE WHEN least(length(term), length(tag)) <= 3 THEN term = tag ELSE contains(tag, term) OR contains(term, tag) END),
h AS (SELECT query_id, symbol_id, bool_or(negative) AS bad, count(DISTINCT grp) FILTER (NOT negative) AS match_count, count(DISTINCT tag) FILTER (NOT negative) AS score FROM q JOIN m USING (term) JOIN e USING (tag) GROUP BY ALL)
SELECT query_id, symbol_id, match_count, score FROM h JOIN (SELECT query_id, count(DISTINCT grp) AS n FROM q WHERE NOT negative GROUP BY query_id) USING (query_id) WHERE NOT bad AND match_count = n""",
    "tag_suggest_many": f"""WITH c AS (SELECT tag, count(*) AS count FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS tag FROM documents) GROUP BY tag),
q AS (SELECT DISTINCT left(w, length(w) - 1) AS query FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) WHERE length(w) > 1)
SELECT * FROM (SELECT query, tag, count, row_number() OVER (PARTITION BY query ORDER BY count DESC, tag)::INT AS rank FROM q JOIN c ON contains(tag, query)) WHERE rank <= 8""",
}
