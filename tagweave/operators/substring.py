"""Substring joins of tables of strings, without comparing each with each.

A string that another contains has all its `GRAM`-character pieces there. So each
needle looks up one of its pieces, the one that the fewest haystack strings have, in
the postings (piece, string) of the haystack, and what it finds is verified. A
needle with a piece that no string has is dropped before the join. Pieces are
characters, not bytes; strings shorter than a piece only match when they are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 4  # the least length at which tags match by containment


def grams(c: Column, size: int = GRAM) -> Column:
    """Distinct pieces of `size` characters, in time linear in the string; none for shorter strings."""
    # a look ahead at each place that isn't the second half of a surrogate pair
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{size}}}))"), F.lit(1)))


def containing(needles: DataFrame, haystack: DataFrame, needle: str = "needle", hay: str = "hay", size: int = GRAM) -> DataFrame:
    """(needle, hay): the pairs of two tables of distinct strings in which hay contains needle, for needles of `size` characters or more."""
    postings = haystack.select(hay, F.explode(grams(F.col(hay), size)).alias("gram"))
    sizes = postings.groupBy("gram").agg(F.count("*").alias("n"))
    pieces = needles.select(needle, F.explode(grams(F.col(needle), size)).alias("gram")).join(sizes, "gram", "left")
    rarest = pieces.groupBy(needle).agg(F.min(F.struct("n", "gram")).alias("least"), F.count_if(F.col("n").isNull()).alias("missing")).filter("missing = 0").select(needle, F.col("least.gram").alias("gram"))
    return rarest.join(postings, "gram").filter(F.contains(hay, needle)).select(needle, hay)


def tag_pairs(terms: DataFrame, tags: DataFrame) -> DataFrame:
    """(term, tag): all pairs of the two tables of distinct strings that match as `text.tag_matches` says.

    Equal, or, with more than three characters each, one within the other; the empty string matches nothing.
    """
    equal = terms.join(tags, F.col("term") == F.col("tag")).filter("term <> ''").select("term", "tag")
    inside = containing(terms, tags, "term", "tag").filter("term <> tag").select("term", "tag")
    around = containing(tags, terms, "tag", "term").filter("term <> tag").select("term", "tag")
    return equal.unionByName(inside).unionByName(around)


def grouped_search_many(edges: DataFrame, queries: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(query_id, symbol_id, match_count, score) for a table of queries; for each as `search.grouped_search`.

    edges: (symbol_id, tag). queries: (query_id, grp, term, negative), a row for each term of each group; terms are
    normalized already. A query without positive groups finds nothing.
    """
    low = edges.select("symbol_id", F.lower("tag").alias("tag"))
    asked = queries.select("query_id", "grp", "term", F.coalesce("negative", F.lit(False)).alias("negative")).distinct()
    wanted = asked.filter("not negative").groupBy("query_id").agg(F.count_distinct("grp").alias("groups"))
    tags = low.select("tag").distinct()
    if scores is not None:
        usage = scores.groupBy(F.lower("tag").alias("tag")).agg(F.max("score").alias("usage"))
    met = asked.join(tag_pairs(asked.select("term").distinct(), tags), "term")
    # what a tag means for a query, before it meets the tag's symbols
    of_tag = met.groupBy("query_id", "tag").agg(F.max("negative").alias("bad"), F.collect_set(F.when(~F.col("negative"), F.col("grp"))).alias("hits"))
    of_tag = of_tag.withColumn("usage", F.lit(0)) if scores is None else of_tag.join(usage, "tag", "left")
    # only edges to tags that some query meets are dealt out
    low = low.join(of_tag.select("tag").distinct(), "tag", "left_semi").distinct()
    gain = F.when(F.size("hits") > 0, F.coalesce("usage", F.lit(0)) + 1).otherwise(0)
    found = of_tag.join(low, "tag").groupBy("query_id", "symbol_id").agg(F.max("bad").alias("bad"), F.size(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("match_count"), F.sum(gain).cast("long").alias("score"))
    whole = found.join(wanted, "query_id").filter("not bad and match_count = groups")
    return whole.select("query_id", "symbol_id", F.col("match_count").cast("long").alias("match_count"), "score")


def suggestions_many(tag_counts: DataFrame, queries: DataFrame, n: int = 8) -> DataFrame:
    """(query, tag, count, rank): for each of a table of distinct lower-case queries the n tags with the largest count that contain it.

    tag_counts: (tag, count), distinct tags. Queries shorter than a piece are looked up as they are, among pieces of
    their length; the empty query is contained in every tag, so it isn't asked.
    """
    asked = queries.select("query").filter("query <> ''").distinct()
    pairs = containing(asked, tag_counts.select("tag"), "query", "tag")
    for size in range(1, GRAM):
        short = asked.filter(F.length("query") == size)
        pairs = pairs.unionByName(short.join(tag_counts.select("tag", F.explode(grams(F.col("tag"), size)).alias("query")), "query").select("query", "tag"))
    order = Window.partitionBy("query").orderBy(F.desc("count"), "tag")
    return pairs.join(tag_counts, "tag").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("query", "tag", "count", "rank")
