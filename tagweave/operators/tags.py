"""Tag tables: index, aliases, categories, graph, drill-down, edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..settle import settled

HOPS = 10
TYPE_RANK = "case tag_type when 'base' then 0 when 'semantic' then 1 else 2 end"


def edges_of(symbols: DataFrame, **arrays: str) -> DataFrame:
    """(symbol_id, tag, tag_type, pos) from array columns, given as tag_type=column; each type keeps its own edge."""
    parts = [symbols.select("symbol_id", F.posexplode(c).alias("pos", "tag"), F.lit(t).alias("tag_type")) for t, c in arrays.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("symbol_id", "tag", "tag_type", "pos")


def index_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("tag_type", "tag").agg(F.count("*").alias("count"))


def shifted_counts(index: DataFrame, gone: DataFrame, came: DataFrame) -> DataFrame:
    """index_counts of a set of edges, from the counts before and the edges that went and came; work grows with these."""
    part = lambda edges, by: edges.groupBy("tag_type", "tag").agg((F.count("*") * by).alias("count"))
    every = index.select("tag_type", "tag", "count").unionByName(part(gone, -1)).unionByName(part(came, 1))
    return every.groupBy("tag_type", "tag").agg(F.sum("count").alias("count")).filter("count > 0")


def index_scores(counts: DataFrame, previous: DataFrame) -> DataFrame:
    """Counts with the scores that the previous index had for (tag_type, tag)."""
    return counts.join(previous.select("tag_type", "tag", "score"), ["tag_type", "tag"], "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("long"))


def type_of_tags(edges: DataFrame) -> DataFrame:
    """(tag, tag_type): base before semantic before custom."""
    return edges.groupBy("tag").agg(F.min(F.struct(F.expr(TYPE_RANK).alias("r"), "tag_type")).alias("t")).select("tag", F.col("t.tag_type").alias("tag_type"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """(tag, tag_type, count): the tags with the number of their symbols, which is summed before the shuffle."""
    nodes = edges.select("symbol_id", "tag").distinct().groupBy("tag").agg(F.count("*").alias("count"))
    return nodes.join(type_of_tags(edges), "tag").select("tag", "tag_type", "count")


def ranked_nodes(edges: DataFrame) -> DataFrame:
    """graph_nodes in the order of the tag graph: most symbols first, equal ones by tag."""
    return graph_nodes(edges).orderBy(F.desc("count"), "tag")


def graph_items(edges: DataFrame) -> DataFrame:
    """(tag, symbol_id): the symbols of each tag as rows, in order; no tag is gathered in one row."""
    return edges.select("tag", "symbol_id").distinct().orderBy("tag", "symbol_id")


def graph(edges: DataFrame) -> DataFrame:
    """(tag, tag_type, count, items): the symbols of each tag as one list, for results that are shown; see graph_items for large tags."""
    nodes = edges.select("symbol_id", "tag").distinct().groupBy("tag").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("symbol_id")).alias("items"))
    return nodes.join(type_of_tags(edges), "tag").select("tag", "tag_type", "count", "items")


def drill_down(edges: DataFrame, selected: Sequence[str]) -> DataFrame:
    """(symbol_id, tags): symbols that have all selected tags."""
    wanted = list(dict.fromkeys(selected))
    hit = edges.filter(F.col("tag").isin(wanted)).groupBy("symbol_id").agg(F.countDistinct("tag").alias("n")).filter(F.col("n") == len(wanted)).select("symbol_id")
    return edges.join(hit, "symbol_id", "left_semi").groupBy("symbol_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def type_counts(edges: DataFrame) -> DataFrame:
    """One row: distinct tags in all and of each type."""
    tags = type_of_tags(edges)
    one = lambda t: F.count(F.when(F.col("tag_type") == t, 1)).alias(t)
    return tags.agg(F.count("*").alias("total"), one("base"), one("semantic"), one("custom"))


def with_type(nodes: DataFrame, tag_type: str = "all") -> DataFrame:
    return nodes if tag_type == "all" else nodes.filter(F.col("tag_type") == tag_type)


def bubble_sizes(counts: DataFrame, least: float = 70, most: float = 190) -> DataFrame:
    """Diameter of each tag's bubble: counts scaled between the extremes, to the power 1.15; half way if all are equal."""
    ends = counts.agg(F.min("count").alias("lo"), F.max("count").alias("hi"))  # one row
    share = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("count") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
    return counts.join(F.broadcast(ends)).withColumn("diameter", F.round(least + F.pow(share, 1.15) * (most - least), 6)).drop("lo", "hi")


def resolve_aliases(tags: DataFrame, aliases: DataFrame, hops: int = HOPS) -> DataFrame:
    """(tag, canonical) of distinct tags: at most `hops` steps along the aliases, stopping before a tag seen already.

    Each round joins only the tags that moved in the round before and is written, so the plan doesn't grow;
    rounds end when no tag moves.
    """
    now = settled(tags.select("tag").distinct().withColumns({"canonical": F.col("tag"), "path": F.array("tag")}))
    steps = aliases.select(F.col("raw").alias("canonical"), F.col("canonical").alias("next"))
    moves = F.coalesce(F.col("next").isNotNull() & ~F.array_contains("path", F.coalesce("next", F.lit(""))), F.lit(False))
    done = None
    for _ in range(hops):
        joined = settled(now.join(steps, "canonical", "left").withColumn("moves", moves))
        rest = joined.filter("not moves").select("tag", "canonical")
        done = rest if done is None else done.unionByName(rest)
        now = joined.filter("moves").select("tag", F.col("next").alias("canonical"), F.concat("path", F.array("next")).alias("path"))
        if now.isEmpty():
            return done
    return done.unionByName(now.select("tag", "canonical"))


def cyclic_aliases(aliases: DataFrame) -> DataFrame:
    """Raw names whose chain reaches a cycle, by doubling steps: a chain that never ends is on or leads to a cycle.

    After n doublings every chain of at most 2**n steps has ended. Rounds are written and end when none has ended:
    a longer chain that ends has names on it whose own chains are of every lesser length.
    """
    now = settled(aliases.select("raw", F.col("canonical").alias("at")))
    left = now.count()
    while True:
        now = settled(now.alias("a").join(now.alias("b"), F.col("a.at") == F.col("b.raw")).select(F.col("a.raw").alias("raw"), F.col("b.at").alias("at")))
        before, left = left, now.count()
        if left == before or not left:
            return now.select("raw").distinct()


def without_cycles(aliases: DataFrame) -> DataFrame:
    return aliases.join(cyclic_aliases(aliases), "raw", "left_anti")


def unknown_tags(tags: DataFrame, aliases: DataFrame, categories: DataFrame) -> DataFrame:
    """Distinct tags that are no alias, no target of one and no category."""
    known = aliases.select(F.col("raw").alias("tag")).union(aliases.select("canonical")).union(categories.select("tag"))
    return tags.select("tag").distinct().join(known.distinct(), "tag", "left_anti")


def category_counts(categories: DataFrame, tags: DataFrame) -> DataFrame:
    """Categories with their counts taken anew; unused ones have 0."""
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"))
    return categories.select("tag").join(counts, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("count"))


def with_categories(categories: DataFrame, tags: DataFrame) -> DataFrame:
    fresh = tags.select("tag").distinct().join(categories, "tag", "left_anti").select("tag", F.lit(0).cast("long").alias("count"))
    return categories.select("tag", "count").unionByName(fresh)


def used_only(categories: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Categories in use, and the aliases that lead to them."""
    used = categories.filter("count > 0")
    return used, aliases.join(used.select(F.col("tag").alias("canonical")), "canonical", "left_semi").select("raw", "canonical")


def merge_maps(existing: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """Both tables' keys; the incoming value wins."""
    return existing.select(key, F.col(value).alias("__old")).join(incoming.select(key, F.col(value).alias("__new")), key, "full").select(key, F.coalesce("__new", "__old").alias(value))


def frequency(symbols: DataFrame) -> DataFrame:
    """(tag, count) over the semantic tags of each symbol, or its base tags where it has none."""
    return _sources(symbols).groupBy("tag").agg(F.count("*").alias("count"))


def _sources(symbols: DataFrame) -> DataFrame:
    picked = F.when(F.size(F.coalesce("semantic", X.strings())) > 0, F.col("semantic")).otherwise(F.coalesce("base", X.strings()))
    return symbols.select("symbol_id", F.posexplode(F.filter(F.transform(picked, X.clean_tag), lambda t: t != "")).alias("pos", "tag"))


def normalization_counts(symbols: DataFrame) -> DataFrame:
    """One row: base and semantic tags as given, semantic ones left after normalization, all left, and distinct ones of both.

    symbols: symbol_id and the arrays base and semantic.
    """
    given = symbols.select(F.coalesce("base", X.strings()).alias("base"), F.coalesce("semantic", X.strings()).alias("semantic"))
    left = given.select("*", X.index_tags(F.col("base")).alias("b"), X.index_tags(F.col("semantic")).alias("s"))
    sums = left.agg(F.sum(F.size("base")).alias("raw_base"), F.sum(F.size("semantic")).alias("raw_semantic"), F.sum(F.size("s")).alias("semantic"), F.sum(F.size("b") + F.size("s")).alias("total"))
    one = left.select(F.explode("s").alias("tag"), F.lit(1).alias("is_s")).unionAll(left.select(F.explode("b"), F.lit(0))).groupBy("tag").agg(F.max("is_s").alias("is_s"))
    distinct = one.agg(F.sum("is_s").alias("distinct_semantic"), F.count("*").alias("distinct_total"))
    return sums.join(F.broadcast(distinct))  # one row each


def primary_tags(symbols: DataFrame) -> DataFrame:
    """(symbol_id, tag): the most frequent tag of each symbol, the earlier one of equals."""
    rows = _sources(symbols)
    counts = rows.groupBy("tag").agg(F.count("*").alias("count"))
    best = rows.join(counts, "tag").groupBy("symbol_id").agg(F.max(F.struct("count", (-F.col("pos")).alias("back"), "tag")).alias("b"))
    return best.select("symbol_id", F.col("b.tag").alias("tag"))


def clusters(symbols: DataFrame, least: int = 3, by_path_from: int = 300) -> DataFrame:
    """(symbol_id, cluster_id, title, kind): by primary tag, small groups by path; all by path over `by_path_from` symbols.

    kind tells tag and path groups apart, so groups of one name don't overwrite each other.
    """
    path = F.coalesce(F.nullif(X.slugify(F.col("hint")), F.lit("")), F.lit("misc"))
    if symbols.limit(by_path_from + 1).count() > by_path_from:
        out = symbols.select("symbol_id", path.alias("cluster_id"), F.lit("path").alias("kind"))
    else:
        tagged = symbols.select("symbol_id", "hint").join(primary_tags(symbols), "symbol_id", "left").withColumn("slug", F.coalesce(X.slugify(F.col("tag")), F.lit("")))
        sized = tagged.withColumn("n", F.count("*").over(W.partitionBy("slug")))
        big = (F.col("slug") != "") & (F.col("n") >= least)
        out = sized.select("symbol_id", F.when(big, F.col("slug")).otherwise(path).alias("cluster_id"), F.when(big, "tag").otherwise("path").alias("kind"))
    return out.withColumn("title", X.title_from_id(F.col("cluster_id")))


def tag_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(symbol_id, tag, tag_type, op): edges to remove and to add; another type is a removal and an addition."""
    key = ["symbol_id", "tag", "tag_type"]
    gone = before.select(key).join(after.select(key), key, "left_anti").withColumn("op", F.lit("remove"))
    return gone.unionByName(after.select(key).join(before.select(key), key, "left_anti").withColumn("op", F.lit("add")))


def batches(tags: DataFrame, size: int = 100) -> DataFrame:
    """(tag, batch): consecutive batches of sorted distinct tags, numbered without one global sort task.

    Range partitions are counted first; a tag's number is its place in its partition plus the counts before it.
    """
    n_parts = int(tags.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number isn't coalesced later
    parts = tags.select("tag").distinct().repartitionByRange(n_parts, "tag").sortWithinPartitions("tag").withColumn("part", F.spark_partition_id())
    local = parts.withColumn("n", F.row_number().over(W.partitionBy("part").orderBy("tag")))
    ahead = local.groupBy("part").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(ahead), "part").select("tag", F.floor((F.col("before") + F.col("n") - 1) / size).cast("long").alias("batch"))


def category_sample(categories: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    return categories.orderBy(F.xxhash64("tag", F.lit(seed)), "tag").limit(n)


def alias_groups(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("canonical").agg(F.array_sort(F.collect_set("raw")).alias("raws"))


def groups_to_aliases(groups: DataFrame) -> DataFrame:
    """(raw, canonical) rows of a map column `groups`: canonical to its tags."""
    return groups.select(F.explode("groups").alias("canonical", "raws")).select(F.explode("raws").alias("raw"), "canonical").filter("raw <> canonical").distinct()


def merged_groups(groups: DataFrame) -> DataFrame:
    """(grp, term, merged): for rows (grp, term) the least group that can be reached over shared terms; as `search.merge_groups` for groups that don't fit a driver.

    Least labels with pointer jumping on written tables: rounds grow with the logarithm of the longest chain, and a
    term or group that many rows have is combined before each shuffle.
    """
    rows = settled(groups.select("grp", "term").distinct())
    labels = settled(rows.groupBy("grp").agg(F.min("grp").alias("merged")))
    while True:
        by_term = rows.join(labels, "grp").groupBy("term").agg(F.min("merged").alias("near"))
        near = rows.join(by_term, "term").groupBy("grp").agg(F.min("near").alias("near"))
        low = labels.join(near, "grp").select("grp", "merged", F.least("merged", "near").alias("low"))
        jump = low.join(labels.select(F.col("grp").alias("low"), F.col("merged").alias("far")), "low")
        after = settled(jump.select("grp", F.col("merged").alias("was"), F.least("low", "far").alias("merged")))
        if after.filter("merged < was").isEmpty():
            return rows.join(after.select("grp", "merged"), "grp").select("grp", "term", "merged")
        labels = after.select("grp", "merged")


# --- edits and usage as logs ---------------------------------------------------------------------


def usage_scores(log: DataFrame) -> DataFrame:
    """(tag, score): how often each tag was asked for."""
    return log.groupBy("tag").agg(F.count("*").alias("score"))


def bumped_index(index: DataFrame, log: DataFrame) -> DataFrame:
    """The tag index with usage added to the first type (base, semantic, custom) that has the tag."""
    first = index.groupBy("tag").agg(F.min(F.expr(TYPE_RANK)).alias("r"))
    bump = usage_scores(log).select("tag", F.col("score").alias("bump")).join(first, "tag")
    hit = index.withColumn("r", F.expr(TYPE_RANK)).join(bump, ["tag", "r"], "left")
    return hit.select("tag_type", "tag", "count", (F.col("score") + F.coalesce("bump", F.lit(0))).alias("score"))


def folded_edits(edges: DataFrame, log: DataFrame) -> DataFrame:
    """Edges after add and remove edits: the last edit of an edge decides, at equal sequence an addition.

    An edge that stays keeps its place `pos`, if the edges have one; added ones come last.
    """
    key = ["symbol_id", "tag", "tag_type"]
    placed = "pos" in edges.columns
    edits = log.filter("op in ('add', 'remove')").select("symbol_id", X.clean_tag(F.col("value")).alias("tag"), "tag_type", "seq", "op").filter("tag <> ''")
    last = edits.groupBy(*key).agg(F.max(F.struct("seq", (F.col("op") == "add").cast("int").alias("adds"))).alias("l")).select(*key, F.col("l.adds").alias("adds"))
    own = edges.groupBy(*key).agg(F.min("pos").alias("pos")) if placed else edges.select(key).distinct()
    kept = own.withColumn("has", F.lit(True)).join(last, key, "full").filter("coalesce(adds, case when has then 1 else 0 end) = 1")
    return kept.select(*key, F.coalesce("pos", F.lit((1 << 31) - 1)).cast("int").alias("pos")) if placed else kept.select(*key)


def folded_briefs(symbols: DataFrame, log: DataFrame) -> DataFrame:
    last = log.filter("op = 'brief'").groupBy("symbol_id").agg(F.max_by("value", "seq").alias("__brief"))
    return symbols.join(last, "symbol_id", "left").withColumn("brief", F.coalesce("__brief", "brief")).drop("__brief")


def folded_index(before: DataFrame, after: DataFrame, index: DataFrame) -> DataFrame:
    """The tag index after edits: counts of the edges left; a tag whose last use went stays with 0."""
    counts = index_counts(after).select("tag_type", "tag", F.col("count").alias("n"))
    return index.join(counts, ["tag_type", "tag"], "full").select("tag_type", "tag", F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("score", F.lit(0)).alias("score"))
