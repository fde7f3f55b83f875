"""Search over symbols and their tags.

Queries are small and are parsed on the driver; their terms become literal
arrays, so matching is a projection over the distinct tags, which is joined
back to the edges by equality. Nothing of the size of the data is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

Groups = list[list[str]]


def parse_groups(args: Sequence[str]) -> tuple[Groups, Groups]:
    """Positive and negative groups of words such as `a|b` and `!c` or `-c`."""
    positive, negative = [], []
    for arg in args:
        word = arg.strip()
        target = negative if word[:1] in ("!", "-") else positive
        terms = [t.strip() for t in (word[1:] if target is negative else word).split("|")]
        if any(terms):
            target.append([t for t in terms if t])
    return positive, negative


def parse_keywords(query: str) -> tuple[list[str], list[str]]:
    """Lower-cased keywords and required #tags of a query."""
    words = query.lower().split()
    return [w for w in words if not w.startswith("#")], [w[1:] for w in words if w.startswith("#") and len(w) > 1]


def merge_groups(groups: Groups) -> Groups:
    """Groups that share a term become one, as often as that happens; terms sorted."""
    merged: list[set[str]] = []
    for group in groups:
        own = set(group)
        apart = []
        for other in merged:
            if own & other:
                own |= other
            else:
                apart.append(other)
        merged = [*apart, own]
    return [sorted(g) for g in merged]


def normalized_groups(spark, groups: Groups, how: str = "query") -> Groups:
    """Terms normalized as on the query path, or as on the index path with how="index"."""
    terms = sorted({t for g in groups for t in g})
    if not terms:
        return []
    fn = X.index_tag if how == "index" else X.query_tag
    table = {r.t: r.n for r in spark.createDataFrame([(t,) for t in terms], "t string").select("t", fn(F.col("t")).alias("n")).collect()}
    return [g for g in ([table[t] for t in group if table[t]] for group in groups) if g]


def expand_groups(groups: Groups, aliases: DataFrame) -> Groups:
    """Every term with its canonical form and all aliases of that: one hop; then groups that overlap are merged."""
    terms = sorted({t for g in groups for t in g})
    if not terms:
        return []
    hit = aliases.filter(F.col("raw").isin(terms)).select("canonical").union(aliases.filter(F.col("canonical").isin(terms)).select("canonical")).distinct()
    near = aliases.join(F.broadcast(hit), "canonical", "left_semi").collect()  # the aliases of the query's terms
    of = {r.raw: r.canonical for r in near}
    raws: dict[str, set[str]] = {}
    for raw, canonical in of.items():
        raws.setdefault(canonical, set()).add(raw)
    wide = [sorted({x for t in g for c in [of.get(t, t)] for x in {t, c} | raws.get(c, set())}) for g in groups]
    return merge_groups(wide)


def _hits(tag: Column, groups: Groups) -> Column:
    """Numbers of the groups that a tag matches."""
    numbers = [F.when(F.exists(X.strings(*g), lambda q: X.tag_matches(q, tag)), F.lit(i)) for i, g in enumerate(groups)]
    return F.array_compact(F.array(*numbers)) if numbers else F.array().cast("array<int>")


def grouped_search(edges: DataFrame, groups: Groups, negative: Groups = (), scores: DataFrame | None = None) -> DataFrame:
    """(symbol_id, match_count, score) of symbols that match all groups and no negative one.

    edges: (symbol_id, tag). scores: (tag, score). The score adds the scores of the matched tags and their number.
    """
    low = edges.select("symbol_id", F.lower("tag").alias("tag")).distinct()
    dim = low.select("tag").distinct().withColumns({"hits": _hits(F.col("tag"), groups), "bad": F.size(_hits(F.col("tag"), list(negative))) > 0}).filter("bad or size(hits) > 0")
    if scores is not None:
        dim = dim.join(scores.groupBy(F.lower("tag").alias("tag")).agg(F.max("score").alias("usage")), "tag", "left")
    else:
        dim = dim.withColumn("usage", F.lit(0))
    met = low.join(dim, "tag")
    per_symbol = met.groupBy("symbol_id").agg(
        F.max("bad").alias("bad"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("groups"),
        F.sum(F.when(F.size("hits") > 0, F.coalesce("usage", F.lit(0)) + 1).otherwise(0)).cast("long").alias("score"),
    )
    return per_symbol.filter(~F.col("bad") & (F.size("groups") == len(groups))).select("symbol_id", F.size("groups").cast("long").alias("match_count"), "score")


def ranked(found: DataFrame, seq: str = "symbol_id") -> DataFrame:
    return found.orderBy(F.desc("score"), F.desc("match_count"), seq)


def score_map(tag_index: DataFrame) -> DataFrame:
    """(tag, score): where several types have a tag, custom wins over semantic over base."""
    rank = F.when(F.col("tag_type") == "custom", 3).when(F.col("tag_type") == "semantic", 2).otherwise(1)
    return tag_index.groupBy("tag").agg(F.max_by("score", rank).alias("score"))


WEIGHTS = {"module": 2, "symbol_id": 3, "file_path": 1, "semantic": 4, "base": 1, "custom": 1, "signature": 1, "brief": 2}


def keyword_search(symbols: DataFrame, query: str, legacy_weights: bool = False) -> DataFrame:
    """symbols with `score`, for a query of keywords and #tags; no shuffle.

    symbols: module, symbol_id, file_path, signature, brief and the arrays base, semantic, custom. With
    legacy_weights all tags weigh as base tags do.
    """
    keywords, required = parse_keywords(query)
    tags = {t: F.transform(F.coalesce(t, X.strings()), F.lower) for t in ("base", "semantic", "custom")}
    every = F.concat(*tags.values())
    score = F.lit(0)
    for word in keywords:
        for name in ("module", "symbol_id", "file_path", "signature"):
            score = score + F.when(F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(word)), WEIGHTS[name]).otherwise(0)
        for name in ("semantic", "base", "custom"):
            source = every if legacy_weights and name == "base" else X.strings() if legacy_weights else tags[name]
            score = score + F.when(F.exists(source, lambda t: F.contains(t, F.lit(word))), WEIGHTS[name]).otherwise(0)
        score = score + WEIGHTS["brief"] * X.occurrences(F.lower(F.coalesce("brief", F.lit(""))), F.lit(word))
    out = symbols
    for tag in required:
        out = out.filter(F.array_contains(every, tag))
    out = out.withColumn("score", score + 5 * len(required))
    return out if required else out.filter("score > 0")


def top(found: DataFrame, n: int, *ties: str) -> DataFrame:
    return found.orderBy(F.desc("score"), *ties).limit(max(1, n))


def markdown_search(docs: DataFrame, query: str, path: str = "path", content: str = "content", min_score: int = 0) -> DataFrame:
    """(path, title, preview, score): 3 for a title with the query, and its occurrences in the text; zero scores stay by default."""
    q = F.lit(query.lower())
    title = X.doc_title(F.col(content), F.col(path))
    score = F.when((q != "") & F.contains(F.lower(title), q), 3).otherwise(0) + X.occurrences(F.lower(content), q)
    return docs.select(F.col(path).alias("path"), title.alias("title"), X.preview(F.col(content)).alias("preview"), score.alias("score")).filter(F.col("score") >= min_score)


def ranked_docs(found: DataFrame, path: str = "path") -> DataFrame:
    """Documents of a search, best first; equal scores by path."""
    return found.orderBy(F.desc("score"), path)


BLOCK_LINES = 4096  # lines of a file that one task looks at together


def nearest_symbols(cursors: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each (file_path, line) of cursors the symbol of that file with the nearest line; ties go to the first symbol.

    An as-of join both ways: cursors and the symbols' lines are one sequence, in which each cursor takes the last line
    with a symbol at or before it and the first at or after it. A file is cut into blocks of `BLOCK_LINES` lines; what lies
    beyond a block's ends comes from the blocks' own first and last symbols. Work grows with cursors plus symbols.
    """
    lines = F.explode(F.array_distinct(F.array_compact(F.array("decl_line", "impl_line"))))
    spots = symbols.select("file_path", lines.alias("line"), F.struct("seq", "symbol_id").alias("spot"))
    asked = cursors.select("file_path", "line", F.lit(True).alias("asks"))
    every = spots.withColumn("asks", F.lit(False)).unionByName(asked, allowMissingColumns=True).withColumn("block", F.floor(F.col("line") / BLOCK_LINES))
    # dealt by block, so that the grouping by line and the windows need no other shuffle
    rows = every.repartition("file_path", "block").groupBy("file_path", "block", "line").agg(F.max("asks").alias("asks"), F.min("spot").alias("spot"))
    here = F.when(F.col("spot").isNotNull(), F.struct("line", "spot"))
    inside = Window.partitionBy("file_path", "block").orderBy("line")
    near = rows.select(
        "file_path", "block", "line", "asks",
        F.last(here, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("before"),
        F.first(here, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("after"),
    ).filter("asks")
    along = Window.partitionBy("file_path").orderBy("block")
    ends = rows.groupBy("file_path", "block").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    beyond = ends.select(
        "file_path", "block",
        F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    met = near.join(beyond, ["file_path", "block"]).withColumns({"before": F.coalesce("before", "earlier"), "after": F.coalesce("after", "later")})
    of = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.line") - F.col("line")).alias("distance"), F.col(f"{c}.spot").alias("spot")))
    best = met.withColumn("b", F.least(of("before"), of("after"))).filter("b is not null")
    return best.select("file_path", "line", F.col("b.spot.symbol_id").alias("symbol_id"), F.col("b.distance").alias("distance"))


def api_prompt(hits: DataFrame, code: str, order: Sequence[str] = ("score",)) -> DataFrame:
    """One row `prompt`: the hits as a list and the code they are asked for; hits are a short list already."""
    line = F.concat(F.lit("- "), F.coalesce("signature", F.col("symbol_id").cast("string")), F.lit(" ["), F.coalesce("module", F.lit("unknown")), F.lit("] "), F.coalesce("brief", F.lit("N/A")))
    rows = hits.select(F.struct(*[(-F.col(c)).alias(c) for c in order], F.col("symbol_id"), line.alias("line")).alias("x"))
    listed = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.line), "\n").alias("apis"))
    return listed.select(F.concat(F.lit("Available APIs:\n"), "apis", F.lit("\n\nCode:\n"), F.lit(code)).alias("prompt"))


def docs_prompt(hits: DataFrame, code: str) -> DataFrame:
    """One row `prompt`: chosen documents (path, content) one after another, and the code they are asked for."""
    block = F.concat(F.lit("## "), "path", F.lit("\n"), "content")
    joined = hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", block.alias("b")))), lambda x: x.b), "\n\n").alias("docs"))
    return joined.select(F.concat("docs", F.lit("\n\nCode:\n"), F.lit(code)).alias("prompt"))


def auto_query(selection: str = "", line: str = "", file_name: str = "") -> str:
    return next((x.strip() for x in (selection, line, file_name) if x and x.strip()), "")


def printed(found: DataFrame) -> DataFrame:
    """One line of text for each hit, as a command line prints it."""
    return found.select(F.format_string("%s (matches %d, score %d)", "symbol_id", "match_count", "score").alias("line"))


def suggestions(tag_counts: DataFrame, query: str, n: int = 8) -> DataFrame:
    return tag_counts.filter(F.contains("tag", F.lit(query.lower()))).orderBy(F.desc("count"), "tag").limit(n)


def single_tag(symbols: DataFrame, tag: str, limit: int | None = None) -> DataFrame:
    """Symbols one of whose base or semantic tags contains the tag or is contained in it, whatever their lengths; the first `limit` if asked for.

    symbols: symbol_id and the arrays base and semantic.
    """
    q = F.lit(tag.strip().lower())
    low = F.transform(F.concat(F.coalesce("semantic", X.strings()), F.coalesce("base", X.strings())), F.lower)
    found = symbols.filter(F.exists(low, lambda t: F.contains(t, q) | F.contains(q, t)))
    return found if limit is None else found.orderBy("symbol_id").limit(limit)


def auto_prompt(symbols: DataFrame, code: str, selection: str = "", line: str = "", file_name: str = "", n: int = 8) -> DataFrame:
    """One row `prompt`: the n best symbols for what is selected, or the line, or the file name, and the code they are asked for."""
    hits = top(keyword_search(symbols, auto_query(selection, line, file_name)), n, "symbol_id")
    return api_prompt(hits, code)
