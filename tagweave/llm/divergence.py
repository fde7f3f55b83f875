"""Divergence audit of sources: which sources of a language differ, and by which terms.

Terms are runs of letters (A-Z lower-cased) and of bytes beyond ASCII. A language keeps
the V terms that at least `LEAST_DOCS` of its documents have. A group is a (lang,
source); with count occurrences of a term among the N of all kept terms it gives
the term p = 1 + floor(1000000000 * (count + 1) / (N + V)). The divergence at a term
is floor((p - q) * (p - q) / q). Part `pair` sums it up for each two sources of a
language; part `term` names, for a group against its language, the `TOP` terms of
largest divergence among those that the group has and prefers (p > q).

Pairs come from postings. A group gives all terms that it lacks one value, so
the sum over all kept terms is: V times the divergence of both groups' values of
lacking terms, plus what the terms of either group change about that, by counts of
terms with equal count, plus a correction for the terms that both have. Only the
last goes through the postings, a row of (group, p) for each term, and is summed
up in numpy before it is shuffled.

Terms come from an upper-bound search. The terms of a group lie in buckets of equal
or nearly equal count. With the largest count and the least probability in the
language a bucket has a bound of the divergence of its terms. Buckets are evaluated best
bound first, in waves of `TOP`, then `TOP * 4`, ... terms a group, until the unseen
bounds of a group are below the divergence of its term in place `TOP`. The waves
are joins of all groups at once.

Arithmetic is by whole numbers, exact below 9 * 10**15 occurrences in a group.

Defined cases: a null text, lang or source is an empty string; a group without kept terms has pairs, but no terms; a
language with V = 0 has pairs of value 0; repeated rows are documents of their own; a
text of any length is counted whole (a task needs about 20 bytes for each byte of its
longest text); an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, scratch, stored, table
from .textnum import byte_class, column_of, lower_ascii, row_slices, span_ids, string_bytes, words_of

SCALE = 1000  # of which the third power is the scale of probabilities
LEAST_DOCS = 3
TOP = 200
SLICE = 4 << 20
PAIR_ROWS = 1 << 20
TERM_BYTES = byte_class([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def _gathered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow string column."""
    sizes = ends - starts
    offs = np.concatenate([[0], np.cumsum(sizes)])
    data = buf[np.arange(offs[-1]) + np.repeat(starts - offs[:-1], sizes)]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data))


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed up in each slice of `SLICE` bytes and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, "__text", SLICE):
            buf, offs = string_bytes(column_of(part, "__text"))
            buf = lower_ascii(buf)
            starts, ends, first = words_of(buf, offs, TERM_BYTES)
            if not len(starts):
                continue
            lang, source = (pc.dictionary_encode(column_of(part, c)) for c in ("lang", "source"))
            wide = len(source.dictionary)
            groups, group = np.unique(lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy(), return_inverse=True)
            ids = span_ids(buf, starts, ends)
            terms, sample = np.unique(ids, return_index=True)
            size = int(terms[-1]) + 1
            row = np.repeat(np.arange(part.num_rows), np.diff(first))
            cells, n = np.unique(group[row] * size + ids, return_counts=True)
            seen = np.unique(row * size + ids)  # each term of each document
            docs_of = np.zeros(len(cells), np.int64)
            at = np.searchsorted(cells, group[seen // size] * size + seen % size)
            np.add.at(docs_of, at, 1)
            where = np.zeros(size, np.int64)
            where[terms] = sample
            span = where[cells % size]
            code = groups[cells // size]
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(code // wide)), source.dictionary.take(pa.array(code % wide)), _gathered(buf, starts[span], ends[span]), pa.array(n, pa.int64()), pa.array(docs_of, pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.col(f"`{text}`").alias("__text"))
    counts = arrow_map(plain, run, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: str, total: str) -> Column:
    """1 + floor(SCALE**3 * (count + 1) / total) by long division, so that no product leaves 63 bits."""
    whole, rest = f"({SCALE} * ({count} + 1))", f"({total})"
    second = f"({SCALE} * ({whole} % {rest}))"
    third = f"({SCALE} * ({second} % {rest}))"
    return F.expr(f"1 + {SCALE * SCALE} * ({whole} div {rest}) + {SCALE} * ({second} div {rest}) + {third} div {rest}")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


class Audit:
    """The written tables of an audit: groups, postings of kept terms, and (group, term) cells."""

    def __init__(self, docs: DataFrame, text: str = "text") -> None:
        named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        per_term = term_counts(docs, text).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("held"))
        #: A row for each kept term of a language, with the sources that have it.
        self.kept = stored(per_term.filter(F.col("docs") >= LEAST_DOCS).drop("docs"))
        langs = self.kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        sums = self.kept.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("total"))
        every = named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
        has = F.col("v") > 0
        #: A row for each group: number, kept occurrences, V, those of the language, and the value of terms that the group lacks.
        self.groups = stored(every.select(F.monotonically_increasing_id().alias("g"), "*", F.when(has, probability("0", "total + v")).alias("p0")))
        cells = self.kept.select("lang", "term", "lang_n", F.explode("held").alias("h")).select("lang", F.col("h.source").alias("source"), "term", "lang_n", F.col("h.n").alias("n"))
        self.cells = stored(
            cells.join(self.groups, ["lang", "source"]).select("g", "lang", "term", "n", probability("n", "total + v").alias("p"), probability("lang_n", "lang_total + v").alias("q"), "p0")
        )


def _pair_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, part) of the terms that both groups have: what f(p, q) differs by from the sum of the one-sided changes."""
    for batch in batches:
        held = column_of(batch, "held")
        flat = held.flatten()
        g, p, p0 = (flat.field(i).to_numpy() for i in range(3))
        begin = held.offsets.to_numpy().astype(np.int64) - held.offsets[0].as_py()
        size = np.diff(begin)
        own = np.repeat(np.arange(len(size)), size)
        steps = np.concatenate([[0], np.cumsum(size[own])])  # each cell meets all cells of its posting
        low = 0
        while low < len(own):
            high = max(low + 1, int(np.searchsorted(steps, steps[low] + PAIR_ROWS, "right")) - 1)
            many = size[own[low:high]]
            a = np.repeat(np.arange(low, high), many)
            b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[own[low:high]], many)
            a, b = a[g[a] != g[b]], b[g[a] != g[b]]
            low = high
            if not len(a):
                continue
            f = lambda x, y: (x - y) * (x - y) // y
            value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
            names, code = np.unique(np.concatenate([g[a], g[b]]), return_inverse=True)
            pairs, at = np.unique(code[: len(a)] * len(names) + code[len(a) :], return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, at, value)
            yield pa.RecordBatch.from_arrays([pa.array(names[pairs // len(names)]), pa.array(names[pairs % len(names)]), pa.array(sums)], names=["a", "b", "part"])


def pairs(audit: Audit) -> DataFrame:
    """(lang, source, item, value) of each two different sources of a language."""
    groups = audit.groups
    other = groups.select(F.col("g").alias("b"), "lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = groups.select(F.col("g").alias("a"), "lang", "source", "v", "p0").join(other, "lang").filter("a != b")
    base = both.select("a", "b", F.coalesce(F.col("v") * divergence("p0", "q0"), F.lit(0)).alias("part"))
    like = audit.cells.groupBy("g", "lang", "p", "p0").agg(F.count("*").alias("terms"))
    change = like.join(other, "lang").filter("g != b")
    ahead = change.select(F.col("g").alias("a"), "b", (F.col("terms") * (divergence("p", "q0") - divergence("p0", "q0"))).alias("part"))
    behind = change.select(F.col("b").alias("a"), F.col("g").alias("b"), (F.col("terms") * (divergence("q0", "p") - divergence("q0", "p0"))).alias("part"))
    postings = audit.cells.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("held")).filter("size(held) > 1")
    shared = arrow_map(postings.select("held"), _pair_corrections, "a long, b long, part long")
    sums = base.unionByName(ahead).unionByName(behind).unionByName(shared).groupBy("a", "b").agg(F.sum("part").alias("value"))
    return both.select("a", "b", "lang", "source", "item").join(sums, ["a", "b"]).select("lang", "source", "item", "value")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The `top` rows of each group by f, ties by term, with their rank; first within salts, so that no group goes to one task."""
    order = "order by f desc, term asc"
    first = rows.withColumn("__r", F.expr(f"row_number() over (partition by g, pmod(xxhash64(term), 64) {order})")).filter(F.col("__r") <= top)
    return first.withColumn("rank", F.expr(f"row_number() over (partition by g {order})")).filter(F.col("rank") <= top).drop("__r")


def top_terms(audit: Audit, top: int = TOP) -> DataFrame:
    """(g, term, f, rank) of the `top` terms of each group, by best-first evaluation of buckets with bounds."""
    # counts below 64 have a bucket of their own, larger ones 16 buckets for each power of two
    bucket = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2(F.col("n")) * 16)).cast("long")
    cells = stored(audit.cells.withColumn("bucket", bucket))
    extremes = cells.groupBy("g", "bucket").agg(F.count("*").alias("terms"), F.max("p").alias("p"), F.min("q").alias("q"))
    # f grows with p and falls with q where p > q; without p > q no term of the bucket counts
    bounds = stored(extremes.filter("p > q").select("g", "bucket", "terms", divergence("p", "q").alias("bound")))
    unseen, found, wave = bounds, None, top
    while True:
        # the best buckets of each group until they hold `wave` terms
        ahead = F.expr("coalesce(sum(terms) over (partition by g order by bound desc, bucket rows between unbounded preceding and 1 preceding), 0)")
        chosen = stored(unseen.withColumn("__before", ahead).filter(F.col("__before") < wave).select("g", "bucket"))
        if chosen.isEmpty():
            break
        new = cells.join(chosen, ["g", "bucket"]).filter("p > q").select("g", "term", divergence("p", "q").alias("f"))
        rows = new if found is None else new.unionByName(found.select("g", "term", "f"))
        found = stored(_best(rows, top))
        least = found.filter(F.col("rank") == top).select("g", F.col("f").alias("kth"))
        rest = unseen.join(chosen, ["g", "bucket"], "left_anti").join(least, "g", "left")
        unseen = stored(rest.filter("kth is null or bound >= kth").select("g", "bucket", "terms", "bound"))
        wave *= 4
    return found if found is not None else _best(cells.filter("p > q").select("g", "term", divergence("p", "q").alias("f")), top)


def audited(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    with scratch() as kept:
        audit = Audit(docs, text)
        order = F.expr("cast(row_number() over (partition by lang, source order by value desc, item asc) as int)")
        pair = pairs(audit).select("lang", "source", F.lit("pair").alias("part"), "item", "value", order.alias("rank"))
        term = top_terms(audit).join(audit.groups.select("g", "lang", "source"), "g").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"), F.col("rank").cast("int").alias("rank"))
        return kept(pair.unionByName(term))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(sf_dir, "documents", spark).select("lang", "source", "text"))


QUERIES = {"op12_source_divergence": op12_source_divergence}
SQL = {
    "op12_source_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
tot AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN n USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS p FROM tot g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pair UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM term)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 200
"""
}
