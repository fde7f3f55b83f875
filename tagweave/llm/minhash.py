"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch. In round i every shingle of a document is thrown into a hashed one of
`T` bins, which keeps the least hash of that round; bins filled in an earlier
round stay as they are. The last T rounds aim each round's shingles at one bin,
so all bins are filled after 2 T rounds at most; a set of n shingles needs about
T log(T) / n rounds. Two documents agree in a bin with the probability of their
similarity, concentrated as for independent samples.

Links. `ROWS` bins make a band; documents that agree in a band share a bucket.
At similarity 0.8 all `BANDS` bands miss with probability below 2e-9. Equal sets
are one *class* beforehand. Pairs of a bucket aren't made into rows:

1. Every class is compared with one member of its buckets, the one that has the
   fullest buckets. Then, in rounds, every class outside its bucket's largest component
   is compared with `TRIES` members of that: each bucket names one at random, and those
   with the most equal bits are taken. Rounds end when fewer than `LEAST_GAIN` per cent
   of the pairs are links. So a group of near copies becomes connected by few pairs a
   document, which are decided on the full sets of both texts.
2. Buckets that still hold several components are left; their *region* is the largest
   component in them. The few rows of a region that are outside it are compared with
   all rows of the region on full sets, in blocks of bounded rows and shingles: a task
   has one block of the few and one of the others, counts common shingles by an
   inverted index, and gives one link at most for each row and component it meets.

Components are found by least labels with pointer jumping, on written tables.

Defined cases: A-Z are lower-cased; a text with fewer than k words has its whole
sequence as its one shingle; a null text, or one without words, has the empty
set and links with nothing; every row has the result of its own text, so a doc_id
with several texts is several documents; repeated rows are kept or go together;
of a component's documents with the least doc_id the one with the least set is
kept; a null doc_id is never linked and kept; ids may be of any ordered type; a text
of any length is compared on its whole set (a task's memory grows with its longest text); an
empty table gives an empty result; only doc_id and the text are read, so other
columns can't clash. Sets are sets of 64-bit shingle hashes: two sets of a million
shingles hold one common hash too many with a probability of 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, scratch, stored, table, text_key
from .textnum import column_of, lower_ascii, mix, row_slices, shingle_hashes, span_hashes, string_bytes, words_of

ROWS = 5
BANDS = 51
T = ROWS * BANDS
PERCENT = 80
LEAST_GAIN = 2
TRIES = 4
#: Rows of a block of the few and of the others, and shingles of either.
FEW, MANY, SHINGLES = 128, 512, 1_000_000
_SEED = np.random.default_rng(20170405).integers(0, 1 << 64, 2 * T, dtype=np.uint64)


def sets_of(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row and where each row's begin."""
    buf = lower_ascii(buf)
    starts, ends, first = words_of(buf, offs)
    hashes, begin = shingle_hashes(span_hashes(buf, starts, ends), first, k)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(begin))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        hashes[a:b].sort()
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
    return hashes[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=len(offs) - 1))])


def sketches(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """T bins for each row; rows without shingles stay at the largest value."""
    rows = len(begin) - 1
    bins = np.full((rows, T), np.iinfo(np.uint64).max)
    filled = np.zeros((rows, T), bool)
    sizes = np.diff(begin)
    active = np.flatnonzero(sizes > 0)
    for i in range(2 * T):
        if not len(active):
            break
        n = sizes[active]
        at = np.arange(int(n.sum())) + np.repeat(begin[active] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        h = mix(hashes[at] ^ _SEED[i])
        local = np.repeat(np.arange(len(active)), n)
        got = np.full(len(active) * T, np.iinfo(np.uint64).max)
        bin_of = (h >> np.uint64(32)) % np.uint64(T) if i < T else np.full(len(h), i - T, np.uint64)
        np.minimum.at(got, local * T + bin_of.astype(np.int64), h)
        got = got.reshape(len(active), T)
        new = ~filled[active] & (got != np.iinfo(np.uint64).max)
        bins[active] = np.where(new, got, bins[active])
        filled[active] |= new
        active = active[~filled[active].all(axis=1)]
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    keys = np.full((len(bins), BANDS), 0, np.uint64)
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bins[:, j::ROWS])
    return mix(keys + np.arange(BANDS, dtype=np.uint64))


def sketched(df: DataFrame, text: str, k: int) -> DataFrame:
    """(doc_id, key, n, s1, s2, bands, bits): text key, set size, two sums that identify the set, band keys, one bit of each bin."""
    body = F.col(f"`{text}`")
    rows = df.select("doc_id", text_key(body).alias("key"), body.alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, "text"):
            hashes, begin = sets_of(*string_bytes(column_of(part, "text")), k)
            bins = sketches(hashes, begin)
            total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[begin]).view(np.int64)
            bits = np.zeros((part.num_rows, 256), np.uint8)
            bits[:, :T] = bins & np.uint64(1)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [column_of(part, "doc_id"), column_of(part, "key"), pa.array(np.diff(begin)), pa.array(total(hashes)), pa.array(total(mix(hashes + np.uint64(1)))), listed(band_keys(bins).view(np.int64)), listed(np.packbits(bits, axis=1).view(np.int64))],
                names=["doc_id", "key", "n", "s1", "s2", "bands", "bits"],
            )

    return arrow_map(rows, run, f"doc_id {kind}, key string, n long, s1 long, s2 long, bands array<long>, bits array<long>")


def compared(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, common, size_a, size_b) of pairs (a, b) of classes, on their full sets; `texts` has (id, text).

    Pairs are sorted by a within a task, so a set that many are compared with is made once in a row.
    """
    sides = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = sides.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for part in row_slices(batches, "text_b"):
            hashes, begin = sets_of(*string_bytes(column_of(part, "text_b")), k)
            texts_a, common, sizes = column_of(part, "text_a"), [], []
            for i, a in enumerate(column_of(part, "a").to_pylist()):
                if a != last:
                    own, _ = sets_of(*string_bytes(texts_a.slice(i, 1)), k)
                    last = a
                common.append(len(np.intersect1d(own, hashes[begin[i] : begin[i + 1]], assume_unique=True)))
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([column_of(part, "a"), column_of(part, "b"), pa.array(common, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.diff(begin))], names=["a", "b", "common", "size_a", "size_b"])

    kind = dict(pairs.dtypes)["a"]
    return arrow_map(both, run, f"a {kind}, b {kind}, common long, size_a long, size_b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all ids in edges (a, b): the least id that can be reached. Hot ids are combined before each shuffle."""
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        low = labels.join(near, "id").select("id", "root", F.least("root", "near").alias("low"))
        jump = low.join(labels.select(F.col("id").alias("low"), F.col("root").alias("far")), "low").select("id", F.col("root").alias("was"), F.least("low", "far").alias("root"))
        after = stored(jump)
        if after.filter("root < was").isEmpty():
            return after.select("id", "root")
        labels = after.select("id", "root")


def open_buckets(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(bucket, id, rank, root): the rows of buckets that hold more than one component."""
    if roots is None:
        return buckets.withColumn("root", F.col("id"))
    rows = buckets.join(roots, "id", "left").select("bucket", "id", "rank", F.coalesce("root", "id").alias("root"))
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket")
    return rows.join(stored(mixed), "bucket")


def star_pairs(rows: DataFrame, nodes: DataFrame, done: DataFrame | None) -> DataFrame:
    """(a, b): every id b with one head a of its buckets that isn't in its component and hasn't been compared with it.

    At first heads are the highest-ranked members; later each bucket has a random one, and the head with most equal bits is taken.
    """
    if done is None:
        heads = rows.groupBy("bucket").agg(F.max(F.struct("rank", "id", "root")).alias("head"))
        ends = rows.join(stored(heads), "bucket").filter("root != head.root").select(F.col("id").alias("b"), "head")
        return ends.groupBy("b").agg(F.max("head").alias("head")).select(F.col("head.id").alias("a"), "b")
    turn = done.agg(F.max("star")).first()[0]
    rows = stored(largest_of(rows).join(nodes.select("id", "bits"), "id"))
    heads = rows.filter("root = largest").groupBy("bucket").agg(F.max(F.struct(F.xxhash64("bucket", "id", F.lit(turn)).alias("draw"), "id", "bits")).alias("head"))
    ends = rows.filter("root != largest").join(stored(heads), "bucket").select(F.col("head.id").alias("a"), F.col("id").alias("b"), equal_bits("bits", "head.bits").alias("equal"))
    ends = ends.groupBy("a", "b").agg(F.max("equal").alias("equal"))  # a pair that shares several buckets
    met = done.select("a", "b").unionAll(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = F.slice(F.sort_array(F.collect_list(F.struct("equal", "a")), asc=False), 1, TRIES)  # of one head a bucket
    return ends.join(met, ["a", "b"], "left_anti").groupBy("b").agg(best.alias("best")).select(F.explode("best.a").alias("a"), "b")


def largest_of(rows: DataFrame) -> DataFrame:
    """rows (bucket, id, root) with the largest root of their bucket."""
    most = rows.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("m")).select("bucket", F.col("m.root").alias("largest"))
    return rows.select("bucket", "id", "root").join(stored(most), "bucket")


def equal_bits(x: str, y: str) -> Column:
    """Of the T bits of two sketches, how many are equal; the 256th is 0 in both."""
    return 255 - sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(4)), F.lit(0))


def rest_links(rows: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between rows outside the largest component of an open bucket and all rows of such buckets."""
    regions = stored(largest_of(rows).select(F.col("largest").alias("region"), "id", "root").distinct().join(nodes.select("id", "n"), "id").withColumn("few", F.col("root") != F.col("region")))
    size = lambda cond, most: F.greatest(F.lit(1), F.ceil(F.count(F.when(cond, 1)) / most), F.ceil(F.sum(F.when(cond, F.col("n"))) / SHINGLES)).cast("int")
    blocks = regions.groupBy("region").agg(size(F.col("few"), FEW).alias("few_blocks"), size(F.lit(True), MANY).alias("blocks")).join(regions.filter("few").select("region").distinct(), "region")
    dealt = regions.join(stored(blocks), "region")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.hash("id"), n)
    few = dealt.filter("few").select("region", own("few_blocks").alias("fb"), each("blocks").alias("mb"), "id", "root", F.lit(True).alias("asks"))
    many = dealt.select("region", each("few_blocks").alias("fb"), own("blocks").alias("mb"), "id", "root", F.lit(False).alias("asks"))
    order = ["region", "fb", "mb", "asks", "id"]
    both = few.unionAll(many).join(texts, "id").repartition("region", "fb", "mb").sortWithinPartitions(*order).select(*order, "root", "text")
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for part in row_slices(batches, "text"):
            hashes, begin = sets_of(*string_bytes(column_of(part, "text")), k)
            for i, row in enumerate(zip(*(column_of(part, c).to_pylist() for c in ("region", "fb", "mb", "asks", "id", "root")), strict=True)):
                if row[:3] != now:
                    yield from done(held)
                    now, held = row[:3], []
                held.append((*row[3:], hashes[begin[i] : begin[i + 1]].copy()))
        yield from done(held)

    def done(held: list) -> Iterator[pa.RecordBatch]:
        found = list(block_links([x[1:] for x in held if x[0]], [x[1:] for x in held if not x[0]], percent)) if held else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["a", "b"])

    return arrow_map(both, run, f"a {kind}, b {kind}")


def block_links(few: list[tuple], many: list[tuple], percent: int) -> Iterator[tuple]:
    """Links of rows (id, component, set): for each of `few`, one link at most to each other component among `many`."""
    if not few or not many:
        return
    sizes = np.array([len(x[2]) for x in many])
    flat = np.concatenate([x[2] for x in many])
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], np.repeat(np.arange(len(many)), sizes)[order]
    for ident, root, own in few:
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        n = hi - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
        common = np.bincount(holder[at], minlength=len(many))
        seen = {root}
        for j in np.flatnonzero(100 * common >= percent * (len(own) + sizes - common)).tolist():
            if many[j][1] not in seen:
                seen.add(many[j][1])
                yield ident, many[j][0]


def near_duplicates(df: DataFrame, text: str = "text", k: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept) of every row of df; `key` is the text_key of its text."""
    docs = df.select("doc_id", F.col(f"`{text}`").alias("text"))
    with scratch() as kept:
        rows = stored(sketched(docs, "text", k))
        sets = rows.filter("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "key")).alias("own"))
        # classes have numbers of their own, whatever the type of doc_id and however many texts one has
        classes = stored(sets.select("n", "s1", "s2", F.monotonically_increasing_id().alias("id"), "own.doc_id", "own.key"))
        firsts = rows.select("doc_id", "key", "bands", "bits").join(classes.select("doc_id", "key", "id", "n"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
        banded = firsts.select("id", F.explode("bands").alias("bucket"))
        sizes = banded.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
        full = stored(banded.join(sizes, "bucket"))
        crowd = full.groupBy("id").agg(F.sum("members").alias("rank"))
        buckets = stored(full.join(crowd, "id").select("bucket", "id", "rank"))
        nodes = stored(firsts.join(crowd.select("id"), "id", "left_semi").select("id", "n", "bits", "doc_id", "key"))
        texts = stored(docs.withColumn("key", text_key(F.col("text"))).join(nodes.select("doc_id", "key", "id"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("id", "text"))

        roots, done, star = None, None, 0
        while True:
            found = stored(compared(stored(star_pairs(open_buckets(buckets, roots), nodes, done)), texts, k).withColumn("star", F.lit(star)))
            done = found if done is None else done.unionAll(found)
            n, gain = found.count(), links_of(found, percent).count()
            if gain or roots is None:
                roots = components(links_of(done, percent))
            if 100 * gain <= LEAST_GAIN * n:
                break
            star += 1
        rest = stored(rest_links(open_buckets(buckets, roots), nodes, texts, k, percent))
        if not rest.isEmpty():
            roots = components(links_of(done, percent).unionAll(rest))

        lead = roots.join(classes.select("id", "doc_id"), "id").groupBy("root").agg(F.min(F.struct("doc_id", "id")).alias("lead"))
        # a merge join, so that Spark splits a root that a large part of the classes has
        ends = stored(roots.join(stored(lead).hint("merge"), "root").select("id", "lead"))
        of_class = stored(classes.join(ends, "id", "left").select("n", "s1", "s2", F.coalesce("lead.doc_id", "doc_id").alias("least"), F.coalesce(F.col("lead.id") == F.col("id"), F.lit(True)).alias("leads")))
        out = rows.select("doc_id", "key", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
        return kept(out.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce((F.col("doc_id") == component) & F.coalesce("leads", F.lit(True)), F.lit(True)).alias("kept")))


def links_of(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.filter(100 * F.col("common") >= percent * (F.col("size_a") + F.col("size_b") - F.col("common"))).select("a", "b")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(sf_dir, "documents", spark), k=2).drop("key")


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles), with the columns of docs; names that begin with two underscores are reserved."""
    gone = near_duplicates(docs, text).filter("not kept").select("doc_id", F.col("key").alias("__key")).distinct()
    return docs.withColumn("__key", text_key(F.col(f"`{text}`"))).join(gone, ["doc_id", "__key"], "left_anti").select(*docs.columns)


QUERIES = {"op4_minhash_dedup": op4_minhash_dedup}
SQL = {
    "op4_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
bt AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM bt UNION SELECT r.a, bt.b FROM r JOIN bt ON r.b = bt.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept FROM n LEFT JOIN c USING (doc_id)
"""
}
