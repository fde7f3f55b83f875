"""Importance resampling towards a target: hashed n-gram features, log-ratio gains, Gumbel top-k.

Features of a text are its runs of one to three consecutive words (A-Z lower-cased),
hashed into `BUCKETS` buckets by the crc32 of their bytes. In each block of at most
`BLOCK` words a dictionary maps distinct words to integers; n-grams are tuples of
these integers packed into one number; the bytes of each distinct tuple are put
together and hashed once, and every occurrence gets the bucket through its tuple's
number. A corpus-wide dictionary would shuffle every feature of every text, three
times the words of the corpus, to save hashing a tuple again in another block.

Texts are read and hashed once: the buckets of each document (two bytes a
feature) are written, counted (one vector of `BUCKETS` counts a task) and read
again to sum up gains. The draw is exact and has no task that sees all rows:
approximate percentiles cut the upper tail into bins, bins are counted, and ranks
are the row numbers within a bin plus the rows of the bins before it.

Defined cases: a null text counts as empty; texts without words have no
features and weight 0; a text of any length is hashed whole, block by block; a null
id counts as an empty string in the hash and comes last among ties; repeated rows
are rows of their own and get ranks of their own; without documents, or with fewer
than 20 of 20 words, nothing is drawn; an empty target has only zero counts; of
the input's columns only those in `keep` are returned, so names can't clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, scratch, stored, table
from .textnum import byte_class, column_of, lower_ascii, row_slices, span_ids, string_bytes, words_of

BUCKETS = 10000
SIZES = (1, 2, 3)
BLOCK = 1 << 18  # words; three numbers below it fit into 63 bits
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
BINS = 128
FEATURE_BYTES = byte_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def _tuple_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, n: int) -> tuple[bytes, np.ndarray]:
    """The n words from each word in `at` on, joined by one space, end to end; and where each of them ends."""
    word = (at[:, None] + np.arange(n)).ravel()
    sizes = ends[word] - starts[word] + 1  # with a space after each word
    stops = np.cumsum(sizes)
    out = np.full(int(stops[-1]), 32, np.uint8)
    source = np.arange(len(out)) + np.repeat(starts[word] - (stops - sizes), sizes)
    inside = np.ones(len(out), bool)
    inside[stops - 1] = False
    out[inside] = buf[source[inside]]
    return out.tobytes(), stops[n - 1 :: n] - 1


def feature_buckets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features row after row, where each row's begin (one more entry than rows), and the words of each row."""
    buf = lower_ascii(buf)
    starts, ends, first = words_of(buf, offs, FEATURE_BYTES)
    n_words = np.diff(first)
    per_size = [np.maximum(n_words - n + 1, 0) for n in SIZES]
    begin = np.concatenate([[0], np.cumsum(sum(per_size))])
    out = np.zeros(int(begin[-1]), np.uint16)
    before = np.cumsum([np.zeros_like(n_words), *per_size[:-1]], axis=0)
    row = np.repeat(np.arange(len(n_words)), n_words)
    for low in range(0, len(starts), BLOCK):
        high = min(low + BLOCK, len(starts))
        end = min(high + SIZES[-1] - 1, len(starts))
        ids = span_ids(buf, starts[low:end], ends[low:end])
        wide = int(ids.max()) + 1
        places = np.arange(low, high)
        left = first[row[low:high] + 1] - places  # words of the row from here on
        keys = np.zeros(high - low, np.int64)
        for k, n in enumerate(SIZES):
            whole = left >= n
            places, left, keys = places[whole], left[whole], keys[whole]
            if not len(places):
                break
            keys = keys * wide + ids[places - low + n - 1]
            _, sample, back = np.unique(keys, return_index=True, return_inverse=True)
            data, stops = _tuple_bytes(buf, starts, ends, places[sample], n)
            cut = stops.tolist()
            hashed = np.fromiter((zlib.crc32(data[a:b]) % BUCKETS for a, b in zip([0, *(c + 1 for c in cut[:-1])], cut, strict=True)), np.uint16, len(cut))
            r = row[places]
            out[begin[r] + before[k][r] + places - first[r]] = hashed[back]
    return out, begin, n_words


def features(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, n_words, n_features and `buckets`: two bytes for each feature of the whole text; no shuffle."""
    own = [f"__{i}" for i in range(len(keep))]
    source = df.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own, strict=True)], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), "n_words long, n_features long, buckets binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, "__text"):
            got, begin, n_words = feature_buckets(*string_bytes(column_of(part, "__text")))
            data = got.astype("<u2").tobytes()
            cells = pa.array([data[2 * a : 2 * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(column_of(part, o) for o in own), pa.array(n_words, pa.int64()), pa.array(np.diff(begin), pa.int64()), cells], names=[*own, "n_words", "n_features", "buckets"])

    return arrow_map(source, run, schema).withColumnsRenamed(dict(zip(own, keep, strict=True)))


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n) of the features of all rows, at most one vector of `BUCKETS` counts from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in batches:
            total += np.bincount(string_bytes(column_of(part, "buckets"))[0].view("<u2"), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    return arrow_map(rows.select("buckets"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def count_vector(rows: DataFrame) -> np.ndarray:
    """bucket_counts of `rows` as a vector of `BUCKETS` numbers."""
    out = np.zeros(BUCKETS, np.int64)
    for r in bucket_counts(rows).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket: the scaled log ratio of smoothed target and source shares, rounded down."""
    held, wanted = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * held / ((s + 1.0) * wanted))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """Replace `buckets` by `weight`, the sum of the gains of a row's features."""
    kept = [c for c in rows.columns if c != "buckets"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept), "weight long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data, offs = string_bytes(column_of(part, "buckets"))
            sums = np.concatenate([[0], np.cumsum(gain[data.view("<u2")])])[offs // 2]
            yield pa.RecordBatch.from_arrays([*(column_of(part, c) for c in kept), pa.array(np.diff(sums), pa.int64())], names=[*kept, "weight"])

    return arrow_map(rows, run, schema)


def scores(docs: DataFrame, target: DataFrame, text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score (weight and Gumbel noise of the hashed id) of every row of docs."""
    spread = f"conv(substr(sha2(concat('{int(seed)}:', coalesce(cast(doc_id as string), '')), 256), 1, 8), 16, 10)"
    noise = f"cast(floor(-1000D * ln(-ln((cast({spread} as double) + 0.5D) / 4294967296D))) as long)"
    with scratch() as kept:
        rows = stored(features(docs, text))
        gain = gains(count_vector(rows), count_vector(features(target, text, keep=())))
        return kept(weigh(rows, gain).withColumn("score", F.col("weight") + F.expr(noise)))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with `rank`: 1, 2, 3 ... for the floor(percent * N / 100) best of the N rows with enough words, null for others."""
    fit = F.col("n_words") >= least_words
    n = scored.filter(fit).count()
    wanted = percent * n // 100
    unranked = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("*", unranked)
    low = max(0.0, 1 - wanted / n - 0.01)  # percentile_approx errs by a ten-thousandth of the rows
    marks = F.array(*[F.lit(low + (1 - low) * i / BINS) for i in range(BINS)])
    cuts = sorted(set(scored.filter(fit).agg(F.percentile_approx("score", marks, 10000).alias("cuts")).first().cuts))
    upper = fit & (F.col("score") >= cuts[0])
    bin_of = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("score")))
    columns = scored.columns
    # rows that are equal in all columns are one row with a count until they get their ranks
    tail = scored.filter(upper).groupBy(*columns).agg(F.count("*").alias("__n")).withColumn("__bin", bin_of)
    sizes = {r["__bin"]: r.n for r in tail.groupBy("__bin").agg(F.sum("__n").alias("n")).collect()}  # BINS rows
    earlier = np.concatenate([[0], np.cumsum([sizes.get(b, 0) for b in range(len(cuts))])])[:-1]
    last = F.expr("sum(__n) over (partition by __bin order by score desc, doc_id asc nulls last rows unbounded preceding)") + F.element_at(F.array(*[F.lit(int(e)) for e in earlier]), F.col("__bin") + 1)
    placed = tail.withColumn("__last", last.cast("long")).select(*columns, F.explode(F.sequence(F.col("__last") - F.col("__n") + 1, F.col("__last"))).alias("rank"))
    ranked = placed.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(scored.filter(~upper).select("*", unranked))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(table(sf_dir, "documents", spark), table(sf_dir, "benchmark", spark))
    return draw(rows).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_importance_resampling": op11_importance_resampling}
#: crc32 is built from its polynomial; each distinct feature is hashed once.
SQL = {
    "op11_importance_resampling": r"""
WITH RECURSIVE bit(i, k, c) AS (SELECT range, 0, range::UINTEGER FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bit WHERE k = 8),
every AS (SELECT 0 AS part, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT part, rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM every),
grams AS (SELECT part, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM words),
counted AS (SELECT part, rid, gram, count(*) AS n FROM grams GROUP BY ALL),
one AS (SELECT gram, hex(gram) AS h, strlen(gram) AS size FROM counted GROUP BY gram),
hashed AS (SELECT gram, xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(0, size), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UINTEGER)), lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295::UINTEGER) % 10000 AS bucket FROM one, crc),
cells AS (SELECT part, rid, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (gram) GROUP BY ALL),
sums AS (SELECT range AS bucket, coalesce(sum(n) FILTER (part = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (part = 1), 0)::DOUBLE AS t FROM range(10000) LEFT JOIN cells ON bucket = range GROUP BY range),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums),
weighed AS (SELECT e.rid, e.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight FROM every e JOIN words USING (part, rid) LEFT JOIN (SELECT rid, sum(n) AS n_features, sum(n * gain) AS weight FROM cells JOIN gain USING (bucket) WHERE part = 0 GROUP BY rid) USING (rid) WHERE part = 0),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) FILTER (n_words >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * fit // 100 THEN r END AS rank FROM placed
"""
}
