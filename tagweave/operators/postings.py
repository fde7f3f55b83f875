"""Search by a written index of character trigrams, with the semantics of the scans in `search`.

`write_postings` stores, for each field of each document, its distinct trigrams, as rows
(gram, field, block, places, n) with the places of the documents that hold the gram in a block of
about `SLICE_BYTES`, in folders by a hash of the gram: a query reads the folders of its own
grams only. So a gram is shuffled once for a block and not once for a document, and ids are
stored once, in a row of the block of their own (folder `FOLDERS`). A term of three or more characters that a field contains has all its
trigrams there, so the rows that hold them are candidates, which are scored by the same
expressions as a scan. A term of fewer characters is looked up among all trigrams
that hold it (a `catalogue` of distinct grams with their sizes) and among the fields that
are shorter than a trigram, which have a row of their own with the whole field.

`top_indexed` needs fewer rows: candidates come with a bound of their score (the sum of
the weights of the fields that may hold each keyword), rows are scored in waves of
falling bounds, and it ends when the best bound that is left is below the n-th score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..settle import settled
from . import search as S

SIZE = 3
FOLDERS = 256
SLICE_BYTES = 2 << 20
_BITS = 21  # of a code point
_NONE = np.uint64((1 << _BITS) - 1)  # no code point: fills up strings that are shorter than a gram
#: Fields of a symbol that keywords are sought in; the tags of a type are one field each.
FIELDS = ("module", "symbol_id", "file_path", "signature", "semantic", "base", "custom", "brief")


def folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def grams_of(strings: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of strings, or a string itself where it is shorter, as three code points in a number, with the owners of the strings."""
    text = "".join(strings.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    at = np.arange(len(points))
    of = np.repeat(np.arange(len(size)), size)
    left = end[of] - at  # code points from here to the end of the string
    use = (left >= SIZE) | (at == (end - size)[of]) & (left < SIZE)
    at, left, of = at[use], left[use], of[use]
    padded = np.concatenate([points, np.full(SIZE, _NONE)])
    key = np.zeros(len(at), np.uint64)
    for j in range(SIZE):
        key = key << np.uint64(_BITS) | np.where(left > j, padded[at + j], _NONE)
    return key, owner[of]


def _named(keys: np.ndarray) -> list[str]:
    """The grams that the numbers stand for."""
    cells = np.stack([keys >> np.uint64(_BITS * (SIZE - 1 - j)) & _NONE for j in range(SIZE)], axis=1)
    size = (cells != _NONE).sum(axis=1).tolist()
    text = np.where(cells == _NONE, np.uint64(0), cells).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [text[SIZE * i : SIZE * i + n] for i, n in enumerate(size)]


def _bytes_of(part: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, part.schema) as sink:
        sink.write_batch(part)
    return out.getvalue().to_pybytes()


def postings(rows: DataFrame, ident: str, fields: dict[str, Column]) -> DataFrame:
    """(gram, field, block, places, idents, n): distinct grams of string or array<string> fields, lower-cased, each with the places of the
    rows of a block that hold it; a row without a gram has the ids of its block. A block's number is a hash of its content."""
    named = {f"f{i}": name for i, name in enumerate(fields)}
    listed = []
    for f, c in zip(named, fields.values(), strict=True):
        every = c if isinstance(rows.select(c.alias("x")).schema[0].dataType.jsonValue(), dict) else F.array(c)
        listed.append(F.transform(F.array_compact(F.coalesce(every, X.strings())), F.lower).alias(f))
    size = sum((F.aggregate(f, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)) for f in named), F.lit(0).cast("long"))
    texts = rows.select(F.col(ident).alias("ident"), *listed).withColumn("size", size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = np.concatenate([[0], np.cumsum(batch.column("size").to_numpy())])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(before, before[at] + SLICE_BYTES, "right")) - 1)
                part = batch.slice(at, to - at)
                idents = part.column("ident")
                block = int.from_bytes(hashlib.sha256(_bytes_of(part)).digest()[:8], "little", signed=True)
                yield batch_of([None], [None], block, None, [idents], [len(idents)])
                for f, name in named.items():
                    key, owner = grams_of(part.column(f).flatten(), np.repeat(np.arange(len(idents)), lengths(part.column(f))))
                    if len(key):
                        distinct, number = np.unique(key, return_inverse=True)
                        pairs = np.unique(number * len(idents) + owner)
                        begin = np.searchsorted(pairs, np.arange(len(distinct) + 1) * len(idents))
                        places = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(pairs % len(idents), pa.int32()))
                        yield batch_of(_named(distinct), [name] * len(distinct), block, places, None, np.diff(begin))
                at = to

    def lengths(lists: pa.Array) -> np.ndarray:
        return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)

    def batch_of(grams, fields, block, places, idents, n) -> pa.RecordBatch:
        size = len(grams)
        none = lambda kind: pa.nulls(size, pa.list_(kind))
        held = none(to_arrow_type(kind)) if idents is None else pa.ListArray.from_arrays(pa.array([0, len(idents[0])], pa.int32()), idents[0])
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(fields, pa.string()), pa.array([block] * size, pa.int64()), none(pa.int32()) if places is None else places, held, pa.array(n, pa.int64())], names=["gram", "field", "block", "places", "idents", "n"])

    kind = texts.schema["ident"].dataType
    return texts.mapInArrow(run, f"gram string, field string, block long, places array<int>, idents array<{kind.simpleString()}>, n long")


def symbol_fields(symbols: DataFrame) -> dict[str, Column]:
    return {f: F.col(f).cast("string") if f == "symbol_id" else F.col(f) for f in FIELDS if f in symbols.columns}


def write_postings(rows: DataFrame, ident: str, fields: dict[str, Column], path: str) -> None:
    """Write postings by folder of the gram, sorted so that row groups can be skipped, and the catalogue of grams."""
    listed = postings(rows, ident, fields).withColumn("folder", F.when(F.col("gram").isNull(), FOLDERS).otherwise(folder_of(F.col("gram"))))
    # by size: Spark splits a folder that is large, so a gram that every row has is spread over several tasks
    dealt = listed.hint("rebalance", "folder").sortWithinPartitions("folder", "gram", "field")
    dealt.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    spark = rows.sparkSession
    spark.read.parquet(f"{path}/postings").filter("gram is not null").groupBy("folder", "gram").agg(F.sum("n").alias("rows")).write.mode("overwrite").parquet(f"{path}/catalogue")


def grams_of_term(spark: SparkSession, path: str, term: str) -> list[str]:
    """Grams a row must hold (all of them) for a long term; for a short one the grams of which it must hold one."""
    if len(term) >= SIZE:
        return sorted({term[i : i + SIZE] for i in range(len(term) - SIZE + 1)})
    found = spark.read.parquet(f"{path}/catalogue").filter(F.contains("gram", F.lit(term))).select("gram").distinct()
    return sorted(r.gram for r in found.collect())  # of the distinct trigrams only


def _folders(spark: SparkSession, wanted: Sequence[str]) -> list[int]:
    return sorted({r.f for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(folder_of(F.col("g")).alias("f")).collect()})


def holders(spark: SparkSession, path: str, term: str, ident: str) -> DataFrame:
    """(ident, field): fields of rows that may hold the term."""
    wanted = grams_of_term(spark, path, term)
    table = spark.read.parquet(f"{path}/postings")
    rows = table.filter(F.col("folder").isin(_folders(spark, wanted)) & F.col("gram").isin(wanted) if wanted else F.lit(False))
    held = rows.select("block", F.explode("places").alias("place"), "field").groupBy("block", "place", "field").agg(F.count("*").alias("n"))
    found = held.filter(F.col("n") >= (len(wanted) if len(term) >= SIZE else 1))
    own = table.filter(F.col("folder") == FOLDERS).select("block", F.posexplode("idents").alias("place", ident))
    return found.join(own.dropDuplicates(["block", "place"]), ["block", "place"]).select(ident, "field").distinct()


def candidates(spark: SparkSession, path: str, query: str, ident: str = "symbol_id") -> DataFrame:
    """(ident, bound): rows that may have a score in a keyword search, with the most that their fields can give, but for occurrences in the brief beyond the first."""
    keywords, required = S.parse_keywords(query)
    weight = F.element_at(F.create_map(*[F.lit(x) for f in FIELDS for x in (f, S.WEIGHTS[f])]), F.col("field"))
    parts = [holders(spark, path, w, ident).withColumn("w", weight) for w in sorted(set(keywords))]
    tags = [holders(spark, path, t, ident).filter(F.col("field").isin("semantic", "base", "custom")).select(ident).distinct() for t in required]
    if parts:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        found = every.groupBy(ident).agg(F.sum("w").alias("bound"), F.max(F.col("field") == "brief").alias("open"))
    else:
        found = tags[0].select(ident, F.lit(0).cast("long").alias("bound"), F.lit(False).alias("open")) if tags else spark.read.parquet(f"{path}/postings").limit(0).select(F.explode("idents").alias(ident), F.lit(0).cast("long").alias("bound"), F.lit(False).alias("open"))
    for t in tags:  # a required tag is held whole, so its rows hold all its grams; rows without a keyword stay, at the tags' score
        found = found.join(t, ident, "right").select(ident, F.coalesce("bound", F.lit(0)).alias("bound"), F.coalesce("open", F.lit(False)).alias("open"))
    return found.withColumn("bound", F.col("bound") + 5 * len(required))


def keyword_indexed(symbols: DataFrame, path: str, query: str) -> DataFrame:
    """The rows of `search.keyword_search`, of candidates from the postings only."""
    found = candidates(symbols.sparkSession, path, query).select("symbol_id")
    return S.keyword_search(symbols.join(found, "symbol_id", "left_semi"), query)


def top_indexed(symbols: DataFrame, path: str, query: str, n: int = 8, *ties: str) -> DataFrame:
    """The rows of `search.top(search.keyword_search(...), n, *ties)`, of few candidates: best bounds first.

    A row whose brief may hold a keyword has no bound, since each occurrence counts; such rows are always scored.
    """
    spark = symbols.sparkSession
    found = settled(candidates(spark, path, query))  # each wave reads it again
    sizes = {r.bound: r.n for r in found.filter("not open").groupBy("bound").agg(F.count("*").alias("n")).collect()}  # sums of few weights
    seen, low = 0, None
    levels = sorted(sizes, reverse=True)
    chosen = F.col("open")
    best: list[int] = []
    for k, level in enumerate(levels or [0]):
        seen += sizes.get(level, 0)
        low = level
        if seen < 4 * n and k + 1 < len(levels):
            continue  # too few rows for a look
        scored = S.keyword_search(symbols.join(found.filter(chosen | (F.col("bound") >= low)).select("symbol_id"), "symbol_id", "left_semi"), query)
        best = [r.score for r in scored.select("score").orderBy(F.desc("score")).limit(max(1, n)).collect()]
        if len(best) >= max(1, n) and k + 1 < len(levels) and levels[k + 1] < best[-1]:
            break
        seen = 0
    scored = S.keyword_search(symbols.join(found.filter(chosen | (F.col("bound") >= (low or 0))).select("symbol_id"), "symbol_id", "left_semi"), query)
    return S.top(scored, n, *ties)


def markdown_indexed(docs: DataFrame, path: str, query: str, ident: str = "path", content: str = "content") -> DataFrame:
    """The rows of `search.markdown_search` with a score above 0; titles are part of the content or are the path."""
    if not query:
        return S.markdown_search(docs, query, ident, content, min_score=1)
    found = holders(docs.sparkSession, path, query.lower(), ident).select(ident).distinct()
    return S.markdown_search(docs.join(found, ident, "left_semi"), query, ident, content, min_score=1)
