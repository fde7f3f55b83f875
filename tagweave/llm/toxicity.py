"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features: the n-grams (3 to 5 code points, A-Z and Latin-1 capitals lower-cased, all
white space alike) of a whole text, hashed into 2**`BITS` buckets; the value of
a bucket is its share of the text's n-grams times `SCALE`, at most 1. Texts
with fewer than `SCALE` n-grams count as having that many. Each feature is
multiplied by r = log of the ratio of its smoothed shares in toxic and other
training texts; on the scaled features a logistic regression with an L2 penalty
is fitted by L-BFGS. Counts and gradients are summed on the executors; the
driver holds vectors of 2**BITS numbers only.

The classifier is fitted on at most `MAX_TRAIN` labelled documents (those whose
hashed id is least); all documents are scored, whole.

Defined cases: a null or empty text has no features and gets the score of the
prior; labels that are null, or of ids without a document, are not used; an id
that is labelled twice counts as toxic if one label says so; without any usable
label every score is 0; repeated rows are scored alike; a text of any length is
scored whole; an empty table gives an empty result; input columns named `score` or
`predicted` are replaced, and the pipeline stage gives its input's own columns back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, scratch, stored, table, without
from .textnum import code_points, column_of, mix, row_slices, string_bytes

SIZES = (3, 4, 5)
BITS = 18
SCALE = 300
SMOOTH = 0.01
PENALTY = 0.01
MAX_TRAIN = 6000
FIT_TASKS = 8
ROUNDS = 25
THRESHOLD = 0.3
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """Weight of each bucket (naive Bayes ratio times fitted weight) and the intercept; None: nothing was learnt."""

    weights: np.ndarray | None
    bias: float


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == 2


def features(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each row."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum(code_points(buf))])[offs]
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE))
    points = np.where(upper, points + np.uint32(32), points)
    points = np.where(points <= 32, np.uint32(32), points)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if a == b:
            yield np.zeros(0, np.int32), np.zeros(0, np.float32)
            continue
        own = np.full(b - a + 2, 32, np.uint64)
        own[1:-1] = points[a:b]
        grams, h = [], np.zeros(len(own), np.uint64)
        for n in range(1, max(SIZES) + 1):
            if len(own) < n:
                break
            h = h[: len(own) - n + 1] * _STEP + own[n - 1 :] + np.uint64(1)
            if n in SIZES:
                grams.append((mix(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32))
        flat = np.sort(np.concatenate(grams))
        begin = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        counts = np.diff(np.append(begin, len(flat)))
        yield flat[begin], np.minimum(1, counts * (SCALE / max(len(flat), SCALE))).astype(np.float32)


def training_features(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(label, bucket, value) of the training documents; the bounded list of labels is broadcast, texts aren't shuffled."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    least = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(least), "doc_id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, "text"):
            got = list(features(*string_bytes(column_of(part, "text"))))
            offs = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _ in got])]), pa.int32())
            cols = [pa.ListArray.from_arrays(offs, pa.array(np.concatenate(x))) for x in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays([column_of(part, "label"), *cols], names=["label", "bucket", "value"])

    return arrow_map(rows, run, "label double, bucket array<int>, value array<float>").repartition(FIT_TASKS)


def _matrix(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    label, bucket, value = (column_of(part, c) for c in ("label", "bucket", "value"))
    row = np.repeat(np.arange(part.num_rows), np.diff(bucket.offsets.to_numpy()))
    return label.to_numpy(), row, bucket.flatten().to_numpy(), value.flatten().to_numpy()


def _summed(rows: DataFrame, fn, width: int) -> np.ndarray:
    """Sum over all tasks of the vectors (float64, `width` numbers) that fn gives for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for part in batches:
            for at in range(0, part.num_rows, 256):
                total += fn(*_matrix(part.slice(at, 256)))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["total"])

    return sum((np.frombuffer(r.total, np.float32).astype(np.float64) for r in arrow_map(rows, run, "total binary").collect()), np.zeros(width))


def _lbfgs(value_and_slope, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    value, slope = value_and_slope(x)
    for _ in range(rounds):
        way, scales = slope.copy(), []
        for s, y in reversed(steps):
            scales.append((s @ way) / (y @ s))
            way -= scales[-1] * y
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y), scale in zip(steps, reversed(scales), strict=True):
            way += s * (scale - (y @ way) / (y @ s))
        length = 1.0
        while True:
            to = x - length * way
            value2, slope2 = value_and_slope(to)
            if value2 <= value - 1e-4 * length * (slope @ way) or length < 1e-3:
                break
            length /= 2
        s, y, gain = to - x, slope2 - slope, value - value2
        if s @ y > 1e-10:
            steps = [*steps, (s, y)][-memory:]
        x, value, slope = to, value2, slope2
        if gain < 1e-5 * max(1.0, abs(value)):
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    with scratch():
        # one vector from each task, whatever the files' split
        return _fitted(stored(training_features(docs, labels, text)).coalesce(FIT_TASKS))


def _fitted(rows: DataFrame) -> Model:
    dims = 1 << BITS

    def counts(label, row, bucket, value):
        toxic = label[row]
        return np.concatenate([np.bincount(bucket, value * toxic, dims), np.bincount(bucket, value * (1 - toxic), dims), [label.sum(), len(label)]])

    got = _summed(rows, counts, 2 * dims + 2)
    n_toxic, n = got[-2:]
    if not n:
        return Model(None, 0.0)
    prior = float(np.log((n_toxic + 0.5) / (n - n_toxic + 0.5)))
    if n_toxic in (0, n):
        return Model(np.zeros(dims, np.float32), prior)
    p, q = got[:dims] + SMOOTH, got[dims:-2] + SMOOTH
    ratio = np.log((p / p.sum()) / (q / q.sum()))

    def loss(w):
        scaled, bias = (w[:-1] * ratio).astype(np.float32), w[-1]

        def of(label, row, bucket, value):
            s = np.bincount(row, value * scaled[bucket], len(label)) + bias
            miss = 1 / (1 + np.exp(-s)) - label
            return np.concatenate([np.bincount(bucket, value * miss[row], dims), [miss.sum(), (np.logaddexp(0, s) - label * s).sum()]])

        out = _summed(rows, of, dims + 2)
        slope = np.append(out[:dims] * ratio + PENALTY * w[:-1], out[dims])
        return out[-1] + PENALTY / 2 * (w[:-1] @ w[:-1]), slope

    start = np.zeros(dims + 1)
    start[-1] = prior
    w = _lbfgs(loss, start, ROUNDS)
    return Model((w[:-1] * ratio).astype(np.float32), float(w[-1]))


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all by default) with score and predicted; no shuffle."""
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    source = df.select(*[f"`{c}`" for c in kept], F.col(f"`{text}`").alias("__text"))
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, "__text"):
            if weights is None:
                got = np.zeros(part.num_rows)
            else:
                sums = np.array([float(weights[i] @ v) for i, v in features(*string_bytes(column_of(part, "__text")))])
                got = 1 / (1 + np.exp(-np.clip(sums + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(column_of(part, c) for c in kept), pa.array(got, pa.float64())], names=[*kept, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), "score double"])
    return arrow_map(source, run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark)
    model = fit(docs, table(sf_dir, "labels", spark).select("doc_id", "toxic"))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    model = fit(docs, labels.select("doc_id", "toxic"))
    names = [f"__{i}" for i in range(len(docs.columns))]  # so that a column named score or predicted stays as it is
    own = docs.toDF(*names)
    kept = score(own, model, text=names[docs.columns.index("text")]).filter("predicted = 0").select(*names)
    return kept.toDF(*docs.columns)


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
