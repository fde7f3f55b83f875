"""Chroma audio fingerprints and alignment of recordings.

Samples become frames of twelve pitch-class energies. Over the integral image of
the frames, `FILTERS` compare two parts of a window of time and pitch; each
difference is quantised to two bits (Gray code), and the bits of all filters at
one place are packed into one 32-bit integer. Each integer gives two overlapping sub-keys
of `KEY_BITS` bits, so that a few wrong bits leave one of them whole. For a query and
a recording the equal sub-keys vote for their offsets: a histogram of offsets. Those
with `LEAST_VOTES` are aligned, most votes first, and hold if the share of differing
bits over the whole overlap is small enough: `MOST_ERROR` at `FULL_FRAMES` integers or
more, and in proportion less for shorter overlaps, where chance finds more.

A recording's integers are looked up by sub-key in sorted keys, a block of queries
with a block of recordings (`BLOCK` integers each) at a time; the queries are the
recordings with an id divisible by `QUERY_EVERY`. Equal sub-keys in a row (silence, a
held note) count as one run: two runs vote for all their offsets by four changes of the
histogram's slope, so a frequent integer doesn't make pairs of its places.

Recordings with equal fingerprints are one class with the least id, so copies
are never paired with each other.

Defined cases: a null or too short recording has no fingerprint, gets no match
and forms no class; of the offsets that hold the one with most votes is given,
then the one with the least bit error, then the least; repeated rows of an
id are one recording with the fingerprint that is first in order; silence has a
fingerprint like any other recording; a long recording is read whole, a few
thousand frames at a time; only the id and the media column are read, so other
columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, stored, table
from .textnum import column_of

RATE = 4000
FRAME = 512
HOP = 256
WIDTH = 16
SPECTRA = 4096  # frames of a recording that are transformed together
TOGETHER = 1 << 17  # samples of recordings that are decoded together, about, one recording at least
BATCH_BYTES = 4 << 20  # of media values that are decoded together, but one value at least
BLOCK = 80_000
LEAST_FRAMES = 20
MOST_ERROR = 0.2
FULL_FRAMES = 64
KEY_BITS = 20
LEAST_VOTES = 4
RUN_PAIRS = 1 << 17  # pairs of runs that are counted together
GROUP = 16  # offsets that are looked at together first
CELLS = 1 << 24  # offsets of queries that are counted together, one query at least
QUERY_EVERY = 50
#: (kind, first pitch class, pitch classes, frames): what each filter compares inside its window.
FILTERS = tuple((kind, low, high, width) for k, (low, high) in enumerate([(0, 12), (0, 6), (6, 6), (3, 6)]) for kind, width in (("time", 16), ("pitch", 8), ("cross", 12), ("middle", 12 if k else 15)))


def samples_of_pcm(value: bytes) -> np.ndarray:
    """16-bit little-endian mono samples as floats."""
    return np.frombuffer(value[: len(value) // 2 * 2], "<i2").astype(np.float64) / 32768


@lru_cache(4)
def _pitch_bins(rate: int) -> np.ndarray:
    """Matrix that adds the bins of a spectrum up to twelve pitch classes."""
    freq = np.fft.rfftfreq(FRAME, 1 / rate)
    fold = np.zeros((len(freq), 12))
    use = np.flatnonzero((freq >= 100) & (freq <= 1800))
    fold[use, np.round(12 * np.log2(freq[use] / 440)).astype(int) % 12] = 1
    return fold


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames of twelve pitch-class energies, each of length one, of a recording or of rows of recordings."""
    n = (samples.shape[-1] - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((*samples.shape[:-1], 0, 12))
    out, window = np.empty((*samples.shape[:-1], n, 12)), np.hanning(FRAME)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME, axis=-1)[..., ::HOP, :]
    for begin in range(0, n, SPECTRA):
        out[..., begin : begin + SPECTRA, :] = np.abs(np.fft.rfft(frames[..., begin : begin + SPECTRA, :] * window, axis=-1)) ** 2 @ _pitch_bins(rate)
    return out / np.maximum(np.linalg.norm(out, axis=-1, keepdims=True), 1e-9)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One packed 32-bit integer for each window of WIDTH frames, of a recording or of rows of recordings."""
    n = frames.shape[-2] - WIDTH + 1
    if n < 1:
        return np.zeros((*frames.shape[:-2], 0), np.uint32)
    image = np.zeros((13, *frames.shape[:-2], frames.shape[-2] + 1))  # pitch classes first, so that an area is four rows of numbers
    image[1:, ..., 1:] = np.moveaxis(frames.cumsum(axis=-2).cumsum(axis=-1), -1, 0)
    area = lambda a, b, lo, hi: image[hi, ..., b : b + n] - image[hi, ..., a : a + n] - image[lo, ..., b : b + n] + image[lo, ..., a : a + n]
    packed = np.zeros((*frames.shape[:-2], n), np.uint32)
    for kind, low, size, width in FILTERS:
        high, mid, half = low + size, low + size // 2, width // 2
        if kind == "time":
            plus, minus = area(0, half, low, high), area(half, width, low, high)
        elif kind == "pitch":
            plus, minus = area(0, width, low, mid), area(0, width, mid, high)
        elif kind == "cross":
            plus = area(0, half, low, mid) + area(half, width, mid, high)
            minus = area(half, width, low, mid) + area(0, half, mid, high)
        else:
            third = width // 3
            plus, minus = 2 * area(third, 2 * third, low, high), area(0, third, low, high) + area(2 * third, width, low, high)
        level = np.log((plus + 1e-3) / (minus + 1e-3))
        step = (level > -0.25).astype(np.uint32) + (level > 0) + (level > 0.25)
        packed = packed << np.uint32(2) | (step ^ step >> np.uint32(1))
    return packed


def prints_of(recordings: Iterable[np.ndarray | None], rate: int = RATE) -> list[np.ndarray]:
    """Fingerprints of recordings; of about TOGETHER samples at a time those of one length are taken together."""
    out: list[np.ndarray] = []
    like, held = defaultdict(list), 0

    def flush() -> None:
        for own in like.values():
            for (i, _), found in zip(own, fingerprint(chroma(np.stack([x for _, x in own]), rate)), strict=True):
                out[i] = found
        like.clear()

    for i, x in enumerate(recordings):
        out.append(np.zeros(0, np.uint32))
        if x is not None:
            like[len(x)].append((i, x))
            held += len(x)
        if held >= TOGETHER:
            flush()
            held = 0
    flush()
    return out


def media_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part has more than BATCH_BYTES of its binary or list column `media`, but one row at least."""
    media = column_of(batch, "media")
    wide = pa.types.is_large_binary(media.type) or pa.types.is_large_list(media.type)
    ends = np.frombuffer(media.buffers()[1], np.int64 if wide else np.int32)[media.offset : media.offset + len(media) + 1] if len(media) else np.zeros(1)
    unit = media.type.value_type.bit_width // 8 if pa.types.is_list(media.type) or pa.types.is_large_list(media.type) else 1
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_BYTES // unit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def fingerprints(df: DataFrame, ident: str, media: str, samples: Callable = samples_of_pcm, rate: int = RATE) -> DataFrame:
    """(id, print): array<int> of packed integers of each recording; `samples` decodes a value of the media column."""
    rows = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{media}`").alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in media_slices(batch):
                prints = [p.view(np.int32) for p in prints_of((samples(v) if v is not None else None for v in column_of(part, "media").to_pylist()), rate)]
                offs = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prints])]), pa.int32())
                yield pa.RecordBatch.from_arrays([column_of(part, "id"), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(prints)))], names=["id", "print"])

    return arrow_map(rows, run, f"id {dict(rows.dtypes)['id']}, print array<int>")


def classes_of(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, class) of every recording and (class, copies, print) of every class; hot classes are combined before the shuffle."""
    ids = prints.filter("id is not null and size(print) > 0").groupBy("id").agg(F.min(F.xxhash64("print")).alias("h1"), F.min(F.hash("print")).alias("h2"), F.min(F.size("print")).alias("n"))
    ids = stored(ids)
    least = ids.groupBy("h1", "h2", "n").agg(F.min("id").alias("class"), F.count("*").alias("copies"))
    least = stored(least)
    member = ids.join(least, ["h1", "h2", "n"]).select("id", "class")
    own = least.select("class", "copies").join(prints.select(F.col("id").alias("class"), "print"), "class").dropDuplicates(["class"])
    return member, own


def error_limit(frames: int) -> float:
    """The largest bit error of an overlap of so many integers that holds."""
    return MOST_ERROR * min(1.0, frames / FULL_FRAMES)


def _key_runs(prints: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sub-key, first place, length and number of the print of each run of equal sub-keys; the second kind of sub-key is told apart by a bit."""
    ends = np.cumsum([len(p) for p in prints], dtype=np.int64)
    p = np.concatenate([np.zeros(0, np.uint32), *prints])
    print_of = np.repeat(np.arange(len(prints)), np.diff(ends, prepend=0))
    runs = []
    for kind in (0, 1):
        k = (p >> np.uint32(kind * (32 - KEY_BITS)) & np.uint32((1 << KEY_BITS) - 1)).astype(np.int64) | kind << KEY_BITS
        begin = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (print_of[1:] != print_of[:-1]))[: len(k)])
        holder = print_of[begin]
        runs.append((k[begin], begin - np.append(0, ends)[holder], np.diff(np.append(begin, len(k))), holder))
    return tuple(np.concatenate(x) for x in zip(*runs, strict=True))


def _voted(pairs: Callable[[], Iterable[tuple[np.ndarray, ...]]], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that get LEAST_VOTES from pairs of runs (first cell and both lengths), in order, and their votes.

    A pair's votes rise by one a step, stay, and fall again. Cells are looked at in groups of GROUP first: those of a group have no more votes
    than the pairs that reach it are high. Only pairs that reach a group with enough are counted, by the changes of their slope.
    """
    groups = cells // GROUP + 1
    reach = np.zeros(groups, np.int64)

    def wide(cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pairs that may give a group more than one vote or reach several, the first and the last group of each, and their heights."""
        last, high = (cell + a + b - 2) // GROUP, np.minimum(a, b)
        w = np.flatnonzero((last != cell // GROUP) | (high > 1))
        return w, cell[w] // GROUP, last[w], high[w]

    for cell, a, b in pairs():
        reach += np.bincount(cell // GROUP, minlength=groups)
        _, first, last, high = wide(cell, a, b)
        more = np.zeros(groups + 1, np.int64)
        np.add.at(more, first, high)
        np.subtract.at(more, last + 1, high)
        reach += np.cumsum(more)[:-1]
    before = np.append(0, np.cumsum(rich := reach >= LEAST_VOTES))
    at, change = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for cell, a, b in pairs() if before[-1] else ():
        use = rich[cell // GROUP]
        w, first, last, _ = wide(cell, a, b)
        use[w] = before[last + 1] > before[first]
        cell, a, b = cell[use], a[use], b[use]
        turns = np.sort(np.concatenate([2 * cell + 1, 2 * (cell + a), 2 * (cell + b), 2 * (cell + a + b) + 1]))  # odd where the slope rises
        own, step = turns >> 1, (turns & 1) * 2 - 1
        if len(at):
            own, step = np.concatenate([at, own]), np.concatenate([change, step])
            order = np.argsort(own, kind="stable")
            own, step = own[order], step[order]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        at, change = own[begin], np.add.reduceat(step, begin) if len(begin) else step
    slope, size = np.cumsum(change), np.diff(at, append=at[-1:])
    end = np.cumsum(slope * size)  # votes before the next change
    most = np.flatnonzero(np.maximum(end, end - slope * (size - 1)) >= LEAST_VOTES)
    n = size[most]
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    votes = np.repeat((end - slope * (size - 1))[most], n) + k * np.repeat(slope[most], n)
    hold = votes >= LEAST_VOTES
    return (np.repeat(at[most], n) + k)[hold], votes[hold]


def _errors(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many bits of n integers differ, from the places given on."""
    out, ends, begin = np.zeros(len(n), np.int64), np.cumsum(n), 0
    while begin < len(n):
        done = int(ends[begin] - n[begin])
        end = max(begin + 1, int(np.searchsorted(ends, done + RUN_PAIRS, "right")))
        own = n[begin:end]
        first = ends[begin:end] - own - done
        k = np.arange(own.sum()) - np.repeat(first, own)
        out[begin:end] = np.add.reduceat(np.bitwise_count(x[np.repeat(x_at[begin:end], own) + k] ^ y[np.repeat(y_at[begin:end], own) + k]), first, dtype=np.int64)
        begin = end
    return out


def alignments(queries: list[np.ndarray], others: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, float]]:
    """(query, other, offset, votes, frames, bit error) of each pair of prints (uint32) with an offset that has votes and holds.

    Queries are taken together as far as they make RUN_PAIRS pairs of runs and have CELLS offsets.
    """
    lengths, asked = (np.array([len(p) for p in x], np.int64) for x in (others, queries))
    x_all, y_all = (np.concatenate([np.zeros(0, np.uint32), *x]) for x in (queries, others))
    x_first, y_first = np.cumsum(asked) - asked, np.cumsum(lengths) - lengths
    by = lambda runs, k: [v[order] for order in [np.argsort(runs[k], kind="stable")] for v in runs]
    keys, starts, sizes, holder = by(_key_runs(others), 0)
    own, at, size, query = by(_key_runs(queries), 3)
    low = np.searchsorted(keys, own, "left")
    count = np.searchsorted(keys, own, "right") - low
    steps = np.concatenate([[0], np.cumsum(count)])
    runs_of = np.searchsorted(query, np.arange(len(queries) + 1))
    most = max(1, CELLS // (int(lengths.sum()) + (int(asked.max(initial=0)) + 4) * len(others) + 1))
    begin = 0
    while begin < len(queries):
        end = min(len(queries), begin + most, begin + max(1, int(np.searchsorted(steps[runs_of[begin + 1 :]], steps[runs_of[begin]] + RUN_PAIRS, "right"))))
        widest = int(asked[begin:end].max())
        first = np.concatenate([[0], np.cumsum(lengths + widest + 4)])  # the cells of each recording's offsets, -widest first
        a, b = int(runs_of[begin]), int(runs_of[end])
        cuts = [a]
        while cuts[-1] < b:
            cuts.append(min(b, max(cuts[-1] + 1, int(np.searchsorted(steps, steps[cuts[-1]] + RUN_PAIRS, "right")) - 1)))
        place, base = first[holder] + starts, (query - begin) * first[-1] + widest + 1 - at - size

        def part(a: int, b: int, place: np.ndarray = place, base: np.ndarray = base) -> tuple[np.ndarray, ...]:
            n = count[a:b]
            y = np.arange(n.sum()) + np.repeat(low[a:b] - np.cumsum(n) + n, n)
            return np.repeat(base[a:b], n) + place[y], np.repeat(size[a:b], n), sizes[y]

        slices = list(zip(cuts, cuts[1:], strict=False))
        once = [part(*x) for x in slices] if len(slices) == 1 else []
        cell, votes = _voted(lambda: once or (part(*x) for x in slices), int(first[-1]) * (end - begin))  # noqa: B023
        i, cell = begin + cell // first[-1], cell % first[-1]
        j = np.searchsorted(first, cell, "right") - 1
        yield from _held(i, j, cell - first[j] - widest, votes, (x_all, x_first, asked), (y_all, y_first, lengths))
        begin = end


def _held(i: np.ndarray, j: np.ndarray, offset: np.ndarray, votes: np.ndarray, x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int, int, int, int, float]]:
    """Of each pair the offset with most votes that holds, then the least bit error, then the least offset; x and y are all integers, and each print's first and number."""
    x_at, y_at = x[1][i] + np.maximum(-offset, 0), y[1][j] + np.maximum(offset, 0)
    n = np.minimum(x[1][i] + x[2][i] - x_at, y[1][j] + y[2][j] - y_at)
    left = np.flatnonzero(n >= LEAST_FRAMES)
    left = left[np.lexsort((-votes[left], j[left], i[left]))]
    best: dict[tuple[int, int], tuple] = {}
    while len(left):  # those with most votes of each pair; the others only count if none of these holds
        fresh = np.append(True, (np.diff(i[left]) != 0) | (np.diff(j[left]) != 0))[: len(left)]
        pair = np.cumsum(fresh) - 1
        top = votes[left] == votes[left][fresh][pair]
        now = left[top]
        wrong = _errors(x[0], x_at[now], y[0], y_at[now], n[now])
        found = np.zeros(int(pair[-1]) + 1, bool)
        for k in np.flatnonzero(wrong <= 32 * n[now] * (MOST_ERROR * np.minimum(1.0, n[now] / FULL_FRAMES) + 1e-6)).tolist():
            own, frames = now[k], int(n[now[k]])
            error, key = round(int(wrong[k]) / (32 * frames), 6), (int(i[own]), int(j[own]))
            if error <= error_limit(frames):
                found[pair[top][k]] = True
                best[key] = min(best.get(key, (2.0,)), (error, int(offset[own]), int(votes[own]), frames))
        left = left[~top & ~found[pair]]
    for (a, b), (error, o, n_votes, frames) in sorted(best.items()):
        yield a, b, o, n_votes, frames, error


def blocks_of(prints: DataFrame, name: str) -> DataFrame:
    """(`name`: array of classes, `name`_sizes, `name`_codes) with about BLOCK integers a row."""
    n = prints.agg(F.sum(F.size("print"))).first()[0] or 0
    kind = dict(prints.dtypes)["class"]
    rows = prints.select("class", "print").repartition(max(1, -(-n // BLOCK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, codes, held = [], [], [], 0
        for batch in batches:
            ident = column_of(batch, "class")
            for i, p in enumerate(column_of(batch, "print")):
                own = p.values.to_numpy()
                if held and held + len(own) > 2 * BLOCK:
                    yield block(ident.type, ids, sizes, codes)
                    ids, sizes, codes, held = [], [], [], 0
                ids.append(ident[i].as_py())
                sizes.append(len(own))
                codes.append(own.tobytes())
                held += len(own)
        if ids:
            yield block(ident.type, ids, sizes, codes)

    def block(kind: pa.DataType, ids: list, sizes: list, codes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(codes)], pa.binary())], names=[name, f"{name}_sizes", f"{name}_codes"])

    return arrow_map(rows, run, f"{name} array<{kind}>, {name}_sizes array<int>, {name}_codes binary")


def matches(queries: DataFrame, all_prints: DataFrame) -> DataFrame:
    """(query, match, offset, votes, frames, bit_error): for each pair of classes the offset with most votes that holds.

    `queries` and `all_prints` have (class, print). Each block of queries goes to each block of recordings; these are dealt over
    as many tasks, as there are far more of them.
    """
    kind = dict(all_prints.dtypes)["class"]
    met = stored(blocks_of(all_prints, "match").withColumn("block", F.monotonically_increasing_id()))
    n = max(1, met.count())
    asked = blocks_of(queries, "query").crossJoin(F.broadcast(met.select("block")))  # a block's number for BLOCK integers
    pairs = met.repartition(n, "block").join(asked.repartition(n, "block"), "block").select("query", "query_sizes", "query_codes", "match", "match_sizes", "match_codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, prints = [], []
                for name in ("query", "match"):
                    sizes = column_of(batch, f"{name}_sizes")[i].values.to_numpy()
                    ids.append(column_of(batch, name)[i].values)
                    prints.append(np.split(np.frombuffer(column_of(batch, f"{name}_codes")[i].as_buffer(), np.uint32), np.cumsum(sizes)[:-1]))
                found = list(alignments(*prints))
                if found:
                    a, b, *rest = zip(*found, strict=True)
                    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(a)), ids[1].take(pa.array(b)), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], names=["query", "match", "offset", "votes", "frames", "bit_error"])

    return arrow_map(pairs, run, f"query {kind}, match {kind}, offset int, votes long, frames int, bit_error double")


def search(prints: DataFrame, every: int = QUERY_EVERY) -> DataFrame:
    """Recordings whose id is divisible by `every` against all: one row for each query and matching class."""
    member, own = classes_of(prints)
    own, member = stored(own), stored(member)
    asked = member.filter(F.col("id") % every == 0)
    queries = own.join(asked.select("class").distinct(), "class", "left_semi").select("class", "print")
    pairs = stored(matches(queries, own.select("class", "print")).join(own.select(F.col("class").alias("match"), "copies"), "match"))
    return asked.select(F.col("id").alias("query_id"), F.col("class").alias("query")).join(pairs, "query").select("query_id", F.col("query").alias("query_class"), F.col("match").alias("match_class"), "copies", "offset", "votes", "frames", "bit_error")


@lru_cache(1)
def _notes() -> np.ndarray:
    """A tenth of a second of each pitch class above 220 Hz, with an overtone."""
    t = np.arange(RATE // 10) / RATE
    base = 220 * 2 ** (np.arange(12)[:, None] / 12)
    return 0.6 * np.sin(2 * np.pi * base * t) + 0.3 * np.sin(4 * np.pi * base * t)


def melody_of(vector: list[float | None]) -> np.ndarray:
    """Recording of a vector: a tenth of a second for each number, whose 24ths give the pitch class; nulls are silent."""
    silent = np.array([x is None for x in vector], bool)
    steps = np.floor(np.array([x or 0.0 for x in vector], np.float64) * 24).astype(np.int64) % 12
    out = _notes()[steps]
    out[silent] = 0
    return out.reshape(-1)


def op8_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: every vector of `embeddings` is played as a melody, which stands for a media column."""
    return search(stored(fingerprints(table(sf_dir, "embeddings", spark), "vec_id", "embedding", melody_of)))


QUERIES = {"op8_audio_fingerprints": op8_audio_fingerprints}
SQL: dict[str, str] = {}
