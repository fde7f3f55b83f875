"""Substring dedup: fuzzy passages that documents share, found by collinear chaining.

1. *Seeds*: the `K`-word shingles of every whole text, at every place. Texts are kept in
   *blocks* of about `BLOCK_BYTES`. Every seed that several documents have gets one first
   place, the least (doc_id, position): `first_places` asks for it in two rounds. First each
   block sends 32 bits of each of its distinct seeds, dealt by the seeds' leading bits, and
   is told which of them another document may have; most seeds end here. Of the rest it
   sends the whole seed and its least place, and is told the first place of those that are
   shared in truth. A block sends a seed once, however often it stands there, so a seed that
   a large part of the documents has is no hot key.
2. Other places meet the first one only: anchors grow with the seeds, not with the
   pairs of documents that share a passage. Where neighbouring seeds of a document
   stood first in different documents, as they do when pieces of a passage stand
   elsewhere too, the *pair* of them (each seed with all that follow within
   `NEAR` words) is a seed of its own, with a first place and two anchors, which are found
   by the same two rounds. Whether a pair counts depends on its seeds and their distance alone,
   so two documents with both seeds agree on that.
3. *Chains*: the anchors of a document and a source are chained in order of
   both positions; the score of a chain is `K` for each anchor less `GAP` for
   each word between anchors on either side, and the best predecessor is found
   with a Fenwick tree of prefix maxima, or, where all anchors grow on both sides, is the anchor before. Where anchors follow
   each other word by word on both sides, the two at the ends and every `K`th between them are kept: they cover all words of
   the run. All anchors of a document stand in its block, so they are chained there and none is shuffled.
4. *Alignment*: a chain takes its words along from its own block and goes to its source's block; one that many
   chains read is sent to several tasks. Between anchors the longest
   common subsequence counts, at both ends the alignment grows within a band of
   `DRIFT` words until its score falls `DROP` below its best. Spans with at least
   `PERCENT` per cent of matching words hold; else the chain counts without its
   growth, or is split at its largest gap and its parts are aligned. Growth mostly ends after a few words, so a chain takes
   `FIRST_REACH` words along at either end, or `REACH` where other chains cover half of those; the few that need more are aligned again.
5. *Exact repeats* need no chain: each `MIN_WORDS`-word shingle that a document with
   a lesser id has too is a span, whatever other partners its seeds have. All
   seeds inside such a shingle stand in both documents. Where their first places follow each
   other word by word in one document, that document has the shingle; equal shingles have
   equal first places, so the others only meet each other, by a hash of those.
6. Spans of a document that touch and have the same source are merged; those of `MIN_WORDS`
   words or more are passages, so short pieces from several documents don't add up to one. The copy in the document with the least id stays.

Words are split at white space and A-Z lower-cased. Defined cases: a null text
has no words; a document whose text equals that of a lesser doc_id is one
passage as a whole (if it has MIN_WORDS words); rows with a null doc_id are
left alone; of a doc_id with several texts the one with the least `text_key` is the
document, its repeated rows are treated alike, and rows with other texts are left
alone; repeats within one document aren't passages; runs of one line of a few
words, repeated, have no order to chain and are found as exact repeats only; an
empty table gives no passages; all columns of the input are kept, and names that
begin with two underscores are reserved.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_map, scratch, stored, table, text_key
from .textnum import BASE, STEP, column_of, lower_ascii, mix, row_slices, shingle_hashes, span_hashes, string_bytes, words_of  # noqa: F401

K = 5
BLOCK_BYTES = 4 << 20  # of the texts of a block
PART_KEYS = 2_000_000  # keys that are compared together, about
PAIR_CELLS = 4_000_000  # pairs of seeds of a block that are looked at together
NEAR = 40  # words between the seeds of a pair
GAP = 0.03
REACH = 64  # words that an alignment may grow beyond a chain at either end
FIRST_REACH = 20  # of which so many are fetched first
DRIFT = 4  # words by which a growing alignment may shift
DROP = 16  # growth ends where the score has fallen so far below its best; a match is 1, any difference -2
PERCENT = 80
MIN_WORDS = 40
JOIN_WORDS = 3  # spans with so few words between them are one
ALIGN_WORDS = 2_000_000  # words of chains that are aligned in one task, about
ALIGN_ROWS = 8192  # chains that are aligned together
ROUNDS = 4  # in which chains are aligned, one after the other, so that a part of the blocks and words is on disk at once


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = string_bytes(col)
    buf = lower_ascii(buf)
    starts, ends, first = words_of(buf, offs)
    return span_hashes(buf, starts, ends), first


def _seeds(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place of each seed of the rows' words; the hashes are those of `shingle_hashes`."""
    n = max(0, len(words) - K + 1)
    h = np.zeros(n, np.uint64)
    for j in range(K):
        h = (h ^ h >> np.uint64(29)) * BASE + words[j : n + j]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    at = np.flatnonzero(first[owner + 1] - np.arange(n) >= K)  # the others begin in one row and end in the next
    return mix(h[at] + np.uint64(K)), owner[at], at - first[owner[at]]


BLOCK = {"ids": np.int64, "first": np.int32, "codes": np.uint8, "known": np.uint32, "rest": np.uint32}
ALIGNED_BY = [c for c in BLOCK if c != "rest"]  # words are compared by half their hashes


def blocks_of(texts: DataFrame) -> DataFrame:
    """(block, n, ids, first, codes, known, rest) of rows (id, text) with distinct long ids: blocks in order of id, known by the least one, and their words.

    All but the first two are arrays, as bytes (`BLOCK`): the documents, the first word of each and the number of words, and for
    each word its place among the block's distinct word hashes, all lowest bytes first and no more bytes than are needed, compressed; of those hashes the
    upper and the lower halves. Texts are split into words here only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, "text", BLOCK_BYTES):
            order = np.argsort(column_of(part, "id").to_numpy())
            ids = column_of(part, "id").to_numpy()[order]
            words, first = _words(column_of(part, "text").take(pa.array(order)))
            coded = pa.array(words).dictionary_encode()
            planes = coded.indices.to_numpy().astype("<u4").view(np.uint8).reshape(-1, 4).T[: _planes(len(coded.dictionary))]
            codes, known = np.frombuffer(pa.compress(planes.tobytes(), "zstd", asbytes=True), np.uint8), coded.dictionary.to_numpy()
            arrays = (ids, first, codes, known >> np.uint64(32), known)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:1]), pa.array([len(words)], pa.int64()), *(pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(arrays, BLOCK.values(), strict=True))], names=["block", "n", *BLOCK])

    return arrow_map(texts, run, "block long, n long, ids binary, first binary, codes binary, known binary, rest binary")


def _planes(known: int) -> int:
    """Bytes that a place among so many words needs."""
    return (known.bit_length() + 7) // 8


def _block(block: dict[str, pa.Scalar]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of a block of texts, the first word of each (and their number), and the hashes of all words, or their upper halves if the block has no others."""
    ids, first, known = (np.frombuffer(block[c].as_buffer(), BLOCK[c]) for c in ("ids", "first", "known"))
    n, places = int(first[-1]), np.zeros(int(first[-1]), np.int64)
    codes = np.frombuffer(pa.decompress(block["codes"].as_buffer(), n * _planes(len(known)), "zstd"), np.uint8)
    for k in range(_planes(len(known))):
        places |= codes[k * n : (k + 1) * n].astype(np.int64) << 8 * k
    if "rest" in block:
        known = known.astype(np.uint64) << np.uint64(32) | np.frombuffer(block["rest"].as_buffer(), BLOCK["rest"])
    return ids, first.astype(np.int64), known[places]


def seed_keys(block: dict[str, pa.Scalar]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of a block of texts, the document of each and its place there, in order of document and place."""
    ids, first, words = _block(block)
    hashes, owner, place = _seeds(words, first)
    return hashes, ids[owner], place


SHARED = {"id": np.int64, "q": np.int32, "src": np.int64, "s": np.int32, "many": np.uint8}


def _places(block: dict[str, pa.Scalar]) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(block[c].as_buffer(), kind) for c, kind in SHARED.items())


def _codes(src: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A first place as one number, which stands for its seed."""
    return mix(mix(src.view(np.uint64) + STEP) + s.astype(np.uint64))


def _near(block: dict[str, pa.Scalar]) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each pair of seeds of a block of shared places, in order.

    Two seeds of two places each, with different first documents, have one document in common at most, so such pairs aren't made.
    """
    ids, q, src, _, many = _places(block)
    at = np.cumsum(np.append(False, ids[1:] != ids[:-1])[: len(ids)]) << 32 | q
    n = np.searchsorted(at, at + NEAR, "right") - np.arange(len(at)) - 1
    steps = np.concatenate([[0], np.cumsum(n)])
    left, right, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(steps, steps[begin] + PAIR_CELLS, "right")) - 1)
        i = np.repeat(np.arange(begin, end), n[begin:end])
        j = np.arange(len(i)) - np.repeat(steps[begin:end] - steps[begin], n[begin:end]) + i + 1
        use = (src[i] != src[j]) & (many[i] | many[j]).astype(bool)
        left.append(i[use])
        right.append(j[use])
        begin = end
    return np.concatenate(left), np.concatenate(right)


def pair_keys(block: dict[str, pa.Scalar]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of seeds of a block of shared places, the document of each and its two places (the second as the distance, in the last byte)."""
    ids, q, src, s, _ = _places(block)
    i, j = _near(block)
    code = _codes(src, s)
    return mix(code[i] * BASE + code[j]), ids[i], q[i].astype(np.int64) << 8 | (q[j] - q[i])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the first and the last place of each among the keys given, and how often it comes."""
    order = np.argsort(keys)
    begin = np.flatnonzero(np.append(True, keys[order[1:]] != keys[order[:-1]]))[: len(keys)]
    if not len(keys):
        return keys, order, order, order
    return keys[order[begin]], np.minimum.reduceat(order, begin), np.maximum.reduceat(order, begin), np.diff(np.append(begin, len(keys)))


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict[str, pa.Scalar]]:
    for i in range(table.num_rows):
        yield {c: table.column(k)[i] for k, c in enumerate(table.schema.names)}


def _table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(schema.items())})


def _flat(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)])


def first_places(blocks: DataFrame, keys: Callable, parts: int) -> DataFrame:
    """(block, at, src, place, many): for keys that several documents have their number among the block's distinct keys and their first place.

    `keys` gives a block's keys, their documents and their places, in order; many: a key has three places or more. All
    but the block are arrays, as bytes: uint32, int64, int64, uint8.
    """
    cuts_of = lambda own: np.searchsorted((own >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1)).tolist()
    asked = {"part": pa.int32(), "block": pa.int64(), "prints": pa.binary(), "several": pa.binary()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _rows(batch):
                every, ids, _ = keys(block)
                own, first, last, _ = _distinct(every)
                several, prints, cuts = (ids[first] != ids[last]).astype(np.uint8), own.astype(np.uint32), cuts_of(own)
                rows = [(p, block["block"].as_py(), prints[a:b].tobytes(), several[a:b].tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                yield from _table(asked, rows).to_batches()

    def met(rows: pa.Table) -> pa.Table:
        prints = _flat(rows, "prints", np.uint32)
        order = np.argsort(prints)
        same = prints[order[1:]] == prints[order[:-1]]
        use = np.empty(len(prints), bool)
        use[order] = np.append(False, same) | np.append(same, False)
        use |= _flat(rows, "several", np.uint8).astype(bool)
        sizes = [len(x.as_buffer()) for x in rows.column("several")]
        ends = np.cumsum(sizes)
        return _table({"part": pa.int32(), "block": pa.int64(), "bits": pa.binary()}, [(p, b, np.packbits(use[e - n : e]).tobytes()) for p, b, n, e in zip(rows.column("part").to_pylist(), rows.column("block").to_pylist(), sizes, ends, strict=True)])

    sent = {"part": pa.int32(), "block": pa.int64(), "at": pa.binary(), "keys": pa.binary(), "ids": pa.binary(), "places": pa.binary(), "counts": pa.binary()}

    def send(block: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        for x in _rows(block):
            every, ids, places = keys(x)
            own, first, last, n = _distinct(every)
            cuts, counts = cuts_of(own), (np.minimum(n, 3) | (ids[first] != ids[last]).astype(np.int64) << 2).astype(np.uint8)
            for p, bits in zip(told.column("part").to_pylist(), told.column("bits").to_pylist(), strict=True):
                at = cuts[p] + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[p + 1] - cuts[p]))
                if len(at):
                    rows.append((p, x["block"].as_py(), at.astype(np.uint32).tobytes(), own[at].tobytes(), ids[first[at]].tobytes(), places[first[at]].astype(np.int64).tobytes(), counts[at].tobytes()))
        return _table(sent, rows)

    def answer(rows: pa.Table) -> pa.Table:
        at, every, ids, places, counts = (_flat(rows, c, kind) for c, kind in (("at", np.uint32), ("keys", np.uint64), ("ids", np.int64), ("places", np.int64), ("counts", np.uint8)))
        order = np.argsort(every)
        begin = np.flatnonzero(np.append(True, every[order[1:]] != every[order[:-1]]))
        size = np.diff(np.append(begin, len(order)))
        shared = (size > 1) | (np.maximum.reduceat(counts[order], begin) > 3)
        many = (np.add.reduceat((counts[order] & 3).astype(np.int64), begin) > 2).astype(np.uint8)
        src = np.minimum.reduceat(ids[order], begin)
        place = np.minimum.reduceat(np.where(ids[order] == np.repeat(src, size), places[order], np.iinfo(np.int64).max), begin)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(begin)), size)
        out, end = [], 0
        for block, x in zip(rows.column("block").to_pylist(), rows.column("counts"), strict=True):
            own = slice(end, end := end + len(x.as_buffer()))
            use = shared[group[own]]
            g = group[own][use]
            out.append((block, at[own][use].tobytes(), src[g].tobytes(), place[g].tobytes(), many[g].tobytes()))
        return _table({"block": pa.int64(), "at": pa.binary(), "src": pa.binary(), "place": pa.binary(), "many": pa.binary()}, out)

    with scratch() as kept:
        bits = stored(arrow_map(blocks, ask, "part int, block long, prints binary, several binary").groupBy("part").applyInArrow(met, "part int, block long, bits binary"))
        rows = blocks.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(send, "part int, block long, at binary, keys binary, ids binary, places binary, counts binary")
        return kept(rows.groupBy("part").applyInArrow(answer, "block long, at binary, src binary, place binary, many binary"))


def _told(every: np.ndarray, told: pa.Table) -> tuple[np.ndarray, ...]:
    """Which of a block's keys `first_places` told of, and the document, place and `many` of each of those."""
    order = np.argsort(every)
    rank = np.empty(len(every), np.int64)
    rank[order] = np.cumsum(np.append(False, every[order[1:]] != every[order[:-1]])[: len(every)])
    n = int(rank.max()) + 1 if len(rank) else 0
    src, place, many = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.uint8)
    at = _flat(told, "at", np.uint32)
    src[at], place[at], many[at] = _flat(told, "src", np.int64), _flat(told, "place", np.int64), _flat(told, "many", np.uint8)
    use = np.flatnonzero(src[rank] >= 0)
    rank = rank[use]
    return use, src[rank], place[rank], many[rank]


def shared_places(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, n, id, q, src, s, many): the places of a block's seeds that several documents have, with the first place of each seed; arrays, as bytes (`SHARED`)."""
    schema = {"block": pa.int64(), "n": pa.int64(), **{c: pa.binary() for c in SHARED}}

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        for x in _rows(block) if told.num_rows else ():
            every, ids, places = seed_keys(x)
            use, src, s, many = _told(every, told)
            rows.append((x["block"].as_py(), len(use), *(v.astype(kind).tobytes() for v, kind in zip((ids[use], places[use], src, s, many), SHARED.values(), strict=True))))
        return _table(schema, rows)

    told = first_places(blocks, seed_keys, parts)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "block long, n long, id binary, q binary, src binary, s binary, many binary")


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Where rows in order differ from the row before in one of the columns."""
    n = len(columns[0])
    return np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns]))[:n] if n else np.zeros(0, bool)


def _anchors(ids: np.ndarray, src: np.ndarray, q: np.ndarray, s: np.ndarray, thin: bool = True) -> tuple[np.ndarray, ...]:
    """The distinct anchors in order of id, src, q and s; those at the ends of runs and every Kth, if they are to be thinned out."""
    _, source = np.unique(src, return_inverse=True)
    _, own = np.unique(ids, return_inverse=True)
    pair, place = own << 32 | source, q.astype(np.int64) << 32 | s
    order = np.lexsort((place, pair))
    fresh = order[_groups(pair[order], place[order])]
    if thin:
        fresh = fresh[run_ends(q[fresh], s[fresh], pair[fresh])]
    return ids[fresh], src[fresh], q[fresh].astype(np.int32), s[fresh].astype(np.int32)


CHAINS = {"id": pa.int64(), "block": pa.int64(), "src": pa.int64(), "q0": pa.int32(), "q1": pa.int32(), "s0": pa.int32(), "s1": pa.int32(), "qs": pa.binary(), "ss": pa.binary()}


def chains_of(shared: DataFrame) -> DataFrame:
    """(id, block, src, q0, q1, s0, s1, qs, ss): ends of chains of two anchors or more, in words, and their anchors (int32, as bytes).

    The anchors are the places of a seed with its first place in another document, and those of pairs of seeds. All of a
    document stand in its block, so they are chained where they are found.
    """

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        found = [_chains(0, *(np.zeros(0, np.int64) for _ in range(4)))]
        for x in _rows(block):
            ids, q, src, s, _ = _places(x)
            use = ids != src
            anchors = [_anchors(ids[use], src[use], q[use], s[use])]
            if told.num_rows:
                every, ids, places = pair_keys(x)
                use, src, first, _ = _told(every, told)
                other = src != ids[use]
                use, src, first = use[other], src[other], first[other]
                q, s = places[use], first
                anchors.append(_anchors(np.tile(ids[use], 2), np.tile(src, 2), np.concatenate([q >> 8, (q >> 8) + (q & 255)]), np.concatenate([s >> 8, (s >> 8) + (s & 255)])))
            found.append(_chains(x["block"].as_py(), *_anchors(*(np.concatenate(c) for c in zip(*anchors, strict=True)))))
        return pa.concat_tables(found)

    told = first_places(shared, pair_keys, _parts(shared, F.sum("n") * 3))  # about three pairs a place
    return shared.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "id long, block long, src long, q0 int, q1 int, s0 int, s1 int, qs binary, ss binary")


def _parts(blocks: DataFrame, keys: Column) -> int:
    return max(1, -(-int(blocks.agg(keys).first()[0] or 0) // PART_KEYS))


def exact_spans(shared: DataFrame) -> DataFrame:
    """(id, lo, hi): stretches, or single ones of their shingles of MIN_WORDS words, that stand in a document with a lesser id."""
    steps = MIN_WORDS - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _rows(batch):
                ids, q, src, s, _ = _places(block)
                last = np.arange(steps, len(q))  # a window is known by its last and its first seed
                last = last[(ids[last] == ids[last - steps]) & (q[last] - q[last - steps] == steps)]
                breaks = np.cumsum(np.append(False, (np.diff(s) != 1) | (np.diff(src) != 0))[: len(q)])
                straight = breaks[last] == breaks[last - steps]
                known = last[straight & (ids[last] != src[last])] - steps
                bent = last[~straight] - steps
                code, hashes = _codes(src, s), np.zeros(len(bent), np.uint64)
                for j in [*range(0, steps, K), steps]:  # seeds that cover the window's words
                    hashes = (hashes ^ hashes >> np.uint64(29)) * BASE + code[bent + j]
                begin = known[np.flatnonzero(np.append(True, (np.diff(known) != 1))[: len(known)])]  # straight windows side by side are one stretch
                end = known[np.flatnonzero(np.append(np.diff(known) != 1, True)[: len(known)])]
                cuts = np.concatenate([bent, begin])
                h = pa.array(np.concatenate([mix(hashes).view(np.int64), np.zeros(len(begin), np.int64)]), mask=np.arange(len(cuts)) >= len(bent))
                hi = pa.array(np.concatenate([q[bent], q[end]]).astype(np.int32) + MIN_WORDS, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids[cuts]), pa.array(q[cuts], pa.int32()), hi, h], names=["id", "q", "hi", "h"])

    found = stored(arrow_map(shared, run, "id long, q int, hi int, h long"))
    hashed = found.filter("h is not null")
    first = stored(hashed.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("last")).filter("least != last").select("h", "least"))
    again = hashed.join(first, "h").filter("id != least")
    return again.unionByName(found.filter("h is null"), allowMissingColumns=True).select("id", F.col("q").alias("lo"), "hi")


def best_chains(q: np.ndarray, s: np.ndarray) -> list[list[int]]:
    """Disjoint chains of anchors, best first; anchors are sorted by q, then s.

    f(j) = K + max(0, max over i before j on both sides of f(i) - GAP * distance(i, j)). The distance is a
    sum of coordinates, so f(i) + GAP * (q_i + s_i) is kept in a Fenwick tree of prefix maxima over s.
    """
    n = len(q)
    rank = {v: r + 1 for r, v in enumerate(sorted(set(s.tolist())))}
    size = len(rank)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, prev = [0.0] * n, [-1] * n
    waiting: deque[int] = deque()
    qs, ss = q.tolist(), s.tolist()
    for j in range(n):
        while waiting and qs[waiting[0]] < qs[j]:  # only anchors with a lesser q are predecessors
            i = waiting.popleft()
            value, r = (score[i] + GAP * (qs[i] + ss[i]), i), rank[ss[i]]
            while r <= size:
                if tree[r] < value:
                    tree[r] = value
                r += r & -r
        top, r = (-1e18, -1), rank[ss[j]] - 1
        while r > 0:
            if tree[r] > top:
                top = tree[r]
            r -= r & -r
        gain = top[0] - GAP * (qs[j] + ss[j])
        score[j] = K + max(0.0, gain)
        if gain > 0:
            prev[j] = top[1]
        waiting.append(j)
    used, chains = [False] * n, []
    for j in sorted(range(n), key=lambda x: -score[x]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = prev[j]
        if len(chain) > 1:
            chains.append(chain[::-1])
    return chains


def run_ends(q: np.ndarray, s: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Which of the distinct anchors (of each group) count for chains: of each run of anchors that follow each other word by word the ends and every Kth."""
    group = np.zeros(len(q), np.int64) if group is None else group
    order = np.lexsort((q, q - s, group))
    if not len(q):
        return np.zeros(0, bool)
    step = (np.diff(q[order]) == 1) & (np.diff(s[order]) == 1) & (np.diff(group[order]) == 0)
    inner = np.append(False, step) & np.append(step, False)
    begin = np.maximum.accumulate(np.where(np.append(True, ~step), np.arange(len(q)), 0))
    use = np.empty(len(q), bool)
    use[order] = ~inner | ((np.arange(len(q)) - begin) % K == 0)
    return use


def straight_chains(q: np.ndarray, s: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last anchor of the chains of `best_chains` of two anchors or more, of groups that begin at `begin` and grow in q and s.

    There the best predecessor is the anchor before, so f(j) = K + max(0, f(j - 1) - GAP * distance), counted in hundredths: the
    sum of the steps less its least value so far. A chain ends where no later anchor of its run has a higher score.
    """
    n, far = len(q), 1 << 32
    if not n:
        return begin, begin
    step = np.concatenate([[0], 100 * K - round(100 * GAP) * (np.diff(q).astype(np.int64) + np.diff(s))])
    step[begin] = -far * K
    total = np.cumsum(step)
    score = total - np.minimum.accumulate(total)
    fresh = score == 0  # no gain by the anchor before
    run = np.cumsum(fresh)
    after = np.maximum.accumulate((score - run * far * K)[::-1])[::-1]  # the highest score from here to the end of the run
    last = np.append(fresh[1:], True)
    last[:-1] |= score[:-1] - run[:-1] * far * K >= after[1:]
    first = np.flatnonzero(fresh | np.append(True, last[:-1]))
    end = np.flatnonzero(last)
    return first[end > first], end[end > first]


def _lists(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> pa.Array:
    """Binary values of n numbers each, from `begin` on."""
    ends = np.concatenate([[0], np.cumsum(n)])
    own = values[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(own)])


def _chains(block: int, ids: np.ndarray, src: np.ndarray, q: np.ndarray, s: np.ndarray) -> pa.Table:
    """The chains (`CHAINS`) of a block's distinct anchors in order."""
    begin = np.flatnonzero(_groups(ids, src))
    size = np.diff(np.append(begin, len(ids)))
    bent = np.append(False, (np.diff(q) <= 0) | (np.diff(s) <= 0))[: len(q)]
    bent[begin] = False
    bent = np.add.reduceat(bent, begin, dtype=np.int64) > 0 if len(begin) else bent
    straight = ~bent & (size > 1)
    use = np.flatnonzero(np.repeat(straight, size))
    first, last = straight_chains(q[use], s[use], np.cumsum(size[straight]) - size[straight])
    others = [a + np.array(chain) for a, n in zip(begin[bent].tolist(), size[bent].tolist(), strict=True) for chain in best_chains(q[a : a + n], s[a : a + n])]
    sizes = np.array([len(x) for x in others], np.int64)
    n = np.append(last - first + 1, sizes)
    first = np.append(first, len(use) + np.cumsum(sizes) - sizes)
    use = np.concatenate([use, *others])
    lo, hi = use[first], use[first + n - 1]
    columns = [ids[lo], np.full(len(lo), block), src[lo], q[lo], q[hi] + K, s[lo], s[hi] + K]
    lists = [_lists(x[use].astype(np.int32), first, n) for x in (q, s)]
    return pa.table({c: pa.array(x, kind) if isinstance(x, np.ndarray) else x for (c, kind), x in zip(CHAINS.items(), [*columns, *lists], strict=True)})


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def grown(a: list[int], b: list[int]) -> tuple[int, int]:
    """How many words of two sequences an alignment from their beginnings takes in until its score is best, within a band of DRIFT."""
    return _grown(a, b)[:2]


def _grown(a: list[int], b: list[int]) -> tuple[int, int, bool]:
    """As `grown`; and whether it ended before the end of both sequences, so that more words wouldn't change it."""
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    best, end = 0, (0, 0)
    width = 2 * DRIFT + 1
    row = [-1000] * DRIFT + [-2 * d for d in range(DRIFT + 1)]  # cell d: d - DRIFT more words of b than of a
    for i, x in enumerate(a):
        after, left = [-1000] * width, -1000
        for d in range(max(0, DRIFT - i - 1), width):
            j = i + d - DRIFT  # word of b that stands against x
            if j >= len(b):
                break
            value = row[d] + (1 if j >= 0 and b[j] == x else -2) if j >= 0 else -1000
            if d + 1 < width and row[d + 1] - 2 > value:
                value = row[d + 1] - 2
            if left - 2 > value:
                value = left - 2
            after[d] = left = value
            if value > best:
                best, end = value, (i + 1, j + 1)
        row = after
        if max(row) < best - DROP:
            return same + end[0], same + end[1], i + DRIFT < len(b)
    return same + end[0], same + end[1], False


def matched(a: list[int], b: list[int], q: list[int], s: list[int]) -> int:
    """Words that agree along the anchors (q, s): the anchors' own, and the longest common subsequences between them."""
    n, i, j = 0, q[0], s[0]
    for x, y in zip(q, s, strict=True):
        if x > i and y > j:
            n += common_words(a[i:x], b[j:y])
        taken = max(i - x, j - y, 0)
        if taken < K:
            n += K - taken
            i, j = x + K, y + K
    return n


def held_parts(a: list[int], b: list[int], q: list[int], s: list[int], reach: int = REACH) -> list[tuple[int, int]] | None:
    """Spans of a that align with b: the whole chain of anchors (q, s), or, split at the largest gap, such parts of two anchors or more.

    None if growth may need more than `reach` words, where that is less than REACH.
    """
    found, parts = [], [(0, len(q))]
    while parts:
        x, y = parts.pop()
        if y - x < 2:
            continue
        lo, hi, s_lo, s_hi = q[x], q[y - 1] + K, s[x], s[y - 1] + K
        n = hi - lo if a[lo:hi] == b[s_lo:s_hi] else matched(a, b, q[x:y], s[x:y])
        right, left = _grown(a[hi : hi + reach], b[s_hi : s_hi + reach]), _grown(a[max(0, lo - reach) : lo][::-1], b[max(0, s_lo - reach) : s_lo][::-1])
        if reach < REACH and not (right[2] and left[2]):
            return None
        more = common_words(a[hi : hi + right[0]], b[s_hi : s_hi + right[1]]) + common_words(a[lo - left[0] : lo], b[s_lo - left[1] : s_lo])
        if 100 * (n + more) >= PERCENT * max(hi - lo + left[0] + right[0], s_hi - s_lo + left[1] + right[1]):
            found.append((lo - left[0], hi + right[0]))
        elif 100 * n >= PERCENT * max(hi - lo, s_hi - s_lo):
            found.append((lo, hi))
        else:
            cut = max(range(x + 1, y), key=lambda i: q[i] - q[i - 1] + s[i] - s[i - 1])
            parts += [(x, cut), (cut, y)]
    return found


def _by_block(rows: DataFrame, blocks: DataFrame, by: str, fn: Callable, schema: str, rounds: int = 1) -> Iterator[DataFrame]:
    """`fn` of the chains whose column `by` names a block, and of that block; each round takes its share of the blocks and all chains of those.

    A block that many chains read is sent to several tasks, one for ALIGN_WORDS words of them, about. The table of their number has a row a block.
    """
    words = F.sum(F.col("q1") - F.col("q0") + F.col("s1") - F.col("s0") + 2 * REACH)
    parts = stored(rows.groupBy(F.col(by).alias("block")).agg(F.ceil(words / ALIGN_WORDS).cast("int").alias("parts")))
    for k in range(rounds):
        turn = lambda c: F.pmod(F.hash(c), F.lit(rounds)) == k  # noqa: B023, E731
        own = parts.filter(turn("block"))
        sent = blocks.select("block", *ALIGNED_BY).join(F.broadcast(own), "block").select("block", *ALIGNED_BY, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        several = F.broadcast(own.filter("parts > 1").withColumnRenamed("block", by))
        dealt = rows.filter(turn(by)).join(several, by, "left").withColumn("part", F.coalesce(F.pmod(F.hash("id", "src", "q0", "s0"), "parts"), F.lit(0))).drop("parts")
        yield dealt.groupBy(by, "part").cogroup(sent.groupBy("block", "part")).applyInArrow(fn, schema)


def grown_rows(a: np.ndarray, a_at: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_n: np.ndarray, way: int) -> tuple[np.ndarray, ...]:
    """`_grown` of many rows: the sequences begin at a_at and b_at, have a_n and b_n words, and are read forwards or backwards (way 1 or -1).

    Gives the words taken in of both, whether growth ended, and how many words agree from the beginning on.
    """
    n, most = len(a_at), int(min(a_n.max(initial=0), b_n.max(initial=0)))
    word = lambda x, at, k: x[np.clip(at + way * k, 0, max(0, len(x) - 1))] if len(x) else np.zeros(np.broadcast(at, k).shape, x.dtype)
    k = np.arange(most)
    other = (word(a, a_at[:, None], k) != word(b, b_at[:, None], k)) | (k >= np.minimum(a_n, b_n)[:, None])
    same = np.where(other.any(axis=1), other.argmax(axis=1), most) if most else np.zeros(n, np.int64)
    best, end_a, end_b, ended = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    a_at, b_at, a_n, b_n = a_at + way * same, b_at + way * same, a_n - same, b_n - same
    d = np.arange(2 * DRIFT + 1, dtype=np.int32)
    own, i = np.flatnonzero(a_n > 0), 0
    row = np.tile(np.where(d < DRIFT, -1000, 2 * (DRIFT - d)).astype(np.int32), (len(own), 1))
    while len(own):
        j = i + d - DRIFT
        hit = word(a, a_at[own], i)[:, None] == word(b, b_at[own][:, None], j)
        value = np.where(j >= 0, row + np.where(hit, np.int32(1), np.int32(-2)), np.int32(-1000))
        value[:, :-1] = np.maximum(value[:, :-1], row[:, 1:] - 2)
        value = np.maximum.accumulate(value + 2 * d, axis=1) - 2 * d
        value[(j >= b_n[own][:, None]) | (j < -1)] = -1000
        top = value.argmax(axis=1)
        high = value[np.arange(len(own)), top]
        up = high > best[own]
        best[own[up]], end_a[own[up]], end_b[own[up]] = high[up], i + 1, j[top[up]] + 1
        low = high < best[own] - DROP
        ended[own[low]] = i + DRIFT < b_n[own[low]]
        i += 1
        left = ~low & (a_n[own] > i)
        own, row = own[left], value[left]
    return same + end_a, same + end_b, ended, same


def aligned(rows: pa.Table, block: pa.Table) -> Iterator[pa.Table]:
    """(id, src, lo, hi, block, s0, s1, qs, ss) of chains with their words, and of their sources' block, as `held_parts` finds them; the last five are null.

    Chains that need more words than their `reach` come as they are. Mostly a chain's words agree, and all rows are aligned together.
    """
    documents, first, words = _block(next(_rows(block)))
    for at in range(0, rows.num_rows, ALIGN_ROWS):
        part = rows.slice(at, ALIGN_ROWS).combine_chunks()
        ids, src, q0, q1, s0, s1, qf, n_q, reach = (part.column(c).to_numpy().astype(np.int64) for c in ("id", "src", "q0", "q1", "s0", "s1", "q_from", "q_n", "reach"))
        buf, offs = string_bytes(part.column("q_words"))
        a = np.frombuffer(np.ascontiguousarray(buf), np.uint32)
        a_lo, a_end = offs[:-1] // 4, offs[1:] // 4
        doc = np.searchsorted(documents, src)
        b_lo, b_end = np.maximum(first[doc], first[doc] + s0 - reach), np.minimum(first[doc + 1], first[doc] + s1 + reach)
        x0, x1, y0, y1 = a_lo + q0 - qf, a_lo + q1 - qf, first[doc] + s0, first[doc] + s1
        right = grown_rows(a, x1, a_end - x1, words, y1, b_end - y1, 1)
        left = grown_rows(a, x0 - 1, x0 - a_lo, words, y0 - 1, y0 - b_lo, -1)
        whole_right = (qf + a_end - a_lo == n_q) & (b_end == first[doc + 1])  # the texts end there
        whole_left = (qf == 0) & (b_lo == first[doc])
        more = (reach < REACH) & ~((right[2] | whole_right) & (left[2] | whole_left))
        exact = (q1 - q0 == s1 - s0) & ~more
        n, rank = (q1 - q0)[exact], np.flatnonzero(exact)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = a[np.repeat(x0[exact], n) + k] != words[np.repeat(y0[exact], n) + k]
        exact[rank[np.unique(np.repeat(np.arange(len(n)), n)[differ])]] = False
        agree = q1 - q0
        for da, db, _, same, begin_a, begin_b, way in ((*right, x1, y1, 1), (*left, x0 - 1, y0 - 1, -1)):
            agree = agree + np.where((da == same) & (db == same), same, 0)
            for i in np.flatnonzero(exact & ((da != same) | (db != same))).tolist():
                u, v, x, y = int(da[i]), int(db[i]), int(begin_a[i]), int(begin_b[i])
                agree[i] += common_words(a[x : x + u].tolist(), words[y : y + v].tolist()) if way > 0 else common_words(a[x - u + 1 : x + 1].tolist(), words[y - v + 1 : y + 1].tolist())
        wide = 100 * agree >= PERCENT * np.maximum(q1 - q0 + left[0] + right[0], s1 - s0 + left[1] + right[1])
        lo, hi = np.where(wide, q0 - left[0], q0)[exact], np.where(wide, q1 + right[0], q1)[exact]
        out = [(ids[exact], src[exact], lo, hi)]
        for i in np.flatnonzero(~exact & ~more).tolist():
            qs, ss = (np.frombuffer(part.column(c)[i].as_buffer(), np.int32).tolist() for c in ("qs", "ss"))
            base = int(b_lo[i] - first[doc[i]])
            held = held_parts(a[a_lo[i] : a_end[i]].tolist(), words[b_lo[i] : b_end[i]].tolist(), [x - int(qf[i]) for x in qs], [x - base for x in ss], int(reach[i]))
            more[i] = held is None
            if held:
                spans = np.array(held) + qf[i]
                out.append((np.full(len(spans), ids[i]), np.full(len(spans), src[i]), spans[:, 0], spans[:, 1]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        done = pa.table({c: pa.array(x, kind) for (c, kind), x in zip(ALIGNED.items(), columns, strict=False)})
        again = part.filter(pa.array(more))
        yield pa.concat_tables([pa.table({c: done.column(c) if c in done.column_names else pa.nulls(done.num_rows, kind) for c, kind in ALIGNED.items()}), again.rename_columns({"q0": "lo", "q1": "hi"}).select(list(ALIGNED)).cast(pa.schema(list(ALIGNED.items())))])


ALIGNED = {"id": pa.int64(), "src": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "block": pa.int64(), "home": pa.int64(), "s0": pa.int32(), "s1": pa.int32(), "qs": pa.binary(), "ss": pa.binary()}
SENT = {**CHAINS, "home": pa.int64(), "reach": pa.int32(), "q_from": pa.int32(), "q_n": pa.int32(), "q_words": pa.binary()}


def aligned_spans(chains: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, src, lo, hi) of chains (`CHAINS`, and `home`, the block of the source), or parts of chains, whose alignment holds."""
    sql = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    schema_of = lambda columns: ", ".join(f"{c} {sql[kind]}" for c, kind in columns.items())

    def near(chains: DataFrame, reach: int, rounds: int) -> Iterator[DataFrame]:
        def send(rows: pa.Table, block: pa.Table) -> pa.Table:
            documents, first, words = _block(next(_rows(block)))
            doc = np.searchsorted(documents, rows.column("id").to_numpy())
            n, q0, q1 = np.diff(first)[doc], rows.column("q0").to_numpy(), rows.column("q1").to_numpy()
            ends = [np.bincount(first[doc] + x, minlength=len(words) + 1) for x in (q0, q1)]
            covered = np.concatenate([[0], np.cumsum(np.cumsum(ends[0] - ends[1]) > 0)])  # words of chains before each word
            after = covered[first[doc] + np.minimum(n, q1 + reach)] - covered[first[doc] + q1]
            before = covered[first[doc] + q0] - covered[first[doc] + np.maximum(0, q0 - reach)]
            own = np.where(np.maximum(after, before) >= FIRST_REACH // 2, REACH, reach)  # where other chains go on, growth does too, mostly
            begin, end = np.maximum(0, q0 - own), np.minimum(n, q1 + own)
            more = {"reach": pa.array(own, pa.int32()), "q_from": pa.array(begin, pa.int32()), "q_n": pa.array(n, pa.int32()), "q_words": _lists(words, first[doc] + begin, end - begin)}
            return pa.table({c: more[c] if c in more else rows.column(c) for c in SENT})

        def align(rows: pa.Table, block: pa.Table) -> pa.Table:
            return pa.concat_tables([pa.table({c: pa.array([], kind) for c, kind in ALIGNED.items()}), *(aligned(rows, block) if rows.num_rows else ())])

        sent = stored(next(_by_block(chains, blocks, "block", send, schema_of(SENT))))
        return _by_block(sent, blocks, "home", align, schema_of(ALIGNED), rounds)

    with scratch() as kept:  # a round's shuffled words and blocks go before the next one's are made
        first = reduce(DataFrame.unionAll, [kept(part) for part in near(chains, FIRST_REACH, ROUNDS)])
    (more,) = near(first.filter("qs is not null").withColumnsRenamed({"lo": "q0", "hi": "q1"}), REACH, 1)
    return first.filter("qs is null").unionAll(more).select("id", "src", "lo", "hi")


def homes_of(blocks: DataFrame) -> DataFrame:
    """(no, block, n): the block of each document, and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _rows(batch):
                ids, first = (np.frombuffer(x[c].as_buffer(), BLOCK[c]) for c in ("ids", "first"))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), x["block"].as_py())), pa.array(np.diff(first), pa.int32())], names=["no", "block", "n"])

    return arrow_map(blocks.select("block", "ids", "first"), run, "no long, block long, n int")


def merged(spans: DataFrame, *by: str) -> DataFrame:
    """(by, lo, hi): spans that touch are one; shorter ones than MIN_WORDS go."""
    order = Window.partitionBy(*by).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cuts = spans.withColumn("new", F.coalesce(F.col("lo") > before + JOIN_WORDS, F.lit(True)).cast("int"))
    runs = cuts.withColumn("run", F.sum("new").over(order)).groupBy(*by, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.filter(F.col("hi") - F.col("lo") >= MIN_WORDS).select(*by, "lo", "hi")


def passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, passages): word spans of each document, [lo, hi), that an earlier document has too."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    with scratch() as kept:
        ids = stored(rows.groupBy("id").agg(F.min("key").alias("key")))
        first = stored(ids.groupBy("key").agg(F.min("id").alias("first")))
        # documents are numbered in order of their ids
        numbers = stored(first.select(F.col("first").alias("id"), F.col("key").alias("own")).orderBy("id").withColumn("no", F.monotonically_increasing_id()))
        texts = rows.join(numbers, "id").filter("key = own").dropDuplicates(["id"]).select(F.col("no").alias("id"), "text")
        blocks = stored(blocks_of(texts))
        homes = stored(homes_of(blocks))
        with scratch() as kept_longer:  # without the shared places from here on
            with scratch() as kept_here:
                shared = kept_here(shared_places(blocks, _parts(blocks, F.sum("n"))))
            exact = kept_longer(exact_spans(shared))
            chains = kept_longer(chains_of(shared).join(homes.select(F.col("no").alias("src"), F.col("block").alias("home")), "src"))
        held = aligned_spans(chains, blocks)
        spans = merged(merged(held, "id", "src").select("id", "lo", "hi").unionAll(exact), "id").withColumnRenamed("id", "no").join(numbers, "no").select("id", "lo", "hi")
        found = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("passages")).join(ids, "id").select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), "passages")
        long = homes.filter(F.col("n") >= MIN_WORDS).join(numbers, "no").select(F.col("own").alias("key"), "n")
        whole = ids.join(first, "key").filter("id != first").join(long, "key").select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), "n")
        return kept(found.unionAll(whole.select("doc_id", "text_key", F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"))).alias("passages"))))


def with_passages(docs: DataFrame, found: DataFrame, text: str = "text", name: str = "__spans") -> DataFrame:
    """docs with the passages of each row's text as column `name`, null where there are none."""
    own = found.select("doc_id", F.col("text_key").alias("__key"), F.col("passages").alias(name))
    return docs.withColumn("__key", text_key(F.col(f"`{text}`"))).join(own, ["doc_id", "__key"], "left").drop("__key")


def without_passages(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """docs with the passages cut out of their texts (and n_chars adjusted); rows without a word left over go."""
    marked = with_passages(docs, found, text)
    order = docs.columns
    kept = [c for c in order if c != text]
    source = marked.select(*[f"`{c}`" for c in kept], F.col(f"`{text}`").alias("__text"), "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, "__text"):
            col = column_of(part, "__text")
            buf, offs = string_bytes(col)
            starts, _, first = words_of(buf, offs)
            out, hit = col.to_pylist(), []
            for i, spans in enumerate(column_of(part, "__spans").to_pylist()):
                if not spans:
                    hit.append(False)
                    continue
                own = np.append(starts[first[i] : first[i + 1]], offs[i + 1])
                left, at = [], offs[i]
                for x in spans:
                    left.append(buf[at : own[x["lo"]]].tobytes())
                    at = own[x["hi"]]
                left.append(buf[at : offs[i + 1]].tobytes())
                out[i] = b"".join(left).decode()
                hit.append(True)
            yield pa.RecordBatch.from_arrays([*(column_of(part, c) for c in kept), pa.array(out, pa.string()), pa.array(hit)], names=[*kept, "__text", "__hit"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if not f.name.startswith("__")), "__text string, __hit boolean"])
    cut = arrow_map(source, run, schema).filter(r"not __hit or __text rlike '[^\\x20\\x09-\\x0D]'").withColumnRenamed("__text", text)
    if "n_chars" in order:
        cut = cut.withColumn("n_chars", F.when(F.col("__hit"), F.length(text).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return cut.select(*order)


def dedup_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    return without_passages(docs, passages(docs, text), text)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark).select("doc_id", "text")
    rows = with_passages(docs, passages(docs), name="spans").select("doc_id", "spans")
    size = F.aggregate("spans", F.lit(0), lambda acc, x: acc + x.hi - x.lo)
    return rows.select("doc_id", F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).alias("n_passages"), F.coalesce(size, F.lit(0)).alias("n_words_repeated"), F.coalesce(F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x.lo, x.hi)), ","), F.lit("")).alias("spans"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
SQL: dict[str, str] = {}
