"""BPE encoding and decoding as streaming transducers.

Encoding. A text is cut into pretokens; no merge crosses their borders, so the
tokens before a border are stable. Inside a pretoken a token is stable once the
merge list's *sufficient lookahead* has been read behind it (see `lookahead`).
A pretoken that fits in the lookahead has no stable token before its end; such
ones are merged together, as columns, by numpy, and kept in a cache that is
bounded by bytes. A longer one passes through `Transducer`, which emits tokens as
they become stable and holds a window of bounded size, and `pretokens` cuts even a
pretoken of many megabytes into blocks of `CHUNK` characters: besides the text
itself, memory doesn't depend on its length.

The bound: for rules in the order of rank let M[x] be how many bytes behind a
token x must be read to know that x is not taken by a rule seen so far whose
left part is x, and S[x] how many behind its end to know that x forms. A rule
(x, y) -> xy needs y to form and not to be taken from the right before, so it
needs len(y) + max(S[y], M[y]) bytes behind x; and xy forms under the same
condition: S[xy] = max(S[y], M[y]). Ranks fall along such a chain, so one pass
over the list computes the bound.

Decoding. Ids become bytes by a table; `TextDecoder` turns bytes into text as
they come and keeps no more than an unfinished UTF-8 sequence.

Defined cases: a null or empty text has no tokens; the added special token is
one id wherever its string stands; invalid ids are an error; repeated rows and
ties are rows of their own; a text of any length is read in chunks of `CHUNK`
characters; an empty table gives an empty result; input columns named like an
added column are replaced, and names that begin with two underscores are reserved.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .shared import arrow_map, table, without
from .textnum import column_of, row_slices

CHUNK = 1 << 16
CACHE_BYTES = 48 << 20  # of the cache, at ENTRY_BYTES for each pretoken beside its text
ENTRY_BYTES = 120
NO_RANK = np.int64(1 << 40)
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _split_one(points: list[int]) -> Iterator[tuple[str, int]]:
    """Class (L, N or O) of each code point, by how the library's splitter parts it from a letter and a digit."""
    splitter = ByteLevel(add_prefix_space=False, use_regex=True)
    for k in range(0, len(points), 10_000):
        part = points[k : k + 10_000]
        ends = {end for _, (_, end) in splitter.pre_tokenize_str(" ".join(f"a{chr(c)}1" for c in part))}
        for n, c in enumerate(part):
            yield ("L" if 4 * n + 1 not in ends else "N" if 4 * n + 2 not in ends else "O"), c


@lru_cache(2)
def pretoken_pattern(top: int) -> tuple[re.Pattern, tuple[re.Pattern, ...]]:
    """The byte-level splitting pattern over code points up to `top`, and its runs of letters, numbers, others and white space."""

    # code points newer than Python's tables: the library's own splitter tells their class
    newer = [c for c in range(min(top, 0x3FFFF) + 1) if unicodedata.category(chr(c)) == "Cn"]
    kinds: dict[int, str] = {}
    for kind, c in _split_one(newer):
        kinds[c] = kind

    def ranges(major: str) -> str:
        found, begin = [], None
        for c in range(top + 2):
            is_in = c <= top and (kinds[c] if c in kinds else unicodedata.category(chr(c))[0]) == major
            if is_in and begin is None:
                begin = c
            elif not is_in and begin is not None:
                found.append(re.escape(chr(begin)) + ("-" + re.escape(chr(c - 1)) if c - 1 > begin else ""))
                begin = None
        return "".join(found)

    letters, numbers = ranges("L"), ranges("N")
    classes = letters, numbers, f"^{SPACES}{letters}{numbers}", SPACES
    whole = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{classes[0]}]+| ?[{classes[1]}]+| ?[{classes[2]}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
    return whole, tuple(re.compile(f"[{c}]+") for c in classes)


def pieces_of(text: str, most: int = CHUNK) -> Iterator[list[str] | Iterator[str]]:
    """The pretokens of a text in order: lists of whole ones, and pretokens too long for a chunk as iterators of their parts.

    A pretoken may go on behind a chunk, and what begins one may be changed by three characters behind it; so the last
    three pretokens of a chunk are read again with the next one. A run that fills a chunk goes on as long as its class does.
    """
    whole, runs = pretoken_pattern(0xFFFF if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else sys.maxunicode)
    at = 0
    while len(text) - at > most:
        found = whole.findall(text[at : at + most])
        if len(found) > 3:
            yield found[:-3]
            at += sum(map(len, found[:-3]))
            continue
        run = next(r for r in runs if r.match(found[0][-1]))
        end = {"at": at + (found[0][0] == " " and run is not runs[3])}

        def parts(begin=at, run=run, end=end) -> Iterator[str]:
            spot = end["at"]
            while m := run.match(text, spot, spot + most):
                spot = m.end()
            # the last white space before another character isn't part of the run
            stop = spot - 1 if run is runs[3] and spot < len(text) and spot - begin > 1 else spot
            yield from (text[k : min(k + most, stop)] for k in range(begin, stop, most))
            end["at"] = stop

        if len(found[0]) < most // 4:  # one of the last three is the long one
            yield found[:1]
            at += len(found[0])
            continue
        yield parts()
        at = end["at"]
    yield whole.findall(text[at:])


class Merges:
    """Vocabulary and merge list of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        self.first = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        spot = self._spot(keys)
        self.table_key, self.table_rank = np.full(1 << 20, -1, np.int64), np.full(1 << 20, NO_RANK)
        self.table_key[spot[::-1]], self.table_rank[spot[::-1]] = keys[::-1], np.arange(len(keys))[::-1]
        lost = self.table_key[spot] != keys  # pairs whose place another pair has
        self.shared = np.zeros(1 << 20, bool)
        self.shared[spot[lost]] = True
        order = np.argsort(keys[lost], kind="stable")
        self.lost_key, self.lost_rank = keys[lost][order], np.flatnonzero(lost)[order]
        self.lookahead = self._lookahead(left.tolist(), right.tolist(), self.new.tolist())
        size = max(self.bytes_of) + 1
        self.token_len = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])[:-1]
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    def _lookahead(self, left: list[int], right: list[int], new: list[int]) -> int:
        taken: dict[int, int] = {}
        forms: dict[int, int] = {}
        for x, y, xy in zip(left, right, new, strict=True):
            behind = max(forms.get(y, 0), taken.get(y, 0))
            forms[xy] = max(forms.get(xy, 0), behind)
            taken[x] = max(taken.get(x, 0), len(self.bytes_of[y]) + behind)
        return max([*taken.values(), *forms.values(), 0])

    @staticmethod
    def _spot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK if it is not in the list."""
        key = a << 32 | b
        spot = self._spot(key)
        rank = np.where(self.table_key[spot] == key, self.table_rank[spot], NO_RANK)
        if len(self.lost_key):
            look = np.flatnonzero(self.shared[spot] & (rank == NO_RANK))
            at = np.minimum(np.searchsorted(self.lost_key, key[look]), len(self.lost_key) - 1)
            hit = self.lost_key[at] == key[look]
            rank[look[hit]] = self.lost_rank[at[hit]]
        return rank

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces one after another, and how many each has."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        sym = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done_sym, done_owner, done_at = [], [], []
        at = np.arange(len(sym))
        while len(sym):
            inner = owner[1:] == owner[:-1]
            rank = np.full(len(sym), NO_RANK)
            rank[:-1][inner] = self.ranks(sym[:-1][inner], sym[1:][inner])
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(sym)))
            still = np.repeat(best < NO_RANK, count)
            done_sym.append(sym[~still])
            done_owner.append(owner[~still])
            done_at.append(at[~still])
            sym, owner, at, rank, best = sym[still], owner[still], at[still], rank[still], np.repeat(best, count)[still]
            take = rank == best
            # in a run such as x x x the first two go together: take every other one of a run of adjacent hits
            here = np.flatnonzero(take)
            if len(here):
                run = np.flatnonzero(np.append(True, np.diff(here) > 1))
                step = np.arange(len(here)) - np.repeat(run, np.diff(np.append(run, len(here))))
                here = here[step % 2 == 0]
                sym[here] = self.new[rank[here]]
                keep = np.ones(len(sym), bool)
                keep[here + 1] = False
                sym, owner, at = sym[keep], owner[keep], at[keep]
        order = np.argsort(np.concatenate(done_at), kind="stable") if done_at else np.zeros(0, np.int64)
        ids = np.concatenate(done_sym)[order] if done_sym else np.zeros(0, np.int64)
        owners = np.concatenate(done_owner)[order] if done_owner else np.zeros(0, np.int64)
        return ids, np.bincount(owners, minlength=len(pieces))

    def bytes_for(self, ids: np.ndarray) -> bytes:
        sizes = self.token_len[ids]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.token_at[ids] - ends + sizes, sizes)
        return self.token_bytes[at].tobytes()


class Transducer:
    """Encodes one pretoken from a stream of bytes; holds the unstable bytes only."""

    def __init__(self, merges: Merges, block: int = 4096):
        self.merges, self.block, self.held = merges, max(block, 4 * merges.lookahead), b""

    def feed(self, data: bytes) -> Iterator[np.ndarray]:
        for at in range(0, len(data), self.block):
            self.held += data[at : at + self.block]
            ids, _ = self.merges.merge_all([self.held])
            ends = np.cumsum(self.merges.token_len[ids])
            n = int(np.searchsorted(ends, len(self.held) - self.merges.lookahead, "right"))
            if n:
                yield ids[:n]
                self.held = self.held[int(ends[n - 1]) :]

    def finish(self) -> np.ndarray:
        ids, _ = self.merges.merge_all([self.held])
        self.held = b""
        return ids


class Encoder:
    """Token ids of texts; finished pretokens are looked up in a cache of bounded size."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.clear()

    def clear(self) -> None:
        special = self.merges.special
        self.place: dict[str, int] = {s: k for k, s in enumerate(special)}
        self.ids = np.array(list(special.values()), np.int64)
        self.starts, self.counts = np.arange(len(special)), np.ones(len(special), np.int64)
        self.size = 0

    def learn(self, pretokens: set[str]) -> None:
        fresh = [p for p in pretokens if p not in self.place]
        if not fresh:
            return
        if self.size + sum(ENTRY_BYTES + len(p) for p in fresh) > CACHE_BYTES:
            self.clear()
            fresh = [p for p in pretokens if p not in self.place]
        coded = [p.encode() for p in fresh]
        self.size += sum(ENTRY_BYTES + len(p) for p in coded)
        ids, counts = self.merges.merge_all(coded)
        n = len(self.starts)
        begin = len(self.ids) + np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.place.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        self.ids, self.starts, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, begin]), np.concatenate([self.counts, counts])

    def lookup(self, pretokens: list[str]) -> np.ndarray:
        """Ids of pretokens that fit in the lookahead."""
        try:
            at = np.fromiter(map(self.place.__getitem__, pretokens), np.int64, len(pretokens))
        except KeyError:
            self.learn(set(pretokens))
            at = np.fromiter(map(self.place.__getitem__, pretokens), np.int64, len(pretokens))
        self.last_counts = counts = self.counts[at]
        ends = np.cumsum(counts)
        return self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[at] - ends + counts, counts)]

    def pretokens(self, text: str) -> Iterator[list[str] | Iterator[str]]:
        """What `pieces_of` gives of a text; a special token is a pretoken of its own."""
        special = self.split is not None and any(s in text for s in self.merges.special)
        for segment in self.split.split(text) if special else (text,):
            if special and segment in self.merges.special:
                yield [segment]
            elif segment:
                yield from pieces_of(segment)

    def long(self, parts: Iterator[str]) -> Iterator[np.ndarray]:
        """Ids of one pretoken, given in parts, as they become stable."""
        window = Transducer(self.merges)
        for part in parts:
            yield from window.feed(part.encode())
        yield window.finish()

    def stream(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text in pieces, each emitted as soon as it is stable."""
        most = self.merges.lookahead
        for piece in self.pretokens(text):
            if not isinstance(piece, list):
                yield from self.long(piece)
                continue
            begin = 0
            for k in [i for i, p in enumerate(piece) if len(p) > most]:
                yield self.lookup(piece[begin:k])
                yield from self.long(iter((piece[k],)))
                begin = k + 1
            yield self.lookup(piece[begin:])

    def streams(self, texts: list[str]) -> Iterator[Iterator[np.ndarray]]:
        """A stream of ids for each text; the texts of a slice that have short pretokens only are looked up together."""
        most, short = self.merges.lookahead, []
        for t in texts:
            ps = [p for piece in self.pretokens(t) for p in piece] if len(t) <= CHUNK else None
            short.append(None if ps is None or max(map(len, ps), default=0) > most else ps)
        ids = self.lookup([p for ps in short if ps for p in ps])
        ends = np.concatenate([[0], np.cumsum(self.last_counts)])
        at = n = 0
        for text, ps in zip(texts, short, strict=True):
            if ps is None:
                yield self.stream(text)
                continue
            m = n + len(ps)
            to = at + int(ends[m] - ends[n])
            yield iter((ids[at:to],))
            at, n = to, m


class TextDecoder:
    """Byte-to-text state machine; state between pushes is an unfinished UTF-8 sequence."""

    def __init__(self):
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, data: bytes) -> str:
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(2)
def merges_of(path: str) -> Merges:
    return Merges(path)


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    return Encoder(merges_of(path))


def decode(ids: Iterator[np.ndarray], path: str | None = None) -> Iterator[str]:
    """Text of a stream of id arrays, as soon as it is known."""
    merges, machine = merges_of(path or default_path()), TextDecoder()
    for piece in ids:
        yield machine.push(merges.bytes_for(piece))
    yield machine.finish()


def encode_column(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """All columns of df and array<int> `ids`; the tokenizer file must be at `path` on every executor."""
    file = path or default_path()
    kept = without(df, [ids]).columns
    source = df.select(*[f"`{c}`" for c in kept], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(file)
        for part in row_slices(batches, "__text"):
            rows = [np.concatenate([np.zeros(0, np.int64), *ids]) for ids in encoder.streams([t or "" for t in column_of(part, "__text").to_pylist()])]
            offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(rows), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(column_of(part, c) for c in kept), values], names=[*kept, ids])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), f"`{ids}` array<int>"])
    return arrow_map(source, run, schema)


DIGESTS = (("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string"))


def round_trip(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, ids: str | None = None) -> DataFrame:
    """Columns `keep`, number of tokens, digest of the ids and digest of the text decoded from them; with `ids` the ids too, as array<int>.

    Ids and decoded text pass through as streams; neither is held whole, but for ids that are asked for.
    """
    file = path or default_path()
    kept = [c for c in keep if c not in {d[0] for d in DIGESTS} and c != ids]
    source = df.select(*[f"`{c}`" for c in kept], F.col(f"`{text}`").alias("__text"))

    def one(encoder: Encoder, stream: Iterator[np.ndarray], seen: list) -> tuple[int, str, str]:
        n, of_ids, of_text, machine = 0, hashlib.sha256(), hashlib.sha256(), TextDecoder()
        for piece in stream:
            n += len(piece)
            of_ids.update(piece.astype("<u4").tobytes())
            of_text.update(machine.push(encoder.merges.bytes_for(piece)).encode())
            if ids is not None:
                seen.append(piece.astype(np.int32))
        of_text.update(machine.finish().encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(file)
        for part in row_slices(batches, "__text"):
            seen: list[np.ndarray] = []
            cols = list(zip(*(one(encoder, s, seen) for s in encoder.streams([t or "" for t in column_of(part, "__text").to_pylist()])), strict=True))
            out = [*(column_of(part, c) for c in kept), *(pa.array(c, d[1]) for c, d in zip(cols, DIGESTS, strict=True))]
            if ids is not None:
                offs = pa.array(np.concatenate([[0], np.cumsum(cols[0])]), pa.int32())
                out.append(pa.ListArray.from_arrays(offs, pa.array(np.concatenate([np.zeros(0, np.int32), *seen]))))
            yield pa.RecordBatch.from_arrays(out, names=[*kept, *(d[0] for d in DIGESTS), *([ids] if ids is not None else [])])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), *(f"{d[0]} {d[2]}" for d in DIGESTS), *([f"`{ids}` array<int>"] if ids is not None else [])])
    return arrow_map(source, run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(sf_dir, "documents", spark), ["doc_id"])


QUERIES = {"op2_bpe": op2_bpe}
SQL: dict[str, str] = {}
