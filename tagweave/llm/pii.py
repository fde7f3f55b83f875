"""Personal data: rules for e-mail addresses, IP addresses, cards and phones, and a skip-chain conditional random field.

The rules (`base_spans`) give base spans, which always stay. The random field finds
mentions that the rules miss because of how they are written: in tables, with
marks after each word, without the plus sign, with `[at]` or `[.]`, with other
separators. Its nodes are the tokens (runs without white space) that have a digit or
`@`; tokens without any can't be part of such a span, so their label is certain and
they only serve as features of their neighbours. The potentials:

* of a node: features of its shape, digits, checks and neighbours, hashed into
  `BUCKETS` weights for each label;
* of neighbours: nodes with at most one token between them, and that without letters
  and digits, share a matrix over label pairs;
* of repeated or similar tokens anywhere in the document: equal letters and digits,
  equal digits, or an equal local part of an address. Each occurrence is linked with
  the one before, so the links grow with the tokens and not with their pairs.

Labels of tokens in base spans are given. Sum-product messages run over all links
of a slice of documents at once until they settle or `ROUNDS` are over; a token whose
label has a marginal of `SURE` is taken, neighbours with one label are joined, and
an added span must pass a plain check of its kind and touch no base span.

The field is fitted by pseudo-likelihood on at most `MAX_TRAIN` documents with
digits or `@` and at most `TRAIN_CHARS` characters (those whose hashed id is
least); the rules label their tokens, and every mention is repeated in a disturbed
spelling, so that the field learns spellings that the rules don't know. All documents
are searched, whole.

Defined cases: null and empty texts have no spans; a text of any length is searched
whole, in linear time (a task's memory grows with its longest text); repeated
rows are rows of their own and get equal spans; without any document to fit on nothing is
added; an empty table gives an empty result; input columns named like an added one are replaced.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, table, without
from .textnum import column_of, row_slices, string_bytes
from .toxicity import _lbfgs

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: none
BUCKETS = 1 << 12
LINKS = 4  # neighbours, equal tokens, equal digits, equal local parts
MAX_TRAIN = 2000
TRAIN_CHARS = 20000
PENALTY = 0.05
FIT_ROUNDS = 60
ROUNDS = 40
SETTLED = 1e-4
SURE = 0.9
SPAN_TYPE = "array<struct<kind:string,start:long,end:long,added:boolean>>"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ACTIVE = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"[0-9]+|[^\W0-9_]+|.", re.DOTALL)
EDGE = re.compile(r"^[^\w+(]+|[^\w)]+$")
AT = re.compile(r"@|\[at\]|\(at\)", re.IGNORECASE)


def luhn(digits: str) -> bool:
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(sum(divmod(2 * int(d), 10)) for d in back[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses, from each `@` to both sides, so that long words without one cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all base spans, in order; places are code points."""
    spans = [(a, 0, b) for a, b in emails(text)]
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts = [(d.start(), d.end()) for d in DIGITS.finditer(text, m.start(), m.end())]
        for i in range(0, len(parts) - 3, 4):
            if all(b - a < 4 or not text[a:b].lstrip("0")[3:] for a, b in parts[i : i + 4]) and all(int(text[a:b].lstrip("0") or 0) <= 255 for a, b in parts[i : i + 4]):
                spans.append((parts[i][0], 1, parts[i + 3][1]))
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(spans)


@dataclass
class Field:
    """Log potentials: of features, and of label pairs of each kind of link; the first of a pair stands earlier."""

    weights: np.ndarray  # BUCKETS x LABELS
    pairs: np.ndarray  # LINKS x LABELS x LABELS


@dataclass
class Graph:
    """Nodes and links of one or several documents."""

    tokens: list[int]  # number of each node's token
    buckets: list[int]  # features of all nodes, one after another
    sizes: list[int]  # features of each node
    links: list[tuple[int, int, int]]  # earlier node, later node, kind


def _shape(core: str) -> str:
    return "".join(f"d{min(len(r), 20)}" if r[0].isdigit() else "a" if r[0].isalpha() else r for r in RUN.findall(core))


def _features(tokens: Sequence[str], i: int, cores: dict[int, str], run_digits: int) -> Iterator[str]:
    core, digits = cores[i], "".join(DIGITS.findall(cores[i]))
    yield "bias"
    yield f"shape {_shape(core)}"
    yield f"digits {len(digits)} {min(run_digits, 30)}"
    yield f"at {bool(AT.search(core))} dots {min(core.count('.'), 5)} letters {any(map(str.isalpha, core))}"
    yield f"plus {core[:1] == '+'} bracket {core[:1] == '('}"
    if 14 <= len(digits) <= 19:
        yield f"luhn {luhn(digits)}"
    numbers = DIGITS.findall(core)
    if len(numbers) == 4 and len(digits) <= 12:
        yield f"octets {all(int(n) <= 255 for n in numbers)} {any(map(str.isalpha, core))}"
    for side, j in (("before", i - 1), ("after", i + 1)):
        near = tokens[j] if 0 <= j < len(tokens) else ""
        yield f"{side} {_shape(cores.get(j) or EDGE.sub('', near))}"


def _keys(core: str) -> Iterator[tuple[int, str]]:
    """What repeated and similar tokens have in common, by the kind of link."""
    plain = "".join(filter(str.isalnum, core)).lower()
    if len(plain) >= 3:
        yield 1, plain
    digits = "".join(DIGITS.findall(core))
    if len(digits) >= 7:
        yield 2, digits
    address = AT.split(core, maxsplit=1)
    if len(address) == 2:
        local = "".join(filter(str.isalnum, address[0])).lower()
        if len(local) >= 4:
            yield 3, local


def graph_of(tokens: Sequence[str]) -> Graph:
    """Nodes, their features and links for the tokens of one document."""
    active = [i for i, t in enumerate(tokens) if ACTIVE.search(t)]
    cores = {i: EDGE.sub("", tokens[i]) for i in active}
    joined = [i - h == 1 or (i - h == 2 and not any(map(str.isalnum, tokens[h + 1]))) for h, i in zip(active, active[1:], strict=False)]
    runs = np.cumsum([0, *(not j for j in joined)]).tolist() if active else []
    digits: dict[int, int] = {}
    for i, r in zip(active, runs, strict=True):
        digits[r] = digits.get(r, 0) + sum(map(len, DIGITS.findall(cores[i])))
    graph, last = Graph(active, [], [], [(k, k + 1, 0) for k, j in enumerate(joined) if j]), {}
    for k, i in enumerate(active):
        found = [zlib.crc32(f.encode()) % BUCKETS for f in _features(tokens, i, cores, digits[runs[k]])]
        graph.buckets += found
        graph.sizes.append(len(found))
        for key in _keys(cores[i]):
            if key in last:
                graph.links.append((last[key], k, key[0]))
            last[key] = k
    return graph


def _unary(weights: np.ndarray, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[buckets], np.cumsum(sizes) - sizes, axis=0)


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, j], n) for j in range(values.shape[1])], axis=1)


def marginals(field: Field, unary: np.ndarray, links: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Label marginals of all nodes by loopy sum-product message passing; a node with given >= 0 has that label."""
    own = unary - np.logaddexp.reduce(unary, axis=1, keepdims=True)
    fixed = given >= 0
    own[fixed] = -1e9
    own[fixed, given[fixed]] = 0
    if len(links):
        a, b, kind = links.T
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        pair = np.concatenate([field.pairs[kind], field.pairs[kind].transpose(0, 2, 1)])  # source label, target label
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        sent = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            held = own + _sums(sent, target, len(own))
            new = np.logaddexp.reduce((held[source] - sent[back])[:, :, None] + pair, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            moved = float(np.abs(np.exp(new) - np.exp(sent)).max())
            sent = 0.5 * (sent + new) if moved > SETTLED else new  # damped, since links form circles
            if moved <= SETTLED:
                break
        own = own + _sums(sent, target, len(own))
    return np.exp(own - np.logaddexp.reduce(own, axis=1, keepdims=True))


def _labels(spans: Sequence[tuple[int, int, int]], words: Sequence[tuple[int, int]], active: Sequence[int]) -> np.ndarray:
    """Label that the base spans give to each node, or -1."""
    out, at = np.full(len(active), -1), 0
    spans = sorted(spans)
    for k, i in enumerate(active):
        start, end = words[i]
        while at < len(spans) and spans[at][2] <= start and all(s[2] <= start for s in spans[at : at + 1]):
            at += 1
        touching = []
        for s in spans[at:]:
            if s[0] >= end:
                break
            if s[2] > start:
                touching.append(s[1])
        if touching:
            out[k] = min(touching) + 1
    return out


def _plausible(kind: int, mention: str) -> bool:
    """The plain check that an added span must pass."""
    numbers = DIGITS.findall(mention)
    digits = "".join(numbers)
    if kind == 0:
        sides = AT.split(mention)
        return len(sides) == 2 and all(any(map(str.isalnum, s)) for s in sides) and "." in sides[1]
    if kind == 1:
        return len(numbers) == 4 and len(digits) <= 12 and all(int(n) <= 255 for n in numbers)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and not any(map(str.isalpha, mention))


def _added(text: str, words: Sequence[tuple[int, int]], graph: Graph, chances: np.ndarray, base: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the nodes whose label is sure; neighbours with one label are one mention of a card or a phone."""
    best = np.where(chances.max(axis=1) >= SURE, chances.argmax(axis=1), 0).tolist()
    near = {(a, b) for a, b, kind in graph.links if kind == 0}
    groups: list[tuple[int, int, int]] = []  # kind, first and last node
    for k, label in enumerate(best):
        if not label:
            continue
        if groups and label > 2 and groups[-1][0] == label and groups[-1][2] == k - 1 and (k - 1, k) in near:
            groups[-1] = (label, groups[-1][1], k)
        else:
            groups.append((label, k, k))
    out, at = [], 0
    ends = np.maximum.accumulate([s[2] for s in base]) if base else []
    for label, a, b in groups:
        start, end = words[graph.tokens[a]][0], words[graph.tokens[b]][1]
        mention = text[start:end]
        left = re.match(r"[^\w+(]*", mention).end()
        right = len(mention) - re.match(r"[^\w]*", mention[::-1]).end()
        start, end = start + left, start + right
        at = int(np.searchsorted([s[0] for s in base], end)) if base else 0
        if start < end and not (at and ends[at - 1] > start) and _plausible(label - 1, text[start:end]):
            out.append((start, label - 1, end))
    return out


def find_in(texts: Sequence[str], field: Field | None) -> list[list[tuple[int, int, int, bool]]]:
    """(start, number of the kind, end, added) of all spans of each text, in order."""
    bases = [base_spans(t) for t in texts]
    if field is None:
        return [[(*s, False) for s in b] for b in bases]
    words = [[m.span() for m in WORD.finditer(t)] for t in texts]
    graphs = [graph_of([t[a:b] for a, b in w]) for t, w in zip(texts, words, strict=True)]
    nodes = [len(g.tokens) for g in graphs]
    shift = np.concatenate([[0], np.cumsum(nodes)]).astype(np.int64)
    if not shift[-1]:
        return [[(*s, False) for s in b] for b in bases]
    unary = _unary(field.weights, np.array([x for g in graphs for x in g.buckets]), np.array([x for g in graphs for x in g.sizes]))
    links = np.array([(a + int(s), b + int(s), kind) for g, s in zip(graphs, shift[:-1], strict=True) for a, b, kind in g.links], np.int64).reshape(-1, 3)
    given = np.concatenate([_labels(b, w, g.tokens) for b, w, g in zip(bases, words, graphs, strict=True)])
    chances = marginals(field, unary, links, given)
    chances[given >= 0] = 0  # base spans stand for these
    return [
        sorted([*((*s, False) for s in base), *((*s, True) for s in _added(t, w, g, chances[a:b], base))]) if b > a else [(*s, False) for s in base]
        for t, w, g, base, a, b in zip(texts, words, graphs, bases, shift[:-1], shift[1:], strict=True)
    ]


# --- fitting


def _disturbed(tokens: Sequence[str], labels: Sequence[int], rng: random.Random) -> tuple[list[str], list[int]]:
    """The labelled tokens and their neighbours once more, in another spelling."""
    mark = rng.choice(["", "", "!!", "###", "$$$", ",", "***"])
    out: list[str] = []
    own: list[int] = []
    bars = rng.random() < 0.3
    drop_plus = rng.random() < 0.5
    for i, (token, label) in enumerate(zip(tokens, labels, strict=True)):
        if not (label or any(labels[max(0, i - 2) : i + 3]) or ACTIVE.search(token)):
            continue
        if label == 1 and rng.random() < 0.6:
            token = token.replace("@", rng.choice(["[at]", "(at)", "@"])).replace(".", rng.choice([".", "[.]"]))
        elif label == 2 and rng.random() < 0.6:
            token = token.replace(".", rng.choice(["[.]", "-", ","]))
        elif label == 3 and rng.random() < 0.6:
            between = rng.choice([".", "/", "_", "--"])
            token = re.sub(r"([0-9]{4})(?=[0-9])", rf"\1{between}", token)
        elif label == 4 and drop_plus:
            token = token.lstrip("+")
        out.append(token + mark)
        own.append(label)
        if bars:
            out.append("|")
            own.append(0)
    return out, own


def training_rows(docs: DataFrame, text: str = "text") -> list:
    """Nodes of at most MAX_TRAIN documents: features, label, and link partners' labels."""
    whole = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    share = min(1.0, 50 * MAX_TRAIN / max(1, whole.count()))
    some = whole.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= TRAIN_CHARS))
    chosen = some.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(MAX_TRAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, "text"):
            rows: list[tuple[list[int], int, list[int]]] = []
            for doc_id, body in zip(column_of(part, "doc_id").to_pylist(), column_of(part, "text").to_pylist(), strict=True):
                words = [m.span() for m in WORD.finditer(body)]
                tokens = [body[a:b] for a, b in words]
                labels = np.zeros(len(tokens), int)
                active = [i for i, t in enumerate(tokens) if ACTIVE.search(t)]
                labels[active] = np.maximum(_labels(base_spans(body), words, active), 0)
                again, own = _disturbed(tokens, labels.tolist(), random.Random(zlib.crc32(str(doc_id).encode())))
                every, tags = [*tokens, *again], [*labels.tolist(), *own]
                graph = graph_of(every)
                near: list[list[int]] = [[] for _ in graph.tokens]
                for a, b, kind in graph.links:  # as one number: kind, side and the partner's label
                    near[b].append(kind * 2 * LABELS + tags[graph.tokens[a]])
                    near[a].append(kind * 2 * LABELS + LABELS + tags[graph.tokens[b]])
                begin = np.cumsum([0, *graph.sizes]).tolist()
                rows += [(graph.buckets[begin[k] : begin[k + 1]], tags[i], near[k]) for k, i in enumerate(graph.tokens)]
            if rows:
                buckets, labels_, near_ = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.list_(pa.int32())), pa.array(labels_, pa.int32()), pa.array(near_, pa.list_(pa.int32()))], names=["buckets", "label", "near"])

    return arrow_map(chosen, run, "buckets array<int>, label int, near array<int>").collect()  # MAX_TRAIN documents of TRAIN_CHARS at most


def fit(docs: DataFrame, text: str = "text") -> Field | None:
    """The field, by maximal penalised pseudo-likelihood: each node's label given its features and its partners' labels."""
    rows = sorted(training_rows(docs, text), key=lambda r: (r.label, r.buckets, r.near))
    if not rows:
        return None
    buckets, sizes = np.concatenate([r.buckets for r in rows]).astype(np.int64), np.array([len(r.buckets) for r in rows])
    near, links = np.array([x for r in rows for x in r.near], np.int64), np.array([len(r.near) for r in rows])
    label, n = np.array([r.label for r in rows]), len(rows)
    owner, linked = np.repeat(np.arange(n), sizes), np.repeat(np.arange(n), links)
    wide = BUCKETS + LINKS * 2 * LABELS

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x.reshape(wide, LABELS)
        scores = _sums(w[buckets], owner, n) + _sums(w[BUCKETS + near], linked, n)
        log = scores - np.logaddexp.reduce(scores, axis=1, keepdims=True)
        miss = np.exp(log)
        miss[np.arange(n), label] -= 1
        slope = np.concatenate([_sums(miss[owner], buckets, BUCKETS), _sums(miss[linked], near, wide - BUCKETS)])
        return float(-log[np.arange(n), label].sum() + PENALTY / 2 * (x @ x)), slope.ravel() + PENALTY * x

    w = _lbfgs(loss, np.zeros(wide * LABELS), FIT_ROUNDS).reshape(wide, LABELS)
    sides = w[BUCKETS:].reshape(LINKS, 2, LABELS, LABELS)
    # a link's matrix is the mean of what its two ends learnt; [earlier label, later label]
    return Field(w[:BUCKETS], (sides[:, 0] + sides[:, 1].transpose(0, 2, 1)) / 2)


def find(df: DataFrame, field: Field | None, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns `keep` (all by default) and `spans`: kind, start and end (code points, end exclusive) and whether the field added it."""
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != "spans"]
    source = without(df, ["spans"]).select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), f"spans {SPAN_TYPE}"])
    flags = np.zeros(256, np.int64)
    flags[[*b"0123456789@"]] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))
        for part in row_slices(batches, "__text"):
            column = column_of(part, "__text")
            buf, offs = string_bytes(column)
            rows = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(flags[buf])])[offs]))
            found: list[list] = [[] for _ in range(part.num_rows)]
            for row, spans in zip(rows.tolist(), find_in(column.take(pa.array(rows)).to_pylist(), field), strict=True):
                found[row] = [{"kind": KINDS[kind], "start": a, "end": b, "added": added} for a, kind, b, added in spans]
            yield pa.RecordBatch.from_arrays([*(column_of(part, c) for c in kept), pa.array(found, kind_type)], names=[*kept, "spans"])

    return arrow_map(source, run, schema)


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `find` with each span of the text replaced by its kind in angle brackets; of spans that overlap the first counts."""
    step = F.expr(
        f"""aggregate(spans, named_struct('at', 0L, 'out', ''), (s, x) -> if(x.start < s.at, s, named_struct('at', x.end,
        'out', concat(s.out, substring(`{text}`, cast(s.at + 1 as int), cast(x.start - s.at as int)), '<', x.kind, '>'))), s -> concat(s.out, substring(`{text}`, cast(s.at + 1 as int))))"""
    )
    return found.withColumn(text, F.when(F.size("spans") > 0, step).otherwise(F.col(f"`{text}`")))


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark).select("doc_id", "text")
    found = find(docs, fit(docs), keep=["doc_id"])
    base = "filter(spans, x -> not x.added)"
    counts = [f"cast(size(filter(spans, x -> x.kind = '{k}' and not x.added)) as long) as n_{k}" for k in KINDS]
    return found.selectExpr("doc_id", *counts, f"sha2({_listed(base)}, 256) as base_sha256", f"{_listed('spans')} as spans", f"cast(size(spans) - size({base}) as long) as n_added")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans alone, without the random field."""
    found = find(table(sf_dir, "documents", spark).select("doc_id", "text"), None, keep=["doc_id"])
    counts = [f"cast(size(filter(spans, x -> x.kind = '{k}')) as long) as n_{k}" for k in KINDS]
    return found.selectExpr("doc_id", *counts, f"{_listed('spans')} as spans")


QUERIES = {"op13_pii": op13_pii, "pii_base": pii_base}
#: Places of matches: the texts between matches, and the matches, are summed up by turns.
SQL = {
    "pii_base": r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
kinds(k, kind, re) AS (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
hits AS (
  SELECT rid, k, kind, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS g FROM docs, kinds WHERE k = 0 UNION ALL
  SELECT rid, k, kind, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM docs, kinds WHERE k = 1 UNION ALL
  SELECT rid, k, kind, regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), string_split_regex(text, '[0-9]([\x20-]?[0-9])+') FROM docs, kinds WHERE k = 2 UNION ALL
  SELECT rid, k, kind, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM docs, kinds WHERE k = 3),
each AS (SELECT rid, k, kind, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM hits WHERE len(m) > 0),
placed AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY rid, k ORDER BY i))::BIGINT AS stop, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM each),
good AS (SELECT rid, k, kind, stop - length(m) AS start, stop FROM placed WHERE CASE k WHEN 0 THEN true
  WHEN 1 THEN list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255
  WHEN 2 THEN length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN (length(d) - j) % 2 = 0 THEN d[j]::INT ELSE (2 * d[j]::INT) // 10 + (2 * d[j]::INT) % 10 END)) % 10 = 0
  ELSE length(d) BETWEEN 10 AND 15 END),
got AS (SELECT rid, count(*) FILTER (k = 0) AS e, count(*) FILTER (k = 1) AS i, count(*) FILTER (k = 2) AS c, count(*) FILTER (k = 3) AS p, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM good GROUP BY rid)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, coalesce(spans, '') AS spans FROM docs LEFT JOIN got USING (rid)
"""
}
