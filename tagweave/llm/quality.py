"""Quality rules as a bitmask ledger.

`measure` computes the measurements of every whole text once; `ledger` turns
them into one integer of failure bits with a bit for each rule of `RULES`;
`apply_policy` keeps the rows none of whose failure bits are in a policy's mask;
words, lines and windows are equal where their bytes are, not their hashes;
`ablations` counts, from the bits alone, what each rule of a policy decides.

Defined cases: a null text counts as empty (zero measurements, so it fails
`few_words`); a text of any length is measured whole; a policy is looked up by its version and an unknown version is an
error; repeated rows are rows of their own; an empty table gives an empty
ledger; input columns named like an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, table, without
from .textnum import WORD_BYTES, code_points, column_of, mix, row_slices, shingle_hashes, span_ids, string_bytes, words_of

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter_words")

#: name, bit and failure condition of each rule; a bit is never given to another rule.
RULES: tuple[tuple[str, int, str], ...] = (
    ("few_words", 0, "n_words < 20"),
    ("repeated_words", 1, "100 * n_repeat_words > 30 * n_words"),
    ("symbols", 2, "10 * n_symbols > n_words"),
    ("repeated_lines", 3, "n_dup_lines >= 5 and 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", 4, "word_chars < 2 * n_words"),
    ("long_words", 5, "word_chars > 15 * n_words"),
    ("many_words", 6, "n_words > 100000"),
    ("stutter", 7, "100 * n_stutter_words > 30 * n_words"),
)
BIT = {name: 1 << bit for name, bit, _ in RULES}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "web-2": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "many_words", "stutter"),
}
POLICY = "web-2"


def _repeats(group: np.ndarray, keys: np.ndarray, views: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True where another window of the same group holds the same words; window i is views[at[i]], with the hash keys[i]."""
    order = np.lexsort((keys, group))
    g, k = group[order], keys[order]
    same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    met = np.flatnonzero(same)
    if (views[at[order[met]]] != views[at[order[met + 1]]]).any():  # different windows have one hash
        keys = np.unique(views[at], axis=0, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((keys, group))
        g, k = group[order], keys[order]
        same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def measure_bytes(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """MEASURES of the rows whose UTF-8 bytes lie between `offs`."""
    rows = len(offs) - 1
    starts, ends, first = words_of(buf, offs)
    n_words = np.diff(first)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
    word_chars = total(code_points(buf) & WORD_BYTES[buf])
    n_symbols = total(np.isin(buf, np.frombuffer(SYMBOLS, np.uint8)))

    breaks = np.flatnonzero(buf == 10)
    line_starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    line_row = np.searchsorted(np.sort(np.concatenate([np.searchsorted(breaks, offs[:-1]) + np.arange(rows), [len(line_starts)]])), np.arange(len(line_starts)), "right") - 1
    next_start = np.append(line_starts[1:], len(buf))
    last = np.append(line_row[1:] != line_row[:-1], True) if rows else np.zeros(0, bool)
    line_ends = np.where(last, next_start, np.maximum(next_start - 1, line_starts))
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    at, group = np.flatnonzero(filled), line_row[filled]
    keys = span_ids(buf, line_starts[at], line_ends[at])
    order = np.lexsort((keys, group))
    again = (group[order][1:] == group[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    n_dup = np.bincount(group[order][1:][again], minlength=rows)
    n_lines = np.bincount(group, minlength=rows)

    words = span_ids(buf, starts, ends)
    stutter = np.zeros(len(words), bool)
    stutter[1:] = words[1:] == words[:-1]
    stutter[first[:-1][n_words > 0]] = False
    n_stutter = np.diff(np.concatenate([[0], np.cumsum(stutter)])[first])
    windows, begin = shingle_hashes(mix(words.astype(np.uint64)), first, WINDOW)
    owner = np.repeat(np.arange(rows), np.diff(begin))
    whole = n_words[owner] >= WINDOW
    at = (np.arange(len(owner)) + np.repeat(first[:-1] - begin[:-1], np.diff(begin)))[whole]
    views = np.lib.stride_tricks.sliding_window_view(words, WINDOW) if len(words) >= WINDOW else np.zeros((0, WINDOW), np.int64)
    hit = at[_repeats(owner[whole], windows[whole], views, at)]
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    n_repeat = np.diff(np.concatenate([[0], np.cumsum(covered)])[first])
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_lines": n_lines, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "n_stutter_words": n_stutter}


def measure(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns `keep` (all of df's by default) and the MEASURES of column `text`; no shuffle."""
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in MEASURES]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), *(f"{m} long" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, "__text"):
            got = measure_bytes(*string_bytes(column_of(part, "__text")))
            yield pa.RecordBatch.from_arrays([*(column_of(part, c) for c in kept), *(pa.array(got[m], pa.int64()) for m in MEASURES)], names=[*kept, *MEASURES])

    return arrow_map(source, run, schema)


def ledger(measured: DataFrame) -> DataFrame:
    """Add `fail_bits`: the sum of the bits of all rules that a row fails."""
    bits = F.lit(0).cast("long")
    for name, _, failed in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return without(measured, ["fail_bits"]).withColumn("fail_bits", bits)


def mask_of(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def passes(policy: str, bits: Column | None = None) -> Column:
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows of a ledger that the policy keeps."""
    return rows.filter(passes(policy))


def ablations(rows: DataFrame, policies: Sequence[str] = tuple(POLICIES)) -> DataFrame:
    """For each policy and rule of it: rows failed, rows failed by this rule alone, rows kept with and without it.

    Only the counts per bit pattern (at most 2**rules) are aggregated, by bitwise tests.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    pairs = [(p, r, mask_of(p), BIT[r]) for p in policies for r in POLICIES[p]]
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, r, m, b in pairs]))
    each = patterns.select("fail_bits", "n", wanted.alias("x")).select("fail_bits", "n", "x.*")
    count = lambda cond: F.sum(F.when(F.expr(cond), F.col("n")).otherwise(0)).alias
    return each.groupBy("policy", "rule").agg(
        count("(fail_bits & bit) != 0")("failed"),
        count("(fail_bits & mask) = bit")("failed_alone"),
        count("(fail_bits & mask) = 0")("kept"),
        count("(fail_bits & (mask ^ bit)) = 0")("kept_without"),
        F.bit_or("fail_bits").alias("bits_seen"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(measure(table(sf_dir, "documents", spark), keep=["doc_id"]))
    base = ~passes("base-1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes(POLICY).alias("kept"), "fail_bits", F.lit(POLICY).alias("policy"), "n_lines", "n_stutter_words")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy decides, from the ledger of all documents."""
    return ablations(ledger(measure(table(sf_dir, "documents", spark), keep=["doc_id"])))


QUERIES = {"op1_quality_rules": op1_quality_rules, "quality_ablations": quality_ablations}
#: Shared by both queries: measurements and failure bits of every row.
_LEDGER = r"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM rows)),
win AS (SELECT rid, word, pos, CASE WHEN lead(word, 7) OVER o IS NOT NULL THEN concat_ws(chr(31), word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) END AS k, CASE WHEN word = lag(word) OVER o THEN 1 ELSE 0 END AS st FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
flag AS (SELECT rid, word, pos, st, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY rid, k) > 1 THEN 1 ELSE 0 END AS f FROM win),
cov AS (SELECT rid, word, st, max(f) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM flag),
m AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, sum(c) AS n_repeat_words, sum(st) AS n_st FROM cov GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM rows) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_st, 0) AS n_st FROM rows LEFT JOIN m USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END) + (CASE WHEN n_words > 100000 THEN 64 ELSE 0 END) + (CASE WHEN 100 * n_st > 30 * n_words THEN 128 ELSE 0 END) AS bits FROM a)
"""
SQL = {
    "op1_quality_rules": _LEDGER
    + """SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS fail_bits, 'web-2' AS policy, n_lines, n_st::BIGINT AS n_stutter_words FROM b""",
    "quality_ablations": _LEDGER
    + f""", x(policy, rule, mask, bit) AS (VALUES {", ".join(f"('{p}', '{r}', {mask_of(p)}, {BIT[r]})" for p, rules in POLICIES.items() for r in rules)})
SELECT policy, rule, count(*) FILTER ((bits & bit) <> 0) AS failed, count(*) FILTER ((bits & mask) = bit) AS failed_alone, count(*) FILTER ((bits & mask) = 0) AS kept, count(*) FILTER ((bits & (mask & ~bit)) = 0) AS kept_without, bit_or(bits::BIGINT) AS bits_seen FROM b, x GROUP BY policy, rule""",
}
