"""Quality rules, BPE, chat formatting, sharding and licence scan: brute force, round trips and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagweave.llm import bpe, chat, licenses, quality, sharding, textnum
from tagweave.llm.textnum import string_bytes

from tests.llm.conftest import ROWS

WORD = r"[^\x20\x09-\x0D]+"


def brute_measures(text):
    words = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    hit = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(hit), sum(a == b for a, b in zip(words, words[1:], strict=False)))


def test_measures_by_brute_force():
    texts = [r[1] for r in ROWS] + ["a b c d e f g h " * 4, "\n\n", "x\nx\nx", "a a a a a a a a a a", " \n a \n a "]
    got = quality.measure_bytes(*string_bytes(pa.array(texts, pa.string())))
    assert list(zip(*(got[m].tolist() for m in quality.MEASURES), strict=True)) == [brute_measures(t) for t in texts]


def alternating(n):
    """The Thue-Morse sequence, whose prefixes and their complements defeat polynomials modulo a power of two."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return bits[:n]


def test_equal_means_equal_bytes(monkeypatch):
    bits = alternating(1024)
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    texts = [f"{one}\n{other}", f"{one} {other} " * 5, f"{one}\n{one}", "aa bb\ncc dd\naa bb ee ff gg hh ii jj aa bb kk ll mm nn oo pp"]
    measured = lambda: list(zip(*(x.tolist() for x in quality.measure_bytes(*string_bytes(pa.array(texts))).values()), strict=True))
    want = [brute_measures(t) for t in texts]
    assert measured() == want
    weak = lambda words, first, k: (np.zeros_like(textnum.shingle_hashes(words, first, k)[0]), textnum.shingle_hashes(words, first, k)[1])
    monkeypatch.setattr(quality, "shingle_hashes", weak)
    monkeypatch.setattr(textnum, "span_hashes", lambda buf, starts, ends: (ends - starts).astype(np.uint64))
    assert measured() == want


def test_ledger_policies_and_ablations(docs, none):
    clash = docs.withColumn("n_words", F.lit("clash")).withColumn("fail_bits", F.lit(0))
    rows = quality.ledger(quality.measure(clash, keep=["doc_id", "n_words", "fail_bits"]))
    bits = {r.doc_id: r.fail_bits for r in rows.collect()}
    assert rows.count() == len(ROWS) and bits[4] & 1 and bits[1] == 1 * (len(ROWS[0][1].split()) < 20)
    kept = quality.apply_policy(rows).count()
    report = {(r.policy, r.rule): r for r in quality.ablations(rows).collect()}
    assert all(r.kept_without == r.kept + r.failed_alone for r in report.values())
    assert report[(quality.POLICY, "few_words")].kept == kept
    assert quality.ledger(quality.measure(none)).isEmpty()


def test_bpe_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe.default_path())
    rng = np.random.default_rng(5)
    texts = [r[1] or "" for r in ROWS[:9]] + ["".join(rng.choice(list("aest'  \n1é中😀-"), n)) for n in (5, 300, 4000)] + ["aest" * 30000, "=" * 5000, " " * 700 + "x"]
    enc = bpe.encoder_of(bpe.default_path())
    for text, ids in zip(texts, enc.streams(texts), strict=True):
        pieces = list(ids)
        want = tk.encode(text, add_special_tokens=False).ids
        assert np.concatenate([np.zeros(0, np.int64), *pieces]).tolist() == want
        assert "".join(bpe.decode(iter(pieces))) == tk.decode(want, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.round_trip(docs.withColumn("n_tokens", F.lit(1)), ["doc_id", "n_tokens"]).collect()}
    for doc_id, text, *_ in ROWS:
        ids = tk.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id].n_tokens == len(ids) and got[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(none, ["doc_id"]).isEmpty()
    assert bpe.encode_column(docs, ids="ids").filter("doc_id = 4").first().ids == []


def test_bpe_window_is_bounded():
    merges = bpe.merges_of(bpe.default_path())
    window, text, most = bpe.Transducer(merges), b"aestion" * 20000, 0
    got = []
    for piece in window.feed(text):
        got.append(piece)
        most = max(most, len(window.held))
    got.append(window.finish())
    assert most <= window.block + merges.lookahead + 128
    assert np.concatenate(got).tolist() == merges.merge_all([text])[0].tolist()


def test_bpe_of_long_pretokens_is_a_stream():
    import tracemalloc

    from tokenizers import Tokenizer

    tk, enc = Tokenizer.from_file(bpe.default_path()), bpe.encoder_of(bpe.default_path())
    rng = np.random.default_rng(7)
    for text in ("aest" * 3000, " " + "7" * 9000 + "x", "\n" * 5000 + "a", " " * 5000, " " * 4999 + "b", "!'s" * 4000, "\t " * 3000 + "é" * 5000 + " 中", "it's " * 2000, "".join(rng.choice(list("aest'  \n1é中😀-"), 20000)), ("x" * 300 + "\n\n") * 40):
        for most in (64, 1000):
            pieces = [p if isinstance(p, list) else ["".join(p)] for p in bpe.pieces_of(text, most)]
            assert [p for ps in pieces for p in ps] == bpe.pretoken_pattern(0x10FFFF)[0].findall(text)
        assert np.concatenate(list(enc.stream(text))).tolist() == tk.encode(text, add_special_tokens=False).ids
    peaks = []
    for size in (1, 8):
        text = "aestion" * (size * 150_000)
        tracemalloc.start()
        n = sum(map(len, enc.stream(text)))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        assert n > size * 150_000
    assert peaks[1] < peaks[0] + 3 and enc.size <= bpe.CACHE_BYTES


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<", "<\\|", "<\\\\|x|", None, "", "a|b<|", "é<|中"]
    rows = [(c, t, r, x) for c, turns in enumerate([odd, odd[::-1], ["only"]]) for t, x in enumerate(turns) for r in (["user", "assistant", "sys\ntem|\\"][t % 3],)]
    rows += [(None, None, None, "lost"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 0, "assistant", "x" * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted([((t is not None, t or 0), r or "", x or "") for cc, t, r, x in rows if cc == c])
        want = [(r, x) for _, r, x in turns]
        assert chat.parse(out[c].formatted) == want
        assert back[c].n_turns == len(want)
        assert back[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in want).encode()).hexdigest()
        learnt = "".join(x for r, x in want if r == "assistant")
        assert (back[c].loss_chars, back[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).isEmpty()


def test_sharding_law(docs, none):
    rows = sharding.sized(docs.withColumn("size", F.lit("clash")), keep=["doc_id", "size"])
    now = sharding.initial_map(5)
    maps = sharding.map_table(docs.sparkSession, {1: now})
    placed = sharding.place(rows, maps, 1, ["doc_id", "text_crc32"]).collect()
    assert len(placed) == len(ROWS)
    texts = {r[0]: (r[1] or "").encode() for r in ROWS}
    for r in placed:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r.vslot, r.shard, r.size, r.text_crc32) == (slot, now[slot], len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]))
    for shard in {r.shard for r in placed}:
        own = sorted(r.slot for r in placed if r.shard == shard)
        assert own == list(range(len(own)))
    assert sharding.place(sharding.sized(none, keep=["doc_id"]), maps, 1, ["doc_id"]).isEmpty()


def test_slot_maps(spark, tmp_path):
    now = sharding.initial_map(40)
    more = sharding.grow(now, 41)
    assert all(b in (a, 40) for a, b in zip(now, more, strict=True)) and more == sharding.initial_map(41)
    assert max(now.count(s) for s in range(40)) - min(now.count(s) for s in range(40)) <= 1
    sizes = {s: (s % 7) ** 3 for s in range(sharding.SLOTS)}
    load = lambda m: [sum(sizes[s] for s in range(sharding.SLOTS) if m[s] == k) for k in range(40)]
    even = sharding.rebalance(now, sizes)
    assert max(load(even)) - min(load(even)) <= 0.02 * sum(sizes.values()) / 40 + 1
    sharding.store_map(sharding.map_table(spark, {1: now, 2: more}), str(tmp_path / "maps"))
    assert sharding.load_map(spark, str(tmp_path / "maps"), 2).filter("shard = 40").count() == more.count(40)


def test_license_scan_by_brute_force(docs, none):
    got = {r.doc_id: r for r in licenses.scan(docs.withColumn("labels", F.lit("clash"))).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for doc_id, text, *_ in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [i for p, _ in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        labels = {x for p, x in licenses.BASE + licenses.NAMES if f" {p} " in f" {' '.join(words)} "}
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.labels == ",".join(sorted(labels)) and (r.score == 1.0) == bool(labels)
    assert got[10].base_labels == "cc-by,gpl,reserved" and "mit" in got[10].labels.split(",")
    assert licenses.scan(none).isEmpty()


def test_whole_licences_are_found_when_reworded(spark):
    rng = np.random.default_rng(3)
    label, text, keys = licenses.TEMPLATES[0]
    words = licenses.words_in(text)
    kept = {i + j for k in keys for i in range(len(words)) if words[i : i + len(k.split())] == k.split() for j in range(len(k.split()))}
    reworded = [w if i in kept or rng.random() > 0.15 else "thing" for i, w in enumerate(words)]
    reworded[:0] = "a preface of our own with É and ÀÉ".split()
    reworded[60:60] = ["inserted"] * 5 if 60 not in kept else []
    broken = " ".join(words).replace("restriction", "limits")
    cut = " ".join(w for i, w in enumerate(words) if i in kept)
    rows = [(1, text), (2, " ".join(reworded)), (3, broken), (4, cut), (5, "software " * 300), (6, "ſoftware Kelvin K permission"), (7, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert label in got[1].labels.split(",") and got[1].score == 1
    assert label in got[2].labels.split(",")
    assert got[3].labels == "mit" and got[3].score == 1  # its opening clause still stands
    assert got[4].labels == "" and got[4].score < 1  # key phrases alone, without the text around them
    assert got[5].labels == "" and got[5].n_words == 300 and got[6].labels == "" and got[7].score == 0
    rows = [(i, whole) for i, (_, whole, _) in enumerate(licenses.TEMPLATES)]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert licenses.TEMPLATES[r.doc_id][0] in r.labels.split(",")
