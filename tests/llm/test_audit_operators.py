"""Importance resampling, source divergence and personal data: brute force, plain patterns, a reference field and edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagweave.llm import divergence, importance, pii, shared
from tagweave.llm.textnum import string_bytes

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def feature_list(text):
    words = FEATURE.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_draw(docs, target):
    found = [(d, *feature_list(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in feature_list(x)[1])
    held, wanted = s.total() + 10000, t.total() + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * wanted**0 * held / ((s[b] + 1) * wanted))) for b in range(10000)]
    rows = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [(*r[:1], *r[2:], i + 1) for i, r in enumerate(fit[: 5 * len(fit) // 100])]
    left = Counter((*r[:1], *r[2:]) for r in rows) - Counter(r[:-1] for r in drawn)
    return sorted([*drawn, *((*r, None) for r in left.elements())], key=repr)


def test_feature_buckets_by_brute_force(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB1é中 .\n_-") for _ in range(rng.randint(0, 80))) for _ in range(120)] + ["", None, "one", "A b", "x " * 500]
    for block in (7, importance.BLOCK):
        monkeypatch.setattr(importance, "BLOCK", block)
        got, begin, n_words = importance.feature_buckets(*string_bytes(pa.array(texts, pa.string())))
        for i, t in enumerate(texts):
            n, want = feature_list(t)
            assert n_words[i] == n and got[begin[i] : begin[i + 1]].tolist() == want


def test_importance_resampling(spark, docs, none):
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "delta", "éclair", "zeta", "eta", "x1"]) + rng.choice(["", "s", "2"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(15, 60)))) for i in range(230)] + [(5, "alpha " * 30)] * 30 + [(None, "beta " * 25), (300, None), (301, ""), (302, "beta " * 25)]
    target = [" ".join(word() for _ in range(30)) for _ in range(5)] + ["alpha alpha alpha", None]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit("clash")).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.draw(importance.scores(df, goal)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == brute_draw(rows, target)
    whole = importance.draw(importance.scores(docs, goal.limit(0)))
    assert whole.count() == docs.count() and whole.filter("rank is not null").isEmpty()
    assert importance.draw(importance.scores(none, goal)).isEmpty()
    every = importance.draw(importance.scores(df, goal), percent=100)
    n = every.filter("n_words >= 20").count()
    assert sorted(r["rank"] for r in every.filter("rank is not null").collect()) == list(range(1, n + 1))


def brute_audit(docs, top):
    docs = [tuple(x or "" for x in d) for d in docs]
    words = [(lang, source, TERM.findall(text.translate(LOWER))) for lang, source, text in docs]
    seen = Counter((lang, t) for lang, _, w in words for t in set(w))
    kept = {lang: sorted(t for (x, t), n in seen.items() if x == lang and n >= 3) for lang in {w[0] for w in words}}
    groups = {}
    for lang, source, w in words:
        groups.setdefault((lang, source), Counter()).update(t for t in w if t in set(kept[lang]))
    out = []
    p_of = lambda c, n, v: 1 + 1000000000 * (c + 1) // (n + v)
    for (lang, source), counts in groups.items():
        v = len(kept[lang])
        p = {t: p_of(counts[t], counts.total(), v) for t in kept[lang]}
        whole = sum((c for (x, _), c in groups.items() if x == lang), Counter())
        parts = {"pair": [], "term": []}
        for (x, other), c in groups.items():
            if x == lang and other != source:
                q = {t: p_of(c[t], c.total(), v) for t in kept[lang]}
                parts["pair"].append((other, sum((p[t] - q[t]) ** 2 // q[t] for t in kept[lang])))
        for t in kept[lang]:
            q = p_of(whole[t], whole.total(), v)
            if counts[t] and p[t] > q:
                parts["term"].append((t, (p[t] - q) ** 2 // q))
        for part, items in parts.items():
            order = sorted(items, key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(order) if part == "pair" or k < top]
    return sorted(out)


def test_divergence_by_brute_force(spark, docs, none, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["É", "中文", "straße"]
    rows = []
    for i in range(160):
        source = f"s{min(5, int(rng.expovariate(0.6)))}"  # one source has most rows
        words = [vocabulary[min(len(vocabulary) - 1, int(rng.expovariate(0.02)))] for _ in range(rng.randint(0, 80))] + [source + "only"] * rng.randint(0, 6)
        rows.append((rng.choice(["en", "de", None]), rng.choice([source, source, None]), ", ".join(words).upper() if i % 3 else "_".join(words)))
    rows += [("xx", "lonely", "never kept"), ("xx", "other", None), ("yy", "single", "a"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("clash")).repartition(7)
    for top, slice_ in ((200, divergence.SLICE), (7, 300)):
        monkeypatch.setattr(divergence, "SLICE", slice_)
        monkeypatch.setattr(divergence, "PAIR_ROWS", 50)
        with shared.scratch() as kept:
            audit = divergence.Audit(df)
            terms = kept(divergence.top_terms(audit, top).join(audit.groups, "g").select("lang", "source", F.lit("term").alias("part"), "term", "f", "rank"))
        got = [tuple(r) for r in divergence.audited(df).filter("part = 'pair'").collect()] + [tuple(r) for r in terms.collect()]
        assert sorted(got) == brute_audit(rows, top)
    assert divergence.audited(none).isEmpty()
    odd = divergence.audited(docs).collect()
    assert {r.part for r in odd} == {"pair"} and all(r.value == 0 for r in odd if r.lang == "de")


def test_probability_is_exact(spark):
    rng = random.Random(4)
    rows = [(c, c + rng.randint(0, 1 << k) + 1) for k in (3, 30, 52) for c in (rng.randint(0, 1 << k) for _ in range(40))]
    got = [r[0] for r in spark.createDataFrame(rows, "c long, d long").coalesce(1).select(divergence.probability("c", "d")).collect()]
    assert got == [1 + 1000000000 * (c + 1) // d for c, d in rows]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_by_the_plain_patterns():
    rng = random.Random(5)
    pieces = ["a", "B.", "@", "x@y.z", "@b.c", ".", "-", " ", "+", "1", "25", "255.", "256", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 010-2345", "é", "\n", "(", "0", "00.", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == plain_base(text), text
    long = ["a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" + "." * 200_000, "@" * 100_000, "1 " * 100_000, "a@b" * 60_000]
    import time

    began = time.process_time()
    for text in long:
        pii.base_spans(text)
    assert time.process_time() - began < 10  # linear; the plain patterns take minutes


def test_messages_are_exact_on_trees():
    """Loopy message passing on a graph without circles gives the marginals that summing over all labellings gives."""
    rng = np.random.default_rng(6)
    n, links = 5, np.array([(0, 1, 0), (1, 2, 1), (1, 3, 2), (3, 4, 3)])
    field = pii.Field(np.zeros((1, pii.LABELS)), rng.normal(0, 1, (pii.LINKS, pii.LABELS, pii.LABELS)))
    unary = rng.normal(0, 1, (n, pii.LABELS))
    given = np.array([-1, -1, 3, -1, -1])
    got = pii.marginals(field, unary.copy(), links, given)
    want = np.zeros((n, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=n):
        if labels[2] == 3:
            weight = math.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(field.pairs[k][labels[a], labels[b]] for a, b, k in links))
            for i, x in enumerate(labels):
                want[i, x] += weight
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(got, want, atol=2e-3)


def people(rng, i):
    phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    card = [rng.randint(0, 9) for _ in range(15)]
    card = next(c for c in ("".join(map(str, [*card, d])) for d in range(10)) if pii.luhn(c))
    fake = next(c for c in (str(rng.randint(10**15, 10**16 - 1)) for _ in range(99)) if not pii.luhn(c))
    return {"phone": phone, "card": card, "ip": ".".join(str(rng.randint(1, 255)) for _ in range(4)), "email": f"user{i}@mail{rng.randint(0, 9)}.example.com", "none": fake}


def test_field_adds_other_spellings_and_leaves_clean_texts_alone(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{fill(12)} {p['phone']} {fill(5)} {p['ip']} {fill(4)} {p['email']} {fill(3)} {p['card']} {fill(6)} hash {p['none']} {fill(4)} version {rng.randint(1, 9)}.{rng.randint(0, 9)} of {rng.randint(1990, 2030)}") for i in range(200) for p in [people(rng, i)]]
    train = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    field = pii.fit(train)
    again = pii.fit(train.repartition(2))
    assert np.allclose(field.weights, again.weights) and np.allclose(field.pairs, again.pairs)  # whatever the partitions
    p = people(rng, 7)
    cases = {
        1: (f"{fill(3)} {p['phone']} {fill(4)} {p['phone'][1:]} end", ["phone"], ["phone"]),
        2: ("| " + p["phone"].replace(" ", " | ") + " | x |", [], ["phone"]),
        3: (" ".join(w + "!!" for w in f"{fill(3)} {p['phone']} {fill(2)}".split()), [], ["phone"]),
        4: (f"{fill(2)} {p['ip']} {fill(2)} {p['ip'].replace('.', '[.]')}", ["ip"], ["ip"]),
        5: (f"{fill(2)} {p['card']} {fill(2)} {re.sub('(....)(?=.)', chr(92) + '1.', p['card'])}", ["card"], ["card"]),
        6: (f"{p['email']} {fill(2)} {p['email'].replace('@', '[at]')}", ["email"], ["email"]),
        7: (f"{fill(40)} version 3.0 of 2020-10-11, {p['none']} and {p['none']} 12 345", [], []),
        8: ("", [], []),
        9: (None, [], []),
    }
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _, _) in cases.items()], "doc_id long, text string, spans string")
    found = pii.find(df, field)
    assert found.columns == ["doc_id", "text", "spans"]
    for r in found.collect():
        _, base, added = cases[r.doc_id]
        assert [x.kind for x in r.spans if not x.added] == base and [x.kind for x in r.spans if x.added] == added, (r.doc_id, r.spans)
        assert all(0 <= x.start < x.end <= len(r.text) for x in r.spans) and [x.start for x in r.spans] == sorted(x.start for x in r.spans)
    masked = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert "<phone>" in masked[2] and p["ip"] not in masked[4] and masked[4].count("<ip>") == 2 and masked[9] is None and masked[7] == cases[7][0]


def test_pii_query_on_odd_rows(spark, docs, none, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op13_pii(spark, str(tmp_path)).collect()
    assert len(got) == docs.count() and got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and {r.spans for r in got} == {""}
    assert pii.fit(none) is None and pii.find(none, None).isEmpty()
    one = pii.find(spark.createDataFrame([(1, "é a@b.co 1.2.3.4")], "doc_id long, text string"), None).first()
    assert [(x.kind, x.start, x.end) for x in one.spans] == [("email", 2, 8), ("ip", 9, 16)]
