"""Near-duplicates, passages, mixing, audio and toxicity on small fixtures."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagweave.llm import audio, minhash, mixing, passages, toxicity


def components(edges, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    base = [word() for _ in range(60)]
    texts = {}
    for i in range(60):  # a group whose members are near the threshold of each other
        texts[i] = " ".join(w if rng.random() > 0.04 else word() for w in base)
    texts |= {100 + i: " ".join(word() for _ in range(rng.randint(0, 30))) for i in range(40)}
    texts |= {200: None, 201: "", 202: "Solo", 203: "solo", 204: texts[5].upper(), 205: " ".join(base * 400), 206: " ".join(base * 400 + ["end"])}
    df = spark.createDataFrame([*texts.items(), (5, texts[5])], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, k=2).collect()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w)} if len(w) == 1 else {tuple(w[i : i + 2]) for i in range(len(w) - 1)}

    sets = {i: shingles(t) for i, t in texts.items()}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(edges, sets)
    assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert minhash.near_duplicates(df.limit(0)).isEmpty()


def test_groups_of_near_copies_by_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(w if rng.random() > 0.01 + 0.005 * (i % 9) else f"x{rng.random()}" for w in base)) for i in range(60)]
    sets = {i: {tuple(t.split()[j : j + 2]) for j in range(99)} for i, t in rows}
    want = components([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    assert len(set(want.values())) > 2
    df = spark.createDataFrame([(f"d{i:03}", t) for i, t in rows], "doc_id string, text string")
    for least in (100, 2):  # after the first star all is left to step 2, or further stars do most
        monkeypatch.setattr(minhash, "LEAST_GAIN", least)
        monkeypatch.setattr(minhash, "FEW", 5)
        monkeypatch.setattr(minhash, "MANY", 7)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k=2).collect()} == {f"d{i:03}": f"d{c:03}" for i, c in want.items()}


def test_two_texts_of_a_doc_id_are_two_documents(spark):
    rng = random.Random(5)
    one, other = (" ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(40)) for _ in range(2))
    rows = [(1, one), (2, other), (2, one), (2, one), (3, other), (4, other + " end"), (None, other)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, key string, n_shingles int").repartition(3)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (2, 2, True), (3, 2, False), (4, 2, False)]
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, other), (1, one), (2, other)]


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 1000, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    x = minhash.sketches(np.concatenate([a, np.concatenate([a[:800], b]), a[:1]]), np.array([0, 1000, 2000, 2001]))
    assert (x != np.iinfo(np.uint64).max).all()
    assert abs((x[0] == x[1]).mean() - 800 / 1200) < 0.15


def test_near_duplicates_with_ids_of_any_type(spark):
    body = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    for kind, ids in (("int", (1, 2, 2147483647)), ("long", (1, 2, 1 << 62)), ("string", ("a", "b", "c"))):
        a, b, c = ids
        rows = [(a, body), (a, other), (b, f"{body} end"), (c, f"{other} end"), (c, body), (c, None)]
        got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, f"doc_id {kind}, text string"), k=2).collect()]
        assert {x[2] for x in got if x[1] > 0} == {a} and sum(x[3] for x in got if x[1] > 0) == 2
        assert (c, 0, c, True) in got and len(got) == 6


def test_passages(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    fresh = lambda n: [word() for _ in range(n)]
    shared = fresh(80)
    fuzzy = [w if i % 13 else word() for i, w in enumerate(shared)]
    docs = [(1, fresh(50) + shared + fresh(50)), (2, fresh(70) + shared + fresh(30)), (3, fresh(20) + fuzzy + fresh(60)), (4, fresh(300)), (5, shared), (6, fresh(10) + shared[:20] + fresh(10))]
    rows = [(i, " ".join(w)) for i, w in docs] + [(7, " ".join(docs[0][1])), (8, None), (9, ""), (None, "x"), (4, " ".join(docs[3][1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(x.lo, x.hi) for x in r.passages] for r in passages.passages(df).collect()}
    assert set(got) == {2, 3, 5, 7}
    assert got[2] == [(70, 150)] and got[5] == [(0, 80)] and got[7] == [(0, 180)]
    (lo, hi), = got[3]
    assert abs(lo - 20) <= 3 and abs(hi - 100) <= 3
    left = {r.doc_id: r.text for r in passages.dedup_passages(df).collect()}
    assert left[2].split() == docs[1][1][:70] + docs[1][1][150:] and left[4] == rows[3][1] and left[9] == "" and left[8] is None
    assert 5 not in left and 7 not in left and left[1] == rows[0][1]
    assert passages.passages(df.limit(0)).isEmpty()


def _spans(spark, docs):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    return {r.doc_id: [(x.lo, x.hi) for x in r.passages] for r in passages.passages(df).collect()}


def test_passages_whose_seeds_have_many_first_places(spark):
    rng = random.Random(3)
    fresh = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    shared = fresh(60)
    early = [(k, fresh(20) + shared[4 * k : 4 * k + 12] + fresh(20)) for k in range(15)]
    got = _spans(spark, [*early, (50, fresh(30) + shared + fresh(30)), (51, fresh(10) + shared + fresh(10))])
    assert got == {51: [(10, 70)]}


def test_passages_of_a_repeated_line(spark):
    rng = random.Random(4)
    fresh = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    for period in (1, 2, 7, 10):
        line = fresh(period)
        run = (line * 60)[:60]
        assert _spans(spark, [(1, fresh(20) + run + fresh(20)), (2, fresh(15) + run + fresh(15)), (3, fresh(40))]) == {2: [(15, 75)]}


def test_failing_chains_are_split(spark):
    rng = random.Random(5)
    fresh = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    first, second = fresh(50), fresh(20)
    fuzzy = [w if i % 12 != 6 else "other" for i, w in enumerate(first)]
    (lo, hi), = _spans(spark, [(1, fresh(9) + first + fresh(25) + second + fresh(9)), (2, fresh(9) + fuzzy + second + fresh(9))])[2]
    assert abs(lo - 9) <= 3 and 56 <= hi <= 79
    a, b = first + second, first + fresh(25) + second
    number = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    a, b = ([number[w] for w in x] for x in (a, b))
    q = [0, 8, 16, 24, 32, 45, 50, 58, 65]
    s = [x + 25 * (x >= 50) for x in q]
    assert 100 * passages.matched(a, b, q, s) < passages.PERCENT * len(b)
    assert sorted(passages.held_parts(a, b, q, s)) == [(0, 50), (50, 70)]


def test_of_two_texts_of_a_doc_id_one_is_the_document(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared, long, short = fresh(60), fresh(300), "too short"
    rows = [(1, shared), (2, f"{long} {shared}"), (2, short), (2, None), (3, f"{shared} {short}"), (3, f"{shared} {short}")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, passages string").repartition(4)
    left = passages.dedup_passages(df)
    assert left.columns == df.columns
    got = sorted((r.doc_id, r.text or "") for r in left.collect())
    assert got[0] == (1, shared) and [x for x in got if x[0] == 3] == [(3, short)] * 2
    assert {x[1].strip() for x in got if x[0] == 2} in ({long, short, ""}, {f"{long} {shared}", short, ""})


def test_exact_repeats_by_brute_force(spark):
    rng = random.Random(7)
    fresh = lambda n: [rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 2) for _ in range(n)]
    pool = [fresh(rng.randint(30, 90)) for _ in range(8)]
    docs = [(i, [w for _ in range(rng.randint(0, 4)) for w in (rng.choice(pool) if rng.random() < 0.6 else fresh(rng.randint(1, 60)))]) for i in range(60)]
    got, seen = _spans(spark, docs), set()
    for i, words in docs:
        own = [tuple(words[k : k + passages.MIN_WORDS]) for k in range(len(words) - passages.MIN_WORDS + 1)]
        want = {k + j for k, x in enumerate(own) if x in seen for j in range(passages.MIN_WORDS)}
        assert want <= {k for lo, hi in got.get(i, []) for k in range(lo, hi)}
        seen |= set(own)


def test_recall_of_fuzzy_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    docs, planted = [], {}
    for rate in (5, 10, 15, 20):
        for _ in range(40):
            one = [word() for _ in range(100)]
            other = [word() if rng.random() < rate / 100 else w for w in one]
            docs += [(len(docs), [word() for _ in range(50)] + one), (len(docs) + 1, [word() for _ in range(40)] + other + [word() for _ in range(40)])]
            if sum(a == b for a, b in zip(one, other, strict=True)) >= 80:
                planted[len(docs) - 1] = rate
    docs += [(len(docs) + i, [word() for _ in range(200)]) for i in range(50)]
    got = _spans(spark, docs)
    assert set(got) <= set(range(1, 320, 2))
    for rate in (5, 10, 15, 20):
        covered = [sum(max(0, min(hi, 140) - max(lo, 40)) for lo, hi in got.get(i, [])) for i, x in planted.items() if x == rate]
        assert np.mean(covered) >= 90


def _shingles(words):
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, first = passages.words_of(buf, np.array([0, len(buf)]))
    return passages.shingle_hashes(passages.span_hashes(buf, starts, ends), first, passages.K)[0]


def test_passages_are_found_by_any_shingle(spark):
    """Passages none of whose common shingles has a hash divisible by six, which were the only seeds before."""
    rng = random.Random(11)
    fresh = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    docs = []
    while len(docs) < 20:
        one = fresh(60)
        other = [w if i % 8 != 5 else "other" for i, w in enumerate(one)]
        common = np.intersect1d(_shingles(one), _shingles(other))
        assert len(common) == 21
        if (common % np.uint64(6) != 0).all():
            docs += [(len(docs), fresh(30) + one + fresh(30)), (len(docs) + 1, fresh(20) + other + fresh(20))]
    got = _spans(spark, docs)
    assert set(got) == set(range(1, 20, 2)) and all(abs(lo - 20) <= 5 and abs(hi - 80) <= 5 for (lo, hi), in got.values())


def test_a_seed_is_sent_once_for_each_block(spark):
    """First places by brute force; a seed that each document has many times is one row's entry for each block, not a row for each place."""
    rng = random.Random(13)
    texts = [(i, " ".join(["all of us say this"] * 50 + [rng.choice("abcd") for _ in range(rng.randint(0, 12))])) for i in range(40)]
    blocks = passages.blocks_of(spark.createDataFrame(texts, "id long, text string").repartition(3)).localCheckpoint()
    first, docs, n = {}, {}, {}
    for i, text in texts:
        for q, seed in enumerate(_shingles(text.split()).tolist()):
            first.setdefault(seed, (i, q))
            docs.setdefault(seed, set()).add(i)
            n[seed] = n.get(seed, 0) + 1
    want = {(i, q, *first[seed], n[seed] > 2) for i, text in texts for q, seed in enumerate(_shingles(text.split()).tolist()) if len(docs[seed]) > 1}
    got = set()
    for r in passages.shared_places(blocks, 4).collect():
        got |= set(zip(*(np.frombuffer(r[c], kind).tolist() for c, kind in passages.SHARED.items()), strict=True))
    assert got == want and len(want) > 40 * 240
    told = passages.first_places(blocks, passages.seed_keys, 4).collect()
    assert sum(len(r.at) // 4 for r in told) <= 3 * len(first)


def test_short_reach_gives_the_same_spans_or_none():
    rng = random.Random(14)
    ended = 0
    for _ in range(300):
        one = [rng.randrange(10**6) for _ in range(64 + rng.randint(5, 40) + 64)]
        other = [x if 60 <= i < len(one) - 60 or rng.random() < rng.choice((0.1, 0.9)) else -1 for i, x in enumerate(one)]
        cut = passages.REACH - passages.FIRST_REACH
        q = [64, len(one) - 64 - passages.K]
        whole = passages.held_parts(one, other, q, q)
        near = passages.held_parts(one[cut:-cut], other[cut:-cut], [x - cut for x in q], [x - cut for x in q], passages.FIRST_REACH)
        if near is not None:
            ended += 1
            assert [(lo + cut, hi + cut) for lo, hi in near] == whole
    assert 0 < ended < 300


def test_ends_of_runs():
    rng = random.Random(12)
    for _ in range(100):
        at = sorted({(d + i, i) for _ in range(6) for d in [rng.randint(-9, 9)] for b in [rng.randint(10, 90)] for i in range(b, b + rng.randint(1, 30))})
        q, s = np.array(at).T
        kept = {at[i] for i in np.flatnonzero(passages.run_ends(q, s))}
        assert {x for x in at if (x[0] - 1, x[1] - 1) not in at or (x[0] + 1, x[1] + 1) not in at} <= kept
        words = lambda anchors: {(x + k, y + k) for x, y in anchors for k in range(passages.K)}
        assert words(kept) == words(at)


def test_straight_chains_are_the_best_chains():
    rng = np.random.default_rng(15)
    groups = [np.cumsum(rng.integers(1, rng.choice([3, 60, 200]), (rng.integers(1, 40), 2)), axis=0) for _ in range(300)]
    q, s = np.concatenate(groups).T
    begin = np.cumsum([0, *map(len, groups)])[:-1]
    want = {(b + c[0], b + c[-1]) for b, g in zip(begin, groups, strict=True) for c in passages.best_chains(*g.T)}
    assert set(zip(*passages.straight_chains(q, s, begin), strict=True)) == want and len(want) > 300


def test_rows_grow_as_one_by_one():
    rng = np.random.default_rng(16)
    a, b = rng.integers(0, 4, 3000).astype(np.uint32), rng.integers(0, 4, 3000).astype(np.uint32)
    b[500:2500] = np.where(rng.random(2000) < 0.15, 9, np.delete(a, rng.integers(400, 2400, 3))[480:2480])
    at, n = rng.integers(70, 2900, (2, 500)), rng.integers(0, 65, (2, 500))
    at[1, :250] = np.clip(at[0, :250] + rng.integers(-2, 23, 250), 70, 2900)
    for way in (1, -1):
        got = passages.grown_rows(a, at[0], n[0], b, at[1], n[1], way)
        for i in range(500):
            x, y = (v[k : k + m] if way > 0 else v[k - m + 1 : k + 1][::-1] for v, k, m in ((a, at[0, i], n[0, i]), (b, at[1, i], n[1, i])))
            assert tuple(c[i] for c in got[:3]) == passages._grown(x.tolist(), y.tolist())
        assert len(set(got[0].tolist())) > 10 and got[2].any() and not got[2].all()


def test_anchors_of_a_document_are_chained_in_its_block(spark, monkeypatch):
    """No anchor is shuffled: chains leave the blocks whole; a block that all others quote is met in several tasks."""
    shared = [f"w{k}" for k in range(60)]
    texts = [(i, " ".join([f"a{i}"] * 5 + shared + [f"z{i}"] * 5)) for i in range(30)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    blocks = passages.blocks_of(df).localCheckpoint()
    found = passages.chains_of(passages.shared_places(blocks, 2).localCheckpoint()).localCheckpoint()
    assert {(r.id, r.src, r.q0, r.q1, r.s0, r.s1) for r in found.collect()} == {(i, 0, 5, 65, 5, 65) for i in range(1, 30)}
    monkeypatch.setattr(passages, "ALIGN_WORDS", 500)
    homes = passages.homes_of(blocks).selectExpr("no src", "block home")
    spans = passages.aligned_spans(found.join(homes, "src").localCheckpoint(), blocks).collect()
    assert sorted((r.id, r.src, r.lo, r.hi) for r in spans) == [(i, 0, 5, 65) for i in range(1, 30)]


def test_growth_and_matches_by_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randint(0, 20))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(6) for _ in range(rng.randint(0, 8))]
        cells = {(0, 0): 0}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i or j:
                    at = lambda x, y: cells.get((x, y), -1000)
                    cells[i, j] = max(at(i - 1, j - 1) + (1 if i and j and a[i - 1] == b[j - 1] else -2), at(i - 1, j) - 2, at(i, j - 1) - 2)
        i, j = passages.grown(a, b)
        assert 0 <= cells[i, j] <= max(cells.values()) and (cells[i, j] == max(cells.values()) or len(a) > passages.DRIFT)
        common = np.zeros((len(a) + 1, len(b) + 1), int)
        for x in range(len(a)):
            for y in range(len(b)):
                common[x + 1, y + 1] = common[x, y] + 1 if a[x] == b[y] else max(common[x, y + 1], common[x + 1, y])
        assert passages.common_words(a, b) == common[-1, -1]


def test_chains_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        pts = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (14, 2))})
        q, s = (np.array(x) for x in zip(*pts, strict=True))
        best = [0.0] * len(pts)
        for j in range(len(pts)):
            best[j] = passages.K + max([0.0, *(best[i] - passages.GAP * (q[j] - q[i] + s[j] - s[i]) for i in range(j) if q[i] < q[j] and s[i] < s[j])])
        chains = passages.best_chains(q, s)
        if chains:
            c = chains[0]
            value = passages.K * len(c) - passages.GAP * (q[c[-1]] - q[c[0]] + s[c[-1]] - s[c[0]])
            assert abs(value - max(best)) < 1e-9
    assert passages.common_words([1, 2, 3, 4], [2, 9, 4]) == 2


def test_raking_and_sampling(spark):
    rows = [(i, "w " * (1 + i % 7), ["en", "de", None][i % 3], ["a", "b"][i % 5 > 1]) for i in range(2000)] + [(5000, None, "en", "a"), (5001, "", "de", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed(df.withColumn("topic", df.lang)).collect()
    assert len(got) == len(rows) and all(not r.sampled and r.probability == 0 for r in got if r.doc_id >= 5000)
    weight = lambda r: r.tokens * r.probability
    total = sum(map(weight, got))
    for dim in ("source", "lang"):
        natural = {}
        for r in got:
            natural[r[dim] or ""] = natural.get(r[dim] or "", 0) + r.tokens
        flat = {k: v**mixing.TEMPERATURE for k, v in natural.items()}
        for k, v in flat.items():
            assert abs(sum(weight(r) for r in got if (r[dim] or "") == k) / total - v / sum(flat.values())) < 1e-4
    assert max(r.probability for r in got) == pytest.approx(1)
    taken, expected = sum(r.sampled for r in got), sum(r.probability for r in got)
    assert abs(taken - expected) < 5 * expected**0.5
    assert mixing.mixed(df.limit(0)).isEmpty()


def test_raking_by_brute_force(spark):
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 1000, (3, 4, 2)).astype(float)
    rows = [(f"s{i}", f"l{j}", f"t{k}", float(tokens[i, j, k])) for i in range(3) for j in range(4) for k in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    goals = {d: rng.dirichlet(np.ones(n) * 3) for d, n in zip(mixing.DIMS, tokens.shape, strict=True)}
    targets = {d: spark.createDataFrame([(f"{d[0]}{i}", float(x)) for i, x in enumerate(g)], "value string, share double") for d, g in goals.items()}
    got = mixing.rake(cells, targets)
    want = tokens / tokens.sum()
    for _ in range(500):
        for axis, g in enumerate(goals.values()):
            other = tuple(a for a in range(3) if a != axis)
            want = want * (g / want.sum(axis=other)).reshape([-1 if a == axis else 1 for a in range(3)])
    for r in got.weights.collect():
        assert abs(r.weight - want[int(r.source[1]), int(r.lang[1]), int(r.topic[1])]) < 1e-5
    assert got.converged and all(abs(r.target - r.reached) < 1e-5 for r in mixing.report(got, targets).collect())


def test_targets_that_contradict_each_other_are_told(spark, caplog):
    cells = spark.createDataFrame([("a", "en", "x", 10.0), ("b", "de", "x", 30.0)], "source string, lang string, topic string, tokens double")
    shares = lambda *x: spark.createDataFrame(x, "value string, share double")
    targets = {"source": shares(("a", 0.9), ("b", 0.1)), "lang": shares(("en", 0.1), ("de", 0.9))}
    got = mixing.rake(cells, targets)
    assert not got.converged and got.deviation == pytest.approx(0.8) and "off by 0.8" in caplog.text
    assert {(r.dimension, r.value): round(r.reached, 6) for r in mixing.report(got, targets).collect()}[("source", "a")] == 0.1


def test_an_odd_document_does_not_cut_the_sample(spark):
    rows = [(i, "w " * 50, "en", f"s{i % 2}") for i in range(5000)] + [(9999, "w", None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in mixing.mixed(df).collect()}
    assert got[9999].probability == 1 and got[9999].sampled
    assert min(r.probability for r in got.values()) > 0.5


def test_audio_alignment(spark):
    rng = np.random.default_rng(8)
    tune = audio.melody_of(rng.normal(0, 0.2, 64).tolist())
    other = audio.melody_of(rng.normal(0, 0.2, 64).tolist())
    pcm = lambda x: (np.clip(x, -1, 1) * 32000).astype("<i2").tobytes()
    late = np.concatenate([np.zeros(audio.HOP * 20), tune])
    rows = [(50, pcm(tune)), (51, pcm(tune)), (52, pcm(late + rng.normal(0, 0.01, len(late)))), (53, pcm(other)), (100, pcm(other)), (54, None), (150, b""), (50, pcm(tune))]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, media binary"), "id", "media")
    got = {(r.query_id, r.match_class): (r.offset, r.copies) for r in audio.search(prints).collect()}
    assert got[(50, 50)] == (0, 2) and got[(50, 52)][0] == 20 and got[(100, 53)] == (0, 2)
    assert set(got) == {(50, 50), (50, 52), (100, 53)}
    assert audio.search(prints.limit(0)).isEmpty()


def test_long_and_silent_recordings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    tune = np.concatenate([audio.melody_of(rng.normal(0, 0.2, 64).tolist()) for _ in range(8)])
    want = audio.fingerprint(audio.chroma(tune))
    monkeypatch.setattr(audio, "SPECTRA", 7)
    assert (audio.fingerprint(audio.chroma(tune)) == want).all()
    pcm = lambda x: (np.clip(x, -1, 1) * 32000).astype("<i2").tobytes()
    rows = [(50, pcm(tune), "clash"), (1, pcm(tune[30_000:60_000]), ""), *((100 + i, bytes(20_000 + 600 * i), "") for i in range(12))]
    df = spark.createDataFrame(rows, "id long, media binary, print string")
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows])], names=["media"])
    assert [p.num_rows for p in audio.media_slices(batch)] == [len(rows)]
    monkeypatch.setattr(audio, "BATCH_BYTES", 30_000)
    assert sum(p.num_rows for p in audio.media_slices(batch)) == len(rows) and len(list(audio.media_slices(batch))) > 5
    got = {(r.query_id, r.match_class) for r in audio.search(audio.fingerprints(df, "id", "media")).collect()}
    assert {(50, 50), (50, 1)} <= got and {m for q, m in got if q == 100} == set(range(100, 112))


def _by_all_offsets(query, other):
    """(-votes, bit error, offset) of the best offset that holds, by trying all of them."""
    best = None
    for o in range(1 - len(query), len(other)):
        x, y = query[max(-o, 0) :], other[max(o, 0) :]
        n = min(len(x), len(y))
        error = round(int(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n), 6)
        if n >= audio.LEAST_FRAMES and error <= audio.error_limit(n):
            votes = sum(int(((x[:n] >> s & 0xFFFFF) == (y[:n] >> s & 0xFFFFF)).sum()) for s in (np.uint32(0), np.uint32(12)))
            best = min(best or (1,), (-votes, error, o))
    return best


def test_audio_matches_have_wrong_bits(spark):
    rng = np.random.default_rng(4)
    one, other = rng.integers(0, 1 << 32, (2, 84), dtype=np.uint32)
    flipped = lambda p, share: p ^ ((rng.random((len(p), 32)) < share) @ (1 << np.arange(32))).astype(np.uint32)
    prints = {50: one, 51: flipped(one, 0.05), 52: flipped(one, 0.1), 53: np.concatenate([other[:40], flipped(one, 0.05)[:44]]), 54: one[:19], 55: other, 56: np.tile(one, 40)}
    df = spark.createDataFrame([(i, p.view(np.int32).tolist()) for i, p in prints.items()], "id long, print array<int>")
    got = {r.match_class: r for r in audio.search(df).collect()}
    assert set(got) == {50, 51, 52, 53, 56}
    assert [got[i].offset for i in (50, 51, 52, 53)] == [0, 0, 0, 40] and got[53].frames == 44
    want = {i: _by_all_offsets(one, p) for i, p in prints.items()}
    assert {i: w for i, w in want.items() if w} == {i: (-r.votes, r.bit_error, r.offset) for i, r in got.items()}


def test_audio_histogram_by_brute_force(monkeypatch):
    rng = np.random.default_rng(6)
    prints = [rng.choice(np.array([7, 7, 7, 1 << 25, 90210], np.uint32), rng.integers(1, 70)) for _ in range(40)]  # long runs of equal integers
    prints += [rng.integers(0, 1 << 32, 60, dtype=np.uint32), np.zeros(0, np.uint32), np.full(200, 3, np.uint32)]
    monkeypatch.setattr(audio, "RUN_PAIRS", 50)
    got = {(i, j): (-v, e, o) for i, j, o, v, n, e in audio.alignments(prints, prints)}
    for i, p in enumerate(prints):
        for j, q in enumerate(prints):
            want = _by_all_offsets(p, q) if len(p) and len(q) else None
            assert got.get((i, j)) == (want if want and -want[0] >= audio.LEAST_VOTES else None), (i, j)


def test_audio_recall_against_all_offsets(spark):
    """Noise, changed notes and cut recordings of melodies: found, where some offset holds."""
    rng = np.random.default_rng(12)
    tunes = rng.normal(0, 0.2, (30, 64))
    others = []
    for t in tunes:
        t = np.where(rng.random(64) < 0.06, rng.normal(0, 0.2, 64), t)
        sound = audio.melody_of(t.tolist())[int(rng.integers(0, 6000)) :]
        others.append(sound + rng.normal(0, 0.1, len(sound)))
    prints = [audio.fingerprint(audio.chroma(audio.melody_of(t.tolist()))) for t in tunes]
    found = [audio.fingerprint(audio.chroma(x)) for x in others]
    want = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(found) if _by_all_offsets(p, q)}
    got = {x[:2] for x in audio.alignments(prints, found)}
    assert len(want) >= 15 and got <= want and len(got & want) >= 0.9 * len(want)


def test_chains_are_aligned_in_rounds_of_some_blocks_each(spark, monkeypatch):
    """One round sent all blocks and the words of all chains at once, which was the most disk that op6 took."""
    monkeypatch.setattr(passages, "BLOCK_BYTES", 2000)
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [[word() for _ in range(60)] for _ in range(12)]
    texts = [(i, " ".join([word() for _ in range(40)] + shared[i % 12] + [word() for _ in range(20)])) for i in range(48)]
    blocks = passages.blocks_of(spark.createDataFrame(texts, "id long, text string").repartition(3)).localCheckpoint()
    homes = passages.homes_of(blocks).select(F.col("no").alias("src"), F.col("block").alias("home"))
    chains = passages.chains_of(passages.shared_places(blocks, 2)).join(homes, "src").localCheckpoint()

    def seen(rows, block):
        assert "rest" not in block.column_names  # half of the hashes isn't compared
        return pa.table({"home": rows.column("home").slice(0, 1), "n": pa.array([rows.num_rows], pa.int64())}) if rows.num_rows else pa.table({"home": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})

    rounds = [{(r.home, r.n) for r in part.collect()} for part in passages._by_block(chains, blocks, "home", seen, "home long, n long", 3)]
    met = [{home for home, _ in x} for x in rounds]
    assert len(rounds) == 3 and sum(len(x) > 0 for x in met) > 1 and len(set.union(*met)) == sum(len(x) for x in met)
    assert sum(n for x in rounds for _, n in x) == chains.count() > 30
    spans = []
    for n in (1, 5):
        monkeypatch.setattr(passages, "ROUNDS", n)
        spans.append(sorted(map(tuple, passages.aligned_spans(chains, blocks).collect())))
    assert spans[0] == spans[1] and len({x[0] for x in spans[0]}) == 36


def test_blocks_of_recordings_are_dealt_over_tasks(spark, monkeypatch):
    """One block of queries against many blocks of recordings, which all went to one task before."""
    monkeypatch.setattr(audio, "BLOCK", 300)
    rng = np.random.default_rng(18)
    one = rng.integers(0, 1 << 32, 84, dtype=np.uint32)
    prints = [(50 + i, np.where(np.arange(84) == i, 7, one).astype(np.uint32).view(np.int32).tolist()) for i in range(49)]
    rows = spark.createDataFrame(prints, "class long, print array<int>")
    found = audio.matches(rows.filter("class = 50"), rows).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.match for r in found) == list(range(50, 99)) and len({r.task for r in found}) > 3


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [word() for _ in range(rng.randint(20, 60))]
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorkly", "vilegrim"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    labels += [(9999, 1), (None, 1), (3, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert got[1000].score == got[1001].score < toxicity.THRESHOLD
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).collect()} == {0}


def test_pipeline_is_wired(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "source_mixing", "bpe"]
    docs = spark.createDataFrame([(i, f"some words {i} here " * 3, "en", "s", 60) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert passages.dedup_passages(kept).columns == docs.columns and mixing.sample_mixture(kept).columns == docs.columns


def plain_features(text):
    """Bucket shares of a text's 3- to 5-grams, by plain loops."""
    mask = (1 << 64) - 1
    mixed = lambda x: (lambda y: y ^ y >> 31)(((lambda y: (y ^ y >> 27) * 0x94D049BB133111EB & mask)((x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask)))
    if not text:
        return {}
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "\xc0" <= c <= "\xde" else " " if c <= " " else c for c in text)
    own, counts, total = f" {low} ", {}, 0
    for n in toxicity.SIZES:
        for i in range(len(own) - n + 1):
            h = 0
            for c in own[i : i + n]:
                h = (h * int(toxicity._STEP) + ord(c) + 1) & mask
            b = mixed((h + n) & mask) >> (64 - toxicity.BITS)
            counts[b] = counts.get(b, 0) + 1
            total += 1
    return {b: min(1.0, n * toxicity.SCALE / max(total, toxicity.SCALE)) for b, n in counts.items()}


def test_toxicity_equals_a_plain_fit(spark):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    docs = [(i, " ".join([word() for _ in range(40)] + (["Vilegrim É"] * 3 if i % 5 == 0 else []))) for i in range(60)] + [(60, None), (61, "")]
    labels = [(i, int(i % 5 == 0)) for i in range(60)]
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    feats = {i: plain_features(t) for i, t in docs}
    train = [(feats[i], y) for i, y in labels if i not in held]
    names = {b: k for k, b in enumerate(sorted({b for f, _ in train for b in f}))}
    x = np.zeros((len(train), len(names)))
    for r, (f, _) in enumerate(train):
        for b, v in f.items():
            x[r, names[b]] = v
    y = np.array([t for _, t in train], float)
    # buckets that no training text has share in the smoothing
    rest = toxicity.SMOOTH * ((1 << toxicity.BITS) - len(names))
    p, q = x[y == 1].sum(0) + toxicity.SMOOTH, x[y == 0].sum(0) + toxicity.SMOOTH
    z = x * np.log((p / (p.sum() + rest)) / (q / (q.sum() + rest)))

    def loss(v):
        sums = z @ v[:-1] + v[-1]
        miss = 1 / (1 + np.exp(-sums)) - y
        return (np.logaddexp(0, sums) - y * sums).sum() + toxicity.PENALTY / 2 * (v[:-1] @ v[:-1]), np.append(z.T @ miss + toxicity.PENALTY * v[:-1], miss.sum())

    v = toxicity._lbfgs(loss, np.zeros(z.shape[1] + 1), 300)
    for r, i in enumerate(i for i, _ in labels if i not in held):
        assert abs(got[i] - 1 / (1 + np.exp(-(z[r] @ v[:-1] + v[-1])))) < 0.02, i
    assert all(got[i] > 0.5 for i in range(0, 60, 5)) and all(got[i] < 0.3 for i in range(60) if i % 5)


def test_votes_are_counted_where_they_meet_and_not_for_every_offset():
    rng = np.random.default_rng(9)
    long = rng.integers(0, 1 << 32, 20_000, np.uint32)
    others = [rng.integers(0, 1 << 32, 84, np.uint32) for _ in range(499)] + [long[700:784].copy()]
    tracemalloc.start()
    try:
        got = list(audio.alignments([long], others))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == [(0, 499, -700, 168, 84, 0.0)]
    assert peak < 100 << 20  # there are ten million offsets


def test_recordings_of_one_length_are_printed_together_as_each_alone(monkeypatch):
    rng = np.random.default_rng(10)
    tunes = [audio.melody_of(rng.normal(0, 0.2, n).tolist()) for n in (64, 20, 64, 64, 30, 64, 2, 20)] + [None, np.zeros(9000), np.zeros(0)]
    want = [audio.fingerprint(audio.chroma(x)) if x is not None else np.zeros(0, np.uint32) for x in tunes]
    calls = []
    alone = audio.chroma
    monkeypatch.setattr(audio, "chroma", lambda x, rate: calls.append(x.shape) or alone(x, rate))
    got = audio.prints_of(tunes)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(got, want, strict=True))
    assert (4, 64 * audio.RATE // 10) in calls
    monkeypatch.setattr(audio, "TOGETHER", 1)  # one is decoded at a time
    calls.clear()
    audio.prints_of(iter(tunes))
    assert len(calls) == 10 and {n for n, _ in calls} == {1}
