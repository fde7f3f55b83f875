"""The pipeline as a whole over a small corpus, stage by stage against what each must do."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from tagweave.llm import bpe


def test_stages_take_effect(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 6)))
    shared = [word() for _ in range(70)]
    rows, labels = [], []
    for i in range(120):
        words = [word() for _ in range(80)]
        if i % 6 == 0:
            for at in (5, 20, 60):
                words.insert(at, "vilegrim")
        if i in (7, 8, 9):
            words += shared
        rows.append((i, " ".join(words), ["en", "de"][i % 2], f"s{i % 3}", len(" ".join(words))))
        labels.append((i, int(i % 6 == 0), 1))
    rows += [(200 + k, rows[1][1] + " end" * k, "en", "s1", 0) for k in range(4)]
    sf_dir = str(tmp_path)
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{sf_dir}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{sf_dir}/out_{name}")
        seen[name] = docs = spark.read.parquet(f"{sf_dir}/out_{name}")
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert ids["toxicity"] == {r[0] for r in rows if "vilegrim" not in r[1]}
    assert ids["near_dedup"] == ids["toxicity"] - {200, 201, 202, 203}
    assert ids["substring_dedup"] == ids["near_dedup"]
    texts = {r.doc_id: r.text for r in seen["substring_dedup"].collect()}
    assert " ".join(shared) in texts[7] and " ".join(shared) not in texts[8] and texts[9] == " ".join(rows[9][1].split()[:80]) + " "
    assert ids["source_mixing"] <= ids["substring_dedup"] and ids["bpe"] == ids["source_mixing"]
    tk = Tokenizer.from_file(bpe.default_path())
    for r in seen["bpe"].collect():
        want = tk.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_last_stage_gives_the_token_ids(spark, docs, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe.default_path())
    rows = docs.collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    got = corpus_pipeline.encode(spark, docs, "").collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.token_ids) == tk.encode(texts[r.doc_id], add_special_tokens=False).ids
    key = lambda r: (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
    assert sorted(map(key, got)) == sorted(map(key, bpe.round_trip(docs, ["doc_id"]).collect()))
    assert corpus_pipeline.encode(spark, none, "").isEmpty()


def test_stages_on_odd_rows(spark, docs, none, tmp_path):
    """Null, empty and long texts, repeated rows, columns named like added ones, an empty table."""
    names = ("score", "predicted", "topic", "tokens", "probability", "sampled", "key", "passages", "n_shingles", "component_id", "kept")
    spark.createDataFrame([(1, 0, 1), (2, 1, None), (None, 1, 0), (77, None, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, none):
        now = rows.selectExpr("*", "cast(length(text) as long) n_chars", *(f"concat('{c}', doc_id) {c}" for c in names))
        want = {(r.doc_id, *(r[c] for c in names)) for r in now.collect()}
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            if name == "bpe":
                assert out.count() == now.count()
                continue
            assert out.columns == now.columns, name
            path = str(tmp_path / f"{i}-{len(want)}")
            out.write.parquet(path)
            now = spark.read.parquet(path)
            assert {(r.doc_id, *(r[c] for c in names)) for r in now.collect()} <= want, name
