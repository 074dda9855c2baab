"""The pipeline's stages on a small corpus with planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
from phaseloom.llm.common import stored


def plant(spark, folder: str) -> None:
    rng = random.Random(12)
    sentence = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(200):
        good = i % 5 != 0
        t = "\n".join(sentence(15) for _ in range(4)) if good else " | ".join(sentence(50).upper().split()) + "!!"
        rows.append((i, t))
        labels.append((i, int(good), 0))
    long = [sentence(30) for _ in range(5)]
    rows += [(300, "\n".join(long)), (301, "\n".join(long)), (302, "\n".join([sentence(20), *long[1:4], sentence(20)]))]
    w = sentence(200).split()
    rows += [(310, " ".join(w)), (311, " ".join([*w[:100], "changed", *w[101:]]))]
    rows += [(320, sentence(40) + " password=hunter2hunter2 " + sentence(10)), (330, None), (331, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    plant(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(spark, stage(spark, docs, folder), "test")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    good = {i for i in range(200) if i % 5}
    ids = {n: {r.doc_id for r in d.collect()} for n, d in seen.items()}
    assert good <= ids["quality classifier"] and not ids["quality classifier"] & {i for i in range(200) if not i % 5}
    lines = {r.doc_id: r.text for r in seen["line dedup"].collect()}
    assert 301 not in lines and lines[300].count("\n") == 4 and lines[302].count("\n") == 1 and good <= set(lines)
    assert 310 in ids["near-duplicate removal"] and 311 not in ids["near-duplicate removal"] and good <= ids["near-duplicate removal"]
    secret = {r.doc_id: (r.text, r.n_chars) for r in seen["secret scan"].collect()}
    assert "hunter2" not in secret[320][0] and secret[320][1] == len(secret[320][0])
    assert ids["packing"] == ids["secret scan"]


def test_run_on_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
