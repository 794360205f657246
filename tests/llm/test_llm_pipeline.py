"""The corpus pipeline: each stage's decisions take effect, and odd tables go through."""

from __future__ import annotations

import random

import plain
import pytest
from test_llm_operators import odd_docs

import corpus_pipeline
from quarry.llm import mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, own_1 string, text_2 string, mix_slot int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(21)
    docs = [d for d in odd_docs(rng) if d[0] != 7] + [(7, "long " * 60_000)]
    item = " ".join(f"exam{i}" for i in range(25))
    docs += [(800, f"some words before {' '.join(item.split()[3:15])} and after"), (801, "mail me at a.b@c.org or +44 20 7946 0958 please"), (802, item), (None, "a row without an id"), (None, None)]
    rows = [(d, t, [None, "en"][i % 2], ["s0", None, "s1"][i % 3], len(t or ""), "x", "y", 1) for i, (d, t) in enumerate(docs)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d, _ in docs[:30]] + [(None, 0, None), (800, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_stages_against_plain_versions(spark, tables):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    good = stages["quality classifier"](spark, docs, tables)
    assert rows(good, *docs.columns) == rows(docs, *docs.columns)  # one class of labels only: nothing is known to be bad
    single = stages["MinHash near-dedup"](spark, good, tables)
    known = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    kept = {d for d, _, _, k in plain.near_duplicates(known, 5, 80) if k}
    assert len(kept) <= len(known) - 14
    assert rows(single, *docs.columns) == sorted((tuple(r) for r in docs.collect() if r["doc_id"] is None or r["doc_id"] in kept), key=repr)
    clean = stages["benchmark decontamination"](spark, single, tables)
    before = [(r["doc_id"], r["text"]) for r in single.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    hit = [x for x, y in zip(before, plain.decontamination(before, items, 10), strict=True) if y[-1]]
    assert sorted(d for d, _ in hit) == [800, 802]
    assert rows(clean, "doc_id", "text") == sorted([x for x in before if x not in hit], key=repr) and clean.columns == docs.columns
    safe = stages["PII"](spark, clean, tables)
    assert safe.columns == docs.columns and safe.count() == clean.count()
    text = {r["doc_id"]: r for r in safe.collect()}
    assert text[801]["text"] == "mail me at <EMAIL> or <PHONE> please" and text[801]["n_chars"] == len(text[801]["text"])
    assert not any(plain.personal(r["text"]) for r in text.values())
    mixed = stages["mixing sources to target weights"](spark, safe, tables)
    assert set(mixed.columns) == set(docs.columns) | set(mixing.OUTPUT)
    assert rows(mixed, "doc_id", "text") == rows(safe, "doc_id", "text")
    final = corpus_pipeline.run(spark, tables)
    assert rows(final, *mixed.columns) == rows(mixed, *mixed.columns)


def test_documents_the_classifier_rejects_go(spark, tables, tmp_path):
    rng = random.Random(5)
    good, bad = ["a careful sentence about", "rivers and mountains", "that were measured"], ["BUY!!! now", "$$$ click", "win xx99"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(60)), "en", "s", 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
    model = quality.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")), lambda c: corpus_pipeline.remainder(c, 5) != 0)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert {r["doc_id"] for r in left.collect()} == {d for d, s in scores.items() if s >= 0.3}
    assert sum(r["doc_id"] % 2 for r in left.collect()) >= 195 and left.count() < 220


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and set(mixing.OUTPUT) <= set(out.columns)
