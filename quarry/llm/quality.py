"""Quality by compression: texts shrink more with a dictionary of their own kind."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, sampled
from ._words import pieces

#: Bytes that are compressed at a time, so that a long text doesn't become its own dictionary.
BLOCK = 2048


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the line that turns the size difference into log odds."""

    good: bytes
    bad: bytes
    bias: float
    slope: float


@lru_cache(maxsize=4)
def _compressors(model: QualityModel):
    both = []
    for raw in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
        d.precompute_compress(level=3)
        both.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
    return both


def difference(model: QualityModel, text: bytes) -> float:
    """(size with the bad dictionary - size with the good one) / their sum, over all blocks; 0 if empty."""
    good, bad = _compressors(model)
    a = b = 0
    for i in range(0, len(text), BLOCK):
        part = text[i : i + BLOCK]
        a += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - a) / (a + b) if text else 0.0


def _dictionary(texts: list[bytes], size: int) -> bytes:
    parts = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"\n".join(parts)[-size:] or b"        "


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Bias and slope of the log odds; weights count relative to their mean, so the ridge's share depends on no total."""
    weight = weight / (weight.mean() or 1.0)
    scale = x.std() or 1.0
    a = np.stack([np.ones_like(x), x / scale], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + 1e-2 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def fit(docs: DataFrame, labels: DataFrame, learn, per_class: int = 1500, longest: int = 65536, size: int = 65536) -> QualityModel:
    """Learn from labels(doc_id, quality) with ``learn`` true of the doc_id column.

    About ``per_class`` labelled texts of each class are fetched (twice as many at most), picked by a hash
    of doc_id, and only texts up to ``longest`` bytes; that bounds the driver's memory whatever the tables
    hold. Where labels repeat a doc_id, each counts; a null doc_id, or a label but 0 and 1, teaches nothing.
    Two thirds of them make the dictionaries, the rest the calibration, weighted by the classes' true
    shares among all labels that may be learnt from. Without texts of both classes, every score is the
    share of class 1 (0.5 without labels).
    """
    marked = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & learn(F.col("doc_id")))
    own = marked.groupBy("y", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    tally = {r["y"]: r for r in own.groupBy("y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids")).collect()}
    total, ids_of = ({y: r[c] for y, r in tally.items()} for c in ("n", "ids"))
    picked: dict[int, list[int]] = {}
    for y in (0, 1):
        rows = marked.where((F.col("y") == y) & sampled("doc_id", per_class, ids_of.get(y, 0))).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class).collect()
        for r in rows:
            picked.setdefault(r["doc_id"], []).append(y)
    texts: tuple[list, list] = ([], [])
    if picked:
        ids = docs.sparkSession.createDataFrame([(k,) for k in picked], "doc_id long")
        found = docs.select("doc_id", "text").where(F.octet_length("text").between(1, longest)).join(F.broadcast(ids), "doc_id", "left_semi")
        for r in sorted(found.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(4 * per_class).collect()):
            for y in picked[r["doc_id"]]:
                texts[y].append(r["text"].encode("utf-8", "replace"))
    n = [total.get(0, 0), total.get(1, 0)]
    prior = math.log((n[1] + 1) / (n[0] + 1))
    if min(map(len, texts)) < 3:
        return QualityModel(b"        ", b"        ", prior, 0.0)
    own, rest = [[t for i, t in enumerate(ts) if i % 3] for ts in texts], [ts[::3] for ts in texts]
    model = QualityModel(_dictionary(own[1], size), _dictionary(own[0], size), 0.0, 1.0)
    x = np.array([difference(model, t) for y in (0, 1) for t in rest[y]])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    share = np.repeat([n[0] / len(rest[0]), n[1] / len(rest[1])], [len(rest[0]), len(rest[1])])
    bias, slope = _logistic(x, y, share)
    return QualityModel(model.good, model.bad, bias, slope)


def _scores(model: QualityModel, col: pa.Array) -> np.ndarray:
    z = [model.bias + model.slope * difference(model, t or b"") for t in col.cast(pa.binary()).to_pylist()]
    return 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1; higher: label 1 likelier) for every row; null and empty texts have no
    size difference and get the score at 0. Rows repeat as they come, equal texts score alike, and an empty
    table stays empty. Nothing is shuffled; other columns are ignored."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(_scores(model, b.column("text")))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more.

    Null and empty texts go or stay by the score without a size difference; rows that repeat go or stay
    together; an empty table stays empty; further columns may have any names but text's.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in pieces(batches, at):
            yield b.filter(pa.array(_scores(model, b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
