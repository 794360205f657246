"""Language identification: one Bloom filter lookup gives all languages that contain an n-gram."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches
from ._words import K1, LOWER, U, flat, mix, pieces

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
SLOTS, HASHES = 1 << 19, 3


@dataclass
class LanguageModel:
    """planes[p, slot]: a bit for each language; false_rate: how often an absent n-gram seems present."""

    names: list[str]
    planes: np.ndarray
    false_rate: np.ndarray


def ngrams(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of each text, and the first one's index for each text (plus one).

    Letters are lower-cased, all else is blank; words have single blanks between them, before the first and
    after the last. The n-grams are the runs of ``n`` bytes, and each word that is shorter than ``n`` bytes
    even with its blanks, so that every text with a letter has some.
    """
    low = LOWER[data]
    if len(low) > 1:  # capital letters of Latin-1 in UTF-8
        up = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[up] += 0x20
    low = np.insert(low, np.concatenate([off[:-1], off[1:]]), 32)
    off = off + 2 * np.arange(len(off))
    letter = LETTER[low]
    low = np.where(letter, low, np.uint8(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[off[:-1]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    low, off = low[keep], total[off]
    view = np.ndarray(len(low) + 1, "<u8", np.concatenate([low, np.full(8, 32, np.uint8)]), strides=(1,))[:-1]
    place = np.arange(len(low))
    long = place < np.repeat(np.maximum(off[1:] - n + 1, off[:-1]), np.diff(off))
    # Blanks before words of so few bytes, and the words' sizes with both blanks.
    blank = np.flatnonzero(low == 32)
    size = np.diff(blank) + 1
    some = (size > 2) & (size < n)
    short, size = blank[:-1][some], size[some]
    count = long.astype(np.int64)
    count[short] += 1
    end = np.cumsum(count)
    out = np.empty(int(end[-1]) if len(end) else 0, U)
    out[(end - count)[long]] = view[long] & U((1 << 8 * n) - 1)
    out[end[short] - 1] = view[short] & ((U(1) << (U(8) * size.astype(U))) - U(1))
    return out, np.concatenate([[0], end])[off]


def _slots(g: np.ndarray) -> list[np.ndarray]:
    h = mix(g * K1)
    return [((h >> U(20 * j)) & U(SLOTS - 1)).astype(np.int64) for j in range(HASHES)]


def fit(docs: DataFrame, learn, per_language: int = 600, longest: int = 65536, n: int = 5) -> LanguageModel:
    """Learn from rows with text and lang for which ``learn`` is true of the doc_id column.

    About ``per_language`` texts of each language, none over ``longest`` bytes, picked by a hash of
    doc_id, are fetched (twice as many at most): the driver's memory is bounded by the number of languages.
    N-grams that occur twice or more in them enter the filter. Rows that repeat count each time; a null
    doc_id is no reason to leave a text out unless ``learn`` is.
    """
    known = docs.where(F.col("lang").isNotNull() & F.octet_length("text").between(1, longest) & learn(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts)
    planes = np.zeros(((len(names) + 63) // 64 or 1, SLOTS), U)
    if names:
        part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000))
        rates = docs.sparkSession.createDataFrame([(k, min(1_000_000, 1_000_000 * per_language // v + 1)) for k, v in counts.items()], "lang string, rate long")
        rows = known.join(F.broadcast(rates), "lang").where(part < F.col("rate")).orderBy(part, F.xxhash64("text")).select("lang", "text").limit(2 * per_language * len(names)).collect()
        for i, name in enumerate(names):
            texts = [r["text"].encode("utf-8", "replace") for r in rows if r["lang"] == name]
            data, off = flat(pa.array(texts, pa.binary()))
            g, times = np.unique(ngrams(data, off, n)[0], return_counts=True)
            for s in _slots(g[times > 1] if len(texts) > 5 else g):
                planes[i // 64, s] |= U(1 << i % 64)
    full = np.array([np.mean((planes[i // 64] >> U(i % 64)) & U(1)) for i in range(len(names))])
    return LanguageModel(names, planes, full**HASHES)


def predict(docs: DataFrame, model: LanguageModel, n: int = 5) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every row.

    A text that is null or has no letter gets `und` and score 0. Each n-gram's bitmask, the AND of its
    slots, adds to the counts of all languages in it; the counts, less the false positives that the
    filter's fill leads one to expect, decide, ties going to the first name. The score is the winner's
    share of the counts above what the best languages have in common. A text whose n-grams no language
    holds gets the first language at score 0; a model without languages gives `und` to all. Rows repeat as
    they come, a null doc_id stays null, an empty table stays empty, and further columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS words for 64 languages

    def run(batches):
        m = shared.value
        for b in pieces(batches, "text", 1 << 20):
            data, off = flat(b.column("text"))
            g, first = ngrams(data, off, n)
            k = np.diff(first)
            masks = [np.bitwise_and.reduce([p[s] for s in _slots(g)]) for p in m.planes]
            hits = np.zeros((len(m.names), len(k)))
            for i, fp in enumerate(m.false_rate):
                c = np.concatenate([[0], np.cumsum((masks[i // 64] >> U(i % 64)) & U(1))]).astype(np.int64)
                hits[i] = np.maximum(0, (c[first[1:]] - c[first[:-1]] - fp * k) / (1 - fp + 1e-9))
            names, scores = [], []
            for j, t in enumerate(b.column("text").to_pylist()):
                if not m.names or not t or not any(map(str.isalpha, t)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                top = int(np.argmax(hits[:, j]))
                names.append(m.names[top])
                shares = (hits[:, j] + 0.5) / (k[j] + 1)
                odds = (shares / shares.max()) ** 8
                scores.append(float(min(1.0, hits[top, j] / max(k[j], 1)) ** 0.25 / odds.sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
