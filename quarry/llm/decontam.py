"""Benchmark decontamination: suffix arrays over shards of documents, searched for every test suffix."""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches
from ._words import ALNUM, pieces, word_hashes

#: A word number takes 21 bits, so three fit a sort key.
BITS = 21
MOST = (1 << BITS) - 2
FOUND = ("n_words", "n_hit", "longest_match", "n_items", "items_sha256", "contaminated")
PLACES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
#: Bytes of text in a shard.
SHARD = 2 << 20


@dataclass
class TestBlock:
    """Windows of some benchmark items, sorted: numbers of their words, padded to whole keys."""

    vocabulary: np.ndarray
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    owners: list[list[int]]
    places: list[list[int]]
    items: list[str]


def _keys(ids: np.ndarray, levels: int) -> np.ndarray:
    """For each position, its next 3 * levels words as ``levels`` integers; 0 stands beyond the end."""
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(3 * levels + 3, np.int64)])
    three = (padded[:-2] << (2 * BITS)) | (padded[1:-1] << BITS) | padded[2:]
    return np.stack([three[3 * j : 3 * j + n] for j in range(levels)])


def blocks(benchmark: DataFrame, window: int, most_words: int):
    """Read the benchmark in blocks of at most ``most_words`` words (or one item), each ready to broadcast."""
    levels = -(-window // 3)

    def made(rows):
        col = pa.array([r["text"] for r in rows], pa.string())
        h, first = word_hashes(col, ALNUM, True)
        vocabulary, ids = np.unique(h, return_inverse=True)
        ids = ids.astype(np.int64) + 1
        seen: dict[tuple, int] = {}
        owners, places, length, low, high = [], [], [], [], []
        for k in range(len(rows)):
            w = ids[first[k] : first[k + 1]]
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if size else 0):
                key = tuple(w[i : i + size].tolist())
                if key not in seen:
                    seen[key] = len(owners)
                    owners.append([])
                    places.append([])
                    length.append(size)
                    low.append(key + (0,) * (3 * levels - size))
                    high.append(key + (MOST + 1,) * (3 * levels - size))
                owners[seen[key]].append(k)
                places[seen[key]].append(i)
        shift = np.array([1 << 2 * BITS, 1 << BITS, 1], np.int64)
        as_keys = lambda x: (np.array(x, np.int64).reshape(len(x), levels, 3) @ shift).T
        return TestBlock(vocabulary, as_keys(low), as_keys(high), np.array(length, np.int64), owners, places, [str(r["item_id"]) for r in rows])

    rows, total = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").encode("utf-8", "replace")) // 2 + 1  # at least the number of words
        if rows and total + n > min(most_words, MOST):
            yield made(rows)
            rows, total = [], 0
        rows.append(r)
        total += n
    if rows:
        yield made(rows)


def suffix_array(ids: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of known words, sorted by their next 3 * levels words, and the keys of every position.

    Positions whose word isn't in the benchmark (0) start no match and are left out.
    """
    keys = _keys(ids, levels)
    at = np.flatnonzero(ids)
    order = at[np.argsort(keys[0][at], kind="stable")]
    first = keys[0][order]
    same = np.concatenate([[False], first[1:] == first[:-1]])
    tied = same.copy()
    tied[:-1] |= same[1:]
    where = np.flatnonzero(tied)
    if where.size and levels > 1:
        group, sub = np.cumsum(~same)[where], order[where]
        order[where] = sub[np.lexsort((*(keys[j][sub] for j in range(levels - 1, 0, -1)), group))]
    return order, keys


def search(order: np.ndarray, keys: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all ``want`` (levels x m) at once: the first suffix not below (right: above) each."""
    first = keys[0][order]
    lo, hi = np.searchsorted(first, want[0], "left"), np.searchsorted(first, want[0], "right")
    levels = len(keys)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        pos, less, equal = order[mid], np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for j in range(levels):
            a, b = keys[j][pos], want[j][open_]
            less |= equal & (a < b)
            equal &= a == b
        up = less | (equal if right else False)
        lo[open_] = np.where(up, mid + 1, lo[open_])
        hi[open_] = np.where(up, hi[open_], mid)
    return lo


def matches(block: TestBlock, ids: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every occurrence of a window in the word numbers ``ids``."""
    if not len(block.length) or not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, keys = suffix_array(ids, levels)
    a, b = search(order, keys, block.low, False), search(order, keys, block.high, True)
    if any(block.low[0] != block.high[0]):  # windows of one or two words cover several first keys
        first = keys[0][order]
        short = np.flatnonzero(block.low[0] != block.high[0])
        a[short], b[short] = np.searchsorted(first, block.low[0][short], "left"), np.searchsorted(first, block.high[0][short], "right")
    n = np.maximum(b - a, 0)
    window = np.repeat(np.arange(len(n)), n)
    return order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())], window


def _numbers(block: TestBlock, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, first = word_hashes(col, ALNUM, True)
    at = np.minimum(np.searchsorted(block.vocabulary, h), max(0, len(block.vocabulary) - 1))
    found = block.vocabulary[at] == h if len(block.vocabulary) else np.zeros(len(h), bool)
    ids = np.where(found, at + 1, 0)
    # A gap after each text, so that no match runs over its end.
    k = np.arange(len(first) - 1)
    out = np.zeros(len(h) + len(first) - 1, np.int64)
    owner = np.repeat(k, np.diff(first))
    out[np.arange(len(h)) + owner] = ids
    return out, first + np.arange(len(first))


def _found(block: TestBlock, col: pa.Array, levels: int):
    """For each text: words, the longest verbatim run and the items found; then all occurrences by position."""
    ids, first = _numbers(block, col)
    pos, window = matches(block, ids, levels)
    by_pos = np.argsort(pos, kind="stable")
    pos, window = pos[by_pos], window[by_pos]
    n = len(first) - 1
    doc = np.searchsorted(first, pos, "right") - 1
    items, longest = [set() for _ in range(n)], np.zeros(n, np.int64)
    if len(pos):
        pairs = np.unique(np.stack([doc, window]), axis=1)
        for d, w in pairs.T.tolist():
            items[d].update(block.owners[w])
        # Matches that go on word by word, in item and document alike, are one longer match.
        runs: dict[tuple, int] = {}
        for p, w, d in zip(pos.tolist(), window.tolist(), doc.tolist(), strict=True):
            size = int(block.length[w])
            for k, i in zip(block.owners[w], block.places[w], strict=True):
                run = runs.pop((p - 1, k, i - 1), size - 1) + 1
                runs[p, k, i] = run
                longest[d] = max(longest[d], run)
    return np.diff(first) - 1, longest, items, first, pos, window


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_words: int = 1_000_000, texts: bool = False, places: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, longest_match, n_items, items_sha256, contaminated for every row of ``docs``.

    Words are runs of [0-9a-z] and non-ASCII characters of the lower-cased text; a word is hit if a
    window of ``window`` consecutive words of an item (the whole item, if it is shorter) covers it.
    Shards of whole documents (about 2 MB) are sorted into suffix arrays, in which all windows are
    searched by bisection; equal suffixes give the locations. longest_match is the most consecutive
    words shared with an item, in windows. With ``places`` there is a column more, locations: the ranges of
    hit words (from 0, the end outside).

    The benchmark is taken in blocks of ``most_words`` words, each broadcast on its own; with several,
    the documents pass through one search after the other without a shuffle. A null or empty text has
    no words and is clean; an item without words has no windows; an empty benchmark hits nothing; rows
    repeat as they come; other columns are ignored (``texts``: kept in the result, with the found ones
    added).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    levels = -(-window // 3)
    names = docs.columns if texts else ["doc_id"]
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("t"), F.lit(None).cast("binary").alias("state"))
    row = state.schema["row"].dataType.simpleString()
    done = f"row {row}, n_words long, n_hit long, longest_match long, n_items long, items_sha256 string, contaminated boolean, locations array<struct<begin:long,end:long>>"
    nothing = ([], set(), 0)
    coming = blocks(benchmark, window, most_words)
    block = next(coming, None) or TestBlock(np.zeros(0, np.uint64), *(np.zeros((levels, 0), np.int64),) * 2, np.zeros(0, np.int64), [], [], [])
    while block is not None:
        after = next(coming, None)
        shared, last = spark.sparkContext.broadcast(block), after is None

        def run(batches, shared=shared, last=last):
            for b in pieces(batches, "t", SHARD):
                block = shared.value
                n, longest, items, first, pos, win = _found(block, b.column("t"), levels)
                cut = np.searchsorted(pos, first)
                states = b.column("state").to_pylist()
                for d in np.flatnonzero([len(x) > 0 for x in items]).tolist():
                    spans, have, most = pickle.loads(states[d]) if states[d] else nothing
                    own = slice(cut[d], cut[d + 1])
                    start = pos[own] - first[d]
                    spans = merged([*spans, *zip(start.tolist(), (start + block.length[win[own]]).tolist(), strict=True)])
                    states[d] = pickle.dumps((spans, have | {block.items[k] for k in items[d]}, max(most, int(longest[d]))))
                if not last:
                    yield b.set_column(2, "state", pa.array(states, pa.binary()))
                    continue
                found = [pickle.loads(x) if x else nothing for x in states]
                hit = [sum(y - x for x, y in s[0]) for s in found]
                sha = [hashlib.sha256(",".join(sorted(s[1])).encode()).hexdigest() for s in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([s[2] for s in found], pa.int64()), pa.array([len(s[1]) for s in found], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_()), pa.array([[{"begin": x, "end": y} for x, y in s[0]] for s in found], PLACES)],
                    names=["row", *FOUND, "locations"],
                )

        state = state.mapInArrow(run, done if last else state.schema)
        block = after
    return state.select(*[F.col("row").getField(c).alias(c) for c in names], *FOUND, *["locations"] * places)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges that cover the same."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, that share no window with the benchmark.

    Null and empty texts share none and stay; rows that repeat go or stay together; an empty benchmark leaves
    all rows; further columns may have any names.
    """
    inner = docs.toDF(*[f"own_{i}" for i in range(len(docs.columns))])
    text = f"own_{docs.columns.index('text')}"
    found = find(inner.withColumn("text", F.col(text)), benchmark, window, texts=True)
    return found.where(~F.col("contaminated")).select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])
