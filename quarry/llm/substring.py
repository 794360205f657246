"""Repeated passages by level-wise doubling: only windows that repeat at one length are tried at twice that length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, discard, materialize, sized_shards
from ._words import K2, SPACED, U, flat, give_back, grams, hashes, mix, pack, pieces, unpack, words

#: Bits of a level's filter of repeated windows, which is broadcast: by the size of the texts, within these bounds.
FILTER_BITS, MOST_FILTER_BITS = 1 << 26, 1 << 29
#: Text that is gathered before windows are dealt out, and windows that a task takes at once.
GATHER, TASK = 16 << 20, 4_000_000
#: Text for each key range.
RANGE = 8 << 20
#: The seed of a window's second hash.
CHECK = 1
NO_ID = np.iinfo(np.int64).max


class RepeatFilter:
    """Which windows of a level occur more than once: never misses one, and rarely adds one."""

    def __init__(self, slices: int, bits: int = FILTER_BITS):
        self.slices, self.words = slices, max(1, bits // slices // 64)
        self.bits = np.zeros((slices, self.words), U)

    @staticmethod
    def cells(keys: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
        h = mix(keys ^ K2)
        n = U(words * 64)
        return (h >> U(32)) % n, (h & U(0xFFFFFFFF)) % n

    @classmethod
    def part(cls, keys: np.ndarray, words: int) -> bytes:
        out = np.zeros(words, U)
        for c in cls.cells(keys, words):
            np.bitwise_or.at(out, (c >> U(6)).astype(np.int64), U(1) << (c & U(63)))
        return zstandard.ZstdCompressor(level=1).compress(out.tobytes())

    def has(self, keys: np.ndarray) -> np.ndarray:
        s, ok = shard_of(keys, self.slices), np.ones(len(keys), bool)
        for c in self.cells(keys, self.words):
            ok &= (self.bits[s, (c >> U(6)).astype(np.int64)] >> (c & U(63))) & U(1) == 1
        return ok


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U(32)) * U(n) >> U(32)).astype(np.int64)


def filter_bits(shards: int) -> int:
    """An eighth of a bit for each byte of text, within bounds; a filter that is full passes all windows on, which costs time only."""
    return min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (shards * RANGE // 8).bit_length()))


def levels(window: int, least: int = 6) -> list[int]:
    """Lengths from a short one to ``window``, each at most twice the one before."""
    out = [window]
    while -(-out[0] // 2) >= least:
        out.insert(0, -(-out[0] // 2))
    return out


class Piece:
    """Some documents' words: hashes, and for each level the key of every window of ``window`` words.

    A level's key for a window is the least hash of its runs of that many words, so that neighbouring
    windows mostly share theirs; equal windows have equal keys at every level. At the last level it is the
    hash of the whole window.
    """

    def __init__(self, col: pa.Array, window: int):
        self.data, self.off = flat(col)
        self.starts, self.lens, self.first = words(self.data, self.off, SPACED)
        self.h, self.window = hashes(self.data, self.starts, self.lens), window
        n = np.diff(self.first)
        valid = np.repeat(np.maximum(self.first[1:] - window + 1, self.first[:-1]), n)
        self.at = np.flatnonzero(np.arange(len(self.h)) < valid)
        self.doc = np.repeat(np.arange(len(n)), n)[self.at]

    def keys(self, length: int) -> np.ndarray:
        g = grams(self.h, length)
        if not len(self.at):
            return np.zeros(0, U)
        least = g[self.at]
        for j in range(1, self.window - length + 1):
            np.minimum(least, g[self.at + j], out=least)
        return mix(least)

    def checks(self) -> np.ndarray:
        """For every window, a hash that is independent of its key at the last level."""
        g = grams(hashes(self.data, self.starts, self.lens, CHECK), self.window)
        return g[self.at] if len(self.at) else np.zeros(0, U)

    def surviving(self, filters: list[tuple[int, RepeatFilter]]) -> None:
        """Leave only the windows that repeat at the given levels."""
        for length, f in filters:
            ok = f.has(self.keys(length))
            self.at, self.doc = self.at[ok], self.doc[ok]


def found_at(known: np.ndarray, check: np.ndarray, k: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where each (k, c) stands in (known, check), sorted by both; -1 if it isn't there."""
    at = np.searchsorted(known, k)
    out = np.full(len(k), -1)
    open_ = np.arange(len(k))
    while len(open_):  # goes on only where different windows have one key
        p = at[open_]
        open_, p = open_[p < len(known)], p[p < len(known)]
        same = known[p] == k[open_]
        hit = same & (check[p] == c[open_])
        out[open_[hit]] = p[hit]
        open_ = open_[same & ~hit]
        at[open_] += 1
    return out


def _deal(keys: np.ndarray, n: int):
    """(shard, range) for sorted keys."""
    cut = np.searchsorted(shard_of(keys, n), np.arange(n + 1))
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), slice(int(cut[s]), int(cut[s + 1]))


def _level(docs: DataFrame, window: int, length: int, filters, n: int):
    """The filter of windows that repeat at ``length``; at the last level also (shard, keys, least ids, load)."""
    last, spark = length == window, docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)

    def run(batches):
        ids, keys, checks, rows, size = [], [], [], 0, 0

        def flush():
            k, d, c = np.concatenate(keys), np.concatenate(ids), np.concatenate(checks)
            order = np.lexsort((d, c, k))
            k, d, c = k[order], d[order], c[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            # The first in order has the least id; whether the last has another tells of a repeat.
            end = np.concatenate([at[1:], [len(k)]]) - 1 if len(at) else at
            many = (d[at] != d[end]).astype(np.uint8)
            count = (end - at + 1).astype(np.uint32)
            k, d, c = k[at], d[at], c[at]
            for s, r in _deal(k, n):
                yield s, pack(k[r], c[r], d[r], many[r], count[r]) if last else pack(k[r], many[r]), len(k[r])

        def out(found):
            found = list(found)
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], names=["shard", "blob", "load"])

        for b in pieces(batches, "text"):
            p = Piece(b.column("text"), window)
            p.surviving(shared.value)
            id_ = b.column("doc_id").cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            k, d = p.keys(length), id_[p.doc]
            c = p.checks() if last else np.zeros(len(k), np.uint8)
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) and not last else slice(None)
            keys.append(k[new])
            ids.append(d[new])
            checks.append(c[new])
            size += len(p.data)
            rows += len(keys[-1])
            if size >= GATHER or rows >= TASK:
                yield out(flush())
                ids, keys, checks, rows, size = [], [], [], 0, 0
        if keys:
            yield out(flush())

    width = max(1, filter_bits(n) // n // 64)

    def count(table: pa.Table) -> pa.Table:
        s, load = table["shard"][0].as_py(), 0
        k, c, d, many = [], [], [], []
        for blob in table["blob"].to_pylist():
            parts = unpack(blob, U, U, np.int64, np.uint8, np.uint32) if last else unpack(blob, U, np.uint8)
            k.append(parts[0])
            many.append(parts[-2] if last else parts[1])
            c.append(parts[1] if last else np.zeros(0, U))
            d.append(parts[2] if last else np.zeros(0, np.int64))
            if last:
                load += int(parts[4].sum())
        k, c, many = np.concatenate(k), np.concatenate(c), np.concatenate(many)
        order = np.lexsort((c, k)) if last else np.argsort(k, kind="stable")
        ks = k[order]
        new = ks[1:] != ks[:-1]
        if last:
            new |= c[order][1:] != c[order][:-1]
        at = np.flatnonzero(np.concatenate([[True], new]))
        times = np.diff(np.concatenate([at, [len(ks)]]))
        repeat = (times > 1) | (np.maximum.reduceat(many[order], at) > 0)
        blob = b""
        if last:
            blob = pack(ks[at][repeat], c[order][at][repeat], np.minimum.reduceat(np.concatenate(d)[order], at)[repeat])
        give_back()
        return pa.table({"shard": pa.array([s], pa.int32()), "bits": pa.array([RepeatFilter.part(ks[at][repeat], width)], pa.binary()), "blob": pa.array([blob], pa.binary()), "load": pa.array([load], pa.int64())})

    dealt = docs.select("doc_id", "text").mapInArrow(run, "shard int, blob binary, load long")
    found = materialize(dealt.groupBy("shard").applyInArrow(count, "shard int, bits binary, blob binary, load long"))
    filter_ = RepeatFilter(n, filter_bits(n))
    loads = {}
    for r in found.select("shard", "bits", "load").toLocalIterator():  # MOST_FILTER_BITS in all, a shard at a time
        filter_.bits[r["shard"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["bits"]), U)
        loads[r["shard"]] = r["load"]
    return filter_, found, loads


def _digest(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, keep: np.ndarray | None = None) -> str:
    raw = data.tobytes()
    at = range(len(starts)) if keep is None else np.flatnonzero(keep).tolist()
    s, e = starts.tolist(), (starts + lens).tolist()
    return hashlib.sha256(b" ".join([raw[s[i] : e[i]] for i in at])).hexdigest()


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` consecutive words covers it whose words also stand, in this order,
    in a document with a smaller doc_id. kept_sha256 is over the kept words joined by single blanks.

    For 13 words the levels are 7 and 13. At each level the windows that repeated at the level before are
    gathered (equal ones in one batch of text only once), dealt out by key and counted; a filter of fixed
    size carries those that repeat to the next level. At the last level the least doc_id of each repeated
    window is kept, and the windows are dealt out once more, hot key ranges to several tasks, to meet it.
    Only documents with such windows are shuffled. At the last level windows are the same if two independent
    64-bit hashes of their words are, and a document's row is found by its doc_id and a hash of its text.

    A null, empty or blank text has no words. A null doc_id counts as larger than any other; rows with the
    same doc_id don't repeat each other; ties and repeated rows get equal results; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = sized_shards(docs, "text", RANGE)
    filters: list[tuple[int, RepeatFilter]] = []
    found, loads = None, {}
    for length in levels(window):
        if found is not None:
            discard(found)
        f, found, loads = _level(docs, window, length, filters, n)
        filters.append((length, f))
    shared = spark.sparkContext.broadcast(filters)
    salts = np.ones(n, np.int64)
    for s, load in loads.items():
        salts[s] = max(1, -(-load // TASK), -(-load * n // max(1, 2 * sum(loads.values()))))

    def occurrences(batches):
        part = 0
        for b in pieces(batches, "text", GATHER // 2):
            part += 1
            p = Piece(b.column("text"), window)
            p.surviving(shared.value)
            k = p.keys(window)
            id_ = b.column("doc_id").cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            row = hashes(p.data, p.off[:-1], np.diff(p.off))  # tells rows of one doc_id apart
            order = np.argsort(k, kind="stable")
            k, d, pos = k[order], p.doc[order], (p.at - p.first[p.doc])[order].astype(np.uint32)
            c = p.checks()[order]
            out = [(s, (part + int(id_[d[r.start]])) % int(salts[s]), pack(k[r], c[r], id_[d[r]], row[d[r]], pos[r])) for s, r in _deal(k, n)]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["shard", "salt", "blob"])

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Windows that a smaller id has, dealt out by document."""
        out: tuple[list, list] = ([], [])
        if left.num_rows and right.num_rows:
            known, check, least = unpack(right["blob"][0].as_py(), U, U, np.int64)
            got = []
            for blob in left["blob"].to_pylist():
                k, c, d, row, pos = unpack(blob, U, U, np.int64, U, np.uint32)
                at = found_at(known, check, k, c)
                ok = at >= 0
                ok[ok] = least[at[ok]] < d[ok]
                got.append((mix(row ^ d.view(U))[ok], d[ok], pos[ok]))
            ident, d, pos = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(ident, kind="stable")
            ident, d, pos = ident[order], d[order], pos[order]
            for s, r in _deal(ident, n):
                out[0].append(s)
                out[1].append(pack(ident[r], d[r], pos[r]))
        give_back()
        return pa.table({"group": pa.array(out[0], pa.int32()), "blob": pa.array(out[1], pa.binary())})

    def texts(batches, candidates: bool):
        for b in pieces(batches, "text", GATHER // 2):
            p = Piece(b.column("text"), window)
            p.surviving(shared.value)
            some = np.zeros(b.num_rows, bool)
            some[p.doc] = True
            if candidates:
                id_ = b.column("doc_id").cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
                ident = mix(hashes(p.data, p.off[:-1], np.diff(p.off)) ^ id_.view(U))
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(ident, n), pa.int32()), pa.array(ident.view(np.int64)), b.column("doc_id").cast(pa.int64()), b.column("text").cast(pa.string())], names=["group", "ident", "doc_id", "text"]).filter(pa.array(some))
            else:
                at = np.flatnonzero(~some)
                words_ = np.diff(p.first)
                sha = [_own(p, i) for i in at]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()).take(pa.array(at)), pa.array(words_[at], pa.int64()), pa.array(np.zeros(len(at), np.int64)), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        got = [unpack(x, U, np.int64, np.uint32) for x in right["blob"].to_pylist()]
        ident, of, pos = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        order = np.argsort(ident, kind="stable")
        ident, of, pos = ident[order], of[order], pos[order].astype(np.int64)
        cols: tuple[list, ...] = ([], [], [], [])
        for b in pieces(iter(left.to_batches()), "text"):
            p = Piece(b.column("text"), window)
            own = b.column("ident").to_numpy(zero_copy_only=False).view(U)
            id_ = b.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            a, z = np.searchsorted(ident, own, "left"), np.searchsorted(ident, own, "right")
            for i in range(b.num_rows):
                m = int(p.first[i + 1] - p.first[i])
                edge = np.zeros(m + 1, np.int64)
                at = np.unique(pos[a[i] : z[i]][of[a[i] : z[i]] == id_[i]])
                edge[at] += 1
                edge[at + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                cols[0].append(b.column("doc_id")[i].as_py())
                cols[1].append(m)
                cols[2].append(int(gone.sum()))
                cols[3].append(_own(p, i, ~gone))
        give_back()
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n_words": pa.array(cols[1], pa.int64()), "n_removed": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3], pa.string())})

    slim = docs.select("doc_id", "text")
    rows = [(s, k) for s in range(n) if salts[s] > 1 for k in range(1, int(salts[s]))]
    more = spark.createDataFrame(rows, "s int, salt int") if rows else None
    known = found.select("shard", F.lit(0).alias("salt"), "blob")
    if more is not None:
        known = known.unionByName(found.join(F.broadcast(more), F.col("shard") == F.col("s")).select("shard", "salt", "blob"))
    removed = slim.mapInArrow(occurrences, "shard int, salt int, blob binary").groupBy("shard", "salt").cogroup(known.groupBy("shard", "salt")).applyInArrow(meet, "group int, blob binary")
    some = slim.mapInArrow(lambda it: texts(it, True), "group int, ident long, doc_id long, text string")
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    changed = some.groupBy("group").cogroup(removed.groupBy("group")).applyInArrow(cut, result)
    return slim.mapInArrow(lambda it: texts(it, False), result).unionByName(changed)


def _own(p: Piece, i: int, keep: np.ndarray | None = None) -> str:
    """The digest of one document of a piece."""
    a, z = int(p.first[i]), int(p.first[i + 1])
    base = int(p.off[i])
    return _digest(p.data[base : int(p.off[i + 1])], p.starts[a:z] - base, p.lens[a:z], keep)
