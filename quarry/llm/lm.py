"""A language model of words, pairs and triples by deleted interpolation, counted and applied over the whole corpus."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, materialize, sized_shards
from ._words import K1, K3, SPACED, U, give_back, mix, pack, pieces, unpack, word_hashes
from .substring import _deal

#: Text that makes a batch. A batch's distinct words and word pairs are sent out once and their counts come back.
GATHER = 8 << 20
#: Text for each key range: packed, its words and pairs take about 1.5 times as much.
RANGE = 8 << 20
START, END = (mix(np.array([x], U))[0] for x in (0x5354415254, 0x454E44))
BUCKETS, STEPS, LOWEST = 64, 4, -200
UNIGRAM, BIGRAM, TRIGRAM = 0, 1, 2


class Batch:
    """Documents as numbers of words in a vocabulary of the batch."""

    def __init__(self, blobs: list[bytes]):
        self.doc, held, size = unpack(blobs[0], np.int64, np.uint8, np.uint32)
        self.null, self.held = held >= 2, held % 2 == 1
        (self.vocabulary,) = unpack(blobs[1], U)
        (self.ids,) = unpack(blobs[2], np.int32, rising=False)
        self.first = np.concatenate([[0], np.cumsum(size.astype(np.int64))])

    @staticmethod
    def blobs(doc: np.ndarray, held: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes]:
        vocabulary, ids = np.unique(h, return_inverse=True)
        return [pack(doc, held.astype(np.uint8), size.astype(np.uint32)), pack(vocabulary), pack(ids.astype(np.int32), rising=False)]

    def pairs(self) -> np.ndarray:
        """The key of each token with the one before it."""
        h = self.vocabulary[self.ids]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.first[:-1]] = START
        return mix(mix(before * K3) + h)

    def runs(self, order: int) -> list[np.ndarray]:
        """The keys of all tokens' pairs with the one before and, for ``order`` 3, of their triples."""
        pairs = self.pairs()
        if order == 2:
            return [pairs]
        before = np.empty_like(pairs)
        before[1:] = pairs[:-1]
        before[self.first[:-1]] = START
        return [pairs, mix(mix(before * K1) + self.vocabulary[self.ids])]

    def weight(self) -> np.ndarray:
        """For each token whether it is learnt from."""
        return np.repeat((~self.held).astype(np.int64), np.diff(self.first))


def _batches(docs: DataFrame, held: Column, dev: Column) -> DataFrame:
    """(batch, dev, docs, vocabulary, ids): documents that weigh the parts are in batches of their own."""

    def run(parts):
        kept: dict[bool, list] = {True: [], False: []}

        def row(dev):
            h, size, doc, flag = (np.concatenate(x) for x in zip(*kept[dev], strict=True))
            kept[dev] = []
            blobs = Batch.blobs(doc, flag, h, size)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([dev]), *(pa.array([x], pa.binary()) for x in blobs)], names=["batch", "dev", "docs", "vocabulary", "ids"])

        for b in pieces(parts, "text"):
            all_dev = b.column("dev").to_numpy(zero_copy_only=False)
            for dev in (True, False):
                c = b.filter(pa.array(all_dev == dev))
                if not c.num_rows:
                    continue
                h, first = word_hashes(c.column("text"), SPACED, True)
                size = np.diff(first) + 1
                out = np.full(len(h) + c.num_rows, END, U)
                out[np.arange(len(h)) + np.repeat(np.arange(c.num_rows), size - 1)] = h
                flag = c.column("held").to_numpy(zero_copy_only=False).astype(np.int64) + 2 * c.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                kept[dev].append((out, size, c.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), flag))
                if sum(len(x[0]) for x in kept[dev]) * 6 >= GATHER:
                    yield row(dev)
        for dev in (True, False):
            if kept[dev]:
                yield row(dev)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"), (~held & dev).alias("dev"))
    return rows.mapInArrow(run, "batch long, dev boolean, docs binary, vocabulary binary, ids binary")


def _counted(batches: DataFrame, n: int, order: int) -> DataFrame:
    """(batch, kind, shard, blob, tokens, words): for each batch the corpus counts of its keys, in their order.

    The counts are of all documents learnt from, and of these less the ones that weigh the parts.
    """

    def run(rows):
        for b in rows:
            for r in b.to_pylist():
                x = Batch([r["docs"], r["vocabulary"], r["ids"]])
                w = x.weight()
                words = np.bincount(x.ids, w, len(x.vocabulary)).astype(np.uint32)
                found = [(UNIGRAM, mix(x.vocabulary), words)]
                for kind, runs in enumerate(x.runs(order), BIGRAM):
                    keys, at = np.unique(runs, return_inverse=True)
                    found.append((kind, keys, np.bincount(at, w, len(keys)).astype(np.uint32)))
                out = []
                for kind, keys, count in found:
                    by = np.argsort(keys)
                    keys, count = keys[by], count[by]
                    out += [(s, kind, r["batch"], r["dev"], pack(keys[p], count[p])) for s, p in _deal(keys, n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["shard", "kind", "batch", "dev", "blob"])
                give_back()

    def count(table: pa.Table) -> pa.Table:
        kind = table["kind"][0].as_py()
        got = [unpack(x, U, np.uint32) for x in table["blob"].to_pylist()]
        dev = table["dev"].to_pylist()
        keys, at = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
        every, less, i = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64), 0
        for (k, c), d in zip(got, dev, strict=True):  # keys are distinct within each
            every[at[i : i + len(k)]] += c
            if not d:
                less[at[i : i + len(k)]] += c
            i += len(k)
        blobs, i = [], 0
        for (k, _), d in zip(got, dev, strict=True):
            p = at[i : i + len(k)]
            blobs.append(pack(every[p], less[p], rising=False) if d else pack(every[p], rising=False))
            i += len(k)
        uni = kind == UNIGRAM
        tokens = [int(every.sum()) * uni, int(less.sum()) * uni, int((every > 0).sum()) * uni]
        rows = table.num_rows
        first = lambda v: pa.array([v] + [0] * (rows - 1), pa.int64())
        give_back()
        return pa.table({"batch": table["batch"], "kind": table["kind"], "shard": table["shard"], "blob": pa.array(blobs, pa.binary()), "tokens": first(tokens[0]), "rest": first(tokens[1]), "words": first(tokens[2])})

    dealt = batches.mapInArrow(run, "shard int, kind int, batch long, dev boolean, blob binary")
    return dealt.groupBy("kind", "shard").applyInArrow(count, "batch long, kind int, shard int, blob binary, tokens long, rest long, words long")


def _own_counts(left: pa.Table, right: pa.Table, less: bool, order: int):
    """A batch, and for each token how often it, its pair with the one before and its triple were seen."""
    r = left.to_pylist()[0]
    x = Batch([r["docs"], r["vocabulary"], r["ids"]])
    found = []
    rows = sorted(right.select(["kind", "shard", "blob"]).to_pylist(), key=lambda q: (q["kind"], q["shard"]))
    for kind in range(order):
        parts = [unpack(q["blob"], U, U, rising=False)[1] if less else unpack(q["blob"], U, rising=False)[0] for q in rows if q["kind"] == kind]
        found.append(np.concatenate(parts).astype(np.float64) if parts else np.zeros(0))
    words = np.empty(len(x.vocabulary))
    words[np.argsort(mix(x.vocabulary))] = found[0]
    return x, [words[x.ids], *(c[np.unique(k, return_inverse=True)[1]] for c, k in zip(found[1:], x.runs(order), strict=True))]


def _chances(x: Batch, seen: list[np.ndarray], documents: float, tokens: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each token the bucket of its contexts, and its chance by the longest run, the next one and so on."""
    before = [_before(x, c, documents) for c in seen[:-1]]
    bucket = _bucket(before[0])
    for k, c in enumerate(before[1:], 1):
        bucket = np.where(c > 0, BUCKETS * k + _bucket(c), bucket)
    chance = [seen[0] / max(tokens, 1), *(c / np.maximum(b, 1) for c, b in zip(seen[1:], before, strict=True))]
    return bucket, chance[::-1]


def _before(x: Batch, one: np.ndarray, documents: float) -> np.ndarray:
    """How often each token's context was seen: what ends with the word before, or the start of a document."""
    out = np.empty_like(one)
    out[1:] = one[:-1]
    out[x.first[:-1]] = documents
    return out


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(2 * np.log2(context + 1)), BUCKETS - 1).astype(np.int64)


def expectation_maximisation(cells: np.ndarray, floor: float, rounds: int = 60) -> np.ndarray:
    """Weights (longest run, ..., unigram, uniform) of each bucket of contexts from rows (bucket, log p of each but the uniform, times).

    The first ``BUCKETS`` are of contexts of one word, the next of two: those of one word give no weight to
    longer runs, and those that never occurred none to pairs.
    """
    order = cells.shape[1] - 2
    out = np.zeros((BUCKETS * (order - 1), order + 1))
    for k in range(len(out)):
        length = min(1 + k // BUCKETS, order - 1) + (k % BUCKETS > 0)  # the longest run there
        may = np.arange(order + 1) >= order - length
        out[k, -2:], out[k, order - length : -2] = (0.5, 0.1) if length > 1 else (0.9, 0.1), 0.4 / max(1, length - 1)
        own = cells[cells[:, 0] == k]
        if not len(own):
            continue
        p = np.stack([*(np.where(q <= LOWEST, 0.0, 2.0 ** (q / STEPS)) for q in own[:, 1:-1].T), np.full(len(own), floor)], 1)
        n = own[:, -1][:, None]
        for _ in range(rounds):
            share = out[k] * p
            share /= share.sum(1, keepdims=True)
            out[k] = ((share * n).sum(0) + 1e-3 * may) / (n.sum() + 1e-3 * may.sum())
    return out


def score(docs: DataFrame, held: Column, dev: Column, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``held`` marks rows that nothing is learnt from, ``dev`` those of the rest on which the parts' weights
    are learnt. Tokens are the words of the lower-cased (A-Z) text and one end. base_score is the add-one
    unigram log10 probability. score is log10 of the product of l2 c(v w)/c(v) + l1 c(w)/N + l0/(V+1), with
    weights by the size of c(v), learnt by expectation-maximisation on the ``dev`` rows against counts
    without them (probabilities rounded to quarter powers of two); then all learnt rows are counted. With an
    ``order`` of 3 there is l3 c(u v w)/c(u v) besides, and where u v was seen its count chooses the weights.

    No count is broadcast: each batch of about 8 MB of text sends the distinct words and pairs it holds,
    by key, meets the sums of all batches there, and gets its own back. Keys are 64-bit hashes. The number of
    key ranges follows the size of the texts, so that none outgrows a task.

    A null, empty or blank text is one end token. A null doc_id is kept as null. Rows repeat as they come and
    are counted each time. With nothing learnt from, N and V are 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = sized_shards(docs, "text", RANGE)
    batches = materialize(_batches(docs, held, dev))
    counted = materialize(_counted(batches, n, order))
    r = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "rest", "words")]).first()
    tokens, rest, words = r["tokens"], r["rest"], r["words"]
    tally = docs.agg(F.count_if(~held).alias("a"), F.count_if(~held & ~dev).alias("b")).first()
    counts = counted.select("batch", "kind", "shard", "blob")

    def cells(key, left: pa.Table, right: pa.Table) -> pa.Table:
        x, seen = _own_counts(left, right, True, order)
        code, chances = _chances(x, seen, float(tally["b"]), rest)
        for p in chances:
            log = np.where(p > 0, np.maximum(LOWEST + 1, np.round(STEPS * np.log2(np.maximum(p, 1e-300)))), LOWEST).astype(np.int64)
            code = (code << 8) | (log - LOWEST)
        code, times = np.unique(code, return_counts=True)
        give_back()
        return pa.table({"code": code, "n": times.astype(np.int64)})

    some = batches.where("dev")
    own = counts.join(some.select(F.col("batch").alias("k")), F.col("batch") == F.col("k"), "left_semi")
    found = some.groupBy("batch").cogroup(own.groupBy("batch")).applyInArrow(cells, "code long, n long")
    rows = found.groupBy("code").agg(F.sum("n").alias("n")).collect()  # buckets and rounded chances: their number doesn't grow with the rows
    code, times = np.array([(c["code"], c["n"]) for c in rows], np.int64).reshape(-1, 2).T
    table = np.stack([code >> 8 * order, *((code >> 8 * k & 255) + LOWEST for k in range(order - 1, -1, -1)), times], 1).astype(np.float64)
    mixture = expectation_maximisation(table, 1 / (words + 1))

    def apply(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if left["dev"][0].as_py():
            right = right.set_column(right.schema.get_field_index("blob"), "blob", pa.array([_first(b) for b in right["blob"].to_pylist()], pa.binary()))
        x, seen = _own_counts(left, right, False, order)
        bucket, chances = _chances(x, seen, float(tally["a"]), tokens)
        p, one = mixture[bucket, order] / (words + 1), seen[0]
        for k, chance in enumerate(chances):
            p += mixture[bucket, k] * chance
        total = lambda v: np.add.reduceat(v, x.first[:-1])
        size = np.diff(x.first)
        give_back()
        base = total(np.log10(one + 1)) - size * np.log10(tokens + words + 1)
        return pa.table(
            {"doc_id": pa.array(x.doc, mask=x.null), "held_out": pa.array(x.held), "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(total((one > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(len(size), tokens), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(total(np.log10(p)), pa.float64())}
        )

    return batches.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _first(blob: bytes) -> bytes:
    return pack(unpack(blob, U, U, rising=False)[0], rising=False)
