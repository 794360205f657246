"""Token counts by dictionary: the corpus' distinct pre-tokens are cut into pieces, counts are joined to frequencies and summed."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, materialize, sized_shards, spread
from ._words import LOWER, SPACED, U, flat, give_back, hashes, pack, pieces, unpack, words
from .substring import _deal

#: Text whose pre-tokens are dealt out together, and packed bytes that a task joins and sums at once.
GATHER, TASK = 8 << 20, 4 << 20
#: Key ranges at most; beyond, ranges are split by batch, and a pre-token is cut once for each split.
MOST_SHARDS = 4096
_SPACE, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[~SPACED] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[0xC3] = _KIND[0x80:0xC0] = _LETTER
#: Bytes that leave a run of non-blanks whole: controls, the apostrophe, all non-ASCII but Latin-1 letters.
_ODD = np.ones(256, bool)
_ODD[0x20:0x7F] = _ODD[9:14] = False
_ODD[0x27] = True


def pre_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start and length of each pre-token, and for each text (plus one) the index of its first.

    A run without ASCII white space is one pre-token, or, if it holds but ASCII and Latin-1 letters, no
    apostrophe and no ``<|``, its runs of letters, its single digits and its runs of other signs, letters
    A-Z in lower case. The tokenizer cuts at all these places whatever stands beside them.
    """
    starts, lens, _ = words(data, off, SPACED)
    odd = _ODD[data]
    pair = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    odd[:-1] &= ~pair
    odd[1:] &= ~pair
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    seen = np.concatenate([[0], np.cumsum(odd)])
    whole = seen[starts + lens] > seen[starts]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[whole]] += 1
    edge[starts[whole] + lens[whole]] -= 1
    kind = np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, np.uint8(_WHOLE), _KIND[data])
    new = np.ones(len(data) + 1, bool)  # whether something else begins at a byte
    new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    new[off] = True
    cut = np.flatnonzero(new)
    start, length = cut[:-1], np.diff(cut)
    some = kind[start] != _SPACE
    start, length = start[some], length[some]
    return np.where(kind == _WHOLE, data, LOWER[data]), start, length, np.searchsorted(start, off)


def _spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> bytes:
    """The spans' bytes, one after the other."""
    at = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    return data[at].tobytes()


def _dealt(docs: DataFrame, n: int) -> DataFrame:
    """(batch, shard, blob): a batch's distinct pre-tokens of a key range with their documents and frequencies.

    Shard -1 holds the batch's documents.
    """

    def rows(kept):
        data = np.concatenate([x[0] for x in kept])
        base = np.cumsum([0, *(len(x[0]) for x in kept)])
        start = np.concatenate([x[1] + b for x, b in zip(kept, base, strict=False)])
        length = np.concatenate([x[2] for x in kept])
        counts = np.concatenate([np.diff(x[3]) for x in kept])
        doc = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
        key = hashes(data, start, length)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([at, [len(key)]])).astype(np.uint32)
        first = np.flatnonzero(np.concatenate([[True], key[at][1:] != key[at][:-1]])) if len(at) else at
        many = np.diff(np.concatenate([first, [len(at)]])).astype(np.uint32)
        own, size = order[at[first]], length[order[at[first]]]
        batch = uuid.uuid4().int >> 65
        ids = pa.concat_arrays([x[4] for x in kept])
        bytes_ = np.concatenate([x[5] for x in kept])
        out = [(batch, -1, [pack(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), bytes_), b"", b""])]
        pair = np.concatenate([first, [len(at)]])
        for s, r in _deal(key[at[first]], n):
            p = slice(int(pair[r.start]), int(pair[r.stop]))
            text = zstandard.ZstdCompressor(level=1).compress(_spans(data, start[own[r]], size[r]))
            out.append((batch, s, [pack(size[r].astype(np.uint32), many[r]), text, pack(doc[at[p]], times[p])]))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.binary()))], names=["batch", "shard", "blobs"])

    def run(batches):
        kept, size = [], 0
        for b in pieces(batches, "text", GATHER // 4):
            data, off = flat(b.column("text"))
            kept.append((*pre_tokens(data, off), b.column("doc_id").cast(pa.int64()), np.diff(off)))
            size += len(data)
            if size >= GATHER or sum(len(x[5]) for x in kept) >= 50_000:
                yield rows(kept)
                kept, size = [], 0
        if kept:
            yield rows(kept)

    return docs.select("doc_id", "text").mapInArrow(run, "batch long, shard int, blobs array<binary>")


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    Pre-tokens are those of :func:`pre_tokens`. A batch of about 8 MB of text sends its distinct ones to the
    tasks of their key ranges, each with its documents in the batch and its frequencies there. Such a task
    asks the library once for each distinct pre-token, joins the numbers of pieces to the frequencies
    and returns sums for the documents, which are added up by batch. Ids are never laid out. The number of
    key ranges follows the size of the texts; ranges with much (a very common word is in every document) are
    split by batch. Within a batch, pre-tokens are told apart by 64-bit hashes, beyond it by their bytes.

    A null text counts as empty (0 bytes, 0 tokens); rows repeat as they come, null doc_id included;
    an empty table gives an empty result; further columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    dealt = materialize(_dealt(docs, sized_shards(docs, "text", 4 * TASK, most=MOST_SHARDS)))

    def summed(table: pa.Table) -> pa.Table:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(shared.value)
        tok.no_padding()
        tok.no_truncation()
        number: dict[bytes, int] = {}
        of, rows = [], []
        for batch, (head, text, pairs) in zip(table["batch"].to_pylist(), table["blobs"].to_pylist(), strict=True):
            size, many = unpack(head, np.uint32, np.uint32)
            raw = zstandard.ZstdDecompressor().decompress(text)
            end = np.cumsum(size).tolist()
            of.append(np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *end], end, strict=False)), np.int64, len(end)))
            rows.append((batch, many, *unpack(pairs, np.uint32, np.uint32)))
        distinct, n = list(number), np.zeros(len(number), np.int64)
        for i in range(0, len(distinct), 10_000):
            part = [w.decode("utf-8", "replace") for w in distinct[i : i + 10_000]]
            found = tok.encode(part, is_pretokenized=True, add_special_tokens=False).word_ids
            n[i : i + len(part)] = np.bincount(np.array(found, np.int64), minlength=len(part))
        out: tuple[list, list] = ([], [])
        for k, (batch, many, doc, times) in zip(of, rows, strict=True):
            total = np.bincount(doc, np.repeat(n[k], many) * times.astype(np.int64)).astype(np.uint64)
            at = np.flatnonzero(total)
            out[0].append(batch)
            out[1].append([pack(at.astype(np.uint32), total[at])])
        give_back()
        return pa.table({"batch": pa.array(out[0], pa.int64()), "shard": pa.array(np.zeros(len(out[0]), np.int32)), "blobs": pa.array(out[1], pa.list_(pa.binary()))})

    load = F.aggregate("blobs", F.lit(0), lambda a, x: a + F.octet_length(x))
    words_ = dealt.where("shard >= 0")
    sums = spread(words_, "shard", load, F.col("batch"), TASK).groupBy("shard", "salt").applyInArrow(summed, "batch long, shard int, blobs array<binary>")

    def documents(table: pa.Table) -> pa.Table:
        own = table["shard"].to_numpy() < 0
        blobs = table["blobs"].to_pylist()
        ids, null, size = unpack(blobs[int(np.flatnonzero(own)[0])][0], np.int64, np.uint8, np.int64)
        n = np.zeros(len(ids), np.int64)
        for i in np.flatnonzero(~own).tolist():
            at, total = unpack(blobs[i][0], np.uint32, np.uint64)
            n[at] += total.astype(np.int64)
        return pa.table({"doc_id": pa.array(ids, mask=null > 0), "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    both = dealt.where("shard < 0").unionByName(sums)
    return both.groupBy("batch").applyInArrow(documents, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
