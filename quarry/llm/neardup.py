"""Near-duplicate documents by HyperMinHash: compressed registers are banded, estimated, then verified."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import bounded_batches, discard, id_filter, in_filter, join_split, materialize
from ._words import K1, SPACED, U, give_back, grams, mix, pieces, word_hashes
from .components import components

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
#: Documents in crowded buckets are compared by their TOP rarest shingles, long ones by finer sketches of 2 ** FINE registers.
FINE, TOP, SHORT, LONG = 9, 128, 1000, 800
#: Documents with a rare shingle that a task compares at once, and rows of a group.
TILE, GROUP = 4096, 10_000
#: Bytes of text that a task takes at once.
PIECE = 2 << 20
_SEEDS = mix(np.arange(1, (1 << FINE) + 1, dtype=U) * K1)
_BAND_SEEDS = mix(np.arange(1001, 1001 + BANDS, dtype=U) * K1)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of n words; fewer words make one shingle, none make none."""
    if not len(h):
        return h
    return np.unique(grams(h, min(n, len(h))))


def registers(u: np.ndarray, bits: int = 7) -> np.ndarray:
    """HyperMinHash registers of a non-empty set of hashes, as uint16.

    ``bits`` bits of a hash choose the bucket; the least of the others in a bucket is kept as its count of
    leading zeros (6 bits) and the 10 bits after the first one. An empty bucket takes the least hash of
    the whole set under its own seed, so that two sets agree in a bucket with the probability of their
    similarity whatever their sizes.
    """
    rest = U(64 - bits)
    k = np.sort((u << rest) | (u >> U(bits)))
    bucket = (k >> rest).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    low = np.zeros(1 << bits, U)
    low[bucket[first]] = k[first] & ((U(1) << rest) - U(1))
    empty = np.ones(1 << bits, bool)
    empty[bucket[first]] = False
    at = np.flatnonzero(empty)
    step = max(1, (1 << 18) // len(u))
    for i in range(0, len(at), step):
        e = at[i : i + step]
        low[e] = mix(u[None, :] ^ _SEEDS[e][:, None]).min(1) >> U(bits)
    fraction, exponent = np.frexp((low >> U(11 - bits)).astype(np.float64))
    mantissa = ((np.maximum(fraction, 0.5) * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return ((53 - exponent).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates for rows of registers, less the matches that compression makes by accident."""
    match = (a == b).mean(1)
    k = np.arange(54)[None, :]
    prob = [np.exp(-np.maximum(n, 1)[:, None] / REGISTERS * 0.5 ** (k + 1)) - np.exp(-np.maximum(n, 1)[:, None] / REGISTERS * 0.5**k) for n in (na, nb)]
    accident = (prob[0] * prob[1]).sum(1) / (1 << MANTISSA)
    return (match - accident) / (1 - accident)


def _sketch(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for b in pieces(batches, "text", PIECE):
            h, first = word_hashes(b.column("text"), SPACED, True)
            size, fp, regs, bands = [], [], [], []
            for i in range(b.num_rows):
                u = shingles(h[first[i] : first[i + 1]], n)
                size.append(len(u))
                if not len(u):
                    fp.append(None)
                    regs.append(None)
                    bands.append(None)
                    continue
                fp.append(xxhash.xxh3_128_digest(u.tobytes()))
                r = registers(u)
                regs.append(r.tobytes())
                bands.append(mix(mix(r.view(U)) ^ _BAND_SEEDS).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(fp, pa.binary()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "fp", "regs", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, fp binary, regs binary, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(id, g, set, fine) of the documents among ``nodes`` (node): a bitmap of fixed size spares most others.

    g tells sets of one id apart; fine is a sketch of more registers, for large sets only.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(id_filter(nodes, "node"))

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(in_filter(bitmap.value, b.column("h").to_numpy(zero_copy_only=False))))
            for b in pieces(iter([b]), "text", PIECE):
                h, first = word_hashes(b.column("text"), SPACED, True)
                sets = [shingles(h[first[i] : first[i + 1]], n).view(np.int64) for i in range(b.num_rows)]
                g = [xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in sets]
                fine = [registers(x.view(U), FINE).tobytes() if len(x) > LONG else b"" for x in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(g, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(fine, pa.binary())], names=["id", "g", "set", "fine"])

    found = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    return found.mapInArrow(run, "id long, g long, set array<long>, fine binary").where(F.size("set") > 0).join(nodes, F.col("id") == F.col("node"), "left_semi")


def _linked(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, n: int, percent: int, made: list, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``sets``, if given, holds those of all in ``pairs``.

    ``pairs`` is a written table. A document in very many pairs is joined in several tasks.
    """
    slack = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)

    @F.pandas_udf("boolean")
    def likely(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS) for x in (ra, rb))
        return pd.Series(estimate(a, b, na.to_numpy(), nb.to_numpy()) >= slack)

    total = pairs.count()

    def attached(pairs: DataFrame, total: int, table: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
        """``pairs`` with the columns of ``table`` for both sides; hot sides are known by their number of pairs."""
        out = pairs
        for s in ("a", "b"):
            sizes = pairs.groupBy(F.col(s).alias("split_key")).agg(F.count(F.lit(1)).alias("split_n"))
            own = table.select(F.col(key).alias(f"k{s}"), *[F.col(c).alias(f"{x}{s}") for c, x in values.items()])
            out = join_split(out, s, own, f"k{s}", total=total, sizes=sizes).drop(f"k{s}")
        return out

    near = attached(pairs, total, sketches, "rep", {"n": "n", "regs": "r"})
    near = near.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & likely("ra", "rb", "na", "nb"))
    near = materialize(near.select("a", "b"), made)
    if sets is None:
        sets = materialize(_sets(docs, near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), n), made)
    both = attached(near, near.count(), sets, "id", {"set": "s"})
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def _rare_pairs(sets: DataFrame, labels: DataFrame, percent: int, made: list | None = None) -> DataFrame:
    """Candidates (a, b) of different components that share one of their rarest shingles.

    With shingles in the order of their frequency among ``sets``, the rarest ninth (for 80 percent) of the
    smaller set and the rarest fifth of the larger one have a member in common if the sets are similar
    enough. What a crowd of documents shares isn't among the rarest of those that have much of their own.
    Documents with a rare shingle in common are compared within a task (tiles of a crowd in several), which
    gives out only pairs that can be similar enough: for sets of up to 1000 by what their 128 rarest
    shingles have in common and all others could have, which misses none; for larger ones by sketches of 512
    registers, which lose a pair over the threshold only if its estimate is five standard errors too low.
    """
    total = sets.agg(F.coalesce(F.sum(F.size("set")), F.lit(0)).alias("n")).first()["n"]
    every = sets.select("id", "g", F.size("set").cast("long").alias("n"), F.explode("set").alias("t"))
    often = materialize(every.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1").withColumnRenamed("t", "ot"), made)
    own = Window.partitionBy("id", "g")
    # Shingles of one set only come first; they are counted, but meet nothing.
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("f", "t"))
    whole = F.expr(f"n - (({percent} * n + 99) div 100) + 1")
    short = F.expr(f"n - ((2 * {percent} * n + {99 + percent}) div {100 + percent}) + 1")
    known = join_split(every, "t", often, "ot", total, often.select(F.col("ot").alias("split_key"), F.col("f").alias("split_n"))).drop("ot")
    placed = known.withColumn("place", place).where((F.col("place") <= whole) | (F.col("place") <= TOP) & (F.col("n") <= SHORT))
    placed = materialize(placed.select("id", "g", "n", "t", "place"), made)
    tops = placed.where((F.col("place") <= TOP) & (F.col("n") <= SHORT)).groupBy("id", "g").agg(F.collect_list("t").alias("top"))
    rare = placed.where(F.col("place") <= whole).select("id", "g", "n", "t", (F.col("place") <= short).alias("first"))
    rare = materialize(rare.join(labels, F.col("id") == F.col("node")).drop("node"), made)
    crowds = rare.groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    crowds = crowds.select(F.col("t").alias("ct"), F.ceil(F.col("m") / TILE).cast("int").alias("parts"))
    known = sets.select("id", "g", "fine").join(tops, ["id", "g"], "left")
    rows = materialize(join_split(rare, "t", crowds, "ct").drop("ct").join(known, ["id", "g"]).drop("g"), made)
    groups = rows.count() // GROUP + 1
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    few, many = rows.where("parts = 1"), rows.where("parts > 1")
    zero = F.lit(0)
    dealt = few.select(F.pmod(F.xxhash64("t"), F.lit(groups)).alias("s"), zero.alias("i"), zero.alias("j"), zero.alias("side"), "t", "id", "n", "label", "first", "fine", "top")
    alone = (F.shiftright(F.xxhash64("t"), 20) + (1 << 45)).alias("s")
    dealt = dealt.unionByName(many.where("first").select(alone, mine.alias("i"), others.alias("j"), F.lit(1).alias("side"), "t", "id", "n", "label", "first", "fine", "top"))
    dealt = dealt.unionByName(many.select(alone, others.alias("i"), mine.alias("j"), F.lit(2).alias("side"), "t", "id", "n", "label", F.lit(False).alias("first"), "fine", "top"))
    least = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / (1 << FINE))

    def compare(table: pa.Table) -> pa.Table:
        t, ids, n, label, first, side = (table[c].to_numpy() for c in ("t", "id", "n", "label", "first", "side"))
        fine = table["fine"].to_pylist()
        sketch = np.cumsum([len(x) > 0 for x in fine]) - 1
        regs = np.frombuffer(b"".join(fine), np.uint16).reshape(-1, 1 << FINE)
        top = table["top"].combine_chunks()
        size = top.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        shingle = np.asarray(top.flatten()).view(U)
        start = np.concatenate([[0], np.cumsum(size)])
        held = np.sort(mix(shingle + mix(np.repeat(np.arange(len(size)), size).astype(U))))
        rest = np.where(n <= SHORT, np.maximum(0, n - TOP), n)

        def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Whether the rarest shingles of two sets leave room for enough in common."""
            m = size[x]
            at = np.repeat(start[x] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            key = mix(shingle[at] + mix(np.repeat(y, m).astype(U)))
            found = held[np.minimum(np.searchsorted(held, key), max(0, len(held) - 1))] == key if len(held) else np.zeros(len(key), bool)
            common = np.bincount(np.repeat(np.arange(len(x)), m)[found], minlength=len(x))
            most = common + np.maximum(rest[x], rest[y])
            return most * 100 >= percent * (n[x] + n[y] - most)

        small, large = np.flatnonzero(first), np.flatnonzero(side != 1)
        large = large[np.argsort(t[large], kind="stable")]
        lo, hi = np.searchsorted(t[large], t[small], "left"), np.searchsorted(t[large], t[small], "right")
        out = [np.zeros((2, 0), np.int64)]
        begin, end = 0, np.cumsum(hi - lo)
        while begin < len(small):  # at most 20,000 pairs, or one row's
            stop = max(begin + 1, int(np.searchsorted(end, (end[begin - 1] if begin else 0) + 20_000, "right")))
            m = (hi - lo)[begin:stop]
            x = np.repeat(small[begin:stop], m)
            y = large[np.repeat(lo[begin:stop] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())]
            ok = (label[x] != label[y]) & ((n[x] < n[y]) | (n[x] == n[y]) & (ids[x] < ids[y])) & (n[x] * 100 >= n[y] * percent)
            x, y = x[ok], y[ok]
            near = np.ones(len(x), bool)
            both = np.flatnonzero((n[x] <= SHORT) & (n[y] <= SHORT))
            near[both] = possible(x[both], y[both])
            both = np.flatnonzero((n[x] > LONG) & (n[y] > LONG))
            for k in range(0, len(both), 20_000):
                p = both[k : k + 20_000]
                near[p] &= (regs[sketch[x[p]]] == regs[sketch[y[p]]]).mean(1) >= least
            a, b = ids[x[near]], ids[y[near]]
            out.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))
            begin = stop
        a, b = np.unique(np.concatenate(out, 1), axis=1)
        give_back()
        return pa.table({"a": a, "b": b})

    found = dealt.groupBy("s", "i", "j").applyInArrow(compare, "a long, b long")
    return found.distinct()


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents whose sets of distinct ``words``-word shingles (lower-cased A-Z, split at ASCII white space)
    have a Jaccard similarity of ``percent`` or more are linked; component_id is the smallest doc_id
    reachable and kept marks it. Equal sets are one class, represented by the smallest doc_id. Two classes
    are candidates if one of 32 bands of four registers is equal: at a similarity of 0.8 a pair shares none
    with a probability of 5e-8. Candidates whose estimate isn't far below the threshold are verified on
    their full sets.

    A band's bucket isn't expanded into pairs: each class is compared with two of its buckets' centres, the
    members that meet most others. Classes whose buckets still hold several components then meet by their
    rarest shingles. Keys with very many rows are joined in several tasks.

    A null, empty or blank text has no shingles and is linked with nothing. Rows that share a doc_id count
    as linked. A null doc_id represents no class: such a row gets the component of its equal texts, or null
    if there are none with an id (and is then kept). Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    made: list[DataFrame] = []
    sketch = materialize(_sketch(docs, words))
    ids = sketch.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = materialize(
        sketch.where("fp is not null")
        .groupBy("fp")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
        .where("rep is not null"),
        made,
    )
    keys = classes.select("rep", F.explode("bands").alias("key"))
    buckets = materialize(keys.groupBy(F.col("key").alias("bucket")).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), made)
    shared = join_split(keys, "key", buckets, "bucket", classes.count() * BANDS, buckets.select(F.col("bucket").alias("split_key"), F.col("size").alias("split_n")))
    shared = materialize(shared.select("rep", "key", "size"), made)
    # How many others a class meets: an original meets more of its altered copies than these do each other.
    reach = shared.groupBy("rep").agg(F.sum("size").alias("reach"))
    members = materialize(shared.select("rep", "key").join(reach, "rep"), made)
    # Each class meets its buckets' centres: at most two, those that meet most others and fewest.
    centre = members.groupBy(F.col("key").alias("bucket")).agg(F.max(F.struct("reach", (-F.col("rep")).alias("o"))).alias("m"))
    near = join_split(members, "key", centre, "bucket").where("rep <> -m.o").select("rep", F.col("m.reach").alias("r"), (-F.col("m.o")).alias("o")).distinct()
    ordered = near.select(F.least("rep", "o").alias("a"), F.greatest("rep", "o").alias("b"), "rep", "r")
    star = ordered.groupBy("rep").agg(F.max(F.struct("r", "a", "b")).alias("p"), F.min(F.struct("r", "a", "b")).alias("q"))
    star = materialize(star.select(F.explode(F.array("p", "q")).alias("p")).select("p.a", "p.b").distinct(), made)
    links = materialize(_linked(star, classes, docs, words, percent, made), made)
    labels = components(links)
    state = members.join(labels, F.col("rep") == F.col("node"), "left").select("rep", "key", F.coalesce("label", "rep").alias("c"))
    state = materialize(state, made)
    # What the stars have left: buckets with several components.
    open_ = state.groupBy(F.col("key").alias("bucket")).agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("bucket")
    left = materialize(join_split(state, "key", open_, "bucket").groupBy(F.col("rep").alias("node")).agg(F.first("c").alias("label")), made)
    sets = materialize(_sets(docs, left.select("node"), words), made)
    cross = materialize(_rare_pairs(sets, left, percent, made).join(star, ["a", "b"], "left_anti"), made)
    links = links.unionByName(_linked(cross, classes, docs, words, percent, made, sets))
    labels = components(links)
    for table in made:
        discard(table)
    chosen = ids.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("label", "rep").alias("component"))
    some = join_split(sketch.where("fp is not null").select("doc_id", "n_shingles", "fp"), "fp", chosen, "f", how="left")
    none = sketch.where("fp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = some.select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionByName(none)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one document of each component (the least doc_id's row).

    Rows that repeat a doc_id are one document and stay or go together. Rows with a null doc_id stay.
    """
    inner = docs.toDF(*[f"own_{i}" for i in range(len(docs.columns))])
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    slim = inner.select(F.col(own["doc_id"]).alias("doc_id"), F.col(own["text"]).alias("text"))
    found = near_duplicates(slim, words, percent)
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias("gone")).distinct())
    out = inner.join(gone, F.col(own["doc_id"]) == F.col("gone"), "left_anti")
    return out.select(*[F.col(x).alias(c) for c, x in own.items()])
