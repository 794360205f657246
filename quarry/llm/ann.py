"""Nearest neighbours by inner product: cross-polytope hashing with several probes, then exact scores."""

from __future__ import annotations

from itertools import pairwise
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import bounded_batches, join_split, materialize
from ._words import U, mix

#: Vectors and queries that one task takes together, and queries of a matrix product.
CELL_ROWS, CELL_QUERIES, AT_ONCE = 65_536, 8_192, 256
#: Entries for each cell; cells for each query and table at most.
CELL, MOST_PROBES = 4, 65_536


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-random rotation of rows: for each row of ``signs`` flip signs, then a fast Hadamard transform."""
    x = np.concatenate([x, np.zeros((len(x), signs.shape[1] - x.shape[1]))], 1)
    for s in signs:
        x = x * s
        h = 1
        while h < x.shape[1]:
            v = x.reshape(len(x), -1, 2, h)
            x = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], 2).reshape(len(x), -1)
            h *= 2
        x = x / np.sqrt(x.shape[1])
    return x


class Hashing:
    """Cells of unit vectors: in each table, the nearest signed axis after each of some pseudo-random rotations.

    All rotations but the last take all axes; the last as many (a power of two) as give about one cell for
    every ``CELL`` entries, so that the number of cells grows with the rows.
    """

    def __init__(self, width: int, entries: int, tables: int, seed: int):
        self.sides, cells = [], max(1, entries // CELL)
        while cells > 2 * width and len(self.sides) < 5:
            self.sides.append(2 * width)
            cells //= 2 * width
        self.sides.append(min(2 * width, max(2, 1 << cells.bit_length())))
        self.cells = prod(self.sides)
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, len(self.sides), 3, width))

    def nearness(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each rotation, each row's inner product with each signed axis; 2i is axis i, 2i+1 its opposite."""
        out = []
        for signs, side in zip(self.signs[table], self.sides, strict=True):
            y = rotate(x, signs)[:, : side // 2]
            out.append(np.stack([y, -y], 2).reshape(len(y), -1))
        return out

    def cell(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for y in self.nearness(x, table):
            out = out * y.shape[1] + y.argmax(1)
        return out

    def combinations(self, probes: int) -> np.ndarray:
        """Places in the orders of the axes that can be among the ``probes`` best: at most so many are better in all."""
        out = np.zeros((1, 0), np.int64)
        for side in self.sides:
            used = (out + 1).prod(1)
            many = np.minimum(side, np.maximum(1, probes // used))
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out = np.concatenate([np.repeat(out, many, 0), at[:, None]], 1)
        return out

    def nearest(self, x: np.ndarray, table: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's ``probes`` cells of the greatest sum of inner products, and these sums."""
        probes = min(probes, self.cells)
        places = self.combinations(probes)
        cells, sums = np.empty((len(x), probes), np.int64), np.empty((len(x), probes))
        for i in range(0, len(x), step := max(1, (1 << 22) // len(places))):
            code, total = 0, 0.0
            for y, p in zip(self.nearness(x[i : i + step], table), places.T, strict=True):
                order = np.argsort(-y, 1, kind="stable")
                code = code * y.shape[1] + order[:, p]
                total = total + np.take_along_axis(y, order, 1)[:, p]
            best = np.argpartition(-total, probes - 1, 1)[:, :probes]
            cells[i : i + step], sums[i : i + step] = np.take_along_axis(code, best, 1), np.take_along_axis(total, best, 1)
        return cells, sums

    def at(self, x: np.ndarray, table: int, cell: np.ndarray) -> np.ndarray:
        """Each row's sum of inner products with the axes of a cell."""
        total, row = 0.0, np.arange(len(x))
        for y, below in zip(self.nearness(x, table), [prod(self.sides[k + 1 :]) for k in range(len(self.sides))], strict=True):
            total = total + y[row, cell // below % y.shape[1]]
        return total


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array<double>): vectors without null or non-finite components and not zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    big = F.lit(float("inf"))
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: F.coalesce(F.abs(x) < big, F.lit(False)))
    return v.where(ok & F.exists("vec", lambda x: x != 0))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """(query number, entry number) of each query's best ``k`` entries by exact score, then smaller id, and the scores."""
    out = ([], [], [])
    longest = np.linalg.norm(x, axis=1).max()
    for i in range(0, len(q), AT_ONCE):
        s = q[i : i + AT_ONCE] @ x.T
        # All that may be among the best, ties too: the products' rounding is less than the margin.
        least = np.partition(s, max(0, len(x) - k), 1)[:, max(0, len(x) - k)]
        margin = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(q[i : i + AT_ONCE], axis=1) * longest
        near = ~(s < (least - margin)[:, None])
        for j, at in enumerate(map(np.flatnonzero, near)):
            exact = (x[at] * q[i + j]).sum(1)  # the same whatever the tile
            order = np.lexsort((ids[at], -exact))[:k]
            out[0].append(np.full(len(order), i + j))
            out[1].append(at[order])
            out[2].append(exact[order])
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _short(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as 16-bit integers, and the length of each row's step."""
    step = np.abs(x).max(1) / 32767
    step[step == 0] = 1.0
    return np.rint(x / step[:, None]).astype("<i2"), step


def probes_for(hashing: Hashing, asked: np.ndarray, near: list[np.ndarray], recall: float) -> int | None:
    """Cells that a query has to visit in each table to meet ``recall`` of its nearest entries; None if the most aren't enough.

    ``asked`` holds queries, and ``near`` for each the unit vectors of its nearest entries.
    """
    owner = np.repeat(np.arange(len(asked)), [len(x) for x in near])
    if not len(owner):
        return 1
    entries = np.concatenate(near)
    most = min(MOST_PROBES, hashing.cells)
    rank = np.full(len(owner), most)
    for t in range(len(hashing.signs)):
        own = hashing.at(asked[owner], t, hashing.cell(entries, t))
        for i in range(len(asked)):
            mine = np.flatnonzero(owner == i)
            sums = np.sort(hashing.nearest(asked[i : i + 1], t, most)[1][0])
            rank[mine] = np.minimum(rank[mine], most - np.searchsorted(sums, own[mine] - 1e-12))
    rank.sort()
    need = int(rank[min(len(rank) - 1, ceil(recall * len(rank)) - 1)]) + 1
    return min(need, most) if need <= most or most == hashing.cells else None


def search(vectors: DataFrame, queries, k: int = 20, tables: int = 6, recall: float = 0.96, sample: int = 256, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row for which ``queries`` (a column) is true.

    Nearness is the inner product in double precision; ties go to the smaller vec_id; a query isn't its
    own neighbour. Vectors are parted by norm, half an octave to each part. In a part they are scaled by its
    largest norm and given one more component that makes them unit vectors, so that the largest inner
    product is the smallest angle. In each of ``tables`` tables a vector is in one cell of the part, by the
    nearest signed axes after some pseudo-random rotations; there are more cells the more rows there are.
    Every vector is indexed. A query visits the same number of nearest cells in every table and part: the
    least with which about ``sample`` queries, picked by a hash and scored against all entries, meet
    ``recall`` of their true neighbours.

    Cells are dealt out in blocks, a query once to each block with the cells it visits there. Vectors travel
    as 16-bit integers; whatever can be among the best by their rounding error is scored again on the
    original vectors. Blocks with many vectors or queries are split into tiles, each with some of either.

    A query that meets fewer than ``k`` rows so is scored against all entries, in tiles: it gets ``k`` rows,
    or all candidates if there are fewer. So are all queries where no number of cells reaches ``recall``.
    Equal vectors are one entry with its k+1 smallest ids, all that can be in a result.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of
    another length than most (ties: the longest). Rows that repeat a vec_id with different vectors are
    entries of their own; a query id then has the neighbours of all. A null vec_id takes no part.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    usable = _usable(vectors).where("vec_id is not null")
    sizes = usable.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 1
    usable = usable.where(F.size("vec") == d).withColumn("q", F.coalesce(queries(F.col("vec_id")), F.lit(False))).withColumn("key", F.xxhash64("vec"))
    same = Window.partitionBy("key", "vec").orderBy("vec_id")
    entries = usable.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    entries = entries.groupBy("key", "vec").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # Parts by norm: 4096 at most, as doubles go; unit vectors are in the middle of one.
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    octave = F.floor(2 * F.log2(F.greatest(F.least(norm, F.lit(1e300)), F.lit(1e-300))) + 0.5).cast("int")
    entries = materialize(entries.withColumn("part", octave))
    asked = materialize(usable.where("q").select(F.col("vec_id").alias("id"), "key", "vec").distinct())
    n = entries.count()
    largest = {r["part"]: r["m"] for r in entries.groupBy("part").agg(F.max(norm).alias("m")).collect()}
    parts = sorted(largest)
    hashing = Hashing(1 << d.bit_length(), n, tables, seed)  # holds d + 1
    blocks = max(16, -(-n * tables // CELL_ROWS))

    def unit(x: np.ndarray, part: np.ndarray | None) -> np.ndarray:
        x = x / (np.linalg.norm(x, axis=1) if part is None else np.array([largest[o] or 1.0 for o in part.tolist()]))[:, None]
        rest = np.zeros(len(x)) if part is None else np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        return np.concatenate([x, rest[:, None]], 1)

    # The queries that tell how many cells are needed, scored against all entries.
    rows = asked.orderBy(F.xxhash64("key", "id"), "id").limit(sample).collect()
    some = np.array([r["vec"] for r in rows], float).reshape(len(rows), d)

    def exact(batches):
        for b in batches:
            if b.num_rows and len(some):
                x = _matrix(b.column("vec"))
                i, j, score = _best(some, x, b.column("entry").to_numpy(), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(score), b.column("entry").take(pa.array(j)), b.column("part").take(pa.array(j)), b.column("vec").take(pa.array(j))], names=["i", "score", "entry", "part", "vec"])

    found = entries.select("entry", "part", "vec").mapInArrow(exact, "i long, score double, entry long, part int, vec array<double>")
    order = Window.partitionBy("i").orderBy(F.desc("score"), "entry")
    near: list[list] = [[] for _ in rows]
    for r in found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).collect():  # sample * (k + 1) rows
        if r["entry"] != rows[r["i"]]["id"] and len(near[r["i"]]) < k:
            near[r["i"]].append(r)
    near_units = [unit(np.array([r["vec"] for r in x]), np.array([r["part"] for r in x])) if x else np.zeros((0, d + 1)) for x in near]
    probes = probes_for(hashing, unit(some, None), near_units, recall) if rows else 1

    def cell_numbers(cells: np.ndarray, table: int, part: np.ndarray | int) -> np.ndarray:
        return (table * len(parts) + part) * hashing.cells + cells

    def block_of(number: np.ndarray) -> np.ndarray:
        return (mix((number // hashing.sides[-1]).astype(U)) % U(blocks)).astype(np.int32)

    def indexed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vec"))
            u, place = unit(x, b.column("part").to_numpy()), np.searchsorted(parts, b.column("part").to_numpy())
            short, step = _short(x)
            raw, ids = pa.array([v.tobytes() for v in short], pa.binary()), [b.column(c) for c in ("entry", "key")]
            for t in range(tables):
                number = cell_numbers(hashing.cell(u, t), t, place)
                yield pa.RecordBatch.from_arrays([pa.array(block_of(number)), *ids, raw, pa.array(step), pa.array(number)], names=["block", "id", "key", "short", "step", "cell"])

    def visiting(batches):
        for b in batches:
            x = _matrix(b.column("vec"))
            for i in range(0, b.num_rows, step_ := max(1, (1 << 22) // (probes * tables * len(parts)))):
                c = b.slice(i, step_)
                u, (short, step) = unit(x[i : i + step_], None), _short(x[i : i + step_])
                every = np.concatenate([cell_numbers(hashing.nearest(u, t, probes)[0], t, p) for t in range(tables) for p in range(len(parts))], 1)
                block = block_of(every)
                out: tuple[list, ...] = ([], [], [])
                for r in range(len(every)):
                    at = np.argsort(block[r], kind="stable")
                    bounds = np.flatnonzero(np.diff(block[r][at], prepend=-1, append=blocks))
                    for lo, hi in pairwise(bounds.tolist()):
                        out[0].append(r)
                        out[1].append(block[r][at[lo]])
                        out[2].append(np.sort(every[r][at[lo:hi]]))
                row = pa.array(out[0], pa.int32())
                raw = pa.array([v.tobytes() for v in short], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(out[1], pa.int32()), c.column("id").take(row), c.column("key").take(row), raw.take(row), pa.array(step).take(row), pa.array(out[2], pa.list_(pa.int64()))], names=["block", "id", "key", "short", "step", "cells"])

    entry_vectors = entries.select("entry", F.col("key").alias("entry_key"), F.col("vec").alias("entry_vec"))

    def ranked(found: DataFrame) -> DataFrame:
        """The final rows from (query_id, entry, entry_key, score)."""
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
        found = materialize(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"))
        named = entries.select(F.col("entry").alias("e"), F.col("key").alias("ek"), "ids")
        members = join_split(found, "entry", named, "e").where("entry_key = ek").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").distinct()
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def scanned(short: DataFrame) -> DataFrame:
        """All entries for each of some queries."""
        across, down = -(-n // CELL_ROWS) or 1, -(-short.count() // CELL_QUERIES) or 1
        tile = lambda c, m: F.pmod(F.xxhash64(c, "key"), F.lit(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = short.select("id", "vec", tile("id", down).alias("down"), every(across).alias("across"))
        right = entries.select("entry", "key", "vec", tile("entry", across).alias("across"), every(down).alias("down"))

        def best(key, left: pa.Table, right: pa.Table) -> pa.Table:
            i, j, score = (np.zeros(0, np.int64),) * 3
            if left.num_rows and right.num_rows:
                i, j, score = _best(_matrix(left["vec"].combine_chunks()), _matrix(right["vec"].combine_chunks()), right["entry"].to_numpy(), k + 1)
            return pa.table({"query_id": left["id"].take(pa.array(i)), "entry": right["entry"].take(pa.array(j)), "entry_key": right["key"].take(pa.array(j)), "score": pa.array(score.astype(float))})

        return ranked(left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(best, "query_id long, entry long, entry_key long, score double").distinct())

    if probes is None or not n:
        return scanned(asked)

    index = materialize(entries.select("entry", "key", "vec", "part").mapInArrow(indexed, "block int, id long, key long, short binary, step double, cell long"))
    visits = materialize(asked.mapInArrow(visiting, "block int, id long, key long, short binary, step double, cells array<long>"))
    count = lambda df, c: df.groupBy("block").agg(F.count(F.lit(1)).alias(c))
    tiles = count(index, "n").join(count(visits, "m"), "block").select("block", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("across"), F.ceil(F.col("m") / CELL_QUERIES).cast("int").alias("down"))
    tiles = F.broadcast(materialize(tiles))  # a row for each block

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "key"), F.col(own)).cast("int")
        return df.join(tiles, "block").select(*df.columns, mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    def met(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one tile, for each query the entries of its cells that can be among its best k+1."""
        out: tuple[list, ...] = ([], [], [])
        if left.num_rows and right.num_rows:
            vec = lambda t: np.frombuffer(b"".join(t["short"].to_pylist()), "<i2").reshape(t.num_rows, -1).astype(np.float32)
            q, x, qs, xs = vec(left), vec(right), left["step"].to_numpy(), right["step"].to_numpy()
            qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
            cells = left["cells"].combine_chunks()
            who, want = np.repeat(np.arange(len(q)), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()
            own = right["cell"].to_numpy()
            by, wanted = np.argsort(own, kind="stable"), np.argsort(want, kind="stable")
            own, want, who = own[by], want[wanted], who[wanted]
            both = np.intersect1d(own, want)
            a, z = np.searchsorted(own, both, "left"), np.searchsorted(own, both, "right")
            f, g = np.searchsorted(want, both, "left"), np.searchsorted(want, both, "right")
            found: tuple[list, ...] = ([], [], [])

            def cut() -> None:
                """Keep what can be among the best k+1 of each query, by scores in float and 16-bit steps."""
                i, j, s = (np.concatenate(o) for o in found)
                order = np.lexsort((-s, i))
                i, j, s = i[order], j[order], s[order]
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                size = np.diff(np.concatenate([first, [len(i)]]))
                least = np.where(size > k + 1, s[np.minimum(first + k, len(s) - 1)], -np.inf)
                keep = s >= np.repeat(least, size) - np.repeat(slack[i[first]], size)
                for o, v in zip(found, (i, j, s), strict=True):
                    o[:] = [v[keep]]

            root = np.sqrt(x.shape[1])
            # Twice the most that a score can be off: the steps' rounding, and that of the product in single precision.
            reach = (xn * xs).max()
            slack = 2 * (qn * qs * root / 2 * xs.max() + (reach + root / 2 * xs.max()) * root / 2 * qs + 4 * root * root * np.finfo(np.float32).eps * qn * qs * reach)
            held = 0
            for m in range(len(both)):
                i, j = who[f[m] : g[m]], by[a[m] : z[m]]
                for lo in range(0, len(i), AT_ONCE):
                    p = i[lo : lo + AT_ONCE]
                    s = (q[p] @ x[j].T).astype(float) * qs[p][:, None] * xs[j][None, :]
                    if len(j) > k + 1:
                        least = np.partition(s, len(j) - k - 1, 1)[:, len(j) - k - 1] - slack[p]
                        r, c = np.nonzero(s >= least[:, None])
                    else:
                        r, c = np.divmod(np.arange(s.size), len(j))
                    for o, v in zip(found, (p[r], j[c], s[r, c]), strict=True):
                        o.append(v)
                    held += len(r)
                    if held > 4_000_000:
                        cut()
                        held = len(found[0][0])
            if held:
                cut()
                out = found
        i, j, s = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
        ids = lambda t, c, at: t[c].take(pa.array(at))
        off = slack[i] if len(i) else np.zeros(0)
        return pa.table({"query_id": ids(left, "id", i), "query_key": ids(left, "key", i), "entry": ids(right, "id", j), "entry_key": ids(right, "key", j), "about": pa.array(s.astype(float)), "slack": pa.array(off)})

    tile = ["block", "across", "down"]
    found = dealt(visits, "down", "across").groupBy(tile).cogroup(dealt(index, "across", "down").groupBy(tile)).applyInArrow(met, "query_id long, query_key long, entry long, entry_key long, about double, slack double")
    pair = ["query_id", "query_key", "entry", "entry_key"]
    found = found.groupBy(pair).agg(F.max("about").alias("about"), F.max("slack").alias("slack"))
    own = Window.partitionBy("query_id", "query_key")
    found = found.withColumn("r", F.row_number().over(own.orderBy(F.desc("about"))))
    least = F.max(F.when(F.col("r") == k + 1, F.col("about"))).over(own)
    found = found.withColumn("least", F.coalesce(least, F.lit(float("-inf")))).withColumn("off", F.max("slack").over(own))
    pairs = materialize(found.where("about >= least - off").select(*pair))
    exact_pairs = join_split(pairs, "entry", entry_vectors.select(F.col("entry").alias("e"), F.col("entry_key").alias("ek"), "entry_vec"), "e").where("entry_key = ek")
    exact_pairs = exact_pairs.join(asked.select(F.col("id").alias("query_id"), F.col("key").alias("query_key"), "vec"), ["query_id", "query_key"])

    def scored(batches):
        for b in batches:
            s = (_matrix(b.column("entry_vec")) * _matrix(b.column("vec"))).sum(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("query_id", "entry", "entry_key")), pa.array(s, pa.float64())], names=["query_id", "entry", "entry_key", "score"])

    exact_pairs = exact_pairs.select("query_id", "entry", "entry_key", "entry_vec", "vec").mapInArrow(scored, "query_id long, entry long, entry_key long, score double").distinct()
    result = materialize(ranked(exact_pairs))
    full = result.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = materialize(asked.join(full, "id", "left_anti"))
    if not short.count():
        return result
    return result.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(scanned(short))
