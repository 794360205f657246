"""Mixing sources to target weights by proportionate-fair scheduling, with DataFrame operations only."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import shared_folder

OUTPUT = ("mix_slot", "mix_position", "mix_deadline", "in_target")
#: Of the generator that scrambles ids.
MODULUS, MULTIPLIER, ADDEND = 1 << 31, 1_103_515_245, 12_345
#: More sources than this are an error: the driver holds their counts and the schedule of a period.
MOST_SOURCES = 10_000
#: Blocks of a schedule that the driver holds at once, and in all; the largest deadline (64 bits).
AT_ONCE, MOST_BLOCKS, LATEST = 1 << 17, 1 << 24, (1 << 63) - 1


def whole_shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Blocks of each source in a period: by largest remainder, one at least, adding up to ``period``."""
    if not weights:
        return {}
    if len(weights) > period or min(weights.values()) <= 0:
        raise ValueError("there must be no more sources than slots in a period, and weights above 0")
    total, spare = sum(weights.values()), period - len(weights)
    exact = {k: v / total * spare for k, v in weights.items()}
    out = {k: 1 + int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))[: period - sum(out.values())]:
        out[k] += 1
    return out


def schedule(shares: Mapping[str, int]) -> list[tuple[str, int, int, int]]:
    """(source, number of its block, slot, deadline) for one period, earliest deadline first.

    Block j of a source with k of the P slots is released at floor((j-1)P/k) and due by ceil(jP/k).
    As the shares add up to P, each is placed within its window, so at any time a source is less than
    one block away from its weight.
    """
    period = sum(shares.values())
    ready: list = []
    coming = [(0, -(-period // k), s, 1) for s, k in sorted(shares.items())]
    heapq.heapify(coming)
    out = []
    for slot in range(period):
        while coming and coming[0][0] <= slot:
            release, due, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (due, s, j))
            if j < shares[s]:
                heapq.heappush(coming, (j * period // shares[s], -(-(j + 1) * period // shares[s]), s, j + 1))
        due, s, j = heapq.heappop(ready)
        out.append((s, j, slot, due))
    return out


def whole_run(weights: Mapping[str, float], rows: Mapping[str, int], block: int) -> Iterator[tuple[str, int, int, int, bool]]:
    """(source, number of its block, slot, deadline, whether all sources last) for every block, earliest deadline first.

    Block j of a source of target weight w, a fraction of all weights, is released at floor((j-1)/w) and
    due by ceil(j/w); weights count as they are, without rounding. As long as all sources last, each block
    is placed within its window, so at any time a source is less than one block away from its target.
    When a source is used up the others follow each other without gaps.
    """
    if any(not 0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be above 0 and finite")
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    per = {s: (total / w).as_integer_ratio() for s, w in exact.items()}
    last = {s: -(-rows[s] // block) for s in weights}
    ready: list = []
    coming = [(0, -(-per[s][0] // per[s][1]), s, 1) for s in sorted(weights)]
    heapq.heapify(coming)
    slot, now, lasting = 0, 0, True
    while coming or ready:
        if not ready:
            now = max(now, coming[0][0])
        while coming and coming[0][0] <= now:
            _, due, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        lasting = lasting and j <= rows[s] // block
        if j > last[s]:
            continue
        a, b = per[s]
        heapq.heappush(coming, (j * a // b, -(-(j + 1) * a // b), s, j + 1))
        yield s, j, slot, min(due, LATEST), lasting
        slot, now = slot + 1, now + 1


def _inline(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """Rows of the driver as a constant of the plan, which executors turn into rows by themselves."""
    names = [x.split()[0] for x in kind.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    shape = ", ".join(":".join(x.split()) for x in kind.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{shape}>>")))


def _written(spark: SparkSession, plan: Iterator, places: Mapping[str, int]) -> tuple[DataFrame, int]:
    """``plan`` as a table in the shared folder, and how many of its slots are within the target."""
    path, horizon = f"{shared_folder(spark)}/{uuid.uuid4().hex}", 0
    kind = "q_s int, q_j long, q_slot long, q_due long"
    while True:
        part = list(islice(plan, AT_ONCE))
        horizon += sum(x[4] for x in part)
        _inline(spark, [(places[x[0]], *x[1:4]) for x in part], kind).write.mode("append").parquet(path)
        if len(part) < AT_ONCE:
            return spark.read.schema(kind).parquet(path), horizon


def _with_slots(before: DataFrame, places: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """b_s, b_range, before, slots: for each range of a source, the slots and deadlines of the blocks that it has rows of."""
    last = F.floor((F.col("before") + F.col("n") - 1) / block)
    blocks = before.join(F.broadcast(places), F.col("b_s") == F.col("r_s")).select("b_s", "b_range", "before", "r_i", F.explode(F.sequence(F.floor(F.col("before") / block) + 1, last + 1)).alias("j"))
    found = blocks.join(plan, (F.col("r_i") == F.col("q_s")) & (F.col("j") == F.col("q_j")))
    return found.groupBy("b_s", "b_range").agg(F.first("before").alias("before"), F.sort_array(F.collect_list(F.struct("q_j", "q_slot", "q_due"))).alias("slots"))


def _named(source):
    return F.coalesce(source.cast("string"), F.lit("\0none"))


def _scrambled(docs: DataFrame):
    """A row's place in the order of reading: 31 bits, made of doc_id by arithmetic that any SQL engine has.

    Without a doc_id it is made of a hash of the row, so that many such rows aren't in one place.
    """
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if not any(k in kind for k in ("map<", "variant"))]
    x = F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(*hashed)), F.lit(MODULUS))
    x = (x * MULTIPLIER + ADDEND) % MODULUS
    x = x.bitwiseXOR(F.shiftright(x, 16))
    return (x * MULTIPLIER + ADDEND) % MODULUS


def _range(key):
    """One of 4096 ranges of places: each is ranked on its own, so no source meets in one task."""
    return F.shiftright(key, 19).cast("int")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, period: int | None = None, block: int = 8) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, ...) with its place in the mixture.

    A block is ``block`` rows of a source (without a ``period``, more where there would be over 2^24 blocks, as
    the driver makes their schedule), in a scrambled order of doc_id. ``weights`` maps sources to
    target weights; sources that it lacks, or all if it is None, weigh (their rows) ** ``power``. Columns
    added: mix_slot, the block's slot; mix_position, unique and ascending through the mixture;
    mix_deadline, by which the slot had to come; in_target, whether all sources last up to this slot, so
    that the weights hold to less than one block. Rows after that point are kept too.

    With a ``period`` the weights are rounded to that many slots (or twice the number of sources, if that is
    more), one of them at least for each source, and one schedule is repeated: the deviation from the target
    weights then grows with the number of slots.

    A null source is a source of its own; rows of a repeated doc_id take neighbouring places in any order,
    those without one places by a hash of the row; an empty table stays empty; columns of ``docs`` named as the added ones are replaced.
    The schedule of a whole run is made by the driver, ``AT_ONCE`` blocks at a time, and written to the
    shared folder, from which each range of a source gets the slots of its own blocks: the rows themselves move
    once. That of a period (``period`` rows) is broadcast.
    """
    spark = docs.sparkSession
    docs = docs.drop(*OUTPUT)
    names = docs.columns
    counts = docs.groupBy(_named(F.col("source")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    rows = {r["s"]: r["n"] for r in counts.limit(MOST_SOURCES + 1).collect()}
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"there are more than {MOST_SOURCES} sources")
    given = {k if k is not None else "\0none": v for k, v in (weights or {}).items()}
    targets = {s: given.get(s, float(n) ** power) for s, n in rows.items()}
    places = {s: i for i, s in enumerate(sorted(rows))}
    if period is None:
        block = max(block, -(-sum(rows.values()) // MOST_BLOCKS))
        table = None
        written, horizon = _written(spark, whole_run(targets, rows, block), places)
    else:
        period = max(period, 2 * len(rows))
        cycles = whole_shares(targets, period)
        plan = schedule(cycles)
        slots: dict[tuple[str, int], int] = {(s, j): slot for s, j, slot, _ in plan}
        # The first slot whose block its source can't fill.
        ends = [divmod(n // block, cycles[s]) for s, n in rows.items()]
        horizon = min((q * period + slots[s, r + 1] for (q, r), s in zip(ends, rows, strict=True)), default=0)
        table = F.broadcast(_inline(spark, [(places[s], j, slot, due) for s, j, slot, due in plan], "q_s int, q_j long, q_slot long, q_due long"))

    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        _named(F.col("source")).alias("s"),
        _scrambled(docs).alias("key"),
        _range(_scrambled(docs)).alias("range"),
        F.col("doc_id").alias("tie"),
    )
    before = (
        docs.select(_named(F.col("source")).alias("b_s"), _range(_scrambled(docs)).alias("b_range"))
        .groupBy("b_s", "b_range")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("b_s", "b_range", (F.sum("n").over(Window.partitionBy("b_s").orderBy("b_range")) - F.col("n")).alias("before"), "n")
    )
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("s", "range").orderBy("key", "tie")))
    if table is None:
        before = _with_slots(before, _inline(spark, [(s, i) for s, i in places.items()], "r_s string, r_i int"), written, block)
    here = (F.col("s") == F.col("b_s")) & (F.col("range") == F.col("b_range"))  # as the window is dealt out: no row moves again
    rank = F.col("before") + F.col("r") - 1
    ranked = ranked.join(before, here).withColumn("rank", rank).withColumn("number", F.floor(F.col("rank") / block))
    if table is None:
        own = F.get("slots", (F.col("number") - F.floor(F.col("before") / block)).cast("int"))
        placed = ranked.select("row", "rank", own.getField("q_slot").alias("slot"), own.getField("q_due").alias("due"))
    else:
        sizes = _inline(spark, [(s, places[s], k) for s, k in cycles.items()], "r_s string, r_i int, r_k long")
        ranked = ranked.select("row", "s", "rank", "number").join(F.broadcast(sizes), F.col("s") == F.col("r_s"))
        ranked = ranked.withColumns({"cycle": F.floor(F.col("number") / F.col("r_k")), "j": F.col("number") % F.col("r_k") + 1})
        placed = ranked.join(table, (F.col("r_i") == F.col("q_s")) & (F.col("j") == F.col("q_j")))
        placed = placed.select("row", "rank", (F.col("cycle") * period + F.col("q_slot")).alias("slot"), (F.col("cycle") * period + F.col("q_due")).alias("due"))
    slot = F.col("slot").cast("long")
    return placed.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        slot.alias("mix_slot"),
        (slot * block + F.col("rank") % block).cast("long").alias("mix_position"),
        F.col("due").cast("long").alias("mix_deadline"),
        (slot < F.lit(horizon)).alias("in_target"),
    )
