"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over the run, a piecewise linear function on [0, 1]. Its integral is the
source's cumulative token demand D(t); with D scaled to the source's target, the document copy whose tokens
begin at c of the source's stream is trained at the position t where D(t) = c. Documents (with copies) are
range-sorted by that position.

Targets: the sources share the sum of all sizes by weight; a target stops at ``max_repeats`` times the
source's size, and the excess is shared again by weight among the others until none is above.

A source's stream is its documents in the order of a hash, epoch after epoch. A copy is taken if its middle
lies below the target, so the words taken differ from the target by at most half a document.

Scale: prefix sums have two levels. Sums by (source, slot of the hash) are prefix-summed first; then documents within a
slot. There are as many slots as the root of the number of rows (LEAST_SLOTS at least), so either window holds
about that many rows. No window spans a source, so a source with a third of all rows is spread over its slots; the hash
is of id, source and text, so rows without an id are spread too.

Nulls: a null text has size 0; null is a source of its own, sorted last; null ids are documents too. Rows
that repeat count as often as they occur. Ties: documents of one hash are ordered by id, then by the text's hash; rows
equal in all of these are interchangeable. Documents of size 0 take nothing and are kept as rows. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.frames import BROADCAST_BYTES, saved

WORD = r"[^\x20\x09-\x0D]+"
LEAST_SLOTS = 1 << 12
MAX_REPEATS = 3
#: Weight of a source over the run, as (time, factor) knots from 0 to 1; factors have mean 1. Sources take them in turn.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))


def targets(sizes: dict, weights: dict, max_repeats: int = MAX_REPEATS) -> dict:
    """Target of each source: shares by weight, held to max_repeats times the size, the excess shared again."""
    left, out, free = float(sum(sizes.values())), {}, [s for s in sizes if weights[s] > 0]
    out = dict.fromkeys(sizes, 0.0)
    while free and left > 0:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > max_repeats * sizes[s]]
        if not over:
            for s in free:
                out[s] = left * weights[s] / total
            break
        for s in over:
            out[s] = float(max_repeats * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def position(share: Column, schedule: Column) -> Column:
    """t in [0, 1] where the schedule's integral reaches a share of its whole.

    schedule: array of (t0, t1, w0, w1, done): pieces between knots and the integral before each, scaled to end at 1.
    """
    piece = F.element_at(F.filter(schedule, lambda p: p["done"] <= share), -1)
    need, w0, span = share - piece["done"], piece["w0"], piece["t1"] - piece["t0"]
    slope = (piece["w1"] - piece["w0"]) / span
    root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * need, F.lit(0.0)))
    u = F.when((w0 + root) > 0, 2 * need / (w0 + root)).otherwise(F.lit(0.0))
    return F.least(piece["t0"] + F.least(u, span), F.lit(1.0))


def pieces(knots: tuple) -> list[tuple]:
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((t0, t1, w0 / whole, w1 / whole, done))
        done += (t1 - t0) * (w0 + w1) / 2 / whole
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, order: a hash that orders a source's documents, and ties of it by id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id"), F.col("source"), text).alias("order"), F.xxhash64(text).alias("th"),
    )


def plan(sizes: DataFrame, weights=(1.0, 2.0, 3.0), schedules=SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each source: source, source_size, target and its schedule. Each source has a weight in the mix, so
    their number is small; their sums are read by the driver."""
    spark = sizes.sparkSession
    found = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted((s for s in found if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in found)
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal = targets({s: found[s] for s in names}, weigh, max_repeats)
    rows = [(s, int(found[s]), float(goal[s]), pieces(schedules[i % len(schedules)])) for i, s in enumerate(names)]
    return spark.createDataFrame(rows, "source string, source_size long, target double, schedule array<struct<t0:double,t1:double,w0:double,w1:double,done:double>>")


def mix(docs: DataFrame, weights=(1.0, 2.0, 3.0), schedules=SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted) and positions (of
    each copy in [0, 1], in order), a row for each document."""
    sizes = saved(sized(docs))
    slot = F.pmod(F.col("order"), F.lit(max(LEAST_SLOTS, math.isqrt(sizes.count()))))
    by_slot = sizes.groupBy("source", slot.alias("slot")).agg(F.sum("size").alias("in_slot"))
    before = by_slot.select("source", "slot", (F.sum("in_slot").over(Window.partitionBy("source").orderBy("slot")) - F.col("in_slot")).alias("slot_start"))
    within = Window.partitionBy("source", "slot").orderBy("order", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("slot", slot).withColumn("in_front", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    placed = placed.join(before, same(placed, before, "source", "slot"), "left").select(placed["*"], (F.col("in_front") + F.col("slot_start")).alias("at"))
    of = plan(sizes, weights, schedules, max_repeats)
    few = of.count() * 1024 <= BROADCAST_BYTES  # a row is a name, three numbers and a few knots
    out = placed.join(F.broadcast(of) if few else of.hint("shuffle_merge"), same(placed, of, "source"), "left").select(placed["*"], of["source_size"], of["target"], of["schedule"])
    begins = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: (e * F.col("source_size") + F.col("at")).cast("double"))
    taken = F.filter(begins, lambda b: (F.col("size") > 0) & (b + F.col("size") / 2 <= F.col("target")))
    out = out.withColumn("begins", taken)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (F.size("begins") * F.col("size")).cast("long").alias("taken"),
        F.transform("begins", lambda b: position(F.least(b / F.col("target"), F.lit(1.0)), F.col("schedule"))).alias("positions"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """mixed with ``position``, the first of each document, range-sorted by it (ties by id); documents that take nothing come first."""
    out = mixed.withColumn("position", F.try_element_at("positions", F.lit(1)))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def sequence(mixed: DataFrame) -> DataFrame:
    """A row for each copy, range-sorted by training position (ties by id): what a trainer reads in order."""
    copies = mixed.select("doc_id", "source", "size", F.posexplode("positions").alias("copy", "position"))
    return copies.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")
