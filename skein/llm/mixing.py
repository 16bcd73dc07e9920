"""Mixing sources to target weights on a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], a piecewise-linear rate.
Its integral, scaled to the source's target, is the number of the source's words that are
due by time t. A document's place in its source's stream (passes over the source, one after
the other, in the order of a hash) is a number of words; inverting the integral there gives
the time at which the document is due. Range-sorting by that time gives the training order.

The places are prefix sums over a source. A source may hold a third of all rows, so the sum
is taken in two levels: the order is cut into buckets by leading hash bits, sums of buckets
are accumulated over the buckets of a source, and rows only inside their bucket. The number
of bits follows the number of rows, so a bucket of a source holds about ROWS_PER_BUCKET.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import text_or_empty, word_count, written

MAX_PASSES = 3
WEIGHTS = (1, 2, 3)
ROWS_PER_BUCKET = 1000

#: Rates over time by the weight's place in WEIGHTS: (time, rate) knots, each integrating to 1.
#: The least-weighted sources fade out, the middle ones are flat, the heaviest ones fade in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(skey, source_size, slot, target) from (skey, source_size), one row per source.

    Sources in code point order, null last, weigh weights in turn. Targets share the sum of
    all sizes by weight; a target stops at max_passes times its source's size and what is
    over is shared again. That is a common level per unit of weight: sources in the order of
    size over weight are capped until the level that the rest leaves is below the next cap.
    The windows run over one row per source, never over documents.
    """
    slot = ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights)).cast("int")
    scale = math.lcm(*weights)
    weigh = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("bigint") for v in values]), F.col("slot") + 1)
    rows = sizes.withColumn("slot", slot).withColumn("w", weigh(weights))
    rows = rows.withColumn("cap", F.col("source_size") * max_passes).withColumn("ratio", F.col("cap") * weigh([scale // w for w in weights]))
    order, whole = Window.orderBy("ratio", "skey"), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    rows = (
        rows.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), none))
        .withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), none))
        .withColumn("place", F.row_number().over(order))
    )
    # The first place whose cap is not below the level starts the uncapped ones.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    rows = rows.withColumn("cut", F.min(F.when(wide("cap") * wide("left_w") >= wide("left") * wide("w"), F.col("place"))).over(whole))
    at_cut = lambda c: F.max(F.when(F.col("place") == F.col("cut"), F.col(c))).over(whole)
    rows = rows.withColumn("lv", at_cut("left")).withColumn("lw", at_cut("left_w"))
    shared = (F.col("lv") * F.col("w")).cast("double") / F.col("lw").cast("double")
    return rows.select("skey", "source_size", "slot", F.when(F.col("place") < F.col("cut"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def integral(knots: tuple) -> list[tuple[float, float, float, float]]:
    """Segments (t0, t1, rate at t0, slope) with the area before each, scaled to a total of 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
        out.append((t0, r0 / area, (r1 - r0) / area / (t1 - t0), before))
        before += (t1 - t0) * (r0 + r1) / 2 / area
    return out


def inverse(share: Column, knots: tuple) -> Column:
    """Time by which the schedule has asked for share (0 to 1) of its words.

    On a segment the demand is before + r (t - t0) + s (t - t0)^2 / 2; the root is taken in
    the form that stays exact for a flat rate.
    """
    out = None
    for t0, rate, slope, before in reversed(integral(knots)):
        due = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(rate * rate) + due * (2 * slope), F.lit(0.0)))
        t = F.lit(t0) + due * 2 / (F.lit(rate) + root)
        out = t if out is None else F.when(share < F.lit(last), t).otherwise(out)
        last = before
    return F.least(out, F.lit(1.0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per row of docs (columns doc_id, text, source), range-sorted by training position.

    Returns doc_id, source, size (words of the text; null: 0), source_size, target (of its source),
    taken (words the mix takes, passes counted; the takes of a source add up to its target
    rounded down, so the document at the end of the stream may count in part), passes (how
    often it is met, the part counted as one), position (time in [0, 1] of its first
    meeting, null if never met) and positions (of every meeting).

    The order inside a source is by the MD5 of the id (null id as the empty string), then
    the id, then size: reruns agree, and equal rows are interchangeable. A null source is a
    source of its own. Empty texts take nothing. Empty input gives an empty table.
    """
    key = F.md5(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8"))
    # Orders as the source does, null last: no character is above the last code point.
    skey = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    # Written once: every sum below is over these few bytes a row, and texts are cut into words once.
    rows = written(docs.select("doc_id", "source", skey.alias("skey"), word_count(text_or_empty()).alias("size"), key.alias("key")), "sizes")
    per_source = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    bits = min(32, max(0, math.ceil(math.log2(max(1, rows.count()) / ROWS_PER_BUCKET))))
    lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("bucket", F.shiftright(lead, 32 - bits))

    # Buckets are accumulated in two steps as well: no window meets more than about the square root of them.
    buckets = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bsize")).withColumn("coarse", F.shiftright(F.col("bucket"), bits // 2))
    tops = buckets.groupBy("skey", "coarse").agg(F.sum("bsize").alias("csize"))
    tops = tops.select("skey", "coarse", (F.sum("csize").over(Window.partitionBy("skey").orderBy("coarse")) - F.col("csize")).alias("cbefore"))
    inner = F.sum("bsize").over(Window.partitionBy("skey", "coarse").orderBy("bucket")) - F.col("bsize")
    starts = buckets.withColumn("inner", inner).join(tops, ["skey", "coarse"]).join(source_targets(per_source, weights, max_passes), "skey")
    starts = starts.select("skey", "bucket", (F.col("inner") + F.col("cbefore")).alias("before"), "source_size", "slot", "target")

    in_bucket = Window.partitionBy("skey", "bucket").orderBy("key", F.col("doc_id").isNull(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(in_bucket)).join(starts, ["skey", "bucket"])
    rows = rows.withColumn("start", F.col("before") + F.col("upto") - F.col("size"))

    goal = F.floor("target").cast("bigint")
    takes = [F.least(F.greatest(goal - F.col("source_size") * e - F.col("start"), F.lit(0).cast("bigint")), F.col("size")) for e in range(max_passes)]
    place = [(F.col("start") + F.col("source_size") * e).cast("double") / goal.cast("double") for e in range(max_passes)]

    def time_of(e: int) -> Column:
        out = inverse(place[e], schedules[-1])
        for k, s in list(enumerate(schedules))[:-1]:
            out = F.when(F.col("slot") % len(schedules) == k, inverse(place[e], s)).otherwise(out)
        return out

    times = F.filter(F.array(*[F.when(t > 0, time_of(e)) for e, t in enumerate(takes)]), lambda x: x.isNotNull())
    out = rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        sum(takes[1:], takes[0]).alias("taken"),
        times.alias("positions"),
        # Rows that are never met follow, spread by their hash, so that no range holds them all.
        (F.lit(2.0) + F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("spread"),
    )
    out = out.withColumn("passes", F.size("positions")).withColumn("position", F.when(F.col("passes") > 0, F.col("positions")[0]))
    return out.orderBy(F.coalesce("position", "spread"), "doc_id").drop("spread")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix meets them: each row as often as it has passes, in training order.

    A document that the end of its source's stream cuts is met whole. Rows of one id are
    matched with the mix's rows of that id by source and size. Rows travel in a struct, so their columns may have any names.
    """
    key = ["id", "source", "size"]
    nth = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    met = mix(docs).select(F.col("doc_id").alias("id"), "source", "size", "positions", "taken").withColumn("n", nth(["taken", "positions"]))
    met = met.filter(F.size("positions") > 0).select(*[F.col(c).alias(f"met_{c}") for c in (*key, "n")], F.explode("positions").alias("at"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), "source", word_count(text_or_empty()).alias("size"))
    rows = rows.withColumn("n", nth(["row.text"]))
    same = F.col("id").eqNullSafe(F.col("met_id")) & F.col("source").eqNullSafe(F.col("met_source")) & (F.col("size") == F.col("met_size")) & (F.col("n") == F.col("met_n"))
    return rows.join(met, same).orderBy("at", "id").select("row.*")
