"""Exact ranks and exact percentiles without gathering a group into one task.

A plain ``row_number`` over a category sends the whole category to one task. Here a group is cut
into pieces along its order first; pieces are counted, given their starting rank, and ranked on
their own. The result equals the plain window, row for row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions import draws
from qaloom.session import checkpoint, lookup

ROWS_PER_TASK = 200_000
RADIX_BITS = 12  # of a value's image that one round of percentiles settles
_LOWER_63 = (1 << 63) - 1
SKETCH = 10_000  # accuracy of quantile sketches: ranks are right to one in so many


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join on same-named keys where null matches null; key columns come from the left."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    test = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"__{k}"])
        test = same if test is None else test & same
    return left.join(renamed, test, how).drop(*[f"__{k}" for k in keys])


def _cut_positions(pieces: int) -> Column:
    return F.array(*[F.lit(i / pieces) for i in range(1, pieces)])


def _piece_of(value: Column, cuts: str) -> Column:
    return F.size(F.filter(F.col(cuts), lambda c: c < value)).cast("bigint")


def ranked(
    df: DataFrame,
    by: list[str],
    key: str,
    seed: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Adds ``rank`` (from 0) and ``group_size`` within ``by``.

    With a ``seed`` the order is by hash draw of the key, ties by key; without one it is by the
    key itself, which must then be numeric. ``key`` must be unique within its group.
    """
    by = by or ["__all"]
    rows = df.withColumn("__all", F.lit(0)) if by == ["__all"] else df
    value = F.col(key) if seed is None else draws.draw(seed, F.col(key))
    rows = rows.withColumn("__order", value)
    sizes = lookup(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("group_size")))
    largest = sizes.agg(F.max("group_size")).first()[0] or 0
    rows = join_on(rows, sizes, by)
    if largest <= rows_per_task:
        window = Window.partitionBy(*by).orderBy("__order", key)
        return rows.withColumn("rank", F.row_number().over(window) - 1).drop("__order", "__all")
    if seed is not None:
        pieces = F.ceil(F.col("group_size") / rows_per_task)
        rows = rows.withColumn("__piece", F.floor(F.col("__order") / F.lit(float(draws.SPAN)) * pieces))
    else:
        pieces = math.ceil(largest / rows_per_task)
        cuts = F.percentile_approx("__order", _cut_positions(pieces), F.lit(max(SKETCH, 10 * pieces)))
        table = lookup(rows.groupBy(*by).agg(cuts.alias("__cuts")), row_bytes=8 * pieces)
        rows = join_on(rows, table, by)
        rows = rows.withColumn("__piece", _piece_of(F.col("__order"), "__cuts")).drop("__cuts")
    before = (
        Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        rows.groupBy(*by, "__piece")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*by, "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    rows = join_on(rows, lookup(starts), [*by, "__piece"])
    window = Window.partitionBy(*by, "__piece").orderBy("__order", key)
    return rows.withColumn("rank", F.col("__start") + F.row_number().over(window) - 1).drop(
        "__order", "__piece", "__start", "__all"
    )


def rank_cuts(
    df: DataFrame,
    by: list[str],
    key: str,
    seed: str,
    positions: list[Callable[[Column], Column]],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Per group its size and, for each position, the (draw, key) of the row with that rank.

    Lets a caller tell on which side of a rank a row falls by comparing the row's own draw, with
    no rank computed and no row moved. Only draws and keys are shuffled here, and only those of
    the pieces that hold a wanted rank are ordered. A position past the last rank gives null.
    """
    rows = df.select(*by, F.struct(draws.draw(seed, F.col(key)).alias("d"), F.col(key).alias("k")).alias("at"))
    sizes = lookup(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("group_size")))
    pieces = F.ceil(F.col("group_size") / rows_per_task)
    placed = join_on(rows, sizes, by)
    placed = placed.withColumn("piece", F.floor(F.col("at.d") / F.lit(float(draws.SPAN)) * pieces))
    before = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[p(F.col("group_size")).cast("bigint") for p in positions])
    holders = (
        placed.groupBy(*by, "group_size", "piece")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("wanted", wanted)
        .where(F.exists("wanted", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n"))))
        .select(*by, "piece", "start", "wanted")
    )
    inside = join_on(placed.drop("group_size"), lookup(holders), [*by, "piece"])
    order = Window.partitionBy(*by, "piece").orderBy("at")
    numbered = inside.withColumn("rank", F.col("start") + F.row_number().over(order) - 1)
    found = numbered.where(F.array_contains("wanted", F.col("rank"))).groupBy(*by)
    cuts = [
        F.max(F.when(F.col("rank") == F.get("wanted", F.lit(i)), F.col("at"))).alias(f"cut{i}")
        for i in range(len(positions))
    ]
    return join_on(sizes, found.agg(*cuts), by, "left")


def _image(value: Column) -> Column:
    """The order of doubles as an order of longs: one number for -0 and 0, NaN above all."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_LOWER_63))).otherwise(bits)


def _of_image(image: Column) -> Column:
    bits = F.when(image < 0, image.bitwiseXOR(F.lit(_LOWER_63))).otherwise(image)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], bits: int = RADIX_BITS) -> DataFrame:
    """Exact linear-interpolation percentiles per group: one column per entry of ``shares``.

    Radix selection on the order-preserving 64-bit image of the values. A round counts, for each range that still holds a wanted
    rank, its up to 2^``bits`` buckets in one mergeable aggregate, and goes on with the bucket that holds the rank, narrowed to
    its least and largest value; a rank is found when these are equal. No values are ordered or gathered: what a task
    sees of a group are bucket counts, however large the group, and 64 / ``bits`` rounds find any rank.
    """
    keys = by or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(0))
    rows = checkpoint(rows.where(F.col(value).isNotNull()).select(*keys, _image(F.col(value).cast("double")).alias("__z")))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__z").alias("lo"), F.max("__z").alias("hi"))
    ends = []
    for share in shares.values():
        at = F.lit(share) * (F.col("__n") - 1)
        ends += [F.floor(at), F.ceil(at)]
    wanted = F.posexplode(F.array(*ends)).alias("slot", "rank")
    sizes = checkpoint(sizes)
    open_, done = sizes.select(*keys, "lo", "hi", wanted), None
    while True:
        open_ = checkpoint(open_)
        found = open_.where("lo = hi").select(*keys, "slot", F.col("lo").alias("image"))
        done = found if done is None else done.unionByName(found)
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            break
        open_ = _narrowed(rows, open_, keys, bits)
    place = {name: 2 * i for i, name in enumerate(shares)}
    picked = [F.max(F.when(F.col("slot") == i, F.col("image"))).alias(f"__{i}") for i in range(2 * len(shares))]
    found = join_on(sizes.select(*keys, "__n"), done.groupBy(*keys).agg(*picked), keys)
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("__n") - 1)
        low, high = _of_image(F.col(f"__{place[name]}")), _of_image(F.col(f"__{place[name] + 1}"))
        between = F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))
        out.append(between.alias(name))
    return found.select(*by, *out)


def _narrowed(rows: DataFrame, open_: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """One round of ``percentiles``: the bucket that holds each wanted rank, and the rank in it."""
    # Halves, so that the width of any range is a long.
    width = F.length(F.bin(F.shiftright("hi", 1) - F.shiftright("lo", 1)))
    ranges = open_.groupBy(*keys, "lo", "hi").agg(F.greatest(F.lit(0), width + 1 - bits).alias("shift"))
    of_group = ranges.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "shift")).alias("__ranges"))  # as many as shares at most, twice
    placed = join_on(rows, lookup(of_group, row_bytes=512), keys)
    inside = F.filter("__ranges", lambda r: (r["lo"] <= F.col("__z")) & (F.col("__z") <= r["hi"]))
    placed = placed.withColumn("__in", F.get(inside, F.lit(0))).where(F.col("__in").isNotNull())
    # Shifted by Spark's own expression: the number of places is a column.
    places = F.call_function("shiftright", "__z", "__in.shift") - F.call_function("shiftright", "__in.lo", "__in.shift")
    counts = placed.groupBy(*keys, F.col("__in.lo").alias("__from"), places.alias("__bucket")).agg(
        F.count(F.lit(1)).alias("__m"), F.min("__z").alias("lo"), F.max("__z").alias("hi")
    )
    before = Window.partitionBy(*keys, "__from").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0)))
    slots = open_.select(*keys, F.col("lo").alias("__from"), "slot", "rank")
    held = join_on(counts, lookup(slots), [*keys, "__from"]).where("rank >= __before AND rank < __before + __m")
    return held.select(*keys, "lo", "hi", "slot", (F.col("rank") - F.col("__before")).alias("rank"))


def top_ranked(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per group with their ``rank`` (from 1).

    Spark keeps only ``k`` rows per group and task before the shuffle, so a hot group is no burden.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
