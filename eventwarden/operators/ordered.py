"""Ordered sums that do not depend on how rows spread over keys.

A window over a key sorts the whole key in one task. Here a *hot* key, one that
holds more than its share of the rows, is cut along the order column into slices.
A slice is sorted on its own; the sum of all earlier slices of the key comes from
a small table and is added afterwards. Cold keys are one slice each. Slices hold about
equally many rows: they end at quantiles of the key's own order values, taken from a
mergeable sketch, so a key whose rows lie in one minute is cut as finely as any other.

A key is hot above a fixed number of rows, so no task holds more at any size of
the table. Up to ``max_hot_keys`` hot keys are broadcast; a longer list is joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from eventwarden.session import cut_lineage

SLICE = "_slice"
CARRY = "_carry_"


@dataclass(frozen=True)
class SlicePolicy:
    min_rows: int = 2_000_000       # a smaller key is never cut
    target_rows: int = 500_000      # rows wanted per slice
    max_hot_keys: int = 10_000      # a longer list is not broadcast
    max_slices: int = 4096          # of one key; beyond, slices grow


DEFAULT_POLICY = SlicePolicy()


@dataclass(frozen=True)
class Spread:
    """How rows lie along the order column and over the keys."""
    rows: int
    low: float
    high: float
    hot: DataFrame | None       # keys to cut, with the ascending values at which slices begin
    few: bool = True            # whether the keys to cut are few enough to broadcast

    def keys_to_cut(self) -> DataFrame:
        return F.broadcast(self.hot) if self.few else self.hot


def span_of(df: DataFrame, order: str) -> Spread:
    """Number of rows and range of the order column."""
    facts = df.agg(
        F.count("*").alias("n"),
        F.min(order).cast("double").alias("low"),
        F.max(order).cast("double").alias("high"),
    ).first()
    return Spread(facts["n"], facts["low"] or 0.0, facts["high"] or 0.0, None)


#: Cuts are searched in two steps: among every STEP-th one, then among the next STEP.
STEP = 64


def cut_points(df: DataFrame, keys: Sequence[str], order: str, pieces: int) -> DataFrame:
    """``(keys, _points)``: for every key the values that part its rows into ``pieces`` about equal slices."""
    shares = F.array(*[F.lit(k / pieces) for k in range(1, pieces)])
    accuracy = F.lit(max(10_000, 8 * pieces))
    return df.groupBy(*keys).agg(F.percentile_approx(order, shares, accuracy).alias("_points"))


def with_steps(df: DataFrame) -> DataFrame:
    """Add every STEP-th of the ascending ``_cuts`` as ``_coarse``."""
    return df.withColumn("_coarse", F.filter("_cuts", lambda _, place: place % STEP == 0))


def slice_number(value: Column) -> Column:
    """How many of the row's ``_cuts`` are not above ``value``."""
    blocks = F.size(F.filter("_coarse", lambda cut: cut <= value))
    first = F.greatest(blocks - 1, F.lit(0)) * STEP
    return (first + F.size(F.filter(F.slice("_cuts", first + 1, F.lit(STEP)), lambda cut: cut <= value))).cast("bigint")


def spread_of(df: DataFrame, keys: Sequence[str], order: str, policy: SlicePolicy = DEFAULT_POLICY,
              span: Spread | None = None, echoes: Sequence[int] = ()) -> Spread:
    """Look at the data once to decide how to cut it.

    ``df`` may be any cheap frame with the keys and the order column; a known
    ``span`` of the same rows saves a pass. Rows are counted per key only when the
    frame is large enough to have a hot key; the counts are combined before the
    shuffle and at most ``max_hot_keys`` come back; more stay a table. ``echoes`` are
    distances after which every row matters again: slices are even over those values too.
    """
    span = span or span_of(df, order)
    rows, low, high = span.rows, span.low, span.high
    if not keys or rows <= policy.min_rows:
        return Spread(rows, low, high, None)
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > policy.min_rows)
    listed = counts.limit(policy.max_hot_keys + 1).collect()
    if not listed:
        return Spread(rows, low, high, None)
    few = len(listed) <= policy.max_hot_keys
    hot = df.sparkSession.createDataFrame(listed, counts.schema) if few else cut_lineage(counts)
    most = max(r["_n"] for r in listed) if few else hot.agg(F.max("_n")).first()[0]
    finest = min(max(2, -(-most // policy.target_rows)), policy.max_slices)
    values = F.explode(F.array(F.col(order), *[F.col(order) + e for e in echoes]))
    seen = df.join(F.broadcast(hot) if few else hot, list(keys), "left_semi").select(*keys, values.alias("_value"))
    # Of the finest cuts, a smaller key takes every so many.
    pieces = F.least(F.greatest(F.ceil(F.col("_n") / policy.target_rows), F.lit(2)), F.lit(finest))
    taken = F.transform(F.sequence(F.lit(1), (pieces - 1).cast("int")),
                        lambda k: F.col("_points")[(F.floor(k * finest / pieces) - 1).cast("int")])
    found = with_steps(hot.join(cut_points(seen, keys, "_value", finest), list(keys)).select(
        *keys, F.array_distinct(taken).alias("_cuts")))
    found = cut_lineage(found)
    return Spread(rows, low, high, found, few)


def with_slices(df: DataFrame, keys: Sequence[str], order: str, spread: Spread) -> DataFrame:
    """Add the slice number; it is null for rows of keys that stay whole."""
    if spread.hot is None:
        return df.withColumn(SLICE, F.lit(None).cast("bigint"))
    marked = df.join(spread.keys_to_cut(), list(keys), "left")
    number = F.when(F.col("_cuts").isNotNull(), slice_number(F.col(order)))
    return marked.withColumn(SLICE, number).drop("_cuts", "_coarse")


def with_global_slices(df: DataFrame, order: str, spread: Spread,
                       policy: SlicePolicy = DEFAULT_POLICY) -> DataFrame:
    """Cut the whole frame along ``order``, for sums that have no key.

    Slices hold about equally many rows wherever the values lie, so one far value does not leave all others in one slice.
    """
    pieces = min(max(-(-spread.rows // policy.target_rows), 8), policy.max_slices)
    points = with_steps(cut_points(df, [], order, pieces).select(F.array_distinct("_points").alias("_cuts")))
    marked = df.withColumns({c: points.select(c).scalar() for c in ("_cuts", "_coarse")})
    return marked.withColumn(SLICE, slice_number(F.col(order))).drop("_cuts", "_coarse")


def sums_before(sliced: DataFrame, keys: Sequence[str], order: str,
                groups: Sequence[tuple[Sequence[str], dict[str, str]]],
                cut: bool, probe: Column | None = None, distinct: bool = False) -> DataFrame:
    """For every row, the sums over the strictly earlier rows of its key.

    ``sliced`` carries the slice column. ``groups`` lists ``(extra_keys, {out: value})``:
    sums within the key, or within the key and the extra keys; all share one shuffle.
    ``cut`` tells whether any key has slices. ``probe`` keeps only the rows whose sums
    are asked for. Without ``distinct``
    rows equal in ``order`` do not count for each other, and ``order`` must be a long.
    """
    place = [*keys, SLICE]
    rows = sliced
    for extra, sums in groups:
        base = Window.partitionBy(*place, *extra).orderBy(order)
        if distinct:
            frame = base.rowsBetween(Window.unboundedPreceding, -1)
        else:
            frame = base.rangeBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({
            out: F.coalesce(F.sum(value).over(frame), F.lit(0)) for out, value in sums.items()
        })
    if probe is not None:
        rows = rows.where(probe)
    if not cut:
        return rows.drop(SLICE)
    pieces = sliced.where(F.col(SLICE).isNotNull())
    for extra, sums in groups:
        within = Window.partitionBy(*keys, *extra).orderBy(SLICE).rowsBetween(
            Window.unboundedPreceding, -1)
        carry = (
            pieces.groupBy(*place, *extra)
            .agg(*[F.sum(value).alias(CARRY + out) for out, value in sums.items()])
            .withColumns({CARRY + out: F.sum(CARRY + out).over(within) for out in sums})
        )
        rows = rows.join(carry, [*place, *extra], "left").withColumns({
            out: F.col(out) + F.coalesce(F.col(CARRY + out), F.lit(0)) for out in sums
        }).drop(*[CARRY + out for out in sums])
    return rows.drop(SLICE)


def with_position(df: DataFrame, keys: Sequence[str], order: str, tie: str,
                  name: str = "position", policy: SlicePolicy = DEFAULT_POLICY) -> DataFrame:
    """Number the rows of every key from 0 by ``order``, then ``tie``.

    With no keys the whole frame is numbered. Only rows equal in key and order
    are ranked together; if very many are, they are cut along a numeric ``tie``.
    """
    counts = df.groupBy(*keys, order).agg(F.count("*").alias("_rows"))
    spread = spread_of(df, keys, order, policy)
    if keys:
        sliced, cut = with_slices(counts, keys, order, spread), spread.hot is not None
    else:
        sliced, cut = with_global_slices(counts, order, spread, policy), True
    before = sums_before(sliced, keys, order, [([], {"_before": "_rows"})], cut, distinct=True)
    place = [*keys, order]
    rows, firsts = df, before.select(*place, "_before")
    crowded = spread_of(df, place, tie, policy, spread) if isinstance(df.schema[tie].dataType, NumericType) else None
    if crowded is not None and crowded.hot is not None:
        # A slice of a crowded place begins after the rows of the slices before it.
        rows = with_slices(df, place, tie, crowded).withColumn(SLICE, F.coalesce(SLICE, F.lit(-1)))
        earlier = Window.partitionBy(*place).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        pieces = rows.groupBy(*place, SLICE).agg(F.count("*").alias("_rows")).withColumn(
            "_earlier", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        firsts = cut_lineage(pieces.join(firsts, place).select(
            *place, SLICE, (F.col("_before") + F.col("_earlier")).alias("_before")))
        place = [*place, SLICE]
    peers = Window.partitionBy(*place).orderBy(tie)
    return (
        rows.join(firsts, place)
        .withColumn(name, F.col("_before") + F.row_number().over(peers) - 1)
        .drop("_before", SLICE)
    )


def last_rows(df: DataFrame, keys: Sequence[str], order: str, tie: str, length: int,
              payload: str, name: str, block: int = 10_000,
              policy: SlicePolicy = DEFAULT_POLICY, tasks: int | None = None) -> DataFrame:
    """For every row, the array of ``payload`` of the last ``length`` rows of its key.

    Rows are numbered within the key and cut into blocks; the tail of a block is
    copied into the next one, so no task holds more than one block of a key. Arrays are far larger
    than the rows they are made from: ``tasks`` says into how many tasks blocks go, else their bytes do.
    """
    placed = with_position(df, keys, order, tie, "_position", policy)
    number = F.floor(F.col("_position") / block)
    in_tail = F.pmod(F.col("_position"), F.lit(block)) >= block - (length - 1)
    copies = F.when(in_tail, F.array(F.struct(number.alias("_block"), F.lit(True).alias("_own")),
                                     F.struct((number + 1).alias("_block"), F.lit(False).alias("_own")))
                    ).otherwise(F.array(F.struct(number.alias("_block"), F.lit(True).alias("_own"))))
    frame = Window.partitionBy(*keys, "_block").orderBy("_position").rowsBetween(-(length - 1), 0)
    blocks = placed.withColumn("_copy", F.explode(copies)).withColumns(
        {"_block": F.col("_copy._block"), "_own": F.col("_copy._own")})
    if tasks is not None:
        blocks = blocks.repartition(tasks, *keys, "_block")
    return (
        blocks.withColumn(name, F.collect_list(payload).over(frame))
        .where("_own")
        .drop("_copy", "_block", "_own", "_position")
    )


def nth_value(df: DataFrame, column: str, n: int, slots: int = 100_000) -> tuple[int, int]:
    """The value of the n-th row, from 0, in the order of a long column.

    Returns it with the number of smaller rows. Each pass reads one column and counts
    it into at most ``slots`` slots, the next pass looks into the slot that holds the
    row. Nothing is sorted, and three passes cover a month of microseconds.
    """
    span = df.agg(F.min(column), F.max(column)).first()
    low, high, before = span[0], span[1], 0
    while True:
        width = max(-(-(high - low + 1) // slots), 1)
        slot = F.floor((F.col(column) - low) / width)
        counts = (df.where(F.col(column).between(low, high)).groupBy(slot.alias("slot"))
                  .agg(F.count("*").alias("rows")).collect())
        for row in sorted(counts):
            if n < before + row["rows"]:
                break
            before += row["rows"]
        else:
            raise ValueError(f"there is no row {n}")
        low, high = low + row["slot"] * width, low + (row["slot"] + 1) * width - 1
        if width == 1:
            return low, before


def is_before_row(df: DataFrame, n: int, order: str, tie: str) -> Column:
    """True for the first n rows by ``order``, then ``tie``; both are longs."""
    if n <= 0:
        return F.lit(False)
    cut, before = nth_value(df, order, n - 1)
    last, _ = nth_value(df.where(F.col(order) == cut), tie, n - 1 - before)
    return (F.col(order) < cut) | ((F.col(order) == cut) & (F.col(tie) <= last))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float],
                    policy: SlicePolicy = DEFAULT_POLICY) -> DataFrame:
    """Exact quantiles with linear interpolation: ``(share, quantile)``.

    Equal values are counted first, so ties cost one row; then every wanted rank
    is looked up in the prefix counts.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_value"))
    spread = spread_of(known, [], "_value", policy)
    counts = known.groupBy("_value").agg(F.count("*").alias("_rows"))
    sliced = with_global_slices(counts, "_value", spread, policy)
    ranked = sums_before(sliced, [], "_value", [([], {"_before": "_rows"})], True, distinct=True)
    total = F.lit(spread.rows)
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    # Ranks below and above every wanted share; a row serves those it covers.
    spots = F.transform(wanted, lambda s: F.struct(
        s.alias("share"), (s * (total - 1)).alias("rank")))
    covered = F.filter(spots, lambda p: (
        (F.floor(p["rank"]) < F.col("_before") + F.col("_rows"))
        & (F.ceil(p["rank"]) >= F.col("_before"))))
    hits = ranked.withColumn("_spot", F.explode(covered))
    low_rank, high_rank = F.floor("_spot.rank"), F.ceil("_spot.rank")
    holds_low = (low_rank >= F.col("_before")) & (low_rank < F.col("_before") + F.col("_rows"))
    holds_high = (high_rank >= F.col("_before")) & (high_rank < F.col("_before") + F.col("_rows"))
    ends = hits.groupBy(F.col("_spot.share").alias("share"), F.col("_spot.rank").alias("_rank")).agg(
        F.max(F.when(holds_low, F.col("_value"))).alias("_low"),
        F.max(F.when(holds_high, F.col("_value"))).alias("_high"),
    )
    part = F.col("_rank") - F.floor("_rank")
    return ends.select("share", (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias("quantile"))
