"""Deduplication, throttling of noisy alerts, merging and keyed updates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventwarden import constants as K
from eventwarden.operators.ordered import DEFAULT_POLICY, SlicePolicy, cut_points, slice_number, with_steps
from eventwarden.session import cut_lineage


def last_version(events: DataFrame, key: str | Sequence[str] = "event_id",
                 by: Sequence[str] = ("ingest_ts",)) -> DataFrame:
    """One row per key, the last written; of equal ones that with the largest hash of its fields.

    Rank pruning runs before the shuffle, so a key with very many copies sends one row per input task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    # Maps have no hash.
    plain = [f.name for f in events.schema.fields if "map<" not in f.dataType.simpleString()]
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in by], F.xxhash64(*plain).desc())
    return events.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def first_per_key(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    oldest = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("_rank", F.row_number().over(oldest)).where("_rank = 1").drop("_rank")


def merge_new(old: DataFrame, new: DataFrame, key: str = "id", by: str = "time",
              newest: int | None = None) -> DataFrame:
    """Known rows plus the new ones not yet known; only the ``newest`` rows if asked for."""
    added = new.join(old.select(key), key, "left_anti")
    merged = old.unionByName(added)
    return merged if newest is None else merged.orderBy(F.col(by).desc(), F.col(key).desc()).limit(newest)


def insert_unique(table: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The batch rows to insert: unknown keys only, the first of equal keys."""
    return first_per_key(batch, [key], [order]).join(table.select(key), key, "left_anti")


def partial_update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Replace only the fields a change sets; other rows and fields stay."""
    fields = [c for c in table.columns if c != key]
    named = changes.select(key, *[
        (F.col(c) if c in changes.columns else F.lit(None)).alias("_new_" + c) for c in fields])
    return table.join(named, key, "left").select(
        key, *[F.coalesce("_new_" + c, c).alias(c) for c in fields])


# --- throttling -------------------------------------------------------------
#
# Keep a row only if the last kept row of its class is at least ``gap`` older.
# Whether a row stays depends on all earlier ones, but a stretch of time sees the
# past only through one number: the instant from which it may keep again. So a
# stretch is a map from that number to the next one. The maps of all stretches are found
# in parallel, those of FAN neighbours are composed to one, level by level; then the
# numbers are handed down the same tree, and the rows are picked. No task sees more than
# one stretch or FAN maps.

FAN = 32


def _exits(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each possible start the last instant kept: (latest start, last kept)."""
    count = len(times)
    step = np.searchsorted(times, times + gap)
    here = np.arange(count)
    # The last instant of a chain points to itself; squaring doubles every jump.
    jump = np.where(step < count, step, here)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    exits = times[jump]
    # Later starts end later, and chains soon meet: few different ends.
    ends = np.append(exits[1:] != exits[:-1], True)
    return times[ends], exits[ends]


def _composed(maps: list[tuple[np.ndarray, np.ndarray]], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """One map for neighbouring stretches: (latest start, last kept)."""
    starts, exits = maps[0]
    for after, then in maps[1:]:
        # What the first part leaves goes through the second; a start behind it sees the second only.
        spot = np.searchsorted(after, exits + gap)
        exits = np.where(spot < len(after), then[np.minimum(spot, len(after) - 1)], exits)
        starts, exits = np.concatenate([starts, after]), np.concatenate([exits, then])
        ends = np.append(exits[1:] != exits[:-1], True)
        starts, exits = starts[ends], exits[ends]
    return starts, exits


def throttle(events: DataFrame, label: str = "classification", us: str = "us", tie: str = "event_id",
             classes: Sequence[str] = K.NOISY_CLASSES, gap_us: int = K.NOISY_GAP_SECONDS * K.SECOND_US,
             policy: SlicePolicy = DEFAULT_POLICY, kept_before: DataFrame | None = None) -> DataFrame:
    """Thin out the noisy classes; every other row passes.

    ``kept_before`` holds the last instant kept per class by an earlier run:
    ``(label, us)``.
    """
    noisy = events.where(F.col(label).isin(*classes))
    rows = noisy.count()
    # Rows at the same instant are decided together; a stretch holds about as many instants as any other.
    instants = noisy.groupBy(label, us).agg(F.min(tie).alias(tie))
    pieces = min(max(2, -(-rows // policy.target_rows)), policy.max_slices)
    points = cut_points(noisy, [], us, pieces).first()["_points"] or []
    cuts = sorted(set(points))
    found = with_steps(instants.withColumn("_cuts", F.lit(cuts).cast("array<bigint>")))
    instants = found.withColumn("_part", slice_number(F.col(us))).drop("_cuts", "_coarse")

    def outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, exits = _exits(np.sort(pdf[us].to_numpy()), gap_us)
        return pd.DataFrame({label: [pdf[label].iloc[0]], "_part": [int(pdf["_part"].iloc[0])],
                             "_starts": [starts.tolist()], "_exits": [exits.tolist()]})

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        maps = [(np.asarray(a, np.int64), np.asarray(b, np.int64)) for a, b in zip(pdf["_starts"], pdf["_exits"])]
        starts, exits = _composed(maps, gap_us)
        return pd.DataFrame({label: [pdf[label].iloc[0]], "_part": [int(pdf["_part"].iloc[0]) // FAN],
                             "_starts": [starts.tolist()], "_exits": [exits.tolist()]})

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        free, given = int(pdf["_free"].iloc[0]), []
        for starts, exits in zip(pdf["_starts"], pdf["_exits"]):
            given.append(free)
            spot = int(np.searchsorted(np.asarray(starts), free))
            if spot < len(starts):
                free = int(exits[spot]) + gap_us
        return pd.DataFrame({label: pdf[label].to_numpy(), "_part": pdf["_part"].to_numpy(),
                             "_free": given})

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(us)
        times, free, chosen = pdf[us].to_numpy(), int(pdf["_free"].iloc[0]), []
        spot = int(np.searchsorted(times, free))
        while spot < len(times):
            chosen.append(spot)
            spot = int(np.searchsorted(times, times[spot] + gap_us))
        return pdf.iloc[chosen][[label, us, tie]]

    kinds = {f.name: f.dataType.simpleString() for f in instants.schema.fields}
    place = f"`{label}` {kinds[label]}, `_part` bigint"
    shape = place + ", `_starts` array<bigint>, `_exits` array<bigint>"
    levels = [cut_lineage(instants.groupBy(label, "_part").applyInPandas(outcomes, shape))]
    above, count = F.floor(F.col("_part") / FAN), len(cuts) + 1
    while count > FAN:
        levels.append(cut_lineage(levels[-1].groupBy(label, above.alias("_above")).applyInPandas(composed, shape)))
        count = -(-count // FAN)
    starts = levels[-1].select(label).distinct().withColumns({
        "_part": F.lit(0).cast("bigint"), "_free": F.lit(-(2 ** 62))})
    if kept_before is not None:
        known = kept_before.groupBy(label).agg((F.max(us) + gap_us).alias("_known"))
        starts = starts.join(known, label, "left").withColumn("_free", F.coalesce("_known", "_free")).drop("_known")
    for level in reversed(levels):
        parents = starts.withColumnRenamed("_part", "_above")
        starts = level.withColumn("_above", above).join(parents, [label, "_above"]).groupBy(label, "_above").applyInPandas(
            hand_down, place + ", `_free` bigint")
    kept = (
        instants.join(starts, [label, "_part"]).groupBy(label, "_part")
        .applyInPandas(pick, f"`{label}` {kinds[label]}, `{us}` bigint, `{tie}` {kinds[tie]}")
    )
    shown = noisy.join(kept, [label, us, tie], "left_semi").dropDuplicates([label, us])
    return events.where(~F.coalesce(F.col(label).isin(*classes), F.lit(False))).unionByName(shown)
