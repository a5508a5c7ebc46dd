"""Per-client request quota over an access log.

A quota window opens at a client's first request, lasts a fixed time, and the next window
opens at the first request at or after its end. So each window depends on the one before it,
back to the client's first request. To follow that chain without walking a busy client's log
in one task, requests are first counted per instant, and time is cut into cells as long as a
window, `BLOCK` cells to a block:

1. each block on its own is turned into a step function: "if the next window may open at x,
   then after this block the next one may open at f(x)". Chains that meet stay together, so
   few steps are left;
2. per client the functions are followed from block to block;
3. each block, told where its chain begins, marks the window that opens in each of its cells
   (at most one, as a cell is as long as a window).

Each step reads its rows sorted and works on all complete groups of its Arrow batches at once.
Steps 1 and 3 hold the distinct instants of one client in one block, step 2 the few steps.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions.scalars import floor_div
from threatloom.operators.windows import STRETCH

# --- Fixed values ---------------------------------------------------------------
MAX_REQUESTS = 100
WINDOW_SECONDS = 60
# --------------------------------------------------------------------------------

BLOCK = 64  # cells
_NEVER = -(2**62)


def _whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut sorted batches so that no group crosses a cut."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        changed = np.zeros(len(batch), dtype=bool)
        for name in by:
            values = batch[name].to_numpy()
            before = held[-1][name].iloc[-1] if held else values[0]
            changed |= np.r_[values[0] != before, values[1:] != values[:-1]]
        cuts = np.flatnonzero(changed)
        if len(cuts):
            last = cuts[-1]
            ready = pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = [batch.iloc[last:]]
            if len(ready):
                yield ready
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def _group_ids(rows: pd.DataFrame, by: list[str]) -> np.ndarray:
    """0, 1, 2, … for each run of equal values."""
    changed = np.zeros(len(rows), dtype=bool)
    for name in by:
        values = rows[name].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.cumsum(changed)


class _Line:
    """Positions of many groups laid end to end on one number line, for one binary search."""

    def __init__(self, group: np.ndarray, offset: np.ndarray, length: int) -> None:
        self.group, self.length = group, length
        self.line = group * length + offset

    def first_at_or_after(self, group: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, whether it is of the group) for each (group, offset)."""
        row = np.searchsorted(self.line, group * self.length + np.clip(offset, 0, self.length - 1))
        inside = row < len(self.line)
        inside[inside] = self.group[row[inside]] == group[inside]
        return row, inside


def _compose(span: int, block: int) -> Callable:
    """Sorted (_key, _block, _at) -> the step function of each block."""

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, ["_key", "_block"]):
            at, group = rows["_at"].to_numpy(), _group_ids(rows, ["_key", "_block"])
            offset = at - rows["_block"].to_numpy() * (span * block)
            line = _Line(group, offset, span * (block + 2))
            following, inside = line.first_at_or_after(group, offset + span)
            last = np.arange(len(at))
            moving = inside.copy()
            while moving.any():  # at most `block` rounds: each start is a window further on
                last[moving] = following[last[moving]]
                moving[moving] = inside[last[moving]]
            leaves = at[last] + span
            # The chain enters within a window of the block's start, or at the first request after.
            early = offset < span
            first_late = ~early & np.r_[True, early[:-1] | (group[1:] != group[:-1])]
            kept = np.flatnonzero(early | first_late)
            g, out = group[kept], leaves[kept]
            kept = kept[np.r_[(g[1:] != g[:-1]) | (out[1:] != out[:-1]), True]]
            yield pd.DataFrame(
                {"_key": rows["_key"].to_numpy()[kept], "_block": rows["_block"].to_numpy()[kept],
                 "_open": at[kept], "_next": leaves[kept]}
            )

    return compose


def _follow(span: int, block: int) -> Callable:
    """Sorted (_key, _block, _open, _next) -> the position at which the chain enters each block."""

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, ["_key"]):
            blocks, nexts = rows["_block"].to_numpy(), rows["_next"].to_numpy()
            piece = _group_ids(rows, ["_key", "_block"])
            line = _Line(piece, rows["_open"].to_numpy() - blocks * (span * block), span * (block + 2))
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            client = _group_ids(rows.iloc[first], ["_key"])
            start = np.flatnonzero(np.r_[True, client[1:] != client[:-1]])
            pieces = np.diff(np.r_[start, len(first)])
            x, entered = np.full(len(start), _NEVER), np.empty(len(first), dtype=np.int64)
            for turn in range(pieces.max()):  # all clients of the batch, block by block
                going = np.flatnonzero(pieces > turn)
                now = start[going] + turn
                entered[now] = x[going]
                row, inside = line.first_at_or_after(now, x[going] - blocks[first[now]] * (span * block))
                x[going[inside]] = nexts[row[inside]]
            yield pd.DataFrame({"_key": rows["_key"].to_numpy()[first], "_block": blocks[first], "_x": entered})

    return follow


def _mark(span: int, block: int) -> Callable:
    """Sorted (_key, _block, _at, _n, _x) -> the windows that open in each block."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, ["_key", "_block"]):
            at, group = rows["_at"].to_numpy(), _group_ids(rows, ["_key", "_block"])
            base = rows["_block"].to_numpy() * (span * block)
            line = _Line(group, at - base, span * (block + 2))
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            active, x, opened = np.arange(len(first)), rows["_x"].to_numpy()[first] - base[first], []
            while len(active):
                row, inside = line.first_at_or_after(active, x)
                row, active = row[inside], active[inside]
                opened.append(row)
                x = at[row] - base[row] + span
            opened = np.concatenate(opened)
            cell = at[opened] // span
            end, _ = line.first_at_or_after(group[opened], (cell + 1) * span - base[opened])
            total = np.r_[0, np.cumsum(rows["_n"].to_numpy())]
            yield pd.DataFrame(
                {"_key": rows["_key"].to_numpy()[opened], "_cell": cell, "_start": at[opened],
                 "_rest": total[end] - total[opened]}
            )

    return mark


def quota_windows(instants: DataFrame, span: int, block: int = BLOCK) -> DataFrame:
    """(_key, _cell, _start, _rest) of every quota window, from (_key, _at, _n).

    `_rest` counts the requests between the window's start and the end of its cell.
    """
    blocked = instants.withColumn("_block", floor_div(F.col("_at"), span * block))
    steps = _sorted(blocked.select("_key", "_block", "_at"), ["_key", "_block"], "_at").mapInPandas(
        _compose(span, block), "_key string, _block long, _open long, _next long"
    )
    begins = _sorted(steps, ["_key"], "_block", "_open").mapInPandas(
        _follow(span, block), "_key string, _block long, _x long"
    )
    entered = blocked.join(begins, ["_key", "_block"])
    return _sorted(entered, ["_key", "_block"], "_at").mapInPandas(
        _mark(span, block), "_key string, _cell long, _start long, _rest long"
    )


def _sorted(frame: DataFrame, by: list[str], *order: str) -> DataFrame:
    return frame.repartition(*by).sortWithinPartitions(*by, *order)


def flag_quota(
    log: DataFrame,
    key: Column,
    at: Column,
    limit: int = MAX_REQUESTS,
    window_seconds: int = WINDOW_SECONDS,
    arrival: str = "arrival",
    stretch: int = STRETCH,
    block: int = BLOCK,
) -> DataFrame:
    """Add `request_number`, the place in the client's current window, and `allowed`.

    Refused requests count too. Requests of one instant are numbered in log order.
    """
    span = window_seconds * 1_000_000
    keyed = log.withColumns(
        {
            "_key": F.coalesce(key, F.lit("")),
            "_at": F.unix_micros(at),
            "_stretch": floor_div(F.col(arrival), stretch),
        }
    )
    points = keyed.groupBy("_key", "_at", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    instants = points.groupBy("_key", "_at").agg(F.sum("_n").alias("_n"))
    # A window that opens in one cell can only reach into the next.
    nothing = F.lit(None).cast("bigint")
    own = F.struct(F.col("_cell").alias("_cell"), F.col("_start").alias("_start"), nothing.alias("_carried"))
    following = F.struct((F.col("_cell") + 1).alias("_cell"), nothing.alias("_start"), F.col("_rest").alias("_carried"))
    cells = (
        quota_windows(instants, span, block)
        .select("_key", F.inline(F.array(own, following)))
        .groupBy("_key", "_cell")
        .agg(F.max("_start").alias("_start"), F.coalesce(F.max("_carried"), F.lit(0)).alias("_carried"))
    )
    placed = points.withColumn("_cell", floor_div(F.col("_at"), span)).join(cells, ["_key", "_cell"])
    placed = placed.withColumn("_opened", F.coalesce(F.col("_at") >= F.col("_start"), F.lit(False)))
    earlier = (
        Window.partitionBy("_key", "_cell", "_opened")
        .orderBy("_at", "_stretch")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    in_cell = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    carried = F.when(F.col("_opened"), 0).otherwise(F.col("_carried"))
    before = placed.select("_key", "_at", "_stretch", (in_cell + carried).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_key", "_at", "_stretch").orderBy(arrival))
    numbered = keyed.withColumn("_rank", rank).join(before, ["_key", "_at", "_stretch"])
    return (
        numbered.withColumn("request_number", F.col("_before") + F.col("_rank"))
        .withColumn("allowed", F.col("request_number") <= limit)
        .drop("_key", "_at", "_stretch", "_rank", "_before")
    )
