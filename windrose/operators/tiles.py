"""Sliding windows over gridded fields by tiles: every cell goes to its own tile and to those whose windows reach it.

A tile with its halo is what one task holds, however large a field is or how many cycles there are; columns go around the
date line, rows don't. Windows are cut within the tile as views and handed to a scorer in batches, so that patches, which
repeat every cell some hundreds of times, never leave the task: what comes back are scores, and for the detections that
pass a gate the centre's values, the patch's means and the attribution.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .held import Held

#: Rows and columns of a tile without its halo, and patches that a scorer gets at once.
TILE, BATCH = (16, 32), 256


def dealt(cells: DataFrame, radius: int, columns: int, tile: tuple[int, int] = TILE) -> DataFrame:
    """Copies of ``cells`` (cycle, row, col, candidate and others) with tile_row, tile_col, at_col (the column as the tile
    counts it, around the date line) and own (whether the tile is the cell's). Only tiles with a candidate get cells."""
    if 2 * radius >= columns:
        raise ValueError(f"windows of radius {radius} are wider than {columns} columns")
    tall, wide = tile
    place = lambda x, n: F.floor(x / F.lit(n)).cast("int")
    turned = cells.withColumn("_turn", F.explode(F.array(*[F.lit(k * columns) for k in (-1, 0, 1)]))).withColumn("at_col", F.col("col") + F.col("_turn"))
    near = turned.where(F.col("at_col").between(-radius, columns - 1 + radius))
    rows = F.sequence(F.greatest(F.lit(0), place(F.col("row") - radius, tall)), place(F.col("row") + radius, tall))
    across = F.sequence(F.greatest(F.lit(0), place(F.col("at_col") - radius, wide)), F.least(F.lit((columns - 1) // wide), place(F.col("at_col") + radius, wide)))
    copies = near.withColumn("tile_row", F.explode(rows)).withColumn("tile_col", F.explode(across))
    own = (F.col("_turn") == 0) & (F.col("tile_row") == place(F.col("row"), tall)) & (F.col("tile_col") == place(F.col("col"), wide))
    asked = cells.where("candidate").select("cycle", place(F.col("row"), tall).alias("tile_row"), place(F.col("col"), wide).alias("tile_col")).distinct()
    return copies.withColumn("own", own).drop("_turn").join(asked, ["cycle", "tile_row", "tile_col"], "left_semi")


def _stacked(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if flat.null_count or len(values) % max(1, len(flat)):
        raise ValueError("cells have stacks of different lengths")
    return values.reshape(len(flat), -1)


def _windows(group: pa.Table, radius: int, tile: tuple[int, int]):
    """(row, col) of the candidates of a tile whose windows are whole, each cell there once, and a function from places
    among them to windows (n, side, side, depth)."""
    tall, wide = tile
    side = 2 * radius + 1
    top, left = group["tile_row"][0].as_py() * tall - radius, group["tile_col"][0].as_py() * wide - radius
    row, col, at = (group[c].to_numpy() for c in ("row", "col", "at_col"))
    stack = _stacked(group["stack"])
    field = np.zeros((tall + 2 * radius, wide + 2 * radius, stack.shape[1]), stack.dtype)
    times = np.zeros(field.shape[:2], np.int32)
    field[row - top, at - left] = stack
    np.add.at(times, (row - top, at - left), 1)
    there = times == 1  # a cell given twice has no one value
    sums = np.zeros((there.shape[0] + 1, there.shape[1] + 1), np.int64)
    sums[1:, 1:] = there.cumsum(0).cumsum(1)
    whole = sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side] == side * side
    wanted = group["own"].to_numpy(zero_copy_only=False) & group["candidate"].fill_null(False).to_numpy(zero_copy_only=False)
    wanted[wanted] = whole[row[wanted] - top - radius, col[wanted] - left - radius]
    row, col = row[wanted], col[wanted]
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    view = np.lib.stride_tricks.sliding_window_view(field, (side, side), (0, 1)).transpose(0, 1, 3, 4, 2)
    return row, col, lambda part: view[row[part] - top - radius, col[part] - left - radius]


def _lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as lists of one length."""
    return pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)), pa.array(rows.ravel()))


def _fed(cells: DataFrame, radius: int, columns: int, tile: tuple[int, int]):
    names = ("cycle", "row", "col", "stack", "candidate")
    plain = cells.select(*names).withColumns({c: F.col(c).cast("int") for c in ("row", "col")})
    return dealt(plain, radius, columns, tile).groupBy("cycle", "tile_row", "tile_col")


def patches(cells: DataFrame, radius: int, columns: int, *, tile: tuple[int, int] = TILE) -> DataFrame:
    """(cycle, row, col, patch): for each candidate cell the stacks of the cells around it, row by row, in one array.

    ``cells``: cycle, row, col, stack, candidate. Candidates with a missing cell in their window (as at the first and last
    rows) or one that is given twice are left out. For a look at some patches; a run over all of them uses scan(), which doesn't copy them.
    """
    kinds = {f.name: f.dataType for f in cells.schema.fields}

    def run(group: pa.Table) -> pa.Table:
        row, col, window = _windows(group, radius, tile)
        x = window(slice(None))
        lists = _lists(x.reshape(len(row), x[:1].size if len(row) else 0))
        return pa.table({"cycle": group["cycle"].combine_chunks().take(pa.array(np.zeros(len(row), np.int64))), "row": row, "col": col, "patch": lists})

    return _fed(cells, radius, columns, tile).applyInArrow(run, f"cycle {kinds['cycle'].simpleString()}, row int, col int, patch {kinds['stack'].simpleString()}")


def scan(
    cells: DataFrame,
    scorer: Callable,
    scores: list[str],
    *,
    radius: int,
    columns: int,
    at: float | None = None,
    least_expert: float | None = None,
    explain: Callable | None = None,
    means: list[float] | None = None,
    stds: list[float] | None = None,
    tile: tuple[int, int] = TILE,
    batch: int = BATCH,
) -> DataFrame:
    """(cycle, row, col, scores..., center, mean, attribution) of the candidates whose scores pass the gate.

    ``cells``: cycle, row, col, stack (array of raw values by channel, of one length), candidate. ``scorer`` maps windows
    (n, side, side, channels), normalised by ``means`` and ``stds``, to (n, len(scores)); a NaN is a missing expert and
    null here. The first score must be ``at`` or more, the least of the others that are there ``least_expert`` or more.
    ``explain`` maps the windows that pass to attributions (n, channels); without it they are empty. ``center`` and
    ``mean`` are the raw values at the centre and their means over the window that are numbers. Candidates with a
    missing cell in their window, or one that is given twice, are left out. Functions and statistics travel to the workers once, as a broadcast.
    """
    held = Held(cells.sparkSession, (scorer, explain, None if means is None else np.asarray(means, float), None if stds is None else np.asarray(stds, float)))
    kind = {f.name: f.dataType for f in cells.schema.fields}["cycle"].simpleString()

    def run(group: pa.Table) -> pa.Table:
        score, why, mean, std = held.value
        row, col, window = _windows(group, radius, tile)
        found = []
        for start in range(0, len(row), batch):
            part = slice(start, start + batch)
            raw = window(part)
            x = raw if mean is None else ((raw - mean) / std).astype(raw.dtype)
            got = np.asarray(score(x), float).reshape(len(x), len(scores))
            keep = np.ones(len(x), bool) if at is None else got[:, 0] >= at
            if least_expert is not None:
                keep &= ~(got[:, 1:] < least_expert).any(1)
            if keep.any():
                some = raw[keep]
                reason = np.zeros((len(some), 0)) if why is None else np.asarray(why(x[keep]), float).reshape(len(some), -1)
                good = np.isfinite(some)
                total, n = np.where(good, some, 0).sum((1, 2), dtype=float), good.sum((1, 2))
                found.append((row[part][keep], col[part][keep], got[keep], some[:, radius, radius].astype(float), np.divide(total, n, out=np.full(total.shape, np.nan), where=n > 0), reason))
        if not found:
            return pa.table({"cycle": group["cycle"].combine_chunks()[:0], "row": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), **{s: pa.array([], pa.float64()) for s in scores}, **{c: pa.array([], pa.list_(pa.float64())) for c in ("center", "mean", "attribution")}})
        rows, cols, got, *lists = (np.concatenate(z) for z in zip(*found, strict=True))
        cycle = group["cycle"].combine_chunks().take(pa.array(np.zeros(len(rows), np.int64)))
        return pa.table({"cycle": cycle, "row": rows, "col": cols, **{s: pa.array(got[:, i], mask=np.isnan(got[:, i])) for i, s in enumerate(scores)}, **dict(zip(("center", "mean", "attribution"), map(_lists, lists), strict=True))})

    columns_of = ", ".join(f"{s} double" for s in scores)
    return _fed(cells, radius, columns, tile).applyInArrow(run, f"cycle {kind}, row int, col int, {columns_of}, center array<double>, mean array<double>, attribution array<double>")


def environment(channel: dict[str, int | list[int]]) -> dict[str, Column]:
    """The six conditions of a detection of scan() from its centre and patch means. ``channel`` has the places in the stack
    of landmask, pressfc, rhprs (one or several levels), u850, v850, u200, v200, absvprs and tmpsfc."""
    of = lambda array, name: F.get(F.col(array), F.lit(channel[name]))
    center = lambda name: of("center", name)
    levels = channel["rhprs"] if isinstance(channel["rhprs"], list) else [channel["rhprs"]]
    humid = [F.get(F.col("center"), F.lit(i)) for i in levels]
    return {
        "land_fraction": of("mean", "landmask"),
        "pressure_anomaly_pa": center("pressfc") - of("mean", "pressfc"),
        "midlevel_rh_percent": sum(humid[1:], humid[0]) / len(humid),
        "shear_200_850_ms": F.hypot(center("u200") - center("u850"), center("v200") - center("v850")),
        "vorticity_850_s1": center("absvprs"),
        "surface_temperature_k": center("tmpsfc"),
    }


def shares(variable: list[str]) -> Column:
    """Map from variable to its share of the mean absolute attribution by variable; ``variable`` names each channel's. Empty
    where there is no attribution, or none but zeros."""
    names = list(dict.fromkeys(variable))
    size = lambda v: [F.abs(F.get(F.col("attribution"), F.lit(i))) for i, n in enumerate(variable) if n == v]
    mean = {v: sum(size(v)[1:], size(v)[0]) / len(size(v)) for v in names}
    total = sum(list(mean.values())[1:], mean[names[0]])
    empty = F.create_map().cast("map<string,double>")
    return F.when(total > 0, F.create_map(*[x for v in names for x in (F.lit(v), mean[v] / total)])).otherwise(empty)
