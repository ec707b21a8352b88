"""Irregular readings onto a regular grid, gaps filled by singular-spectrum imputation.

``regular_series`` gives one row for each grid cell from a series' first to
its last cell with a reading. Cells with readings hold their mean; empty cells
are marked ``filled`` and get a value by iterative singular-spectrum
imputation: the bucketed series is embedded as a Hankel trajectory matrix, the
matrix is truncated to its leading singular vectors, diagonal averages replace
the missing entries, and this repeats until they settle. Rows with a value from
a series that doesn't settle are marked ``unsettled``. Cells that stick out of
their neighbourhood (spikes) keep their value, but the imputation of other cells
doesn't learn from them.

A series is processed in blocks of 1000 cells with a halo of its neighbours'
readings, so no task holds a whole series; blocks of one length are imputed
together. Silences of more than ``max_gap`` cells are marked and left without
a value, since nothing near them bears on it.

Defined cases: readings with a null instant or a null or NaN value of the
counting field don't count; an infinite one counts, so its cell isn't empty, but
takes no part in the mean; a null, NaN or infinite value of the second field
leaves it to be imputed, with ``<field>_filled`` true; repeated deliveries count
once; an empty table gives no rows; a series of one cell gives that cell; series
keys may be null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.operators.blocks import block_numbers, instant_ns, pack_blocks, with_halo
from kinelake.operators.flat import Flat, breaks
from kinelake.operators.order_stats import percentiles
from kinelake.session import materialize

BLOCK_CELLS = 1000
HALO = 24
WINDOW, RANK, TOLERANCE = 10, 3, 1e-3
MEMORY, REACH, STALE, STRAY = 6, 0.5, 1000, 10
#: A safety bound, far above what series need (see the README's figures).
MOST_ROUNDS = 50_000


def ssa_impute(x: np.ndarray, missing: np.ndarray, window: int = WINDOW, rank: int = RANK, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Series of one length (rows of ``x``) with their missing entries replaced."""
    return ssa_settle(x, missing, window, rank, rounds, tolerance)[0]


class Trajectories:
    """Hankel matrices of padded series: windows that reach into the padding don't count."""

    def __init__(self, n: int, sizes: np.ndarray, length: int, rank: int) -> None:
        self.length, self.rank, self.k = length, min(rank, length), n - length + 1
        self.counts = (np.arange(self.k) <= (sizes - length)[:, None]).astype(float)
        weight = np.zeros((len(sizes), n))
        for i in range(length):
            weight[:, i : i + self.k] += self.counts
        self.weight = np.maximum(weight, 1)

    def keep(self, rows: np.ndarray) -> None:
        self.counts, self.weight = self.counts[rows], self.weight[rows]

    def truncate(self, y: np.ndarray) -> np.ndarray:
        """Diagonal averages of the matrices cut to their leading singular vectors (eigenvectors of the lag covariance)."""
        h = np.lib.stride_tricks.sliding_window_view(y, self.k, axis=1) * self.counts[:, None, :]
        _, vectors = np.linalg.eigh(h @ h.transpose(0, 2, 1))
        top = vectors[:, :, -self.rank :]
        low = top @ (top.transpose(0, 2, 1) @ h)
        mean = np.zeros_like(y)
        for i in range(self.length):
            mean[:, i : i + self.k] += low[:, i]
        return mean / self.weight


def ssa_settle(x: np.ndarray, missing: np.ndarray, window: int = WINDOW, rank: int = RANK, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The series of ``ssa_impute``, and which of them settled within ``rounds``.

    ``x`` must hold first guesses at the missing places; NaNs at a row's end are
    padding, and all rows must be long enough for the same window. A row has
    settled when a round of truncation moves none of its missing entries by more
    than ``tolerance`` times the row's own spread. Imputed values are kept within
    the range of the row's known ones, widened by ``REACH`` of its width on
    either side: at a row's end truncation alone may run away.

    Where the next round starts is extrapolated from the last ``MEMORY`` rounds
    (Anderson's mixing) after the first dozen, since plain repetition creeps where singular values are
    nearly equal. An extrapolation after which the changes grow is taken back,
    and plain rounds follow, each time twice as many. A row that hasn't come
    nearer to settling for ``STALE`` rounds (its truncation jumps between two
    subspaces) is left as it is, not settled.
    """
    n = x.shape[1]
    sizes = n - np.isnan(x).sum(axis=1)
    length = min(window, int(sizes.min(initial=n)) // 2)
    settled = ~missing.any(axis=1)
    if length < 2:
        return x, np.ones(len(x), bool)
    inside = np.arange(n) < sizes[:, None]
    centre = (np.where(inside, x, 0).sum(axis=1) / sizes)[:, None]
    out = np.where(inside, x - centre, 0.0)
    spread = np.sqrt((out**2).sum(axis=1) / sizes) + 1e-12
    live = np.flatnonzero(~settled)
    y, m, bound = out[live], missing[live], tolerance * spread[live]
    known = inside[live] & ~m
    low, high = np.where(known, y, np.inf).min(axis=1, initial=np.inf)[:, None], np.where(known, y, -np.inf).max(axis=1, initial=-np.inf)[:, None]
    low, high = low - REACH * (high - low), high + REACH * (high - low)
    hankel = Trajectories(n, sizes[live], length, rank)
    past_y, past_f = np.zeros((len(live), MEMORY, n)), np.zeros((len(live), MEMORY, n))
    last_y, last_f = y, np.zeros_like(y)
    best_y, best_f, least = y, np.zeros_like(y), np.full(len(live), np.inf)
    plain, rest = np.full(len(live), 2 * MEMORY), np.full(len(live), MEMORY)  # plain rounds to go, and how many the next failure costs
    since = np.zeros(len(live), np.int64)  # rounds since the row last came nearer to settling
    for turn in range(rounds):
        if not len(live):
            break
        f = np.where(m, np.clip(hankel.truncate(y), low, high) - y, 0.0)
        change = np.abs(f).max(axis=1)
        done = change <= bound
        settled[live[done]] = True
        leave = done | ~np.isfinite(change) | (since > STALE)
        if leave.any():
            out[live[leave]] = (y + f)[leave]
            stay = ~leave
            live, y, f, m, bound, low, high, change, since, past_y, past_f, last_y, last_f, best_y, best_f, least, plain, rest = (
                a[stay] for a in (live, y, f, m, bound, low, high, change, since, past_y, past_f, last_y, last_f, best_y, best_f, least, plain, rest)
            )
            hankel.keep(stay)
            if not len(live):
                break
        failed = (change > 2 * least) & (plain == 0)
        if turn:
            past_y[:, turn % MEMORY], past_f[:, turn % MEMORY] = y - last_y, f - last_f
        if failed.any():  # back to the best point
            past_y[failed] = past_f[failed] = 0
            y, f = np.where(failed[:, None], best_y, y), np.where(failed[:, None], best_f, f)
            plain, rest = np.where(failed, rest, plain), np.where(failed, 2 * rest, rest)
        better = (change < least) & ~failed
        best_y, best_f, least = np.where(better[:, None], y, best_y), np.where(better[:, None], f, best_f), np.where(better, change, least)
        since = np.where(better, 0, since + 1)
        last_y, last_f = y, f
        gram = past_f @ past_f.transpose(0, 2, 1)
        ridge = 1e-10 * np.trace(gram, axis1=1, axis2=2) + 1e-300
        mix = np.linalg.solve(gram + ridge[:, None, None] * np.eye(MEMORY), past_f @ f[:, :, None])
        leap = y + f - ((past_y + past_f).transpose(0, 2, 1) @ mix)[:, :, 0]
        leaps = (plain == 0) & np.where(m, (leap >= low) & (leap <= high), True).all(axis=1)
        y = np.where(leaps[:, None], leap, y + f)
        plain = np.maximum(plain - 1, 0)
    if len(live):
        out[live] = y
    return np.where(inside, out + centre, x), settled


def first_guess(values: np.ndarray, run: np.ndarray) -> np.ndarray:
    """NaNs replaced by linear interpolation within each run, or by its nearest value at the ends; runs without a value stay NaN."""
    n = len(values)
    at = np.arange(n)
    known = ~np.isnan(values)
    before = np.maximum.accumulate(np.where(known, at, -1))
    after = np.minimum.accumulate(np.where(known, at, n)[::-1])[::-1]
    before = np.where((before >= 0) & (run[np.maximum(before, 0)] == run), before, -1)
    after = np.where((after < n) & (run[np.minimum(after, n - 1)] == run), after, -1)
    lo, hi = np.where(before >= 0, before, after), np.where(after >= 0, after, before)
    out = np.full(n, np.nan)
    ok = lo >= 0
    a, b = values[lo[ok]], values[hi[ok]]
    span = np.maximum(hi[ok] - lo[ok], 1)
    out[ok] = a + (b - a) * np.clip((at[ok] - lo[ok]) / span, 0, 1)
    return out


def _medians(values: np.ndarray, run: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The median of each run's values (upper one of two); NaNs come last in a run."""
    order = np.lexsort((values, run))
    return values[order][np.cumsum(sizes) - sizes + sizes // 2]


def strays(values: np.ndarray, run: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cells farther than ``STRAY`` times their run's usual change from the median of the five around them."""
    around = np.full((5, len(values)), np.nan)
    for i, shift in enumerate((-2, -1, 0, 1, 2)):
        moved = np.roll(values, shift)
        around[i] = np.where(np.roll(run, shift) == run, moved, values)
    usual = _medians(np.abs(np.diff(values, prepend=values[:1])), run, sizes)
    with np.errstate(invalid="ignore"):
        return np.abs(values - np.sort(around, axis=0)[2]) > STRAY * np.repeat(usual, sizes) + 1e-12


def _impute(values: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dense runs of ``values`` with their NaNs imputed, runs of like length together; which of the imputed values didn't settle.

    Stray cells keep their values but take no part in the imputation of others.
    """
    starts = np.flatnonzero(breaks(run))
    sizes = np.diff(np.append(starts, len(run)))
    stray = strays(first_guess(values, run), run, sizes) & ~np.isnan(values) if len(values) else np.zeros(0, bool)
    clean = np.where(stray, np.nan, values)
    out = first_guess(clean, run)
    missing, unsettled = np.isnan(clean), np.zeros(len(values), bool)
    gaps = np.add.reduceat(missing, starts) if len(starts) else np.zeros(0)
    usable = (gaps > 0) & ~np.isnan(out[starts]) & (sizes >= 4) if len(starts) else np.zeros(0, bool)
    # runs of like length are padded to one; short ones, whose window depends on their length, aren't
    padded = np.where(sizes < 2 * WINDOW, sizes, np.ceil(2 ** (np.ceil(np.log2(np.maximum(sizes, 1)) * 4) / 4)).astype(np.int64))
    for n in np.unique(padded[usable]):
        group = np.flatnonzero(usable & (padded == n))
        for part in np.array_split(group, max(1, int(len(group) * n / 200_000))):
            inside = np.arange(n) < sizes[part][:, None]
            index = np.minimum(starts[part][:, None] + np.arange(n), len(out) - 1)
            gap = missing[index] & inside
            got, settled = ssa_settle(np.where(inside, out[index], np.nan), gap)
            out[index[inside]] = got[inside]
            unsettled[index[inside]] = (gap & ~settled[:, None])[inside]
    out[stray], unsettled[stray] = values[stray], False
    return out, unsettled


def _means(v: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Means of the finite values of each slice; NaN where there is none."""
    good = np.isfinite(v)
    n = np.add.reduceat(good.astype(np.int64), start)
    return np.where(n > 0, np.add.reduceat(np.where(good, v, 0.0), start) / np.maximum(n, 1), np.nan)


def _regularize(batches: Iterator[pa.RecordBatch], keys: Sequence[str], main: str, second: str, cell: int, max_gap: int, schema: pa.Schema, linear: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = Flat(batch, ["before", "items", "after"], ["at"], [main, second])
        cells = flat["at"] // cell
        start = np.flatnonzero(breaks(flat.seg, cells))
        if not len(start):
            continue
        count = np.diff(np.append(start, len(flat)))
        seg, cells, role = flat.seg[start], cells[start], flat.role[start]
        mean, mean2 = _means(flat[main], start), _means(flat[second], start)
        # dense runs: cells of one block whose silences are short enough
        new = breaks(seg)
        step = np.diff(cells, prepend=cells[:1])
        long = ~new & (step > max_gap + 1)
        run_new = new | long
        lead = np.where(run_new, 0, step)  # cells from the previous known one
        size = np.where(run_new, 1, lead)
        end = np.cumsum(size)
        total = int(end[-1])
        known_at = end - 1
        dense = np.full(total, np.nan)
        dense2 = np.full(total, np.nan)
        readings = np.zeros(total, np.int64)
        dense[known_at], dense2[known_at], readings[known_at] = mean, mean2, count
        owner = np.repeat(np.arange(len(size)), size)
        cell_no = cells[owner] - (known_at[owner] - np.arange(total))
        run = np.cumsum(run_new)[owner]
        (value, open1), (value2, open2) = _impute(dense, run), _impute(dense2, run)
        # a block gives its own cells and the empty ones just before them
        own = role[owner] == 1
        out = {"row": seg[owner][own], "cell": cell_no[own], "a": value[own], "b": value2[own], "n": readings[own], "filled": (readings == 0)[own], "b_filled": np.isnan(dense2)[own], "how": np.where(np.isnan(dense), np.where(np.isnan(value), "marked", "ssa"), "observed")[own], "unsettled": (open1 | open2)[own]}
        if linear:
            out["linear"] = first_guess(dense, run)[own]
        yield from _emit(batch, keys, out, schema, cell)
        for k in np.flatnonzero(long & (role == 1)):  # long silences: marked only
            for lo in range(int(cells[k - 1]) + 1, int(cells[k]), 100_000):
                c = np.arange(lo, min(lo + 100_000, int(cells[k])))
                m = len(c)
                yield from _emit(batch, keys, {"row": np.full(m, seg[k]), "cell": c, "a": np.full(m, np.nan), "b": np.full(m, np.nan), "n": np.zeros(m, np.int64), "filled": np.ones(m, bool), "b_filled": np.ones(m, bool), "how": np.full(m, "marked"), "unsettled": np.zeros(m, bool)} | ({"linear": np.full(m, np.nan)} if linear else {}), schema, cell)


def _emit(batch: pa.RecordBatch, keys: Sequence[str], out: dict, schema: pa.Schema, cell: int) -> Iterator[pa.RecordBatch]:
    n = len(out["row"])
    for lo in range(0, n, 100_000):
        part = {k: v[lo : lo + 100_000] for k, v in out.items()}
        rows = pa.array(part["row"])
        columns = [batch.column(batch.schema.get_field_index(k)).take(rows) for k in keys]
        columns += [
            pa.array(part["cell"] * (cell // 1_000_000)),
            pa.array(part["a"], from_pandas=True),
            pa.array(part["b"], from_pandas=True),
            pa.array(part["n"]),
            pa.array(part["filled"]),
            pa.array(part["b_filled"]),
            pa.array(part["how"].astype(object), pa.string()),
            pa.array(part["unsettled"]),
        ]
        if "linear" in part:
            columns.append(pa.array(part["linear"], from_pandas=True))
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def regular_series(
    readings: DataFrame,
    keys: Sequence[str] = ("episode_id", "joint_name"),
    main: str = "joint_position",
    second: str = "joint_velocity",
    cell_ms: int = 100,
    max_gap: int = 100,
    linear: bool = False,
) -> DataFrame:
    """(keys, cell_ms, main, second, n_readings, filled, second_filled, method, unsettled) of every cell of every series.

    cell_ms is the cell's start in milliseconds since the epoch, a multiple of
    the cell width. filled: no reading counts in the cell. method is observed,
    ssa or marked (without a value: in a silence longer than ``max_gap`` cells,
    or with no finite reading near). unsettled: a filled value of the row comes
    from an imputation that didn't settle. ``linear`` adds what linear
    interpolation gives for the main field.
    """
    cell = cell_ms * 1_000_000
    counts = F.col(main).isNotNull() & ~F.isnan(main)
    src = readings.where(counts).select(*keys, instant_ns().alias("at"), F.col(main).cast("double").alias("v_main"), F.col(second).cast("double").alias("v_second"))
    width, fields = BLOCK_CELLS * cell, ["v_main", "v_second"]
    blocks = with_halo(pack_blocks(src, keys, "at", fields, width), keys, HALO, fields, block_numbers(src, keys, "at", width))
    kinds = dict(src.dtypes)
    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", cell_ms bigint, `{main}` double, `{second}` double, n_readings bigint, filled boolean, `{second}_filled` boolean, method string, unsettled boolean" + (f", `{main}_linear` double" if linear else "")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))
    names = list(keys)
    return blocks.mapInArrow(lambda it: _regularize(it, names, "v_main", "v_second", cell, max_gap, schema, linear), ddl)


def holdout_errors(readings: DataFrame, part: int = 10, **options) -> DataFrame:
    """(joint_name, n_cells, ssa_p50, ssa_p90, linear_p50, linear_p90): how far imputed values lie from cells that were held back.

    A cell of a series is held back, with all its readings, by a hash of its
    series and number, one in ``part``. The errors are those of the main field;
    linear interpolation is the yardstick.
    """
    cell_ms = options.get("cell_ms", 100)
    held = lambda cell: F.pmod(F.xxhash64("episode_id", "joint_name", cell), F.lit(part)) == 0
    of_reading = F.expr(f"(ts_seconds * 1000 + ts_nanos div 1000000) div {cell_ms} * {cell_ms}")
    true = regular_series(readings, **options).where("method = 'observed'").where(held(F.col("cell_ms"))).select("episode_id", "joint_name", "cell_ms", F.col("joint_position").alias("was"))
    guess = regular_series(readings.where(~held(of_reading)), linear=True, **options).where("method = 'ssa'").where(held(F.col("cell_ms")))
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"g.{k}")) for k in ("episode_id", "joint_name", "cell_ms")]
    both = true.alias("t").join(guess.alias("g"), on).select("t.joint_name", F.abs(F.col("joint_position") - F.col("was")).alias("ssa"), F.abs(F.col("joint_position_linear") - F.col("was")).alias("linear"))
    both = materialize(both)
    n = both.groupBy("joint_name").agg(F.count("*").alias("n_cells"))
    for c in ("ssa", "linear"):
        p = percentiles(both, ["joint_name"], c, [0.5, 0.9]).select("joint_name", F.round(F.col("p")[0], 6).alias(f"{c}_p50"), F.round(F.col("p")[1], 6).alias(f"{c}_p90"))
        n = n.join(p, "joint_name")
    return n
