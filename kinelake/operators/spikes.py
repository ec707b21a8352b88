"""Implausible readings, each judged by its own source.

A source is a robot's joint. Three kinds are told apart, by field:

- ``limit``: NaN, infinite, or outside the joint's limits. Row by row.
- ``stuck``: part of a stretch of at least 16 readings in time order in one
  episode with exactly the same value, where the source doesn't repeat itself
  anyway (less than half of its readings repeat the previous one).
- ``spike``: an additive outlier of one to three readings.

The model of a source is a robust autoregression of its changes: the usual
change from reading to reading (the median of its absolute values over all
readings), the usual interval, and the coefficient with which a change goes on
in the next one. The coefficient is estimated after a first test has taken
outliers out, by least squares on changes clipped at three usual ones. All
three are of the whole source, so they don't depend on how it is cut up.

Readings whose one-step residual is far above the usual change are candidates.
Each is tested by its residuals as additive outlier of one to three readings
(free sizes, least squares on the residuals that they touch) against a level
shift from there on. It is a spike where the outlier explains the residuals
better than the shift and leaves little of them, all its sizes have one sign,
and, as an exact check, each reading lies more than ``factor`` usual changes off
the line between the readings before and after it. Intervals above twice the
usual one are gaps: residuals across them count for less, and with gaps on both
sides that line must be missed by more, since the course may have moved on. Of
overlapping outliers the largest is accepted; accepted ones are taken out of
the series, and the rest is tested again, until none is found.

Plan: readings are packed by (source, episode, time block) with map-side
collapse of repeated deliveries and written once to the shared folder; the two
passes of statistics and the test read that table. The statistics are mergeable
histograms and sums, sources are never brought together. The flagged messages
are joined back to all readings, so every delivery is reported.

Defined cases: null values and readings without a time take part in the limit
test only; ties in time are ordered by sequence number; a source without any
usual change (it always repeats) has usual change 0, so whatever leaves its
value and returns is a spike; joints without a row in the limits table have no
limits; null limits don't bind; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.operators.blocks import block_numbers, instant_ns, pack_blocks, with_halo
from kinelake.operators.flat import Flat, breaks
from kinelake.session import materialize

FIELDS = ("joint_position", "joint_velocity", "joint_effort")
LIMITS = {
    "joint_position": ("position_lower_limit", "position_upper_limit"),
    "joint_velocity": ("velocity_limit", "velocity_limit"),
    "joint_effort": ("effort_limit", "effort_limit"),
}
KEYS = ["robot_id", "joint_name", "episode_id"]
SOURCE = ["robot_id", "joint_name"]
BLOCK_NS = 3600 * 1_000_000_000
HALO = 48
STUCK_RUN = 16
FACTOR = 10.0
LONGEST = 3
GAP = 2.0
MISFIT = 0.25  # of an outlier's squared size, what its pattern may leave of the residuals
BINS_PER_OCTAVE = 16
ZERO_BIN = -100_000
RARE = 0.05  # a source of whose readings fewer change has usual change 0
BROADCAST_SOURCES = 50_000


def limit_violations(readings: DataFrame, params: DataFrame) -> DataFrame:
    """(reading_id, field_name) of values that are NaN, infinite or outside the limits of their joint."""
    p = params.groupBy(F.col("joint_name").alias("p_joint")).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("position_lower_limit", "position_upper_limit", "velocity_limit", "effort_limit")])
    j = readings.select("reading_id", "joint_name", *FIELDS).join(p, F.col("joint_name") == F.col("p_joint"), "left")

    def bad(field: str):
        low, high = LIMITS[field]
        x = F.col(field)
        below = x < (F.col(low) if low != high else -F.col(low))
        above = x > F.col(high)
        return F.isnan(x) | (F.abs(x) == F.lit(float("inf"))) | F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))

    kinds = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & bad(f), F.lit(f)) for f in FIELDS]))
    return j.select("reading_id", F.explode(kinds).alias("field_name"))


def source_blocks(readings: DataFrame, params: DataFrame) -> DataFrame:
    """Distinct messages packed by (source, episode, block), with halo and the joint's limits."""
    src = readings.select(*KEYS, instant_ns().alias("at"), "seq_no", *FIELDS)
    blocks = with_halo(pack_blocks(src, KEYS, "at", ["seq_no", *FIELDS], BLOCK_NS), KEYS, HALO, FIELDS, block_numbers(src, KEYS, "at", BLOCK_NS))
    low = params.groupBy(F.col("joint_name").alias("p_joint")).agg(
        F.struct(*[F.first(c, ignorenulls=True).alias(c) for c in ("position_lower_limit", "position_upper_limit", "velocity_limit", "effort_limit")]).alias("limits")
    )
    return materialize(blocks.join(low, F.col("joint_name") == F.col("p_joint"), "left").drop("p_joint"))


def _limits(batch: pa.RecordBatch, field: str) -> tuple[np.ndarray, np.ndarray]:
    lim = batch.column(batch.schema.get_field_index("limits"))
    low, high = LIMITS[field]
    up = pa.compute.struct_field(lim, high).to_numpy(zero_copy_only=False).astype(float)
    down = pa.compute.struct_field(lim, low).to_numpy(zero_copy_only=False).astype(float) if low != high else -up
    return np.where(np.isnan(down), -np.inf, down), np.where(np.isnan(up), np.inf, up)


def _messages(batch: pa.RecordBatch) -> tuple[Flat, np.ndarray]:
    """The flat items of a batch, and the places of the distinct messages among them."""
    flat = Flat(batch, ["before", "items", "after"], ["at", "seq_no"], list(FIELDS))
    return flat, np.flatnonzero(breaks(flat.seg, flat["at"], flat["seq_no"]))


def _plausible(flat: Flat, at: np.ndarray, batch: pa.RecordBatch, field: str) -> np.ndarray:
    """Places of the messages whose value is there, finite and within limits."""
    v = flat[field][at]
    low, high = _limits(batch, field)
    s = flat.seg[at]
    with np.errstate(invalid="ignore"):
        return at[np.isfinite(v) & (v >= low[s]) & (v <= high[s])]


def _sources(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of its source within the batch, and of each source one of its rows."""
    names = [batch.column(batch.schema.get_field_index(k)) for k in SOURCE]
    pair = pa.compute.binary_join_element_wise(*[c.fill_null("\x00") for c in names], "\x01").dictionary_encode()
    code = pair.indices.to_numpy(zero_copy_only=False)
    row = np.zeros(len(pair.dictionary), np.int64)
    row[code] = np.arange(batch.num_rows)
    return code, row


def _bins(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.floor(np.log2(np.where(x > 0, x, 1)) * BINS_PER_OCTAVE), ZERO_BIN).astype(np.int64)


def _partial_stats(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Histogram parts (source, field, bin, n, n_all, n_repeat) of the changes, and, as field -1, of the intervals."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, at = _messages(batch)
        code, sample = _sources(batch)
        rows: list[tuple[np.ndarray, ...]] = []

        def count(source: np.ndarray, x: np.ndarray, field: int) -> None:
            key, n = np.unique(source.astype(np.int64) * (1 << 20) + (_bins(x) + (1 << 19)), return_counts=True)
            zero = np.zeros(len(n), np.int64)
            rows.append((key >> 20, np.full(len(n), field), (key & (1 << 20) - 1) - (1 << 19), n, zero, zero))

        s = flat.seg[at]
        mine = (s[1:] == s[:-1]) & (flat.role[at][1:] == 1)
        count(code[s[1:][mine]], np.diff(flat["at"][at])[mine], -1)
        for f, field in enumerate(FIELDS):
            seen = at[~np.isnan(flat[field][at])]
            v, s, own = flat[field][seen], flat.seg[seen], flat.role[seen] == 1
            n_all = np.bincount(code[s[own]], minlength=len(sample))
            n_rep = np.bincount(code[s[1:]][own[1:] & (s[1:] == s[:-1]) & (v[1:] == v[:-1])], minlength=len(sample))
            u = np.flatnonzero(n_all)
            rows.append((u, np.full(len(u), f), np.full(len(u), ZERO_BIN - 1), np.zeros(len(u), np.int64), n_all[u], n_rep[u]))
            k = _plausible(flat, at, batch, field)
            s = flat.seg[k]
            mine = (s[1:] == s[:-1]) & (flat.role[k][1:] == 1)
            count(code[s[1:][mine]], np.abs(np.diff(flat[field][k])[mine]), f)
        yield _by_source(batch, sample, rows, schema)


def _by_source(batch: pa.RecordBatch, sample: np.ndarray, rows: list[tuple[np.ndarray, ...]], schema: pa.Schema) -> pa.RecordBatch:
    col = [np.concatenate(c) for c in zip(*rows)]
    take = pa.array(sample[col[0]])
    out = [batch.column(batch.schema.get_field_index(k)).take(take) for k in SOURCE] + [pa.array(c) for c in col[1:]]
    return pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(out, schema)], schema=schema)


def _series(batch: pa.RecordBatch, flat: Flat, at: np.ndarray, f: int, pace: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one field: the places of its plausible messages, and of each its row, usual change, coefficient and usual interval."""
    models = batch.column(batch.schema.get_field_index("models")).to_pylist()
    usual, phi = (np.array([row[f][k] if row else 0.0 for row in models], float) for k in ("usual", "phi"))
    k = _plausible(flat, at, batch, FIELDS[f])
    s = flat.seg[k]
    return k, s, usual[s], phi[s], pace[s]


def _pace(batch: pa.RecordBatch) -> np.ndarray:
    return np.maximum(np.nan_to_num(batch.column(batch.schema.get_field_index("pace")).to_numpy(zero_copy_only=False).astype(float)), 1.0)


def _partial_regression(batches: Iterator[pa.RecordBatch], schema: pa.Schema, factor: float) -> Iterator[pa.RecordBatch]:
    """Parts (source, field, sxy, sxx) of the regression of a change on the one before, outliers taken out, changes clipped at three usual ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, at = _messages(batch)
        code, sample = _sources(batch)
        pace = _pace(batch)
        rows: list[tuple[np.ndarray, ...]] = []
        for f, field in enumerate(FIELDS):
            k, s, usual, phi, every = _series(batch, flat, at, f, pace)
            keep = ~find_spikes(flat[field][k], flat["at"][k], s, usual, np.zeros(len(k)), factor, every)
            k, s, usual = k[keep], s[keep], usual[keep]
            if len(k) < 3:
                continue
            same = s[1:] == s[:-1]
            d = np.clip(np.where(same, np.diff(flat[field][k]), 0), -3 * usual[1:], 3 * usual[1:])
            both = same[1:] & same[:-1] & (flat.role[k][2:] == 1)
            source = code[s[2:]][both]
            sxy = np.bincount(source, (d[1:] * d[:-1])[both], len(sample))
            sxx = np.bincount(source, (d[:-1] ** 2)[both], len(sample))
            u = np.flatnonzero(sxx)
            rows.append((u, np.full(len(u), f), sxy[u], sxx[u]))
        if rows:
            yield _by_source(batch, sample, rows, schema)


PARTIAL = "robot_id string, joint_name string, field int, bin long, n long, n_all long, n_repeat long"
REGRESSION = "robot_id string, joint_name string, field int, sxy double, sxx double"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def usual_changes(blocks: DataFrame) -> DataFrame:
    """(robot_id, joint_name, pace, models): the usual interval in nanoseconds, and an entry (usual, repeats, phi = 0) for each field, over all readings.

    The bins of a source are few (some hundreds) whatever its size, so the
    arrays of the last aggregation are bounded.
    """
    schema = _arrow(PARTIAL)
    parts = blocks.mapInArrow(lambda it: _partial_stats(it, schema), PARTIAL)
    bins = parts.groupBy(*SOURCE, "field", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "n_all", "n_repeat")])
    per_field = bins.groupBy(*SOURCE, "field").agg(
        F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("bin", "n")))).alias("hist"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("bin") == ZERO_BIN, F.col("n")).otherwise(0)).alias("n_zero"),
        (F.sum("n_repeat") / F.greatest(F.sum("n_all"), F.lit(1))).alias("repeats"),
    )
    # the bin that holds the median change; where most changes are 0, the median of the others, if they aren't rare
    skip = F.when(F.col("n_zero") * 2 <= F.col("n"), F.lit(0)).otherwise(F.col("n_zero"))
    target = skip + (F.col("n") - skip) / 2
    at = F.aggregate(
        "hist",
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("bin")),
        lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.coalesce(acc["bin"], F.when(acc["seen"] + x["n"] >= target, x["bin"])).alias("bin")),
    )["bin"]
    rare = F.col("n") - F.col("n_zero") < F.col("n") * RARE
    usual = F.when(at.isNull() | (at == ZERO_BIN) | rare, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), (at + 0.5) / BINS_PER_OCTAVE))
    of = lambda c, f, other: F.coalesce(F.max(F.when(F.col("field") == f, F.col(c))), F.lit(other)).alias(c)
    fields = [F.struct(of("usual", f, 0.0), of("repeats", f, 1.0), F.lit(0.0).alias("phi")) for f in range(len(FIELDS))]
    return per_field.withColumn("usual", usual).groupBy(*SOURCE).agg(of("usual", -1, 0.0).alias("pace"), F.array(*fields).alias("models"))


def _with_models(blocks: DataFrame, models: DataFrame, few: bool) -> DataFrame:
    m = models.select(*[F.col(k).alias(f"m_{k}") for k in SOURCE], "pace", "models")
    m = F.broadcast(m) if few else m  # one short row a source
    return blocks.join(m, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in SOURCE], "left").drop(*[f"m_{k}" for k in SOURCE])


def source_models(blocks: DataFrame, factor: float = FACTOR) -> tuple[DataFrame, bool]:
    """The table of ``usual_changes`` with the coefficients of the autoregression, and whether its sources are few enough to broadcast."""
    first = materialize(usual_changes(blocks))
    few = first.count() <= BROADCAST_SOURCES
    schema = _arrow(REGRESSION)
    parts = _with_models(blocks, first, few).mapInArrow(lambda it: _partial_regression(it, schema, factor), REGRESSION)
    phi = parts.groupBy(*SOURCE, "field").agg(F.try_divide(F.sum("sxy"), F.sum("sxx")).alias("phi")).groupBy(*SOURCE).agg(F.map_from_entries(F.collect_list(F.struct("field", "phi"))).alias("phi"))
    on = [F.col(f"u.{k}").eqNullSafe(F.col(f"p.{k}")) for k in SOURCE]
    each = F.transform("models", lambda m, i: F.struct(m["usual"].alias("usual"), m["repeats"].alias("repeats"), F.greatest(F.least(F.coalesce(F.try_element_at("phi", i), F.lit(0.0)), F.lit(0.95)), F.lit(-0.9)).alias("phi")))
    both = first.alias("u").join(phi.alias("p"), on, "left").select(*[F.col(f"u.{k}").alias(k) for k in SOURCE], "pace", each.alias("models"))
    return materialize(both), few


def find_stuck(v: np.ndarray, seg: np.ndarray, run: int = STUCK_RUN) -> np.ndarray:
    """True for the values of runs of at least ``run`` equal ones within a segment."""
    if not len(v):
        return np.zeros(0, bool)
    start = np.flatnonzero(breaks(v, seg))
    size = np.diff(np.append(start, len(v)))
    return np.repeat(size >= run, size)


def find_spikes(v: np.ndarray, t: np.ndarray, seg: np.ndarray, usual: np.ndarray, phi: np.ndarray, factor: float = FACTOR, pace: np.ndarray | None = None) -> np.ndarray:
    """True for additive outliers of one to three readings; ``usual``, ``phi`` and ``pace`` (the usual interval) are the source's, for each reading.

    Iterative: accepted outliers are taken out and the rest is tested again.
    Without ``pace`` no interval counts as a gap.
    """
    found = np.zeros(len(v), bool)
    rest = np.arange(len(v))
    pace = np.full(len(v), np.inf) if pace is None else pace
    while True:
        hit = _outliers(*(a[rest] for a in (v, t, seg, usual, phi, pace)), factor)
        if not hit.any():
            return found
        found[rest[hit]] = True
        # only segments in which something was found are tested again
        again = np.isin(seg[rest], np.unique(seg[rest[hit]]))
        rest = rest[again & ~hit]


def _fit(x: np.ndarray, e: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least squares, one small system for each first index: (coefficients, weighted sum of squared rests)."""
    a, b = x * w[:, :, None], (e * w)[:, :, None]
    coef = np.linalg.solve(a.transpose(0, 2, 1) @ a + 1e-12 * np.eye(x.shape[2]), a.transpose(0, 2, 1) @ b)
    return coef[:, :, 0], ((b - a @ coef) ** 2).sum(axis=(1, 2))


def _outliers(v: np.ndarray, t: np.ndarray, seg: np.ndarray, usual: np.ndarray, phi: np.ndarray, pace: np.ndarray, factor: float) -> np.ndarray:
    n = len(v)
    out = np.zeros(n, bool)
    if n < 3:
        return out
    # residuals of the autoregression of changes, and how far an interval is a gap
    same = np.r_[False, seg[1:] == seg[:-1]]
    d = np.where(same, np.diff(v, prepend=v[:1]), 0)
    residual = d.copy()
    residual[1:] -= phi[1:] * d[:-1]
    wide = np.where(same, np.maximum(np.diff(t, prepend=t[:1]) / (GAP * pace), 1), 1)
    usual = np.maximum(usual, 1e-9 * (1 + np.abs(v)) / factor)
    start = np.flatnonzero((np.abs(residual) > 0.5 * factor * usual) & same)
    best = np.zeros(n)
    length = np.zeros(n, np.int64)
    for k in range(1, LONGEST + 1):
        s = start[start + k < n]
        s = s[seg[s + k] == seg[s]]
        if not len(s):
            continue
        each = np.arange(k)
        touched = np.minimum(s[:, None] + np.arange(k + 2), n - 1)
        inside = (s[:, None] + np.arange(k + 2) < n) & (seg[touched] == seg[s][:, None])
        e, weight = np.where(inside, residual[touched], 0), np.where(inside, 1 / wide[touched], 0)
        # an outlier of size w at a reading leaves w, -(1 + phi) w, phi w in the residuals; a level shift w, -phi w
        outlier = np.zeros((len(s), k + 2, k))
        outlier[:, each, each], outlier[:, each + 1, each], outlier[:, each + 2, each] = 1, -(1 + phi[s])[:, None], phi[s][:, None]
        shift = np.zeros((len(s), k + 2, 1))
        shift[:, 0, 0], shift[:, 1, 0] = 1, -phi[s]
        explained = np.zeros(len(s), bool)
        for last in (1, 0):  # the last residual may belong to the next outlier; without gaps the others are enough
            weight[:, -1] *= last
            weight[(weight[:, :-1] < 1).any(axis=1) & (last == 0)] = 0
            size, rest = _fit(outlier, e, weight)
            one_sign = np.abs(np.sign(size).sum(axis=1)) == k
            least = np.abs(size).min(axis=1)
            explained |= one_sign & (least > 0.5 * factor * usual[s]) & (rest < _fit(shift, e, weight)[1]) & (rest < MISFIT * least**2)
        # the exact check: back by more than half, and off the line between the readings before and after, beyond what a gap on both sides explains
        left, right = s - 1, s + k
        share = (t[s[:, None] + each] - t[left][:, None]) / np.maximum(t[right] - t[left], 1)[:, None]
        off = v[s[:, None] + each] - (v[left][:, None] * (1 - share) + v[right][:, None] * share)
        apart = np.minimum(t[s] - t[left], t[right] - t[right - 1]) / pace[s]
        far = np.abs(off).min(axis=1)
        good = explained & (np.abs(np.sign(off).sum(axis=1)) == k) & (np.abs(v[right] - v[left]) < 0.5 * far) & (far > factor * usual[s] * np.maximum(apart - 1, 1))
        better = good & (far > best[s])
        best[s[better]] = far[better]
        length[s[better]] = k
    # of overlapping candidates the largest stands
    order = np.flatnonzero(length)
    order = order[np.argsort(-best[order], kind="stable")]
    taken = np.zeros(n, bool)
    for i in order:
        if not taken[max(0, i - 1) : i + length[i] + 1].any():
            out[i : i + length[i]] = taken[i : i + length[i]] = True
    return out


FLAGGED = "robot_id string, joint_name string, episode_id string, at long, seq_no long, field_name string, kind string"


def _detect(batches: Iterator[pa.RecordBatch], schema: pa.Schema, factor: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, at = _messages(batch)
        models = batch.column(batch.schema.get_field_index("models")).to_pylist()
        pace = _pace(batch)
        parts = []
        for f, field in enumerate(FIELDS):
            repeats = np.array([row[f]["repeats"] if row else 1.0 for row in models], float)
            seen = at[~np.isnan(flat[field][at])]
            stuck = seen[find_stuck(flat[field][seen], flat.seg[seen]) & (repeats[flat.seg[seen]] < 0.5)]
            k, s, usual, phi, every = _series(batch, flat, at, f, pace)
            spike = k[find_spikes(flat[field][k], flat["at"][k], s, usual, phi, factor, every)]
            for places, kind in ((stuck, "stuck"), (spike, "spike")):
                places = places[flat.role[places] == 1]
                if len(places):
                    parts.append((flat.seg[places], flat["at"][places], flat["seq_no"][places], np.full(len(places), field, object), np.full(len(places), kind, object)))
        if parts:
            seg, ts, seq, name, kind = (np.concatenate(c) for c in zip(*parts))
            rows = pa.array(seg)
            out = [batch.column(batch.schema.get_field_index(k)).take(rows) for k in KEYS] + [pa.array(ts), pa.array(seq), pa.array(name), pa.array(kind)]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(out, schema)], schema=schema)


def implausible_messages(readings: DataFrame, params: DataFrame, factor: float = FACTOR) -> DataFrame:
    """(robot_id, joint_name, episode_id, at, seq_no, field_name, kind) of stuck values and spikes, one row a message."""
    blocks = source_blocks(readings, params)
    models, few = source_models(blocks, factor)
    joined = _with_models(blocks, models, few)
    schema = _arrow(FLAGGED)
    return joined.mapInArrow(lambda it: _detect(it, schema, factor), FLAGGED)


def implausible_readings(readings: DataFrame, params: DataFrame, factor: float = FACTOR) -> DataFrame:
    """(reading_id, field_name, kind): every implausible value, second deliveries included; kind is limit, stuck or spike."""
    flagged = implausible_messages(readings, params, factor).alias("f")
    every = readings.select("reading_id", *KEYS, instant_ns().alias("at"), F.coalesce("seq_no", F.lit(-1)).alias("seq_no")).where("at is not null").alias("r")
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"r.{k}")) for k in KEYS] + [F.col("f.at") == F.col("r.at"), F.col("f.seq_no") == F.col("r.seq_no")]
    back = every.join(flagged, on).select("r.reading_id", "f.field_name", "f.kind")
    return back.unionByName(limit_violations(readings, params).withColumn("kind", F.lit("limit")))
