"""Ordered folds and planning on bounded groups: one run, one map or one trajectory a group.

These are the operators whose next step depends on all earlier ones. A group is
one evaluation run, one trajectory or one map, so it is bounded by what a
robot does in one go; groups are spread over the cluster.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_group(df: DataFrame, keys: Sequence[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """applyInPandas with the key columns in front of what ``fold`` returns."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fold(pdf)
        for i, (k, v) in enumerate(zip(keys, key)):
            out.insert(i, k, v)
        return out

    return df.groupBy(*keys).applyInPandas(run, schema)


def grasp_ticks(z: np.ndarray, gap: np.ndarray, still: float = 1e-3, near: float = 0.1, need: int = 3) -> int | None:
    """First index at which an object has risen with the gripper near it for ``need`` frames; standing still keeps the counter, distance resets it."""
    count = 0
    for i in range(1, len(z)):
        if gap[i] >= near:
            count = 0
        elif z[i] - z[i - 1] > still:
            count += 1
            if count >= need:
                return i
    return None


def simplify_path(points: np.ndarray, least: float, turn: float) -> list[int]:
    """Indexes kept: both ends, and nodes farther than ``least`` from the last kept one where the course turns by more than ``turn`` degrees."""
    n = len(points)
    if n <= 2:
        return list(range(n))
    kept = [0]
    for i in range(1, n - 1):
        a, b = points[i] - points[kept[-1]], points[i + 1] - points[i]
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        if na < least or nb == 0:
            continue
        if math.degrees(math.acos(max(-1.0, min(1.0, float(a @ b) / (na * nb))))) > turn:
            kept.append(i)
    return [*kept, n - 1]


def spaced_sample(points: np.ndarray, least: float) -> list[int]:
    """Greedy: a point is taken if it lies at least ``least`` from all taken ones. Taken points are kept in cells of that size, so each test is local."""
    cells: dict[tuple[int, ...], list[int]] = {}
    out = []
    around = [np.array(o) for o in np.ndindex(*(3,) * points.shape[1])]
    for i, p in enumerate(points):
        c = np.floor(p / least).astype(int)
        if all(np.linalg.norm(points[j] - p) >= least for o in around for j in cells.get(tuple(c + o - 1), ())):
            cells.setdefault(tuple(c), []).append(i)
            out.append(i)
    return out


def farthest_points(points: np.ndarray, k: int) -> list[int]:
    """k indexes, each the farthest from those before; the first is index 0, ties go to the smaller index."""
    if not len(points):
        return []
    out, dist = [0], np.linalg.norm(points - points[0], axis=1)
    while len(out) < min(k, len(points)):
        out.append(int(dist.argmax()))
        dist = np.minimum(dist, np.linalg.norm(points - points[out[-1]], axis=1))
    return out


def nearest_order(points: np.ndarray) -> list[int]:
    """Greedy tour from index 0: always on to the nearest point not yet seen."""
    if not len(points):
        return []
    left, out = np.ones(len(points), bool), [0]
    left[0] = False
    while left.any():
        d = np.where(left, np.linalg.norm(points - points[out[-1]], axis=1), np.inf)
        out.append(int(d.argmin()))
        left[out[-1]] = False
    return out


def line_cells(a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int]]:
    """The grid cells of a straight line."""
    (x, y), (x1, y1) = a, b
    dx, dy = abs(x1 - x), -abs(y1 - y)
    sx, sy = (1 if x < x1 else -1), (1 if y < y1 else -1)
    err, out = dx + dy, [(x, y)]
    while (x, y) != (x1, y1):
        e2 = 2 * err
        if e2 >= dy:
            err, x = err + dy, x + sx
        if e2 <= dx:
            err, y = err + dx, y + sy
        out.append((x, y))
    return out


def in_sight(free: np.ndarray, a: tuple[int, int], b: tuple[int, int], cost: np.ndarray | None = None, most: float | None = None) -> bool:
    """Whether every cell of the line is free, no diagonal step passes a blocked corner, and, with a limit, no cell costs more than ``most``. Ends outside the map see nothing."""
    h, w = free.shape
    if not all(0 <= x < w and 0 <= y < h for x, y in (a, b)):
        return False
    line = line_cells(a, b)
    if not all(free[y, x] for x, y in line):
        return False
    if any(x != u and y != v and not (free[y, u] and free[v, x]) for (x, y), (u, v) in zip(line, line[1:])):
        return False
    return cost is None or most is None or all(cost[y, x] <= most for x, y in line)


def shortest_path(free: np.ndarray, start: tuple[int, int], goal: tuple[int, int], cost: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Cheapest way over free cells with eight neighbours, no cutting of corners; empty if there is none."""
    h, w = free.shape
    if not (free[start[1], start[0]] and free[goal[1], goal[0]]):
        return []
    guess = lambda p: math.hypot(p[0] - goal[0], p[1] - goal[1])
    best, back, heap = {start: 0.0}, {}, [(guess(start), start)]
    closed = set()
    while heap:
        _, p = heapq.heappop(heap)
        if p == goal:
            out = [p]
            while p in back:
                p = back[p]
                out.append(p)
            return out[::-1]
        if p in closed:
            continue
        closed.add(p)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                x, y = p[0] + dx, p[1] + dy
                if not (dx or dy) or not (0 <= x < w and 0 <= y < h) or not free[y, x] or not (free[p[1], x] and free[y, p[0]]):
                    continue
                g = best[p] + math.hypot(dx, dy) * (1 + (float(cost[y, x]) if cost is not None else 0.0))
                if g < best.get((x, y), math.inf):
                    best[x, y], back[x, y] = g, p
                    heapq.heappush(heap, (g + guess((x, y)), (x, y)))
    return []


def pull_string(free: np.ndarray, path: list[tuple[int, int]], cost: np.ndarray | None = None, most: float | None = None) -> list[tuple[int, int]]:
    """A path without the nodes that can be seen past: from each kept node on to the farthest one in sight, under the same guards as ``in_sight``."""
    if len(path) < 3:
        return path
    out, i = [path[0]], 0
    while i < len(path) - 1:
        j = len(path) - 1
        while j > i + 1 and not in_sight(free, path[i], path[j], cost, most):
            j -= 1
        out.append(path[j])
        i = j
    return out


def wall_distance(free: np.ndarray) -> np.ndarray:
    """Steps from each cell to the nearest one that isn't free (four neighbours); the border counts as wall."""
    h, w = free.shape
    dist = np.full((h + 2, w + 2), -1)
    walls = np.ones((h + 2, w + 2), bool)
    walls[1:-1, 1:-1] = ~free
    queue = deque(zip(*np.nonzero(walls)))
    dist[walls] = 0
    while queue:
        y, x = queue.popleft()
        for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= a < h + 2 and 0 <= b < w + 2 and dist[a, b] < 0:
                dist[a, b] = dist[y, x] + 1
                queue.append((a, b))
    return dist[1:-1, 1:-1]


def safety_cost(free: np.ndarray, clear: int) -> np.ndarray:
    """0 from ``clear`` steps off the walls on, rising to 1 at them."""
    return np.clip(1 - wall_distance(free) / clear, 0, 1)


def nearest_free(free: np.ndarray, at: tuple[int, int]) -> tuple[int, int] | None:
    """The free cell with the fewest steps from ``at``; None if there is none."""
    h, w = free.shape
    seen, queue = {at}, deque([at])
    while queue:
        x, y = queue.popleft()
        if free[y, x]:
            return x, y
        for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if 0 <= n[0] < w and 0 <= n[1] < h and n not in seen:
                seen.add(n)
                queue.append(n)
    return None


def follow_actions(path: np.ndarray, step: float = 0.25, turn: float = 15.0, heading: float = 0.0) -> list[int]:
    """Discrete actions along a path: 1 forward, 2 left, 3 right, ending in 0."""
    pos, out = np.array(path[0], float), []
    for target in path[1:]:
        for _ in range(10_000):
            gap = np.array(target, float) - pos
            if np.linalg.norm(gap) < step / 2:
                break
            off = (math.degrees(math.atan2(gap[1], gap[0])) - heading + 180) % 360 - 180
            if abs(off) > turn / 2:
                out.append(2 if off > 0 else 3)
                heading += turn if off > 0 else -turn
            else:
                out.append(1)
                pos = pos + step * np.array([math.cos(math.radians(heading)), math.sin(math.radians(heading))])
    return [*out, 0]


def warp_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping of two point series, consecutive equal points dropped."""
    a, b = (x[np.r_[True, (np.diff(x, axis=0) != 0).any(axis=1)]] for x in (a, b))
    row = np.full(len(b) + 1, np.inf)
    row[0] = 0
    for p in a:
        new = np.full(len(b) + 1, np.inf)
        d = np.linalg.norm(b - p, axis=1)
        for j in range(1, len(b) + 1):
            new[j] = d[j - 1] + min(row[j], row[j - 1], new[j - 1])
        row = new
    return float(row[-1])


def ndtw(a: np.ndarray, truth: np.ndarray, radius: float) -> float:
    return math.exp(-warp_distance(a, truth) / (len(truth) * radius))


def ground_plane(points: np.ndarray, tolerance: float, rounds: int = 64, seed: int = 5) -> tuple[np.ndarray, int]:
    """(unit normal and offset, number of inliers) of the plane with the most points near it; seeded."""
    rng, best, most = np.random.default_rng(seed), np.array([0.0, 0.0, 1.0, 0.0]), -1
    if len(points) < 3:
        return best, 0
    for _ in range(rounds):
        p = points[rng.choice(len(points), 3, replace=False)]
        n = np.cross(p[1] - p[0], p[2] - p[0])
        if np.linalg.norm(n) < 1e-12:
            continue
        n = n / np.linalg.norm(n) * (1 if n[2] >= 0 else -1)
        k = int((np.abs(points @ n - p[0] @ n) <= tolerance).sum())
        if k > most:
            best, most = np.array([*n, -(p[0] @ n)]), k
    return best, most


def compress_chains(edges: list[tuple[object, object]]) -> list[tuple[object, object, int]]:
    """(from, to, steps) of a graph whose nodes with exactly two neighbours are passed over; a ring of such nodes is kept at its least node.

    Undirected; repeated edges and loops count once. The result is sorted.
    """
    near: dict[object, set] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    ends = {n for n, k in near.items() if len(k) != 2}
    seen: set[tuple[object, object]] = set()
    out = []

    def walk(start: object, step: object) -> tuple[object, int]:
        last, here, n = start, step, 1
        seen.add((start, step))
        while here not in ends and here != start:
            last, here = here, next(k for k in near[here] if k != last)
            seen.add((last, here))
            n += 1
        seen.add((here, last))
        return here, n

    for a in sorted(ends):
        for b in sorted(near[a]):
            if (a, b) not in seen:
                end, n = walk(a, b)
                out.append((min(a, end), max(a, end), n))
    for a in sorted(set(near) - ends):  # rings
        b = min(near[a])
        if not any((a, k) in seen or (k, a) in seen for k in near[a]):
            out.append((a, a, walk(a, b)[1]))
    return sorted(out)


def place_rectangles(sizes: list[tuple[float, float]], room: tuple[float, float], gap: float, seed: int, tries: int = 200) -> list[tuple[float, float] | None]:
    """A seeded layout: each rectangle (width, depth), the largest first, at the first random place within the room where it keeps ``gap`` to all before it; None where ``tries`` places don't do."""
    rng = np.random.default_rng(seed)
    out: list[tuple[float, float] | None] = [None] * len(sizes)
    put: list[tuple[float, float, float, float]] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k][0] * sizes[k][1], k)):
        w, h = sizes[i]
        for _ in range(tries):
            x, y = rng.uniform(0, 1, 2) * (np.array(room) - (w, h))
            if x < 0 or y < 0:
                break
            if all(x >= a + c + gap or a >= x + w + gap or y >= b + e + gap or b >= y + h + gap for a, b, c, e in put):
                put.append((x, y, w, h))
                out[i] = (float(x), float(y))
                break
    return out


def assign_shapes(wanted: list[set], have: list[object]) -> list[object] | None:
    """An instance of its own for each wanted shape, which names the instances that it accepts; the first assignment in order, None if there is none. Recursive search over the few shapes of a scene."""

    def search(i: int, used: frozenset) -> list[object] | None:
        if i == len(wanted):
            return []
        for h in have:
            if h in wanted[i] and h not in used:
                rest = search(i + 1, used | {h})
                if rest is not None:
                    return [h, *rest]
        return None

    return search(0, frozenset())
