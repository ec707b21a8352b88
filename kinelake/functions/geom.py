"""Geometry as JVM expressions on tuples of columns: no UDF, so it stays within whole-stage code.

A vector is (x, y, z), a quaternion (w, x, y, z), a rotation three rows of
three, a pose (rotation, translation). Every function takes and returns Columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]
Quat = Sequence[Column]
Rot = Sequence[Sequence[Column]]
Pose = tuple[Rot, Vec]


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, col(low)), col(high))


def dot(a: Vec, b: Vec) -> Column:
    out = col(a[0]) * col(b[0])
    for p, q in zip(a[1:], b[1:]):
        out = out + col(p) * col(q)
    return out


def cross(a: Vec, b: Vec) -> Vec:
    a, b = [col(v) for v in a], [col(v) for v in b]
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def add(a: Vec, b: Vec) -> Vec:
    return tuple(col(p) + col(q) for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(col(p) - col(q) for p, q in zip(a, b))


def scale(a: Vec, s) -> Vec:
    return tuple(col(p) * col(s) for p in a)


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def unit(a: Vec) -> Vec:
    n = norm(a)
    return tuple(F.try_divide(col(p), n) for p in a)


def axis_vector(name: str) -> tuple[float, float, float]:
    """'x', '-y', ... as a unit vector."""
    sign = -1.0 if name.startswith("-") else 1.0
    letter = name.lstrip("+-").lower()
    if letter not in ("x", "y", "z"):
        raise ValueError(f"no axis: {name!r}")
    return tuple(sign if c == letter else 0.0 for c in "xyz")


def angle_between(a: Vec, b: Vec) -> Column:
    """Angle in degrees; the cosine is clipped to [-1, 1]."""
    return F.degrees(F.acos(clip(F.try_divide(dot(a, b), norm(a) * norm(b)), -1, 1)))


# quaternions


def q_normalize(q: Quat) -> Quat:
    n = F.sqrt(dot(q, q))
    return tuple(F.try_divide(col(c), n) for c in q)


def q_multiply(a: Quat, b: Quat) -> Quat:
    aw, ax, ay, az = (col(c) for c in a)
    bw, bx, by, bz = (col(c) for c in b)
    return (
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )


def q_conjugate(q: Quat) -> Quat:
    return (col(q[0]), -col(q[1]), -col(q[2]), -col(q[3]))


def q_inverse(q: Quat) -> Quat:
    n = dot(q, q)
    return tuple(F.try_divide(c, n) for c in q_conjugate(q))


def q_rotate(q: Quat, v: Vec) -> Vec:
    """The vector turned by a unit quaternion."""
    u = q[1:]
    t = scale(cross(u, v), 2)
    return add(add(v, scale(t, q[0])), cross(u, t))


def q_angle(a: Quat, b: Quat) -> Column:
    """Angle in degrees between two orientations (unit quaternions)."""
    return F.degrees(2 * F.acos(clip(F.abs(dot(a, b)), 0, 1)))


def q_slerp(a: Quat, b: Quat, t) -> Quat:
    """Shortest-path interpolation; linear where the two nearly coincide."""
    d = dot(a, b)
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    c = clip(F.abs(d), 0, 1)
    theta = F.acos(c)
    s = F.sin(theta)
    near = c > 0.9995
    wa = F.when(near, 1 - col(t)).otherwise(F.try_divide(F.sin((1 - col(t)) * theta), s))
    wb = F.when(near, col(t)).otherwise(F.try_divide(F.sin(col(t) * theta), s)) * sign
    return q_normalize(tuple(wa * col(p) + wb * col(q) for p, q in zip(a, b)))


def q_yaw(q: Quat) -> Column:
    """Turn about z in degrees."""
    w, x, y, z = (col(c) for c in q)
    return F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))


def q_matrix(q: Quat) -> Rot:
    w, x, y, z = (col(c) for c in q)
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def matrix_q(m: Rot) -> Quat:
    """Unit quaternion with w >= 0 of a rotation."""
    half = lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) / 2
    w = half(1 + m[0][0] + m[1][1] + m[2][2])
    x, y, z = half(1 + m[0][0] - m[1][1] - m[2][2]), half(1 - m[0][0] + m[1][1] - m[2][2]), half(1 - m[0][0] - m[1][1] + m[2][2])
    sign = lambda a, b: F.when(a < b, -1.0).otherwise(1.0)
    return (w, x * sign(m[2][1], m[1][2]), y * sign(m[0][2], m[2][0]), z * sign(m[1][0], m[0][1]))


def wrap_degrees(a: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(a + 180, F.lit(360.0)) - 180


def euler_xyz(m: Rot) -> Vec:
    """Angles in degrees of the extrinsic x, y, z turns."""
    return (F.degrees(F.atan2(m[2][1], m[2][2])), F.degrees(F.asin(clip(-m[2][0], -1, 1))), F.degrees(F.atan2(m[1][0], m[0][0])))


def euler_yzx(m: Rot) -> Vec:
    """Angles in degrees of the extrinsic y, z, x turns: m = Rx(c) Rz(b) Ry(a)."""
    return (F.degrees(F.atan2(m[0][2], m[0][0])), F.degrees(F.asin(clip(-m[0][1], -1, 1))), F.degrees(F.atan2(m[2][1], m[1][1])))


# rotations and poses


def m_transpose(m: Rot) -> Rot:
    return tuple(tuple(m[j][i] for j in range(3)) for i in range(3))


def m_apply(m: Rot, v: Vec) -> Vec:
    return tuple(dot(row, v) for row in m)


def m_multiply(a: Rot, b: Rot) -> Rot:
    bt = m_transpose(b)
    return tuple(tuple(dot(row, c) for c in bt) for row in a)


def m_angle(a: Rot, b: Rot) -> Column:
    """Angle in degrees between two rotations."""
    trace = dot(a[0], b[0]) + dot(a[1], b[1]) + dot(a[2], b[2])
    return F.degrees(F.acos(clip((trace - 1) / 2, -1, 1)))


def pose_compose(a: Pose, b: Pose) -> Pose:
    return m_multiply(a[0], b[0]), add(m_apply(a[0], b[1]), a[1])


def pose_inverse(p: Pose) -> Pose:
    back = m_transpose(p[0])
    return back, scale(m_apply(back, p[1]), -1)


def pose_relative(frame: Pose, p: Pose) -> Pose:
    """p as seen from ``frame``."""
    return pose_compose(pose_inverse(frame), p)


def pose_difference(a: Pose, b: Pose) -> tuple[Column, Column]:
    """(metres, degrees)."""
    return distance(a[1], b[1]), m_angle(a[0], b[0])


def transform_point(p: Pose, v: Vec) -> Vec:
    return add(m_apply(p[0], v), p[1])


# cameras


def project(point: Vec, fx, fy, cx, cy) -> tuple[Column, Column]:
    """Pixel of a point in the camera's frame; null on or behind the image plane."""
    x, y, z = point
    front = z > 0
    return F.when(front, col(fx) * x / z + col(cx)), F.when(front, col(fy) * y / z + col(cy))


def back_project(u, v, depth, fx, fy, cx, cy) -> Vec:
    """Point in the camera's frame of a pixel with a depth."""
    d = col(depth)
    return ((col(u) - col(cx)) * d / col(fx), (col(v) - col(cy)) * d / col(fy), d)


# boxes, segments, planes of two dimensions


def in_box(p: Vec, low: Vec, high: Vec) -> Column:
    out = F.lit(True)
    for c, a, b in zip(p, low, high):
        out = out & (c >= col(a)) & (c <= col(b))
    return out


def scaled_box(low: Vec, high: Vec, factor) -> tuple[Vec, Vec]:
    """A box scaled about its centre."""
    mid = [(col(a) + col(b)) / 2 for a, b in zip(low, high)]
    half = [(col(b) - col(a)) / 2 * col(factor) for a, b in zip(low, high)]
    return tuple(m - h for m, h in zip(mid, half)), tuple(m + h for m, h in zip(mid, half))


def box_of_rotated(centre: Vec, size: Vec, m: Rot) -> tuple[Vec, Vec]:
    """The axis-parallel box around a turned one: its half extents are |R| times the halves."""
    half = [sum((F.abs(m[i][j]) * col(size[j]) / 2 for j in range(1, 3)), F.abs(m[i][0]) * col(size[0]) / 2) for i in range(3)]
    return tuple(col(c) - h for c, h in zip(centre, half)), tuple(col(c) + h for c, h in zip(centre, half))


def overlap_1d(a0, a1, b0, b1) -> Column:
    return F.greatest(F.least(col(a1), col(b1)) - F.greatest(col(a0), col(b0)), F.lit(0.0))


def rect_iou(a: Vec, b: Vec) -> Column:
    """Intersection over union of (x0, y0, x1, y1) rectangles; 0 for two without area."""
    inter = overlap_1d(a[0], a[2], b[0], b[2]) * overlap_1d(a[1], a[3], b[1], b[3])
    area = lambda r: (col(r[2]) - col(r[0])) * (col(r[3]) - col(r[1]))
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0))


def segment_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """Distance of a point from a segment."""
    d = sub(b, a)
    t = clip(F.coalesce(F.try_divide(dot(sub(p, a), d), dot(d, d)), F.lit(0.0)), 0, 1)
    return distance(p, add(a, scale(d, t)))


def segment_hits_box(a: Vec, b: Vec, low: Vec, high: Vec) -> Column:
    """Slab test: the segment meets the box."""
    t0, t1, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q, lo, hi in zip(a, b, low, high):
        p, d = col(p), col(q) - col(p)
        flat = F.abs(d) < 1e-12
        first = F.try_divide(F.when(d >= 0, col(lo)).otherwise(col(hi)) - p, d)
        last = F.try_divide(F.when(d >= 0, col(hi)).otherwise(col(lo)) - p, d)
        inside = inside & (~flat | ((p >= col(lo)) & (p <= col(hi))))
        t0 = F.when(flat, t0).otherwise(F.greatest(t0, first))
        t1 = F.when(flat, t1).otherwise(F.least(t1, last))
    return inside & (t0 <= t1)


def rotate_2d(x, y, degrees) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(col(degrees))), F.sin(F.radians(col(degrees)))
    return col(x) * c - col(y) * s, col(x) * s + col(y) * c


def rectangle_corners(cx, cy, w, h, degrees) -> list[tuple[Column, Column]]:
    out = []
    for sx, sy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
        x, y = rotate_2d(col(w) * sx, col(h) * sy, degrees)
        out.append((x + col(cx), y + col(cy)))
    return out


def rectangles_separate(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]]) -> Column:
    """Separating-axis test of two convex polygons: some edge's normal tells them apart."""
    out = F.lit(False)
    for poly in (a, b):
        for i in range(len(poly)):
            (x0, y0), (x1, y1) = poly[i], poly[(i + 1) % len(poly)]
            nx, ny = y0 - y1, x1 - x0
            pa, pb = [x * nx + y * ny for x, y in a], [x * nx + y * ny for x, y in b]
            out = out | (F.greatest(*pa) < F.least(*pb)) | (F.greatest(*pb) < F.least(*pa))
    return out


def in_polygon(x, y, polygon: Sequence[tuple[float, float]]) -> Column:
    """Ray casting: an odd number of edges lies to the right."""
    odd = F.lit(0)
    n = len(polygon)
    for i in range(n):
        (x0, y0), (x1, y1) = polygon[i], polygon[(i + 1) % n]
        if y0 == y1:
            continue
        crosses = ((col(y) >= min(y0, y1)) & (col(y) < max(y0, y1))) & (col(x) < (col(y) - y0) * ((x1 - x0) / (y1 - y0)) + x0)
        odd = odd + F.when(crosses, 1).otherwise(0)
    return odd % 2 == 1


def azimuth_elevation(v: Vec) -> tuple[Column, Column]:
    """Degrees about z from x, and above the xy plane."""
    return F.degrees(F.atan2(v[1], v[0])), F.degrees(F.asin(clip(F.try_divide(v[2], norm(v)), -1, 1)))


def grid_cell(x, y, x_min, y_max, resolution) -> tuple[Column, Column]:
    """Column and row of a point on a grid whose y axis is flipped; truncated towards zero."""
    return ((col(x) - x_min) / resolution).cast("int"), ((col(y_max) - col(y)) / resolution).cast("int")


def piecewise(x: Column, edges: Sequence[float], slopes: Sequence[float]) -> Column:
    """Continuous score of linear pieces; the offsets are worked out here, the chain runs in the JVM."""
    offset, out = 0.0, F.lit(None).cast("double")
    for (a, b), k in zip(zip(edges, edges[1:]), slopes):
        out = F.coalesce(out, F.when((x >= a) & (x <= b), (x - a) * k + offset))
        offset += (b - a) * k
    return out


def lerp(a, b, t) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def log_lerp(a, b, t) -> Column:
    return F.exp(lerp(F.log(col(a)), F.log(col(b)), t))


def interpolation_steps(metres: Column, degrees: Column, step_m: float, step_deg: float) -> Column:
    """Number of poses between two poses, two at least."""
    return F.greatest(F.ceil(metres / step_m), F.ceil(degrees / step_deg), F.lit(2)).cast("int")


SH_C0 = 0.28209479177387814  # fixed value: the constant of the zeroth spherical harmonic


def rgb_to_sh(c) -> Column:
    return (col(c) - 0.5) / SH_C0


def sh_to_rgb(c) -> Column:
    return col(c) * SH_C0 + 0.5
