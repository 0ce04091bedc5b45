"""Column functions of boxes, axes, rotations and cameras. A box is columns ``{side}min_x`` ... ``{side}max_z``."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
Vector = tuple[Column, Column, Column]


def extent(side: str, axis: str) -> Column:
    return F.col(f"{side}max_{axis}") - F.col(f"{side}min_{axis}")


def overlap(axis: str, left: str = "a_", right: str = "b_") -> Column:
    """What two boxes share on an axis; the separation, negative, where they are apart."""
    return F.least(f"{left}max_{axis}", f"{right}max_{axis}") - F.greatest(f"{left}min_{axis}", f"{right}min_{axis}")


def volume(side: str) -> Column:
    return extent(side, "x") * extent(side, "y") * extent(side, "z")


def common_volume(left: str = "a_", right: str = "b_") -> Column:
    parts = [F.greatest(overlap(a, left, right), F.lit(0.0)) for a in AXES]
    return parts[0] * parts[1] * parts[2]


def extent_ratio(left: str = "a_", right: str = "b_") -> Column:
    """The least ratio of the smaller to the larger extent on an axis: 1 where both are flat, null where only one is."""
    ratios = []
    for axis in AXES:
        small, large = F.least(extent(left, axis), extent(right, axis)), F.greatest(extent(left, axis), extent(right, axis))
        ratios.append(F.when(large == 0, 1.0).when(small > 0, small / large))
    known = ratios[0].isNotNull() & ratios[1].isNotNull() & ratios[2].isNotNull()
    return F.when(known, F.least(*ratios))


def directed(side: str, axis: str, sign: int = 1) -> tuple[Column, Column]:
    """A box's low and high end along a signed axis, so that larger is further that way."""
    low, high = F.col(f"{side}min_{axis}"), F.col(f"{side}max_{axis}")
    return (low, high) if sign > 0 else (-high, -low)


def cross_axes(axis: str) -> list[str]:
    return [a for a in AXES if a != axis]


def contains(outer: str, inner: str) -> Column:
    tests = [(F.col(f"{outer}min_{a}") <= F.col(f"{inner}min_{a}")) & (F.col(f"{inner}max_{a}") <= F.col(f"{outer}max_{a}")) for a in AXES]
    return tests[0] & tests[1] & tests[2]


def intersects(left: str, right: str) -> Column:
    tests = [overlap(a, left, right) >= 0 for a in AXES]
    return tests[0] & tests[1] & tests[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def inner(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    terms = [x * y for x, y in zip(a, b, strict=True)]
    return sum(terms[1:], terms[0])


def conjugate(q: tuple[Column, ...]) -> tuple[Column, ...]:
    return -q[0], -q[1], -q[2], q[3]


def normalized(q: tuple[Column, ...]) -> tuple[Column, ...]:
    """Null where the length is zero."""
    n = F.sqrt(inner(q, q))
    return tuple(F.when(n > 0, x / n) for x in q)


def rotated(q: tuple[Column, ...], v: Vector) -> Vector:
    """A vector turned by a unit quaternion (x, y, z, w)."""
    axis = (q[0], q[1], q[2])
    t = tuple(2 * x for x in cross(axis, v))
    u = cross(axis, t)
    return tuple(a + q[3] * b + c for a, b, c in zip(v, t, u, strict=True))


#: Above this cosine of half the angle a straight blend stands for the arc.
NEARLY_EQUAL = 0.9995


def slerp(a: tuple[Column, ...], b: tuple[Column, ...], share: Column) -> tuple[Column, ...]:
    """Between two unit quaternions along the shorter arc; of nearly equal ones a straight blend; of unit length."""
    turn = F.when(inner(a, b) < 0, -1.0).otherwise(1.0)
    b = tuple(x * turn for x in b)
    dot = F.least(inner(a, b), F.lit(1.0))
    angle = F.acos(dot)
    near = dot > NEARLY_EQUAL
    wa = F.when(near, 1 - share).otherwise(F.sin((1 - share) * angle) / F.sin(angle))
    wb = F.when(near, share).otherwise(F.sin(share * angle) / F.sin(angle))
    return normalized(tuple(wa * x + wb * y for x, y in zip(a, b, strict=True)))


@dataclass(frozen=True)
class Camera:
    """Focal lengths and principal point, the image's size, and ``kind``: pinhole with radial and tangential distortion ``k`` (k1 k2 p1 p2
    k3 k4 k5 k6, the last three a denominator), fisheye (k1 to k4, odd powers of the angle to the axis) or unified (``xi``; k1 k2 p1
    p2). Missing coefficients are zero."""

    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int
    kind: str = "pinhole"
    k: tuple[float, ...] = ()
    xi: float = 0.0

    def widest(self) -> float:
        """The angle at which a fisheye's radius stops growing: beyond it two directions would share a pixel."""
        k1, k2, k3, k4 = (*self.k, *[0.0] * 4)[:4]
        growth = lambda t: 1 + t * t * (3 * k1 + t * t * (5 * k2 + t * t * (7 * k3 + t * t * 9 * k4)))
        steps = [math.pi * i / 4096 for i in range(4097)]
        past = next((i for i, t in enumerate(steps) if growth(t) <= 0), None)
        if past is None:
            return math.pi
        low, high = steps[past - 1], steps[past]
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if growth(middle) > 0 else (low, middle)
        return low


#: Directions this near to the edge of a camera's domain, in the cosine of their angle, are outside.
MARGIN = 1e-9


def _bent(x: Column, y: Column, k: tuple[float, ...], radial: Column) -> tuple[Column, Column]:
    p1, p2 = k[2], k[3]
    r2 = x * x + y * y
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def project(camera: Camera, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(u, v, stage) of a point in the camera's frame: outside_domain (no pixel), outside_image, or inside. The image reaches from
    -0.5, included, to its size less 0.5, excluded, about the pixels' centres."""
    reach = F.sqrt(x * x + y * y + z * z)
    k = (*camera.k, *[0.0] * 8)[:8]
    if camera.kind == "pinhole":
        ahead = z > MARGIN * reach
        xn, yn = x / z, y / z
        r2 = xn * xn + yn * yn
        radial = (1 + r2 * (k[0] + r2 * (k[1] + r2 * k[4]))) / (1 + r2 * (k[5] + r2 * (k[6] + r2 * k[7])))
        xd, yd = _bent(xn, yn, k, radial) if camera.k else (xn, yn)
    elif camera.kind == "fisheye":
        rho = F.hypot(x, y)
        theta = F.atan2(rho, z)
        ahead = (reach > 0) & (theta < camera.widest())
        t2 = theta * theta
        bent = theta * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))
        scale = F.when(rho > 0, bent / rho).otherwise(0.0)
        xd, yd = scale * x, scale * y
    elif camera.kind == "unified":
        least = -min(camera.xi, 1 / camera.xi) if camera.xi > 0 else 0.0
        ahead = z > (least + MARGIN) * reach
        depth = z + camera.xi * reach
        xn, yn = x / depth, y / depth
        r2 = xn * xn + yn * yn
        xd, yd = _bent(xn, yn, k, 1 + k[0] * r2 + k[1] * r2 * r2)
    else:
        raise ValueError(f"no camera of the kind {camera.kind!r}")
    u, v = F.when(ahead, camera.fx * xd + camera.cx), F.when(ahead, camera.fy * yd + camera.cy)
    inside = (u >= -0.5) & (u < camera.width - 0.5) & (v >= -0.5) & (v < camera.height - 0.5)
    return u, v, F.when(~ahead, "outside_domain").when(inside, "inside").otherwise("outside_image")


def unproject(camera: Camera, u: Column, v: Column, rounds: int = 20) -> Vector:
    """The direction of a pixel, of unit length, of cameras without tangential or with mild distortion: the distortion is undone
    by as many rounds of fixed-point iteration, all in column expressions of the few pixels asked for."""
    xd, yd = (u - camera.cx) / camera.fx, (v - camera.cy) / camera.fy
    if camera.kind != "pinhole":
        raise ValueError("only pinhole cameras")
    k = (*camera.k, *[0.0] * 8)[:8]
    point = F.struct(xd.alias("x"), yd.alias("y"))
    if camera.k:
        def step(s: Column, _: Column) -> Column:
            x, y = s["x"], s["y"]
            r2 = x * x + y * y
            radial = (1 + r2 * (k[0] + r2 * (k[1] + r2 * k[4]))) / (1 + r2 * (k[5] + r2 * (k[6] + r2 * k[7])))
            return F.struct(((xd - 2 * k[2] * x * y - k[3] * (r2 + 2 * x * x)) / radial).alias("x"), ((yd - k[2] * (r2 + 2 * y * y) - 2 * k[3] * x * y) / radial).alias("y"))

        point = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), point, step)
    x, y = point["x"], point["y"]
    n = F.sqrt(x * x + y * y + 1)
    return x / n, y / n, 1 / n


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used: it is bound to a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def eigenvector(m: dict[str, Column], value: Column) -> Vector:
    """The unit eigenvector of a symmetric 3x3 matrix (``xx`` ... ``yz``) for a simple eigenvalue: the longest cross product of two rows
    of the matrix less the eigenvalue, of equals the first, its largest component positive; null where there is none."""

    def products(l: Column) -> Column:  # noqa: E741
        rows = [(m["xx"] - l, m["xy"], m["xz"]), (m["xy"], m["yy"] - l, m["yz"]), (m["xz"], m["yz"], m["zz"] - l)]
        each = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
        return F.array(*[F.struct(*[c.alias(a) for c, a in zip(v, AXES, strict=True)]) for v in each])

    of = lambda s: (s["x"], s["y"], s["z"])
    pack = lambda v, **more: F.struct(*[c.alias(a) for c, a in zip(v, AXES, strict=True)], *[c.alias(n) for n, c in more.items()])
    sized = F.transform(let(value, products), lambda c: pack(of(c), s=inner(of(c), of(c))))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in (*AXES, "s")])
    longest = F.aggregate(sized, zero, lambda a, b: F.when(b["s"] > a["s"], b).otherwise(a))
    found = let(longest, lambda v: F.when(v["s"] > 0, pack(tuple(x / F.sqrt(v["s"]) for x in of(v)))))
    found = let(found, lambda v: pack(canonical(of(v))))
    return found["x"], found["y"], found["z"]


def canonical(v: Vector) -> Vector:
    """An axis with its largest component, of equals the first, positive."""
    sizes = [F.abs(x) for x in v]
    largest = F.greatest(*sizes)
    lead = F.when(sizes[0] == largest, v[0]).when(sizes[1] == largest, v[1]).otherwise(v[2])
    sign = F.when(lead < 0, -1.0).otherwise(1.0)
    return v[0] * sign, v[1] * sign, v[2] * sign
