"""3-vectors, rotations and quaternions as Column expressions, unrolled so that they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Quaternion = tuple[Column, Column, Column, Column]


def let(values: Sequence[Column], body: Callable[[list[Column]], Column]) -> Column:
    """body over values that are computed once, whatever number of times it uses them."""
    return F.transform(F.array(F.array(*values)), lambda a: body([a[k] for k in range(len(values))]))[0]


def joint(flat: Column, k: int) -> Vector:
    """Joint k of a flat array x0, y0, z0, x1, ... as doubles."""
    return tuple(flat[3 * k + i].cast("double") for i in range(3))


def vector(x, y, z) -> Vector:
    return F.lit(x), F.lit(y), F.lit(z)


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vector, k: Column) -> Vector:
    return tuple(x * k for x in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    """F-24."""
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    """Null components for a zero vector."""
    n = norm(a)
    return tuple(F.try_divide(x, n) for x in a)


def flat(vectors: Sequence[Vector]) -> Column:
    return F.array(*[x for v in vectors for x in v])


def each_joint(flat: Column, n: int, body: Callable[[Vector], Vector]) -> Column:
    """body of each of the first n joints, as a flat array; short code for long bodies."""
    at = lambda k, i: F.get(flat, 3 * k + i).cast("double")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array(*body((at(k, 0), at(k, 1), at(k, 2))))))


def clip(x: Column, low: float, high: float) -> Column:
    """F-23."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def swap_yz(a: Vector) -> Vector:
    """F-30."""
    return a[0], a[2], a[1]


def shortest_rotation(a: Vector, b: Vector) -> tuple[Vector, Vector, Vector]:
    """V-13: rows of the rotation that takes unit a to unit b: I + K + K^2 (1 - c) / s^2; identity where s < 1e-7."""
    v, c = cross(a, b), dot(a, b)
    s2 = dot(v, v)
    near = F.sqrt(s2) < 1e-7
    k = F.when(near, F.lit(0.0)).otherwise(F.try_divide(1 - c, s2))
    zero = F.lit(0.0)
    skew = ((zero, -v[2], v[1]), (v[2], zero, -v[0]), (-v[1], v[0], zero))
    rows = []
    for i in range(3):
        row = []
        for j in range(3):
            square = v[i] * v[j] - (s2 if i == j else zero)
            value = F.lit(1.0 if i == j else 0.0) + skew[i][j] + square * k
            row.append(F.when(near, F.lit(1.0 if i == j else 0.0)).otherwise(value))
        rows.append(tuple(row))
    return tuple(rows)


def rotate(rows: Sequence[Vector], v: Vector) -> Vector:
    """Matrix, given by its rows, times vector."""
    return tuple(dot(r, v) for r in rows)


def quaternion_multiply(a: Quaternion, b: Quaternion) -> Quaternion:
    """V-27: Hamilton product, scalar first."""
    av, bv = a[1:], b[1:]
    v = add(add(scale(bv, a[0]), scale(av, b[0])), cross(av, bv))
    return (a[0] * b[0] - dot(av, bv), *v)


def quaternion_inverse(q: Quaternion) -> Quaternion:
    """V-27, of a unit quaternion."""
    return q[0], -q[1], -q[2], -q[3]


def quaternion_rotate(q: Quaternion, v: Vector) -> Vector:
    """V-27: v + 2 (w (u x v) + u x (u x v))."""
    u = q[1:]
    uv = cross(u, v)
    return add(v, scale(add(scale(uv, q[0]), cross(u, uv)), F.lit(2.0)))


def quaternion_between(a: Vector, b: Vector) -> Quaternion:
    """V-27: the unit quaternion that turns a to b."""
    w = F.sqrt(dot(a, a) * dot(b, b)) + dot(a, b)
    v = cross(a, b)
    n = F.sqrt(w * w + dot(v, v))
    return tuple(F.try_divide(x, n) for x in (w, *v))


def quaternion_six(q: Quaternion) -> tuple[Column, ...]:
    """V-27: first two columns of the rotation matrix."""
    w, x, y, z = q
    return (1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y), 2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x))
