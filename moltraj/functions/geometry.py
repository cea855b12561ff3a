"""Vector arithmetic as SQL expression text over plain double columns.

A vector is three expressions. Text keeps building a plan cheap, and plain doubles keep it inside whole-stage code
generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltraj.schema import VIRTUAL_CB

Vector = tuple[str, str, str]
AXES = ("x", "y", "z")


def vector(prefix: str) -> Vector:
    return f"{prefix}_x", f"{prefix}_y", f"{prefix}_z"


def named(prefix: str, value: Vector) -> dict[str, str]:
    return {f"{prefix}_{axis}": part for axis, part in zip(AXES, value, strict=True)}


def with_expressions(df: DataFrame, new: dict[str, str]) -> DataFrame:
    """Add or replace columns given as SQL text, in one projection."""
    return df.withColumns({name: F.expr(text) for name, text in new.items()})


def gather(points: str, index: str) -> Vector:
    """Coordinates of one point of an array<struct<x,y,z>>, never NULL: an absent point is NaN.

    Non-null columns keep the generated arithmetic small enough to be compiled; whether a point exists is decided
    from its index, so NaN coordinates in the data are not mistaken for absent points.
    """
    return tuple(f"coalesce(CAST(get({points}, {index}).{axis} AS DOUBLE), DOUBLE('NaN'))" for axis in AXES)


def plus(*vectors: Vector) -> Vector:
    return tuple("(" + " + ".join(parts) + ")" for parts in zip(*vectors, strict=True))


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(f"({p} - {q})" for p, q in zip(a, b, strict=True))


def times(a: Vector, factor: str | float) -> Vector:
    text = f"DOUBLE('{factor!r}')" if isinstance(factor, float) else factor
    return tuple(f"({p} * {text})" for p in a)


def dot(a: Vector, b: Vector) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"


def cross(a: Vector, b: Vector) -> Vector:
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def length(a: Vector) -> str:
    return f"sqrt({dot(a, a)})"


# The backbone walk whose consecutive bonds carry phi, psi and omega: C before, N, CA, C, N after, CA after.
WALK = ("cp", "n", "ca", "c", "nn", "can")
# Each torsion is seen along one bond of the walk, counted from 1 = (cp, n).
TORSION_AXIS = {"phi": 2, "psi": 3, "omega": 4}


def with_backbone(df: DataFrame, defined: dict[str, str], has_cb: str, has_arms: str) -> DataFrame:
    """Add phi, psi, omega as sine and cosine and replace cb_* by the real, virtual or fallback C-beta.

    The three torsions and the virtual C-beta share bonds and bond normals, so each is computed once, in short
    projections that stay within one compiled stage. With bonds u, v, w around an axis v, cosine and sine are
    proportional to (u x v).(v x w) and |v| u.(v x w). Atoms that coincide on the axis leave only u and w.
    """
    steps = list(zip(WALK, WALK[1:], strict=False))
    bonds, normals, parts = {}, {}, {}
    for i, (start, stop) in enumerate(steps, 1):
        bonds |= named(f"_b{i}", minus(vector(stop), vector(start)))
    for i in range(1, len(steps)):
        normals |= named(f"_n{i}", cross(vector(f"_b{i}"), vector(f"_b{i + 1}")))
    for name, i in TORSION_AXIS.items():
        before, axis, after = vector(f"_b{i - 1}"), vector(f"_b{i}"), vector(f"_b{i + 1}")
        near, far = vector(f"_n{i - 1}"), vector(f"_n{i}")
        parts[f"_{name}_x"] = f"if({length(axis)} < 1e-8, -{dot(before, after)}, {dot(near, far)})"
        parts[f"_{name}_y"] = f"{length(axis)} * {dot(before, far)}"
    reach = {f"_{name}_r": f"sqrt(_{name}_x * _{name}_x + _{name}_y * _{name}_y)" for name in TORSION_AXIS}

    final = {}
    for name in TORSION_AXIS:
        x, y, r, ok = f"_{name}_x", f"_{name}_y", f"_{name}_r", defined[name]
        final[f"{name}_sin"] = f"if(NOT {ok} OR {r} = 0, 0D, {y} / {r})"
        final[f"{name}_cos"] = f"CASE WHEN NOT {ok} THEN 0D WHEN {r} = 0 THEN 1D ELSE {x} / {r} END"
    ca, weights = vector("ca"), VIRTUAL_CB
    arms = (vector("_n2"), vector("_b2"), vector("_b3"))
    built = plus(ca, *[times(arm, weight) for arm, weight in zip(arms, weights, strict=True)])
    for axis, real, virtual, plain in zip(AXES, vector("cb"), built, ca, strict=True):
        final[f"cb_{axis}"] = f"CASE WHEN {has_cb} THEN {real} WHEN {has_arms} THEN {virtual} ELSE {plain} END"
    for stage in (bonds, normals, parts, reach, final):
        df = with_expressions(df, stage)
    return df.drop(*bonds, *normals, *parts, *reach)


def dihedral(p0: Vector, p1: Vector, p2: Vector, p3: Vector) -> Column:
    """Signed dihedral angle in radians: the bonds next to the axis, seen along it."""
    u, v, w = minus(p1, p0), minus(p2, p1), minus(p3, p2)
    near, far = cross(u, v), cross(v, w)
    flat = f"{length(v)} < 1e-8"
    return F.expr(f"atan2(if({flat}, 0D, {length(v)} * {dot(u, far)}), if({flat}, -{dot(u, w)}, {dot(near, far)}))")


def squared_distance(a: Vector, b: Vector) -> str:
    gap = minus(a, b)
    return dot(gap, gap)
