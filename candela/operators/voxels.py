"""Grids of voxels: grids as rows (case_id, ni, nj, nk, m00..m22, t0..t2), world = m index + t with
world axes growing right, front and up, and foreground voxels as rows (case_id, i, j, k).

Reorientation and resampling are column arithmetic on voxel rows joined with one row a case; no
array of a grid is ever built."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import clouds

AXES = "ijk"
#: The world axis of each letter and whether it grows there.
DIRECTIONS = {"R": (0, 1), "L": (0, -1), "A": (1, 1), "P": (1, -1), "S": (2, 1), "I": (2, -1)}
LETTERS = (("L", "R"), ("P", "A"), ("I", "S"))
#: Largest angle in degrees of a voxel axis against its world axis.
OBLIQUE = 1.0


def matrix(grids: DataFrame | None = None) -> list[list[Column]]:
    return [[F.col(f"m{w}{j}") for j in range(3)] for w in range(3)]


def with_axes(grids: DataFrame) -> DataFrame:
    """grids with `world` and `sign`, the world axis of each voxel axis and whether it grows there,
    their `codes`, the `obliquity` and `sizes` of voxels, and `axis_error`.

    Every voxel axis has a world axis of its own: of the six assignments, the one with the
    greatest sum of direction cosines, on ties the first. Three separate maxima could give one
    world axis twice. Axes without length, or not finite, are an error and have no codes."""
    m = matrix()
    sizes = clouds.voxel_sizes(m)
    finite = F.lit(True)
    for row in m:
        for c in row:
            finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
    good = finite & sizes[0].isNotNull()
    cosine = [[F.abs(m[w][j]) / sizes[j] for j in range(3)] for w in range(3)]
    ways = [F.struct((cosine[p[0]][0] + cosine[p[1]][1] + cosine[p[2]][2]).alias("sum"), F.lit(-n).alias("order"), F.array(*[F.lit(w) for w in p]).alias("world")) for n, p in enumerate(permutations(range(3)))]
    out = grids.withColumn("world", F.when(good, F.greatest(*ways)["world"]))
    along = [F.get(F.array(m[0][j], m[1][j], m[2][j]), F.get("world", F.lit(j))) for j in range(3)]
    out = out.withColumn("sign", F.when(good, F.array(*[F.when(a > 0, 1).otherwise(-1) for a in along])))
    letters = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in LETTERS])
    codes = [F.get(F.get(letters, F.get("world", F.lit(j))), F.when(F.get("sign", F.lit(j)) > 0, 1).otherwise(0)) for j in range(3)]
    return out.withColumns({"codes": F.concat(*codes), "obliquity": F.when(good, clouds.obliquity(m)), "sizes": F.when(good, F.array(*sizes)), "axis_error": F.when(good, "").otherwise("affine_has_invalid_axes")})


def _plan(target: str) -> list[tuple[Column, Column]]:
    """For each target axis: the voxel axis that becomes it, and whether that is turned round."""
    if sorted(DIRECTIONS[c][0] for c in target) != [0, 1, 2]:
        raise ValueError(f"{target} doesn't name three axes")
    out = []
    for letter in target:
        axis, way = DIRECTIONS[letter]
        source = F.array_position("world", F.lit(axis)).cast("int") - 1
        out.append((source, F.get("sign", source) != way))
    return out


def reoriented_grids(grids: DataFrame, target: str = "LPS") -> DataFrame:
    """grids (with_axes) in the target's axes: shape, matrix and origin such that every voxel stays
    where it is; sizes follow. Grids with an axis error are left out."""
    plan, m = _plan(target), matrix()
    shape = F.array("ni", "nj", "nk")
    out = {f"n{a}": F.get(shape, source) for a, (source, _) in zip(AXES, plan)}
    turned = [F.when(turn, -1.0).otherwise(1.0) for _, turn in plan]
    for w in range(3):
        row = F.array(*m[w])
        out |= {f"m{w}{a}": turned[a] * F.get(row, source) for a, (source, _) in enumerate(plan)}
        moved = [F.when(turn, F.get(row, source) * (F.get(shape, source) - 1)).otherwise(0.0) for source, turn in plan]
        out[f"t{w}"] = F.col(f"t{w}") + moved[0] + moved[1] + moved[2]
    out["sizes"] = F.array(*[F.get("sizes", source) for source, _ in plan])
    kept = [c for c in grids.columns if c not in out and c not in ("world", "sign", "codes", "axis_error")]
    return grids.where("axis_error = ''").select(*kept, *[c.alias(k) for k, c in out.items()], F.lit(target).alias("codes"))


def reoriented_voxels(voxels: DataFrame, grids: DataFrame, target: str = "LPS") -> DataFrame:
    """(case_id, i, j, k) in the target's axes, of grids with axes and without an error."""
    plan = _plan(target)
    shape = F.array("ni", "nj", "nk")
    by = grids.where("axis_error = ''").select("case_id", *[x.alias(f"{k}{a}") for a, (source, turn) in enumerate(plan) for k, x in (("from", source), ("turn", turn), ("size", F.get(shape, source)))])
    place = F.array(*AXES)
    new = [F.when(F.col(f"turn{a}"), F.col(f"size{a}") - 1 - F.get(place, F.col(f"from{a}"))).otherwise(F.get(place, F.col(f"from{a}"))) for a in range(3)]
    return voxels.select("case_id", *AXES).join(by, "case_id").select("case_id", *[x.cast("int").alias(a) for a, x in zip(AXES, new)])


def boxes(voxels: DataFrame, grids: DataFrame, padding: int = 1) -> DataFrame:
    """(case_id, i_lo, i_hi, ...): the box around each case's foreground, padded within its grid;
    hi is beyond the last."""
    seen = voxels.groupBy("case_id").agg(*[f(a).alias(f"{a}_{k}") for a in AXES for f, k in ((F.min, "lo"), (F.max, "hi"))])
    cut = [x.cast("int").alias(f"{a}_{k}") for a in AXES for k, x in (("lo", F.greatest(F.col(f"{a}_lo") - padding, F.lit(0))), ("hi", F.least(F.col(f"{a}_hi") + padding + 1, F.col(f"n{a}"))))]
    return seen.join(grids.select("case_id", *[f"n{a}" for a in AXES]), "case_id").select("case_id", *cut)


def isotropic(voxels: DataFrame, boxes: DataFrame, sizes: DataFrame, mm: float = 1.0) -> DataFrame:
    """(case_id, i, j, k) of each box resampled to cubes of mm by the nearest voxel.

    boxes as of boxes(); sizes: (case_id, si, sj, sk) in mm. An axis of n voxels gets
    n size / mm, rounded half to even; its ends stay its ends, and target t shows the voxel at
    t (n - 1) / (targets - 1), rounded half up. A voxel yields the targets that show it, so nothing
    is looked up."""
    by = boxes.join(sizes, "case_id")
    n = {a: F.col(f"{a}_hi") - F.col(f"{a}_lo") for a in AXES}
    by = by.select("case_id", *[F.col(f"{a}_lo") for a in AXES], *[n[a].alias(f"n{a}") for a in AXES], *[F.rint(n[a] * F.col(f"s{a}") / mm).cast("int").alias(f"out{a}") for a in AXES])
    step = {a: F.when(F.col(f"out{a}") > 1, (F.col(f"n{a}") - 1) / (F.col(f"out{a}") - 1)).otherwise(F.lit(1.0)) for a in AXES}
    by = by.where(F.least(*[f"out{a}" for a in AXES]) > 0).select("case_id", *[f"{a}_lo" for a in AXES], *[f"out{a}" for a in AXES], *[step[a].alias(f"step{a}") for a in AXES])
    out = voxels.select("case_id", *AXES).join(by, "case_id")
    for a in AXES:
        at = (F.col(a) - F.col(f"{a}_lo")).cast("double")
        last = F.col(f"out{a}") - 1
        # one to each side more than the range, as it is divided; the rule itself decides
        near = [F.when(F.col(f"step{a}") > 0, F.floor((at + d) / F.col(f"step{a}")) + e).otherwise(end) for d, e, end in ((-0.5, -1, F.lit(0)), (0.5, 1, last))]
        span = F.sequence(F.greatest(near[0], F.lit(0)).cast("int"), F.least(near[1], last).cast("int"))
        span = F.when(near[0] <= last, span).otherwise(F.array().cast("array<int>"))
        step_, at_ = F.col(f"step{a}"), at
        out = out.withColumn(f"to{a}", F.filter(span, lambda t: F.floor(t * step_ + 0.5) == at_))  # noqa: B023
    for a in AXES:
        out = out.withColumn(a, F.explode(f"to{a}"))
    return out.select("case_id", *AXES)
