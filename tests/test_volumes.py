"""The volume source, orientation, resampling and shape features against plain numpy."""

import gzip
import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import clouds, shapes, voxels
from candela.sources import volumes

CODES = {"uint8": 2, "int16": 4, "float32": 16, "uint16": 512}


def file_of(a, affine, order="<", slope=0.0, inter=0.0, turn=None):
    """A NIfTI-1 file; turn: (quaternion b c d, origin, sign of the third axis) in place of the affine."""
    h = bytearray(352)
    struct.pack_into(order + "i", h, 0, 348)
    struct.pack_into(order + "8h", h, 40, a.ndim, *a.shape, *[1] * (7 - a.ndim))
    struct.pack_into(order + "2h", h, 70, CODES[a.dtype.name], a.dtype.itemsize * 8)
    zooms = np.sqrt((np.asarray(affine, float)[:3, :3] ** 2).sum(0))
    struct.pack_into(order + "8f", h, 76, turn[2] if turn else 1, *zooms, *[1] * 4)
    struct.pack_into(order + "3f", h, 108, 352, slope, inter)
    struct.pack_into(order + "2h", h, 252, int(turn is not None), int(turn is None))
    if turn:
        struct.pack_into(order + "6f", h, 256, *turn[0], *turn[1])
    struct.pack_into(order + "12f", h, 280, *np.asarray(affine, float)[:3].ravel())
    h[344:348] = b"n+1\0"
    return bytes(h) + a.astype(a.dtype.newbyteorder(order)).tobytes(order="F")


def tilted(degrees):
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    return np.array([[c, -s, 0, 0], [s, c, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("volumes")
    rng = np.random.default_rng(1)
    a = (rng.random((7, 5, 9)) < 0.3).astype("int16") * 116 + (rng.random((7, 5, 9)) < 0.2).astype("int16")
    ras, lps = np.diag([1.0, 2, 3, 1]), np.diag([-1.0, -1, 2, 1])
    ras[:3, 3] = 5, -7, 11
    swapped = np.array([[0, 0, 3.0, 1], [-1, 0, 0, 2], [0, 2.0, 0, 3], [0, 0, 0, 1]])
    files = {
        "lps.nii": file_of(a, lps), "ras.nii": file_of(a, ras, ">"), "packed.nii.gz": gzip.compress(file_of(a.astype("float32"), swapped)), "scaled.nii": file_of(((a == 116) * 58).astype("uint8"), lps, ">", 2.0, 0.0),
        "turned.nii": file_of(a.astype("uint16"), np.diag([2.0, 2, 2, 1]), turn=((0.0, 0.0, 1.0), (1.0, 2.0, 3.0), -1)), "oblique.nii": file_of(a, tilted(5)), "nearly.nii": file_of(a, tilted(0.5)),
        "empty.nii": file_of(a * 0, lps), "flat.nii": file_of(a[0], lps), "junk.nii": b"x" * 400, "short.nii": b"x", "notes.txt": b"not read",
    }
    for name, data in files.items():
        (d / name).write_bytes(data)
    return d, a, {"lps": lps, "ras": ras, "swapped": swapped}


def named(df):
    return {r[0].rsplit("/", 1)[-1]: r for r in df.collect()}


def test_headers(spark, folder):
    d, a, affines = folder
    volumes.register(spark)
    got = named(spark.read.format("volumes").load(str(d)))
    assert "notes.txt" not in got and len(got) == 11
    for name, affine in (("lps.nii", affines["lps"]), ("ras.nii", affines["ras"]), ("packed.nii.gz", affines["swapped"])):
        r = got[name]
        assert (r.shape, r.ndim, r.voxel_count, r.error) == (list(a.shape), 3, a.size, "")
        assert [[r[f"m{w}{j}"] for j in range(3)] + [r[f"t{w}"]] for w in range(3)] == affine[:3].tolist()
    assert got["ras.nii"].physical_volume_mm3 == a.size * 6.0 and got["lps.nii"].bytes == 352 + a.size * 2
    # half a turn about the third axis, which is then turned round
    r = got["turned.nii"]
    assert np.allclose([[r[f"m{w}{j}"] for j in range(3)] for w in range(3)], np.diag([-2, -2, -2])) and [r.t0, r.t1, r.t2] == [1, 2, 3]
    assert [got[n].error for n in ("flat.nii", "junk.nii", "short.nii")] == ["not_three_dimensions", "not_a_volume", "header_cut_short"]
    files = spark.read.format("binaryFile").load(f"{d}/*.nii*")
    assert {n: tuple(r[1:]) for n, r in named(volumes.headers_of(files)).items()} == {n: tuple(r[1:]) for n, r in got.items()}


def test_plain_affine():
    data = bytearray(file_of(np.zeros((4, 5, 6), "uint8"), np.diag([2.0, 3, 4, 1])))
    struct.pack_into("<2h", data, 252, 0, 0)
    assert volumes.Header(bytes(data)).affine.tolist() == [[-2, 0, 0, 3], [0, 3, 0, -6], [0, 0, 4, -10]]


def test_voxels_by_slices(spark, folder, monkeypatch):
    d, a, _ = folder
    volumes.register(spark)
    want = sorted(map(tuple, np.argwhere(a == 116).tolist()))
    for name in ("lps.nii", "ras.nii", "packed.nii.gz", "scaled.nii"):
        for size in (100, 1 << 20):
            v = spark.read.format("volumes").option("label", 116).option("taskBytes", size).load(f"{d}/{name}")
            assert v.rdd.getNumPartitions() == (1 if size > 100 or name.endswith("gz") else -(-(d / name).stat().st_size // 100))
            assert sorted((r.i, r.j, r.k) for r in v.collect()) == want
    monkeypatch.setattr(volumes, "STEP_BYTES", 80)  # a slice at a time
    files = spark.read.format("binaryFile").load(f"{d}/ras.nii")
    assert sorted((r.i, r.j, r.k) for r in volumes.voxels_of(files, 116).collect()) == want


def test_cut_short_fails_by_name(spark, tmp_path):
    whole = file_of(np.full((3, 3, 3), 116, "int16"), np.eye(4))
    (tmp_path / "cut.nii").write_bytes(whole[:-5])
    volumes.register(spark)
    with pytest.raises(Exception, match="file_cut_short"):
        spark.read.format("volumes").option("label", 116).load(str(tmp_path)).collect()


def test_masks(spark, folder):
    d, a, affines = folder
    volumes.register(spark)
    good = [f"{d}/{n}" for n in ("lps.nii", "ras.nii", "packed.nii.gz", "oblique.nii", "nearly.nii", "empty.nii")]
    headers, found = (volumes_of(spark, good, label) for label in (None, 116))
    grids, lps = volumes.masks(headers, found)
    g = named(grids)
    assert {n: r.error for n, r in g.items()} == {"lps.nii": "", "ras.nii": "", "packed.nii.gz": "", "nearly.nii": "", "oblique.nii": "oblique", "empty.nii": "label_absent"}
    assert (g["ras.nii"].input_codes, g["ras.nii"].codes, g["packed.nii.gz"].input_codes) == ("RAS", "LPS", "PSR")
    rows = lps.groupBy("case_id").agg(F.collect_list(F.struct("i", "j", "k")).alias("v"))
    places = {n: {tuple(x) for x in r.v} for n, r in named(rows).items()}
    assert places["ras.nii"] == {(6 - i, 4 - j, k) for i, j, k in places["lps.nii"]}
    # each voxel stays where it is in the world
    r = g["packed.nii.gz"]
    new = np.array([[r[f"m{w}{j}"] for j in range(3)] + [r[f"t{w}"]] for w in range(3)])
    at = lambda m, ijk: {tuple(np.round(m[:, :3] @ np.array(p) + m[:, 3], 6).tolist()) for p in ijk}
    assert at(new, places["packed.nii.gz"]) == at(affines["swapped"][:3], np.argwhere(a == 116).tolist())
    strict = named(volumes.masks(headers, found, strict=True)[0])
    assert strict["ras.nii"].error == "input_not_LPS: RAS" and strict["lps.nii"].error == ""


def volumes_of(spark, paths, label):
    out = None
    for p in paths:
        reader = spark.read.format("volumes")
        df = (reader if label is None else reader.option("label", label)).load(p)
        out = df if out is None else out.unionByName(df)
    return out


def grid_rows(spark, matrices, shape=(4, 5, 6)):
    names = [f"n{a}" for a in "ijk"] + [f"m{w}{j}" for w in range(3) for j in range(3)] + [f"t{w}" for w in range(3)]
    return spark.createDataFrame([(n, *shape, *np.asarray(m, float).ravel().tolist(), 0.5, -1.0, 2.0) for n, m in enumerate(matrices)], "case_id int, ni int, nj int, nk int, " + ", ".join(f"{c} double" for c in names[3:]))


def test_axes_have_a_world_axis_each(spark):
    rng = np.random.default_rng(2)
    two_on_one = [[0.8, 0.7, 0.1], [0.6, 0.1, 0.2], [0.0, 0.7, 0.9]]  # separate maxima: first world axis twice
    matrices = [np.eye(3), np.diag([-1, -1, 1]), two_on_one, np.zeros((3, 3)), [[np.nan, 0, 0], [0, 1, 0], [0, 0, 1]], *rng.normal(size=(40, 3, 3))]
    g = voxels.with_axes(grid_rows(spark, matrices))
    rows = {r.case_id: r for r in g.collect()}
    assert (rows[0].codes, rows[1].codes, rows[0].obliquity) == ("RAS", "LPS", 0.0)
    assert rows[2].codes == "ARS" and rows[3].axis_error == rows[4].axis_error == "affine_has_invalid_axes" and rows[3].codes is None
    for n, m in enumerate(matrices[5:], 5):
        m = np.asarray(m) / np.linalg.norm(m, axis=0)
        best = max(itertools.permutations(range(3)), key=lambda p: sum(abs(m[p[j], j]) for j in range(3)))
        assert tuple(rows[n].world) == best and rows[n].sign == [1 if m[best[j], j] > 0 else -1 for j in range(3)]
    for target in ("LPS", "RAS", "SAL"):
        again = {r.case_id: r for r in voxels.with_axes(voxels.reoriented_grids(g, target).drop("sizes", "obliquity")).collect()}
        assert {r.codes for r in again.values()} == {target} and 3 not in again
    with pytest.raises(ValueError, match="three axes"):
        voxels.reoriented_grids(g, "LRS")


def zoomed(mask, sizes, mm):
    shape = [int(round(n * s / mm)) for n, s in zip(mask.shape, sizes)]
    at = [np.floor(np.arange(t) * ((n - 1) / (t - 1) if t > 1 else 1.0) + 0.5).astype(int) for n, t in zip(mask.shape, shape)]
    return mask[np.ix_(*at)]


def test_isotropic(spark):
    rng = np.random.default_rng(3)
    masks = {n: rng.random(rng.integers(1, 9, 3)) < 0.4 for n in range(12)}
    masks = {n: m for n, m in masks.items() if m.any()}
    sizes = {n: rng.choice([0.3, 0.5, 1.0, 1.7, 2.5, 3.0], 3) for n in masks}
    rows = [(n, *map(int, p)) for n, m in masks.items() for p in np.argwhere(m)]
    v = spark.createDataFrame(rows, "case_id int, i int, j int, k int")
    g = spark.createDataFrame([(n, *map(int, m.shape)) for n, m in masks.items()], "case_id int, ni int, nj int, nk int")
    s = spark.createDataFrame([(n, *map(float, x)) for n, x in sizes.items()], "case_id int, si double, sj double, sk double")
    boxes = voxels.boxes(v, g)
    cut = {r.case_id: r for r in boxes.collect()}
    for mm in (1.0, 0.4):
        got = sorted(tuple(r) for r in voxels.isotropic(v, boxes, s, mm).collect())
        want = []
        for n, m in masks.items():
            b = cut[n]
            want += [(n, *p) for p in np.argwhere(zoomed(m[b.i_lo : b.i_hi, b.j_lo : b.j_hi, b.k_lo : b.k_hi], sizes[n], mm)).tolist()]
        assert got == sorted(want)


def brute_shape(points, size):
    """Area and volume by every cube of the box, distances of all pairs of vertices."""
    inside, size = set(points), np.array(size)
    lo, hi = np.min(points, 0) - 1, np.max(points, 0) + 1
    area = volume = 0.0
    edges = {}
    for c in itertools.product(*[range(a, b) for a, b in zip(lo, hi)]):
        code = sum(1 << (x + 2 * y + 4 * z) for x, y, z in itertools.product((0, 1), repeat=3) if (c[0] + x, c[1] + y, c[2] + z) in inside)
        for loop in shapes.cube_loops(code):
            p = (np.array(loop) + np.array(c)) * size
            for a, b in zip(p[1:-1], p[2:]):
                area += np.linalg.norm(np.cross(a - p[0], b - p[0])) / 2
                volume += np.dot(p[0], np.cross(a, b)) / 6
            for a, b in zip(loop, loop[1:] + loop[:1]):
                key = tuple(np.add(a, c)), tuple(np.add(b, c))
                edges[key] = edges.get(key, 0) + 1
    assert all(edges.get((b, a)) == n for (a, b), n in edges.items())  # the surface is closed
    ends = np.array(sorted({a for a, _ in edges}))
    d = np.sqrt((((ends[:, None] - ends[None]) * size) ** 2).sum(2))
    flat = [max(d[np.ix_(ends[:, a] == x, ends[:, a] == x)].max() for x in set(ends[:, a])) for a in range(3)]
    return area, volume, d.max(), flat


def test_shapes(spark):
    rng = np.random.default_rng(4)
    cases = {
        "one": [(3, 3, 3)], "diagonal": [(0, 0, 0), (1, 1, 1)], "corner": [(0, 0, 0), (1, 1, 0)], "box": list(itertools.product(range(3), range(4), range(2))),
        "ball": [p for p in itertools.product(range(-5, 6), repeat=3) if sum(x * x for x in p) <= 25], "hollow": [p for p in itertools.product(range(4), repeat=3) if p != (1, 1, 1)],
    } | {f"random{n}": sorted({tuple(map(int, p)) for p in rng.integers(0, 6, (70, 3))}) for n in range(4)}
    sizes = {n: (1.0, 1.0, 1.0) if n in ("one", "box", "ball") else (0.5, 1.25, 2.0) for n in cases}
    rows = [(n, *p) for n, points in cases.items() for p in points] + [("one", 3, 3, 3), ("box", None, 0, 0)]
    v = spark.createDataFrame(rows, "case_id string, i int, j int, k int")
    s = spark.createDataFrame([(n, *x) for n, x in sizes.items()], "case_id string, si double, sj double, sk double")
    table = spark.createDataFrame([(n, "") for n in cases] + [("none", ""), ("bad", "oblique")], "case_id string, error string")
    got = {r.case_id: r for r in shapes.shape_table(table, v, s).collect()}
    assert (got["none"].status, got["none"].error_message, got["bad"].error_message, got["none"].original_shape_MeshVolume) == ("failed", "no_foreground", "oblique", None)
    for n, points in cases.items():
        r, (area, volume, wide, flat) = got[n], brute_shape(points, sizes[n])
        assert r.status == "success" and r.original_shape_VoxelVolume == pytest.approx(len(points) * np.prod(sizes[n]))
        assert (r.original_shape_SurfaceArea, r.original_shape_MeshVolume) == pytest.approx((area, volume))
        assert (r.original_shape_Maximum3DDiameter, r.original_shape_Maximum2DDiameterRow, r.original_shape_Maximum2DDiameterColumn, r.original_shape_Maximum2DDiameterSlice) == pytest.approx((wide, *flat))
        e = np.linalg.eigvalsh(np.cov((np.array(points) * sizes[n]).T, bias=True)) if len(points) > 1 else np.zeros(3)
        assert (r.original_shape_LeastAxisLength, r.original_shape_MinorAxisLength, r.original_shape_MajorAxisLength) == pytest.approx(4 * np.sqrt(np.maximum(e, 0)), abs=1e-5)
        assert r.original_shape_Sphericity == pytest.approx((36 * np.pi * volume**2) ** (1 / 3) / area)
    # closed forms: an octahedron; a box with its edges and corners cut
    assert (got["one"].original_shape_SurfaceArea, got["one"].original_shape_MeshVolume, got["one"].original_shape_Elongation) == (pytest.approx(3**0.5), pytest.approx(1 / 6), None)
    a, b, c = 2, 3, 1
    assert got["box"].original_shape_SurfaceArea == pytest.approx(2 * (a * b + b * c + a * c) + 4 * (a + b + c) * 0.5**0.5 + 3**0.5)
    assert got["box"].original_shape_MeshVolume == pytest.approx(a * b * c + a * b + b * c + a * c + (a + b + c) / 2 + 1 / 6)


def test_mask_to_features(spark, tmp_path):
    # from files to canonical pose and shape: an upright ellipsoid, coarser along its axis
    z, y, x = np.meshgrid(np.arange(30), np.arange(24), np.arange(24), indexing="ij")
    a = ((((x - 12) / 6) ** 2 + ((y - 12) / 9) ** 2 + ((z - 15) / 13) ** 2) <= 1).T.astype("int16") * 116
    (tmp_path / "e.nii").write_bytes(file_of(a, np.diag([1.0, 1, 2, 1])))
    volumes.register(spark)
    grids, v = volumes.masks(volumes_of(spark, [str(tmp_path)], None), volumes_of(spark, [str(tmp_path)], 116))
    s = grids.select("case_id", *[F.col("sizes")[n].alias(f"s{x}") for n, x in enumerate("ijk")])
    even = voxels.isotropic(v, voxels.boxes(v, grids), s)
    ones = s.select("case_id", *[F.lit(1.0).alias(c) for c in ("si", "sj", "sk")])
    r = shapes.shape_table(grids.select("case_id", "error"), even, ones).first()
    assert r.original_shape_MeshVolume == pytest.approx(4 / 3 * np.pi * 6 * 9 * 26, rel=0.03) and r.original_shape_Maximum3DDiameter == pytest.approx(52, abs=2)
    pose = clouds.poses(clouds.points_of_voxels(even, ones.withColumnsRenamed({"si": "sx", "sj": "sy", "sk": "sz"}))).first()
    assert pose.status == "success" and pose.long_axis_z == pytest.approx(1, abs=1e-3)
