"""Volumes in the NIfTI-1 single-file format as a Spark source.

    register(spark)
    spark.read.format("volumes").load(folder)                                  # a header a file
    spark.read.format("volumes").option("label", 116).load(folder)            # its foreground voxels

The source opens local folders and the stores that pyarrow knows by URI. A file is split by slices
of its third axis, and each task reads its own bytes; compressed files are read by one task, a
few slices at a time. Stores that only Spark opens go through headers_of and voxels_of, which take
Spark's rows (path, content) of whole files."""

from __future__ import annotations

import gzip
import math
import struct
import sys
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import voxels as grids_

HEADER_BYTES = 348
#: Element types by the format's code.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
#: Bytes of slices that are in memory at once, and of a file for one task.
STEP_BYTES, TASK_BYTES = 1 << 24, 1 << 27

HEADER_SCHEMA = (
    "path string, bytes long, ndim int, shape array<int>, voxel_count long, physical_volume_mm3 double, ni int, nj int, nk int, "
    + ", ".join(f"m{w}{j} double" for w in range(3) for j in range(3))
    + ", t0 double, t1 double, t2 double, error string"
)
VOXEL_SCHEMA = "path string, i int, j int, k int"


class BadVolume(ValueError):
    """A file that isn't what it should be, by the name of the fault."""


class Header:
    """What the first 348 bytes say; numbers in either byte order."""

    def __init__(self, data: bytes):
        if len(data) < HEADER_BYTES:
            raise BadVolume("header_cut_short")
        order = next((o for o in "<>" if struct.unpack_from(f"{o}i", data)[0] == HEADER_BYTES), None)
        if order is None or data[344:347] not in (b"n+1", b"ni1"):
            raise BadVolume("not_a_volume")
        if data[344:347] == b"ni1":
            raise BadVolume("voxels_in_another_file")
        read = lambda form, at: struct.unpack_from(order + form, data, at)
        dim, zooms = read("8h", 40), read("8f", 76)
        if not 1 <= dim[0] <= 7 or min(dim[1 : dim[0] + 1]) < 0:
            raise BadVolume("bad_dimensions")
        self.shape = dim[1 : dim[0] + 1]
        code = read("h", 70)[0]
        if code not in TYPES:
            raise BadVolume("element_type_not_known")
        self.dtype = np.dtype(order + TYPES[code])
        self.zooms = zooms[1 : dim[0] + 1]
        self.offset, slope, inter = read("3f", 108)
        self.scale = (slope, inter if math.isfinite(inter) else 0.0) if math.isfinite(slope) and slope != 0 else (1.0, 0.0)
        q_code, s_code = read("2h", 252)
        if s_code > 0:
            self.affine = np.array(read("12f", 280), float).reshape(3, 4)
        elif q_code > 0:
            self.affine = self._turned(read("3f", 256), read("3f", 268), zooms)
        else:
            self.affine = self._plain()

    def _turned(self, bcd: tuple[float, ...], offset: tuple[float, ...], zooms: tuple[float, ...]) -> np.ndarray:
        """From the rotation as a unit quaternion; a negative first zoom turns the third axis."""
        b, c, d = bcd
        a = math.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ])
        sizes = np.array(zooms[1:4]) * [1, 1, -1 if zooms[0] < 0 else 1]
        return np.column_stack([turn * sizes, offset])

    def _plain(self) -> np.ndarray:
        """By zooms alone: centred, the first axis growing left."""
        n = np.ones(3)
        n[: min(3, len(self.shape))] = self.shape[:3]
        sizes = np.ones(3)
        sizes[: min(3, len(self.zooms))] = self.zooms[:3]
        sizes = sizes * [-1, 1, 1]
        return np.column_stack([np.diag(sizes), -(n - 1) / 2 * sizes])

    def row(self, path: str, size: int) -> tuple:
        solid = len(self.shape) == 3
        count = math.prod(self.shape) if solid else None
        error = "" if solid else "not_three_dimensions"
        if solid and not all(math.isfinite(z) and z > 0 for z in self.zooms[:3]):
            error = "voxel_sizes_not_positive"
        volume = count * math.prod(self.zooms[:3]) if solid and not error else None
        m = self.affine[:, :3].ravel().tolist()
        return (path, size, len(self.shape), list(self.shape), count, volume, *(self.shape if solid else (None,) * 3), *m, *self.affine[:, 3].tolist(), error)


def _bad_row(path: str, size: int, error: str) -> tuple:
    return (path, size, *(None,) * (len(HEADER_SCHEMA.split(", ")) - 3), error)


def _opened(raw: BinaryIO, packed: bool):
    return gzip.GzipFile(fileobj=raw) if packed else raw


def _header_row(raw: BinaryIO, path: str, size: int) -> tuple:
    try:
        return Header(_opened(raw, path.endswith(".gz")).read(HEADER_BYTES)).row(path, size)
    except (BadVolume, EOFError, gzip.BadGzipFile) as e:
        return _bad_row(path, size, str(e) if isinstance(e, BadVolume) else "file_cut_short")


def _voxels(raw: BinaryIO, path: str, label: float, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """Voxels of the label in the part's slices, a few slices at a time."""
    file = _opened(raw, path.endswith(".gz"))
    head = Header(file.read(HEADER_BYTES))
    if len(head.shape) != 3:
        raise BadVolume(f"not_three_dimensions: {path}")
    ni, nj, nk = head.shape
    lo, hi = nk * part // parts, nk * (part + 1) // parts
    wide = ni * nj * head.dtype.itemsize
    file.seek(int(head.offset) + lo * wide)
    step = max(1, STEP_BYTES // max(1, wide))
    slope, inter = head.scale
    for k0 in range(lo, hi, step):
        n = min(step, hi - k0)
        data = file.read(n * wide)
        if len(data) < n * wide:
            raise BadVolume(f"file_cut_short: {path}")
        values = np.frombuffer(data, head.dtype)
        at = np.flatnonzero((values if (slope, inter) == (1.0, 0.0) else values * slope + inter) == label)
        if len(at):
            columns = (at % ni, at // ni % nj, at // (ni * nj) + k0)
            yield pa.record_batch([pa.array([path] * len(at), pa.string()), *[pa.array(c.astype(np.int32)) for c in columns]], names=["path", *"ijk"])


def _header_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split(" ") for f in HEADER_SCHEMA.split(", ")]
    return pa.record_batch([pa.array([r[n] for r in rows], kinds[kind]) for n, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


# --- the data source


class Part(InputPartition):
    def __init__(self, path: str, size: int, part: int, parts: int):
        super().__init__((path, size, part, parts))
        self.path, self.size, self.part, self.parts = path, size, part, parts


class VolumeReader(DataSourceReader):
    def __init__(self, root: str, label: float | None, task_bytes: int):
        self.root, self.label, self.task_bytes = root, label, task_bytes

    def _store(self):
        return pa.fs.FileSystem.from_uri(self.root) if "://" in self.root else (pa.fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        """A listing only: tasks read the headers."""
        store, root = self._store()
        top = store.get_file_info(root)
        if top.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        files = [top] if top.is_file else store.get_file_info(pa.fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.is_file and f.path.endswith((".nii", ".nii.gz")):
                parts = 1 if self.label is None or f.path.endswith(".gz") else max(1, -(-f.size // self.task_bytes))
                out += [Part(f.path, f.size, p, parts) for p in range(parts)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        with store.open_input_file(part.path) as raw:
            if self.label is None:
                yield _header_batch([_header_row(raw, part.path, part.size)])
            else:
                yield from _voxels(raw, part.path, self.label, part.part, part.parts)


class Volumes(DataSource):
    """Options: label, the value of the foreground (without it, rows are headers); taskBytes, the
    bytes of a file that one task reads. A file that can't be read is a header row with its
    error; where voxels are asked for, it fails by name."""

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return HEADER_SCHEMA if self.options.get("label") is None else VOXEL_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        label = self.options.get("label")
        return VolumeReader(self.options["path"], None if label is None else float(label), int(self.options.get("taskBytes", TASK_BYTES)))


def register(spark: SparkSession) -> None:
    """The source goes to Spark by value: the process that plans a read may not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Volumes)


# --- whole files as Spark's rows


def headers_of(files: DataFrame) -> DataFrame:
    """Header rows of files (path, content, length), as Spark's binaryFile gives them."""

    def run(batches):
        for batch in batches:
            yield _header_batch([_header_row(pa.BufferReader(c.as_buffer()), p, n) for p, c, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist())])

    return files.select("path", "content", "length").mapInArrow(run, HEADER_SCHEMA)


def voxels_of(files: DataFrame, label: float) -> DataFrame:
    """Foreground voxels of files (path, content)."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _voxels(pa.BufferReader(content.as_buffer()), path, label)

    return files.select("path", "content").mapInArrow(run, VOXEL_SCHEMA)


# --- masks


def masks(headers: DataFrame, voxels: DataFrame, strict: bool = False, oblique: float = grids_.OBLIQUE) -> tuple[DataFrame, DataFrame]:
    """(grids, voxels) in left, back and up axes, by path as case_id, of headers and the label's voxels.

    Every file keeps a grid row; `error` names what keeps it out: the header's error,
    affine_has_invalid_axes, input_not_LPS (strict only), oblique or label_absent. Voxels are those
    of grids without an error."""
    good = F.col("error") == ""
    g = grids_.with_axes(headers.withColumnRenamed("path", "case_id"))
    found = voxels.groupBy("path").agg(F.count("*").alias("n_voxels")).withColumnRenamed("path", "case_id")
    g = g.join(found, "case_id", "left")
    error = F.when(~good, F.col("error")).when(F.col("axis_error") != "", F.col("axis_error"))
    if strict:
        error = error.when(F.col("codes") != "LPS", F.concat(F.lit("input_not_LPS: "), F.col("codes")))
    error = error.when(F.col("obliquity") > oblique, "oblique").when(F.col("n_voxels").isNull(), "label_absent").otherwise("")
    g = g.withColumn("error", error).withColumn("input_codes", F.col("codes")).withColumn("axis_error", F.col("error"))
    fit = g.where("error = ''")
    lost = g.where("error <> ''").select("case_id", "input_codes", "error")
    grids = grids_.reoriented_grids(fit).unionByName(lost, allowMissingColumns=True)
    return grids, grids_.reoriented_voxels(voxels.withColumnRenamed("path", "case_id"), fit)
