"""Dense tensors in raw or NumPy files as partitioned reads (SRC1, SRC8).

A file is cut into ranges of time steps; each task seeks to its range and reads
only that.  Nothing but the header passes through the driver.  Members of an
archive are found by its directory and read by byte range like plain files; only
a compressed one cannot be cut and is one task that streams.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "t_idx bigint, node int, channels array<float>"
PARTITION_BYTES = 64 << 20
BATCH_STEPS = 256


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _batch(first: int, block: np.ndarray) -> pa.RecordBatch:
    """``block`` is ``[steps, nodes, channels]``."""
    steps, nodes, channels = block.shape
    t = np.repeat(np.arange(first, first + steps, dtype=np.int64), nodes)
    n = np.tile(np.arange(nodes, dtype=np.int32), steps)
    flat = pa.array(np.ascontiguousarray(block, dtype=np.float32).ravel())
    offsets = pa.array(np.arange(0, steps * nodes * channels + 1, channels, dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(t), pa.array(n), pa.ListArray.from_arrays(offsets, flat)],
        schema=pa.schema([("t_idx", pa.int64()), ("node", pa.int32()), ("channels", pa.list_(pa.float32()))]))


class Steps(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class TensorReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.t_lo = int(options.get("t_lo", 0))
        self.t_hi = int(options["t_hi"]) if "t_hi" in options else None
        self.per_task = int(options["steps"]) if "steps" in options else None
        self.declared = [int(x) for x in options["shape"].split(",")] if "shape" in options else None
        self.member = options.get("member", "data")

    def _stored(self) -> bool:
        """Whether the bytes of the array stand in the file as they are."""
        if not self.path.endswith(".npz"):
            return True
        with _open(self.path) as f, zipfile.ZipFile(f) as z:
            return z.getinfo(f"{self.member}.npy").compress_type == zipfile.ZIP_STORED

    def _header(self) -> tuple[list[int], np.dtype, int]:
        """Shape, type, and where the array begins in the file."""
        with _open(self.path) as f:
            if self.path.endswith(".npz"):
                with zipfile.ZipFile(f) as z:
                    at = z.getinfo(f"{self.member}.npy").header_offset
                # a local header of 30 bytes, which ends with the lengths of the name and of what follows it
                f.seek(at + 26)
                name, extra = np.frombuffer(f.read(4), "<u2").tolist()
                f.seek(at + 30 + name + extra)
                return _npy_header(f)
            if self.path.endswith(".npy"):
                return _npy_header(f)
            if self.declared is None:
                raise ValueError("a raw tensor needs the option shape")
            size = f.size()
        if int(np.prod(self.declared)) * 4 != size:
            raise ValueError(f"{self.path} holds {size} bytes, shape {self.declared} needs {int(np.prod(self.declared)) * 4}")
        return self.declared, np.dtype("<f4"), 0

    def partitions(self):
        if not self._stored():
            return [Steps(self.t_lo, self.t_hi if self.t_hi is not None else 1 << 62)]
        shape, dtype, _ = self._header()
        hi = min(self.t_hi, shape[0]) if self.t_hi is not None else shape[0]
        step_bytes = max(dtype.itemsize * int(np.prod(shape[1:])), 1)
        per = self.per_task or max(1, PARTITION_BYTES // step_bytes)
        return [Steps(i, min(i + per, hi)) for i in range(self.t_lo, hi, per)] or [Steps(0, 0)]

    def read(self, part: Steps) -> Iterator[pa.RecordBatch]:
        if not self._stored():
            with _open(self.path) as f, zipfile.ZipFile(f) as z, z.open(f"{self.member}.npy") as m:
                shape, dtype, _ = _npy_header(m)
                yield from self._stream(m, shape, dtype, 0, max(part.lo, 0), min(part.hi, shape[0]))
            return
        shape, dtype, offset = self._header()
        step_bytes = dtype.itemsize * int(np.prod(shape[1:]))
        with _open(self.path) as f:
            f.seek(offset + part.lo * step_bytes)
            yield from self._stream(f, shape, dtype, part.lo, part.lo, part.hi)

    @staticmethod
    def _stream(f, shape, dtype, at: int, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        rest = (list(shape[1:]) + [1, 1])[:2] if len(shape) < 3 else list(shape[1:])
        step_bytes = dtype.itemsize * int(np.prod(rest))
        while at < hi:
            steps = min(BATCH_STEPS, hi - at)
            block = np.frombuffer(f.read(steps * step_bytes), dtype=dtype).reshape(steps, *rest)
            if at + steps > lo:
                yield _batch(max(at, lo), block[max(lo - at, 0):])
            at += steps


def _npy_header(f) -> tuple[list[int], np.dtype, int]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    if fortran or dtype.hasobject:
        raise ValueError("only row-major numeric arrays can be read")
    return list(shape), dtype, f.tell()


class TensorSource(DataSource):
    """``spark.read.format("tensor").option("shape", "L,N,C").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "tensor"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TensorReader(self.options)


def read_tensor(
    spark: SparkSession, path: str, shape: tuple[int, ...] | None = None, t_lo: int = 0, t_hi: int | None = None,
    steps: int | None = None, member: str = "data",
) -> DataFrame:
    """SRC1 for raw float32, SRC8 for ``.npy`` and ``.npz``: ``(t_idx, node, channels)``.

    ``t_lo`` and ``t_hi`` bound the steps read.
    """
    spark.dataSource.register(TensorSource)
    reader = spark.read.format("tensor").option("t_lo", t_lo).option("member", member)
    if shape:
        shape = (tuple(shape) + (1, 1))[:3]
        reader = reader.option("shape", ",".join(str(s) for s in shape))
    if t_hi is not None:
        reader = reader.option("t_hi", t_hi)
    if steps:
        reader = reader.option("steps", steps)
    return reader.load(path)


def named_channels(tensor: DataFrame, names: list[str]) -> DataFrame:
    """Channels as columns: the value first, then the time features."""
    from pyspark.sql import functions as F

    return tensor.select("t_idx", "node", *[F.get("channels", F.lit(i)).alias(n) for i, n in enumerate(names)])
