"""Array archives (``.npz``) and single arrays (``.npy``) as a data source that is read by row ranges."""

from __future__ import annotations

import io
import pickle
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stitchrank.sources.tables import as_vectors

RANGE_BYTES = 64 << 20  # bytes of one partition
BATCH_ROWS = 4096
_KINDS = {"f4": (T.FloatType(), pa.float32()), "f8": (T.DoubleType(), pa.float64())}
# What an array of Python strings is pickled with; anything else in such a file is refused.
_ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct")}


class _Strings(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) in _ALLOWED:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} in an array of objects")


@dataclass(frozen=True)
class Member:
    """An array of a file: where its rows begin, and how they look. ``start`` is None where rows cannot be reached by position."""

    name: str
    shape: tuple[int, ...]
    dtype: str
    start: int | None

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * int(np.prod(self.shape[1:], dtype=np.int64))

    def types(self) -> tuple[T.DataType, pa.DataType]:
        kind = np.dtype(self.dtype)
        if kind.kind in "OUS":
            one = (T.StringType(), pa.string())
        elif kind.kind in "iub":
            one = (T.LongType(), pa.int64())
        elif kind.kind == "f":
            one = _KINDS.get(kind.str[1:], _KINDS["f8"])
        else:
            raise ValueError(f"array {self.name!r} has values of type {kind}")
        if len(self.shape) == 1:
            return one
        if len(self.shape) != 2:
            raise ValueError(f"array {self.name!r} has {len(self.shape)} dimensions: {self.shape}")
        return T.ArrayType(one[0]), pa.list_(one[1])


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(name)


def _header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(stream)


def members(path: str) -> dict[str, Member]:
    """The arrays of a file by name (``data`` in a ``.npy``); only directory and headers are read."""
    with _open(path) as file:
        if not path.endswith(".npz"):
            shape, fortran, dtype = _header(file)
            return {"data": Member("data", shape, dtype.str, None if fortran or dtype.hasobject else file.tell())}
        out = {}
        with zipfile.ZipFile(file) as archive:
            for info in archive.infolist():
                with archive.open(info) as stream:
                    shape, fortran, dtype = _header(stream)
                    used = stream.tell()
                name, start = info.filename.removesuffix(".npy"), None
                if info.compress_type == zipfile.ZIP_STORED and not fortran and not dtype.hasobject:
                    file.seek(info.header_offset + 26)  # lengths of name and extra field, before the data
                    lengths = np.frombuffer(file.read(4), "<u2")
                    start = info.header_offset + 30 + int(lengths.sum()) + used
                out[name] = Member(name, shape, dtype.str, start)
        return out


def _rows(path: str, member: Member, low: int, high: int) -> np.ndarray:
    """Rows ``low`` to ``high``: by position where they are stored plainly, else from the whole array."""
    if member.start is not None:
        with _open(path) as file:
            file.seek(member.start + low * member.row_bytes)
            raw = file.read((high - low) * member.row_bytes)
        return np.frombuffer(raw, member.dtype).reshape(high - low, *member.shape[1:])
    with _open(path) as file:
        stream = zipfile.ZipFile(file).open(f"{member.name}.npy") if path.endswith(".npz") else file
        shape, fortran, dtype = _header(stream)
        if dtype.hasobject:
            return _Strings(io.BytesIO(stream.read())).load().reshape(shape)[low:high]
        whole = np.frombuffer(stream.read(), dtype).reshape(shape, order="F" if fortran else "C")
        return whole[low:high]


def _column(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    if rows.dtype.kind in "OUS":
        text = lambda v: v.decode() if isinstance(v, bytes) else str(v)
        return pa.array([text(v) for v in rows] if rows.ndim == 1 else [[text(v) for v in r] for r in rows], kind)
    if rows.ndim == 1:
        return pa.array(rows, kind)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel(), kind.value_type))


@dataclass
class Range(InputPartition):
    low: int
    high: int


class ArrayReader(DataSourceReader):
    """Rows of several arrays of one file side by side, each with its number."""

    def __init__(self, path: str, chosen: list[Member], range_bytes: int) -> None:
        self.path, self.chosen, self.range_bytes = path, chosen, range_bytes

    def partitions(self) -> Sequence[InputPartition]:
        n, width = self.chosen[0].shape[0], max(1, sum(m.row_bytes for m in self.chosen))
        # A compressed array has no ranges: it is read once, by one task.
        step = n if any(m.start is None and not np.dtype(m.dtype).hasobject for m in self.chosen) else max(1, self.range_bytes // width)
        return [Range(low, min(n, low + step)) for low in range(0, n, max(1, step))] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = ["row", *(m.name for m in self.chosen)]
        held = [None if m.start is not None else _rows(self.path, m, partition.low, partition.high) for m in self.chosen]
        for low in range(partition.low, partition.high, BATCH_ROWS):
            high = min(partition.high, low + BATCH_ROWS)
            parts = [_rows(self.path, m, low, high) if h is None else h[low - partition.low : high - partition.low] for m, h in zip(self.chosen, held)]
            columns = [_column(rows, m.types()[1]) for rows, m in zip(parts, self.chosen)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), *columns], names=names)


class ArraySource(DataSource):
    """``spark.read.format("arrays").option("arrays", "ids,embeddings").load(path)``: row, and a column per array.

    All chosen arrays (by default all with as many rows as the first) need one length. Paths are those of
    ``pyarrow.fs``: local ones, or URIs of a store it knows.
    """

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def _chosen(self) -> list[Member]:
        have, wanted = members(self.options["path"]), [n.strip() for n in self.options.get("arrays", "").split(",") if n.strip()]
        missing = [n for n in wanted if n not in have]
        if missing:
            raise KeyError(f"no arrays {missing} in {self.options['path']}: it has {sorted(have)}")
        chosen = [have[n] for n in wanted] if wanted else [m for m in have.values() if m.shape[:1] == next(iter(have.values())).shape[:1]]
        if len({m.shape[:1] for m in chosen}) != 1 or not chosen[0].shape:
            raise ValueError(f"arrays of different length: {({m.name: m.shape for m in chosen})}")
        return chosen

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("row", T.LongType()), *(T.StructField(m.name, m.types()[0]) for m in self._chosen())])

    def reader(self, schema: T.StructType) -> ArrayReader:
        return ArrayReader(self.options["path"], self._chosen(), int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_arrays(spark: SparkSession, path: str, arrays: Sequence[str] = (), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Arrays of a ``.npz`` or ``.npy`` file side by side, with ``row``."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("arrays").option("arrays", ",".join(arrays)).option("rangeBytes", range_bytes).load(path)


def read_vector_arrays(
    spark: SparkSession, path: str, id_keys: Sequence[str], vec_keys: Sequence[str], feat_keys: Sequence[str] = (), normalize: bool = True, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """``id, v[, feat]`` of a ``.npz`` file, by the first alias present of each kind; a single ``.npy`` has row numbers as ids.

    Numbers of ids and vectors have to agree, and vectors to be two-dimensional. Features of another number of
    rows are left out with a warning, as in :func:`as_vectors`.
    """
    import warnings

    have = members(path)
    if not path.endswith(".npz"):
        rows = read_arrays(spark, path, ["data"], range_bytes)
        return as_vectors(rows, ["row"], ["data"], normalize=normalize)
    first = lambda keys: next((k for k in keys if k in have), None)
    key, vec, feat = first(id_keys), first(vec_keys), first(feat_keys)
    if key is None or vec is None:
        raise KeyError(f"no ids or vectors in {path}: tried {list(id_keys)} and {list(vec_keys)}, it has {sorted(have)}")
    if len(have[vec].shape) != 2:
        raise ValueError(f"vectors {vec!r} are not two-dimensional: {have[vec].shape}")
    if have[key].shape[0] != have[vec].shape[0]:
        raise ValueError(f"{have[key].shape[0]} ids {key!r} for {have[vec].shape[0]} vectors {vec!r}")
    if feat is not None and have[feat].shape[:1] != have[vec].shape[:1]:
        warnings.warn(f"features {feat!r} ignored: {have[feat].shape} for {have[vec].shape[0]} rows", stacklevel=2)
        feat = None
    rows = read_arrays(spark, path, [key, vec, *([feat] if feat else [])], range_bytes)
    return as_vectors(rows, [key], [vec], [feat] if feat else (), normalize)


def read_candidate_arrays(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(query_id, product_id, score, rank) and k of a candidate cache with the arrays query_ids, product_ids, topk, topk_indices and topk_scores."""
    lists = read_arrays(spark, path, ["query_ids", "topk_indices", "topk_scores"])
    products = read_arrays(spark, path, ["product_ids"])
    hits = lists.select(F.col("query_ids").alias("query_id"), F.posexplode(F.arrays_zip("topk_indices", "topk_scores")).alias("at", "hit"))
    named = hits.join(products, F.col("hit.topk_indices") == F.col("row"))
    k = int(_rows(path, members(path)["topk"], 0, 1)[0])
    return named.select("query_id", F.col("product_ids").alias("product_id"), F.col("hit.topk_scores").cast("double").alias("score"), (F.col("at") + 1).alias("rank")), k
