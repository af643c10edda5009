"""Arrays in .npz archives as a Spark data source: members are read by byte range, partitions are planned from headers."""

from __future__ import annotations

import ast
import io
import json
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

# The archive's format (fixed values): signatures, and the sizes of its records' fixed parts.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
STORED, DEFLATED = 0, 8
CHUNK = 1 << 20
BATCH_BYTES = 8 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Where a path lies: any store with an address that Arrow knows, or a folder all machines share."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """Paths of the .npz files that path is, holds (a folder) or matches (a pattern in its last part), sorted."""
    fs, where = file_system(path)
    back = (lambda p: path[: len(path) - len(where)] + p) if path.endswith(where) else (lambda p: p)
    folder, _, last = where.rstrip("/").rpartition("/")
    if any(x in last for x in "*?["):
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.is_file and fnmatch(f.base_name, last)]
    else:
        info = fs.get_file_info(where)
        if info.type == pafs.FileType.Directory:
            found = [f.path for f in fs.get_file_info(pafs.FileSelector(where)) if f.is_file and f.extension == "npz"]
        else:
            found = [where] if info.is_file else []
    return [back(p) for p in sorted(found)]


@dataclass(frozen=True)
class Member:
    """An array of an archive: where its bytes lie, and what its header says of it."""

    path: str
    name: str
    method: int
    at: int
    packed: int
    skip: int
    dtype: str
    shape: tuple[int, ...]
    by_column: bool

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def width(self) -> int:
        return math.prod(self.shape[1:])


def _directory(f: pa.NativeFile) -> list[tuple[str, int, int, int]]:
    """name, method, packed size and place of the local header of each member, from the archive's end."""
    size = f.size()
    tail = f.read_at(min(size, 66_000), max(0, size - 66_000))
    i = tail.rfind(END)
    if i < 0:
        raise ValueError("not an archive")
    count, length, start = struct.unpack_from("<HII", tail, i + 10)
    if 0xFFFFFFFF in (length, start) or count == 0xFFFF:
        j = tail.rfind(LOCATOR64, 0, i)
        (place,) = struct.unpack_from("<Q", tail, j + 8)
        record = f.read_at(56, place)
        if j < 0 or record[:4] != END64:
            raise ValueError("archive without its long directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    data, at, out = f.read_at(length, start), 0, []
    for _ in range(count):
        if data[at : at + 4] != ENTRY:
            raise ValueError("broken directory")
        method, packed, full, n, extra, note, place = (*struct.unpack_from("<H", data, at + 10), *struct.unpack_from("<IIHHH", data, at + 20), *struct.unpack_from("<I", data, at + 42))
        name, more = data[at + 46 : at + 46 + n].decode(), data[at + 46 + n : at + 46 + n + extra]
        while len(more) >= 4:
            kind, long = struct.unpack_from("<HH", more)
            if kind == 1:
                # Only the fields that don't fit above are there, in this order.
                big = iter(struct.unpack_from(f"<{long // 8}Q", more, 4))
                full = next(big) if full == 0xFFFFFFFF else full
                packed = next(big) if packed == 0xFFFFFFFF else packed
                place = next(big) if place == 0xFFFFFFFF else place
            more = more[4 + long :]
        out.append((name, method, packed, place))
        at += 46 + n + extra + note
    return out


def _pieces(f: pa.NativeFile, method: int, at: int, packed: int) -> Iterator[bytes]:
    """The member's bytes, unpacked piece by piece."""
    unpack = zlib.decompressobj(-15) if method == DEFLATED else None
    for place in range(at, at + packed, CHUNK):
        data = f.read_at(min(CHUNK, at + packed - place), place)
        if unpack is None:
            yield data
            continue
        while data:
            yield unpack.decompress(data, 4 * CHUNK)
            data = unpack.unconsumed_tail
    if unpack is not None:
        yield unpack.flush()


def members(path: str) -> list[Member]:
    """The arrays of an archive, by the first bytes of each; its data stay unread."""
    fs, where = file_system(path)
    out = []
    with fs.open_input_file(where) as f:
        for name, method, packed, place in _directory(f):
            if not name.endswith(".npy") or method not in (STORED, DEFLATED):
                continue
            local = f.read_at(30, place)
            if local[:4] != LOCAL:
                raise ValueError(f"{path}: broken member {name}")
            at = place + 30 + sum(struct.unpack_from("<HH", local, 26))
            head = b""
            for piece in _pieces(f, method, at, min(packed, 70_000)):
                head += piece
                if len(head) > 70_000:
                    break
            if head[:6] != b"\x93NUMPY":
                raise ValueError(f"{path}: {name} is no array")
            (length,), first = (struct.unpack_from("<H", head, 8), 10) if head[6] == 1 else (struct.unpack_from("<I", head, 8), 12)
            said = ast.literal_eval(head[first : first + length].decode("latin-1"))
            out.append(Member(path, name.removesuffix(".npy"), method, at, packed, first + length, said["descr"], tuple(said["shape"]), bool(said["fortran_order"]) and len(said["shape"]) > 1))
    return out


def spark_type(m: Member) -> DataType:
    kind = np.dtype(m.dtype).kind if isinstance(m.dtype, str) else "V"
    plain = {"i": LongType(), "u": LongType(), "f": DoubleType(), "b": BooleanType(), "U": StringType(), "S": StringType()}.get(kind)
    if plain is None:
        raise PySparkValueError(f"{m.path}: {m.name} holds {m.dtype}, which is no plain type")
    return plain if len(m.shape) < 2 else ArrayType(plain)


@dataclass
class Rows(InputPartition):
    """Rows first to last of a member."""

    member: Member
    first: int
    last: int


class NpzReader(DataSourceReader):
    """Partitions of about rows_per_partition rows. An array kept as it is gives a partition for each run of its bytes;
    a packed one can only be unpacked from its start, so it is a partition, and goes through memory in pieces.

    Bounds of rows are options: Spark 4.1 keeps the partitions of a pushed filter for later scans of the same frame, which
    then lose rows, so no filter is pushed.
    """

    def __init__(self, found: list[Member], per: int, first: int, last: int, schema: StructType):
        self.found, self.per, self.first, self.last, self.schema = found, per, first, last, schema

    def partitions(self) -> list[InputPartition]:
        out = []
        for m in self.found:
            low, high = max(0, self.first), min(m.rows, self.last)
            step = max(1, high - low) if m.method == DEFLATED else self.per
            out += [Rows(m, i, min(i + step, high)) for i in range(low, high, step)]
        return out or [Rows(self.found[0], 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        m, dtype = part.member, np.dtype(part.member.dtype)
        fs, where = file_system(m.path)
        per = max(1, BATCH_BYTES // max(1, dtype.itemsize * m.width))
        with fs.open_input_file(where) as f:
            start = m.at + m.skip
            if m.by_column:
                for i in range(part.first, part.last, per):
                    n = min(per, part.last - i)
                    columns = [np.frombuffer(f.read_at(n * dtype.itemsize, start + (j * m.rows + i) * dtype.itemsize), dtype) for j in range(m.width)]
                    yield self._batch(m, i, np.stack(columns, axis=1))
                return
            size, at, left = dtype.itemsize * m.width, part.first, b""
            if m.method == STORED:
                pieces, ahead = _pieces(f, STORED, start + part.first * size, (part.last - part.first) * size), 0
            else:
                pieces, ahead = _pieces(f, DEFLATED, m.at, m.packed), m.skip + part.first * size
            for piece in pieces:
                if ahead:
                    ahead, piece = max(0, ahead - len(piece)), piece[ahead:]
                left += piece
                n = min(len(left) // size, part.last - at) if size else part.last - at
                if n >= per or (n and at + n == part.last):
                    for i in range(0, n, per):
                        rows = left[i * size : min(i + per, n) * size]
                        yield self._batch(m, at + i, np.frombuffer(rows, dtype).reshape(-1, m.width))
                    left, at = left[n * size :], at + n
                if at >= part.last:
                    return
            if at < part.last:
                raise ValueError(f"{m.path}: {m.name} ends after {at} of {m.rows} rows")

    def _batch(self, m: Member, first: int, rows: np.ndarray) -> pa.RecordBatch:
        kind = rows.dtype.kind
        if kind == "u" and rows.size and rows.max() > np.uint64(2**63 - 1):
            raise ValueError(f"{m.path}: {m.name} holds numbers over 2 ** 63")
        flat = rows.ravel()
        if kind in "iuf":
            flat = pa.array(flat.astype(np.int64 if kind in "iu" else np.float64))
        else:
            flat = pa.array([x.decode() if kind == "S" else x for x in flat.tolist()], pa.bool_() if kind == "b" else pa.string())
        n = len(rows)
        value = flat if len(m.shape) < 2 else pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * m.width, flat)
        columns = [pa.array([m.path] * n, pa.string()), pa.array(np.arange(first, first + n)), value]
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names)


class NpzSource(DataSource):
    """Format npz: path, row and value of one array in one or many archives.

    Options: path (a file, a folder, or a pattern in the last part) or paths (a JSON list of files), member (the array's
    name), rowsPerPartition, firstRow and lastRow (exclusive; only their bytes are read). value is a long, double, boolean or string, or for arrays of more axes a list of a row's
    entries. Archives that lack the member have no rows; without any that has it, loading fails.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def _found(self) -> list[Member]:
        name = self.options.get("member")
        if not name:
            raise PySparkValueError("option member is missing")
        paths = json.loads(self.options["paths"]) if "paths" in self.options else archives(self.options["path"])
        found = [m for p in paths for m in members(p) if m.name == name]
        if not found:
            raise FileNotFoundError(f"no archive with an array {name!r} among {len(paths)} of {self.options.get('path', 'paths')}")
        if any(m.by_column and m.method == DEFLATED for m in found):
            raise PySparkValueError(f"{name}: packed arrays in order of columns can't be read by rows in bounded memory")
        return found

    def schema(self) -> StructType:
        types = {repr(t): t for t in map(spark_type, self._found())}
        if len(types) > 1:
            raise PySparkValueError(f"{self.options['member']} differs between archives: {', '.join(types)}")
        return StructType([StructField("path", StringType()), StructField("row", LongType()), StructField("value", *types.values())])

    def reader(self, schema: StructType) -> NpzReader:
        number = lambda k, v: int(self.options.get(k, v))
        return NpzReader(self._found(), number("rowsPerPartition", 1_000_000), number("firstRow", 0), number("lastRow", 2**62), schema)


def read_array(spark: SparkSession, path: str | list[str], member: str, rows_per_partition: int = 1_000_000, rows: tuple[int, int] | None = None) -> DataFrame:
    """path, row, value of an array, by the data source npz; rows: the first, and the one after the last, of each archive."""
    spark.dataSource.register(NpzSource)
    options = {"path": path} if isinstance(path, str) else {"paths": json.dumps(path)}
    if rows is not None:
        options |= {"firstRow": str(rows[0]), "lastRow": str(rows[1])}
    return spark.read.format("npz").options(**options, member=member, rowsPerPartition=str(rows_per_partition)).load()


def write_arrays(df: DataFrame, folder: str) -> list[str]:
    """df as archives below folder, one for each partition, with an array for each column (numbers, strings or lists of
    numbers of one length); the paths written. A partition's rows pass through its task's memory. Files get their names
    when they are whole, so a task that is run again leaves one."""
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        fs, where = file_system(folder)
        fs.create_dir(where)
        task, data = TaskContext.get(), io.BytesIO()
        plain = {n: np.array(rows[n].to_pylist()) if pa.types.is_list(rows[n].type) or pa.types.is_string(rows[n].type) else rows[n].to_numpy() for n in names}
        np.savez(data, **plain)
        name = f"{where}/part-{task.partitionId():05d}.npz"
        with fs.open_output_stream(f"{name}.{task.taskAttemptId()}") as f:
            f.write(data.getvalue())
        fs.move(f"{name}.{task.taskAttemptId()}", name)
        yield pa.RecordBatch.from_pydict({"path": [name]})

    return sorted(r["path"] for r in df.mapInArrow(write, "path string").collect())


def domain_archive(folder: str, member: str = "domain_id") -> str:
    """The first archive, by name, of a run's folder (or the archive itself) that holds the member."""
    for p in archives(folder):
        if any(m.name == member for m in members(p)):
            return p
    raise FileNotFoundError(f"{folder}: no archive with {member}")


def named_path(spec: str) -> tuple[str, str]:
    """NAME=PATH; the path may hold further signs of equality."""
    name, sign, path = spec.partition("=")
    if not sign or not name or not path:
        raise ValueError(f"expected NAME=PATH, got {spec!r}")
    return name, path


def gallery_labels(spark: SparkSession, specs: list[str], member: str = "domain_id") -> DataFrame:
    """name, row, domain_id of runs NAME=PATH, all read in one job."""
    runs = [(name, domain_archive(path, member)) for name, path in map(named_path, specs)]
    if not runs:
        raise ValueError("no run is named")
    rows = read_array(spark, sorted({p for _, p in runs}), member)
    of = F.explode(F.try_element_at(F.from_json(F.lit(json.dumps(_by_path(runs))), "map<string,array<string>>"), F.col("path")))
    return rows.select(of.alias("name"), "row", F.col("value").cast("long").alias("domain_id"))


def _by_path(runs: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, path in runs:
        out.setdefault(path, []).append(name)
    return out
