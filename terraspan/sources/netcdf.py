"""NetCDF classic files (versions 1, 2 and 5) as a Spark source and sink.

A file is a table with a row for each cell of its grid: the coordinates, then every variable over all dimensions of the
grid. ``read_netcdf`` lists blocks of cells as partitions, reads the bytes of the wanted columns only, and turns a box of
coordinates, or the predicates of a query, into ranges of bytes. ``write_netcdf`` has tasks write slabs of one file side by side and puts it
in place when all are there; whatever fails leaves nothing behind.

Fill values and NaN are NULL, scale and offset are applied, and times in units since a date become timestamps. Several
files (a folder, or paths separated by commas) are read one after the other and must hold the columns of the first.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import re
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: External types of the format by code.
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {"byte": 1, "smallint": 3, "int": 4, "float": 5, "double": 6, "bigint": 10}
#: What stands for NULL in written variables.
FILL = {1: -127, 3: -32767, 4: -2147483647, 5: math.nan, 6: math.nan, 10: -9223372036854775806}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
UNIT_MICROS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000, "microsecond": 1}
SINCE = re.compile(r"\s*(\w+?)s?\s+since\s+(\d{1,4}-\d{1,2}-\d{1,2})(?:[T ]+(\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?))?\s*(?:Z|UTC|[+-]0?0:?00)?\s*$", re.I)
CALENDARS = {"standard", "gregorian", "proleptic_gregorian"}
#: Cells in a batch, and in a partition; bytes that are sooner read than skipped.
BATCH, PARTITION, GAP = 1 << 16, 1 << 20, 1 << 14
#: Values of one coordinate that a written file may have: they are held by the driver and broadcast.
MOST = 1 << 22

Range = tuple[int, int]


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    kind: int
    begin: int
    attributes: dict = field(default_factory=dict)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(KINDS[self.kind])


@dataclass
class Header:
    dims: dict[str, int]
    attributes: dict
    variables: dict[str, Variable]
    record: str | None = None
    stride: int = 0  # bytes of a record

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.dims[d] for d in v.dims)


# ---- format ----------------------------------------------------------------------------------------------------------


def header_of(f, size: int) -> Header:
    """The header of a file that is read from its beginning; size: bytes of the file."""

    def take(n: int) -> bytes:
        if len(b := f.read(n)) != n:
            raise ValueError("the header ends too soon")
        return b

    magic = take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a NetCDF classic file" + (" but HDF5 (NetCDF 4)" if magic[1:] == b"HDF" else ""))
    count, offset = ("q" if magic[3] == 5 else "i"), ("i" if magic[3] == 1 else "q")
    number = lambda code: struct.unpack(">" + code, take(struct.calcsize(">" + code)))[0]
    padded = lambda n: take(n + -n % 4)[:n]
    name = lambda: padded(number(count)).decode()

    def many(tag: int, one) -> list:
        found, n = number("i"), number(count)
        if found not in (0, tag) or (n and not found):
            raise ValueError(f"unexpected tag {found}")
        return [one() for _ in range(n)]

    def attribute() -> tuple:
        key, kind, n = name(), number("i"), number(count)
        raw = padded(n * np.dtype(KINDS[kind]).itemsize)
        values = raw.decode(errors="replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, KINDS[kind]).tolist()
        return key, values[0] if kind != 2 and len(values) == 1 else values

    def variable() -> Variable:
        key, ids = name(), [number(count) for _ in range(number(count))]
        attributes, kind, _ = dict(many(ATTRIBUTE, attribute)), number("i"), number(count)
        return Variable(key, tuple(names[i] for i in ids), kind, number(offset), attributes)

    records = number(count)
    dims = dict(many(DIMENSION, lambda: (name(), number(count))))
    names = list(dims)
    attributes = dict(many(ATTRIBUTE, attribute))
    variables = {v.name: v for v in many(VARIABLE, variable)}
    out = Header(dims, attributes, variables, next((d for d, n in dims.items() if n == 0), None))
    own = [v for v in variables.values() if v.dims[:1] == (out.record,)]
    if own:
        each = [math.prod(dims[d] for d in v.dims[1:]) * v.dtype.itemsize for v in own]
        out.stride = each[0] if len(own) == 1 else sum(n + -n % 4 for n in each)
        whole = (size - min(v.begin for v in own)) // out.stride if out.stride else 0
        dims[out.record] = whole if records < 0 else records  # of a stream, what is there
    return out


def slab(f, header: Header, v: Variable, ranges: tuple[Range, ...]) -> np.ndarray:
    """The cells of a variable in ``ranges`` of its dimensions, as few bytes as it takes."""
    shape, width = header.shape(v), v.dtype.itemsize
    wanted = list(ranges)
    inner = [math.prod(shape[k + 1 :]) * width for k in range(len(shape))]
    for k in range(len(shape) - 1, 0, -1):  # a small gap is read, not skipped
        a, b = wanted[k]
        if (a, b) != (0, shape[k]) and (shape[k] - (b - a)) * inner[k] > GAP:
            break
        wanted[k] = (0, shape[k])
    recorded = v.dims[:1] == (header.record,) if v.dims else False
    step = [header.stride if recorded and k == 0 else n for k, n in enumerate(inner)]
    run = len(shape)  # from this dimension on, cells follow each other
    while run > 0 and all(wanted[k] == (0, shape[k]) for k in range(run, len(shape))) and (run > 1 or not recorded or header.stride == inner[0]):
        run -= 1
    out = np.empty([b - a for a, b in wanted], v.dtype)
    if out.size:
        flat = out.reshape(math.prod(out.shape[:run]), -1)
        for row, at in zip(flat, itertools.product(*[range(a, b) for a, b in wanted[:run]]), strict=True):
            start = v.begin + sum(i * s for i, s in zip(at, step, strict=False)) + (wanted[run][0] * step[run] if run < len(shape) else 0)
            f.seek(start)
            if len(raw := f.read(row.nbytes)) != row.nbytes:
                raise ValueError(f"{v.name} ends too soon")
            row[:] = np.frombuffer(raw, v.dtype)
    return out[tuple(slice(a - w[0], b - w[0]) for (a, b), w in zip(ranges, wanted, strict=True))]


def decoded(v: Variable, raw: np.ndarray, times: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Values and where they are missing."""
    missing = np.zeros(raw.shape, bool)
    for key in ("_FillValue", "missing_value"):
        for x in np.atleast_1d(v.attributes.get(key, [])):
            missing |= raw == raw.dtype.type(x)
    if times and (since := SINCE.match(str(v.attributes.get("units", "")))) and since[1].lower() in UNIT_MICROS:
        if (calendar := v.attributes.get("calendar", "standard")) not in CALENDARS:
            raise ValueError(f"{v.name}: the calendar {calendar} is not supported")
        day = "-".join(f"{int(x):0{w}d}" for x, w in zip(since[2].split("-"), (4, 2, 2), strict=True))
        clock = ":".join(x if x[1:2].isdigit() else f"0{x}" for x in (since[3] or "0:0").split(":"))
        missing |= ~np.isfinite(raw.astype("f8"))
        exact = raw.dtype.kind in "iu"
        micros = np.where(missing, 0, raw).astype("i8") * UNIT_MICROS[since[1].lower()] if exact else np.rint(np.where(missing, 0, raw).astype("f8") * UNIT_MICROS[since[1].lower()]).astype("i8")
        return np.datetime64(f"{day}T{clock}", "us") + micros, missing
    scaled = "scale_factor" in v.attributes or "add_offset" in v.attributes
    if raw.dtype.kind != "f" and not scaled:
        return raw.astype("i8"), missing
    values = raw.astype("f8")
    if scaled:
        values = values * v.attributes.get("scale_factor", 1.0) + v.attributes.get("add_offset", 0.0)
    return values, missing | np.isnan(values)


def kind_of(v: Variable, times: bool) -> str:
    values, _ = decoded(v, np.zeros(0, v.dtype), times)
    return {"M": "timestamp_ntz", "f": "double"}.get(values.dtype.kind, "bigint")


# ---- source ----------------------------------------------------------------------------------------------------------


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """Paths separated by commas; a folder stands for its files that end in .nc, in order."""
    out = []
    for p in path.split(","):
        store, plain = opened(p.strip())
        if store.get_file_info(plain).type == fs.FileType.Directory:
            inside = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(plain)) if x.base_name.endswith(".nc"))
            out += [f"{p.strip().rstrip('/')}/{x}" for x in inside]
        else:
            out.append(p.strip())
    if not out:
        raise ValueError(f"no .nc file in {path}")
    return out


def file_header(path: str) -> Header:
    store, plain = opened(path)
    with store.open_input_stream(plain, buffer_size=1 << 16) as f:
        return header_of(f, store.get_file_info(plain).size)


def grid_of(header: Header) -> tuple[tuple[str, ...], list[str]]:
    """Dimensions of the grid, those of the variable with the most of them, and the variables over just these."""
    values = [v for v in header.variables.values() if v.kind != 2 and v.dims and v.dims != (v.name,)]
    if not values:
        raise ValueError("no variable over a grid")
    dims = max(values, key=lambda v: len(v.dims)).dims
    return dims, [v.name for v in values if v.dims == dims]


@dataclass
class Block(InputPartition):
    path: str
    ranges: tuple[Range, ...]


def split(ranges: tuple[Range, ...], most: int) -> list[tuple[Range, ...]]:
    """A box in boxes of at most ``most`` cells, cut along the outer dimensions first."""
    out = [ranges]
    for k in range(len(ranges)):
        rest = math.prod(b - a for a, b in ranges[k + 1 :])
        n = max(1, most // max(1, rest))
        out = [(*r[:k], (a, min(a + n, r[k][1])), *r[k + 1 :]) for r in out for a in range(r[k][0], r[k][1], n)]
        if rest <= most:
            break
    return out


def runs(mask: np.ndarray) -> list[Range]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


class NetCdfReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str] | None = None):
        self.files, self.columns = files_of(options["path"]), columns
        self.times = options.get("decode_times", "true").lower() != "false"
        self.most = int(options.get("rows_per_partition", PARTITION))
        ends = json.loads(options.get("box", "{}")).items()
        self.filters: list[tuple[str, str, object]] = [(c, test, x) for c, pair in ends for test, x in zip((">=", "<="), pair, strict=True) if x is not None]

    def coordinates(self, f, header: Header, dims: tuple[str, ...]) -> list[np.ndarray]:
        """Values along each dimension; places from 0 where the file has none."""
        out = []
        for d in dims:
            v = header.variables.get(d)
            if v is None or v.dims != (d,):
                out.append(np.arange(header.dims[d]))
                continue
            values, missing = decoded(v, slab(f, header, v, ((0, header.dims[d]),)), self.times)
            if missing.any():
                raise ValueError(f"coordinate {d} has missing values")
            out.append(values)
        return out

    def chosen(self, name: str, values: np.ndarray) -> np.ndarray:
        mask = np.ones(len(values), bool)
        like = lambda x: np.datetime64(x, "us") if values.dtype.kind == "M" else x
        for column, test, x in self.filters:
            if column == name:
                mask &= np.isin(values, [like(y) for y in x if y is not None]) if test == "in" else {"=": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}[test](values, like(x))
        return mask

    def partitions(self) -> list[Block]:
        out = []
        for path in self.files:
            header = file_header(path)
            dims, _ = grid_of(header)
            store, plain = opened(path)
            with store.open_input_file(plain) as f:
                kept = [runs(self.chosen(d, x)) for d, x in zip(dims, self.coordinates(f, header, dims), strict=True)]
            if math.prod(map(len, kept)) > 10_000:  # scattered cells: the box around them
                kept = [[(k[0][0], k[-1][1])] if k else [] for k in kept]
            out += [Block(path, r) for box in itertools.product(*kept) for r in split(box, self.most)]
        return out

    def read(self, block: Block | None) -> Iterator[pa.RecordBatch]:
        if block is None:  # no cell is wanted
            return
        header = file_header(block.path)
        store, plain = opened(block.path)
        with store.open_input_file(plain) as f:
            yield from self.batches(f, header, block.ranges)

    def batches(self, f, header: Header, ranges: tuple[Range, ...]) -> Iterator[pa.RecordBatch]:
        dims, names = grid_of(header)
        along = dict(zip(dims, self.coordinates(f, header, dims), strict=True))
        columns = self.columns if self.columns is not None else [*dims, *names]
        if gone := set(columns) - {*dims, *names}:
            raise ValueError(f"no variable {sorted(gone)} over {dims}")
        for box in split(ranges, BATCH):
            shape, out = tuple(b - a for a, b in box), []
            for c in columns:
                if c in along:
                    k = dims.index(c)
                    line = along[c][slice(*box[k])]
                    out.append(pa.array(np.broadcast_to(line.reshape([-1 if i == k else 1 for i in range(len(dims))]), shape).ravel()))
                else:
                    values, missing = decoded(header.variables[c], slab(f, header, header.variables[c], box), self.times)
                    out.append(pa.array(values.ravel(), mask=missing.ravel()))
            yield pa.RecordBatch.from_arrays(out, list(columns)) if out else pa.RecordBatch.from_struct_array(pa.array([{}] * math.prod(shape), pa.struct([])))


class PushedReader(NetCdfReader):
    """Takes a query's comparisons of coordinates too; Spark looks at all filters again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names = {EqualTo: "=", EqualNullSafe: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for x in filters:
            if type(x) in names and len(x.attribute) == 1 and x.value is not None:
                self.filters.append((x.attribute[0], names[type(x)], x.value))
            yield x


class NetCdf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        header = file_header(files_of(self.options["path"])[0])
        times = self.options.get("decode_times", "true").lower() != "false"
        dims, names = grid_of(header)
        kinds = {d: kind_of(header.variables[d], times) if d in header.variables else "bigint" for d in dims} | {n: kind_of(header.variables[n], times) for n in names}
        return ", ".join(f"`{n}` {k}" for n, k in kinds.items())

    def reader(self, schema) -> NetCdfReader:
        return (PushedReader if self.options.get("pushdown", "false").lower() == "true" else NetCdfReader)(self.options, schema.names)

    def writer(self, schema, overwrite: bool) -> NetCdfWriter:
        if "layout" not in self.options:
            raise ValueError("a NetCDF file is written by write_netcdf, which lays it out")
        return NetCdfWriter(json.loads(self.options["layout"]))


def read_netcdf(spark: SparkSession, path: str, variables: list[str] | None = None, box: dict[str, tuple] | None = None, pushdown: bool = False, **options) -> DataFrame:
    """The grid of NetCDF files: coordinates and ``variables`` (all, or those of the list that exist). Columns that are not
    asked for here are not read.

    box: least and largest value by coordinate, None for no bound; only those cells are read. pushdown: read only what the
    comparisons of coordinates in a query leave. Spark keeps a query's predicates with the table they were pushed to, and a
    second query over the same DataFrame would see them: read anew for each query then.
    options: decode_times (false: numbers stay), rows_per_partition."""
    spark.dataSource.register(NetCdf)
    options = {k: str(v) for k, v in options.items()} | {"path": path}
    if box:
        options["box"] = json.dumps({c: [x.isoformat() if hasattr(x, "isoformat") else x for x in pair] for c, pair in box.items()})
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        options["pushdown"] = "true"
    if variables is None and not box:
        return spark.read.format("netcdf").options(**options).load()
    dims, names = grid_of(file_header(files_of(path)[0]))
    if unknown := set(box or {}) - set(dims):
        raise ValueError(f"{sorted(unknown)} are no coordinates of {dims}")
    there = [n for n in (names if variables is None else variables) if n in names]
    if not there:
        raise ValueError(f"none of {variables} among {names}")
    kinds = dict(x.rsplit(" ", 1) for x in NetCdf(options).schema().split(", "))
    wanted = ", ".join(f"`{c}` {kinds[f'`{c}`']}" for c in [*dims, *there])
    return spark.read.format("netcdf").schema(wanted).options(**options).load()


# ---- sink ------------------------------------------------------------------------------------------------------------


def packed_header(dims: dict[str, int], variables: list[Variable], attributes: dict, version: int) -> bytes:
    """A header for variables of fixed size; their ``begin`` is set, in order, each at a multiple of 4."""
    count, offset = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")

    def name(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(count, len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def many(tag: int, parts: list[bytes]) -> bytes:
        return struct.pack(">i", tag if parts else 0) + struct.pack(count, len(parts)) + b"".join(parts)

    def attribute(key: str, x) -> bytes:
        kind, values = (2, x.encode()) if isinstance(x, str) else (x[0], [x[1]]) if isinstance(x, tuple) else (6, [float(x)])
        raw = values if kind == 2 else np.array(values, KINDS[kind]).tobytes()
        return name(key) + struct.pack(">i", kind) + struct.pack(count, len(values)) + raw + b"\0" * (-len(raw) % 4)

    def listed(own: dict) -> bytes:
        return many(ATTRIBUTE, [attribute(k, x) for k, x in own.items()])

    def whole() -> bytes:
        out = b"CDF" + bytes([version]) + struct.pack(count, 0) + many(DIMENSION, [name(d) + struct.pack(count, n) for d, n in dims.items()]) + listed(attributes)
        each = []
        for v in variables:
            size = math.prod(dims[d] for d in v.dims) * v.dtype.itemsize
            size += -size % 4
            ids = struct.pack(count, len(v.dims)) + b"".join(struct.pack(count, list(dims).index(d)) for d in v.dims)
            stated = size if version == 5 or size < 1 << 31 else -1 & 0x7FFFFFFF
            each.append(name(v.name) + ids + listed(v.attributes) + struct.pack(">i", v.kind) + struct.pack(count, stated) + struct.pack(offset, v.begin))
        return out + many(VARIABLE, each)

    at = len(whole())
    for v in variables:
        v.begin = at
        at += math.prod(dims[d] for d in v.dims) * v.dtype.itemsize
        at += -at % 4
    return whole()


class Written(WriterCommitMessage):
    pass


class NetCdfWriter(DataSourceArrowWriter):
    """Tasks write their slabs at their places in a file of its own folder; the commit puts the header in front and moves the
    file to where it belongs. A task that runs again writes the same bytes."""

    def __init__(self, layout: dict):
        self.layout = layout

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        cells, most, variables = self.layout["cells"], self.layout["slab"], self.layout["variables"]
        out = os.open(f"{self.layout['folder']}/data", os.O_WRONLY | os.O_CREAT)
        now, held, seen = -1, [], np.zeros(0, bool)

        def flush() -> None:
            for v, values in zip(variables, held, strict=True):
                raw, start, done = values.tobytes(), v["begin"] + now * most * values.dtype.itemsize, 0
                while done < len(raw):
                    done += os.pwrite(out, raw[done:], start + done)

        try:
            for b in iterator:
                slabs = b.column("_slab").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(slabs)) + 1).tolist(), len(slabs)] if len(slabs) else [0]
                for first, last in itertools.pairwise(cuts):
                    part = b.slice(first, last - first)
                    if slabs[first] != now:
                        if now >= 0:
                            flush()
                        now = int(slabs[first])
                        n = min(most, cells - now * most)
                        held, seen = [np.full(n, v["fill"], v["dtype"]) for v in variables], np.zeros(n, bool)
                    part = part.filter(part.column("_at").is_valid())
                    at = part.column("_at").to_numpy()
                    if seen[at].any() or len(np.unique(at)) < len(at):
                        raise ValueError("several rows for one cell")
                    seen[at] = True
                    for v, values in zip(variables, held, strict=True):
                        values[at] = part.column(v["name"]).fill_null(v["fill"]).to_numpy(zero_copy_only=False)
            if now >= 0:
                flush()
            os.fsync(out)
        finally:
            os.close(out)
        return Written()

    def commit(self, messages: list) -> None:
        folder, path = self.layout["folder"], self.layout["path"]
        with open(f"{folder}/header", "rb") as f:
            head = f.read()
        with open(f"{folder}/data", "r+b" if os.path.exists(f"{folder}/data") else "w+b") as f:
            f.write(head)
            f.truncate(self.layout["size"])
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{folder}/data", path)
        shutil.rmtree(folder)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.layout["folder"], ignore_errors=True)


def write_netcdf(df: DataFrame, path: str, dims: list[str], attributes: dict | None = None, overwrite: bool = False, version: int = 5, slab_cells: int = 1 << 20) -> None:
    """Write ``df`` as one NetCDF file over the grid of the distinct values of ``dims``; the other columns are its variables,
    their metadata (long_name, units) are kept. Cells without a row are filled; several rows for a cell, a missing
    coordinate, or a coordinate of more than ``MOST`` values are errors, after which nothing is left.

    path: on a file system that all executors mount, since they write one file. Only coordinates pass the driver."""
    spark = df.sparkSession
    spark.dataSource.register(NetCdf)
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [c for c in df.columns if c not in dims]
    lacking = [c for c in names if kinds[c] not in CODES or (kinds[c] == "bigint" and version != 5)]
    if lacking or not names:
        raise ValueError(f"no numbers that version {version} holds: {lacking or df.columns}")
    lines: dict[str, list] = {}
    for d in dims:
        values = [r[0] for r in df.select(d).distinct().limit(MOST + 1).collect()]
        if None in values or len(values) > MOST:
            raise ValueError(f"{d} is missing somewhere" if None in values else f"{d} has more than {MOST} values")
        lines[d] = sorted(values)
    shape = {d: len(v) for d, v in lines.items()}
    cells = math.prod(shape.values())
    coordinates, variables = [], []
    for d in dims:
        attrs = {k: v for k, v in df.schema[d].metadata.items() if isinstance(v, (str, int, float))}
        timed = kinds[d].startswith(("timestamp", "date"))
        kind = 6 if timed else CODES[kinds[d]] if version == 5 or kinds[d] != "bigint" else 6
        coordinates.append(Variable(d, (d,), kind, 0, attrs | ({"units": "seconds since 1970-01-01 00:00:00", "calendar": "proleptic_gregorian"} if timed else {})))
    for c in names:
        attrs = {k: v for k, v in df.schema[c].metadata.items() if isinstance(v, (str, int, float))}
        variables.append(Variable(c, tuple(dims), CODES[kinds[c]], 0, attrs | {"_FillValue": (CODES[kinds[c]], FILL[CODES[kinds[c]]])}))
    head = BytesIO(packed_header(shape, [*coordinates, *variables], attributes or {}, version))
    for v in coordinates:
        head.seek(v.begin)
        line = np.array(lines[v.name], "M8[us]").astype("i8") / 1e6 if "calendar" in v.attributes else np.array(lines[v.name])
        head.write(line.astype(v.dtype).tobytes())
    folder = os.path.join(os.path.dirname(os.path.abspath(path)), f".{os.path.basename(path)}-{uuid.uuid4().hex}")
    os.makedirs(folder)
    try:
        with open(f"{folder}/header", "wb") as f:
            f.write(head.getvalue())
        place, rows = F.lit(0).cast("long"), df
        for k, d in enumerate(dims):
            numbered = spark.createDataFrame([(x, i) for i, x in enumerate(lines[d])], f"`{d}` {kinds[d]}, `_{k}` long")
            rows = rows.join(F.broadcast(numbered), d)  # at most MOST rows
            place = place * shape[d] + F.col(f"_{k}")
        placed = rows.select(F.floor(place / slab_cells).alias("_slab"), (place % slab_cells).alias("_at"), *names)
        marks = spark.range(-(-cells // slab_cells)).select(F.col("id").alias("_slab"), F.lit(None).cast("long").alias("_at"), *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
        layout = {"folder": folder, "path": os.path.abspath(path), "cells": cells, "slab": slab_cells, "size": variables[-1].begin + cells * variables[-1].dtype.itemsize}
        layout["variables"] = [{"name": v.name, "begin": v.begin, "dtype": v.dtype.str, "fill": FILL[v.kind]} for v in variables]
        dealt = placed.unionByName(marks).repartition("_slab").sortWithinPartitions("_slab")
        dealt.write.format("netcdf").option("layout", json.dumps(layout)).mode("append").save()
    except BaseException:
        shutil.rmtree(folder, ignore_errors=True)
        raise
