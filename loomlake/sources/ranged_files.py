"""Formats that Spark lacks, as data sources: FASTA by byte ranges and archives of arrays by row ranges.

After ``register(spark)`` they are read with ``spark.read.format("fasta")`` and ``spark.read.format("arrays")``; the second is written
too. A path is a file or a folder (files beginning with ``.`` or ``_`` are left out) in any store that Arrow knows. The driver
lists files and reads the headers of archives; each task reads its own range, a few megabytes at a time.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

#: Bytes of a file that one task reads, unless the option ``splitBytes`` says otherwise.
SPLIT = 64 << 20
#: Bytes read, and rows' bytes given on, at a time.
CHUNK = 4 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path).rstrip("/"))


def _files(path: str) -> list[fs.FileInfo]:
    """The file, or the files of the folder and those below it, by path."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [info]
    hidden = lambda f: any(p.startswith((".", "_")) for p in f.path[len(at) :].split("/"))
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f for f in found if f.is_file and not hidden(f)), key=lambda f: f.path)


@dataclass
class Span(InputPartition):
    """Bytes or rows ``lo`` to ``hi`` of a file; without ``hi``, all that follows."""

    path: str
    lo: int
    hi: int | None
    arrays: tuple = ()


def _records(stream, lo: int, hi: int | None) -> Iterator[tuple[int, bytes]]:
    """(place of the ``>``, bytes) of each record that begins within the span; its end may lie beyond.

    A record begins at a ``>`` that is the file's first byte or follows a line break. What comes before the first is no record.
    """
    base, kept = (-1, b"\n") if lo == 0 else (lo - 1, b"")
    start, pieces = None, []
    while True:
        chunk = stream.read(CHUNK)
        data = kept + chunk
        end = len(data) - (1 if chunk and data.endswith(b"\n") else 0)  # a line break at the end may be the one before a record
        done = 0
        for border in re.finditer(b"\n>", data):
            at = base + border.start() + 1
            if start is not None:
                yield start, b"".join([*pieces, data[done : border.start()]])
            if hi is not None and at >= hi:
                return
            start, pieces, done = (at if at >= lo else None), [], border.start() + 2
        if start is not None:
            pieces.append(data[done:end])
        if not chunk:
            break
        if start is None and hi is not None and base + end >= hi:
            return
        base, kept = base + end, data[end:]
    if start is not None:
        yield start, b"".join(pieces)


def _cut(infos: list[fs.FileInfo], size: int) -> list[Span]:
    whole = [Span(i.path, 0, None) for i in infos if i.path.endswith(".gz")]
    return whole + [Span(i.path, lo, min(lo + size, i.size)) for i in infos if not i.path.endswith(".gz") for lo in range(0, i.size, size)]


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.until, self.size = options["path"], options.get("until", " #"), int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[Span]:
        return _cut(_files(self.path), self.size) or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        if not span.path:
            return
        with _store(self.path)[0].open_input_file(span.path) as raw:
            raw.seek(max(span.lo - 1, 0))
            with gzip.GzipFile(fileobj=raw) if span.path.endswith(".gz") else raw as stream:
                for place, content in _records(stream, span.lo, span.hi):
                    head, _, body = content.partition(b"\n")
                    header = head.decode("utf-8", "replace").strip()
                    name = header.split(self.until, 1)[0] if self.until else header
                    yield header, name, b"".join(body.split()).decode("utf-8", "replace"), span.path, place


class Fasta(DataSource):
    """(header, name, sequence, file, place) of the records of FASTA files, plain or gzip.

    A plain file is cut into ranges of ``splitBytes``; a record belongs to the range that holds its ``>`` and may be longer than any
    range. A gzip file cannot be entered in the middle and is one task's, read as a stream. ``name`` is the header up to the
    option ``until``; ``place`` is the byte at which a record begins, so (file, place) is the order in the files. Empty files
    have no records, a record without a sequence has an empty one, and bytes that are no UTF-8 become the replacement sign.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "header string, name string, sequence string, file string, place bigint"

    def reader(self, schema: StructType) -> FastaReader:
        return FastaReader(self.options)


@dataclass(frozen=True)
class Stored:
    """An array of an archive: where its data begin (None where they are compressed), and what they are."""

    name: str
    dtype: str
    width: int | None
    rows: int
    place: int | None


def _header(stream, name: str) -> tuple[np.dtype, tuple[int, ...]]:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(stream)
    if dtype.hasobject or not 1 <= len(shape) <= 2 or (fortran and len(shape) > 1 and min(shape) > 1):
        raise ValueError(f"{name}: arrays are plain, of one or two dimensions, and stored by rows")
    return dtype, shape


def _stored(store: fs.FileSystem, path: str) -> list[Stored]:
    """The arrays of an archive, from its directory and their headers alone."""
    out = []
    with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
        for entry in archive.infolist():
            name = entry.filename.removesuffix(".npy")
            with archive.open(entry) as member:
                dtype, shape = _header(member, f"{path}: {name}")
                read = member.tell()
            place = None
            if entry.compress_type == zipfile.ZIP_STORED:
                raw.seek(entry.header_offset)
                local = raw.read(30)
                place = entry.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little") + read
            out.append(Stored(name, dtype.str, shape[1] if len(shape) == 2 else None, shape[0], place))
    return out


_TYPES = {"f4": FloatType(), "f8": DoubleType(), "i1": ByteType(), "i2": ShortType(), "i4": IntegerType(), "i8": LongType(), "b1": BooleanType()}


def _type(array: Stored) -> DataType:
    kind = _TYPES.get(array.dtype[1:], StringType() if array.dtype[1] == "U" else None)
    if kind is None:
        raise ValueError(f"{array.name}: give a schema, as there is no type for {array.dtype}")
    return kind if array.width is None else ArrayType(kind)


def _column(values: np.ndarray, to: pa.DataType) -> pa.Array:
    values = values.astype(values.dtype.newbyteorder("="), copy=False)
    flat = values.reshape(-1)
    column = pa.array(flat.tolist() if flat.dtype.kind in "US" else flat)
    if values.ndim == 2:
        column = pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], column)
    return column.cast(to)


class ArraysReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema, self.size = options["path"], schema, int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[Span]:
        store, spans = _store(self.path)[0], []
        for info in _files(self.path):
            held = {a.name: a for a in _stored(store, info.path)}
            if absent := [n for n in self.schema.names if n not in held]:
                raise ValueError(f"{info.path} has no {', '.join(absent)}")
            arrays = tuple(held[n] for n in self.schema.names)
            rows = {a.rows for a in arrays}
            if len(rows) != 1:
                raise ValueError(f"{info.path}: parallel arrays have one length")
            n = rows.pop()
            step = max(1, self.size // max(1, sum(_width(a) for a in arrays)))
            if any(a.place is None for a in arrays):
                step = max(n, 1)
            spans += [Span(info.path, lo, min(lo + step, n), arrays) for lo in range(0, n, step)]
        return spans or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.path:
            return
        to, store = to_arrow_schema(self.schema), _store(self.path)[0]
        step = max(1, CHUNK // max(1, sum(_width(a) for a in span.arrays)))
        streams = [_opened(store, span.path, a, span.lo) for a in span.arrays]
        try:
            for lo in range(span.lo, span.hi, step):
                n = min(step, span.hi - lo)
                columns = []
                for array, stream, field in zip(span.arrays, streams, to, strict=True):
                    content = _exactly(stream, n * _width(array), span.path)
                    shape = (n,) if array.width is None else (n, array.width)
                    columns.append(_column(np.frombuffer(content, dtype=array.dtype, count=int(np.prod(shape))).reshape(shape), field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=to)
        finally:
            for stream in streams:
                stream.close()


def _width(array: Stored) -> int:
    """Bytes of a row."""
    return np.dtype(array.dtype).itemsize * (1 if array.width is None else array.width)


def _exactly(stream, n: int, path: str) -> bytes:
    parts, missing = [], n
    while missing:
        part = stream.read(missing)
        if not part:
            raise ValueError(f"{path} ends within an array")
        parts.append(part)
        missing -= len(part)
    return b"".join(parts)


def _opened(store: fs.FileSystem, path: str, array: Stored, row: int):
    """A stream that stands at a row: by a seek in stored data, past the header in compressed ones, which are read from the first row."""
    raw = store.open_input_file(path)
    if array.place is not None:
        raw.seek(array.place + row * _width(array))
        return raw
    member = zipfile.ZipFile(raw).open(f"{array.name}.npy")
    _header(member, array.name)
    return member


@dataclass
class Shards(WriterCommitMessage):
    paths: list[str]


class ArraysWriter(DataSourceArrowWriter):
    """Each task writes archives of ``splitBytes`` under a name of this write; they get their place when all tasks are done."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.size, self.overwrite = options["path"], int(options.get("splitBytes", SPLIT)), overwrite
        self.mark = uuid.uuid4().hex[:12]

    def _at(self) -> tuple[fs.FileSystem, str]:
        return _store(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shards:
        store, root = self._at()
        temporary = f"{root}/_temporary-{self.mark}"
        store.create_dir(temporary)
        made: list[str] = []
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            made.append(f"{temporary}/{uuid.uuid4().hex}.npz")
            packed = io.BytesIO()
            np.savez(packed, **{name: _plain(column, name) for name, column in zip(held[0].schema.names, pa.Table.from_batches(held).columns, strict=True)})
            with store.open_output_stream(made[-1]) as out:
                out.write(packed.getbuffer())
            held.clear()

        for batch in iterator:
            step = max(1, int(self.size * batch.num_rows // max(1, batch.nbytes)))
            for lo in range(0, batch.num_rows, step):
                held.append(batch.slice(lo, step))
                if sum(b.nbytes for b in held) >= self.size:
                    flush()
        if held:
            flush()
        return Shards(made)

    def commit(self, messages: list[Shards | None]) -> None:
        store, root = self._at()
        old = [f.path for f in _files(self.path)] if self.overwrite and store.get_file_info(root).type != fs.FileType.NotFound else []
        for message in messages:
            for k, path in enumerate(message.paths if message else []):
                store.move(path, f"{root}/{self.mark}-{path.rsplit('/', 1)[1]}")
        for path in old:
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Shards | None]) -> None:
        store, root = self._at()
        if store.get_file_info(f"{root}/_temporary-{self.mark}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_temporary-{self.mark}")


def _plain(column: pa.ChunkedArray, name: str) -> np.ndarray:
    """A column as an array; null values have no place in one."""
    values = column.combine_chunks()
    flat = values.flatten() if pa.types.is_list(values.type) else values
    if values.null_count or flat.null_count:
        raise ValueError(f"{name}: an array has no null values")
    plain = np.array(flat.to_pylist(), dtype=str) if pa.types.is_string(flat.type) else flat.to_numpy(zero_copy_only=False)
    if flat is values:
        return plain
    if len(widths := {len(v) for v in values}) > 1:
        raise ValueError(f"{name}: rows of an array have one length")
    return plain.reshape(len(values), *widths)


class Arrays(DataSource):
    """Rows of archives of parallel arrays (``.npz``): a column for each named array, a row for each place, arrays of numbers for two dimensions.

    Only headers are read ahead. Stored arrays are read by ranges of rows, so one file is many tasks'; a compressed archive is one
    task's, as a stream. Without a schema that of the first file is taken. Written archives hold ``splitBytes`` each and appear
    when the whole write has succeeded; null values and rows of unequal length are errors. Rows have no order.
    """

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> StructType:
        store, files = _store(self.options["path"])[0], _files(self.options["path"])
        if not files:
            raise ValueError("give a schema, as there is no archive")
        return StructType([StructField(a.name, _type(a)) for a in _stored(store, files[0].path)])

    def reader(self, schema: StructType) -> ArraysReader:
        return ArraysReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArraysWriter:
        return ArraysWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats ``fasta`` and ``arrays`` known to the session."""
    for source in (Fasta, Arrays):
        spark.dataSource.register(source)
    return spark
