"""Labelled survey files (Stata ``.dta``) as a Spark data source.

A file is a header (types, names, formats, value-label names), rows of one fixed width, and
value labels. The driver reads the header and the labels. Rows are dealt to tasks by
number, as their width says where each begins; a task reads its stretch of the file in bounded pieces
and decodes only the columns asked for. A path may be one file or a folder of files with the same columns.

Read: releases 114, 115 (binary headers) and 117, 118, 119 (tagged headers), both byte orders.
Written: release 118, little-endian, several files per task if it holds much, each whole by itself.

A missing value of any kind is NULL. Integers become ``int``, both floating-point types ``double``,
day formats ``date``, strings ``string`` (up to the first zero byte; an empty one stays empty). Long
strings of variable place (``strL``) are refused where they are read: name the other columns.

Files are opened with ``pyarrow.fs``, by driver and executors alike: a shared folder, ``s3://``,
``gs://`` or ``hdfs://``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

PARTITION_BYTES = 32 << 20
PIECE_BYTES = 4 << 20  # read and decoded at a time
FILE_ROWS = 1 << 18  # rows of a written file at most
EPOCH_DAYS = 3653  # from 1960-01-01 to 1970-01-01

# The format's type codes, first missing values, and field widths by release.
TAGGED_TYPES = {65526: "f8", 65527: "f4", 65528: "i4", 65529: "i2", 65530: "i1"}
PLAIN_TYPES = {255: "f8", 254: "f4", 253: "i4", 252: "i2", 251: "i1"}
LONGEST_TAGGED, LONGEST_PLAIN, STRL = 2045, 244, 32768
FIRST_MISSING = {"i1": 101, "i2": 32741, "i4": 2147483621, "f4": 2.0 ** 127, "f8": 2.0 ** 1023}
NAME, FORMAT, LABEL = {114: 33, 115: 33, 117: 33, 118: 129, 119: 129}, {114: 49, 115: 49, 117: 49, 118: 57, 119: 57}, {114: 81, 115: 81, 117: 81, 118: 321, 119: 321}
SORT = {114: 2, 115: 2, 117: 2, 118: 2, 119: 4}
SECTIONS = ("stata_dta", "map", "variable_types", "varnames", "sortlist", "formats", "value_label_names", "variable_labels",
            "characteristics", "data", "strls", "value_labels", "end", "eof")


class FormatError(ValueError):
    pass


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str  # numpy type code without byte order; "S<n>" for strings, "strL"
    offset: int
    format: str = ""
    labels: str = ""
    label: str = ""

    @property
    def is_date(self) -> bool:
        return self.format.startswith(("%td", "%d", "%-td", "%-d")) and self.kind[0] in "if"

    def spark_type(self) -> T.DataType:
        if self.is_date:
            return T.DateType()
        return {"S": T.StringType(), "s": T.StringType(), "i": T.IntegerType(), "f": T.DoubleType()}[self.kind[0]]


@dataclass(frozen=True)
class Header:
    release: int
    order: str  # "<" or ">"
    rows: int
    width: int
    data: int  # where the first row begins
    labels: int  # where the value labels begin
    variables: tuple[Variable, ...] = field(default=())

    @property
    def encoding(self) -> str:
        return "utf-8" if self.release >= 118 else "latin-1"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(v.name, v.spark_type()) for v in self.variables])


class _File:
    """A random-access file with the numbers of one byte order."""

    def __init__(self, source, order: str = "<", at: int = 0):
        self.source, self.order, self.at = source, order, at

    def take(self, n: int) -> bytes:
        self.source.seek(self.at)
        found = self.source.read(n)
        if len(found) != n:
            raise FormatError(f"the file ends at {self.at + len(found)}")
        self.at += n
        return found

    def numbers(self, code: str, n: int) -> list[int]:
        kind = np.dtype(self.order + code)
        return np.frombuffer(self.take(kind.itemsize * n), kind).tolist()

    def number(self, code: str) -> int:
        return self.numbers(code, 1)[0]

    def need(self, text: str) -> None:
        found = self.take(len(text))
        if found != text.encode():
            raise FormatError(f"{text!r} expected, {found!r} found")

    def texts(self, n: int, width: int, encoding: str) -> list[str]:
        raw = self.take(n * width)
        return [raw[i * width:(i + 1) * width].split(b"\0", 1)[0].decode(encoding, "replace") for i in range(n)]


def read_header(source) -> Header:
    """The header of an open ``.dta`` file of any release that is read here."""
    f = _File(source)
    first = f.take(1)[0]
    if first == ord("<"):
        return _tagged(_File(source))
    if first in (114, 115):
        return _plain(f, first)
    raise FormatError("not a .dta file of release 114, 115 or 117 to 119")


def _tagged(f: _File) -> Header:
    f.need("<stata_dta><header><release>")
    release = int(f.take(3))
    if release not in (117, 118, 119):
        raise FormatError(f"release {release}")
    f.need("</release><byteorder>")
    f.order = {b"LSF": "<", b"MSF": ">"}[f.take(3)]
    f.need("</byteorder><K>")
    n = f.number("u4" if release == 119 else "u2")
    f.need("</K><N>")
    rows = f.number("u4" if release == 117 else "u8")
    f.need("</N><label>")
    f.take(f.number("u1" if release == 117 else "u2"))
    f.need("</label><timestamp>")
    f.take(f.number("u1"))
    f.need("</timestamp></header><map>")
    where = dict(zip(SECTIONS, f.numbers("u8", len(SECTIONS)), strict=True))

    def section(name: str) -> _File:
        part = _File(f.source, f.order, where[name])
        part.need(f"<{name}>")
        return part

    codes = section("variable_types").numbers("u2", n)
    encoding = "utf-8" if release >= 118 else "latin-1"
    text = lambda name, width: section(name).texts(n, width[release], encoding)
    kinds = ["strL" if c == STRL else f"S{c}" if c <= LONGEST_TAGGED else TAGGED_TYPES[c] for c in codes]
    variables, width = _placed(kinds, text("varnames", NAME), text("formats", FORMAT), text("value_label_names", NAME), text("variable_labels", LABEL))
    return Header(release, f.order, rows, width, where["data"] + len("<data>"), where["value_labels"], variables)


def _plain(f: _File, release: int) -> Header:
    f.order = {1: ">", 2: "<"}[f.take(1)[0]]
    f.take(2)
    n, rows = f.number("u2"), f.number("u4")
    f.take(81 + 18)  # the file's label and its time
    codes = f.numbers("u1", n)
    kinds = [f"S{c}" if c <= LONGEST_PLAIN else PLAIN_TYPES[c] for c in codes]
    names = f.texts(n, NAME[release], "latin-1")
    f.take(SORT[release] * (n + 1))
    formats, labels = f.texts(n, FORMAT[release], "latin-1"), f.texts(n, NAME[release], "latin-1")
    about = f.texts(n, LABEL[release], "latin-1")
    while True:  # fields that nothing here needs, up to an empty one
        kind, size = f.number("u1"), f.number("u4")
        if not kind and not size:
            break
        f.take(size)
    variables, width = _placed(kinds, names, formats, labels, about)
    return Header(release, f.order, rows, width, f.at, f.at + rows * width, variables)


def _placed(kinds: Sequence[str], *texts: Sequence[str]) -> tuple[tuple[Variable, ...], int]:
    out, offset = [], 0
    for kind, name, form, labels, about in zip(kinds, *texts, strict=True):
        out.append(Variable(name, kind, offset, form, labels, about))
        offset += 8 if kind == "strL" else int(kind[1:])
    return tuple(out), offset


def read_value_labels(source, header: Header) -> dict[str, dict[int, str]]:
    """The value-label tables of a file, by the tables' names."""
    f, out = _File(source, header.order, header.labels), {}
    tagged = header.release >= 117
    if tagged:
        f.need("<value_labels>")
    end = source.size()
    while f.at < end:
        if tagged:
            if f.take(5) != b"<lbl>":
                break
        f.take(4)  # how long the table is
        name = f.texts(1, NAME[header.release], header.encoding)[0]
        f.take(3)
        n, size = f.numbers("u4", 2)
        starts, codes = f.numbers("u4", n), f.numbers("i4", n)
        text = f.take(size)
        out[name] = {code: text[start:].split(b"\0", 1)[0].decode(header.encoding, "replace") for start, code in zip(starts, codes, strict=True)}
        if tagged:
            f.need("</lbl>")
    return out


def decode(raw: bytes, header: Header, variables: Sequence[Variable]) -> list[pa.Array]:
    """Columns of the rows in ``raw``; what lies between the wanted columns is skipped."""
    kinds = [f"V{1}" if v.kind == "strL" else v.kind if v.kind[0] == "S" else header.order + v.kind for v in variables]
    layout = np.dtype({"names": [f"c{i}" for i in range(len(kinds))], "formats": kinds, "offsets": [v.offset for v in variables], "itemsize": header.width})
    rows = np.frombuffer(raw, layout)
    return [_column(rows[f"c{i}"], v, header) for i, v in enumerate(variables)]


def _column(values: np.ndarray, v: Variable, header: Header) -> pa.Array:
    if v.kind == "strL":
        raise FormatError(f"{v.name} is a strL column, which is not read")
    if v.kind[0] == "S":
        texts = [x.split(b"\0", 1)[0] for x in values.tolist()]
        if header.encoding == "latin-1":
            return pa.array([x.decode("latin-1") for x in texts], pa.string())
        return pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())
    with np.errstate(invalid="ignore"):
        missing = ~(values < FIRST_MISSING[v.kind])
    if v.is_date:
        days = np.where(missing, 0, values).astype(np.int32) - EPOCH_DAYS
        return pa.array(days, mask=missing).cast(pa.date32())
    kind = np.int32 if v.kind[0] == "i" else np.float64
    return pa.array(np.ascontiguousarray(values, values.dtype.newbyteorder("=")).astype(kind), mask=missing)


# Files.

def _opened(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^s3[an]://", "s3://", path)
    if re.match(r"^file:/|^/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[str]:
    """The files of a path, itself or those in the folder, as the path's file system names them."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [inner]
    inside = system.get_file_info(fs.FileSelector(inner))
    return sorted(x.path for x in inside if x.type == fs.FileType.File and x.extension.lower() == "dta" and not x.base_name.startswith(("_", ".")))


def headers(path: str) -> dict[str, Header]:
    """Each file's header; all files must have the same columns."""
    system, _ = _opened(path)
    found = {}
    for name in files_of(path):
        with system.open_input_file(name) as source:
            found[name] = read_header(source)
    if not found:
        raise FileNotFoundError(f"no .dta file in {path}")
    kinds = {tuple((v.name, v.spark_type()) for v in h.variables) for h in found.values()}
    if len(kinds) > 1:
        raise FormatError(f"the files of {path} have different columns")
    return found


def value_labels(path: str) -> dict[str, dict[int, str]]:
    """Code to label for every labelled column of a file (of the first file of a folder)."""
    system, _ = _opened(path)
    name, header = next(iter(headers(path).items()))
    with system.open_input_file(name) as source:
        tables = read_value_labels(source, header)
    return {v.name: tables[v.labels] for v in header.variables if v.labels in tables}


def variable_labels(path: str) -> dict[str, str]:
    """What the file says about each column."""
    return {v.name: v.label for v in next(iter(headers(path).values())).variables}


# Reading.

@dataclass
class Rows(InputPartition):
    """A stretch of a file's rows."""

    def __init__(self, file: str, start: int, stop: int, header: Header):
        super().__init__(None)
        self.file, self.start, self.stop, self.header = file, start, stop, header


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, partition_bytes: int):
        self.path, self.columns, self.partition_bytes = path, schema.names, partition_bytes
        self.schema = to_arrow_schema(schema)

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for name, header in headers(self.path).items():
            per = max(1, self.partition_bytes // max(1, header.width))
            out += [Rows(name, start, min(start + per, header.rows), header) for start in range(0, header.rows, per)]
        return out or [Rows("", 0, 0, Header(118, "<", 0, 0, 0, 0))]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        header = partition.header
        by_name = {v.name: v for v in header.variables}
        wanted = [by_name[c] for c in self.columns]
        per = max(1, PIECE_BYTES // max(1, header.width))
        system, _ = _opened(self.path)
        with system.open_input_file(partition.file) as source:
            f = _File(source, header.order, header.data + partition.start * header.width)
            for start in range(partition.start, partition.stop, per):
                n = min(per, partition.stop - start)
                columns = decode(f.take(n * header.width), header, wanted)
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)


# Writing.

def encode(columns: Mapping[str, pa.Array], labels: Mapping[str, Mapping[int, str]]) -> bytes:
    """A whole file of release 118 with these columns; labels by column."""
    kinds, parts = {}, {}
    n = len(next(iter(columns.values()))) if columns else 0
    for name, column in columns.items():
        kinds[name], parts[name] = _encoded(name, column)
    layout = np.dtype([(f"c{i}", k if k[0] == "S" else "<" + k) for i, k in enumerate(kinds.values())])
    rows = np.zeros(n, layout)
    for i, part in enumerate(parts.values()):
        rows[f"c{i}"] = part
    padded = lambda texts, width: b"".join(_fits(x, width).ljust(width, b"\0") for x in texts)
    codes = {v: k for k, v in TAGGED_TYPES.items()}
    types = np.array([int(k[1:]) if k[0] == "S" else codes[k] for k in kinds.values()], "<u2").tobytes()
    dates = {name for name, c in columns.items() if pa.types.is_date(c.type)}
    formats = ["%td" if x in dates else f"%{k[1:]}s" if k[0] == "S" else "%12.0g" for x, k in kinds.items()]
    k, width = len(kinds), NAME[118]
    body = {
        "variable_types": types, "varnames": padded(kinds, width), "sortlist": bytes(2 * (k + 1)), "formats": padded(formats, FORMAT[118]),
        "value_label_names": padded([x if x in labels else "" for x in kinds], width), "variable_labels": bytes(k * LABEL[118]), "characteristics": b"",
        "data": rows.tobytes(), "strls": b"", "value_labels": b"".join(_label_table(x, labels[x]) for x in kinds if x in labels)}
    head = (b"<stata_dta><header><release>118</release><byteorder>LSF</byteorder><K>" + np.uint16(k).tobytes() + b"</K><N>" + np.uint64(n).tobytes()
            + b"</N><label>\0\0</label><timestamp>\0</timestamp></header>")
    sections, at = {"stata_dta": 0, "map": len(head)}, len(head) + len("<map></map>") + 8 * len(SECTIONS)
    out = []
    for name, content in body.items():
        sections[name] = at
        out.append(f"<{name}>".encode() + content + f"</{name}>".encode())
        at += len(out[-1])
    sections |= {"end": at, "eof": at + len("</stata_dta>")}
    where = np.array([sections[x] for x in SECTIONS], "<u8").tobytes()
    return b"".join([head, b"<map>", where, b"</map>", *out, b"</stata_dta>"])


def _fits(text: str, width: int) -> bytes:
    raw = text.encode()
    if len(raw) >= width:
        raise FormatError(f"{text!r} is too long a name")
    return raw


def _encoded(name: str, column: pa.Array) -> tuple[str, np.ndarray]:
    """The type code and the values, missing ones as the format's plain missing value."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        raw = [b"" if x is None else x.encode() for x in column.to_pylist()]
        width = max([1, *map(len, raw)])
        if width > LONGEST_TAGGED:
            raise FormatError(f"{name} has a text of {width} bytes")
        return f"S{width}", np.array(raw, f"S{width}") if raw else np.zeros(0, f"S{width}")
    if pa.types.is_date(column.type):
        values = column.cast(pa.date32()).cast(pa.int32()).fill_null(0).to_numpy() + EPOCH_DAYS
    elif pa.types.is_boolean(column.type):
        values = column.cast(pa.int8()).fill_null(0).to_numpy()
    else:
        values = column.fill_null(0).to_numpy()
    kind = "f8" if values.dtype.kind == "f" else "i4"
    if kind == "i4" and len(values) and max(abs(int(values.min())), int(values.max())) >= FIRST_MISSING["i4"]:
        raise FormatError(f"{name} has an integer beyond the format's range")
    values = values.astype(kind)
    fits = values < FIRST_MISSING[kind]  # what is no number, or too large for the format, is missing
    return kind, np.where(known & fits, values, np.array(FIRST_MISSING[kind], kind))


def _label_table(name: str, labels: Mapping[int, str]) -> bytes:
    codes = sorted(labels)
    texts = [labels[c].encode() + b"\0" for c in codes]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    table = (np.array([len(codes), sum(map(len, texts))], "<u4").tobytes() + starts.astype("<u4").tobytes() + np.array(codes, "<i4").tobytes() + b"".join(texts))
    return b"<lbl>" + np.uint32(len(table)).tobytes() + _fits(name, NAME[118]).ljust(NAME[118], b"\0") + bytes(3) + table + b"</lbl>"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    """Files of each task under names that no reader sees; those of the attempts that count get their names at the end.

    What a failed attempt leaves is not read, and ``_SUCCESS`` says that the folder is complete.
    """

    def __init__(self, path: str, labels: Mapping[str, Mapping[int, str]], rows: int, overwrite: bool, schema: T.StructType):
        self.path, self.labels, self.rows, self.schema = path, labels, rows, to_arrow_schema(schema)
        system, inner = _opened(path)
        if not overwrite and system.get_file_info(inner).type != fs.FileType.NotFound and files_of(path):
            raise FileExistsError(path)
        self.before = files_of(path) if overwrite and system.get_file_info(inner).type != fs.FileType.NotFound else []
        system.create_dir(inner)

    def write(self, iterator: Iterable[pa.RecordBatch]) -> WriterCommitMessage:
        system, inner = _opened(self.path)
        files: list[str] = []
        held: list[pa.RecordBatch] = []

        def put() -> None:
            whole = pa.Table.from_batches(held, self.schema)
            name = f"{inner.rstrip('/')}/_part-{uuid.uuid4().hex}.dta"
            files.append(name)
            with system.open_output_stream(name) as sink:
                sink.write(encode({c: whole.column(c).combine_chunks() for c in whole.column_names}, self.labels))
            held.clear()

        for batch in iterator:
            for at in range(0, batch.num_rows, self.rows):
                held.append(batch.slice(at, self.rows))
                if sum(b.num_rows for b in held) >= self.rows:
                    put()
        if held:
            put()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = _opened(self.path)
        if not any(m and m.files for m in messages):  # an empty table still has columns
            with system.open_output_stream(f"{inner.rstrip('/')}/part-{uuid.uuid4().hex}.dta") as sink:
                sink.write(encode({f.name: pa.array([], f.type) for f in self.schema}, self.labels))
        for name in self.before:
            system.delete_file(name)
        for name in [x for m in messages if m for x in m.files]:
            system.move(name, name.replace("/_part-", "/part-"))
        with system.open_output_stream(f"{inner.rstrip('/')}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _opened(self.path)
        for name in [x for m in messages if m for x in m.files]:
            if system.get_file_info(name).type == fs.FileType.File:
                system.delete_file(name)


class LabelledSource(DataSource):
    """``spark.read.format("labelled").load(path)``; a schema that names fewer columns reads only those."""

    @classmethod
    def name(cls) -> str:
        return "labelled"

    def schema(self) -> T.StructType:
        return next(iter(headers(self.options["path"]).values())).schema()

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        labels = {c: {int(k): v for k, v in codes.items()} for c, codes in json.loads(self.options.get("labels", "{}")).items()}
        return Writer(self.options["path"], labels, int(self.options.get("filerows", FILE_ROWS)), overwrite, schema)


def read_labelled(spark: SparkSession, path: str, columns: Sequence[str] | Mapping[str, str] | None = None,
                  partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """A labelled file or folder, all columns or those named; a mapping ``{name here: name in the file}`` renames them.

    Columns keep their codes; ``value_labels`` has the codes' meaning, for ``labels_dim`` and ``decode_with``.
    """
    spark.dataSource.register(LabelledSource)
    there = next(iter(headers(path).values())).schema()
    names = {c: c for c in there.names} if columns is None else dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    absent = [c for c in names.values() if c not in there.names]
    if absent:
        raise ValueError(f"{path} lacks columns {absent}")
    schema = T.StructType([there[c] for c in dict.fromkeys(names.values())])
    df = spark.read.format("labelled").schema(schema).option("partitionBytes", partition_bytes).load(path)
    return df.select(*[df[inside].alias(name) for name, inside in names.items()])


def write_labelled(df: DataFrame, path: str, labels: Mapping[str, Mapping[int, str]] | None = None, overwrite: bool = False) -> str:
    """A folder of labelled files. 64-bit integers must fit into 32 bits."""
    df.sparkSession.dataSource.register(LabelledSource)
    wanted = {c: {str(k): v for k, v in codes.items()} for c, codes in (labels or {}).items()}
    df.write.format("labelled").mode("overwrite" if overwrite else "append").option("labels", json.dumps(wanted)).save(path)
    return path
