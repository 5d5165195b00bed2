"""Labelled files: bytes written here by the format's description, read by Spark."""

import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.sources import labelled, schemas, tables
from larder.sources.labelled import read_labelled, value_labels, write_labelled

REGIONS = {1: "Coast", 2: "Höhe"}
# name, type, format, value-label table, values; None is missing.
COLUMNS = [("HHID", "d", "%9.0g", "", [1001.0, 1002.0, None, 2.5]), ("region", "b", "%8.0g", "regions", [1, 2, None, 100]),
           ("size", "h", "%8.0g", "", [-32767, 32740, None, 0]), ("code", "l", "%12.0g", "", [2147483620, None, -5, 0]),
           ("weight", "f", "%9.0g", "", [0.5, None, -1.25, 3.0]), ("name", 6, "%6s", "", ["été", "", "abc", "sixsix"[:6]]),
           ("day", "l", "%td", "", [0, 21915, None, -1])]
MISSING = {"b": (101, 127), "h": (32741, 32767), "l": (2147483621, 2147483647), "f": (b"\0\0\0\x7f", b"\0\xd8\0\x7f"), "d": (b"\0" * 6 + b"\xe0\x7f", b"\0" * 5 + b"\x1a\xe0\x7f")}
ROWS = 4


def cell(kind, value, order, extended, encoding):
    if isinstance(kind, int):
        return value.encode(encoding).ljust(kind, b"\0")
    if value is not None:
        return struct.pack(order + kind, value)
    missing = MISSING[kind][extended]
    return (missing if order == "<" else missing[::-1]) if isinstance(missing, bytes) else struct.pack(order + kind, missing)


def data_of(order, extended, encoding, rows):
    return b"".join(cell(kind, values[r % ROWS], order, extended, encoding) for r in range(rows) for _, kind, _, _, values in COLUMNS)


def labels_of(order, encoding):
    texts = [x.encode(encoding) + b"\0" for x in REGIONS.values()]
    return struct.pack(order + "II", 2, sum(map(len, texts))) + struct.pack(order + "II", 0, len(texts[0])) + struct.pack(order + "ii", *REGIONS) + b"".join(texts)


def tagged(release, order="<", extended=0, rows=ROWS):
    """The bytes of a file of release 117 or 118."""
    old = release == 117
    encoding = "latin-1" if old else "utf-8"
    name, form, about, count = (33, 49, 81, "I") if old else (129, 57, 321, "Q")
    p = lambda fmt, *v: struct.pack(order + fmt, *v)
    codes = {"d": 65526, "f": 65527, "l": 65528, "h": 65529, "b": 65530}
    text = lambda xs, w: b"".join(x.encode(encoding).ljust(w, b"\0") for x in xs)
    k = len(COLUMNS)
    head = (f"<stata_dta><header><release>{release}</release><byteorder>{'LSF' if order == '<' else 'MSF'}</byteorder><K>".encode() + p("H", k) + b"</K><N>"
            + p(count, rows) + b"</N><label>" + (p("B", 3) if old else p("H", 3)) + b"abc</label><timestamp>" + p("B", 17) + b"01 Jan 2020 10:00</timestamp></header>")
    table = labels_of(order, encoding)
    parts = [("variable_types", b"".join(p("H", c if isinstance(c, int) else codes[c]) for _, c, *_ in COLUMNS)), ("varnames", text([c[0] for c in COLUMNS], name)),
             ("sortlist", bytes(2 * (k + 1))), ("formats", text([c[2] for c in COLUMNS], form)), ("value_label_names", text([c[3] for c in COLUMNS], name)),
             ("variable_labels", text([f"about {c[0]}" for c in COLUMNS], about)), ("characteristics", b"<ch>" + p("I", 4) + b"abcd</ch>"),
             ("data", data_of(order, extended, encoding, rows)), ("strls", b""), ("value_labels", b"<lbl>" + p("I", len(table)) + text(["regions"], name) + bytes(3) + table + b"</lbl>")]
    places, at, body = [0, len(head)], len(head) + len("<map></map>") + 14 * 8, b""
    for part, content in parts:
        places.append(at + len(body))
        body += f"<{part}>".encode() + content + f"</{part}>".encode()
    places += [at + len(body), at + len(body) + len("</stata_dta>")]
    return head + b"<map>" + p("14Q", *places) + b"</map>" + body + b"</stata_dta>"


def plain(release=115, order=">", extended=0, rows=ROWS):
    """The bytes of a file of release 114 or 115."""
    p = lambda fmt, *v: struct.pack(order + fmt, *v)
    codes = {"d": 255, "f": 254, "l": 253, "h": 252, "b": 251}
    text = lambda xs, w: b"".join(x.encode("latin-1").ljust(w, b"\0") for x in xs)
    k, table = len(COLUMNS), labels_of(order, "latin-1")
    return (bytes([release, 1 if order == ">" else 2, 1, 0]) + p("HI", k, rows) + bytes(81) + bytes(18)
            + bytes(c if isinstance(c, int) else codes[c] for _, c, *_ in COLUMNS) + text([c[0] for c in COLUMNS], 33) + bytes(2 * (k + 1))
            + text([c[2] for c in COLUMNS], 49) + text([c[3] for c in COLUMNS], 33) + text([f"about {c[0]}" for c in COLUMNS], 81)
            + b"\x01" + p("I", 5) + b"12345" + bytes(5) + data_of(order, extended, "latin-1", rows)
            + p("I", len(table)) + text(["regions"], 33) + bytes(3) + table)


VERSIONS = [(tagged, 118, "<"), (tagged, 118, ">"), (tagged, 117, "<"), (plain, 115, ">"), (plain, 114, "<")]


@pytest.fixture
def file_of(tmp_path):
    def put(content, name="a.dta"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
        return str(path)
    return put


@pytest.mark.parametrize(("make", "release", "order"), VERSIONS)
@pytest.mark.parametrize("extended", [0, 1])
def test_every_type_and_release(spark, file_of, make, release, order, extended):
    df = read_labelled(spark, file_of(make(release, order, extended)))
    assert [f"{n} {k}" for n, k in df.dtypes] == ["HHID double", "region int", "size int", "code int", "weight double", "name string", "day date"]
    got = [tuple(r[:6]) + (r.day and (r.day - type(r.day)(1960, 1, 1)).days,) for r in df.collect()]
    assert got == list(zip(*[values for *_, values in COLUMNS], strict=True))


@pytest.mark.parametrize(("make", "release", "order"), VERSIONS)
def test_labels(spark, file_of, make, release, order):
    path = file_of(make(release, order))
    assert value_labels(path) == {"region": REGIONS} and labelled.variable_labels(path)["code"] == "about code"
    df = read_labelled(spark, path, ["region"])
    decoded = tables.decode_with(df, "region", tables.labels_dim(spark, value_labels(path)["region"]))
    assert sorted(str(r.region) for r in decoded.collect()) == ["Coast", "Höhe", "None", "None"]


def test_partitions_are_row_ranges(spark, file_of):
    width = 8 + 1 + 2 + 4 + 4 + 6 + 4
    path = file_of(tagged(118, rows=1003))
    df = read_labelled(spark, path, partition_bytes=100 * width)
    assert df.rdd.getNumPartitions() == 11
    assert [r.code for r in df.collect()] == [COLUMNS[3][-1][i % 4] for i in range(1003)]
    assert read_labelled(spark, path).rdd.getNumPartitions() == 1


def test_only_wanted_columns_are_decoded(spark, file_of, monkeypatch):
    path = file_of(tagged(118))
    header = next(iter(labelled.headers(path).values()))
    reader = labelled.Reader(path, header.schema().__class__([header.schema()["size"]]), 100)
    part = reader.partitions()[0]
    assert next(iter(reader.read(part))).schema.names == ["size"]
    df = read_labelled(spark, path, {"household": "HHID", "again": "HHID", "region": "region"})
    assert df.columns == ["household", "again", "region"] and df.count() == 4
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "weight" not in plan and "name" not in plan
    with pytest.raises(ValueError, match="lacks columns"):
        read_labelled(spark, path, ["nothing"])


def test_folder_of_files(spark, file_of, tmp_path):
    file_of(tagged(118), "f/a.dta")
    file_of(plain(), "f/b.dta")
    file_of(b"", "f/_SUCCESS")
    assert read_labelled(spark, str(tmp_path / "f")).count() == 8
    file_of(tagged(118).replace(b"region", b"REGION", 1), "f/c.dta")
    with pytest.raises(labelled.FormatError, match="different columns"):
        read_labelled(spark, str(tmp_path / "f"))


def test_refused(spark, file_of):
    with pytest.raises(labelled.FormatError, match="not a .dta"):
        read_labelled(spark, file_of(b"PAR1"))
    with pytest.raises(labelled.FormatError):
        read_labelled(spark, file_of(tagged(118)[:300]))
    strl = tagged(118).replace(struct.pack("<H", 65526) + struct.pack("<H", 65530), struct.pack("<H", 32768) + struct.pack("<H", 65530), 1)
    df = read_labelled(spark, file_of(strl, "s.dta"))
    assert read_labelled(spark, file_of(strl, "s.dta"), ["region"]).count() == 4
    with pytest.raises(Exception, match="strL"):
        df.collect()
    with pytest.raises(FileNotFoundError):
        read_labelled(spark, "/nowhere/a.dta")


def test_no_rows(spark, file_of):
    assert read_labelled(spark, file_of(tagged(118, rows=0))).count() == 0
    assert read_labelled(spark, file_of(plain(rows=0))).count() == 0


class TestWriting:
    SCHEMA = "id long, code int, x double, text string, day date, yes boolean"

    def test_round_trip(self, spark, rows, tmp_path):
        import datetime
        data = [(i, None if i % 5 == 0 else i % 3, None if i % 7 == 0 else i / 3, ["", "é" * (i % 40), None][i % 3],
                 None if i % 4 == 0 else datetime.date(1955 + i % 90, 1, 1 + i % 28), i % 2 == 0) for i in range(500)]
        df = rows(self.SCHEMA, *data).repartition(3)
        path = write_labelled(df, str(tmp_path / "out"), {"code": {0: "nö", 1: "yes", -7: "x"}})
        again = read_labelled(spark, path)
        want = {(i, c, x, t or "", d, int(y)) for i, c, x, t, d, y in data}
        assert {tuple(r) for r in again.collect()} == want
        assert value_labels(path) == {"code": {0: "nö", 1: "yes", -7: "x"}}
        with pytest.raises(Exception, match="FileExists"):
            write_labelled(df, path)
        assert read_labelled(spark, write_labelled(df.limit(7), path, overwrite=True)).count() == 7

    def test_many_files_per_task(self, spark, tmp_path):
        spark.dataSource.register(labelled.LabelledSource)
        df = spark.range(1000).select(F.col("id").cast("int").alias("id")).coalesce(1)
        path = str(tmp_path / "many")
        df.write.format("labelled").mode("append").option("fileRows", 300).save(path)
        assert len(labelled.files_of(path)) == 4
        assert sorted(r.id for r in read_labelled(spark, path).collect()) == list(range(1000))

    def test_what_failed_attempts_leave_is_not_read(self, spark, file_of, tmp_path):
        path = write_labelled(spark.range(5).select(F.col("id").cast("int").alias("id")), str(tmp_path / "w"))
        file_of(labelled.encode({"id": pa.array([7], pa.int32())}, {}), "w/_part-left.dta")
        assert read_labelled(spark, path).count() == 5

    def test_empty_and_too_large(self, spark, rows, tmp_path):
        empty = write_labelled(rows(self.SCHEMA).limit(0), str(tmp_path / "e"))
        assert read_labelled(spark, empty).columns == ["id", "code", "x", "text", "day", "yes"] and read_labelled(spark, empty).count() == 0
        with pytest.raises(Exception, match="beyond the format"):
            write_labelled(rows("id long", (1 << 40,)), str(tmp_path / "l"))
        with pytest.raises(Exception, match="2046 bytes"):
            write_labelled(rows("t string", ("x" * 2046,)), str(tmp_path / "t"))


def test_survey_tables_from_labelled_files(spark, rows, tmp_path):
    """A raw table under the file's own names, ids kept there as numbers."""
    diary = rows("interview__id string, day int, coicop4 int, coicop int, unit int, q double", ("a", 1, 111, 11101, 1, 2.5), ("b", 2, 111, 11102, None, None))
    path = write_labelled(diary, str(tmp_path / "HD_B1.dta"))
    got = tables.read_table(spark, path, schemas.DIARY, {"interview_id": "interview__id", "quantity": "q"})
    assert got.schema.names == schemas.DIARY.names and sorted(map(tuple, got.collect())) == [("a", 1, 111, 11101, 1, 2.5), ("b", 2, 111, 11102, None, None)]
    roster = rows("HHID double, s double", (1001.0, 1.0), (None, 2.0), (1.5, None))
    read = tables.read_table(spark, write_labelled(roster, str(tmp_path / "r.dta")), schemas._table(hhid=schemas._S, sex=schemas._I), {"hhid": "HHID", "sex": "s"})
    assert sorted(map(str, read.collect())) == ["Row(hhid='1.5', sex=None)", "Row(hhid='1001', sex=1)", "Row(hhid=None, sex=2)"]
