"""Excel sheets as a Spark data source, reading and writing.

`spark.dataSource.register(ExcelSource)`, then

    spark.read.format("xlsx").option("sheet", "Schools").load(path)
    df.write.format("xlsx").option("sheet", "Schools").mode("append").save(folder)

A file is a zip of XML parts. A read plans one task per file and row range (`taskRows` rows each, a sheet's size being told by its
`dimension` mark; without one the file is one task) and parses the sheet as a stream: rows before the range are skipped as bytes,
without parsing, and the task stops at its end. Only the shared strings of the file are held, which the format puts in one list. A write makes
files of at most `fileRows` rows in each task, text inline, under names of their own that a commit keeps and an abort removes; a task holds
the rows of one file compressed.

Paths are local or shared folders, or addresses that pyarrow's file systems open; a folder or a pattern stands for all its .xlsx files.

Options: `sheet` (name; the first by default), `header` (true), `skipRows` (rows above the header, 0). The schema is that
of the reader, or text columns named by the header: empty names become `_c<place>`, repeated ones get their place added. Typed
columns read numbers, dates (serial numbers of the 1900 calendar or ISO text) and booleans; what does not fit is null.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Name spaces of the format, its first day, the built-in date formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DAY_ZERO = datetime.datetime(1899, 12, 30)
TASK_ROWS, FILE_ROWS = 100_000, 1_000_000
#: Characters that XML cannot hold are written as _xHHHH_, as the format does.
UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\r]|_(?=x[0-9A-Fa-f]{4}_)")
CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")
#: Tags of a sheet's XML as bytes: the start of its rows, and a row with its number.
DATA_TAG = re.compile(rb"<(?:[\w.-]+:)?sheetData(?:\s[^<>]*[^<>/])?>")
ROW_TAG = re.compile(rb"""<(?:[\w.-]+:)?row(?=\s)[^<>]*?\sr\s*=\s*["'](\d+)["']""")
#: Bytes of a sheet that are read at once, and rows of a file that a writing task compresses together.
READ_BYTES, BLOCK_ROWS = 1 << 20, 1_000
#: Types whose columns are handed to Spark in batches of so many rows; zones and scales of others are left to Spark.
ARROW_TYPES = {T.StringType: pa.string, T.BooleanType: pa.bool_, T.DateType: pa.date32, T.DoubleType: pa.float64, T.LongType: pa.int64, T.IntegerType: pa.int32, T.ShortType: pa.int16}
BATCH_ROWS = 5_000


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[str]:
    """The .xlsx files that a path names."""
    from pyarrow import fs

    system, inner = _fs(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    pattern = None
    if any(c in inner for c in "*?["):
        inner, pattern = posixpath.split(inner)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [prefix + inner]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File]
    keep = [n for n in names if n.lower().endswith(".xlsx") and posixpath.basename(n)[0] not in "._~" and (pattern is None or fnmatch(posixpath.basename(n), pattern))]
    return [prefix + n for n in sorted(keep)]


def column_place(ref: str) -> int:
    """Place of a cell's column: A1 is 0, AA7 is 26."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_name(place: int) -> str:
    out, n = "", place + 1
    while n:
        n, left = divmod(n - 1, 26)
        out = chr(65 + left) + out
    return out


def _text(node: ElementTree.Element) -> str:
    """All runs of a string, phonetic notes left out."""
    parts = []
    for child in node:
        if child.tag == MAIN + "t":
            parts.append(child.text or "")
        elif child.tag == MAIN + "r":
            parts += [t.text or "" for t in child.iterfind(MAIN + "t")]
    out = "".join(parts)
    return CODED.sub(lambda m: chr(int(m[1], 16)), out) if "_x" in out else out


class _Joined:
    """Bytes that were read already, and the rest of a file."""

    def __init__(self, seen: bytes, rest):
        self.seen, self.rest = io.BytesIO(seen), rest

    def read(self, n: int) -> bytes:
        return self.seen.read(n) or self.rest.read(n)


def from_row(sheet, first: int) -> _Joined:
    """A sheet's XML without most of the rows before row `first`, which are passed over as bytes.

    The rest starts at a row that tells its number, at most `first`, so rows without numbers still count from there. Sheets in
    encodings other than UTF-8 or without such rows stay whole; comments and CDATA sections, where a tag may be mere text, end the passing.
    """
    head = b""
    while (start := DATA_TAG.search(head)) is None:
        block = sheet.read(READ_BYTES)
        head += block
        if not block or len(head) > 16 * READ_BYTES:
            return _Joined(head, sheet)
    coded = re.search(rb"""^<\?xml[^>]*encoding\s*=\s*["']([\w.-]+)""", head)
    if b"<!" in head[: start.end()] or (coded and coded[1].lower() not in (b"utf-8", b"us-ascii")):
        return _Joined(head, sheet)
    head, held = head[: start.end()], head[start.end() :]
    while b"<!" not in held and len(held) <= 16 * READ_BYTES:
        # the last rows of the block tell whether all of it can go; otherwise they are gone through from the first
        near, last = 0, None
        for last in ROW_TAG.finditer(held, max(0, len(held) - READ_BYTES // 8)):
            pass
        if last is not None and int(last[1]) <= first:
            near = last.start()
        else:
            for row in ROW_TAG.finditer(held):
                if int(row[1]) > first:
                    return _Joined(head + held[near:], sheet)
                near = row.start()
        block = sheet.read(READ_BYTES)
        held = held[near:] + block
        if not block:
            break
    return _Joined(head + held, sheet)


class Workbook:
    """One open file."""

    def __init__(self, path: str):
        system, inner = _fs(path)
        self.file = system.open_input_file(inner)
        self.zip = zipfile.ZipFile(self.file)

    def __enter__(self) -> Workbook:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.file.close()

    def sheet_part(self, name: str | None) -> str:
        """Path inside the zip of a sheet, the first if none is named."""
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(self.zip.open("xl/_rels/workbook.xml.rels")).getroot().iter(PACKAGE + "Relationship")}
        sheets = {s.get("name"): s.get(RELATED + "id") for s in ElementTree.parse(self.zip.open("xl/workbook.xml")).getroot().iter(MAIN + "sheet")}
        if not sheets or (name is not None and name not in sheets):
            raise ValueError(f"no sheet {name!r}; there are {sorted(sheets)}")
        target = targets[sheets[name] if name is not None else next(iter(sheets.values()))]
        return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")

    def shared_strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        out = []
        for _, node in ElementTree.iterparse(self.zip.open("xl/sharedStrings.xml")):
            if node.tag == MAIN + "si":
                out.append(_text(node))
                node.clear()
        return out

    def last_row(self, part: str) -> int | None:
        """Number of the last row by the sheet's dimension mark, None where it has none."""
        for _, node in ElementTree.iterparse(self.zip.open(part), events=("start",)):
            if node.tag == MAIN + "dimension":
                found = re.search(r":[A-Za-z]+(\d+)$", node.get("ref") or "")
                return int(found[1]) if found else None
            if node.tag == MAIN + "sheetData":
                return None
        return None

    def rows(self, part: str, first: int = 1, last: int | None = None) -> Iterator[tuple[int, dict[int, str]]]:
        """(row number, {column place: raw text}) of the rows from `first` to `last`."""
        shared = None
        places: dict[str, int] = {}
        number, data = 0, None
        sheet = self.zip.open(part)
        for event, node in ElementTree.iterparse(sheet if first <= 2 else from_row(sheet, first), events=("start", "end")):
            if event == "start":
                if node.tag == MAIN + "sheetData":
                    data = node
                elif node.tag == MAIN + "row":
                    number = int(node.get("r") or number + 1)
                    if last is not None and number > last:
                        return
                continue
            if node.tag != MAIN + "row":
                continue
            if number >= first:
                cells: dict[int, str] = {}
                k = -1
                for c in node:
                    if c.tag != MAIN + "c":
                        continue
                    k += 1
                    kind, ref = c.get("t"), c.get("r")
                    if kind == "inlineStr":
                        inner = next((x for x in c if x.tag == MAIN + "is"), None)
                        raw = _text(inner) if inner is not None else None
                    else:
                        raw = next((x.text for x in c if x.tag == MAIN + "v"), None)
                        if raw is None or kind == "e":
                            continue
                        if kind == "s":
                            shared = self.shared_strings() if shared is None else shared
                            raw = shared[int(raw)]
                        elif kind == "b":
                            raw = "true" if raw == "1" else "false"
                    if raw is not None:
                        letters = ref.rstrip("0123456789") if ref else None
                        if letters and letters not in places:
                            places[letters] = column_place(letters)
                        cells[places[letters] if letters else k] = raw
                yield number, cells
            if data is not None:
                data.clear()


def _date(raw: str) -> datetime.datetime:
    try:
        return DAY_ZERO + datetime.timedelta(microseconds=round(float(raw) * 86_400_000_000))
    except ValueError:
        return datetime.datetime.fromisoformat(raw)


def caster(kind: T.DataType):
    """Raw cell text to a value of the type; text that does not fit gives None."""
    import decimal

    def whole(raw: str) -> int | None:
        if raw.isascii() and raw.isdigit():
            return int(raw)
        n = decimal.Decimal(raw.strip())
        return int(n) if n == n.to_integral_value() else None

    def number(raw: str):
        return decimal.Decimal(raw.strip()).quantize(decimal.Decimal(1).scaleb(-kind.scale), decimal.ROUND_HALF_UP)

    if isinstance(kind, T.StringType):
        return str
    by_type = {
        T.BooleanType: lambda raw: {"true": True, "1": True, "false": False, "0": False}.get(raw.strip().lower()), T.DateType: lambda raw: _date(raw.strip()).date(),
        T.TimestampType: lambda raw: _date(raw.strip()), T.TimestampNTZType: lambda raw: _date(raw.strip()), T.DecimalType: number,
        T.DoubleType: float, T.FloatType: float, T.LongType: whole, T.IntegerType: whole, T.ShortType: whole,
    }
    if type(kind) not in by_type:
        raise TypeError(f"cells cannot be read as {kind.simpleString()}")
    read = by_type[type(kind)]
    limit = {T.LongType: 63, T.IntegerType: 31, T.ShortType: 15}.get(type(kind))

    def cast(raw: str):
        try:
            value = read(raw)
        except (ValueError, ArithmeticError, OverflowError):
            return None
        return None if limit and value is not None and not -(2**limit) <= value < 2**limit else value

    return cast


@dataclass
class SheetRange(InputPartition):
    path: str
    first: int
    last: int | None

    def __post_init__(self) -> None:
        super().__init__(None)


def _is_true(options: dict, name: str, default: str = "true") -> bool:
    return str(options.get(name, default)).lower() == "true"


def header_names(cells: dict[int, str]) -> list[str]:
    out: list[str] = []
    for k in range(max(cells, default=-1) + 1):
        name = (cells.get(k) or "").strip() or f"_c{k}"
        out.append(name if name.lower() not in {o.lower() for o in out} else f"{name}_{k}")
    return out


class ExcelReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.task_rows = int(options.get("taskRows", TASK_ROWS))
        self.sheet, self.header = options.get("sheet"), _is_true(options, "header")
        self.skip = int(options.get("skipRows", 0))

    def partitions(self) -> list[InputPartition]:
        step = self.task_rows
        first = self.skip + 1 + self.header
        out: list[InputPartition] = []
        for path in list_files(self.path):
            with Workbook(path) as book:
                last = book.last_row(book.sheet_part(self.sheet))
            starts = list(range(first, (last or first) + 1, step)) or [first]
            # the last range is open, as a dimension mark may be out of date
            out += [SheetRange(path, a, a + step - 1 if a != starts[-1] else None) for a in starts]
        return out

    def read(self, partition: SheetRange) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        casts = [caster(f.dataType) for f in self.schema.fields]
        with Workbook(partition.path) as book:
            part = book.sheet_part(self.sheet)
            places = list(range(len(casts)))
            if self.header:
                # columns are found by name, so files may order them differently
                names = next((header_names(c) for _, c in book.rows(part, self.skip + 1, self.skip + 1)), [])
                known = {n.lower(): k for k, n in enumerate(names)}
                places = [known.get(f.name.lower(), -1) for f in self.schema.fields]
            rows = (cells for _, cells in book.rows(part, partition.first, partition.last) if cells)
            if not {type(f.dataType) for f in self.schema.fields} <= set(ARROW_TYPES):
                for cells in rows:
                    yield tuple(None if (raw := cells.get(k)) is None else cast(raw) for k, cast in zip(places, casts))
                return
            # columns of whole batches: Spark takes them as they are, row by row it converts every value
            kinds = [ARROW_TYPES[type(f.dataType)]() for f in self.schema.fields]
            while block := list(islice(rows, BATCH_ROWS)):
                values = [[None if (raw := cells.get(k)) is None else cast(raw) for cells in block] for k, cast in zip(places, casts)]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, kinds)], names=self.schema.names)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class _Rows:
    """The rows of one file under their header as XML, compressed until their number is known, which the format puts first."""

    def __init__(self, names: list[str]):
        self.columns = [column_name(k) for k in range(len(names))]
        self.count, self.packed, self.open = -1, [], []
        self.add(names)

    def add(self, row) -> None:
        self.count += 1
        n = self.count + 1
        self.open.append(f'<row r="{n}">{"".join([cell(c, n, v) for c, v in zip(self.columns, row) if v is not None])}</row>')
        if len(self.open) == BLOCK_ROWS:
            self.packed.append(zlib.compress("".join(self.open).encode(), 1))
            self.open = []

    def blocks(self) -> Iterator[bytes]:
        yield from map(zlib.decompress, self.packed)
        yield "".join(self.open).encode()


class ExcelWriter(DataSourceWriter):
    """Each task writes its rows to files of its own."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.path = schema, options["path"]
        self.sheet = options.get("sheet", "Sheet1")
        self.file_rows = int(options.get("fileRows", FILE_ROWS))
        self.old = list_files(self.path) if overwrite and _exists(self.path) else []

    def write(self, rows: Iterator) -> Written:
        system, folder = _fs(self.path)
        system.create_dir(folder, recursive=True)
        done: list[str] = []
        held = _Rows(self.schema.names)
        for row in rows:
            held.add(row)
            if held.count == self.file_rows:
                done.append(self._file(system, folder, held))
                held = _Rows(self.schema.names)
        if held.count:
            done.append(self._file(system, folder, held))
        return Written(done)

    def _file(self, system, folder: str, rows: _Rows) -> str:
        path = f"{folder}/.part-{uuid.uuid4().hex}.xlsx"
        with system.open_output_stream(path) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
            for name, text in frame_parts(self.sheet).items():
                out.writestr(name, text)
            with out.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'<worksheet xmlns="{MAIN[1:-1]}"><dimension ref="A1:{column_name(max(0, len(self.schema) - 1))}{rows.count + 1}"/><sheetData>'.encode())
                for block in rows.blocks():
                    sheet.write(block)
                sheet.write(b"</sheetData></worksheet>")
        return path

    def commit(self, messages: list) -> None:
        system, _ = _fs(self.path)
        for path in [p for m in messages if m is not None for p in m.paths]:
            folder, name = posixpath.split(path)
            system.move(path, f"{folder}/{name[1:]}")
        for path in self.old:
            system.delete_file(_fs(path)[1])

    def abort(self, messages: list) -> None:
        system, _ = _fs(self.path)
        for path in [p for m in messages if m is not None for p in m.paths]:
            system.delete_file(path)


def _exists(path: str) -> bool:
    from pyarrow import fs

    system, inner = _fs(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def cell(column: str, row: int, value) -> str:
    """One cell in the format's XML."""
    ref = f"{column}{row}"
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime.datetime):
        since = value.replace(tzinfo=None) - DAY_ZERO
        return f'<c r="{ref}" s="2"><v>{since.days + (since.seconds * 1_000_000 + since.microseconds) / 86_400_000_000!r}</v></c>'
    if isinstance(value, datetime.date):
        return f'<c r="{ref}" s="1"><v>{(value - DAY_ZERO.date()).days}</v></c>'
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return f'<c r="{ref}" t="e"><v>#NUM!</v></c>'
    if isinstance(value, str):
        safe = escape(UNFIT.sub(lambda m: f"_x{ord(m[0]):04X}_", value))
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{safe}</t></is></c>'
    return f'<c r="{ref}"><v>{value}</v></c>'


def frame_parts(sheet: str) -> dict[str, str]:
    """The parts of a file around its one sheet."""
    doc, kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    relations = lambda *rs: f'<Relationships xmlns="{PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="rId{k}" Type="{doc}/{t}" Target="{to}"/>' for k, (t, to) in enumerate(rs, 1)) + "</Relationships>"
    formats = "".join(f'<xf numFmtId="{n}" fontId="0" fillId="0" borderId="0" applyNumberFormat="1"/>' for n in (0, 14, 22))
    return {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        + "".join(f'<Override PartName="/xl/{p}.xml" ContentType="{kind}.{c}+xml"/>' for p, c in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles"))) + "</Types>",
        "_rels/.rels": relations(("officeDocument", "xl/workbook.xml")),
        "xl/_rels/workbook.xml.rels": relations(("worksheet", "worksheets/sheet1.xml"), ("styles", "styles.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{doc}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="3">{formats}</cellXfs></styleSheet>',
    }


class ExcelSource(DataSource):
    """Format `xlsx`."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        """Text columns named by the header of the first file."""
        files = list_files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no .xlsx file in {self.options['path']}")
        at = int(self.options.get("skipRows", 0)) + 1
        with Workbook(files[0]) as book:
            cells = next((c for _, c in book.rows(book.sheet_part(self.options.get("sheet")), at, at)), {})
        named = header_names(cells) if _is_true(self.options, "header") else [f"_c{k}" for k in range(max(cells, default=-1) + 1)]
        return T.StructType([T.StructField(n, T.StringType()) for n in named])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ExcelReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return ExcelWriter(schema, self.options, overwrite)
