"""Workbooks (OOXML) as a Spark data source: rows of sheets in, `.xlsx` files out, and back.

A row is (book, sheet, row, cells). Writing streams each book's rows into one file, which stays hidden until the job commits; an abort
deletes it. Reading takes ranges of a sheet's rows as partitions and keeps one row in memory.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "book string, sheet string, row bigint, cells array<string>"
IMAGES = "book string, sheet string, row bigint, col bigint, sha256 string"
#: Rows of a sheet for each partition of a reader, and at most in a sheet of a written book (the format's own limit).
RANGE_ROWS, SHEET_ROWS = 50_000, 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"
_BAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def column_name(n: int) -> str:
    """A, B, …, Z, AA, … for 0, 1, …"""
    out = ""
    while n >= 0:
        n, r = n // 26 - 1, n % 26
        out = chr(65 + r) + out
    return out


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)


class Book:
    """Writes one workbook row by row. Rows of a sheet come together and in order; gaps between their numbers stay blank rows."""

    def __init__(self, out) -> None:
        self.zip, self.names, self.sheet, self.stream, self.last, self.part = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), [], None, None, 0, 0

    def _open(self, name: str) -> None:
        self._close()
        clean = re.sub(r"[\[\]:*?/\\]", "_", _BAD.sub("", name)).strip("'")[:31] or "Sheet"
        title, n = clean, 1
        while title.lower() in {t.lower() for t in self.names}:
            n += 1
            title = f"{clean[: 31 - len(f' ({n})')]} ({n})"
        self.names.append(title)
        self.stream = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
        self.stream.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())

    def _close(self) -> None:
        if self.stream:
            self.stream.write(b"</sheetData></worksheet>")
            self.stream.close()
            self.stream = None

    def add(self, sheet: str, row: int, cells: list[str | None] | None) -> None:
        part = (row - 1) // SHEET_ROWS  # rows beyond a sheet's end go on in another one
        if (sheet, part) != (self.sheet, self.part) or not self.stream:
            self.sheet, self.part = sheet, part
            self._open(sheet)
        at = row - part * SHEET_ROWS
        shown = "".join(f'<c r="{column_name(i)}{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", v))}</t></is></c>' for i, v in enumerate(cells or []) if v)
        self.stream.write(f'<row r="{at}">{shown}</row>'.encode())

    def finish(self) -> None:
        if not self.names:
            self._open("Sheet1")
        self._close()
        number = range(1, len(self.names) + 1)
        rel = f'<Relationships xmlns="{PACKAGE}/relationships">'
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in number)
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>',
            "_rels/.rels": f'{rel}<Relationship Id="rId1" Type="{RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(number, self.names, strict=True)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": rel + "".join(f'<Relationship Id="rId{i}" Type="{RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in number) + "</Relationships>",
        }
        for name, body in parts.items():
            self.zip.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{body}')
        self.zip.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class BookWriter(DataSourceWriter):
    """Each task writes its books to hidden files; the commit names them, and only then deletes what an overwrite replaces."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        fs, top = _file_system(self.path)
        fs.create_dir(f"{top}/_temporary/{self.job}", recursive=True)
        done, book, out, now = Written(), None, None, None
        for r in iterator:
            if r["book"] != now or book is None:
                if book:
                    book.finish()
                    out.close()
                now, name = r["book"], re.sub(r"[^\w.() -]", "_", r["book"] or "book")
                hidden = f"{top}/_temporary/{self.job}/{uuid.uuid4().hex}"
                out = fs.open_output_stream(hidden)
                book = Book(out)
                done.files.append((hidden, f"{top}/{name}.xlsx"))
            book.add(r["sheet"] or "Sheet", r["row"], r["cells"])
        if book:
            book.finish()
            out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = _file_system(self.path)
        files = [f for m in messages if m for f in m.files]
        named = [to for _, to in files]
        old = {i.path for i in fs.get_file_info(pafs.FileSelector(top)) if i.path.endswith(".xlsx")} if fs.get_file_info(top).type == pafs.FileType.Directory else set()
        if len(named) != len(set(named)) or (not self.overwrite and old & set(named)):
            self.abort(messages)
            raise ValueError("two books of one name: rows of a book have to be in one task, and an append may not replace a book")
        for hidden, to in files:
            if to in old:
                fs.delete_file(to)
            fs.move(hidden, to)
        for stale in (old - set(named)) if self.overwrite else ():
            fs.delete_file(stale)
        self._clear(fs, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_file_system(self.path))

    def _clear(self, fs: pafs.FileSystem, top: str) -> None:
        if fs.get_file_info(f"{top}/_temporary/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{top}/_temporary/{self.job}")


# ---- reading ----


@dataclass
class RowRange(InputPartition):
    path: str
    sheet: str
    part: str
    first: int
    last: int


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in order."""
    to = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")
    return [(s.get("name"), "xl/" + to[s.get(f"{{{RELS}}}id")].removeprefix("/xl/")) for s in found]


def _rows(z: zipfile.ZipFile, part: str) -> Iterator[tuple[int, ElementTree.Element]]:
    with z.open(part) as f:
        at, parents = 0, []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag == f"{{{MAIN}}}row":
                at = int(e.get("r") or at + 1)
                yield at, e
                parents[-1].remove(e)


def _text(e: ElementTree.Element | None) -> str:
    return "".join(t.text or "" for t in e.iter(f"{{{MAIN}}}t")) if e is not None else ""


def _cells(row: ElementTree.Element, shared: list[str]) -> list[str]:
    out: list[str] = []
    for c in row.iter(f"{{{MAIN}}}c"):
        at = column_number(c.get("r")) if c.get("r") else len(out)
        v = c.find(f"{{{MAIN}}}v")
        raw = v.text or "" if v is not None else ""
        value = shared[int(raw)] if c.get("t") == "s" and raw else _text(c.find(f"{{{MAIN}}}is")) if c.get("t") == "inlineStr" else raw
        out += [""] * (at - len(out)) + [value]
    return out


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{{{MAIN}}}si")]


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".xlsx")


class BookReader(DataSourceReader):
    """Partitions are ranges of a sheet's rows; a range reads its sheet from the start and passes over what lies before it."""

    def __init__(self, options: dict) -> None:
        self.path, self.size, self.images = options["path"].rstrip("/"), int(options.get("rangeRows", RANGE_ROWS)), options.get("content") == "images"

    def partitions(self) -> list[RowRange]:
        fs, top = _file_system(self.path)
        paths = [top] if top.endswith(".xlsx") else sorted(i.path for i in fs.get_file_info(pafs.FileSelector(top)) if i.path.endswith(".xlsx"))
        out = []
        for p in paths:
            with fs.open_input_file(p) as f, zipfile.ZipFile(f) as z:
                for name, part in _sheets(z):
                    # a compressed row is some bytes at least, so this many ranges are enough; the last one is open
                    most = max(z.getinfo(part).file_size // (20 * self.size), 0) if not self.images else 0
                    edges = [k * self.size for k in range(most + 1)] + [1 << 62]
                    out += [RowRange(p, name, part, a + 1, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def read(self, partition: RowRange | None) -> Iterator[tuple]:
        if partition is None:  # there is no sheet at all
            return
        fs, _ = _file_system(self.path)
        with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            if self.images:
                yield from self._images(z, partition)
                return
            shared = _shared(z)
            for at, e in _rows(z, partition.part):
                if at > partition.last:
                    return
                if at >= partition.first:
                    yield _name(partition.path), partition.sheet, at, _cells(e, shared)

    @staticmethod
    def _images(z: zipfile.ZipFile, p: RowRange) -> Iterator[tuple]:
        """Anchored images of a sheet, by row and column from 1, with the content's hash."""
        names = set(z.namelist())

        def related(part: str) -> dict[str, str]:
            folder, _, file = part.rpartition("/")
            rels = f"{folder}/_rels/{file}.rels"
            if rels not in names:
                return {}
            up = folder.rpartition("/")[0]
            return {r.get("Id"): r.get("Target").replace("../", f"{up}/", 1).lstrip("/") for r in ElementTree.fromstring(z.read(rels))}

        for drawing in sorted(t for t in related(p.part).values() if "/drawings/" in t and t in names):
            media = related(drawing)
            for anchor in ElementTree.fromstring(z.read(drawing)):
                start = anchor.find(f"{{{DRAWING}}}from")
                for blip in anchor.iter("{http://schemas.openxmlformats.org/drawingml/2006/main}blip"):
                    target = media.get(blip.get(f"{{{RELS}}}embed"))
                    if target in names and start is not None:
                        row, col = (int(start.find(f"{{{DRAWING}}}{k}").text) + 1 for k in ("row", "col"))
                        yield _name(p.path), p.sheet, row, col, hashlib.sha256(z.read(target)).hexdigest()


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return IMAGES if self.options.get("content") == "images" else SCHEMA

    def reader(self, schema) -> BookReader:
        return BookReader(self.options)

    def writer(self, schema, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"], overwrite)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would read it by."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def read_workbooks(spark: SparkSession, path: str, **options) -> DataFrame:
    """(book, sheet, row, cells) of the workbooks at a path, a file or a folder of files; content="images" gives anchored images instead."""
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").options(**options).load(qualified(spark, path))


def write_workbooks(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes (book, sheet, row, cells) as one file for each book: a book is one task's work, its rows pass through it in order."""
    spark = rows.sparkSession
    spark.dataSource.register(Workbook)
    own = rows.select("book", "sheet", "row", "cells").repartition("book").sortWithinPartitions("book", "sheet", "row")
    own.write.format("workbook").mode(mode).save(qualified(spark, path))
