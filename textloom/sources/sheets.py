"""Tab-separated files and workbooks written by tasks, with a commit that makes them visible together."""

from __future__ import annotations

import csv
import io
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Rows of a sheet, its header included, that programs read at most.
MOST_ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: The parts of a workbook with one sheet, beside the sheet.
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_LINKS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


@dataclass
class Written(WriterCommitMessage):
    """The files of a task, in the folder of pending ones."""

    files: list[str]


class Sheets(DataSource):
    """Format ``sheets``, for writing: options path, kind (``tsv`` or ``xlsx``) and sheet (a name).

    Each task writes files of its own into a pending folder; the commit moves those of the tasks
    that Spark counts to the target and then, if it overwrites, removes what was there before.
    What failed and repeated tasks left goes with the pending folder.
    """

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        writer = SheetWriter(self.options["path"], self.options.get("kind", "tsv"), self.options.get("sheet", "rows"), schema.names, overwrite)
        # made once, here: a task that outlives an abort finds no folder to write to
        writer.prepare()
        return writer


class SheetWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, sheet: str, columns: list[str], overwrite: bool):
        if kind not in ("tsv", "xlsx"):
            raise ValueError(f"kind must be tsv or xlsx, not {kind}")
        self.path, self.kind, self.sheet, self.columns, self.overwrite = path, kind, sheet, columns, overwrite
        self.job = uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return system, root.rstrip("/"), f"{root.rstrip('/')}/_pending-{self.job}"

    def prepare(self) -> None:
        system, _, pending = self._place()
        system.create_dir(pending, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, _, pending = self._place()
        files, rows = [], (r for batch in iterator for r in zip(*(c.to_pylist() for c in batch.columns)))
        rows = _peekable(rows)
        while rows.more() or not files:
            name = f"part-{uuid.uuid4().hex}.{self.kind}"
            with system.open_output_stream(f"{pending}/{name}") as out:
                (self._tsv if self.kind == "tsv" else self._workbook)(rows, out)
            files.append(name)
        return Written(files)

    def _tsv(self, rows, out) -> None:
        text = io.TextIOWrapper(out, "utf-8", newline="")
        table = csv.writer(text, delimiter="\t", lineterminator="\n")
        table.writerow(self.columns)
        table.writerows(map(shown, row) for row in rows)
        text.flush()
        text.detach()

    def _workbook(self, rows, out) -> None:
        with ExitStack() as stack:
            book = stack.enter_context(zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_DEFLATED))
            for name, part in _PARTS.items():
                book.writestr(name, part)
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets><sheet name="{escape(self.sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="r1"/></sheets></workbook>')
            sheet = stack.enter_context(book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True))
            sheet.write(f'<worksheet xmlns="{_MAIN}"><sheetData>{row_xml(1, self.columns)}'.encode())
            n = 1
            while n < MOST_ROWS and rows.more():
                n += 1
                sheet.write(row_xml(n, map(shown, next(rows))).encode())
            sheet.write(b"</sheetData></worksheet>")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root, pending = self._place()
        before = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.is_file] if self.overwrite else []
        for message in messages:
            for name in message.files if message else []:
                system.move(f"{pending}/{name}", f"{root}/{name}")
        for path in before:
            system.delete_file(path)
        system.delete_dir(pending)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _, pending = self._place()
        if system.get_file_info(pending).type == fs.FileType.Directory:
            system.delete_dir(pending)


class _Forward(io.RawIOBase):
    """A stream that is only written forwards, as stores have them."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


class _peekable:
    """Rows of which it is known whether there are more."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows, self.ahead = rows, []

    def more(self) -> bool:
        if not self.ahead:
            self.ahead = [r for r in [next(self.rows, None)] if r is not None]
        return bool(self.ahead)

    def __iter__(self):
        return self

    def __next__(self) -> tuple:
        return self.ahead.pop() if self.ahead else next(self.rows)


def shown(value) -> str:
    """A value as text: empty for null, lists joined by " | "."""
    if value is None:
        return ""
    return " | ".join(map(shown, value)) if isinstance(value, list) else str(value)


def row_xml(n: int, values) -> str:
    """A row of inline texts; characters that XML has no place for are left out."""
    legal = ("".join(c for c in v if c >= " " or c in "\t\n\r") for v in values)
    cells = "".join(f'<c r="{column_name(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for i, v in enumerate(legal) if v != "")
    return f'<row r="{n}">{cells}</row>'


def column_name(i: int) -> str:
    """A, B, ... Z, AA and so on."""
    letters = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def write_sheets(rows: DataFrame, path: str, kind: str = "tsv", sheet: str = "rows", mode: str = "overwrite") -> None:
    """Writes a table as tab-separated files or workbooks, one or more for each partition; a small table for people is best one partition."""
    rows.sparkSession.dataSource.register(Sheets)
    rows.write.format("sheets").option("path", path).option("kind", kind).option("sheet", sheet).mode(mode).save()
