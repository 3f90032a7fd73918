"""Tables of office files: DOCX by a stream of its XML, XLSX and ODS by sparse cells.

Files come as rows of binary content, as Spark's binaryFile source gives them, and are dealt by it; a task unpacks one
part of one archive at a time and keeps a table's header and the cells merged from above, not the document. A file that
cannot be read gives one row with its error and stops nothing.

A DOCX table's first row is its header; a heading before the table is its section; a cell that spans columns, or goes on
from the row above, has its text in each place, and a run of equal neighbours in a row counts once. Tables within cells are
left out. A sheet's first row names its columns (`Unnamed: i` where it is empty); if the next row has no number, that row is
the header instead and the names go. Rows without any text go, and so do tables without such rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.sources.files import extension

# ---- fixed values: namespaces of the formats
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_OFFICE, _TABLE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"

SCHEMA = "doc_id string, filename string, table_index int, caption string, section string, row_index int, header array<string>, cells array<string>, error string"
#: index, caption, section, row, header, cells
Row = tuple[int, str, str, int, list[str], list[str]]


def _name(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _value(element: ElementTree.Element, name: str = "val") -> str | None:
    return next((v for k, v in element.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _numbered(tables: Iterator[tuple[str, str, list[str], Iterator[list[str]]]]) -> Iterator[Row]:
    """caption, section, header and rows of tables to rows that hold text."""
    for index, (caption, section, header, rows) in enumerate(tables):
        for i, cells in enumerate(rows):
            if any(c.strip() for c in cells):
                yield index, caption, section, i, header, cells


# ---- DOCX


def _without_runs(cells: list[str]) -> list[str]:
    return [c for i, c in enumerate(cells) if not i or c != cells[i - 1]]


def docx_rows(content: bytes) -> Iterator[Row]:
    """The rows of all tables of a document's body."""
    section, depth, index = "", 0, -1
    number, header, above = 0, None, {}
    row, paragraphs, span, goes_on = [], [], 1, False
    texts: list[list[str]] = []  # of the open paragraphs
    style = None
    with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("word/document.xml") as part:
        for event, e in ElementTree.iterparse(part, ("start", "end")):
            name = _name(e)
            if event == "start":
                if name == "tbl":
                    depth += 1
                    if depth == 1:
                        index, number, header, above = index + 1, 0, None, {}
                elif name == "tr" and depth == 1:
                    row = []
                elif name == "tc" and depth == 1:
                    paragraphs, span, goes_on = [], 1, False
                elif name == "p":
                    texts.append([])
                    style = None
                continue
            if name == "t" and texts:
                texts[-1].append(e.text or "")
            elif name in ("tab", "br", "cr") and texts:
                texts[-1].append("\t" if name == "tab" else "\n")
            elif name == "pStyle":
                style = _value(e)
            elif name == "gridSpan" and depth == 1:
                span = max(1, int(_value(e) or 1))
            elif name == "vMerge" and depth == 1:
                goes_on = _value(e) != "restart"
            elif name == "p":
                text = "".join(texts.pop())
                if depth == 1:
                    paragraphs.append(text)
                elif depth == 0 and style and ("Heading" in style or "berschrift" in style):
                    section = text.strip()
                e.clear()
            elif name == "tc" and depth == 1:
                text = above.get(len(row), "") if goes_on else "\n".join(paragraphs).strip().replace("\n", " ")
                for _ in range(span):
                    above[len(row)] = text
                    row.append(text)
            elif name == "tr" and depth == 1:
                cells = _without_runs(row)
                if header is None:
                    header = cells
                else:
                    if any(c.strip() for c in cells):
                        yield index, "", section, number, header, cells
                    number += 1
                e.clear()
            elif name == "tbl":
                depth -= 1


# ---- sheets


def _is_number(cell: str) -> bool:
    try:
        float(cell.replace(",", "."))
    except ValueError:
        return False
    return True


def _sheet(caption: str, sparse: Iterator[dict[int, str]]) -> tuple[str, str, list[str], Iterator[list[str]]] | None:
    """A sheet from the filled cells of its rows, by column."""
    rows = (r for r in sparse if any(v.strip() for v in r.values()))
    first = next(rows, None)
    second = next(rows, None)
    if first is None or second is None:
        return None
    width = max(max(first), max(second)) + 1
    listed = lambda r: [r.get(i, "").strip() for i in range(max(width, max(r) + 1))]
    names = [x or f"Unnamed: {i}" for i, x in enumerate(listed(first))]
    filled = [x for x in listed(second) if x]
    headed = not any(_is_number(x) for x in filled)
    return caption, "", listed(second) if headed else names, (listed(r) for r in ([] if headed else [second], rows) for r in r)


def _column(reference: str) -> int:
    """`AB12` to 27."""
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _shared_strings(archive: zipfile.ZipFile) -> list[str]:
    found: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        with archive.open("xl/sharedStrings.xml") as part:
            spoken: list[str] = []
            phonetic = 0
            for event, e in ElementTree.iterparse(part, ("start", "end")):
                name = _name(e)
                if name == "rPh":
                    phonetic += 1 if event == "start" else -1
                elif event == "end" and name == "t" and not phonetic:
                    spoken.append(e.text or "")
                elif event == "end" and name == "si":
                    found.append("".join(spoken))
                    spoken = []
                    e.clear()
    return found


def _xlsx_cells(archive: zipfile.ZipFile, path: str, shared: list[str]) -> Iterator[dict[int, str]]:
    with archive.open(path) as part:
        row: dict[int, str] = {}
        for event, e in ElementTree.iterparse(part, ("end",)):
            name = _name(e)
            if name == "c":
                kind = e.get("t", "n")
                v = next((x.text or "" for x in e if _name(x) == "v"), "")
                if kind == "s":
                    v = shared[int(v)] if v else ""
                elif kind == "inlineStr":
                    v = "".join(x.text or "" for x in e.iter() if _name(x) == "t")
                elif kind == "b":
                    v = {"1": "True", "0": "False"}.get(v, v)
                if v:
                    row[_column(e.get("r")) if e.get("r") else len(row)] = v
            elif name == "row":
                yield row
                row = {}
                e.clear()


def xlsx_rows(content: bytes) -> Iterator[Row]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = _shared_strings(archive)
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(e.get("name"), targets[e.get(_REL + "id")]) for e in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if _name(e) == "sheet"]
        path = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        yield from _numbered(s for name, t in sheets if (s := _sheet(name, _xlsx_cells(archive, path(t), shared))))


def _ods_cell(e: ElementTree.Element) -> str:
    if e.get(_OFFICE + "value-type") in ("float", "percentage", "currency") and (v := e.get(_OFFICE + "value")) is not None:
        return v.removesuffix(".0")
    return "\n".join("".join(p.itertext()) for p in e if _name(p) == "p")


def _ods_cells(table: ElementTree.Element) -> Iterator[dict[int, str]]:
    for e in table.iter(_TABLE + "table-row"):
        row, at = {}, 0
        for cell in e:
            if _name(cell) in ("table-cell", "covered-table-cell"):
                many, text = int(cell.get(_TABLE + "number-columns-repeated", 1)), _ods_cell(cell)
                if text:  # only filled cells are repeated: empty ones go on to the sheet's edge
                    row |= dict.fromkeys(range(at, at + many), text)
                at += many
        for _ in range(int(e.get(_TABLE + "number-rows-repeated", 1)) if row else 1):
            yield row


def ods_rows(content: bytes) -> Iterator[Row]:
    def sheets() -> Iterator:
        with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("content.xml") as part:
            for _, e in ElementTree.iterparse(part, ("end",)):
                if e.tag == _TABLE + "table":
                    if found := _sheet(e.get(_TABLE + "name", ""), _ods_cells(e)):
                        yield found
                    e.clear()

    yield from _numbered(sheets())


READERS = {"docx": docx_rows, "xlsx": xlsx_rows, "ods": ods_rows}


def table_rows(files: DataFrame) -> DataFrame:
    """SCHEMA: the rows of all tables of DOCX, XLSX and ODS files, and one row with its error of each that cannot be read.

    files: doc_id, filename, content. Other kinds of files give nothing; null content is an error of its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for doc, name, kind, content in zip(*(c for c in batch.columns)):
                doc, name, held = doc.as_py(), name.as_py(), []
                try:
                    for row in READERS[kind.as_py()](content.as_py() or b""):
                        held.append((doc, name, *row, None))
                        if len(held) == 1000:
                            yield out(held)
                            held = []
                except Exception as e:  # noqa: BLE001  whatever a damaged file may raise
                    held.append((doc, name, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
                if held:
                    yield out(held)

    kind = extension(F.col("filename"))
    read = files.where(kind.isin(list(READERS))).select(F.col("doc_id").cast("string"), "filename", kind.alias("kind"), F.col("content").cast("binary"))
    return read.mapInArrow(run, SCHEMA)


def table_prose(rows: DataFrame) -> DataFrame:
    """doc_id, filename, table_index, row_index, section, prose: a sentence for each row, with the table's caption before it."""
    said = T.row_prose(F.col("header"), F.col("cells"))
    caption = F.when(F.coalesce(F.col("caption"), F.lit("")) != "", F.concat("caption", F.lit(": "))).otherwise("")
    return rows.where("error is null").select("doc_id", "filename", "table_index", "row_index", "section", F.concat(caption, said).alias("prose"), said.alias("said")).where("said <> ''").drop("said")
