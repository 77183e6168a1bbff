"""Workbooks: the first sheet of .xlsx files, a zip of XML parts, read in tasks with the standard library.

Spark lists and reads the files, a file is one task's work (a sheet has 1048576 rows at most), and its rows leave as Arrow batches
while the XML is still being read: of a file only its compressed bytes and its shared strings are held. The driver sees
the header of one file. Rows keep the order of their sheet. Files of a folder are laid out by the names of their headers.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from noticeflow.schemas import RAW_COLUMNS

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
BATCH_ROWS = 1000
FILE = "path string, modificationTime timestamp, length long, content binary"  # fixed: what Spark gives of a file


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _number(text: str) -> str:
    return text[:-2] if re.fullmatch(r"-?[0-9]+\.0", text) else text


def _elements(part: io.BufferedIOBase, tag: str) -> Iterator[ET.Element]:
    """Elements of one tag as they are read; what was read before is dropped."""
    events = ET.iterparse(part, ("start", "end"))
    _, root = next(events)
    for event, element in events:
        if event == "end" and element.tag == f"{NS}{tag}":
            yield element
            root.clear()


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet as strings, row by row, blanks as None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as part:
                shared = ["".join(t.text or "" for t in item.iter(f"{NS}t")) for item in _elements(part, "si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)), key=lambda n: int(re.search("[0-9]+", n.rpartition("/")[2])[0]))
        if not sheets:
            raise ValueError("the workbook has no sheet")
        with z.open(sheets[0]) as part:
            for row in _elements(part, "row"):
                cells: dict[int, str] = {}
                for at, cell in enumerate(row.iter(f"{NS}c")):
                    kind, value = cell.get("t"), cell.find(f"{NS}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{NS}t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if kind == "s" else value.text if kind in ("str", "b", "e") else _number(value.text)
                    cells[_column(cell.get("r")) if cell.get("r") else at] = text
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def headed(content: bytes) -> tuple[list[str], Iterator[list[str | None]]]:
    """The names of the columns, as many as the widest row has, and the rows below the first. Blank names become "Unnamed: n"."""
    width = max((len(r) for r in sheet_rows(content)), default=0)
    rows = sheet_rows(content)
    first = next(rows, [])
    return [h if h else f"Unnamed: {i}" for i, h in enumerate([*first, *[None] * (width - len(first))])], rows


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def _parsed(files: DataFrame, names: list[str], place: Callable[[list[str]], list[int | None]]) -> DataFrame:
    """Rows of the files' sheets. place: given a file's header, where each of the names stands in it."""
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])  # names may occur twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                header, rows = headed(content.as_py())
                at = place(header)
                held: list[list[str | None]] = []
                for row in rows:
                    held.append([row[i] if i is not None and i < len(row) else None for i in at])
                    if len(held) == BATCH_ROWS:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return files.select("content").mapInArrow(run, schema).toDF(*names)


def _batch(rows: list[list[str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], [f"c{i}" for i in range(len(rows[0]))])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The header of the first file by path; read in a task, which sends the names alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([headed(content.as_py())[0]], pa.list_(pa.string()))], ["names"])

    names = _files(spark, path).orderBy("path").limit(1).select("content").mapInArrow(run, "names array<string>").first()
    return names["names"] if names else []


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """A workbook, or a folder of them: first row as header, all values strings. The first file's header names the columns;
    others are laid out by name, and what they lack is null."""
    names = header_of(spark, path) or ["Unnamed: 0"]

    def place(header: list[str]) -> list[int | None]:
        if header == names:
            return list(range(len(names)))
        return [header.index(n) if n in header else None for n in names]

    return _parsed(_files(spark, path), names, place)


def landing_sheets(spark: SparkSession, directory: str, files_per_batch: int = 4) -> DataFrame:
    """Raw rows of workbooks as they land in a folder, as a stream: the columns of RAW, whatever the case of a header's names."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.xlsx").option("maxFilesPerTrigger", str(files_per_batch)).load(directory)

    def place(header: list[str]) -> list[int | None]:
        low = [h.lower() for h in header]
        return [low.index(c.lower()) if c.lower() in low else None for c in RAW_COLUMNS]

    return _parsed(files, list(RAW_COLUMNS), place)
