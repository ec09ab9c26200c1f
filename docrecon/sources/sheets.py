"""Spreadsheets as a relation of cells, and spans and answers from JSON.

An .xlsx file is a zip of XML. binaryFile hands whole files to tasks, and the cells come out as rows; a file is one row
of work, as large as a spreadsheet is. No spreadsheet library is needed.
"""

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.shipping import ship

CELLS = "file string, sheet string, address string, row int, col int, raw string, error string"
SPANS = "doc_id string, id string, page int, idx int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, color int, flags int, block int, line int, rotated boolean"
LAYOUT_ANSWER = "titles array<string>, headings array<string>, labels array<string>, codes array<string>"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_cells(name: str, data: bytes) -> list[tuple]:
    """Cells of all sheets in reading order; an unreadable file is one row with an error."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NS)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
            links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            found = []
            for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS):
                target = links[sheet.get(_REL)].lstrip("/")
                for c in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iterfind(".//m:c", _NS):
                    value, inline = c.find("m:v", _NS), c.find("m:is", _NS)
                    if inline is not None:
                        raw = "".join(t.text or "" for t in inline.iterfind(".//m:t", _NS))
                    elif value is None or value.text is None:
                        continue
                    else:
                        raw = shared[int(value.text)] if c.get("t") == "s" else value.text
                    letters, row = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r")).groups()
                    col = 0
                    for x in letters:
                        col = col * 26 + ord(x) - 64
                    found.append((name, sheet.get("name"), c.get("r"), int(row), col, raw, None))
            return found
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, AttributeError, IndexError) as e:
        return [(name, None, None, None, None, None, f"{type(e).__name__}: {e}")]


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """CELLS of every .xlsx file under a path; files that cannot be read are rows with an error, not failures."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        names = [x.split()[0] for x in CELLS.split(", ")]
        for batch in batches:
            rows = [r for p, d in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in sheet_cells(p, d)]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInArrow(run, CELLS)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPANS).json(path)


def parse_answer(answer: Column) -> Column:
    """A layout answer with its four known lists; null where it is no JSON object."""
    return F.when(F.trim(answer).startswith("{"), F.from_json(answer, LAYOUT_ANSWER, {"mode": "PERMISSIVE"}))


def with_headers(cells: DataFrame) -> DataFrame:
    """Cells below the first row, with the text of their column's first row."""
    heads = cells.filter("row = 1").select("file", "sheet", "col", F.col("raw").alias("header"))
    return cells.filter("row > 1").join(heads, ["file", "sheet", "col"], "left")
