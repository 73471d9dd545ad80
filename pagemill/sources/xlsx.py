"""Exchange packages as XLSX files: a writer for one file a package and a data source that reads cells."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MOST_CELLS = 8
SCHEMA = "file string, subject string, sheet_index int, sheet_name string, sheet_state string, row_index int, cells array<string>"
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _sheet(rows: list[list[str]]) -> str:
    body = "".join(f'<row r="{i}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", v or ""))}</t></is></c>' for v in row) + "</row>" for i, row in enumerate(rows, 1))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{NS[1:-1]}"><sheetData>{body}</sheetData></worksheet>'


def workbook(subject: str, sheets: list[tuple[str, str, list[list[str]]]]) -> bytes:
    """An XLSX file of sheets (name, visible or hidden, rows of texts); the subject is the package's id."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        def put(name: str, text: str) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)

        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" state="{s}" r:id="rId{i}"/>' for i, (n, s, _) in enumerate(sheets, 1))
        put("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>")
        put("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>')
        put("docProps/core.xml", f'<?xml version="1.0" encoding="UTF-8"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:subject>{escape(subject)}</dc:subject></cp:coreProperties>')
        put("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{NS[1:-1]}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        put("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (_, _, rows) in enumerate(sheets, 1):
            put(f"xl/worksheets/sheet{i}.xml", _sheet(rows))
    return out.getvalue()


def _column(ref: str | None, at: int) -> int:
    letters = re.match(r"[A-Z]+", ref or "")
    if not letters:
        return at
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def cells(raw: bytes, first_row: int = 2):
    """(subject, sheet index, name, state, row, values) of all sheets, from `first_row` on, at most MOST_CELLS a row."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        have = set(z.namelist())
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{NS}t"))
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{NS}si")] if "xl/sharedStrings.xml" in have else []
        subject = None
        if "docProps/core.xml" in have:
            subject = next((e.text for e in ElementTree.fromstring(z.read("docProps/core.xml")).iter() if e.tag.endswith("}subject")), None)
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for i, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{NS}sheet")):
            target = targets[next(v for k, v in s.items() if k.endswith("}id"))]
            for number, row in enumerate(ElementTree.fromstring(z.read(posixpath.join("xl", target) if not target.startswith("/") else target[1:])).iter(f"{NS}row"), 1):
                at = int(row.get("r") or number)
                if at < first_row:
                    continue
                values: list[str | None] = []
                for c in row.iter(f"{NS}c"):
                    k = _column(c.get("r"), len(values))
                    values += [None] * (k + 1 - len(values))
                    v = c.find(f"{NS}v")
                    values[k] = text(c) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                yield subject, i, s.get("name"), s.get("state") or "visible", at, values[:MOST_CELLS]


def _place(path: str):
    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


@dataclass
class File(InputPartition):
    path: str


class XlsxReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        where, root = _place(self.path)
        return [File(x.path) for x in sorted(where.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda x: x.path) if x.is_file and x.path.endswith(".xlsx")]

    def read(self, partition):
        if partition is None:
            return
        where, _ = _place(self.path)
        with where.open_input_stream(partition.path) as f:
            raw = f.read()
        for subject, i, name, state, row, values in cells(raw):
            yield posixpath.basename(partition.path), subject, i, name, state, row, values


class XlsxSource(DataSource):
    """The cells of all .xlsx files below a path, a partition a file."""

    @classmethod
    def name(cls):
        return "xlsx_cells"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return XlsxReader(self.options)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    return spark.read.format("xlsx_cells").load(path)


def write_packages(packed: DataFrame, path: str, task: str = "task_id") -> DataFrame:
    """(task, package_index, filename, n_rows, n_bytes): one file a package, written under a name of its own and renamed.

    packed has the task, package_index, package_total, row_key and text; a package is bounded by how it was packed.
    """

    def write(key, rows: pd.DataFrame) -> pd.DataFrame:
        total = int(rows["package_total"].iloc[0])
        name = f"{key[0]}_{key[1]:03d}_of_{total:03d}.xlsx"
        rows = rows.sort_values("row_key")
        info = [["Field", "Value"], ["Package ID", f"PKG-{key[0]}-{key[1]:03d}"], ["Package Index", str(key[1])], ["Package Total", str(total)], ["Rows", str(len(rows))]]
        raw = workbook(info[1][1], [("Translate", "visible", [["Row Key", "Text"], *rows[["row_key", "text"]].values.tolist()]), ("Package Info", "hidden", info)])
        where, root = _place(path)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(posixpath.join(root, f".{name}.part")) as f:
            f.write(raw)
        where.move(posixpath.join(root, f".{name}.part"), posixpath.join(root, name))
        return pd.DataFrame([[key[0], key[1], name, len(rows), len(raw)]], columns=["task", "package_index", "filename", "n_rows", "n_bytes"])

    kind = dict(packed.dtypes)[task]
    return packed.groupBy(task, "package_index").applyInPandas(write, f"task {kind}, package_index bigint, filename string, n_rows bigint, n_bytes bigint")
