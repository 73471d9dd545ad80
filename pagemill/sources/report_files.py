"""Reports as files: a JSON document and an HTML page for each row, all of them or none."""

from __future__ import annotations

import html
import json
import posixpath
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pagemill.sources.xlsx import _place

CARDS = ("replaced_segments", "overflow_errors", "complex_background_repairs", "contour_flow_segments", "minimum_rendered_font_size", "dense_pages")
PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font-family:sans-serif;margin:2em auto;max-width:60em}}dl{{display:flex;flex-wrap:wrap;gap:1em}}dl div{{border:1px solid;padding:.6em}}dd{{margin:0;font-size:1.6em}}td,th{{text-align:left;padding:.3em}}</style></head>
<body><h1>{title}</h1><p class="{status}">{status}</p><dl>{cards}</dl>
<table><tr><th>severity</th><th>segment</th><th>message</th></tr>{issues}</table>
<details><summary>JSON</summary><pre>{document}</pre></details></body></html>
"""


def page(report: dict) -> str:
    """The HTML page of a report; all texts are escaped."""
    safe = lambda x: html.escape(str("" if x is None else x))
    cards = "".join(f"<div><dt>{safe(name.replace('_', ' '))}</dt><dd>{safe(report[name])}</dd></div>" for name in CARDS if name in report)
    rows = [f"<tr><td>{safe(i['severity'])}</td><td>{safe(i['segment_id'])}</td><td>{safe(i['message'])}</td></tr>" for i in report.get("shown_issues") or []]
    document = safe(json.dumps(report, ensure_ascii=False, indent=1, default=str))
    return PAGE.format(title=safe(report["task"]), status=safe(report.get("status")), cards=cards, issues="".join(rows) or '<tr><td colspan="3">none</td></tr>', document=document)


@dataclass
class Written(WriterCommitMessage):
    """Names of files, without the mark of what is not committed yet."""

    names: list[str]


class ReportWriter(DataSourceWriter):
    """Each task writes its rows' files under marked names; the commit gives them their own, an abort removes them."""

    def __init__(self, path: str, mark: str):
        self.path, self.mark = path, mark

    def write(self, rows):
        where, root = _place(self.path)
        where.create_dir(root, recursive=True)
        names = []
        for row in rows:
            report = row.asDict(recursive=True)
            if not re.fullmatch(r"[\w-]+", str(report["task"])):
                raise ValueError(f"no name of a file: {report['task']!r}")
            for name, text in ((f"{report['task']}.json", json.dumps(report, ensure_ascii=False, sort_keys=True, default=str)), (f"{report['task']}.html", page(report))):
                with where.open_output_stream(posixpath.join(root, self.mark + name)) as f:
                    f.write(text.encode())
                names.append(name)
        return Written(names)

    def commit(self, messages):
        where, root = _place(self.path)
        for name in (n for m in messages if m for n in m.names):
            where.move(posixpath.join(root, self.mark + name), posixpath.join(root, name))

    def abort(self, messages):
        from pyarrow import fs

        where, root = _place(self.path)
        for found in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if found.base_name.startswith(self.mark):
                where.delete_file(found.path)


class ReportFiles(DataSource):
    """df.write.format("report_files").mode("append").save(path): rows have a column `task`, which names the files."""

    @classmethod
    def name(cls):
        return "report_files"

    def writer(self, schema, overwrite):
        if "task" not in schema.fieldNames():
            raise ValueError("reports are named by their column `task`")
        return ReportWriter(self.options["path"], f".{uuid.uuid4().hex}.")


def write_reports(reports: DataFrame, path: str) -> None:
    reports.sparkSession.dataSource.register(ReportFiles)
    reports.write.format("report_files").mode("append").save(path)
