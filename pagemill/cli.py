"""The engine from a shell: `python -m pagemill.cli --store FOLDER COMMAND ...`. Exit codes: 0, 1 for an error, 2 where issues
stand against an output.

Lines are Parquet tables (page, line_no, line). A task's segments are a partition of the store's table `segments`; every
command reads that partition alone and replaces it as a whole. What is printed is bounded: counts and the first issues.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.api import Engine, Settings
from pagemill.errors import AnalysisError, BlockedError, NoTextError, PackageError, PagemillError
from pagemill.operators.lifecycle import Store
from pagemill.session import session
from pagemill.sources import xlsx

VERSION, SHOWN = 1, 30
LINES = "page int, line_no int, line string"


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="pagemill")
    own.add_argument("--store", required=True)
    commands = own.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, task: bool = True) -> argparse.ArgumentParser:
        out = commands.add_parser(name)
        for place in (["task"] if task else []) + list(places):
            out.add_argument(place)
        return out

    for name in ("analyze", "export"):
        create = command(name, "lines", *(["output"] if name == "export" else []))
        create.add_argument("--page-start", type=int, default=1)
        create.add_argument("--page-end", type=int)
        create.add_argument("--protected-term", action="append", default=[])
    command("package", "output")
    command("import", "folder")
    command("validate").add_argument("--json", action="store_true")
    command("edit", "segment", "text")
    command("generate", "output")
    command("list", task=False)
    command("delete")
    command("restore", "place", task=False)
    return own


class Commands:
    """One call of a command over a store. Returns the exit code; `say` takes each line of output."""

    def __init__(self, spark: SparkSession, root: str, say=print):
        self.spark, self.store, self.say = spark, Store(spark, root, VERSION), say

    def _engine(self, task: str, args: argparse.Namespace | None = None) -> Engine:
        self.store.partition(task)  # refuses what is no name
        if args is None:
            return Engine(self.spark, task)
        return Engine(self.spark, task, Settings(page_start=args.page_start, page_end=args.page_end, protected_terms=tuple(args.protected_term)))

    def _schema(self):
        none = Engine(self.spark, "none").create(self.spark.createDataFrame([], LINES))
        return none.withColumn("translated_text", F.lit(None).cast("string")).schema

    def _all(self) -> DataFrame:
        if "segments" not in self.store.tables():
            return self.spark.createDataFrame([], self._schema())
        return self.store.read("segments", self._schema())

    def _segments(self, task: str) -> DataFrame:
        own = self._all().where(F.col("task_id") == task)
        if own.isEmpty():
            raise PagemillError(f"no task {task}")
        return own

    def _keep(self, segments: DataFrame) -> None:
        self.store.write("segments", segments.select(self._schema().names))

    def _checked(self, engine: Engine, as_json: bool = False) -> int:
        issues, report = engine.validate(self._segments(engine.task))
        row = report.first()
        found = issues.orderBy("severity", "code", "segment_id").limit(SHOWN).collect()
        if row is None:
            raise NoTextError(f"task {engine.task} has nothing to translate")
        if as_json:
            self.say(json.dumps({**row.asDict(), "issues": [r.asDict() for r in found]}, ensure_ascii=False, indent=2))
        else:
            self.say(f"segments {row.translated_segments}/{row.total_segments}, blocking {row.blocking_errors}, warnings {row.warnings}, can generate: {'yes' if row.can_generate else 'no'}")
            for r in found:
                self.say(f"- {r.severity}/{r.code} [{r.segment_id}]")
            if (more := row.blocking_errors + row.warnings - len(found)) > 0:
                self.say(f"- and {more} more")
        return 0 if row.can_generate else 2

    def analyze(self, args) -> int:
        engine = self._engine(args.task, args)
        try:
            lines = self.spark.read.schema(LINES).parquet(args.lines)
        except AnalysisException as e:
            raise AnalysisError(f"no lines at {args.lines}") from e
        made = engine.create(lines).withColumn("translated_text", F.lit(None).cast("string"))
        self._keep(made)
        counts = self._all().where(F.col("task_id") == args.task).agg(F.countDistinct("page").alias("pages"), F.count("*").alias("n"), F.count_if("should_translate").alias("own")).first()
        if not counts.n:
            raise NoTextError(f"no text at {args.lines}")
        self.say(f"task {args.task}: pages {counts.pages}, segments {counts.n}, to translate {counts.own}")
        return 0

    def export(self, args) -> int:
        return self.analyze(args) or self.package(args)

    def package(self, args) -> int:
        files = self._engine(args.task).export(self._segments(args.task), args.output)
        for r in sorted(files.collect(), key=lambda r: r.package_index):  # a row a file; an order by Spark would write them twice
            self.say(f"{args.output.rstrip('/')}/{r.filename}: {r.n_rows}")
        return 0

    def import_(self, args) -> int:
        engine, own = self._engine(args.task), self._segments(args.task)
        try:
            cells = xlsx.read_cells(self.spark, args.folder)
            found, issues = engine.import_with_issues(own.drop("translated_text"), cells)
            before = own.select("segment_id", F.col("translated_text").alias("before__"))
            merged = found.join(before, "segment_id").withColumn("translated_text", F.coalesce("translated_text", "before__"))
            self._keep(merged)
        except (AnalysisException, FileNotFoundError) as e:
            raise PackageError(f"no files at {args.folder}") from e
        for r in issues.orderBy("file", "code", "row_key").limit(SHOWN).collect():
            self.say(f"{r.file}: {r.severity}/{r.code} {r.row_key or ''}".rstrip())
        return self._checked(engine)

    def validate(self, args) -> int:
        return self._checked(self._engine(args.task), args.json)

    def edit(self, args) -> int:
        engine = self._engine(args.task)
        new = self.spark.createDataFrame([(args.segment, args.text)], "segment_id string, translated_text string")
        done, unknown = engine.update(self._segments(args.task), new)
        if not unknown.isEmpty():
            raise PagemillError(f"no segment {args.segment}")
        self._keep(done)
        return self._checked(engine)

    def generate(self, args) -> int:
        engine, own = self._engine(args.task), self._segments(args.task)
        if not engine.validate(own)[1].where("can_generate").count():
            raise BlockedError(f"issues stand against task {args.task}")
        ready = own.where("should_translate")
        engine.generate(ready, ready.select("segment_id", F.array("source_text").alias("anchors"))).write.mode("overwrite").parquet(args.output)
        self.say(args.output)
        return 0

    def list(self, args) -> int:
        tasks = self._all().groupBy("task_id").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("n"), F.count("translated_text").alias("done"))
        for r in tasks.orderBy("task_id").toLocalIterator():
            self.say(f"{r.task_id}\t{r.pages} pages\t{r.done}/{r.n}")
        return 0

    def delete(self, args) -> int:
        self.say(self.store.delete_task(args.task))
        return 0

    def restore(self, args) -> int:
        self.store.restore_task(args.place)
        return 0


def run(argv: list[str], spark: SparkSession | None = None, say=print) -> int:
    args = parser().parse_args(argv)
    try:
        commands = Commands(spark or session(), args.store, say)
        return getattr(commands, "import_" if args.command == "import" else args.command)(args)
    except PagemillError as e:
        say(f"error: {e}")
        return 2 if isinstance(e, BlockedError) else 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
