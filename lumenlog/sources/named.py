"""Output files with names of their own, all or none: a data source that writes lines to the file that each row names.

Tasks write into a hidden folder beside the target; only when all are done does the driver give the files their names, and a job that fails leaves none. Rows should come
clustered by name, since a task has one file open at a time. Of a name that several tasks have written, or that is there already and isn't to be
overwritten, the files are numbered: a.jsonl, a-1.jsonl, ... The folder must be visible to the driver and the executors by the same path.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: (name, where it lies until the commit)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class NamedWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.pretty, self.overwrite = options["path"], options.get("pretty") == "true", overwrite
        self.aside = os.path.join(self.folder, f".staged-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        out, name, f = Written(), None, None
        try:
            for row in iterator:
                if row.name != name:
                    if f:
                        f.close()
                    name = row.name
                    path = os.path.join(self.aside, uuid.uuid4().hex)
                    os.makedirs(self.aside, exist_ok=True)
                    f = open(path, "w", encoding="utf-8")  # noqa: SIM115
                    out.files.append((name, path))
                f.write((json.dumps(json.loads(row.value), ensure_ascii=False, indent=2) if self.pretty else row.value) + "\n")
        finally:
            if f:
                f.close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        taken: set[str] = set()
        for name, path in sorted(x for m in messages if m for x in m.files):
            base, ext = os.path.splitext(name)
            number, at = 0, name
            while at in taken or (not self.overwrite and os.path.exists(os.path.join(self.folder, at))):
                number += 1
                at = f"{base}-{number}{ext}"
            taken.add(at)
            target = os.path.join(self.folder, at)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(path, target)
        shutil.rmtree(self.aside, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class NamedFiles(DataSource):
    """Writes rows of name and value."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options, overwrite)


def file_name(template: str, split: str | None) -> Column:
    """The name of a record's file: {date} and {hour} of the template, or of a template without them `_date` or `_date_hour` before its ending; the template itself without a time or a split."""
    date, hour = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH")
    if not split:
        return F.lit(template)
    if "{date}" in template or "{hour}" in template:
        base, ext = os.path.splitext(template.replace("_{date}", "").replace("_{hour}", "").replace("{date}", "").replace("{hour}", ""))
        named = F.replace(F.replace(F.lit(template), F.lit("{date}"), date), F.lit("{hour}"), hour)
    else:
        base, ext = os.path.splitext(template)
        named = F.concat(F.lit(base), F.lit("_"), date, *([F.lit("_"), hour] if split == "hour" else []), F.lit(ext))
    return F.when(F.col("ts").isNull(), F.lit(base + ext)).otherwise(named)


def write_named(standard: DataFrame, folder: str, template: str, split: str | None = None, pretty: bool = False, overwrite: bool = False) -> None:
    """JSON lines (or indented values) of standard records in files named by a template. The rows of a name lie in as many files as tasks had them; sorting inside tasks moves none."""
    standard.sparkSession.dataSource.register(NamedFiles)
    rows = standard.select(file_name(template, split).alias("name"), F.col("json").alias("value")).sortWithinPartitions("name")
    rows.write.format("named_files").option("pretty", str(pretty).lower()).mode("overwrite" if overwrite else "append").save(folder)
