"""A Spark data source for tables that are published as members of ZIP files.

`spark.read.format("zipped_tables")`: a partition a file. Only the wanted member of an archive is read, in batches of lines,
so no file is a row of Spark; of its fields only the columns of the schema are kept, and filters that compare a column with
given values are applied to the lines before anything leaves the reader.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: A column of this name holds the values of all columns whose name ends in _FN, parted by commas.
CITED = "CITED"
LINES = 10_000


@dataclass
class Archive(InputPartition):
    path: str


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:") :]
    return pyarrow.fs.FileSystem.from_uri(path)


class Reader(DataSourceReader):
    def __init__(self, names: list[str], table: str, files: list[str]) -> None:
        self.names, self.table, self.files = names, table, files
        self.among: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps comparisons of a column with given texts; Spark applies the others."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in self.names or f.attribute[0] == CITED or not all(isinstance(v, str) for v in values):
                yield f
            else:
                name = f.attribute[0]
                self.among[name] = self.among[name] & values if name in self.among else values

    def partitions(self) -> list[Archive]:
        return [Archive(f) for f in self.files]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        system, path = opened(partition.path)
        with system.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            member = next((m for m in archive.namelist() if m.lower().endswith(f"{self.table}.tsv".lower())), None)
            if member is None:
                return
            with io.TextIOWrapper(archive.open(member), "utf-8", "replace", newline="\n") as lines:
                header = next(lines, "").rstrip("\r\n").split("\t")
                at = {c: header.index(c) if c in header else None for c in self.names}
                cited = [i for i, c in enumerate(header) if c.endswith("_FN")]
                field = lambda row, i: (row[i] or None) if i is not None and i < len(row) else None
                while block := list(islice(lines, LINES)):
                    rows = [line.rstrip("\r\n").split("\t") for line in block]
                    for name, values in self.among.items():
                        rows = [row for row in rows if field(row, at[name]) in values]
                    columns = [[",".join(filter(None, (field(row, i) for i in cited))) for row in rows] if c == CITED else [field(row, at[c]) for row in rows] for c in self.names]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], self.names)


class ZippedTables(DataSource):
    """Options: table, the member's name without .tsv, in any case; files, a JSON list of paths."""

    @classmethod
    def name(cls) -> str:
        return "zipped_tables"

    def reader(self, schema) -> Reader:
        return Reader(schema.names, self.options["table"], json.loads(self.options["files"]))


def table(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """Columns, all text, of one table of the ZIP files under a path or pattern.

    Quotes are text, bytes that are no UTF-8 are replaced; fields that are empty, missing or of a column that a file lacks
    are null. A file without the table adds nothing.
    """
    spark.dataSource.register(ZippedTables)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())  # names only: a row a file
    return spark.read.format("zipped_tables").schema(", ".join(f"{c} string" for c in columns)).option("table", name).option("files", json.dumps(files)).load()
