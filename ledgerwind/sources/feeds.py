"""A Spark data source for feed pages, in batches and as a stream whose offset is the last page that was read.

`spark.read.format("feed_pages")` or `spark.readStream...`: a partition some pages, a row an entry, with its page and position. A
page that can't be read gives one row with a fault, so that it holds nothing else up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgerwind.sources.zipped import opened

SCHEMA = "page string, position int, accession string, form string, accepted_at timestamp, url string, cik string, fault string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
# How a filing and a filer are told in an entry.
ACCESSION, CIK = re.compile(r"(\d{10}-\d{2}-\d{6})"), re.compile(r"/data/(\d+)/")


#: Tasks that a folder of pages is read in, before a task takes several pages, and pages of a task at most.
TASKS, MOST = 64, 64


@dataclass
class Pages(InputPartition):
    paths: list[str]


def dealt(paths: list[str]) -> list[Pages]:
    """A page a task up to TASKS pages, then runs of pages in their order: a page is small next to what a task costs."""
    size = min(MOST, -(-len(paths) // TASKS)) or 1
    return [Pages(paths[i : i + size]) for i in range(0, len(paths), size)]


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _entry(page: str, position: int, entry: ElementTree.Element) -> tuple:
    child = {_plain(e.tag): e for e in reversed(list(entry))}
    href = child["link"].get("href", "") if "link" in child else ""
    written = lambda name: (child[name].text or "").strip() if name in child else ""
    accession, cik = ACCESSION.search(written("id")) or ACCESSION.search(href), CIK.search(href)
    try:
        at, fault = datetime.fromisoformat(written("updated")), None
    except ValueError:
        at, fault = None, "bad date"
    if at is not None and at.tzinfo is None:
        at = at.replace(tzinfo=timezone.utc)
    if not accession or not cik:
        fault = "no accession or filer"
    return page, position, accession and accession[1], child["category"].get("term") if "category" in child else None, at, href, (cik[1].lstrip("0") or None) if cik else None, fault


def entries(page: str, data: bytes) -> list[tuple]:
    """Rows of SCHEMA for one page."""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return [(page, -1, None, None, None, None, None, "malformed page")]
    return [_entry(page, i, e) for i, e in enumerate(x for x in root.iter() if _plain(x.tag) == "entry")]


def _read(path: str) -> Iterator[pa.RecordBatch]:
    system, at = opened(path)
    with system.open_input_file(at) as file:
        rows = entries(path.rpartition("/")[2], file.readall())
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)


def pages(path: str, after: str = "", upto: str | None = None) -> list[str]:
    """The pages of a folder, or a single one, in the order of their names; those behind one and up to another."""
    system, root = opened(path)
    found = system.get_file_info(root)
    files = system.get_file_info(pyarrow.fs.FileSelector(root)) if found.type == pyarrow.fs.FileType.Directory else [found]
    names = sorted(f.base_name for f in files if f.type == pyarrow.fs.FileType.File and not f.base_name.startswith((".", "_")))
    base = path.rstrip("/") if found.type == pyarrow.fs.FileType.Directory else path.rpartition("/")[0]
    return [f"{base}/{n}" for n in names if n > after and (upto is None or n <= upto)]


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Page]:
        return dealt(pages(self.path))

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield from _read(path)


class StreamReader(DataSourceStreamReader):
    """The offset is the name of the last page; later pages must have later names."""

    def __init__(self, path: str) -> None:
        self.path, self.last = path, ""

    def initialOffset(self) -> dict:
        return {"page": ""}

    def latestOffset(self) -> dict:
        found = pages(self.path)
        self.last = found[-1].rpartition("/")[2] if found else self.last
        return {"page": self.last}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return dealt(pages(self.path, start["page"], end["page"]))

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield from _read(path)


class FeedPages(DataSource):
    """Option path: a folder of pages, or one page."""

    @classmethod
    def name(cls) -> str:
        return "feed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"])
