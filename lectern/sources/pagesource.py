"""Pages of documents as a batch data source that plans by file and page range and takes filters on both.

    read_pages(spark, "/data/rfc").where("rfc in (3261, 3262) and pdf < 10")

Rows are (rfc, path, pdf, text), a row a page, numbered from 0.  Files are named ``RFC <n>.<ending>``: text files whose pages are
parted by a mark, and PDFs where pymupdf is installed on the workers.  A file whose number a filter rules out is not opened; of
the others, tasks read ranges: of at most ``pagesPerTask`` pages of a PDF, of about ``bytesPerTask`` bytes of a text file, where a
page belongs to the range that it starts in.  A task of a text file reads past its range to the end of its last page, and scans
what comes before for marks, to know the number of its first page.  Pages that a filter rules out are not decoded.

Folders may be local or in a store that Arrow's file systems open.  A file without a number in its name is an error; an empty
folder has no pages; an empty text file is one empty page, as splitting it by the mark gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lectern.sources.pages import PAGE_MARK

SCHEMA = "rfc int, path string, pdf int, text string"
PAGES_PER_TASK, BYTES_PER_TASK, BLOCK = 200, 64 << 20, 1 << 20
_NUMBER = re.compile(r"(?i)RFC(?:\s|%20)*(\d+)\.(pdf|txt)$")
_MARK = PAGE_MARK.encode()
#: What a filter on a number asks.
_TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}


def read_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    """The pages under ``path``; the options are pagesPerTask and bytesPerTask.

    Spark (4.1) hands filters to such sources only where a setting allows it, which is made here, and keeps those it has handed
    over for a later plan over the same frame that has none to hand over.  So the frame comes with a filter that all pages
    pass and every plan hands over, and the source refuses to be read without it.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageDataSource)
    return spark.read.format(PageDataSource.name()).options(**options).load(path).where(F.col("pdf") >= 0)


@dataclass
class PageRange(InputPartition):
    """Pages of a PDF from ``start`` to ``end``, or those of a text file that start at such a byte."""

    path: str
    rfc: int
    is_pdf: bool
    start: int
    end: int


class PageReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        if "path" not in options:
            raise ValueError("the option path is missing")
        self.path = options["path"]
        self.pages_per_task, self.bytes_per_task = int(options.get("pagesPerTask", PAGES_PER_TASK)), int(options.get("bytesPerTask", BYTES_PER_TASK))
        self.filters: dict[str, list[tuple[str, object]]] = {"rfc": [], "pdf": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of the document's and the page's number; others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if type(f) in _TESTS and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name in self.filters and value is not None and not (isinstance(value, tuple) and None in value):
                self.filters[name].append((type(f).__name__, value))
            else:
                yield f

    def _passes(self, name: str, x: int) -> bool:
        tests = {k.__name__: t for k, t in _TESTS.items()}
        return all(tests[kind](x, value) for kind, value in self.filters[name])

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        if (GreaterThanOrEqual.__name__, 0) not in self.filters["pdf"]:
            raise ValueError("pages are read by read_pages")
        store, folder = self._open()
        out: list[InputPartition] = []
        for info in sorted(store.get_file_info(fs.FileSelector(folder, recursive=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.path.lower().endswith((".pdf", ".txt")):
                continue
            named = _NUMBER.search(info.path)
            if not named:
                raise ValueError(f"no RFC number in {info.path}")
            rfc, is_pdf = int(named[1]), named[2].lower() == "pdf"
            if not self._passes("rfc", rfc):
                continue
            if is_pdf:
                n, step = self._page_count(store, info.path), self.pages_per_task
                out += [PageRange(info.path, rfc, True, a, min(n, a + step)) for a in range(0, n, step) if any(self._passes("pdf", p) for p in range(a, min(n, a + step)))]
            else:
                ends = [*range(self.bytes_per_task, info.size, self.bytes_per_task), info.size + 1]  # behind a mark at the very end an empty page starts
                out += [PageRange(info.path, rfc, False, a, b) for a, b in zip([0, *ends], ends, strict=False)]
        return out or [PageRange("", 0, False, 0, 0)]

    def _page_count(self, store: fs.FileSystem, path: str) -> int:
        import pymupdf

        with store.open_input_file(path) as f, pymupdf.open(stream=f.read(), filetype="pdf") as doc:
            return doc.page_count

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if not partition.path:
            return
        store, _ = self._open()
        made = self._pdf(store, partition) if partition.is_pdf else self._text(store, partition)
        for pdf, text in made:
            yield partition.rfc, partition.path, pdf, text

    def _pdf(self, store: fs.FileSystem, part: PageRange) -> Iterator[tuple[int, str]]:
        import pymupdf

        with store.open_input_file(part.path) as f, pymupdf.open(stream=f.read(), filetype="pdf") as doc:
            for p in range(part.start, part.end):
                if self._passes("pdf", p):
                    yield p, doc[p].get_text()

    def _text(self, store: fs.FileSystem, part: PageRange) -> Iterator[tuple[int, str]]:
        """Pages that start in the range; a page starts at the file's beginning and behind every mark."""
        with store.open_input_stream(part.path) as f:
            at, page, held = 0, 0, b""  # held: bytes from ``at`` on that are not dealt with
            starts_here = part.start == 0
            ended = False
            while True:
                k = held.find(_MARK)
                if k < 0 and not ended:
                    if not starts_here:  # nothing of this page is wanted: all but what may begin a mark can go
                        drop = max(0, len(held) - len(_MARK) + 1)
                        at, held = at + drop, held[drop:]
                    more = f.read(BLOCK)
                    ended = not more
                    held += more
                    continue
                if starts_here and self._passes("pdf", page):
                    yield page, (held if k < 0 else held[:k]).decode()
                if k < 0:
                    return
                at, held, page = at + k + len(_MARK), held[k + len(_MARK) :], page + 1
                if at >= part.end:
                    return
                starts_here = at >= part.start


class PageDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)
