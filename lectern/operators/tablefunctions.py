"""The fixed-window chunker as a table function for SQL, which keeps its state from row to row.

    register(spark)
    SELECT * FROM chunk_naive(TABLE(SELECT rfc, pdf, printed, text FROM pages) PARTITION BY rfc ORDER BY pdf)
    SELECT * FROM chunk_naive(TABLE(...) PARTITION BY rfc ORDER BY pdf, size => 500, overlap => 100)

The rows of a partition are a document's pages in order.  Windows are those of ``chunking.fixed_windows`` over the joined pages,
but a page is taken in as it comes and let go when no later window can reach it: what is held is a window and a page, so a
document of any length is never one array.  A null text is an empty page; a partition without visible text has no chunks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lectern.operators.chunking import OVERLAP, WINDOW
from lectern.schemas import POSITION

#: Built by hand: a schema text needs a session, which the process that analyses has not.
CHUNKS = StructType()
for _name, _kind in (("rfc", IntegerType()), ("i", IntegerType()), ("start", LongType()), ("end", LongType()), ("n_chars", IntegerType()), ("text", StringType()), ("page_start", POSITION), ("page_end", POSITION)):
    CHUNKS = CHUNKS.add(_name, _kind)
_SPACE, _TO_LAST_SPACE, _SPACES = re.compile(r"\s"), re.compile(r".*\s", re.DOTALL), re.compile(r"\s+")


class ChunkNaive:
    @staticmethod
    def analyze(pages: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pages.isTable or not {"rfc", "pdf", "printed", "text"} <= set(pages.dataType.names):
            raise ValueError("chunk_naive takes a table of pages with rfc, pdf, printed and text")
        n, m = (d if a is None else a.value for a, d in ((size, WINDOW), (overlap, OVERLAP)))
        if n is None or m is None or not 0 <= m < n:
            raise ValueError("overlap must be at least 0 and below size, both constant")
        return AnalyzeResult(CHUNKS)

    def __init__(self):
        self.held, self.base = "", 0  # text from the offset ``base`` on
        self.starts: list[int] = []  # offset of each page held, and its numbers
        self.pages: list[tuple] = []
        self.at: int | None = 0  # where the next window starts; None while that is sought from ``seek`` on
        self.seek = self.i = 0
        self.rfc, self.size, self.overlap, self.any = None, WINDOW, OVERLAP, False

    def eval(self, page: Row, size: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple]:
        self.rfc, self.size, self.overlap = page["rfc"], size, overlap
        if self.any:
            self.held += "\n"  # the line end between pages is the earlier page's
        self.any = True
        self.starts.append(self.base + len(self.held))
        self.pages.append((page["pdf"], page["printed"]))
        self.held += page["text"] or ""
        yield from self._windows(False)

    def terminate(self) -> Iterator[tuple]:
        yield from self._windows(True)

    def _windows(self, last: bool) -> Iterator[tuple]:
        """Windows whose end does not depend on what is still to come."""
        while self._started(last):
            s, n = self.at - self.base, len(self.held)
            end = s + self.size
            if end >= n:
                if not last or s >= n:
                    return
                end = n
            elif (space := _TO_LAST_SPACE.match(self.held, s, end)) is not None:
                end = space.end()
            elif (space := _SPACE.search(self.held, end)) is not None:
                end = space.start()
            elif last:
                end = n
            else:
                return
            text = self.held[s:end]
            if not text.isspace():
                first, behind = len(text) - len(text.lstrip()), len(text.rstrip())
                yield self.rfc, self.i, self.at, self.base + end, len(text), text, self._page(self.at + first), self._page(self.at + behind - 1)
                self.i += 1
            if last and end == n:
                self.at, self.seek, self.held, self.base = None, self.base + n, "", self.base + n
                return
            self.seek = self.base + max(end - self.overlap, s + 1)
            self.at = None
            self._let_go(self.seek)

    def _started(self, last: bool) -> bool:
        """Is the next window's start known?  It is behind the first spaces from ``seek`` on."""
        if self.at is None:
            spaces = _SPACES.search(self.held, self.seek - self.base)
            if spaces is None or (spaces.end() == len(self.held) and not last):
                return False
            self.at = self.base + spaces.end()
            self._let_go(self.at)
        return True

    def _let_go(self, offset: int) -> None:
        """Drops what lies before ``offset``."""
        self.held, self.base = self.held[offset - self.base :], offset
        k = bisect_right(self.starts, offset) - 1
        if k > 0:
            del self.starts[:k], self.pages[:k]

    def _page(self, offset: int) -> tuple:
        return self.pages[bisect_right(self.starts, offset) - 1]


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_naive", udtf(ChunkNaive))
