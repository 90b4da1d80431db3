"""Sources that answer page by page, as a Spark data source: whole crawls, tails, resumption, the end by search.

`spark.dataSource.register(PagedSource)`, then `spark.read.format("paged")` or `spark.readStream.format("paged")`. A page is
asked by number (from 0) through a fetcher: by default the page files below `path` (see write_pages); source(fetch, name)
makes a data source of any function of (number, options) that gives a list of JSON texts, empty past the end.

Pages are ranges of input partitions. With the option `kept`, a page is stored there as soon as it came, so that a broken
run, task or stream asks no page twice; pages of the overlap margin are asked again, as a source that grows also fills up
its last pages. Rows are (page long, place int, record string).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: A page of a source: (number, options) -> its records as JSON texts, none past the end.
Fetcher = Callable[[int, dict], list[str]]
SHAPE = "page long, place int, record string"


class Expired(RuntimeError):
    """What a fetcher raises when its token is no longer taken."""


def with_token(fetch: Callable[[int, dict, str], list[str]], renew: Callable[[], str]) -> Fetcher:
    """A fetcher that gets a token when it first needs one and renews it once for each page that is refused."""
    token: list[str] = []

    def call(number: int, options: dict) -> list[str]:
        if not token:
            token.append(renew())
        try:
            return fetch(number, options, token[0])
        except Expired:
            token[0] = renew()
            return fetch(number, options, token[0])

    return call


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def stored_page(number: int, options: dict) -> list[str]:
    """The records of page files that write_pages made below the option `path`."""
    system, path = _opened(f"{options['path'].rstrip('/')}/page={number}")
    out = []
    for info in sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda i: i.path):
        if info.is_file and info.path.endswith(".txt"):
            with system.open_input_stream(info.path) as f:
                out += [x for x in f.read().decode().split("\n") if x]
    return out


def write_pages(rows: DataFrame, page: str, order: str, path: str) -> None:
    """Store rows as page files: one folder a page number, one JSON text a row, in order."""
    said = F.to_json(F.struct(*(c for c in rows.columns if c != page)))
    rows.select(F.col(page).alias("page"), F.col(order).alias("_o"), said.alias("value")).repartition("page").sortWithinPartitions("page", "_o").drop("_o").write.mode("overwrite").partitionBy("page").text(path)


def find_end(ask: Callable[[int], bool], known: int = 0) -> int:
    """The number of pages of a source, of which `known` are there: doubled steps until a page is empty, then halves."""
    low, step = known, 1
    while ask(low + step - 1):
        low, step = low + step, step * 2
    high = low + step - 1
    while low < high:  # pages below low are there, page high is not
        mid = (low + high) // 2
        if ask(mid):
            low = mid + 1
        else:
            high = mid
    return low


class _Pages:
    """Asking, keeping and ranges, shared by both readers."""

    def __init__(self, options: dict, fetch: Fetcher):
        self.options, self.fetch = dict(options), fetch
        self.kept = options.get("kept")
        self.each = int(options.get("pagesPerTask", 16))

    def ask(self, number: int, again: bool = False) -> list[str]:
        """A page's records; those kept already aren't asked for, unless again."""
        if not self.kept:
            return self.fetch(number, self.options)
        system, path = _opened(f"{self.kept.rstrip('/')}/{number}.json")
        if not again and system.get_file_info(path).is_file:
            with system.open_input_stream(path) as f:
                return json.loads(f.read())
        got = self.fetch(number, self.options)
        if got:
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            part = f"{path}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(json.dumps(got).encode())
            system.move(part, path)  # whole or not at all
        return got

    def ranges(self, first: int, end: int, fresh_from: int) -> list[PageRange]:
        return [PageRange(a, min(a + self.each, end), fresh_from) for a in range(first, end, self.each)]

    def rows(self, pages: PageRange) -> Iterator[tuple]:
        for number in range(pages.first, pages.end):
            for place, record in enumerate(self.ask(number, number < pages.fresh_from)):
                yield number, place, record


class PageRange(InputPartition):
    """Pages first to end - 1; those before fresh_from are asked again even if kept."""

    def __init__(self, first: int, end: int, fresh_from: int = 0):
        self.first, self.end, self.fresh_from = first, end, fresh_from


class PagedReader(DataSourceReader):
    """All pages, or those from `first` to `last`; without `last` the end is searched for."""

    def __init__(self, options: dict, fetch: Fetcher):
        self.pages = _Pages(options, fetch)
        self.first, self.last = int(options.get("first", 0)), options.get("last")

    def partitions(self) -> list[PageRange]:
        end = int(self.last) + 1 if self.last is not None else find_end(lambda n: bool(self.pages.ask(n)), self.first)
        return self.pages.ranges(self.first, end, 0)

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.pages.rows(partition)


class PagedStreamReader(DataSourceStreamReader):
    """Offsets are numbers of pages seen. A batch starts `margin` pages before its offset: these are asked again."""

    def __init__(self, options: dict, fetch: Fetcher):
        self.pages = _Pages(options, fetch)
        self.margin, self.first = int(options.get("margin", 1)), int(options.get("first", 0))
        self.known = self.first

    def initialOffset(self) -> dict:  # noqa: N802
        return {"pages": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        # the last page known may have been asked when it was the end, so that only fresh answers tell
        self.known = find_end(lambda n: bool(self.pages.ask(n)), self.known)
        return {"pages": self.known}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        return self.pages.ranges(max(0, start["pages"] - self.margin), end["pages"], start["pages"])

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        self.known = max(self.known, end["pages"])


class PagedSource(DataSource):
    """Options: path, kept, pagesPerTask, first, last (batch), margin (stream), and whatever another fetcher reads."""

    fetch: Fetcher = staticmethod(stored_page)

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options, self.fetch)

    def streamReader(self, schema) -> PagedStreamReader:  # noqa: N802
        return PagedStreamReader(self.options, self.fetch)


def source(fetch: Fetcher, name: str) -> type[PagedSource]:
    """A data source of this name that asks its pages through fetch."""
    return type(name, (PagedSource,), {"fetch": staticmethod(fetch), "name": classmethod(lambda cls: name)})
