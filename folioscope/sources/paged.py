"""A store that is read page by page as a Spark source: pages are partitions, cursors are offsets, filters are pushed.

The store is a client with three methods: `pages()` gives the number of pages so far; `page(number,
equal)` the rows of one page, of which `equal` (column -> values) may leave out those that differ;
and `columns()` the columns whose equality it can test.  A page doesn't change once a later one
exists.  Tasks read one page each, so a scan of any length needs no more memory than a page.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Client(Protocol):
    def pages(self) -> int: ...

    def page(self, number: int, equal: dict[str, list]) -> Iterator[tuple]: ...

    def columns(self) -> list[str]: ...


class Page(InputPartition):
    def __init__(self, number: int, equal: dict[str, list]) -> None:
        super().__init__(number)
        self.number, self.equal = number, equal


class _Reader(DataSourceReader):
    def __init__(self, client: Client) -> None:
        self.client, self.equal = client, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equalities of one column with values; the others stay with Spark."""
        able = set(self.client.columns())
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in able and f.attribute[0] not in self.equal:
                self.equal[f.attribute[0]] = [f.value] if isinstance(f, EqualTo) else list(f.value)
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [Page(n, self.equal) for n in range(self.client.pages())] or [Page(-1, {})]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.number >= 0:
            yield from self.client.page(partition.number, partition.equal)


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of pages: a restart goes on with the first page that was not committed."""

    def __init__(self, client: Client) -> None:
        self.client = client

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.client.pages()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(n, {}) for n in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.client.page(partition.number, {})


def register(spark: SparkSession, name: str, schema: str, client: Client) -> None:
    """Makes the client's store readable as `spark.read.format(name)` and `spark.readStream.format(name)`."""

    fields = schema

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return fields

        def reader(self, schema: object) -> DataSourceReader:
            return _Reader(client)

        def streamReader(self, schema: object) -> DataSourceStreamReader:
            return _StreamReader(client)

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Paged)
