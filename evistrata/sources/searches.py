"""Search services as a Spark data source."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Fetch = Callable[[str, int, str], Iterable[Mapping]]


class Page(InputPartition):
    """One page of a search, read by one task."""

    def __init__(self, number: int, name: str) -> None:
        super().__init__(number)
        self.name = name


def search_runner(spark: SparkSession, fetch: Fetch, schema: str, pages: Sequence[str] = ("",)) -> Callable[[str, int], DataFrame]:
    """A runner for ``run_searches`` from ``fetch(query, limit, page)``, which yields mappings.

    Every page is a task of its own, so a lost executor repeats its pages only, and records go to
    Spark as they come.  ``schema`` needs no ``seq``: it is added, ascending by page and then as
    fetched, and the runner's records need no order of their own.  Fields a mapping lacks are
    null; others are left out.  ``fetch`` runs on executors and may raise: the search fails then.
    """
    columns = StructType.fromDDL(schema).fieldNames()
    if "seq" in columns:
        raise ValueError("seq is given by the runner")
    whole = StructType.fromDDL(f"seq bigint, {schema}")
    name = f"search_{uuid.uuid4().hex}"

    class Reader(DataSourceReader):
        def __init__(self, query: str, limit: int) -> None:
            self.query, self.limit = query, limit

        def partitions(self) -> Sequence[InputPartition]:
            return [Page(number, page) for number, page in enumerate(pages)]

        def read(self, partition: Page) -> Iterator[tuple]:
            for place, record in enumerate(fetch(self.query, self.limit, partition.name)):
                yield (partition.value << 40 | place, *[record.get(column) for column in columns])

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return whole

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(self.options["query"], int(self.options["limit"]))

    spark.dataSource.register(Search)
    return lambda query, limit: spark.read.format(name).option("query", query).option("limit", str(limit)).load()
