"""A catalogue behind HTTP as a Spark data source: one row per published file, newest first.

    spark.dataSource.register(CatalogueSource)
    spark.read.format("catalogue").option("url", ...).option("territory_ids", "330330,330270").load()

Every territory is a partition, read by a task in pages of ``size``; an answer
without a list is an empty one, a failed request fails the task, which Spark
tries again.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "territory_id string, municipio string, data string, edicao string, url_origem string"
TIMEOUT_S = 30


class Territory(InputPartition):
    def __init__(self, territory_id: str):
        self.territory_id = territory_id


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.size = options["url"], int(options.get("size", "100"))
        self.most = int(options.get("most", "0"))
        self.territories = [t.strip() for t in options["territory_ids"].split(",") if t.strip()]

    def partitions(self) -> list[InputPartition]:
        return [Territory(t) for t in self.territories]

    def _page(self, territory_id: str, offset: int) -> list[dict]:
        query = urllib.parse.urlencode({"territory_ids": territory_id, "size": self.size, "offset": offset, "sort_by": "descending_date"})
        with urllib.request.urlopen(f"{self.url}?{query}", timeout=TIMEOUT_S) as answer:
            found = json.load(answer)
        return found.get("gazettes") or [] if isinstance(found, dict) else []

    def read(self, partition: Territory) -> Iterator[tuple]:
        offset = 0
        while True:
            page = self._page(partition.territory_id, offset)
            for row in page:
                yield tuple(None if row.get(k) is None else str(row[k]) for k in ("territory_id", "territory_name", "date", "edition", "url"))
            offset += len(page)
            if len(page) < self.size or (self.most and offset >= self.most):
                return


class CatalogueSource(DataSource):
    """Options: url, territory_ids (comma-separated), size (rows a request), most (rows a territory, 0 for all)."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return CatalogueReader(dict(self.options))
