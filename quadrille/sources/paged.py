"""A data source over a paged search service: one partition per query, pages until a short one, ranks running on.

All rows are read unless the option ``most`` bounds them; a cut is reported on standard error.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, int, int], list[dict] | dict]


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.queries = [q for q in options.get("queries", "").split("\n") if q.strip()]
        self.limit = int(options.get("limit", 25))
        self.most = int(options["most"]) if "most" in options else None
        self.retries = int(options.get("retries", 3))
        self.wait = float(options.get("wait", 60))
        self.fetch = fetch

    def partitions(self):
        return [_Query(q) for q in self.queries]

    def page(self, query: str, skip: int) -> list[dict]:
        """One page, tried again after a wait when the service is busy; a list, or an envelope with data."""
        for attempt in range(self.retries + 1):
            try:
                got = self.fetch(query, self.limit, skip)
                return got["data"] if isinstance(got, dict) else got
            except ConnectionError:
                if attempt == self.retries:
                    raise
                time.sleep(self.wait)
        return []

    def read(self, partition) -> Iterator[tuple]:
        rank = skip = 0
        while self.most is None or rank < self.most:
            rows = self.page(partition.query, skip)
            for r in rows:
                if r.get("type", "courses") != "courses":
                    continue
                if rank == self.most:
                    print(f"{partition.query!r}: cut after the {rank} rows that the option most allows", file=sys.stderr)
                    return
                rank += 1
                code = r.get("code") or f"{r.get('subject', '')}{r.get('number', '')}"
                yield partition.query, rank, code, r.get("title"), r.get("href")
            if len(rows) < self.limit:
                return
            skip += self.limit


def paged_source(fetch: Fetch, name: str = "paged_search") -> type[DataSource]:
    """A data source class to register with spark.dataSource.register; fetch(query, limit, skip) gets one page."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "query string, rank int, code string, title string, href string"

        def reader(self, schema) -> PagedReader:
            return PagedReader(dict(self.options), fetch)

    return Paged
