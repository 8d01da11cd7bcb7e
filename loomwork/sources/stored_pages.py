"""Stored pages of many hosts as a data source: `spark.read.format("stored_pages")` walks each host, `spark.readStream` follows what is added.

A folder, which all executors see, holds a folder for each host, with a file for each page, `{"url": ..., "html": ...}`, added under rising names and never
changed. In a batch every host is a partition: a breadth-first walk over links to the same host, from the seeds of that host (option `seeds`, blank-separated),
`depth` links far, `most_pages` pages at most, as `pages.crawl` does with joins. A walk holds one host's addresses and reads a page when it
reaches it. In a stream the offset of a host is the number of its files that were read, so a restart goes on where the checkpoint was, and
every page comes once.

Defined cases: a file that is no such page is left out of a walk, and a stream gives its name as url and null html; of two files with one url the last counts in a walk.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*["'](https?://[^"'#\s]+)""", re.IGNORECASE)


@dataclass
class Host(InputPartition):
    name: str
    start: int = 0
    end: int = 0


def _files(folder: str, host: str) -> list[str]:
    return sorted(f"{folder}/{host}/{n}" for n in os.listdir(f"{folder}/{host}") if n.endswith(".json"))


def _page(file: str) -> tuple[str, str] | None:
    try:
        with open(file, encoding="utf-8") as f:
            page = json.load(f)
        return str(page["url"]), str(page["html"])
    except (ValueError, KeyError, TypeError):
        return None


def _host(url: str) -> str:
    return (urlsplit(url).hostname or "").lower()


def walk(files: list[str], seeds: list[str], depth: int, most: int) -> Iterator[tuple[str, str, int]]:
    """(url, html, depth) of what the seeds reach, nearest first, by address among equally near ones."""
    places = {page[0]: f for f in files if (page := _page(f))}
    front, seen, given = sorted({s for s in seeds}), set(seeds), 0
    for at in range(depth + 1):
        found: set[str] = set()
        for url in front:
            if given == most:
                return
            page = _page(places[url]) if url in places else None
            if page is None:
                if at == 0:  # a seed that isn't stored is still reached
                    given += 1
                    yield url, None, 0
                continue
            given += 1
            yield url, page[1], at
            found |= {x for x in LINK.findall(page[1]) if _host(x) == _host(url) and x in places}
        front = sorted(found - seen)
        seen |= found


class Walks(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.seeds = options["path"], options.get("seeds", "").split()
        self.depth, self.most = int(options.get("depth", "2")), int(options.get("most_pages", "80"))

    def partitions(self) -> list[Host]:
        hosts = {d for d in os.listdir(self.folder) if os.path.isdir(f"{self.folder}/{d}")}
        return [Host(h) for h in sorted(hosts & {_host(s) for s in self.seeds})] or [Host("")]

    def read(self, partition: Host) -> Iterator[tuple]:
        if partition.name:
            own = [s for s in self.seeds if _host(s) == partition.name]
            yield from walk(_files(self.folder, partition.name), own, self.depth, self.most)


class Arrivals(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {d: n for d in sorted(os.listdir(self.folder)) if os.path.isdir(f"{self.folder}/{d}") and (n := len(_files(self.folder, d)))}

    def partitions(self, start: dict, end: dict) -> list[Host]:
        return [Host(h, start.get(h, 0), n) for h, n in end.items() if n > start.get(h, 0)]

    def read(self, partition: Host) -> Iterator[tuple]:
        for file in _files(self.folder, partition.name)[partition.start : partition.end]:
            url, html = _page(file) or (os.path.basename(file), None)
            yield url, html, 0

    def commit(self, end: dict) -> None:
        pass


class StoredPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return "url string, html string, depth int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Walks(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return Arrivals(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoredPages)
