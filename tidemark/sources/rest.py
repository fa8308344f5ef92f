"""A paged JSON endpoint as a Spark data source: ``spark.read.format("rest_pages")``."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def rows_of(body) -> list:
    """The rows of an answer: a list, or an object that has one as ``data`` or ``items``."""
    found = body if isinstance(body, list) else next((body[k] for k in ("data", "items") if isinstance(body, dict) and isinstance(body.get(k), list)), None)
    if found is None:
        raise ValueError("the answer has no list of rows, neither bare nor as data or items")
    return found


@dataclass
class Stride(InputPartition):
    """Pages first, first + step, first + 2 x step, ..."""

    first: int
    step: int


class PageReader(DataSourceReader):
    """Reads pages in strides. Pages fill up in order, so a stride ends at its first page that is not full: no later page can hold rows. A task that is run again asks for the same pages."""

    def __init__(self, options: dict):
        get = lambda name, default: options.get(name, default)
        if not get("url", ""):
            raise ValueError("the option url is missing")
        self.url, self.page, self.size = options["url"], get("pageParam", "page"), get("sizeParam", "per_page")
        self.rows, self.step, self.timeout = int(get("pageSize", 1000)), int(get("readers", 8)), float(get("timeout", 30))
        self.params = json.loads(get("params", "{}"))
        self.headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {options['token']}"} if get("token", "") else {})

    def partitions(self) -> list[InputPartition]:
        return [Stride(k + 1, self.step) for k in range(self.step)]

    def fetch(self, page: int) -> list:
        query = urllib.parse.urlencode({**self.params, self.page: page, self.size: self.rows})
        request = urllib.request.Request(f"{self.url}{'&' if '?' in self.url else '?'}{query}", headers=self.headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return rows_of(json.load(answer))
        except (urllib.error.URLError, TimeoutError, ValueError) as e:
            # Neither headers nor parameters are repeated here: they may hold secrets.
            raise RuntimeError(f"page {page} of {self.url.split('?')[0]} could not be read: {type(e).__name__}: {e}") from e

    def read(self, partition: Stride) -> Iterator[tuple]:
        page = partition.first
        while True:
            found = self.fetch(page)
            yield from ((json.dumps(row, ensure_ascii=False),) for row in found)
            if len(found) < self.rows:
                return
            page += partition.step


class RestPages(DataSource):
    """Options: url, pageParam (page), sizeParam (per_page), pageSize (1000), readers (8), params (a JSON object), token, timeout."""

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def read_rest(spark: SparkSession, url: str, schema: str, **options) -> DataFrame:
    """The rows of all pages in columns of ``schema``; fields that do not fit are null, no rows at all give an empty frame."""
    from pyspark.sql import functions as F

    spark.dataSource.register(RestPages)
    pages = spark.read.format("rest_pages").option("url", url).options(**{k: json.dumps(v) if isinstance(v, dict) else v for k, v in options.items()}).load()
    return pages.select(F.from_json("value", schema).alias("row")).select("row.*")
