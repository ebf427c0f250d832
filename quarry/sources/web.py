"""Fetching pages: tables of URLs, or a Spark data source over a list of them. A failed URL is a row with its error."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.text import netloc

SCHEMA = "success boolean, url string, html string, markdown string, error_message string"


def fetch_one(url: str, timeout: float) -> tuple:
    from urllib.request import Request, urlopen

    from quarry.functions.markdown import to_markdown

    try:
        with urlopen(Request(url, headers={"User-Agent": "quarry"}), timeout=timeout) as answer:
            kind = answer.headers.get_content_type()
            text = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        return True, url, text, to_markdown(text) if kind == "text/html" else text, None
    except Exception as e:  # any failure belongs to its URL alone
        return False, url, None, None, str(e)


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])
        self.slices = max(1, int(options.get("slices", "10")))
        self.timeout = float(options.get("timeout", "30"))

    def partitions(self) -> list[_Urls]:
        n = min(self.slices, max(1, len(self.urls)))
        return [_Urls(self.urls[i::n]) for i in range(n)]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetch_one(url, self.timeout)


class WebPages(DataSource):
    """Options: urls (a JSON list), slices (how many tasks fetch, 10), timeout (seconds, 30)."""

    @classmethod
    def name(cls) -> str:
        return "webpages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def web_pages(spark: SparkSession, urls: list[str], max_concurrent: int = 10, timeout: float = 30.0) -> DataFrame:
    """success, url, html, markdown, error_message of each URL; ``max_concurrent`` tasks fetch at a time at most."""
    spark.dataSource.register(WebPages)
    return spark.read.format("webpages").option("urls", json.dumps(list(urls))).option("slices", max_concurrent).option("timeout", timeout).load()


def fetched_urls(urls: DataFrame, max_concurrent: int = 10, timeout: float = 30.0, per_host: int | None = None, delay: float = 0.0) -> DataFrame:
    """success, url, html, markdown, error_message of each row of ``urls`` (url); ``max_concurrent`` tasks fetch at a time at most.

    A host's URLs are dealt to ``per_host`` lanes (by default ``max_concurrent``), each in one task, which waits ``delay`` seconds
    between two requests of a lane: a host gets ``per_host / delay`` requests a second at most.
    Whoever reads the result more than once must store it first: each reading fetches.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[tuple, float] = {}
        for b in batches:
            for url, *lane in zip(*(c.to_pylist() for c in b.columns), strict=True):
                time.sleep(max(0.0, last.get(tuple(lane), -delay) + delay - time.monotonic()) if delay else 0.0)
                found = fetch_one(url, timeout)
                last[tuple(lane)] = time.monotonic()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.bool_() if i == 0 else pa.string()) for i, x in enumerate(found)], names)

    lane = F.pmod(F.xxhash64("url"), F.lit(per_host or max_concurrent))
    return urls.select("url", netloc(F.col("url")).alias("host"), lane.alias("lane")).repartition(max_concurrent, "host", "lane").mapInArrow(run, SCHEMA)
