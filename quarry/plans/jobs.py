"""Running crawls: started, listed and cancelled by id, through Spark's job tags."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Crawl:
    crawl_id: str
    urls: list[str]
    kind: str
    started: float = field(default_factory=time.time)
    cancelled: bool = False


class Crawls:
    """One registry for the process, so that any call can cancel what another one began."""

    def __init__(self):
        self._lock, self._running = threading.Lock(), {}

    def start(self, spark: SparkSession, urls: list[str], kind: str) -> Crawl:
        crawl = Crawl(str(uuid.uuid4()), urls, kind)
        with self._lock:
            self._running[crawl.crawl_id] = crawl
        spark.sparkContext.addJobTag(crawl.crawl_id)
        return crawl

    def finish(self, spark: SparkSession, crawl_id: str) -> None:
        """Safe to call again after a cancellation."""
        with self._lock:
            self._running.pop(crawl_id, None)
        spark.sparkContext.removeJobTag(crawl_id)

    def is_cancelled(self, crawl_id: str) -> bool:
        with self._lock:
            crawl = self._running.get(crawl_id)
        return crawl is None or crawl.cancelled

    def cancel(self, spark: SparkSession, crawl_id: str) -> bool:
        """Whether there was such a crawl; its Spark jobs are interrupted."""
        with self._lock:
            crawl = self._running.pop(crawl_id, None)
        if crawl is None:
            return False
        crawl.cancelled = True
        spark.sparkContext.cancelJobsWithTag(crawl_id)
        return True

    def cancel_all(self, spark: SparkSession) -> int:
        with self._lock:
            ids = list(self._running)
        return sum(self.cancel(spark, i) for i in ids)

    def active(self) -> dict[str, dict]:
        """Each running crawl by its id."""
        now = time.time()
        with self._lock:
            return {c.crawl_id: {"operation_type": c.kind, "urls": c.urls, "start_time": c.started, "status": "running", "runtime_seconds": round(now - c.started, 2), "url_count": len(c.urls)} for c in self._running.values()}


CRAWLS = Crawls()
