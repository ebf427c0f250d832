"""A crawl whose frontier is stored: it goes on after a failure, shares the load of hosts out, and tries again what failed for a time."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import defragmented, netloc
from quarry.sources.files import Files
from quarry.sources.pages import links

GOT = "success boolean, url string, html string, markdown string, error_message string, depth int, attempt int"
QUEUE = "url string, turn long"


def temporary(error: Column) -> Column:
    """Whether a failure may be gone at the next attempt: limits, faults of the server, lost and refused connections."""
    return F.coalesce(error.rlike(r"(?i)HTTP Error (408|425|429|5\d\d)|timed? ?out|temporar|connection (reset|refused|aborted)|remote end closed|unreachable"), F.lit(False))


@dataclass(frozen=True)
class Limits:
    """``turn``: about how many URLs of one host are fetched in a job; ``attempts`` at each URL; ``wait``: seconds before the second one, then doubled."""

    turn: int = 10_000
    attempts: int = 3
    wait: float = 1.0


class StoredCrawl:
    """Follows internal links level by level and keeps all it knows below ``root``, on any file system that Spark reads.

    A level's queue is its new URLs, in turns by their hash: as many as the host with most URLs needs to stay within ``turn`` a
    job. Each turn's pages are a table of their own. A table counts once its marker is there, which is made at once and names its
    folder; so a crawl that is started again in the same ``root`` fetches only what no finished turn has, and of two crawls at once
    both read what the first has marked. A URL of any queue was visited; new links are those in none, by an anti-join.
    ``follow`` gives the links (url, link) of successes: by default those of the html that was fetched.
    """

    def __init__(self, spark: SparkSession, root: str, fetch: Callable[[DataFrame], DataFrame], max_depth: int = 3, limits: Limits | None = None, follow: Callable[[DataFrame], DataFrame] = links):
        self.spark, self.root, self.fetch, self.max_depth, self.limits, self.follow = spark, root.rstrip("/"), fetch, max_depth, limits or Limits(), follow
        self.files = Files(spark, root)

    # --- steps that are done once ---

    def _once(self, name: str, schema: str, make: Callable[[], DataFrame], facts: Callable[[DataFrame], dict]) -> dict:
        """The marker of step ``name`` (its folder, and ``facts`` about its table); the step is done now where there is none."""
        marker = f"{self.root}/done/{name}.json"
        if not self.files.fs.exists(self.files.path(marker)):
            folder = f"{self.root}/{name}-{uuid.uuid4().hex}"
            make().write.parquet(folder)
            known = {"folder": folder} | facts(self._read(schema, folder))
            self.files.fs.mkdirs(self.files.path(f"{self.root}/done"))
            if self.files.commit(marker, json.dumps(known)):
                return known
            self.files.delete(folder)
        return json.loads(self.files.read(marker))

    def _read(self, schema: str, *folders: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders)

    def _queue(self, depth: int, urls: Callable[[], DataFrame]) -> dict:
        def make() -> DataFrame:
            found = f"found-{depth:04d}"
            step = self._once(found, "url string", lambda: urls().select(defragmented(F.col("url")).alias("url")).filter("url <> ''").distinct(), most)
            turn = F.pmod(F.xxhash64("url"), F.lit(max(1, -(-step["most"] // self.limits.turn))))
            return self._read("url string", step["folder"]).withColumn("turn", turn)

        def most(found: DataFrame) -> dict:
            return {"most": found.groupBy(netloc(F.col("url"))).count().agg(F.max("count")).first()[0] or 0}

        def turns(queue: DataFrame) -> dict:
            return {"turns": [r[0] for r in queue.select("turn").distinct().orderBy("turn").toLocalIterator()]}

        return self._once(f"queue-{depth:04d}", QUEUE, make, turns)

    def _turn(self, depth: int, turn: int, attempt: int, urls: DataFrame) -> dict:
        def make() -> DataFrame:
            got = self.fetch(urls.select("url"))
            error = F.col("error_message") if "error_message" in got.columns else F.lit(None)
            return got.select("success", "url", "html", "markdown", error.cast("string").alias("error_message"), F.lit(depth).alias("depth"), F.lit(attempt).alias("attempt"))

        return self._once(f"got-{depth:04d}-{turn:08d}-{attempt:02d}", GOT, make, lambda got: {"again": got.filter(self._fails_for_now()).count()})

    @staticmethod
    def _fails_for_now() -> Column:
        return ~F.coalesce(F.col("success"), F.lit(False)) & temporary(F.col("error_message"))

    # --- the crawl ---

    def run(self, start: DataFrame, stopped: Callable[[], bool] = lambda: False) -> DataFrame:
        """success, url, html, markdown, error_message, depth, attempt of each visited URL: what its last attempt gave.

        ``start`` (url) counts in a new folder only. ``stopped`` is asked before each turn; a stopped crawl can go on later.
        """
        folders: list[str] = []
        queues: list[str] = []
        new = lambda: start
        for depth in range(1, self.max_depth + 1):
            queue = self._queue(depth, new)
            if not queue["turns"]:
                break
            queues.append(queue["folder"])
            level: list[str] = []
            again = {t: self._read(QUEUE, queue["folder"]).filter(F.col("turn") == t) for t in queue["turns"]}
            for attempt in range(1, self.limits.attempts + 1):
                waited, following = attempt == 1, {}
                for turn, urls in again.items():
                    if stopped():
                        raise RuntimeError("the crawl was cancelled")
                    if not waited:
                        time.sleep(self.limits.wait * 2 ** (attempt - 2))
                        waited = True
                    step = self._turn(depth, turn, attempt, urls)
                    level.append(step["folder"])
                    if step["again"]:
                        following[turn] = self._read(GOT, step["folder"]).filter(self._fails_for_now())
                again = following
            folders += level
            if depth < self.max_depth:
                good = self._read(GOT, *level).filter(F.col("success") & (F.coalesce(F.col("markdown"), F.lit("")) != ""))
                visited = self._read(QUEUE, *queues).select("url")
                new = lambda good=good, visited=visited: self.follow(good).select(defragmented(F.col("link")).alias("url")).distinct().join(visited, "url", "left_anti")
        got = self._read(GOT, *folders) if folders else self.spark.createDataFrame([], GOT)
        return got.filter(~self._fails_for_now() | (F.col("attempt") == self.limits.attempts))

    def delete(self) -> None:
        self.files.delete(self.root)
