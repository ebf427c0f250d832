"""Answers of models, kept by the digest of what was asked: no text is paid for twice, in one run or in a later one."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.store import Store


@dataclass
class Answers:
    """Kept in a folder of the store, a table for each ``kind`` of question. Failures aren't kept, so they are asked again."""

    store: Store
    _staged: list[str] = field(default_factory=list)

    def _read(self, kind: str, schema: str) -> DataFrame:
        spark, root = self.store.spark, f"{self.store.root}/answers/{kind}"
        parts = self.store.files.names(root)
        return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)

    def _stage(self, df: DataFrame) -> DataFrame:
        rows, folder = self.store.staged(df)
        self._staged.append(folder)
        return rows

    def add(self, rows: DataFrame, asked: Column, kind: str, result: str, ask: Callable[[Column], Column], sound: Callable[[Column], Column]) -> DataFrame:
        """``rows`` with ``_answer``, of type ``result``: what ``ask`` makes of ``asked``; null where the answer isn't ``sound``.

        Only distinct texts without an answer are asked. Rows are staged first, so that what makes them doesn't run again, and
        joined to a staged table of answers, so that a text which many rows share is split over tasks.
        """
        schema = f"_digest string, _answer {result}"
        keyed = self._stage(rows.withColumn("_asked", asked).withColumn("_digest", F.sha2(F.col("_asked").cast("binary"), 256)))
        wanted = keyed.filter("_digest IS NOT NULL").groupBy("_digest").agg(F.first("_asked").alias("_asked"))
        new = wanted.join(self._read(kind, schema).select("_digest"), "_digest", "left_anti").repartition("_digest")
        new = self._stage(new.select("_digest", ask(F.col("_asked")).alias("_answer")))  # before any filter, which would ask once more
        new.filter(sound(F.col("_answer"))).write.parquet(f"{self.store.root}/answers/{kind}/{uuid.uuid4().hex}")
        known = self._read(kind, schema).join(wanted.select("_digest"), "_digest", "left_semi").groupBy("_digest").agg(F.first("_answer").alias("_answer"))
        return keyed.join(self._stage(known), "_digest", "left").drop("_digest", "_asked")

    def release(self) -> None:
        """Delete what was staged; nothing that reads it may run later."""
        for folder in self._staged:
            self.store.files.delete(folder)
        self._staged.clear()
