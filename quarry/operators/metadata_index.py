"""An inverted list of metadata: every path of an object with every scalar that stands there.

Elements of an array share one path, so a filter's leaves are all among those of each row that holds it. Rows that have all
of them may still not hold the filter (its leaves may come from several elements), so the filter itself follows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAVES = "leaf long, id long, url string, address int, seq long"


def _walk(value: Any, path: str) -> Iterator[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(v, f"{path}.{json.dumps(k)}")
    elif isinstance(value, list):
        for v in value:
            yield from _walk(v, f"{path}[]")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        yield f"{path}={float(value)!r}"
    else:
        yield f"{path}={json.dumps(value)}"


def leaves_of(value: Any) -> list[int]:
    """The distinct leaves of a JSON value, as 64-bit hashes."""
    return sorted({int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for x in _walk(value, "")})


def leaves(rows: DataFrame) -> DataFrame:
    """A row for each leaf of each row's metadata: what ``LEAVES`` says."""

    @F.pandas_udf("array<bigint>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: leaves_of(json.loads(x)) if x is not None else None)

    return rows.select(F.explode(of(F.to_json("metadata"))).alias("leaf"), "id", "url", "address", "seq")


def holding(index: DataFrame, wanted: dict[str, Any]) -> DataFrame | None:
    """id, address of the rows that have all leaves of a filter; None for a filter without any."""
    found = leaves_of(wanted)
    if not found:
        return None
    rows = index.filter(F.col("leaf").isin(found))
    return rows.groupBy("id", "address").agg(F.count_distinct("leaf").alias("_n")).filter(F.col("_n") == len(found)).select("id", "address")
