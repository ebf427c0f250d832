"""Filters with semantics of their own: metadata containment, thresholds, near-duplicate prefixes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(metadata: Column, wanted: dict[str, Any]) -> Column | None:
    """Whether a VARIANT holds ``wanted``: keys of objects, elements of arrays, equal scalars of the same kind. None for an empty filter."""
    if not wanted:
        return None
    out = None
    for key, value in wanted.items():
        one = _holds(metadata, f"$['{key}']" if not key.isidentifier() else f"$.{key}", value)
        out = one if out is None else out & one
    return F.coalesce(out, F.lit(False))


def _scalar(variant: Column, value: Any) -> Column:
    kind = F.schema_of_variant(variant)
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(variant, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (F.try_variant_get(variant, "$", "double") == float(value))
    return (kind == "STRING") & (F.try_variant_get(variant, "$", "string") == str(value))


def _element(item: Column, value: Any) -> Column:
    if isinstance(value, dict):
        inner = contains(item, value)
        return F.schema_of_variant(item).startswith("OBJECT") & (inner if inner is not None else F.lit(True))
    if isinstance(value, list):
        items = F.try_variant_get(item, "$", "array<variant>")
        out = items.isNotNull()
        for v in value:
            out = out & _any(items, v)
        return out
    return _scalar(item, value)


def _any(items: Column, value: Any) -> Column:
    return F.exists(items, lambda x: F.coalesce(_element(x, value), F.lit(False)))


def _holds(metadata: Column, path: str, value: Any) -> Column:
    return F.coalesce(_element(F.try_variant_get(metadata, path, "variant"), value), F.lit(False))


def where_metadata(df: DataFrame, wanted: dict[str, Any] | None, source: str | None = None, metadata: str = "metadata") -> DataFrame:
    """Rows of the source whose metadata holds ``wanted``; conditions are only built where given, so that scans can prune."""
    if source is not None:
        df = df.filter(F.col("source_id") == source)
    found = contains(F.col(metadata), wanted or {})
    return df if found is None else df.filter(found)


def with_language(wanted: dict[str, Any] | None, language: str | None) -> dict[str, Any]:
    """The filter with a language added; the caller's one stays as it is."""
    return {**(wanted or {}), **({"language": language} if language else {})}


def at_least(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Rows with a score of ``threshold`` or more (missing: 0); all rows for a threshold of 0. Stands behind any limit."""
    return df.filter(F.coalesce(F.col(score), F.lit(0.0)) >= threshold) if threshold > 0 else df


def new_prefixes(main: DataFrame, more: DataFrame, seq: str, content: str = "content", size: int = 100) -> DataFrame:
    """``main`` and those rows of ``more`` whose first characters neither ``main`` nor an earlier row of ``more`` has."""
    key = F.left(F.col(content), F.lit(size))
    fresh = more.withColumn("_prefix", key).join(main.select(key.alias("_prefix")).distinct(), "_prefix", "left_anti")
    first = F.row_number().over(Window.partitionBy("_prefix").orderBy(seq)) == 1
    fresh = fresh.withColumn("_first", first).filter("_first").drop("_first", "_prefix")
    return main.unionByName(fresh, allowMissingColumns=True)


def as_variant(columns: dict[str, Column]) -> Column:
    return F.parse_json(F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()])))
