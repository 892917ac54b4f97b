"""Projections, filters and orderings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import text


def public(df: DataFrame, hidden: Sequence[str] = ("embedding",)) -> DataFrame:
    """All columns but the vectors, so that they never reach a shuffle."""
    return df.drop(*hidden)


def prefixed(columns: Sequence[str], alias: str) -> list[Column]:
    """The columns of an aliased side of a join."""
    return [F.col(f"{alias}.{c}") for c in columns]


def ieq(c: Column | str, value: str) -> Column:
    return F.lower(text(c)) == F.lower(F.lit(value))


def where_all(df: DataFrame, *conditions: Column | None, **equal) -> DataFrame:
    """Rows that meet every condition given; null arguments ask for nothing."""
    wanted = [c for c in conditions if c is not None] + [F.col(k) == v for k, v in equal.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, wanted)) if wanted else df


def non_blank(c: Column | str) -> Column:
    return text(c).isNotNull() & (F.trim(text(c)) != "")


def parse_bbox(value: str) -> tuple[float, float, float, float]:
    """'west,south,east,north' as four numbers; anything else is an error."""
    parts = value.split(",")
    if len(parts) != 4:
        raise ValueError("a bounding box needs four numbers")
    return tuple(float(p) for p in parts)


def in_bbox(lon: Column | str, lat: Column | str, boxes: Iterable[tuple[float, float, float, float]]) -> Column:
    """Inside any of the boxes (west, south, east, north)."""
    tests = [text(lon).between(w, e) & text(lat).between(s, n) for w, s, e, n in boxes]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def text_match(query: str, cols: Sequence[str]) -> Column:
    """Literal, case-insensitive substring of any of the columns."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c)).contains(F.lower(F.lit(query))), F.lit(False)) for c in cols))


def in_list(df: DataFrame, key: str, values: Sequence | DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose key is (not) in a list; a DataFrame of keys is joined instead of inlined."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(key)).distinct(), key, "left_anti" if negate else "left_semi")
    hit = F.col(key).isin(list(values))
    return df.where(~hit if negate else hit)


def get(df: DataFrame, id_value, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == id_value)


def only_flagged(df: DataFrame, flag: str, include_all: bool = False) -> DataFrame:
    return df if include_all else df.where(F.col(flag))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    """One page of a total order; the key breaks ties."""
    return df.orderBy(*order, key).offset(offset).limit(limit)


def shortest_first(df: DataFrame, label: str, key: str = "id") -> DataFrame:
    return df.orderBy(F.length(label), key)


def order_mixed(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Order by (column, descending) pairs."""
    return df.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in keys))


def top_k(df: DataFrame, score: str, k: int, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k)


def capped_union(df: DataFrame, source: str, order: Sequence[Column], limit: int, n_sources: int, source_order: str) -> DataFrame:
    """At most max(5, ceil(limit / sources)) rows of each source, in source order, cut at the limit."""
    per = max(5, -(-limit // max(1, n_sources)))
    rank = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= per).orderBy(source_order, "_rank").limit(limit).drop("_rank")
