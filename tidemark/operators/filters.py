"""Filters, ordering and paging of readings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import moment, to_timestamp_ntz
from ..schema import READING_TYPES, SORT_COLUMNS
from ..session import written
from .layout import COPIES, counted_layout, slice_by_rank
from .lookup import measured

# A top-k plan keeps offset + limit rows per task; deeper pages use a sorted table.
TOP_K_ROWS = 100_000
TAIL = "_row_hash"


def time_range(df: DataFrame, start=None, end=None, column: str = "timestamp") -> DataFrame:
    """Both ends inclusive, either end open. Adds the ``date`` partition filter when there is one."""
    dated = "date" in df.columns
    if start is not None:
        df = df.where(F.col(column) >= moment(start))
        if dated:
            df = df.where(F.col("date") >= moment(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= moment(end))
        if dated:
            df = df.where(F.col("date") <= moment(end).cast("date"))
    return df


def filter_readings(
    df: DataFrame,
    sensor_id=None,
    reading_type=None,
    field=None,
    start=None,
    end=None,
    min_value=None,
    max_value=None,
    anomalous=None,
    **_ignored,
) -> DataFrame:
    """An absent parameter filters nothing; an unknown one is ignored."""
    for name, wanted in (("sensor_id", sensor_id), ("reading_type", reading_type), ("field", field)):
        if wanted is not None:
            df = df.where(F.col(name) == F.lit(wanted))
    df = time_range(df, start, end)
    if min_value is not None:
        df = df.where(F.col("value") >= F.lit(float(min_value)))
    if max_value is not None:
        df = df.where(F.col("value") <= F.lit(float(max_value)))
    if anomalous is not None:
        df = df.where(F.col("anomalous_reading") == F.lit(bool(anomalous)))
    return df


def filter_stored(df: DataFrame, start=None, end=None, reading_type=None, field=None) -> DataFrame:
    """Filter of stored files: rows without a timestamp pass the time range."""
    ts = F.col("timestamp")
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        ts = to_timestamp_ntz(ts)
    if start is not None:
        df = df.where(ts.isNull() | (ts >= moment(start)))
    if end is not None:
        df = df.where(ts.isNull() | (ts <= moment(end)))
    return filter_readings(df, reading_type=reading_type, field=field)


def check_arguments(
    reading_type=None, start=None, end=None, page=None, limit=None, sort_by=None, sort_order=None
) -> None:
    """Domain rules of a request, raised before any job is planned."""
    if reading_type is not None and reading_type not in READING_TYPES:
        raise ValueError(f"reading_type must be one of {', '.join(READING_TYPES)}")
    for name, text in (("start", start), ("end", end)):
        if text is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(text)):
            raise ValueError(f"{name} must look like YYYY-MM-DD")
    if page is not None and int(page) < 1:
        raise ValueError("page must be at least 1")
    if limit is not None and not 1 <= int(limit) <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    if sort_by is not None and sort_by not in SORT_COLUMNS:
        raise ValueError(f"sort_by must be one of {', '.join(SORT_COLUMNS)}")
    if sort_order is not None and sort_order.lower() not in ("asc", "desc"):
        raise ValueError("sort_order must be asc or desc")


def sort_keys(sort_by: str = "timestamp", sort_order: str = "desc", tie: str = "id") -> list[Column]:
    check_arguments(sort_by=sort_by, sort_order=sort_order)
    column = F.col(sort_by)
    lead = column.asc_nulls_last() if sort_order.lower() == "asc" else column.desc_nulls_last()
    return [lead, F.col(tie).asc()]


def newest_first(df: DataFrame, limit: int | None = None) -> DataFrame:
    return df.orderBy(*sort_keys()) if limit is None else offset_page(df, limit)


def ordered_slice(
    df: DataFrame, keys: list[Column], limit: int, offset: int = 0, top_k_rows: int = TOP_K_ROWS
) -> DataFrame:
    """Sort -> offset -> limit. A shallow slice is a top-k plan. A deep one is cut by
    rank from a sorted table, so no task ever holds the rows that are skipped.

    Both orders end in all columns, so equal keys give the same rows either way."""
    if offset + limit <= top_k_rows:
        return df.orderBy(*keys, *[F.col(c).asc() for c in df.columns]).offset(offset).limit(limit)
    return slice_by_rank(counted_layout(df, keys), offset, offset + limit).orderBy(*keys)


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row; null flags are part of it, since the hash itself skips nulls."""
    columns = [F.col(c) for c in df.columns]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def _key_range(df: DataFrame, column: str, lo, hi) -> DataFrame:
    if column == "timestamp":
        return time_range(df, lo, hi)
    return df.where(F.col(column).between(F.lit(lo), F.lit(hi)))


def offset_page(
    df: DataFrame,
    limit: int = 1000,
    offset: int = 0,
    sort_by: str = "timestamp",
    sort_order: str = "desc",
    top_k_rows: int = TOP_K_ROWS,
) -> DataFrame:
    """Offset paging over the whole filtered set.

    Ties of key and id are ordered by a hash of the row. A deep page sorts only keys, ids and hashes, and
    fetches the page's rows by them; of repeated rows it gives as many as fall on the page.
    """
    keys = sort_keys(sort_by, sort_order)
    full = [*keys, F.col(TAIL).asc()]
    marked = df.withColumn(TAIL, row_hash(df))
    if offset + limit <= top_k_rows:
        return marked.orderBy(*full).offset(offset).limit(limit).drop(TAIL)
    found = ordered_slice(marked.select(sort_by, "id", TAIL), full, limit, offset, top_k_rows)
    page_keys = found.groupBy(F.col(sort_by).alias("_key"), F.col("id").alias("_id"), F.col(TAIL).alias("_hash")).agg(
        F.count("*").alias(COPIES)
    )
    wanted = written(page_keys, "page")
    key = F.col("_key")
    ends = wanted.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count_if(key.isNull()).alias("n")).first()
    if not ends["n"]:
        # The page's first and last key reach the scan, and prune dates when sorted by time.
        marked = _key_range(marked, sort_by, ends["lo"], ends["hi"])
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col(sort_by).eqNullSafe(key) & (F.col(TAIL) == F.col("_hash"))
    rows = marked.join(measured(wanted), same).dropDuplicates([sort_by, "id", TAIL])
    rows = rows.withColumn(COPIES, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(COPIES))))
    return rows.orderBy(*full).select(*df.columns)


def page(df: DataFrame, page: int = 1, limit: int = 100, sort_by="timestamp", sort_order="desc", **kw) -> DataFrame:
    check_arguments(page=page, limit=limit)
    return offset_page(df, int(limit), (int(page) - 1) * int(limit), sort_by, sort_order, **kw)


def page_totals(df: DataFrame, page: int = 1, limit: int = 100) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select(
        F.lit(page).cast("bigint").alias("page"),
        F.lit(limit).cast("bigint").alias("limit"),
        "total",
        F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("pages"),
    )


def offset_totals(df: DataFrame, limit: int = 1000, offset: int = 0) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(limit).cast("bigint").alias("limit"),
        F.lit(offset).cast("bigint").alias("offset"),
        (F.lit(offset + limit) < F.col("total")).alias("has_more"),
    )
