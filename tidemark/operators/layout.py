"""Range-sorted scratch tables: exact ranks and carries for groups of any size.

Range partitioning on a key that ends in a unique column cuts even one huge
group into even files. Writing the result fixes the cut points, so a lost
executor cannot change them, and every row then has a stable address
(partition number, row number within its file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir

CHUNK, POS, COPIES = "_chunk", "_pos", "_copies"


def sorted_layout(df: DataFrame, order: list[Column], files: int | None = None) -> DataFrame:
    """Write ``df`` globally sorted; read it back with its address columns."""
    spark = df.sparkSession
    path = scratch_dir(spark, "sorted")
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    # The partition number travels with the rows: file names are the writer's own affair.
    numbered = ranged.sortWithinPartitions(*order).withColumn(CHUNK, F.spark_partition_id())
    numbered.write.option("maxRecordsPerFile", 0).parquet(path)
    shape = T.StructType([*df.schema.fields, T.StructField(CHUNK, T.IntegerType())])
    return spark.read.schema(shape).parquet(path).select("*", F.col("_metadata.row_index").alias(POS))


def chunk_offsets(layout: DataFrame, keys: list[str] = (), rows: Column | None = None) -> DataFrame:
    """Per file (and key group): rows, first row number, and group rows in earlier files.

    ``rows`` counts the rows if one stands for several. The window runs over one row per file and group,
    never over table rows.
    """
    rows = F.count("*") if rows is None else rows
    per_chunk = layout.groupBy(*keys, CHUNK).agg(rows.alias("rows"), F.min(POS).alias("first_pos"))
    # Without a key there is one row per file, so a single window task is enough.
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return per_chunk.withColumn("rows_before", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def counted_layout(df: DataFrame, order: list[Column]) -> DataFrame:
    """Sorted layout of the different rows, each with its number of copies.

    Copies are counted before the sort, so no row is hot, and the order ends in all columns, which is unique.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias(COPIES))
    return sorted_layout(counted, [*order, *[F.col(c).asc() for c in df.columns]])


def slice_by_rank(layout: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows of a counted layout with global rank in [start, stop), rank counted from 0; copies are single rows again.

    Only the files that hold a part of the slice are read: their list is at most
    one entry per range partition, and prunes the scan by the statistics of their number.
    """
    hit = chunk_offsets(layout, rows=F.sum(COPIES)).where(
        (F.col("rows_before") < stop) & (F.col("rows_before") + F.col("rows") > start)
    )
    before = {r[CHUNK]: r["rows_before"] for r in hit.collect()}
    if not before:
        return layout.drop(CHUNK, POS, COPIES).limit(0)
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col(CHUNK))
    part = layout.where(F.col(CHUNK).isin(list(before)))
    end = offset + F.sum(COPIES).over(W.partitionBy(CHUNK).orderBy(POS))
    taken = F.least(F.col("_end"), F.lit(stop)) - F.greatest(F.col("_end") - F.col(COPIES), F.lit(start))
    cut = part.withColumn("_end", end).withColumn(COPIES, taken).where(F.col(COPIES) > 0)
    return cut.withColumn(COPIES, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(COPIES)))).drop(CHUNK, POS, COPIES, "_end")
