"""Global row numbers without a task that sees all rows: numbers within parts, and the counts of the parts before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nameweave.scratch import Table, small

#: Rows in a range that is numbered in one task, until there are RANGES of them.
RANGE_ROWS, RANGES = 20_000, 10_000


def _name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _own(df: DataFrame) -> list:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def _added(cut: DataFrame, part: str, within: str, columns: list, name: str) -> DataFrame:
    """Within-part numbers plus the counts of earlier parts; a window runs over one row for each part alone."""
    p = part + "0"
    counts = cut.groupBy(F.col(part).alias(p)).agg(F.count("*").alias("n"))
    before = counts.select(p, F.coalesce(F.sum("n").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = cut.select(*columns, F.col(part), F.col(within)).join(small(before), F.col(part) == F.col(p))
    return rows.select(*columns, (F.col("before") + F.col(within)).cast("long").alias(name))


def numbered(rows: DataFrame, order: list[str], name: str = "row_number", ranges: int | None = None) -> DataFrame:
    """rows with their global number from 0 by the order; rows that are equal in it are numbered in any order.

    Rows are dealt into ranges of the order and written with the range's number; a window numbers those of a range, and the counts
    of the ranges before it are added. A row's place in the table that is dealt out breaks ties, so equal rows, however many, spread over ranges
    too; the table is written before, so that a row that is read again has the same place. A column that is named like the number is replaced.
    """
    part, within, at = _name(rows, "range_"), _name(rows, "within_"), _name(rows, "at_")
    base = Table(rows, "to_number")
    n = ranges or min(RANGES, max(1, -(-base.count() // RANGE_ROWS)))
    dealt = base.df.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(n, *order, at)
    cut = Table(dealt.withColumn(part, F.spark_partition_id()), "ranges").df
    base.drop()
    placed = cut.withColumn(within, F.row_number().over(Window.partitionBy(part).orderBy(*order, at)) - 1)
    return _added(placed, part, within, [c for c, k in zip(_own(rows), rows.columns, strict=True) if k.lower() != name.lower()], name)


def numbered_as_read(rows: DataFrame, name: str = "rec_id") -> DataFrame:
    """rows with their number from 0 in the order of the files' parts and of the rows in them. Nothing is sorted or shuffled."""
    at, part, within = _name(rows, "at_"), _name(rows, "part_"), _name(rows, "within_")
    cut = Table(rows.withColumn(at, F.monotonically_increasing_id()), "as_read").df  # its upper bits are the part's number, the lower 33 the row's
    placed = cut.withColumn(part, F.shiftright(at, 33)).withColumn(within, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    return _added(placed, part, within, [c for c, k in zip(_own(rows), rows.columns, strict=True) if k.lower() != name.lower()], name)
