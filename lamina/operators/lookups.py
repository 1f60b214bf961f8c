"""Lookups by key: as joins, so that the number of keys has no limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keyed_left(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Every key once, with its row or nulls."""
    return keys.select(on).distinct().join(table, on, "left")


def keyed_strict(keys: DataFrame, table: DataFrame, on: list[str], witness: str) -> DataFrame:
    """As keyed_left, but a missing row fails the query when it runs."""
    return keyed_left(keys, table, on).withColumn(witness, F.coalesce(witness, F.raise_error(F.concat(F.lit("missing: "), F.to_json(F.struct(*on))))))


def existence(keys: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """key, present."""
    there = table.select(on).distinct().withColumn("present", F.lit(True))
    return keys.select(on).distinct().join(there, on, "left").select(on, F.coalesce("present", F.lit(False)).alias("present"))


def in_list(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys, on, "left_semi")


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The table without the keys."""
    return table.join(keys, on, "left_anti")


def numbered(rows: DataFrame, by: list, name: str) -> DataFrame:
    """The rows with their place, from 1, in a total order; no task holds more than a range of the order.

    Rows are dealt into sorted ranges, which are kept; a row's place is that within its range plus the sizes
    of the ranges before, one number a range.
    """
    at, part = "__at", "__part"
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by).persist().withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33))
    sizes = ranges.groupBy(part).agg(F.count("*").alias("__size"))
    before = sizes.select(part, F.coalesce(F.sum("__size").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return ranges.join(F.broadcast(before), part).select(*rows.columns, place.cast("long").alias(name))


def assign_ids(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, id for new distinct keys: the next ids in order of the key."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = new.select(key).distinct().join(existing.select(key), key, "left_anti")
    return numbered(fresh, [key], "place").join(F.broadcast(top), how="cross").select(key, (F.col("top") + F.col("place")).cast("long").alias("id"))


def first_of_each(table: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    return table.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("__n = 1").drop("__n")


def keep_last(table: DataFrame, most: int, by: list) -> DataFrame:
    """What a limit of `most` newest entries drops."""
    return numbered(table, by, "__n").where(F.col("__n") > most).drop("__n")


def reassign(backup: DataFrame, by: str) -> DataFrame:
    """id, new_id: snapshots renumbered from 1 in a total order."""
    from lamina.operators.predicates import order

    return numbered(backup, order(by), "new_id").select("id", "new_id")


def ends(rows: DataFrame, by: list, most: int = 5) -> DataFrame:
    """What a report shows of a long list: the first and the last `most` rows in a total order, with their place and the total."""
    total = rows.agg(F.count("*").alias("total"))
    return numbered(rows, by, "place").join(F.broadcast(total), how="cross").where((F.col("place") <= most) | (F.col("place") > F.col("total") - most))
