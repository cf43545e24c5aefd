"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_items(
    df: DataFrame, items: Column | str, item: str, *keep: Column | str, pos: str = "pos"
) -> DataFrame:
    """One row per array element, with its position.

    For a plain explode Spark infers the filter ``size(items) > 0`` and pushes it below the
    projections the array was built in, which evaluates the whole extraction a second time.
    The outer form keeps the array where it is; its rows for empty arrays go right away.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).where(
        F.col(pos).isNotNull()
    )


def of_groups(rows: DataFrame, groups: DataFrame, group: str, spread: Column, copies: int = 16) -> DataFrame:
    """The rows of the given groups (distinct values of ``group``).

    A group may hold most of the rows, so each is met in ``copies`` places, and its rows are
    dealt to them by ``spread``.
    """
    place = F.pmod(F.xxhash64(spread), F.lit(copies))
    met = groups.select(group, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_place"))
    placed = rows.withColumn("_place", place.cast("int"))
    return placed.join(met, [group, "_place"], "left_semi").drop("_place")


def look_up(rows: DataFrame, table: DataFrame, key: list[str], spread: Column, copies: int = 16) -> DataFrame:
    """``rows`` with the columns of the row of ``table`` that has their ``key``, or nulls.

    Keys are unique in ``table``, but most rows may have the same one; as in :func:`of_groups`
    each is met in ``copies`` places.
    """
    place = F.pmod(F.xxhash64(spread), F.lit(copies))
    met = table.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    placed = rows.withColumn("_place", place.cast("int"))
    return placed.join(met, [*key, "_place"], "left").drop("_place")
