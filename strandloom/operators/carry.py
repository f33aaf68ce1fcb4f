"""Order-dependent work without a window over a whole key: the state of a bin, combined over bins, applied within bins.

Rows lie at positions, and positions are cut into bins. Each bin is summed up in one row (its last row, its first row, its
sum or its largest value), those few rows are ordered over a key, and what the bins before (or after) came to is joined back
to the rows, which are ordered within their bin only. A key that holds most of the rows is spread over as many tasks as it has bins.
Bins are found from the position that the order begins with, so equal positions are never parted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 14
_AT = "_carry_bin"


def _cut(df: DataFrame, order: list[str], width: int) -> DataFrame:
    return df.withColumn(_AT, F.floor(F.col(order[0]) / F.lit(width)).cast("long"))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`left` with the other columns of `right` of the same keys, nulls equal."""
    named = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(named, same, how).drop(*(f"_k{i}" for i in range(len(keys))))


def _neighbour(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], width: int, ahead: bool, there: str | None) -> DataFrame:
    rows, value = _cut(df, order, width), F.struct(*(F.col(c).alias(f"f{k}") for k, c in enumerate(columns)), F.lit(True).alias("there"))
    pick = F.min_by if ahead else F.max_by
    ends = rows.groupBy(*keys, _AT).agg(pick(value, F.struct(*order)).alias("_end"))
    over_bins, inside = Window.partitionBy(*keys).orderBy(_AT), Window.partitionBy(*keys, _AT).orderBy(*order)
    step = F.lead if ahead else F.lag
    given = ends.select(*keys, _AT, step("_end").over(over_bins).alias("_carried")).where("_carried is not null")
    near = join_on(rows.withColumn("_near", step(value).over(inside)), given, [*keys, _AT], "left")
    got = F.coalesce("_near", "_carried")
    found = [got[f"f{k}"].alias(name) for k, name in enumerate(columns.values())]
    return near.select(*df.columns, *found, *([got.isNotNull().alias(there)] if there else []))


def previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], width: int = BIN, there: str | None = None) -> DataFrame:
    """`df` with the values that `columns` (name -> new name) have in the row before, in `order` within `keys`; null in the first row.

    `there` names a column that says whether there is such a row.
    """
    return _neighbour(df, keys, order, columns, width, False, there)


def following(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], width: int = BIN, there: str | None = None) -> DataFrame:
    """`df` with the values of the row after; null in the last row."""
    return _neighbour(df, keys, order, columns, width, True, there)


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, how: str = "sum", with_own: bool = True, width: int = BIN) -> DataFrame:
    """`df` with `name`: the sum or max of `value` over the rows up to each (`with_own`) or before it; null where there are none."""
    rows = _cut(df, order, width)
    fold, join = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest)}[how]
    bins = rows.groupBy(*keys, _AT).agg(fold(value).alias("_total"))
    over_bins = Window.partitionBy(*keys).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    given = bins.select(*keys, _AT, fold("_total").over(over_bins).alias("_carried")).where("_carried is not null")
    inside = Window.partitionBy(*keys, _AT).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if with_own else -1)
    met = join_on(rows.withColumn("_own", fold(value).over(inside)), given, [*keys, _AT], "left")
    whole: Column = F.when(F.col("_own").isNull(), F.col("_carried")).when(F.col("_carried").isNull(), F.col("_own")).otherwise(join(F.col("_own"), F.col("_carried")))
    return met.select(*df.columns, whole.alias(name))
