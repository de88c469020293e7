"""Running totals over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KINDS = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(df: DataFrame, group: list[str], piece: Column, order: list[str], totals: dict[str, tuple[str, Column]], *, back: bool = False, own: bool = True) -> DataFrame:
    """df with totals (sum, min or max of a column) over the rows of a group up to each one, or from it on (back); without
    the row itself where `own` is false. Null: over no row.

    `piece` cuts a group into runs of `order`: rows are summed within a piece, and pieces by their totals, so that a group
    that holds most rows is as many tasks as it has pieces. df is read twice.
    """
    placed = df.withColumn("_piece", piece)
    by = [F.desc(c) if back else F.asc(c) for c in order]
    inside = Window.partitionBy(*group, "_piece").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    across = Window.partitionBy(*group).orderBy(F.desc("_piece") if back else F.asc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "_piece").agg(*(_KINDS[k][0](x).alias(f"_{n}") for n, (k, x) in totals.items()))
    sums = sums.withColumns({f"_{n}": _KINDS[k][0](f"_{n}").over(across) for n, (k, _) in totals.items()})
    rows = placed.withColumns({n: _KINDS[k][0](x).over(inside) for n, (k, x) in totals.items()}).join(sums, [*group, "_piece"])
    return rows.withColumns({n: _KINDS[k][1](F.col(n), F.col(f"_{n}")) for n, (k, _) in totals.items()}).drop("_piece", *(f"_{n}" for n in totals))
