"""Rows of an order until a running total reaches a target, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.storage import Workspace


def _same(keys: Sequence[str], others: Sequence[str]) -> Column:
    test = F.lit(True)
    for a, b in zip(keys, others, strict=True):
        test = test & F.col(a).eqNullSafe(F.col(b))
    return test


def take_until(df: DataFrame, groups: Iterable[str], levels: Sequence[Column], order: Iterable[Column], amount: Column, target: float, at_least_one: bool = False) -> DataFrame:
    """Rows of each group, in order, whose total of the rows before them is under the target; so the row that crosses it is in.

    ``levels`` cut the order into steps, and each step into finer ones; none may decrease along the order within a step of the level before.
    Sums by step give the total before each. A step that ends under the target is taken as a whole, whatever its rows' order; the one in
    which the target is met is cut by the next level, and only rows of its last, finest step are put in order. So a step with a third of all
    rows (equal scores) is never one task's window if the levels end with one by position. Amounts aren't negative; a null one counts as 0.
    With a target of 0 or less no row is taken, or with ``at_least_one`` the first.

    ``df`` is computed once: its rows are written, so leave wide columns out and join them to the result.
    """
    groups, order = list(groups), list(order)
    names = [f"__level{k}" for k in range(len(levels))]
    rows = df.withColumns({n: c.cast("long") for n, c in zip(names, levels, strict=True)}).withColumn("__amount", F.coalesce(amount, F.lit(0.0)).cast("double"))
    ws = Workspace(df.sparkSession, "prefix")
    if target <= 0:
        if not at_least_one:
            return df.limit(0)
        kept = [F.col(f"`{c}`") for c in df.columns]
        first = rows.groupBy(*groups).agg(F.min_by(F.struct(*kept), F.struct(*names)).alias("r")) if not order else None
        one = Window.partitionBy(*(groups or [F.lit(1)])).orderBy(*names, *order)
        return first.select("r.*") if first is not None else rows.withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*kept)
    rest = ws.write(rows, "rows").withColumn("__before", F.lit(0.0))
    taken: list[DataFrame] = []
    for k, name in enumerate(names):
        sums = rest.groupBy(*groups, name).agg(F.sum("__amount").alias("__sum"), F.min("__before").alias("__start"))
        window = Window.partitionBy(*(groups or [F.lit(1)])).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)  # a row for each step
        steps = sums.withColumn("__from", F.col("__start") + F.coalesce(F.sum("__sum").over(window), F.lit(0.0))).where(F.col("__from") < target)
        renamed = [F.col(c).alias(f"__k{i}") for i, c in enumerate([*groups, name])]
        steps = ws.write(steps.select(*renamed, "__from", (F.col("__from") + F.col("__sum") < target).alias("__whole")), f"steps{k}")
        joined = rest.drop("__before").join(steps, _same([*groups, name], [f"__k{i}" for i in range(len(renamed))]))
        taken.append(joined.where("__whole"))
        rest = joined.where("not __whole").withColumnRenamed("__from", "__before").drop("__whole", *(f"__k{i}" for i in range(len(renamed))))
        rest = ws.write(rest, f"rest{k}")  # one step of each group, so that finer levels don't go through all rows again
    within = Window.partitionBy(*(groups or [F.lit(1)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # one finest step of each group
    last = rest.withColumn("__total", F.col("__before") + F.coalesce(F.sum("__amount").over(within), F.lit(0.0))).where(F.col("__total") < target)
    out = last.select(*(F.col(f"`{c}`") for c in df.columns))
    for part in taken:
        out = out.unionByName(part.select(*(F.col(f"`{c}`") for c in df.columns)))
    return out


def by_position(pos: str = "pos") -> list[Column]:
    """Levels of a position: steps of 2**26 rows, 2**13 rows, and then the rows."""
    return [F.shiftright(F.col(pos).cast("long"), 26), F.shiftright(F.col(pos).cast("long"), 13)]
